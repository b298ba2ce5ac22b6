import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlake.llm import codes, resampling


def features(text, low, high):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def test_gram_checksums_equal_direct_ones():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 70)).astype(np.uint8)) for _ in range(300)] + ["ß漢é".encode() * 50]
    got = list(resampling.gram_crcs(words, 1, 4))
    for n, crcs in enumerate(got, 1):
        assert crcs.tolist() == [zlib.crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]
    assert list(resampling.gram_crcs([], 1, 3)) == [] and [len(x) for x in resampling.gram_crcs([b"a"], 1, 3)] == [1]


@pytest.mark.parametrize("grams", [(1, 1), (1, 3)])
def test_ranks_equal_a_plain_loop(spark, work, grams, monkeypatch):
    monkeypatch.setattr(resampling, "GROUP", 40)  # so that texts are cut
    rng = np.random.default_rng(2)
    vocabulary = ["The", "cat", "öl", "x-ray", "42", "E=mc2", "漢字", "foo_bar", "zebra"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(300)] + ["", None, "!!!", "word " * 20000] + ["same text of some words " * 8] * 6
    rows = [(i, t, "clash", -1) for i, t in enumerate(texts)] + [(7, texts[7], "again", 0), (None, texts[8], "no key", 0)]
    target = ["cat zebra 42 " * 5, None, "zebra"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string, rank int")
    got = resampling.rank_by_target(docs, spark.createDataFrame([(t,) for t in target], "text string"), work, grams=grams)
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for table, group in ((s, [r[1] for r in rows]), (t, target)):
        for text in group:
            for f in features(text, *grams)[1]:
                table[bucket(f)] += 1
    big_s, big_t = int(s.sum()), int(t.sum())
    want, allowed = {}, []
    for i, (key, text, *_) in enumerate(rows):
        words, fs = features(text, *grams)
        gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (big_s + 10000) / ((int(s[b]) + 1) * (big_t + 10000)))) for b in map(bucket, fs)]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want[i] = (key, len(fs), weight, score)
        if len(words) >= 20:
            allowed.append(i)
    order = sorted(allowed, key=lambda i: (-want[i][3], rows[i][0] is None, rows[i][0] or 0))[:10 * len(allowed) // 100]
    ranks = {i: r for r, i in enumerate(order, 1)}
    plain = sorted((repr((*w, ranks.get(i))) for i, w in want.items()))
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got.collect()) == plain
    assert len(order) > 10


def test_resample_returns_whole_rows(spark, work):
    docs = spark.createDataFrame([(i % 250, f"{'good' if i % 5 == 0 else 'bad'} " * 30, i) for i in range(500)], "doc_id long, text string, _n int")
    target = spark.createDataFrame([("good " * 500,)], "text string")
    got = resampling.resample(docs, target, work, share=(1, 5))
    assert got.columns == docs.columns and got.count() == 100
    assert sum("good" in r.text for r in got.collect()) >= 75
    assert resampling.resample(docs.limit(0), target, work).collect() == []
    assert resampling.rank_by_target(docs.limit(0), target.limit(0), work).collect() == []


def plain_codes(x, entries, rounds):
    n, d = x.shape
    parts = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    parts = np.pad(parts, ((0, 0), (0, -d % 16))).reshape(n, 16, -1)
    books = parts[:entries].transpose(1, 0, 2).copy()
    dist = lambda p: ((parts[:, p, None, :] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(16):
            near = dist(p).argmin(1)
            for e in range(len(books[p])):
                if (near == e).any():
                    s = parts[near == e, p].sum(0)
                    books[p, e] = [int(v) // int((near == e).sum()) for v in s]
    near = np.stack([dist(p).argmin(1) for p in range(16)], 1)
    error = sum(dist(p).min(1) for p in range(16))
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return ["".join(f"{v:02x}" for v in row) for row in near], error, digest


@pytest.mark.parametrize("n,d", [(1500, 64), (40, 48), (300, 20)])
def test_codes_equal_plain_means(spark, work, n, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(n, d)) * rng.choice([0.05, 1.0], size=(n, 1))).astype(np.float32)
    x[10:30] = np.round(x[10:30] * 2) / 2  # ties
    x[30:35] = x[30]
    rows = [(i, [float(v) for v in r], i % 3 or None, "x") for i, r in enumerate(x)]
    odd = [(9001, None, 1, ""), (9002, [float("nan")] * d, 1, ""), (9003, [1.0] * (d - 1), 1, ""), (9004, [None] * d, 1, ""), (9005, [float("inf")] * d, 1, ""), (9006, [], 1, "")]
    df = spark.createDataFrame(rows[::-1] + odd, "vec_id long, embedding array<float>, label int, code string")
    got = {r.vec_id: r for r in codes.compress(df, work).collect()}
    code, error, digest = plain_codes(x, 64, 2)
    assert set(got) == set(range(n))
    sums = {k: int(error[[i for i in range(n) if (i % 3 or None) == k]].sum()) for k in (None, 1, 2)}
    for i in range(n):
        assert (got[i].code, got[i].error, got[i].codebooks_sha256, got[i].label_error) == (code[i], error[i], digest, sums[i % 3 or None])


def test_boxes_rule_out_only_what_cannot_win():
    rng = np.random.default_rng(5)
    points, entries = rng.integers(-300, 300, (5000, 4)), rng.integers(-300, 300, (64, 4))
    entries[40] = entries[3]
    order, starts = codes.blocks(points)
    assert sorted(order.tolist()) == list(range(5000))
    s = points[order]
    allowed = codes.shortlists(np.minimum.reduceat(s, starts, axis=0), np.maximum.reduceat(s, starts, axis=0), entries)
    best, error = codes.assign(s, starts, allowed, entries)
    d = ((s[:, None, :] - entries) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (error == d.min(1)).all()
    assert allowed.mean() < 0.5


def test_codes_of_huge_wide_and_no_vectors(spark, work):
    df = spark.createDataFrame([(1, [1e30] * 2048, 1), (2, [-1e30] * 2048, 1), (None, [0.0] * 2048, None)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in codes.compress(df, work).collect()}
    assert len(got) == 3 and all(r.error == 0 for r in got.values())
    assert codes.compress(df.limit(0), work).collect() == []
    assert codes.compress(df.select("vec_id", F.array().cast("array<double>").alias("embedding"), "label"), work).collect() == []


def test_hilbert_neighbours_touch():
    for w, side in ((2, 16), (3, 8), (4, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * w, indexing="ij"), -1).reshape(-1, w)
        path = grid[np.argsort(codes.hilbert_keys(grid), kind="stable")]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).mean() > 0.95
