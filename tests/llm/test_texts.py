import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from variantlake.llm import neardup, suffix_tree
from variantlake.llm.common import FREED, Workspace

SCHEMA = "doc_id long, text string, score string"


def test_suffix_tree_scores(spark, work):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = "one two three four".split() if i % 2 else "eins zwei drei vier".split()
        rows.append((i, " ".join(rng.choice(words) + ("" if rng.random() < 0.9 else f"x{rng.randrange(50)}") for _ in range(40)).upper() + "\t", ""))
    rows += [(1000, None, ""), (1001, "", ""), (1002, "never seen words", ""), (1002, "never seen words", ""), (None, "one", ""), (1003, "one " * 50_000, "")]
    got = suffix_tree.score_texts(spark.createDataFrame(rows, SCHEMA), work).collect()
    assert len(got) == len(rows)
    tok = lambda t: [w for w in (t or "").lower().split()] + [""]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not fold(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = {i: tok(t) for i, t, _ in rows}
    better = []
    for r in got:
        t = want[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id), len(t), sum(w in c for w in t), n)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base))
        if r.held_out and r.doc_id is not None and r.doc_id < 300:
            better.append(r.score > base)
    assert len(better) > 20 and all(better)
    assert suffix_tree.score_texts(spark.createDataFrame([], SCHEMA), work).collect() == []


def test_suffix_tree_equals_counting_by_hand(spark, work, monkeypatch):
    # Words of a handful of occurrences in a larger corpus of other words, with contexts of three words that matter.
    rng = random.Random(3)
    rows = []
    for i in range(900):
        ends = {"p": "x", "q": "y"}
        a = rng.choice("pq")
        rows.append((i, f"{a} k l {ends[a]} " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(30)), ""))
    rows += [(2000 + i, f"seldom{i % 5} seen pair{i % 5} of words", "") for i in range(60)] + [(None, None, ""), (3000, "k l x", "")]
    tok = lambda t: [" "] + (t or "").lower().split() + [""]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [tok(t) for i, t, _ in rows if not fold(i)]
    words = Counter(w for t in train for w in t[1:])
    n, v = sum(words.values()), len(words)
    s, states, depth = suffix_tree.SMOOTH, {}, 0

    def prob(context, x, longest):
        for d in range(min(longest, len(context)), 0, -1):
            if (state := states.get(tuple(context[-d:]))) is not None:
                return state[0].get(x) or prob(context, x, d - 1) * state[1]
        return (words[x] + 1) / (n + v + 1)

    while True:
        depth += 1
        seen = {}
        for t in train:
            for i in range(depth, len(t)):
                seen.setdefault(tuple(t[i - depth:i]), Counter())[t[i]] += 1
        new = {}
        for c, nexts in seen.items():
            kept = {x: m for x, m in nexts.items() if m >= 3}
            if sum(nexts.values()) < 5 or not kept:
                continue
            below = {x: prob(c, x, depth - 1) for x in kept}
            p = {x: (m + s * below[x]) / (sum(nexts.values()) + s) for x, m in kept.items()}
            rest, rest_below = 1 - sum(p.values()), 1 - sum(below.values())
            if sum(nexts.values()) * (sum(p[x] * math.log(p[x] / below[x]) for x in p) + rest * math.log(rest / rest_below)) >= suffix_tree.DIVERGE:
                new[c] = (p, rest / rest_below)
        states.update(new)
        if depth == suffix_tree.PASSES[-1][-1]:
            break
    assert ("p", "k", "l") in states and len(states) > 20
    for c in [*states][::7]:  # over all words and one for the unseen
        assert abs(sum(prob(list(c), x, depth) for x in [*words, "?"]) - 1) < 1e-6
    want = {i: sum(math.log10(prob(t[:j], t[j], len(t))) for j in range(1, len(t))) for i, t in ((i, tok(t)) for i, t, _ in rows)}
    for table in (suffix_tree.TABLE, 0.002):  # all n-grams in the tasks, some by join
        monkeypatch.setattr(suffix_tree, "TABLE", table)
        got = suffix_tree.score_texts(spark.createDataFrame(rows, SCHEMA), work).collect()
        assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-6 * abs(want[r.doc_id]) for r in got)


def shingles(t):
    w = t.lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weighted(a, b):
    return sum(min(a.get(g, 0), b.get(g, 0)) for g in {*a, *b}) / max(1, sum(max(a.get(g, 0), b.get(g, 0)) for g in {*a, *b}))


def test_near_duplicates(spark, work, monkeypatch):
    monkeypatch.setattr(neardup, "CELLS", 1 << 20)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(60, 400))] for _ in range(120)]
    texts = [" ".join(b) for b in base]
    for i in range(40):  # near copies: one word in forty changes at most
        b = list(base[i])
        b[rng.randrange(len(b))] = "changed"
        texts.append(" ".join(b))
    for i in range(20):  # far copies: half of the text
        texts.append(" ".join(base[i][: len(base[i]) // 2] + [rng.choice(vocab) for _ in range(100)]))
    texts += [texts[0]] * 30 + ["", "", "a b", "a b", "A  b", "x" * 200_000]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(500, None, ""), (None, texts[1], ""), (7, texts[7], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = neardup.near_duplicate_classes(df, work).collect()
    assert len(got) == len(rows)
    label = {r.doc_id: r.class_id for r in got}
    s = [shingles(t) for t in texts]
    df_of, different = Counter(g for t in set(texts) for g in shingles(t)), len(set(texts))
    w = [{g: n * (1 + neardup.IDF * math.log(different / df_of[g])) for g, n in x.items()} for x in s]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or weighted(w[i], w[j]) >= 0.8]
    parent = list(range(len(texts)))
    for _ in range(5):
        for i, j in linked:
            parent[i] = parent[j] = min(parent[i], parent[j])
    assert [label[i] for i in range(len(texts))] == parent
    assert label[500] == label[texts.index("")] and label[None] == label[1]
    left = neardup.deduplicate(df, work)
    assert left.columns == df.columns
    left = left.collect()
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, neardup.deduplicate(df, work).collect())) == sorted(map(repr, left))
    ids = [r.doc_id for r in left]
    assert sorted(i for i in ids if i is not None) == sorted(set(parent))
    assert neardup.near_duplicate_classes(df.limit(0), work).collect() == []


def test_edited_copies_of_a_text_that_a_third_of_all_documents_share(spark, work, monkeypatch):
    monkeypatch.setattr(neardup, "CELLS", 1 << 20)
    rng = random.Random(12)
    base = [f"v{i}" for i in range(200)]
    texts = [" ".join(base)] * 100
    for i in range(12):  # three separate edits each: 0.86 of the shingles are shared
        b = list(base)
        for at in (30, 90, 150):
            b[at + i] = f"e{i}x{at}"
        texts.append(" ".join(b))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(220)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(df, work).collect()}
    assert [label[i] for i in range(len(texts))] == [0] * 112 + list(range(112, len(texts)))


def test_one_key_with_two_texts_in_any_order(spark, work, monkeypatch):
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(3))
    rows = [(5, a), (5, b), (9, a + " one"), (3, b + " one"), (20, c), (None, c), (None, c + " one"), (None, "alone"), (None, "alone"), (30, a)]
    want = {a: 5, a + " one": 5, b: 3, b + " one": 3, c: 20, c + " one": 20, "alone": None}
    monkeypatch.setattr(neardup, "CELLS", 1 << 16)
    for hot in (1000, 1):
        monkeypatch.setattr("variantlake.llm.common.HOT_ROWS", hot)
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [(r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(df, Workspace(spark, "any")).collect()]
        assert sorted(got, key=repr) == sorted(((i, want[t]) for i, t in rows), key=repr)
        left = [(r.doc_id, r.text) for r in neardup.deduplicate(df, Workspace(spark, "any")).collect()]
        assert sorted(left, key=repr) == sorted([(5, a), (3, b + " one"), (20, c), (None, "alone")], key=repr)


def test_frequencies_are_those_of_counting(spark, work):
    rng = random.Random(2)
    texts = sorted({" ".join(rng.choices("abcdef", k=rng.randint(5, 60))) for _ in range(400)})
    idf = neardup.fit_idf(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    df_of = Counter(g for t in texts for g in shingles(t))
    sh, errors = neardup.Shingler(), []
    for g, n in df_of.items():
        _, w = idf.weigh(sh(" ".join(g).encode()))
        errors.append(abs(w[0] - (1 + neardup.IDF * math.log(len(texts) / n))))
    # A byte keeps steps of 1/8 in the logarithm; two shingles of one cell count together.
    assert np.quantile(errors, 0.995) <= neardup.IDF / neardup.STEPS / 2 + 1e-4 and len({round(neardup.IDF * math.log(n), 2) for n in df_of.values()}) > 5


def test_large_groups_in_blocks(spark, work, monkeypatch):
    monkeypatch.setattr(neardup, "CELLS", 1 << 20)
    monkeypatch.setattr(neardup, "SMALL_GROUP", 4)
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = random.Random(11)
    base = [f"v{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(150):  # each two edits away from the base: some are linked with each other, some with none
        b = list(base)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(b))
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    label = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(df, work).collect()}
    idf = neardup.fit_idf(df)
    sh = neardup.Shingler()
    v = [idf.weigh(sh(t.encode())) for t in texts]
    near = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if neardup.weighted_jaccard(v[i], v[j]) >= 0.8}
    i, j = neardup.similar_pairs(v)
    assert set(zip(i.tolist(), j.tolist())) == near
    parent = list(range(len(texts)))
    for _ in range(20):
        for a, b in near:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert [label[k] for k in range(len(texts))] == parent and 1 < len(set(parent)) < 150


def test_weighted_pairs():
    rng = np.random.default_rng(8)
    v = []
    for _ in range(40):
        e = np.sort(rng.choice(10, 9, replace=False)).astype(np.uint64)
        v.append((e, rng.choice([2, 2, 2, 3], 9) * np.where(e < 4, 1.5, 4.6)))
    i, j = neardup.similar_pairs(v)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if neardup.weighted_jaccard(v[a], v[b]) >= 0.8}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(4)
    agree = 0
    sampler = neardup.Sampler()
    e = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    w = np.where(rng.random(400) < 0.5, 4.0, 8.0)
    total = 0
    for _ in range(60):
        e = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        a, b = sampler.bands(e, w), sampler.bands(e[40:], w[40:])
        agree += (a == b).sum()
        total += len(a)
    j = w[40:].sum() / w.sum()
    assert abs(agree / total - j**neardup.ROWS) < 0.06


def test_values_meet_the_rarer_n_grams_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "PACKED", 3000)
    rng = np.random.default_rng(7)
    model = {int(g): float(v) for g, v in zip(rng.integers(-2**63, 2**63, 5000), rng.normal(size=5000))}
    known, seen, packs, want = np.array([*model]), [], [], Counter()
    for batch in (0, 40, 1 << 33):
        at = np.sort(rng.integers(0, 40, 9000))
        g = np.where(rng.random(9000) < 0.6, rng.choice(known, 9000), rng.integers(-2**63, 2**63, 9000))
        g[::3] = known[0]  # a hot one
        for a, x in zip(at.tolist(), g.tolist()):
            if x in model:
                want[batch + a] += model[x]
        packs += [(i, batch, x.tobytes(), suffix_tree._steps(y)) for i, x, y in suffix_tree._pack(g.view(np.uint64), at, 16)]
        seen.append(len(packs))
    values = spark.createDataFrame([*model.items()], "g long, v double")
    packed = spark.createDataFrame(packs, "bucket int, batch long, gs binary, at binary")
    assert seen[-1] <= 3 * 16  # rows that are shuffled, of 27,000 n-grams
    got = {r.row: r.states for r in suffix_tree._sum_values(packed, values, 16).collect()}
    assert set(got) == set(want) and all(abs(got[r] - want[r]) < 1e-9 for r in want)
    assert suffix_tree._sum_values(packed, values.limit(0), 16).collect() == []


def test_frequencies_are_the_same_from_lists_and_from_counters(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELLS", 1 << 16)
    rng = random.Random(8)
    df = spark.createDataFrame([(" ".join(rng.choices("abc", k=rng.randint(5, 60))),) for _ in range(200)], "text string").repartition(2).cache()
    lists = neardup.fit_idf(df).steps
    monkeypatch.setattr(neardup, "FEW", 50)
    assert lists.any() and (neardup.fit_idf(df).steps == lists).all()


def test_words_of_the_suffix_tree_are_hashed_as_split_and_counted_without_a_row_each(spark, work):
    rng = random.Random(8)
    texts = [None, b"", b" ", b"\tA b \x0b\x0c", b"x" * 100_000, b"y " + b"z" * 40_000 + b" y", b"Ab", b"aB c\r\nd\x1c\x85e", "Äh äh".encode()]
    texts += [b"".join(rng.choice([b"a", b"B", b" ", b"\n", b"cd", b"\x00", b"\x08", b"\x0e"]) for _ in range(rng.randrange(300))) for _ in range(200)]
    array, seen, counts = pa.array(texts, pa.binary()), {}, Counter()
    for part in (array, array[1:5], array[5:6], array[:2], array[:0]):
        hashes, sizes = suffix_tree._words(part)
        want = [[0, "begin", *(t or b"").lower().split(), "end"] for t in part.to_pylist()]
        assert sizes.tolist() == [len(t) for t in want]
        for word, h in zip((w for t in want for w in t), hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        if part is array:
            counts.update(seen[w] for t in want for w in t[2:])
    assert len({*seen.values()}) == len(seen)
    got = suffix_tree.count_words(spark.createDataFrame([(None if t is None else t,) for t in texts], "text binary"))
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()  # which takes a row for each word of a task
    assert {r.g % (1 << 64): r.n for r in got.collect()} == counts


def test_keys_sort_where_their_first_bits_are_equal():
    keys = np.array([5, 3, 5, 1, 1 << 63, 3, 4, (1 << 63) + 1, 1 << 63], np.uint64)
    order, done, first = suffix_tree._sort(keys)
    assert done.tolist() == sorted(keys.tolist()) == keys[order].tolist() and done[first].tolist() == sorted({*keys.tolist()})
    assert [len(x) for x in suffix_tree._sort(keys[:0])] == [0, 0, 0]
    for buckets in (1, 2, 16):
        parts = [*suffix_tree._parts(done, buckets, done)]
        assert b"".join(x for _, x in parts) == done.tobytes() and len({i for i, _ in parts}) == len(parts) <= buckets


def test_suffix_tree_keeps_no_shuffle_files_and_scores_alike_in_parts(spark, work, monkeypatch):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(9000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 30:i * 30 + 30]), "") for i in range(300)] + [(None, "w1", ""), (7, None, "")], SCHEMA)
    files = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    keep, left, steps, before = Workspace.keep, [], [], files()

    def kept(self, df, step):
        out = keep(self, df, step)
        left.append(len(files() - before))
        steps.append(step)
        return out

    monkeypatch.setattr(Workspace, "keep", kept)
    monkeypatch.setattr(Workspace, "clean", lambda self: None)  # which deletes them at some later time
    monkeypatch.setattr(suffix_tree, "TABLE", 0.002)
    want = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score_texts(df, work).collect())
    assert len(left) > 20 and not any(left)
    assert spark.conf.get(FREED, None) is None  # the session's own setting
    one = sum(s.startswith("scored-") for s in steps)
    monkeypatch.setattr(suffix_tree, "PART", suffix_tree.PART / 8)
    again = suffix_tree.score_texts(df, Workspace(spark, "test")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in again) == want
    assert sum(s.startswith("scored-") for s in steps) - one > one


def _files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [files.apply(i) for i in range(files.size())]


def test_scoring_is_dealt_by_what_is_packed():
    few, full = np.zeros(64, np.uint64), np.full(64, 2**64 - 1, np.uint64)
    n = [suffix_tree._score_parts(int(share * 1e6), few, 10**6) for share in (0, 0.1, 0.5, 1, 6)]
    assert n[:2] == [1, 1] and n == sorted(n) and 6 / n[-1] <= suffix_tree.PART
    assert suffix_tree._score_parts(0, full, 10**6) >= n[-1] and suffix_tree._score_parts(0, few, 0) == 1


def test_equal_contexts_stand_together_in_a_bucket():
    rng = np.random.default_rng(3)
    keys, contexts = np.sort(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)), rng.choice(rng.integers(0, 1 << 63, 40, np.uint64), 5000)
    for buckets in (1, 2, 16):
        order, by = suffix_tree._by_context(keys, contexts, buckets)
        assert sorted(order.tolist()) == [*range(5000)]
        want = {i: Counter(np.frombuffer(x, np.uint64).tolist()) for i, x in suffix_tree._parts(keys, buckets, contexts)}
        for i, x in suffix_tree._parts(by, buckets, contexts[order]):
            c = np.frombuffer(x, np.uint64)
            assert Counter(c.tolist()) == want.pop(i) and (c[1:] != c[:-1]).sum() + 1 == len({*c.tolist()})
        assert not want
