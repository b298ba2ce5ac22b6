import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from variantlake.llm import mixing, sharding


def h60(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def directory(sizes, limit):
    """The shards by splitting recursively: {(depth, prefix): bytes}."""
    out = {}

    def split(depth, prefix, rows):
        total = sum(b for _, b in rows)
        if total <= limit or depth == 60:
            out[depth, prefix] = total
            return
        for bit in (0, 1):
            p = prefix * 2 + bit
            part = [(h, b) for h, b in rows if h >> (59 - depth) == p]
            if part:
                split(depth + 1, p, part)

    split(0, 0, sizes)
    return out


def shards_of(spark, work, rows, limit, schema="k long, b long"):
    df = spark.createDataFrame(rows, schema)
    return sharding.extendible_shards(df, work, "k", F.col("b"), limit).collect()


def test_only_oversized_buckets_split(spark, work):
    rows = [(i, (i * 37) % 100 + (5000 if i == 7 else 0)) for i in range(400)]
    want = directory([(h60(k), b) for k, b in rows], 600)
    got = shards_of(spark, work, rows, 600)
    assert len(got) == len(rows)
    assert {(r.shard_depth, r.shard_prefix): r.shard_bytes for r in got} == want
    for r in got:
        assert h60(r.k) >> (60 - r.shard_depth) == r.shard_prefix


def test_hot_key_uses_all_bits_and_salt_spreads_it(spark, work):
    rows = [(1, 100)] * 40 + [(i, 1) for i in range(2, 40)]
    got = shards_of(spark, work, rows, 500)
    assert {r.shard_depth for r in got if r.k == 1} == {60}
    df = spark.createDataFrame([(1, 100, i) for i in range(40)], "k long, b long, n long")
    salted = sharding.extendible_shards(df, work, "k", F.col("b"), 500, F.col("n")).collect()
    assert max(r.shard_bytes for r in salted) <= 500


def test_sharding_nulls_empty_and_clashing_columns(spark, work):
    rows = [(None, 10, "x"), (None, None, "y"), (3, None, "z")]
    got = shards_of(spark, work, rows, 100, "k long, b long, shard_depth string")
    assert [(r.shard_depth, r.shard_prefix, r.shard_bytes) for r in got] == [(0, 0, 10)] * 3
    assert shards_of(spark, work, [], 100) == []


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string")


def test_word_count_and_targets(spark, work):
    df = docs(spark, [(1, "a", "x y\t z\x0b\n", "c"), (2, "a", "   ", ""), (3, None, None, ""), (4, "b", "", "")])
    assert [r.size for r in mixing.add_word_count(df).orderBy("doc_id").collect()] == [3, 2, 0, 0]
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 100)], "source string, size long")
    t = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # All want 451.5 of weights 5, 2, 1, 5: the first is capped at 2, the last at 200; 249.5 goes 2 to 1.
    assert t["a"] == 2 and t[None] == 200
    assert abs(t["b"] - 249.5 * 2 / 3) < 1e-9 and abs(t["c"] - 249.5 / 3) < 1e-9


def test_mix_comes_near_targets_and_repeats(spark, work):
    rows = [(i, f"s{i % 4}" if i % 9 else None, "w " * ((i * 7919) % 300 + 1), "") for i in range(600)]
    mixed = [sorted(map(tuple, mixing.mix_to_weights(docs(spark, rows).repartition(n), work).select("doc_id", "source", "size", "target", "taken").collect())) for n in (3, 5)]
    assert mixed[0] == mixed[1]
    by = defaultdict(lambda: [0, 0.0])
    for _, s, size, target, taken in mixed[0]:
        assert taken in (0, size, 2 * size)
        by[s][0] += taken
        by[s][1] = target
    for taken, target in by.values():
        assert abs(taken - target) <= 0.01 * target + 3


def test_many_sources_are_repaired_like_few(spark, work, monkeypatch):
    rows = [(i, f"s{i % 7}" if i % 9 else None, "w " * ((i * 7919) % 300 + 1), "") for i in range(300)]
    taken = lambda: sorted(map(repr, mixing.mix_to_weights(docs(spark, rows).repartition(2), work).select("doc_id", "taken").collect()))
    few = taken()
    monkeypatch.setattr(mixing, "_few", lambda state: False)
    assert taken() == few
    monkeypatch.setattr(mixing, "_repairs", lambda mixed, work: None)
    assert taken() != few


def test_rates_are_the_optimum_of_the_dual(spark, work):
    import math

    rows = [(i, f"s{i % 5}", "w " * (1 + (i * 7919) % (3 if i % 5 == 4 else 400)), "") for i in range(300)] + [(900 + i, "s1", "w " * 20_000, "") for i in range(3)]
    got = mixing.mix_to_weights(docs(spark, rows), work).select("source", "size", "source_size", "target", "rate").collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        target, mean = rs[0].target, sum(r.size for r in rs) / len(rs)
        rate = lambda lam, size: min(2.0, math.exp(max(-600.0, min(600.0, lam * size / mean))))
        low, high = -1e6, 1e6
        for _ in range(200):  # a plain solver: the expected words rise with lam
            mid = (low + high) / 2
            low, high = (mid, high) if sum(r.size * rate(mid, r.size) for r in rs) < target else (low, mid)
        full = target >= 2 * rs[0].source_size * (1 - 1e-12)
        assert all(abs(r.rate - (2.0 if full else rate(low, r.size))) < 1e-4 for r in rs)


def test_mix_edge_cases(spark, work):
    assert mixing.mix_to_weights(docs(spark, []), work).collect() == []
    rows = [(1, None, None, ""), (1, None, "a b", ""), (None, "x", "c", ""), (2, "x", "", "")]
    got = mixing.mix_to_weights(docs(spark, rows), work).collect()
    assert len(got) == 4 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    again = mixing.repeat(docs(spark, rows), work)
    assert again.columns == ["doc_id", "source", "text", "size"]


def test_repeat_is_the_same_by_broadcast_and_by_shuffle(spark, work, monkeypatch):
    rows = [(i % 190 if i % 11 else None, f"s{i % 3}", "w " * ((i * 7919) % 50), "") for i in range(200)]
    found = []
    for bound in (mixing.BROADCAST_ROWS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
        found.append(sorted(map(repr, mixing.repeat(docs(spark, rows), work).collect())))
    assert found[0] == found[1] and len(found[0]) > len(rows) // 2


def test_repeated_keys_are_mixed_row_by_row(spark, work):
    rows = [(i % 200, "w " * (5 + i % 7), f"s{i // 200}", "x") for i in range(400)] + [(None, "w " * 9, "s1", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    targets = {r.source: r.target for r in mixing.source_targets(mixing.add_word_count(df.drop("size"))).collect()}
    got = mixing.repeat(df, work)
    assert got.columns == df.columns
    taken = {}
    for r in got.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert set(taken) == set(targets) and all(abs(taken[s] - t) <= 2 for s, t in targets.items()), (taken, targets)
