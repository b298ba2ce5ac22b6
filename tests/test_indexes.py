import random

from pyspark.sql import functions as F

from variantlake.operators import textindex
from variantlake.sources import binned


def scan(rows, terms):
    """Records in which each term begins some word, by splitting every record."""
    import re

    out = set()
    for key, *texts in rows:
        ws = [w for w in re.split(r"[\s|'\"]+", " ".join(t or "" for t in texts).lower()) if w]
        if all(any(w.startswith(t) for w in ws) for t in terms.lower().split()):
            out.add(key)
    return out


def test_index_equals_the_scan_in_every_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    rng = random.Random(4)
    vocabulary = ["Alpha", "alps", "beta|gamma", "it's", "éclair", "x1", "ab", "a", "delta", "alphabet"]
    make = lambda i: (i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 5))), rng.choice([None, "alpine", "Beta"]))
    schema = "id long, name string, note string"
    first = {i: make(i) for i in range(60)}
    second = {i: (make(i) if i % 7 == 0 else r) for i, r in first.items() if i % 9} | {100: make(100), 101: (101, None, None)}
    third = {i: r for i, r in second.items() if i % 5} | {0: first[0]}
    index = textindex.TextIndex(spark, str(tmp_path))
    assert index.find("alpha").collect() == []
    for release, state in ((1, first), (2, second), (2, second), (3, third)):  # the second is added again
        index.add(spark.createDataFrame([*state.values(), (None, "alpha", "x")], schema), "id", ["name", "note"], release)
    for release, state in ((1, first), (2, second), (3, third), (None, third)):
        for terms in ("ALP be", "a", "éc x", "it s", "zzz", "")[:6 if release == 3 else 3]:
            assert {r.id for r in index.find(terms, release).collect()} == scan(state.values(), terms), (release, terms)
    changed = {i for i in second if second[i] != first.get(i)}
    written = {r.id for r in index.postings().filter("release = 2").select(F.explode("ids").alias("id")).collect()}
    assert written <= changed  # a release writes no words of records that stay as they are
    assert max(r.n for r in index.postings().select(F.size("ids").alias("n")).collect()) <= 16


def test_index_reads_only_the_folders_of_its_terms(spark, tmp_path):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i}") for i in range(500)]
    index = textindex.TextIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame(rows, "id long, name string"), "id", ["name"], 1)
    files = len(index.postings().inputFiles())
    read = index.matches("wab").filter("term is not null")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(head" in plan and "StringStartsWith(word,wab)" in plan
    folders = index.postings().select("head").distinct().count()
    one = index.postings().filter(F.col("head") == textindex.head(F.lit("wab"))).select(F.input_file_name()).distinct().count()
    assert folders > 10 and one <= files // folders + 1
    assert {r.id for r in index.find("wab").collect()} == scan(rows, "wab")


def test_region_reads_equal_a_scan_and_prune(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["1", "2", "X"]), rng.choice([rng.randint(1, 30_000_000), rng.randint(1, 5_000_000), (1 << 20) * rng.randint(1, 5)]), "A" * rng.choice([1, 1, 2, 50, 3000])) for i in range(700)]
    df = spark.createDataFrame([*rows, (9999, None, 5, "A"), (9998, "1", None, "A")], "id long, chrom string, pos long, ref string")
    path = str(tmp_path / "v")
    binned.write_binned(df, path)
    for chrom, a, b in [("1", 1, 2_000_000), ("2", 1 << 20, (1 << 20) + 1), ("X", 4_000_000, 4_100_000), ("1", 29_000_000, 400_000_000), ("3", 1, 10), ("2", 5, 5)]:
        got = binned.read_region(spark, path, chrom, a, b)
        assert got.columns == df.columns
        assert sorted(r.id for r in got.collect()) == sorted(i for i, c, p, r in rows if c == chrom and p <= b and p + len(r) - 1 >= a)
    scanned = binned.read_region(spark, path, "X", 4_000_000, 4_100_000).select(F.input_file_name()).distinct().count()
    plan = binned.read_region(spark, path, "X", 4_000_000, 4_100_000)._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and scanned <= 12 < len(spark.read.parquet(path).inputFiles()) / 4


def test_bins_hold_their_ranges(spark):
    rng = random.Random(7)
    rows = [(a := rng.randint(1, 1 << 36), a + rng.choice([0, 1, 1 << 19, 1 << 21, 1 << 30])) for _ in range(300)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", binned.bin_of(F.col("a"), F.col("b")).alias("bin")).collect()
    for r in got:
        assert r.bin in binned.bins_of(r.a, r.b) and r.bin in binned.bins_of(r.a, r.a) and r.bin in binned.bins_of(r.b, r.b)


def test_folders_do_not_grow_with_the_positions(spark, tmp_path):
    rows = [(i, str(i % 2), i * (1 << 25) + 7) for i in range(2500)]  # up to 2**36: 32,768 bins of the least width don't reach that far
    df, path = spark.createDataFrame(rows, "id long, chrom string, pos long"), str(tmp_path / "v")
    binned.write_binned(df, path, end=F.col("pos") + 5)
    read = spark.read.parquet(path)
    assert read.select("_chrom", "_bin").distinct().count() <= 2 * 600 and read.filter("_bin = 0").count() < 10
    for a, b in ((1, 1 << 26), (1 << 35, (1 << 35) + (1 << 28)), ((1 << 36) + 1, 1 << 40)):
        got = {r.id for r in binned.read_region(spark, path, "1", a, b).collect()}
        assert got == {i for i, c, p in rows if c == "1" and p <= b and p + 5 >= a}
