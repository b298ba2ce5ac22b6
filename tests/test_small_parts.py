import json

from pyspark.sql import functions as F

from variantlake.functions import collections as R
from variantlake.functions import numbers as M
from variantlake.functions import text as T
from variantlake.operators import info, merge
from variantlake.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_tables_without_headers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#chrom start\nchr1\t5\t9\tx\nchr2\t0\t1\ty\n")
    got = readers.bed(spark, str(tmp_path / "a.bed"), "chrom string, start long, end long, name string").collect()
    assert [tuple(r) for r in got] == [("chr1", 5, 9, "x"), ("chr2", 0, 1, "y")]
    (tmp_path / "b.csv").write_text("k,v\n1,a\n2,\n")
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "b.csv"), "k int, v string", True, ",").collect()] == [(1, "a"), (2, None)]
    s = spark.createDataFrame([(1, ["Lab ENIGMA x"]), (2, ["other"]), (3, [])], "id int, by array<string>")
    assert [r.id for r in readers.with_submitter(s, "by", "ENIGMA").collect()] == [1]


def test_valid_and_rejected_rows(spark):
    df = spark.createDataFrame([("1,2", "k1", None), ("3, -", "k2", "no change"), ("-", "k3", "outside boundaries")], "ids string, key string, reason string")
    good, bad = merge.split_valid(df)
    assert good.columns == ["ids", "key"] and [r.key for r in good.collect()] == ["k1"] and {r.key for r in bad.collect()} == {"k2", "k3"}
    log = merge.rejected_log(bad.withColumn("source", F.lit("S")), "ids", "source", ["key"])
    assert [(r.id, r.reason, r.key) for r in log.collect()] == [("3", "no change", "k2")]


def test_pages_and_metadata_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    got = json.loads(writers.json_page(df, 7, 2, 1).first()[0])
    assert (got["count"], got["synonyms"], got["deletedCount"]) == (7, 2, 1) and sorted(x["id"] for x in got["data"]) == [1, 2]
    assert json.loads(writers.json_page(df.limit(0), 0, 0, 0).first()[0])["data"] == []
    d = spark.createDataFrame([("k1", [("f", "x")]), ("k2", []), ("k3", None)], "key string, diff array<struct<field:string,added:string>>")
    writers.diff_json(d, str(tmp_path / "d"), "key")
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "d")).collect()] == [{"key": "k1", "diff": [{"field": "f", "added": "x"}]}]
    assert json.loads(writers.version_metadata(spark, {"date": "2024", "release": "7"}).first()[0]) == {"date": "2024", "release": "7"}
    urls = [r.url for r in writers.sitemap(df, "id", "https://x/", ["about"]).collect()]
    assert urls == ["https://x/about", "https://x/1", "https://x/2"]


def test_expressions(spark):
    f = F.lit
    got = one(spark, a=T.bases_only(f("AC-GT")), b=T.bases_only(f("ACx")), c=T.sequence_only(f("ACNRY")), d=T.sequence_only(f("")), e=T.source_urls(f("1,2"), "u/"), **dict(zip("xyz", M.percent_triple(f("12.5,50,x")))), l=M.last_percent(f("1,2,75")))
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": "u/1,u/2", "x": 0.125, "y": 0.5, "z": None, "l": 0.75}
    structs = F.array(*[F.struct(f(n).alias("tx"), f(v).alias("v")) for n, v in (("NM_1.1", 1), ("NM_2.3", 2), ("NM_2.4", 3))])
    got = one(spark, a=R.first_matching(structs, "tx", ["NM_2", "NM_9"])["v"], b=R.first_matching(structs, "tx", ["NM_7"])["v"], c=R.text_or_attribute(f("-"), f("attr")), d=R.text_or_attribute(f("text"), f("attr")), e=R.text_or_attribute(f(None), f(None)))
    assert got == {"a": 2, "b": None, "c": "attr", "d": "text", "e": None}


def test_samples_repeat_and_hold_their_share(spark):
    df = spark.range(4000)
    a, b = ({r.id for r in info.sample_rows(df, 0.25, 3).collect()} for _ in range(2))
    assert a == b and 800 < len(a) < 1200 and info.sample_rows(df.limit(0), 0.5, 1).count() == 0


def test_harmonised_keys_name_their_text_a_few_times(spark):
    c = F.concat(F.col("a"), F.lit("_"))
    df = spark.createDataFrame([("NC_000013.11:g.100:A>T",), ("chr1:5:A>T:",), ("X",), ("1:g.2:3:c",), ("NC_0:7",), (None,)], "a string")
    got = [r.k for r in df.select(T.harmonise_key(c).alias("k")).collect()]
    assert got == ["chr13:g.100A>T_", "chr1:g.5A>T:_", "X_:g.X_", "1:g.23c_", "NC_0:g.7_", None]
    for f in (T.harmonise_key, T.add_g):  # what repeats its text in each step is too large to compile in a query
        plan = df.select(f(c).alias("k"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("concat(a#") <= 2
