import pytest
from pyspark.sql import functions as F

from variantlake.functions import text as T
from variantlake.operators import diff, enrich, info, merge, search, serving, splice, versions
from variantlake.sources import readers


def rows(df, *columns):
    got = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in got), key=repr)


def one(spark, schema, values, **columns):
    return spark.createDataFrame([values], schema).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_records_are_assembled_and_diffs_attached(spark):
    v = spark.createDataFrame([(1, "k1", 7), (2, "k2", 7), (3, "k1", 6)], "variant_id int, key string, release int")
    genes = spark.createDataFrame([("k1", "x", 1), ("k1", "x", 1)], "key string, name string, n int")
    got = {r.variant_id: r.gene for r in serving.assemble(v, {"gene": (genes, "key")}).collect()}
    assert (got[1]["name"], got[1]["n"], got[2]) == ("x", 1, None) and len(got) == 3
    d = spark.createDataFrame([("k1", "d1"), ("k9", "d9")], "key string, diff string")
    assert rows(serving.attach_diffs(d, v, 7)) == [(1, "d1")]
    reports = spark.createDataFrame([(1, "SCV1", "-", 7), (2, None, "s2", 7), (3, "SCV1", "s2", 6)], "report_id int, scv string, submission string, release int")
    d = spark.createDataFrame([("SCV1", "a"), ("s2", "b"), ("s3", "c")], "key string, diff string")
    assert rows(serving.attach_report_diffs(d, reports, 7)) == [(1, "a"), (2, "b")]


def test_report_groups(spark):
    r = spark.createDataFrame([("A", 1, "x"), ("A", 3, "y"), ("B", 2, "z")], "Source string, release int, label string")
    assert rows(serving.reports_of_latest(r), "Source", "release") == [("A", 3), ("B", 2)]
    assert rows(serving.report_spans(r, ["Source"], columns=("label",))) == [("A", 1, 3, 2, "x", "y"), ("B", 2, 2, 1, "z", "z")]
    paired = {(x.before.release, x.after and x.after.release) for x in serving.paired_versions(r, ["Source"], "release").collect()}
    assert paired == {(1, 3), (3, None), (2, None)}
    s = spark.createDataFrame([("Two", "2020-01-01"), ("none", "2024-01-01"), ("two", "2021-01-01"), (None, None)], "status string, day string")
    assert [x.day for x in serving.by_review(s, "status", F.col("day"), {"two": 2}).collect()] == ["2021-01-01", "2020-01-01", "2024-01-01", None]


def test_literature(spark):
    papers = spark.createDataFrame([("1", "0"), ("2", "2020"), ("3", None), ("4", "2021")], "pmid string, year string")
    met = spark.createDataFrame([("1", "v"), ("2", "v"), ("3", "v"), ("4", "w")], "pmid string, variant string")
    assert [(r.pmid, r.year) for r in serving.literature(papers, met, "v").collect()] == [("2", "2020"), ("3", None), ("1", "Unknown")]
    assert serving.literature(papers, met).first().pmid == "4"


def test_counts_and_integrity(spark):
    v = spark.createDataFrame([("A, B", "new"), ("A", None), ("B", "deleted")], "Source string, change string")
    got = {r.source: (r.rows, r.new, r.deleted) for r in serving.counts_by_source(v, "Source", "change").collect()}
    assert got == {"A": (2, 1, 0), "B": (2, 1, 1), None: (3, 1, 1)}
    t = lambda *x: spark.createDataFrame(list(x), "source string, ids string")
    got = rows(serving.missing_reports(t(("S", "1,2,3")), t(("S", "1")), t(("S", "2, 9"))))
    assert got == [("S", "3", "missing"), ("S", "9", "unexpected")]
    serving.assert_same_count(v, v)
    with pytest.raises(ValueError):
        serving.assert_same_count(v, v.limit(1))
    with pytest.raises(ValueError):
        merge.check_unique(t(("a", "1"), ("a", "2")), ["source"])
    n = spark.createDataFrame([("1", "-", "0.5"), (None, "", "x")], "a string, b string, c string")
    assert [r.m for r in serving.max_over(n, ["a", "b", "c"], "m").collect()] == [1.0, None]


def test_flags_filters_and_rounding(spark):
    shown = lambda p, ref="A", alt="T", pos=5: one(spark, "pos int, p string, ref string, alt string", (pos, p, ref, alt), f=serving.flag_change(F.col("pos"), [(1, 9)], F.col("p"), F.col("ref"), F.col("alt")))["f"]
    assert shown("p.(Arg1Cys)") and not any([shown("p.(Arg1Ter)"), shown("p.?"), shown("p.(Arg1=)"), shown("p.(Arg1Cys)", pos=10), shown("p.(Arg1Cys)", ref="AT"), shown(None)])
    assert serving.rewrite_hgvs_filters(" Benign ", {"a": "b"}) == ("", {"a": "b", "Pathogenicity_expert": "Benign"})
    assert serving.rewrite_hgvs_filters("benign c.5A>T", {}) == ("benign c.5A>T", {})
    d = spark.createDataFrame([("0.123456", "-", [("AF", "individual", ["0.98765"], None), ("x", "individual", ["0.98765"], None)])],
                              "AF string, other string, diff array<struct<field:string,field_type:string,added:array<string>,removed:array<string>>>")
    r = serving.round_stored(d, ["AF"], 3, "diff").first()
    assert (r.AF, r.other, r.diff[0].added, r.diff[0].removed, r.diff[1].added) == ("0.123", "-", ["0.988"], None, ["0.98765"])


def test_output_columns_and_metadata(spark):
    assert enrich.output_columns(["a", "b", "c", "d"], ["b"], ["e", "a"], {"c": "z", "q": "r"}) == ["a", "d", "e", "z"]
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    meta = spark.createDataFrame([("a", "A", "x", "rename"), ("b", "B", "y", "skip"), ("c", "C", "w", "copy"), ("d", "D", "w", "rename"), ("no", "N", "w", "copy")], "source_name string, name string, category string, action string")
    assert enrich.apply_metadata(df, meta).columns == ["D", "c", "A"] and enrich.apply_metadata(df, meta, ["A"]).first() == (1, 4, 3)
    s = spark.createDataFrame([("X, Y", "1", "2"), ("Y", "1", "2")], "Source string, q_X string, q_Y string")
    assert rows(enrich.without_sources(s, ["Y"])) == [("X", "1")]
    assert rows(enrich.source_flags(s, "Source", ["X"]), "Variant_in_X") == [(False,), (True,)]


def test_pipes_blacklist_and_lookups(spark):
    a, b = enrich.expand_pipes(F.col("c"), 2)
    assert one(spark, "c string", ("x|1,y|1,x|",), a=a, b=b) == {"a": "x&y", "b": "1"}
    df = spark.createDataFrame([("k", "s"), ("m", "t")], "k string, v string")
    assert rows(enrich.blacklist(df, df.filter("k = 'k'"), ["k"], ["v"])) == [("k", "-"), ("m", "t")]
    look = spark.createDataFrame([("k", 5)], "k string, w int")
    assert enrich.must_exist(df.filter("k = 'k'"), look, ["k"], "w").first().w == 5
    with pytest.raises(Exception, match="no w for a key"):
        enrich.must_exist(df, look, ["k"], "w").collect()
    p = spark.createDataFrame([("k", 0, 9, 9), ("k", 2, 1, 1), ("k", 2, 3, 0), ("m", 0, 1, 1)], "k string, preference int, hits int, residues int")
    assert rows(enrich.best_structure(p, ["k"])) == [("k", 2, 3, 0), ("m", 0, 1, 1)]


def test_protein_evidence(spark):
    d = spark.createDataFrame([("G", 10, 20), ("G", 50, 60)], "gene string, start int, end int")
    v = spark.createDataFrame([("G", 10), ("G", 20), ("G", 21), ("G", 55), ("H", 15)], "gene string, pos int")
    assert rows(enrich.in_domain(v, d, "gene", F.col("pos"))) == [("G", 10, True), ("G", 20, True), ("G", 21, False), ("G", 55, True), ("H", 15, False)]
    code = lambda e, inside, p, s: one(spark, "e string, d boolean, p string, s string", (e, inside, p, s), c=enrich.prediction_code(*map(F.col, "edps")))["c"]
    assert [code("missense", True, "0.1", "0.3"), code("missense", True, "0.3", "0"), code("missense", True, "0.1", "0.05"), code("missense", False, "0.9", "0.05"), code("synonymous", False, None, "0.1"), code("missense", True, "0.2", "0.15")] == ["PP3", "PP3", "BP4", "BP1_Strong", "BP4", ""]
    assert one(spark, "p string", ("p.(Gln5Ter)",), c=enrich.truncating_code(F.col("p")))["c"] == "PVS1" and one(spark, "p string", ("p.(Gln5Arg)",), c=enrich.truncating_code(F.col("p")))["c"] == ""


def test_names_and_compared_values(spark):
    bad = lambda x: one(spark, "c string", (x,), v=T.has_bad_parentheses(F.col("c")))["v"]
    assert [bad("(" * 30 + "a" + ")" * 30), bad("a(b)(c)"), bad(""), bad(")("), bad("(()"), bad("())("), bad(None)] == [False, False, False, True, True, True, None]
    f = lambda g, *x: one(spark, ", ".join(f"{n} string" for n in "abc"[:len(x)]), x, v=g(*map(F.col, "abc"[:len(x)])))["v"]
    assert f(T.vcf_value, ";a;b: c;") == "a.b._c" and f(T.strip_parentheses, "p.(A1B)") == "p.A1B"
    assert f(T.strip_protein_suffix, "c.5A>T (p.Lys2Asn)") == "c.5A>T"
    assert [f(T.is_old_nomenclature, x) for x in ("185delAG", "M1V", "c.5A>T", "NM_1.2:c.5A>T", "word")] == [True, True, False, False, False]
    pick = lambda n, l, s: one(spark, "n string, l string, s array<string>", (n, l, s), v=T.preferred_change(F.col("n"), F.col("l"), F.col("s")))["v"]
    assert pick("NM_1.2(GENE):c.5A>T (p.X)", "other", []) == "NM_1.2:c.5A>T" and pick("none", "-", ["NC_1:g.1A>T", "NM_3.1:c.1A>T"]) == "NM_3.1:c.1A>T" and pick("none", "listed", []) == "listed"
    rules = diff.DiffRules("k", "c", lists=frozenset({"l"}), dates=frozenset({"d"}), rounded={"f": 2})
    values = one(spark, "l string, d string, f string, t string", ("b, ,a", "5 March 2020", "0.1234", " - "), **{n: diff.normalise(F.col(n), n, rules) for n in "ldft"})
    assert values == {"l": "b,a", "d": "2020-03-05", "f": "0.12", "t": None}
    a = spark.createDataFrame([("1", "x", None), ("2", "x", "y")], "k string, u string, v string")
    b = spark.createDataFrame([("1", "x", None), ("2", "x", "z"), ("3", "", "")], "k string, u string, v string")
    assert rows(diff.differing_rows(a, b, ["k"]), "k") == [("2",)]
    gone, new = diff.removed_and_added(a, b, ["k"])
    assert rows(gone) == [] and rows(new, "k") == [("3",)]


def test_history_summary_equals_the_join_of_all_versions(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 5), ("a", 2, 7), ("a", 3, 6), ("b", 1, 1), ("c", 5, 2)], "k string, v int, id int")
    where = F.col("v") >= 2
    joined = versions.history_join(df, "k", "v", extra=F.col("old.v") >= 2).groupBy("k", F.col("cur.id").alias("id")).agg(F.count("*").alias("n"), F.min("old.id").alias("least"))
    got = versions.history_summary(df, "k", "v", "n", {"least": "id"}, where)
    assert rows(got, "k", "id", "n", "least") == rows(joined, "k", "id", "n", "least") == [("a", 5, 2, 5), ("a", 6, 3, 5), ("a", 7, 2, 5), ("c", 2, 1, 2)]
    assert rows(versions.number_by_date(spark.createDataFrame([("2021", 0), ("2020", 1)], "d string, x int"), "d"), "d", "name") == [("2020", 1), ("2021", 2)]


def test_components_equal_plain_loops(spark):
    import random

    rng = random.Random(3)
    edges = [(f"p{rng.randrange(60)}", f"s{rng.randrange(40)}") for _ in range(55)] + [(f"p{100 + i}", f"p{101 + i}") for i in range(20)]
    least = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = info.components(spark.createDataFrame(edges + [(None, "x"), ("p0", None)], "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == least


def test_completion_by_release(spark):
    df = spark.createDataFrame([("Alpha alps", 1), ("alphabet beta", 2)], "name string, release int")
    v = search.words(df, ["name"], keep=["release"])
    words = lambda **k: [r.word for r in search.complete(v, "AL", 5, **k).collect()]
    assert words() == ["alphabet"] and words(release=1) == ["alpha", "alps"] and words(release=9) == []
    assert [r.word for r in search.complete(v.drop("release"), "al", 2).collect()] == ["alpha", "alphabet"]


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text("symbol,start,old\nA,5,\nB,6,7\n")
    got = readers.gene_config(spark, str(tmp_path / "g.csv"), "symbol string, start int, old int", {"old": "start"})
    assert rows(got) == [("A", 5, 5), ("B", 6, 7)]
    lines = spark.createDataFrame([("SNP\tProxy\tr2",), ("a\tb\t0.5",), ("a\ta\t1",), ("WARNING no data",), ("a\tz\t0.9",), ("b\ta\tx",)], "value string")
    known = spark.createDataFrame([("a",), ("b",)], "site string")
    assert rows(readers.proxies(lines, known)) == [("a", "b", 0.5)]
    regions = spark.createDataFrame([("13", 100, "ACGTAC")], "chrom string, seq_start long, seq string")
    p = spark.createDataFrame([("13", 101, 3), ("13", 105, 1)], "chrom string, pos long, n int")
    assert rows(readers.sequence_at(p, regions, "chrom", "pos", "n")) == [("13", 101, 3, "CGT"), ("13", 105, 1, "C")]
    v = spark.createDataFrame([("13", 5), ("13", 9), ("17", 5)], "chrom string, pos long")
    assert rows(readers.vcf_region(v, "13", 5, 8)) == [("13", 5)]
    store = versions.Releases(spark, str(tmp_path / "r"))
    store.append(spark.createDataFrame([("a", "new")], "k string, change_type string"), 4)
    assert rows(readers.snapshot(spark, str(tmp_path / "r"), 4)) == [("a", "new")]
    (tmp_path / "j.json").write_text('{"a": 1, "pops": [{"id": "afr", "ac": 3}, {"id": "1kg:afr", "ac": 9}]}\n')
    j = readers.json(spark, str(tmp_path / "j.json"), "a int, pops array<struct<id:string,ac:int>>")
    assert readers.flatten_populations(j, "a", "pops", ["afr", "1kg:afr"], ["ac"]).select("afr_ac", "1kg:afr_ac").first() == (3, None)


def test_equal_values_merge_once(spark):
    a = spark.createDataFrame([("k", ["x"]), ("k", ["x"]), ("k", ["w", "x"]), ("m", None)], "k string, v array<string>")
    b = spark.createDataFrame([("k", ["q"])], "k string, v array<string>")
    m = merge.merge_sources([(merge.SourceSpec("A", {"v": ""}), a), (merge.SourceSpec("B", {"v": ""}), b)], ["k"])
    assert rows(m, "k", "Source", "v_A", "v_B") == [("k", "A,B", ["w", "x"], ["q"]), ("m", "A", [], [])]
    assert splice.same_frame is not None
