import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variantlake.operators import diff, enrich, info, merge, ranges, search, splice, versions


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_versions(spark, tmp_path):
    store = versions.Releases(spark, str(tmp_path / "v"))
    r1 = spark.createDataFrame([("a", 1, "new"), ("b", 1, "new"), ("c", 1, None)], "k string, v int, change_type string")
    store.append(r1, 1)
    store.append(spark.createDataFrame([("a", 2, "changed_information")], r1.schema), 2, spark.createDataFrame([("b", 1)], "k string, v int"))
    cur = {r.k: (r.v, r.release, r.change_type) for r in store.current(["k"]).collect()}
    assert cur == {"a": (2, 2, "changed_information"), "b": (1, 2, "deleted")}
    assert rows(versions.live(store.current(["k"])).select("k")) == [("a",)]
    assert store.remove_latest() == 2 and {r.k for r in store.read().collect()} == {"a", "b"}
    reports = spark.createDataFrame([("X", "7", None), ("Y", None, "9"), ("Y", None, "1")], "Source string, x string, y string")
    variants = spark.createDataFrame([(1, "6,7", "-"), (2, "", "9")], "variant_id int, x string, y string")
    got = versions.attach_reports(variants, reports, {"X": "x", "Y": "y"})
    assert {(r.Source, r.report_id, r.variant_id) for r in got.collect()} == {("X", "7", 1), ("Y", "9", 2), ("Y", "1", None)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), min_size=1, max_size=25), st.lists(st.integers(-5, 80), min_size=1, max_size=25))
def test_range_operators_equal_plain_loops(spark, spans, points):
    r = spark.createDataFrame([(i, "c", s, s + n) for i, (s, n) in enumerate(spans)], "rid int, chrom string, start long, end long")
    p = spark.createDataFrame([(i, "c", x) for i, x in enumerate(points)], "pid int, chrom string, pos long")
    met = ranges.point_lookup(p, r, ["chrom"], "pos", "start", "end", 7, "inner")
    assert sorted((x.pid, x.rid) for x in met.collect()) == sorted((i, j) for i, x in enumerate(points) for j, (s, n) in enumerate(spans) if s <= x < s + n)
    out = ranges.outside(p, r, ["chrom"], "pos", "start", "end", 7)
    assert sorted(x.pid for x in out.collect()) == [i for i, x in enumerate(points) if not any(s <= x <= s + n for s, n in spans)]
    islands = []
    for s, e in sorted((s, s + n) for s, n in spans):
        if islands and s <= islands[-1][1] + 2:
            islands[-1][1] = max(islands[-1][1], e)
        else:
            islands.append([s, e])
    got = ranges.coalesce_intervals(r, ["chrom"], "start", "end", F.lit(2))
    assert sorted((x.start, x.end) for x in got.collect()) == [tuple(i) for i in islands]
    edges = spark.createDataFrame([("c", s, i) for i, (s, _) in enumerate(spans)], "chrom string, edge long, eid int")
    near = ranges.nearest_edge(p, edges, ["pid"], ["chrom"], "pos", "edge", ["eid"])
    for x in near.collect():
        assert abs(x.nearest["at"] - x.pos) == min(abs(s - x.pos) for s, _ in spans)


def test_lift_over_and_windows(spark):
    chain = spark.createDataFrame([(1, 0, "13", 100, "chr13", 1000, "+", 50, 10, 5), (1, 1, "13", 100, "chr13", 1000, "+", 20, None, None)],
                                  "chain_id int, ordinal int, chrom string, start long, to_chrom string, to_start long, strand string, size long, gap long, to_gap long")
    p = spark.createDataFrame([("13", 149), ("13", 155), ("13", 160), ("17", 5)], "chrom string, pos long")
    got = {(r.chrom, r.pos): r.lifted_pos for r in ranges.lift_over(p, ranges.read_chain(chain), "chrom", "pos").collect()}
    assert got == {("13", 149): 1049, ("13", 155): None, ("13", 160): 1055, ("17", 5): None}
    w = spark.range(1).select(ranges.sequence_windows(F.lit("ABCB"), 2).alias("w"))
    assert [tuple(x) for x in w.first()["w"]] == [(0, "AB"), (1, "BC"), (2, "CB")]
    best = w.select(ranges.best_window(F.col("w"), lambda x: F.instr(x, "B").cast("int") * 0 + 1).alias("b")).first()["b"]
    assert best["offset"] == 0


def test_merge(spark):
    vcf = spark.createDataFrame([("f", 1, "13", 5, "A", ["T", "G"], {"AF": ["1", "2"], "X": ["q"]})], "file string, line long, chrom string, pos long, ref string, alts array<string>, info map<string,array<string>>")
    ex = merge.explode_alleles(vcf, ordinal=["file", "line"]).orderBy("allele_id").collect()
    assert [(r.alt, r.allele_id, r.info["AF"], r.info["X"]) for r in ex] == [("T", 1, ["1"], ["q"]), ("G", 2, ["2"], ["q"])]
    spec = merge.SourceSpec("S", {"scv": "", "individuals": "", "other": "", "one": ""}, frozenset({"scv"}), frozenset({"individuals"}), frozenset({"one"}))
    df = spark.createDataFrame([("k", 1, ["s1"], ["2"], ["b", ""], ["x"]), ("k", 2, ["s2"], ["3"], ["a"], ["y"])], "k string, o int, scv array<string>, individuals array<string>, other array<string>, one array<string>")
    r = merge.merge_repeats(df, ["k"], "o", spec).first()
    assert (r.scv, r.individuals, r.other, r.one) == (["s2", "s1"], ["5"], ["a", "b"], ["x"])
    regions = spark.createDataFrame([("13", 100, 105, "ACGTAC", 100)], "chrom string, start long, end long, seq string, seq_start long")
    v = spark.createDataFrame([("13", 101, "C", "T"), ("13", 101, "G", "T"), ("13", 90, "A", "T"), ("13", 101, "c", "c"), ("13", 105, "C", "C")], "chrom string, pos long, ref string, alt string")
    got = {(r.pos, r.ref): r.reason for r in merge.validate(v, regions).collect()}
    assert got == {(101, "C"): None, (101, "G"): "incorrect reference", (90, "A"): "outside boundaries", (101, "c"): "no change", (105, "C"): "no change"}
    log = merge.rejected_log(spark.createDataFrame([("1,2", "S", "r", "k")], "ids string, s string, reason string, k string"), "ids", "s", ["k"])
    assert [r.id for r in log.collect()] == ["1", "2"]


def test_equivalence_key_is_equal_for_equal_edits(spark):
    rng = random.Random(1)
    seq = "ACGTTTTACACACAGGGATATATCG"
    cases = []
    for _ in range(400):
        p, n = rng.randrange(0, len(seq) - 4), rng.randrange(0, 4)
        ref = seq[p:p + n + 1]
        alt = ref[0] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 4)))
        if ref != alt:
            cases.append((len(cases), "13", p + 50, ref, alt, seq[:p] + alt + seq[p + len(ref):]))
    df = spark.createDataFrame(cases, "i int, chrom string, pos long, ref string, alt string, edited string")
    regions = spark.createDataFrame([("13", seq, 50)], "chrom string, seq string, seq_start long")
    got = merge.equivalence_key(df, regions).collect()
    pairs = {(r.edited, r.canonical) for r in got}
    assert len(pairs) == len({e for e, _ in pairs}) == len({c for _, c in pairs})
    assert len({r.edited for r in got}) < len(got)
    classes = spark.createDataFrame([(1, "b", "x", None), (1, "a", None, "q"), (2, "c", "z", "w")], "cls int, key string, u string, v string")
    m = {r.cls: (r.key, r.u, r.v, r.members) for r in merge.merge_equivalent(classes, "cls", "key", F.lit(False), []).collect()}
    assert m == {1: ("a", "x", "q", 2), 2: ("c", "z", "w", 1)}


RULES = diff.DiffRules("k", "cls", lists=frozenset({"names"}), dates=frozenset({"d"}), ignored=frozenset({"skip"}), renamed={"old_name": "new_name"})


@pytest.mark.parametrize("old, new, want", [
    ({"x": "1"}, {"x": "1.0"}, None), ({"x": "1"}, {"x": "10"}, "added_information"), ({"x": "a"}, {"x": "b"}, "changed_information"), ({"x": "-"}, {"x": "b"}, "added_information"),
    ({"x": "a"}, {"x": ""}, "changed_information"), ({"names": "a,b"}, {"names": "b, a"}, None), ({"names": "a"}, {"names": "a,c"}, "added_information"), ({"cls": "B"}, {"cls": "P"}, "changed_classification"),
    ({"d": "03/15/2019"}, {"d": "2019-03-15"}, None), ({"skip": "a"}, {"skip": "b"}, None), ({"old_name": "a"}, {"new_name": "a"}, None), ({}, {"extra": "a"}, "added_information"), ({"gone": "a"}, {}, "changed_information"), ({"gone": "-"}, {}, None),
])
def test_release_diff(spark, old, new, want):
    frame = lambda d: spark.createDataFrame([("k1", *d.values())], ", ".join(f"`{c}` string" for c in ["k", *d]))
    assert diff.release_diff(frame(old), frame(new), RULES).first()["change_type"] == want


def test_release_diff_entries(spark):
    s = "k string, names string, x string"
    d = diff.release_diff(spark.createDataFrame([("a", "p,q", "1"), ("gone", "p", "1")], s), spark.createDataFrame([("a", "q,r", "2"), ("here", "p", "1")], s), RULES)
    got = {r.k: r for r in d.collect()}
    assert (got["gone"].change_type, got["here"].change_type) == ("deleted", "new")
    assert [tuple(e) for e in got["a"]["diff"]] == [("names", "list", ["r"], ["p"]), ("x", "individual", ["2"], ["1"])]


COLS = search.SearchColumns("gene", "tx", "cdna", "prot", "short", "syn", "ca", "vr", ("scv", "scv2"), "bic", "coord", "hgvs", "coord37", "hgvs37", ("cls",))


@pytest.mark.parametrize("term, kind", [("CA123", "registry"), ("ga4gh:VA.x", "digest"), ("NP_000050.2:p.Arg3", "protein"), ("BRCA1:c.5", "gene"), ("brca2 p.arg", "gene"), ("NM_000059.3 c.5", "transcript"), ("SCV000123456", "accession"), ("SCV1", "any"), ("chr13:5", "any")])
def test_terms(term, kind):
    assert search.classify(term, COLS).kind == kind
    assert search.classify("chr13:32:A", COLS).rest == "chr13:g.32:a" and search.classify("BRCA1:p.arg3", COLS).rest == "p.(arg3"


def test_search_and_facets(spark):
    s = "id int, gene string, tx string, cdna string, prot string, short string, syn string, ca string, vr string, scv string, coord string, bic string, hgvs string, coord37 string, hgvs37 string, cls string, scv2 string, f1 boolean, f2 boolean"
    df = spark.createDataFrame([(1, "BRCA1", "NM_007294.3", "c.5A>T", "NP_1.1:p.(Arg3Cys)", "R3C", "old1,c.9del", "CA7", "v", "SCV000123456", "chr17:g.5", "124del", "NC:5", "-", "-", "-", "-", True, False),
                                (2, "BRCA2", "NM_000059.3", "c.7A>T", "-", "-", "c.5A>T", "-", "-", "-", "chr13:g.7", "-", "NC:7", "-", "-", "-", "-", False, True), (3, "BRCA2", *[None] * 15, False, False)], s)
    ids = lambda t: [r.id for r in search.search(df, t, COLS)[0].orderBy("id").collect()]
    counts = lambda t: tuple(search.search(df, t, COLS)[1].first())
    assert ids("c.5a>t") == [1, 2] and counts("c.5A>T") == (2, 1)
    assert ids("BRCA1:c.5A>T") == [1] and ids("BRCA1:c.9del") == [1] and counts("BRCA1:c.9del") == (1, 1)
    assert ids("NM_000059.3:c.7") == [2] and ids("ca7") == [1] and ids("scv000123456") == [1] and ids("zzz") == []
    src = lambda *a: [r.id for r in search.by_sources(df, ["f1", "f2"], *a).collect()]
    assert src(["f1"]) == [1] and src([]) == [3] and src(["f1", "f2"], ["f2"]) == [1] and src(["all"]) == [1, 2, 3]
    assert search.trim_term("a:" * 150) == ("a:" * 100)[:-1] or len(search.trim_term("a:" * 150)) <= 200
    assert [r.id for r in search.ordered(df, "prot", True, {"prot": "coord"}, ["id"]).collect()] == [3, 1, 2]


def test_evidence(spark):
    def code(faf, count, depth, flagged, snv):
        return spark.range(1).select(enrich.dataset_code(F.lit("i"), F.lit(faf), F.lit(count), F.lit(depth), F.lit(flagged), F.lit(snv), F.lit(True)).alias("c")).first()["c"]

    assert [code(f, "1", 30, False, True) for f in ("0.0011", "0.001", "0.0001", "0.00002")] == ["BA1", "BS1", "BS1_Supporting", "no code met"]
    assert code("0.5", "1", 20, False, True) == "BA1" and code("0.5", "1", 19, False, True) == code("-", "0", 24, False, True) == "fail: read depth or flags"
    assert code("-", "0", 25, False, True) == "PM2_Supporting" and code("-", "0", 25, False, False) == "no code met (non-SNV)"
    both = lambda a, b: spark.range(1).select(enrich.consensus_code(F.lit(a), F.lit(b)).alias("c")).first()["c"]
    assert both("BA1", "PM2_Supporting").startswith("review") and both(enrich.FAIL_QC, enrich.FAIL_DEPTH) == enrich.FAIL_DEPTH
    assert both("PM2_Supporting", enrich.FAIL_QC) == "PM2_Supporting" and both("BS1", "BA1") == "BA1" and both("no code met", "BS1") == "BS1"
    v = spark.createDataFrame([("v1", "13", 5, 5, "A", "T", "x1", "0.5", "9", "y1", "-", "0")], "id string, chrom string, start long, end long, ref string, alt string, id_2 string, faf_2 string, count_2 string, id_3 string, faf_3 string, count_3 string")
    cov = spark.createDataFrame([("13", 5, 40.0), ("13", 6, 1.0)], "chrom string, pos long, mean double")
    fl = spark.createDataFrame([("x1", "PASS"), ("y1", "AC0")], "id string, Filters string")
    r = enrich.frequency_evidence(v, {"2": cov, "3": cov}, {"2": fl, "3": fl}).first()
    assert (r.code_2, r.code_3, r.code) == ("BA1", "fail: read depth or flags", "BA1")
    lab = spark.range(1).select(*enrich.classification_labels(F.lit("Benign"), {"ClinVar": F.lit("VUS"), "BIC": F.lit("-")}, "ENIGMA")).first()
    assert tuple(lab) == ("Benign / Little Clinical Significance", "Benign(ENIGMA); VUS (ClinVar)")


def test_splice(spark):
    tx = spark.createDataFrame([("t", "+", "100,300,500,", "200,400,600,")], "transcript string, strand string, exon_starts string, exon_ends string")
    ex = splice.exons(tx)
    assert rows(ex.select("exon", "start", "end", "is_first", "is_last")) == [(1, 100, 200, True, False), (2, 300, 400, False, False), (3, 500, 600, False, True)]
    reg = spark.createDataFrame([("t", "domain", 320, 330), ("t", "grey_zone", 560, 570), ("t", "utr", 590, 700)], "transcript string, kind string, start long, end long")
    v = spark.createDataFrame([("t", p) for p in (50, 150, 199, 203, 250, 290, 302, 325, 565, 595)], "transcript string, pos long")
    assert [r.location for r in splice.locate(v, ex, reg).orderBy("pos").collect()] == ["outside_transcript", "exon", "donor", "donor", "intron", "acceptor", "acceptor", "domain", "grey_zone", "utr"]
    ref = lambda r, a, c=False: spark.range(1).select(splice.reference_site_prior(F.lit(float(r)), F.lit(float(a)), True, F.lit(c)).alias("p")).first()["p"]
    assert [ref(1, 2), ref(-2, -3), ref(-2, -2.2), ref(1, 0.5), ref(1, -1), ref(1, -3), ref(1, -3, True)] == [0.04, 0.97, 0.34, 0.04, 0.34, 0.97, 0.5]
    new = lambda r, a, c, s=False: spark.range(1).select(splice.de_novo_donor_prior(F.lit(float(r)), F.lit(float(a)), F.lit(float(c)), F.lit(s), F.lit(False)).alias("p")).first()["p"]
    assert [new(1, 0, 5), new(-3, -2.5, 5), new(-3, -2.5, -4), new(-3, -1, 5), new(-3, 1, 5), new(-3, 1, 5, True)] == [0.02, 0.02, 0.3, 0.3, 0.64, 0.02]
    cls = spark.createDataFrame([(0.99,), (0.95,), (0.5,), (0.02,), (0.0001,)], "p double").select(splice.prior_class(F.col("p")))
    assert [r[0] for r in cls.collect()] == ["class_5", "class_4", "class_3", "class_2", "class_1"]


def test_information(spark):
    items = [("a", 3, 4.0), ("b", 4, 5.0), ("c", 5, 6.0), ("d", 9, 30.0), ("e", 2, 1.0)]
    from itertools import combinations

    best = max(sum(i[2] for i in c) for n in (0, 1, 2) for c in combinations(items, n) if sum(i[1] for i in c) <= 9)
    got = info.knapsack(spark.createDataFrame(items, "name string, weight long, value double"), 9, 2).collect()
    assert sum(r.value for r in got) == best and sum(r.weight for r in got) <= 9 and len(got) <= 2
    ranked = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 3.0), ("d", 2.0)], "site string, score double")
    near = spark.createDataFrame([("a", "b"), ("d", "c")], "site string, proxy string")
    assert [r.site for r in info.select_uncorrelated(ranked, near, 2).orderBy("rank").collect()] == ["a", "c"]
    g = spark.createDataFrame([("i", 1, "A"), ("i", 2, "T"), ("j", 1, "A"), ("j", 2, "T"), ("k", 1, "A"), ("k", 2, "C")], "ind string, site int, v string")
    p = info.profiles(g, "ind", "site", "v")
    assert rows(p) == [("i", "AT"), ("j", "AT"), ("k", "AC")]
    r = info.identifiability(p).first()
    assert (round(r.distinct_share, 3), round(r.unique_share, 3)) == (0.667, 0.333)
    assert rows(info.top_k_identifiability(g, "ind", "site", "v", [1])) == [(1, 2 / 3)]


def test_uncorrelated_sites_equal_the_greedy_loop(spark):
    # A hub with 30 proxies, then linked pairs: 10 hubs of 2, and one site without a score.
    ranked = [("hub", 100.0)] + [(f"p{i:02d}", 99.0 - i) for i in range(30)] + [(f"q{i}", 20.0 - i // 2) for i in range(20)] + [("z", None)]
    near = [("hub", f"p{i:02d}") for i in range(30)] + [(f"q{i + 1}", f"q{i}") for i in range(0, 20, 2)]
    r, n = spark.createDataFrame(ranked, "site string, score double"), spark.createDataFrame(near, "site string, proxy string")
    linked = {frozenset(x) for x in near}
    want: list = []
    for s, _ in sorted(ranked, key=lambda x: (-(x[1] if x[1] is not None else -1e9), x[0])):
        if all(frozenset((s, w)) not in linked for w in want):
            want.append(s)
    assert len(want) == 12
    for k in (3, 12, 50):
        got = info.select_uncorrelated(r, n, k).orderBy("rank").collect()
        assert [x.site for x in got] == want[:k] and [x.rank for x in got] == list(range(1, len(got) + 1))
    import random

    rng = random.Random(2)
    ranked = [(i, None if i % 17 == 0 else float(rng.randrange(12))) for i in range(150)]
    near = [(rng.randrange(150), rng.randrange(160)) for _ in range(260)] + [(3, 3)]
    linked, want = {frozenset(x) for x in near}, []
    for s, _ in sorted(ranked, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])):
        if all(frozenset((s, w)) not in linked for w in want):
            want.append(s)
    r, n = spark.createDataFrame(ranked, "site long, score double"), spark.createDataFrame(near, "site long, proxy long")
    for k in (5, 150):
        assert [x.site for x in info.select_uncorrelated(r, n, k).orderBy("rank").collect()] == want[:k]
    assert info.select_uncorrelated(r.limit(0), n, 3).collect() == []
