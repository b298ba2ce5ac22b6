"""Search terms of every class against a plain reading of SURVEY A.6, row by row."""

import re

import pytest
from pyspark.sql import functions as F

from variantlake.operators import search

COLS = search.SearchColumns("gene", "tx", "cdna", "prot", "short", "syn", "ca", "vr", ("scv", "scv2"), "bic", "coord", "hgvs", "coord37", "hgvs37", ("cls",))
NAMES = ["id", "gene", "tx", "cdna", "prot", "short", "syn", "ca", "vr", "scv", "scv2", "bic", "coord", "hgvs", "coord37", "hgvs37", "cls"]
ROWS = [
    (1, "BRCA1", "NM_007294.3", "c.839C>G", "NP_009225.1:p.(Ala280Gly)", "A280G", "x:c.99A>T,BRCA1:old9,958 X", "CA001", "ga4gh:VA.1", "SCV000123456", "-", "958C>G", "chr17:g.43094692:G>C", "NC_000017.11:g.43094692G>C", "chr17:g.41246709:G>C", "NC_000017.10:g.41246709G>C", "Benign"),
    (2, "BRCA2", "NM_000059.3", "c.7A>T", "NP_000050.2:p.(Arg3Cys)", "R3C", "c.839C>G,p.(Ala280Gly)", "CA002", "-", "-", "SCV000999999", "-", "chr13:g.32398880:A>C", "NC_000013.11:g.32398880A>C", "chr13:g.32973017:A>C", "NC_000013.10:g.32973017A>C", "Likely benign"),
    (3, "BRCA1", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    (4, "BRCA1", "NM_007294.3", "c.1A>T", "NP_009225.1:p.?", "-", "A280G,brca2:c.7A>T", "-", "-", "-", "-", "124del", "chr17:g.5:A>T", "NC_000017.11:g.5A>T", "chr17:g.6:A>T", "NC_000017.10:g.6A>T", "Cancer"),
    (5, "BRCA2", "NM_000059.3", "c.70A>T", "NP_009225.1:p.(Ala280GlyfsTer3)", "A280Gfs", "np_009225.1:a280g", "-", "-", "-", "-", "958C>G", "chr13:g.7:A>T", "NC_000013.11:g.7A>T", "chr13:g.8:A>T", "NC_000013.10:g.8A>T", "Pathogenic"),
]
TERMS = [
    "CA001", "ca", "cancer", "ga4gh:VA", "SCV000123456", "scv000999999", "SCV0001", "benign", "  BENIGN\x00 ",
    "NP_009225.1:p.(Ala280Gly)", "NP_009225.1:p.Ala280Gly", "np_009225.1 A280G", "NP_000050.2:A280G", "NP_000050.2:p.(Ala280Gly)",
    "BRCA1:chr17:g.43094692:G>C", "BRCA1:chr17:43094692:G>C", "BRCA1:chr17:g.41246709:G>C", "BRCA1:NC_000017.11:43094692G>C", "BRCA1 NC_000017.10:g.41246709G>C", "BRCA2:NC_000013.10:32973017A>C",
    "BRCA1:958C>G", "brca1 c.839C>G", "BRCA1:p.Ala280Gly", "BRCA1:A280G", "BRCA1:old9", "BRCA1:c.99A>T", "BRCA2:c.7A>T", "brca2 p.(ala280gly)", "BRCA1:",
    "NM_007294.3:A280G", "NM_007294.3:c.99A>T", "NM_007294.3:c.839C>G", "NM_007294.3 chr17:43094692:G>C", "NM_000059.3:NC_000013.10:g.32973017A>C", "NM_000059.3:c.839C>G", "NM_007294.3:p.Ala280Gly",
    "chr17:43094692", "chr13:g.32973017", "nc_000013.11:32398880", "NC_000017.10:g.41246709", "c.839C>G", "p.Ala280Gly", "p.(ala280gly", "A280G", "958c>g", "zzz", "brca1",
]


def plain(term):
    """(ids found, count less the count without synonyms) by the table, in lower case, one row at a time."""
    t = term.lower().strip().replace("\x00", "")
    rows = [{k: v.lower() if isinstance(v, str) else v for k, v in zip(NAMES, r)} for r in ROWS]
    has = lambda r, c, s: r[c] is not None and s in r[c]
    starts = lambda r, c, s: r[c] is not None and r[c].startswith(s)
    one = lambda cond: ({r["id"] for r in rows if cond(r)}, 0)
    if t.startswith("ca"):
        return one(lambda r: has(r, "ca", t))
    if t.startswith("ga4gh"):
        return one(lambda r: has(r, "vr", t))
    for name in ("chr17:", "chr13:", "nc_000013.11:", "nc_000017.11:", "nc_000013.10:", "nc_000017.10:"):
        if name in t and "g." not in t:
            t = t.replace(name, name + "g.")
    paren = lambda s: "p.(" + s[2:] if s.startswith("p.") and "(" not in s else s
    if re.match(r"np_\d{6}.\d[: ]", t):
        p, s = t[:11], paren(t[12:])
        full = lambda r: has(r, "prot", t)
        hit = [r for r in rows if starts(r, "prot", p) and (starts(r, "short", s) or has(r, "prot", s) or has(r, "syn", "," + s) or starts(r, "syn", s)) or full(r) or has(r, "syn", t)]
        own = [r for r in hit if starts(r, "short", s) or full(r)]
    elif t[:6] in ("brca1:", "brca2:", "brca1 ", "brca2 "):
        p, s = t[:5], paren(t[6:])
        fields = lambda r: has(r, "cdna", s) or has(r, "prot", s) or any(starts(r, c, s) for c in ("coord", "hgvs", "bic", "short"))
        hit = [r for r in rows if r["gene"] == p and (fields(r) or starts(r, "coord37", s) or starts(r, "hgvs37", s) or has(r, "syn", "," + s) or has(r, "syn", ":" + s) or starts(r, "syn", s)) or has(r, "syn", t)]
        own = [r for r in hit if fields(r)]
    elif re.match(r"nm_\d{6}.\d[: ]", t):
        p, s = t[:11], t[12:]
        fields = lambda r: has(r, "cdna", s) or any(starts(r, c, s) for c in ("coord", "hgvs", "bic"))
        hit = [r for r in rows if r["tx"] == p and (fields(r) or starts(r, "coord37", s) or starts(r, "hgvs37", s) or has(r, "syn", "," + s) or starts(r, "syn", s)) or has(r, "syn", t)]
        own = [r for r in hit if fields(r)]
    elif t.startswith("scv") and len(t) >= 12:
        return one(lambda r: has(r, "scv", t) or has(r, "scv2", t))
    else:
        fields = lambda r: any(has(r, c, t) for c in ("cls", "coord", "gene", "cdna", "bic", "prot", "short")) or starts(r, "hgvs", t)
        hit = [r for r in rows if fields(r) or has(r, "coord37", t) or starts(r, "hgvs37", t) or has(r, "syn", t)]
        own = [r for r in rows if fields(r)]
    return {r["id"] for r in hit}, len(hit) - len(own)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{n} {'int' if n == 'id' else 'string'}" for n in NAMES)).coalesce(1).cache()


def test_every_class_of_term(table):
    hits = [search.predicates(search.classify(t, COLS), COLS) for t in TERMS]
    got = table.select("id", *[c.alias(f"{k}{i}") for i, pair in enumerate(hits) for k, c in zip("hs", pair)]).collect()
    for i, t in enumerate(TERMS):
        ids, synonyms = plain(t)
        assert {r.id for r in got if r[f"h{i}"]} == ids, t
        assert sum(r[f"h{i}"] for r in got) - sum(r[f"h{i}"] and r[f"s{i}"] for r in got) == synonyms, t
    assert plain("BRCA1:chr17:43094692:G>C") == ({1}, 0) and plain("BRCA1:chr17:g.41246709:G>C") == ({1}, 1) and plain("NM_007294.3:A280G")[0] == {4}


def test_search_returns_rows_and_counts(table):
    found, counts = search.search(table, "BRCA1:A280G", COLS)
    assert {r.id for r in found.collect()} == {1, 4} and tuple(counts.first()) == (2, 1)


def test_filters_respell_and_keep_case(table):
    ids = lambda v: {r.id for r in search.by_values(table, v).collect()}
    assert ids({"cls": "Likely Benign"}) == {2} and ids({"cls": "benign"}) == set() and ids({"cls": "Benign", "gene": "BRCA"}) == {1} and ids({"id": 4}) == {4}


def test_releases_and_deleted_rows(spark):
    df = spark.createDataFrame([(1, 7, "new"), (2, 7, "deleted"), (3, 6, "new"), (4, 7, None), (5, 6, "deleted")], "id int, release int, change_type string")
    rows, deleted = search.by_release(df, None)
    assert {r.id for r in rows.collect()} == {1, 3, 4} and df.select(deleted).first()[0] == 2
    assert {r.id for r in search.by_release(df, 7)[0].collect()} == {1, 2, 4} and {r.id for r in search.by_release(df, 7, ["new"])[0].collect()} == {1}
    users = spark.createDataFrame([("Ann Bee", "Rome"), ("Bob", None)], "name string, place string")
    assert [r.name for r in search.all_terms(users, "rom BEE", ["name", "place"]).collect()] == ["Ann Bee"]
    masked = search.mask(users, F.col("name") == "Bob", ["place"], "hidden")
    assert [r.place for r in masked.orderBy("name").collect()] == ["Rome", "hidden"]
