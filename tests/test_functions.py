import pytest
from pyspark.sql import functions as F

from variantlake.functions import collections as R
from variantlake.functions import dates as D
from variantlake.functions import numbers as M
from variantlake.functions import text as T


def one(spark, value, *args, schema=None):
    """The value of an expression over one row of text columns a, b, c, ..."""
    names = "abcdefg"[: len(args)]
    df = spark.createDataFrame([tuple(args)], schema or ", ".join(f"{n} string" for n in names)) if args else spark.range(1)
    return df.select(value(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize("x, want", [("", None), (" - ", None), ("None", None), (" a ", "a"), ("N/A", "N/A"), (None, None)])
def test_blanks(spark, x, want):
    assert one(spark, T.blank_to_null, x) == want


def test_lists(spark):
    assert one(spark, T.split_list, "b, a,-,,b") == ["b", "a"]
    assert one(spark, T.split_list, "-") is None
    assert one(spark, T.split_outside_parentheses, "a, b (c, d),e") == ["a", "b (c, d)", "e"]
    assert one(spark, lambda a, b: T.merge_synonyms(a, b, [F.lit("x")]), "q,x", "b,q") == "b,q"
    assert one(spark, T.display_field, "a_b,-,c") == "a b, c"
    assert one(spark, lambda a: T.links(a, "http://h/?id="), "7") == '<a href="http://h/?id=7">7</a>'
    assert one(spark, lambda a: T.short_authors(a, 3), "A,B,C,D") == "A, B, ..., D"


@pytest.mark.parametrize("ref, alt, pos, want", [("CAT", "CGT", 10, (11, "A", "G")), ("AAA", "A", 5, (5, "AAA"[:3], "A")), ("A", "T", 1, (1, "A", "T")), ("GATT", "GT", 3, (3, "GAT", "G"))])
def test_trim(spark, ref, alt, pos, want):
    def f(a, b):
        r, x = T.trim_trailing(a, b)
        p, r, x = T.trim_leading(F.lit(pos), r, x)
        return F.struct(p.alias("p"), r.alias("r"), x.alias("x"))

    got = one(spark, f, ref, alt)
    assert got["r"] and got["x"] and got["p"] + len(got["r"]) + len(got["x"]) > 0
    # The edit is the same, and no common end is left beyond one base.
    seq = "ACGTACGTACGTACGTACGT"
    put = lambda p, r, a: seq[: p - 1] + a + seq[p - 1 + len(r):]
    lead = seq[: pos - 1] + ref + seq[pos - 1 + len(ref):]
    cut = lambda p, r, a: lead[: p - 1] + a + lead[p - 1 + len(r):]
    assert cut(got["p"], got["r"], got["x"]) == cut(pos, ref, alt) and put
    assert len(got["r"]) == 1 or len(got["x"]) == 1 or (got["r"][0] != got["x"][0] and got["r"][-1] != got["x"][-1])


def test_leading_base_and_edits(spark):
    seq = F.lit("ACGTTT")
    f = lambda a, b: F.struct(*T.add_leading_base(F.lit(103), a, b, seq, F.lit(100)))
    assert tuple(one(spark, f, "T", "-")) == (102, "GT", "G")
    assert tuple(one(spark, f, "", "A")) == (103, "T", "TA")
    assert one(spark, lambda a, b: T.edited_sequence(seq, F.lit(100), F.lit(101), a, b), "CG", "A") == "AATTT"
    assert one(spark, T.reverse_complement, "AACg") == "cGTT"


def test_coordinates(spark):
    assert one(spark, T.harmonise_key, "NC_000013.11:g.32316:A>T") == "chr13:g.32316A>T"
    assert one(spark, T.harmonise_key, "chr13:g.32316:A>T") == "chr13:g.32316A>T"
    assert one(spark, T.add_g, "chr17:5:A>T") == "chr17:g.5:A>T"
    p = one(spark, lambda a: F.struct(*[c.alias(k) for k, c in T.parse_coordinate(a).items()]), "chr13:g.5:A>TG")
    assert (p.chrom, p.pos, p.ref, p.alt) == ("13", 5, "A", "TG")
    for text, want in [("NM_1.2:c.3A>T", ("NM_1.2", "c.3A>T")), ("NM_1.2.c.3A>T", ("NM_1.2", "c.3A>T")), ("c.3A>T", (None, "c.3A>T"))]:
        assert tuple(one(spark, lambda a: F.struct(*T.unpack_change(a)), text)) == want
    assert one(spark, T.amino_acid_code, "p.(Arg12Ter)") == "R12*" and one(spark, T.protein_position, "p.(Arg12Ter)") == 12
    assert T.open_protein("p.arg\x00") == "p.(arg" and T.joint_symbol(["BRCA2", "BRCA1"]) == "BRCA12"


def test_numbers(spark):
    sig = lambda x, n: spark.range(1).select(M.significant(F.lit(x), n).alias("v")).first()["v"]
    assert [sig(v, 3) for v in (0.0, 0.0012345, 12345.0, -0.5)] == [0.0, 0.00123, 12300.0, -0.5]
    assert one(spark, lambda a, b: M.frequency(a, b), "1", "3") == 0.333 and one(spark, lambda a, b: M.frequency(a, b), "1", "0") is None
    assert one(spark, lambda a, b: M.combined_frequency([a, b], [F.lit("4"), F.lit("-")]), "1", "-") == 0.25
    assert one(spark, M.last_percent, "1,2,5") == 0.05
    assert one(spark, M.same_value, "1.0", "1.00") and one(spark, M.same_value, None, None) and not one(spark, M.same_value, "a", "b")
    assert one(spark, lambda a, b: M.greatest_number(a, b), "-", "0.5") == 0.5
    assert spark.range(1).select(M.significant_exact(F.lit(0.001235), F.lit(3)).alias("v")).first()["v"] == 0.00123
    score = M.site_score_udf({c: [0.25, 0.5] for c in "ACGT"})
    assert one(spark, score, "AC") == 1.0 and one(spark, score, "A") is None


def test_dates(spark):
    for text, want in [("03/15/2019", "2019-03-15"), ("2019-3", "2019-3"), ("Mar 5, 2019", "2019-03-05"), ("soon", "soon")]:
        assert one(spark, D.iso_date, text) == want
    assert one(spark, D.display_date, "2019-03-02") == "02 March 2019" and one(spark, D.year_or_unknown, "0000") == "Unknown"
    days = spark.range(1).transform(lambda d: D.days_of_ages(d, F.lit(30), F.lit(30), F.lit("2020-06-15").cast("date")))
    assert days.agg(F.min("born").cast("string"), F.max("born").cast("string")).first()[:] == ("1989-06-16", "1990-06-15")


def test_maps_and_changes(spark):
    assert one(spark, R.info_map, "A=1;B=x=y;F;A=2") == {"A": "1", "B": "x=y", "F": None}
    assert one(spark, lambda a: R.pipe_fields(a, ["x", "y", "z"])["y"], "1|2") == "2"
    assert one(spark, lambda a: F.struct(*R.class_changes(a, F.lit("Benign(ENIGMA); Pathogenic (ClinVar)"), ["ENIGMA", "ClinVar"])), "Benign,VUS (ClinVar)")[:] == (["Benign (ENIGMA)", "Pathogenic (ClinVar)"], ["Benign (ClinVar)", "VUS (ClinVar)"])
    assert one(spark, R.id_in_url, "http://reg/CA123") == "CA123" and one(spark, R.id_in_url, "http://reg/x") is None
    assert one(spark, lambda a: F.struct(*R.list_change(F.split(a, ","), F.split(F.lit("b,b,c"), ","))), "a,b")[:] == (["c"], ["a"])
