"""Queries over whole tables for expressions and for operators on reports, each with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import collections as R
from ..functions import text as T
from ..operators import coordinates as C
from ..operators import diff as D
from ..operators import enrich as E
from ..operators import serving as S
from ..operators import splice as P
from ..operators import textindex as X
from ..operators import versions as V
from ..sources import binned
from .queries import _t, query


# -- expressions ---------------------------------------------------------------------------------------------------

@query("""WITH e AS (SELECT p_partkey, p_name || p_brand AS seq, p_name AS r, left(p_name, 2) || p_type || right(p_name, 3) AS a FROM part),
    s AS (SELECT *, list_max(list_filter(range(0, greatest(least(length(r), length(a)), 1)), lambda i: right(r, CAST(i AS BIGINT)) = right(a, CAST(i AS BIGINT)))) AS k,
        list_max(list_filter(range(0, greatest(least(length(r), length(a)), 1)), lambda i: left(r, CAST(i AS BIGINT)) = left(a, CAST(i AS BIGINT)))) AS j FROM e)
    SELECT p_partkey, left(r, length(r) - k) AS ref_cut, left(a, length(a) - k) AS alt_cut, 100 + j AS pos, substr(r, j + 1) AS ref_late, substr(a, j + 1) AS alt_late, a || substr(seq, length(r) + 1) AS edited FROM s""")
def allele_forms(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_brand").alias("seq"), F.col("p_name").alias("r"), F.concat(F.left("p_name", F.lit(2)), "p_type", F.right("p_name", F.lit(3))).alias("a"))
    (ref_cut, alt_cut), (pos, ref_late, alt_late) = T.trim_trailing(F.col("r"), F.col("a")), T.trim_leading(F.lit(100).cast("long"), F.col("r"), F.col("a"))
    edited = T.edited_sequence(F.col("seq"), F.lit(5), F.lit(5), F.col("r"), F.col("a"))
    return p.select("p_partkey", ref_cut.alias("ref_cut"), alt_cut.alias("alt_cut"), pos.alias("pos"), ref_late.alias("ref_late"), alt_late.alias("alt_late"), edited.alias("edited"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 22 + 1 AS VARCHAR) AS ch, l_returnflag AS r, l_linestatus AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 'chr' || ch || ':g.' || l_orderkey || ':' || r || '>' || a AS coordinate, ch AS chrom, l_orderkey AS pos, r AS ref, a AS alt,
    'chr' || ch || ':g.' || l_orderkey || ':' || r || '>' || a AS added, 'chr' || ch || ':g.' || l_orderkey || r || '>' || a AS one_key, 'NM_' || ch || '.1' AS named, 'c.' || l_orderkey || r || '>' || a AS change FROM c""")
def coordinate_forms(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("ch", (F.col("l_suppkey") % 22 + 1).cast("string"))
    c = T.coordinate(F.col("ch"), F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_linestatus"))
    accession = F.concat(F.lit("NC_0000"), F.lpad("ch", 2, "0"), F.lit(".11:g."), F.col("l_orderkey"), "l_returnflag", F.lit(">"), "l_linestatus")
    named, change = T.unpack_change(F.concat(F.lit("NM_"), "ch", F.lit(".1.c."), F.col("l_orderkey"), "l_returnflag", F.lit(">"), "l_linestatus"))
    one_key = F.when(F.col("l_orderkey") % 2 == 0, T.harmonise_key(accession)).otherwise(T.harmonise_key(c))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", c.alias("coordinate"), *[x.alias(k) for k, x in T.parse_coordinate(c).items()],
                     T.add_g(F.replace(c, F.lit("g."), F.lit(""))).alias("added"), one_key.alias("one_key"), named.alias("named"), change.alias("change"))


@query("""WITH l AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderdate < TIMESTAMP '1996-01-01')) AS old, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderdate >= TIMESTAMP '1996-01-01')) AS new,
        min(o_orderstatus) AS status, min(o_orderpriority) AS shown FROM orders GROUP BY 1),
    u AS (SELECT *, list_sort(list_distinct(list_concat(coalesce(old, []), coalesce(new, [])))) AS all_ FROM l)
    SELECT o_custkey, array_to_string(all_, '|') AS united, array_to_string(list_filter(all_, lambda x: x <> shown), ',') AS synonyms, coalesce(old, []) = coalesce(new, []) AS same,
    'https://x/' || array_to_string(all_, ',https://x/') AS urls FROM u""")
def list_forms(spark, sf_dir):
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    lists = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(early, F.col("o_orderpriority"))).alias("old"), F.collect_set(F.when(~early, F.col("o_orderpriority"))).alias("new"), F.min("o_orderpriority").alias("shown"))
    united = T.union_lists(F.col("old"), F.col("new"))
    text = lambda c: F.array_join(c, ",")
    return lists.select("o_custkey", F.array_join(united, "|").alias("united"), T.merge_synonyms(text("old"), text("new"), [F.col("shown")]).alias("synonyms"),
                        R.same_list(F.col("old"), F.col("new")).alias("same"), T.source_urls(text(united), "https://x/").alias("urls"))


@query("""SELECT p_partkey, p_name AS n, CAST(p_size AS VARCHAR) AS s, 'a=' || p_type AS t, true AS flagged, p_name AS first_field, p_brand AS last_field, CASE WHEN p_size % 2 = 0 THEN 'CA' || p_size END AS registry FROM part""")
def info_forms(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    info = F.concat(F.lit("n="), "p_name", F.lit(";s="), F.col("p_size"), F.lit(";flag;t=a="), "p_type", F.lit(";n=again"))
    p = p.withColumn("m", R.info_map(info))
    fields = R.pipe_fields(F.concat_ws("|", "p_name", F.lit(""), "p_brand"), ["a", "b", "c"])
    address = F.concat(F.lit("http://x/y/"), F.when(F.col("p_size") % 2 == 0, "CA").otherwise("XA"), F.col("p_size"))
    return p.select("p_partkey", F.col("m")["n"].alias("n"), F.col("m")["s"].alias("s"), F.col("m")["t"].alias("t"), (F.map_contains_key("m", F.lit("flag")) & F.col("m")["flag"].isNull() & fields["b"].isNull()).alias("flagged"),
                    fields["a"].alias("first_field"), fields["c"].alias("last_field"), R.id_in_url(address).alias("registry"))


@query("""SELECT p_partkey, p_name || ', ' || p_brand AS shown, p_size AS position, 'R' || p_size || CASE WHEN p_size % 2 = 0 THEN 'C' ELSE '*' END AS short, replace(p_name, ' ', '_') || '.x' AS vcf, p_size % 3 = 0 AS bad,
    replace(p_name, ' ', '') AS plain, CASE p_size % 5 WHEN 0 THEN '0,120,0' WHEN 1 THEN '60,150,60' WHEN 2 THEN '210,90,60' WHEN 3 THEN '190,0,0' ELSE '100,100,100' END AS colour,
    '<a href="u/' || p_brand || '">' || p_brand || '</a>' AS links FROM part""")
def label_forms(spark, sf_dir):
    n, size = F.col("p_name"), F.col("p_size")
    word = F.element_at(F.array(*[F.lit(x) for x in ("Benign", "Likely_benign", "Likely Pathogenic", "pathogenic", "Uncertain (benign)")]), (size % 5 + 1).cast("int"))
    protein = F.concat(F.lit("NP_1.1:p.(Arg"), size, F.when(size % 2 == 0, "Cys").otherwise("Ter"), F.lit(")"))
    own = F.regexp_replace(protein, "^NP_1.1:", "")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.display_field(F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit(",-,"), "p_brand")).alias("shown"), T.protein_position(own).alias("position"), T.amino_acid_code(own).alias("short"),
        T.vcf_value(F.concat(F.lit(";"), n, F.lit(":x;"))).alias("vcf"), T.has_bad_parentheses(F.when(size % 3 == 0, ")a(").otherwise("(a)(b(c))")).alias("bad"),
        T.strip_protein_suffix(F.concat(n, F.lit(" (p.Arg3Cys)"))).alias("plain"), T.class_colour(word).alias("colour"), T.links(F.col("p_brand"), "u/").alias("links"))


# -- reports and versions ------------------------------------------------------------------------------------------

@query("""SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS oldest, CAST(max(year(o_orderdate)) AS INTEGER) AS newest, count(*) AS versions, arg_min(o_orderstatus, o_orderdate) AS oldest_status, arg_max(o_orderstatus, o_orderdate) AS newest_status
    FROM (SELECT DISTINCT ON (o_custkey, o_orderdate) * FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey) GROUP BY 1""")
def report_spans(spark, sf_dir):
    one = V.current_version(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], [F.asc("o_orderkey")]).withColumnRenamed("o_orderstatus", "status")
    s = S.report_spans(one, ["o_custkey"], "o_orderdate", ("status",))
    return s.select("o_custkey", F.year("oldest").alias("oldest"), F.year("newest").alias("newest"), "versions", "oldest_status", "newest_status")


@query("""SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders""")
def paired_versions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return S.paired_versions(o, ["o_custkey"], "o_orderkey").select("o_custkey", F.col("before.o_orderkey").alias("o_orderkey"), F.col("after.o_orderkey").alias("next_key"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders QUALIFY date_trunc('year', o_orderdate) = max(date_trunc('year', o_orderdate)) OVER (PARTITION BY o_orderpriority)""")
def reports_of_latest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("release", F.year("o_orderdate"))
    return S.reports_of_latest(o, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type) AS s, CASE WHEN sum(value) > 3000 THEN 'new' WHEN sum(value) > 1500 THEN 'deleted' WHEN sum(value) > 1000 THEN 'changed_information' END AS c FROM events GROUP BY 1),
    e AS (SELECT unnest(s) AS source, c FROM u UNION ALL SELECT NULL, c FROM u)
    SELECT source, count(*) AS rows, count(*) FILTER (c = 'new') AS new, count(*) FILTER (c = 'deleted') AS deleted, count(*) FILTER (c = 'changed_information') AS changed FROM e GROUP BY 1""")
def counts_by_source(spark, sf_dir):
    total = F.sum(F.col("value").cast("decimal(18,2)"))
    change = F.when(total > 3000, "new").when(total > 1500, "deleted").when(total > 1000, "changed_information")
    u = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_set("event_type"), ",").alias("sources"), change.alias("change"))
    return S.counts_by_source(u, "sources", "change").select("source", "rows", "new", "deleted", F.col("changed_information").alias("changed"))


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS source, l_partkey AS id FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_returnflag AS source, l_partkey AS id FROM lineitem WHERE l_quantity < 40 OR l_linestatus = 'O')
    SELECT source, CAST(coalesce(s.id, b.id) AS VARCHAR) AS id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM s FULL JOIN b USING (source, id) WHERE s.id IS NULL OR b.id IS NULL""")
def missing_reports(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.concat(F.col("l_partkey").cast("string"), F.lit(", -")).alias("ids"), "l_quantity", "l_linestatus")
    return S.missing_reports(li.filter("l_quantity > 10"), li.filter("l_quantity < 40"), li.filter("l_linestatus = 'O'"))


@query("""WITH a AS (SELECT * FROM customer WHERE c_acctbal > 0), b AS (SELECT * FROM customer WHERE c_acctbal < 9000)
    SELECT c_custkey, 'removed' AS side FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT c_custkey, 'added' FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)
    UNION ALL SELECT a.c_custkey, 'differs' FROM a JOIN b USING (c_custkey) WHERE a.c_custkey % 4 = 0""")
def removed_and_added(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    a, b = c.filter("c_acctbal > 0"), c.filter("c_acctbal < 9000").withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    removed, added = D.removed_and_added(a, b, ["c_custkey"])
    parts = [d.select("c_custkey", F.lit(side).alias("side")) for d, side in ((removed, "removed"), (added, "added"), (D.differing_rows(a, b, ["c_custkey"]), "differs"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT l_partkey, arg_min(l_orderkey, row(CAST(l_linenumber % 4 = 0 AS INTEGER), l_linenumber % 4, -l_quantity, -l_tax, l_orderkey, l_linenumber)) AS best FROM (
    SELECT DISTINCT ON (l_partkey, l_linenumber % 4, l_quantity, l_tax) * FROM lineitem ORDER BY l_partkey, l_linenumber % 4, l_quantity, l_tax, l_orderkey) GROUP BY 1""")
def best_structure(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("preference", F.col("l_linenumber") % 4)
    one = li.groupBy("l_partkey", "preference", F.col("l_quantity").alias("hits"), F.col("l_tax").alias("residues")).agg(F.min("l_orderkey").alias("best"))
    return E.best_structure(one, ["l_partkey"]).select("l_partkey", "best")


@query("SELECT c_custkey, greatest(c_acctbal, CAST(c_nationkey AS DOUBLE)) AS most FROM customer")
def max_over(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("a"), F.lit("-").alias("b"), F.col("c_nationkey").cast("string").alias("n"))
    return S.max_over(c, ["a", "b", "n"], "most").select("c_custkey", "most")


# -- indexes and coordinates ---------------------------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    """A new folder that the driver and all executors share; a temporary one in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='variantlake-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""WITH w AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS w, p_size < 25 AS early FROM part)
    SELECT 2 AS release, id FROM w GROUP BY id HAVING bool_or(starts_with(w, 'r')) AND bool_or(starts_with(w, 'st')) AND bool_or(starts_with(w, 'brand#1'))
    UNION ALL SELECT 1, id FROM w WHERE early GROUP BY id HAVING bool_or(starts_with(w, 'econ'))""")
def word_index(spark, sf_dir):
    index = X.TextIndex(spark, _folder(spark, "words"))
    p, columns = _t(spark, sf_dir, "part"), ["p_name", "p_type", "p_brand"]
    index.add(p.filter("p_size < 25"), "p_partkey", columns, 1)
    index.add(p, "p_partkey", columns, 2)
    found = index.find("R brand#1 ST").select(F.lit(2).alias("release"), "id")
    return found.unionByName(index.find("econ", 1).select(F.lit(1).alias("release"), "id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 3 = 1 AND l_orderkey * 1000 + 1 <= 9000000 AND l_orderkey * 1000 + l_partkey >= 4000000""")
def region_records(spark, sf_dir):
    path = _folder(spark, "regions")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 3).cast("string").alias("chrom"), (F.col("l_orderkey") * 1000 + 1).alias("pos"))
    binned.write_binned(li, path, end=F.col("l_orderkey") * 1000 + F.col("l_partkey"))
    return binned.read_region(spark, path, "1", 4_000_000, 9_000_000).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH t AS (SELECT s_suppkey, s_suppkey * 1000 AS s, s_suppkey % 2 = 0 AS plus FROM supplier), p AS (SELECT DISTINCT o_orderkey * 7 AS pos FROM orders),
    x AS (SELECT s_suppkey, pos, plus, CASE WHEN plus THEN pos - s ELSE s + 501 - pos END AS d FROM t JOIN p ON pos > s AND pos <= s + 500),
    y AS (SELECT *, d // 200 AS k, d % 200 AS r FROM x),
    z AS (SELECT s_suppkey, pos, CASE WHEN r BETWEEN 1 AND 100 THEN 100 * k + r WHEN r = 0 THEN 100 * k + 1 WHEN r - 100 <= 50 THEN 100 * k + 100 ELSE 100 * k + 101 END AS n,
        CASE WHEN r BETWEEN 1 AND 100 THEN 0 WHEN r = 0 THEN -1 WHEN r - 100 <= 50 THEN r - 100 ELSE r - 201 END AS o FROM y)
    SELECT s_suppkey, pos, n, CASE WHEN n < 31 THEN CAST(n - 31 AS VARCHAR) WHEN n > 270 THEN '*' || (n - 270) ELSE CAST(n - 30 AS VARCHAR) END || CASE WHEN o > 0 THEN '+' || o WHEN o < 0 THEN CAST(o AS VARCHAR) ELSE '' END AS name FROM z""")
def transcript_positions(spark, sf_dir):
    # Each supplier is a transcript of three exons of 100 bases, 100 apart; its first and last 30 bases aren't coding.
    s = F.col("s_suppkey") * 1000
    plus = F.col("s_suppkey") % 2 == 0
    tx = _t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("transcript"), F.lit("1").alias("chrom"), F.when(plus, "+").otherwise("-").alias("strand"),
        F.concat_ws(",", s, s + 200, s + 400).alias("exon_starts"), F.concat_ws(",", s + 100, s + 300, s + 500).alias("exon_ends"), (s + 30).alias("cds_start"), (s + 470).alias("cds_end"))
    points = _t(spark, sf_dir, "orders").select(F.lit("1").alias("chrom"), (F.col("o_orderkey") * 7).alias("pos")).distinct()
    named = C.transcript_positions(points, C.segments(P.exons(tx)), to="name")
    return named.select(F.col("transcript").cast("long").alias("s_suppkey"), "pos", "n", "name")
