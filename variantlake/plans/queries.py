"""Queries that apply the library's operators to the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as R
from ..functions import numbers as M
from ..functions import text as T
from ..operators import diff as D
from ..operators import enrich as E
from ..operators import info as I
from ..operators import merge as G
from ..operators import ranges as X
from ..operators import search as S
from ..operators import versions as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _current_orders(spark, sf_dir) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    return V.current_version(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


_CURRENT = "(SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC)"


# -- releases ------------------------------------------------------------------------------------------------------

@query(f"""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open_orders, count(*) FILTER (o_orderstatus = 'F') AS filled,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS urgent_open,
    count(*) FILTER (o_totalprice > 250000) AS large FROM {_CURRENT} c WHERE o_orderstatus <> 'P'""")
def facet_counts(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return V.facet_counts(V.live(_current_orders(spark, sf_dir), "o_orderstatus", "P"), {
        "open_orders": s == "O", "filled": s == "F", "urgent": p == "1-URGENT", "urgent_open": (p == "1-URGENT") & (s == "O"), "large": F.col("o_totalprice") > 250000})


@query(f"SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM {_CURRENT} c")
def current_version(spark, sf_dir):
    return _current_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS version, lead(o_orderstatus) OVER w AS previous_status FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)""")
def version_history(spark, sf_dir):
    h = V.history(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], {"previous_status": "o_orderstatus"})
    return h.select("o_custkey", "o_orderkey", "version", "previous_status")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS release, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS opened,
    count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1""")
def release_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return V.counts_by(_t(spark, sf_dir, "orders"), [F.year("o_orderdate").alias("release")], {"opened": s == "O", "filled": s == "F", "pending": s == "P"})


@query("""SELECT c.o_custkey, c.o_orderkey, count(*) AS versions, min(o.o_orderkey) AS first_key FROM orders c JOIN orders o
    ON c.o_custkey = o.o_custkey AND o.o_orderdate <= c.o_orderdate AND o.o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ALL""")
def history_self_join(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    h = V.history_summary(orders, "o_custkey", "o_orderdate", "versions", {"first_key": "o_orderkey"}, F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))
    return h.select("o_custkey", "o_orderkey", "versions", "first_key")


@query("""WITH stored AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0), incoming AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT c_custkey, c_name, false AS deleted FROM incoming UNION ALL
    SELECT c_custkey, c_name, true FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.c_custkey = s.c_custkey)""")
def soft_delete_upsert(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    stored, incoming = (c.filter(f).select("c_custkey", "c_name") for f in ("c_acctbal > 0", "c_mktsegment <> 'BUILDING'"))
    return V.soft_delete_upsert(stored, incoming, ["c_custkey"])


@query("""WITH cur AS (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1)
    SELECT o.o_orderkey, round(c.best, 2) AS o_totalprice FROM orders o JOIN cur c USING (o_custkey)""")
def backfill_history(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    cur = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return V.backfill(orders, cur, ["o_custkey"], ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


# -- merging -------------------------------------------------------------------------------------------------------

@query("""WITH a AS (SELECT c_nationkey AS nation, list_sort(list(DISTINCT c_mktsegment)) AS v FROM customer GROUP BY 1),
    b AS (SELECT s_nationkey AS nation, list_sort(list(DISTINCT CAST(s_suppkey % 7 AS VARCHAR))) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    SELECT nation, concat_ws(',', CASE WHEN a.v IS NOT NULL THEN 'customer' END, CASE WHEN b.v IS NOT NULL THEN 'supplier' END) AS sources,
    coalesce(array_to_string(a.v, ','), '-') AS value_customer, coalesce(array_to_string(b.v, ','), '-') AS value_supplier FROM a FULL JOIN b USING (nation)""")
def merge_sources_full_outer(spark, sf_dir):
    # The condition on balances is part of what is asked: it gives the second source fewer keys than the first.
    from ..sources.writers import as_text

    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.array("c_mktsegment").alias("value"))
    s = _t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), F.array((F.col("s_suppkey") % 7).cast("string")).alias("value"))
    merged = G.merge_sources([(G.SourceSpec("customer", {"value": "value"}), c), (G.SourceSpec("supplier", {"value": "value"}), s)], ["nation"])
    return as_text(merged).select(F.col("nation").cast("int").alias("nation"), F.col("Source").alias("sources"), "value_customer", "value_supplier")


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS quantity,
    arg_min(l_linestatus, l_linenumber) AS status FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus) GROUP BY 1""")
def dedup_repeat_merge(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").repartition("l_orderkey")  # serves the rows of a line and those of an order
    one = V.current_version(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_linestatus")])
    rows = one.select("l_orderkey", "l_linenumber", F.array("l_returnflag").alias("flags"), F.array(F.col("l_quantity").cast("long").cast("string")).alias("quantity"), F.array("l_linestatus").alias("status"))
    spec = G.SourceSpec("lines", {"flags": "", "quantity": "", "status": ""}, summed=frozenset({"quantity"}), single=frozenset({"status"}))
    m = G.merge_repeats(rows, ["l_orderkey"], "l_linenumber", spec)
    return m.select("l_orderkey", F.array_join("flags", ",").alias("flags"), F.array_join("quantity", ",").alias("quantity"), F.array_join("status", ",").alias("status"))


@query("""SELECT p_partkey, CAST(i - 1 AS INTEGER) AS allele, split_part(p_name, ' ', CAST(i AS INTEGER)) AS alt FROM (
    SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def explode_multi(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("alts"), F.create_map(F.lit("k"), F.array("p_brand")).alias("info"))
    return G.explode_alleles(p).select("p_partkey", "allele", "alt")


@query("""SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS VARCHAR) AS total, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1""")
def combine_submissions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").cast("string").alias("total"), F.col("o_orderstatus").alias("statuses"))
    return G.combine_submissions(o, ["o_custkey"], ["total"])


@query("""WITH d AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus),
    f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS n FROM d GROUP BY ALL), g AS (SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY n) AS flags FROM f GROUP BY 1)
    SELECT l_orderkey, arg_min(l_suppkey, l_linenumber) AS supplier, any_value(flags) AS flags FROM d JOIN g USING (l_orderkey) GROUP BY 1""")
def upsert_lists(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").repartition("l_orderkey")  # serves the rows of a line and those of an order
    one = V.current_version(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_linestatus")])
    u = G.upsert(one.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier"), F.array("l_returnflag").alias("flags")), ["l_orderkey"], "l_linenumber", ["supplier"])
    return u.select("l_orderkey", "supplier", F.array_join("flags", ",").alias("flags"))


# -- intervals -----------------------------------------------------------------------------------------------------

def _brackets(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (900L, 950L, 'a'), (1000L, 1100L, 'b'), (1200L, 1300L, 'c'), (1250L, 1500L, 'd'), (1800L, 1900L, 'e') AS t(lo, hi, name)")


_BRACKETS = "(VALUES (900, 950, 'a'), (1000, 1100, 'b'), (1200, 1300, 'c'), (1250, 1500, 'd'), (1800, 1900, 'e')) AS b(lo, hi, name)"


@query(f"SELECT p_partkey, p_retailprice FROM part WHERE NOT EXISTS (SELECT 1 FROM {_BRACKETS} WHERE p_retailprice BETWEEN lo AND hi)")
def outside_boundaries(spark, sf_dir):
    return X.outside(_t(spark, sf_dir, "part"), _brackets(spark), [], "p_retailprice", "lo", "hi", 100).select("p_partkey", "p_retailprice")


@query(f"SELECT p_partkey, name FROM part LEFT JOIN {_BRACKETS} ON p_retailprice >= lo AND p_retailprice < hi")
def interval_point_lookup(spark, sf_dir):
    return X.point_lookup(_t(spark, sf_dir, "part"), _brackets(spark), [], "p_retailprice", "lo", "hi", 100).select("p_partkey", "name")


@query(f"""WITH r AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS lo0, CAST(floor(p_retailprice) AS BIGINT) + p_size AS hi0 FROM part)
    SELECT p_partkey, (SELECT name FROM {_BRACKETS} WHERE lo0 <= hi AND hi0 >= lo ORDER BY name LIMIT 1) AS name FROM r""")
def interval_overlap_first(spark, sf_dir):
    r = _t(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").alias("lo0"), (F.floor("p_retailprice") + F.col("p_size")).alias("hi0"))
    return X.first_overlap(r, _brackets(spark), ["p_partkey"], [], "lo0", "hi0", "lo", "hi", ["name"], 100).select("p_partkey", "name")


@query(f"""SELECT name, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM {_BRACKETS} JOIN part ON p_retailprice BETWEEN lo AND hi
    JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def band_mean_median(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_retailprice", "l_quantity")
    s = X.band_statistics(_brackets(spark), v, ["name"], [], "p_retailprice", "lo", "hi", "l_quantity", 100)
    return s.filter("observable").select("name", F.round("mean", 6).alias("mean"), "median")


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id FROM events),
    f AS (SELECT *, CASE WHEN s > max(s) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1800 THEN 1 ELSE 0 END AS n FROM e),
    g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT user_id, min(s) AS s, max(s) AS e, count(*) AS rows FROM g GROUP BY user_id, i""")
def interval_coalesce(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"))
    return X.coalesce_intervals(e.withColumn("e", F.col("s")), ["user_id"], "s", "e", F.lit(1800))


@query("""WITH b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT b.event_id, v.event_id AS view_id FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""")
def nearest_before(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    n = X.nearest_before(buys, views, ["user_id"], "ts", "ts", ["view_id"])
    return n.select("event_id", F.col("before.view_id").alias("view_id"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, avg(l_quantity) AS m, count(*) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    b AS (SELECT l_partkey, l_suppkey, avg(l_quantity) AS m, count(*) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
    SELECT l_partkey, l_suppkey, round(coalesce((a.m * a.d + b.m * b.d) / (a.d + b.d), a.m, b.m), 6) AS mean FROM a FULL JOIN b USING (l_partkey, l_suppkey)""")
def full_outer_weighted_mean(spark, sf_dir):
    # Many pairs of part and supplier have rows with one of the flags only, so both outer parts are there.
    li, k = _t(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    agg = lambda d: d.groupBy(*k).agg(F.avg("l_quantity").alias("mean"), F.count("*").alias("depth"))
    w = E.weighted_coverage(agg(li.filter("l_returnflag = 'R'")), agg(li.filter("l_returnflag = 'A'")), k)
    return w.select(*k, F.round("mean", 6).alias("mean"))


# -- annotation ----------------------------------------------------------------------------------------------------

@query("""WITH a AS (SELECT l_partkey, max(l_quantity) AS q, max(l_tax) AS t, max(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT p_partkey, q AS max_quantity, greatest(q, t, d, CAST(p_size AS DOUBLE)) AS best FROM part LEFT JOIN a ON p_partkey = l_partkey""")
def left_annotate(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("max_quantity"), F.max("l_tax").alias("t"), F.max("l_discount").alias("d"))
    a = E.annotate(_t(spark, sf_dir, "part"), li, ["p_partkey"], ["max_quantity", "t", "d"])
    return a.select("p_partkey", "max_quantity", M.greatest_number(F.col("max_quantity"), F.col("t"), F.col("d"), F.col("p_size")).alias("best"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01')")
def anti_unscored(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").filter("o_orderdate >= timestamp '1999-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return E.unscored(_t(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < (CASE WHEN l_tax <= 0.00002 THEN 25 ELSE 20 END) THEN 'fail: read depth or flags' WHEN l_returnflag = 'R' THEN 'fail: read depth or flags'
    WHEN l_tax > 0.00002 THEN CASE WHEN l_tax / 50 > 0.001 THEN 'BA1' WHEN l_tax / 50 > 0.0001 THEN 'BS1' ELSE 'BS1_Supporting' END
    WHEN l_discount > 0 THEN 'no code met' WHEN l_linestatus = 'O' THEN 'PM2_Supporting' ELSE 'no code met (non-SNV)' END AS code FROM lineitem""")
def evidence_code(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    faf = F.when(F.col("l_tax") > 0.00002, F.col("l_tax") / 50).otherwise(F.lit(0.0))
    code = E.dataset_code(F.lit("-"), faf, F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.lit(True), parsed=True)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'Discordant' ELSE 'Concordant' END AS flag FROM orders GROUP BY 1""")
def discordance(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "Pathogenic").when(F.col("o_orderstatus") == "O", "Likely_Benign").otherwise("other")
    per = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(word)), ",").alias("words"))
    return per.select("o_custkey", E.discordant(F.col("words")).alias("flag"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment || ' (rich)' END, CASE WHEN c_nationkey % 2 = 0 THEN c_name || ' (even)' END, '-') AS label FROM customer""")
def coalesce_precedence(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    label = M.frequency_by_precedence([(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), "rich"), (F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")), "even")])
    return c.select("c_custkey", label.alias("label"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x * pow(10.0, 2.0 - floor(log10(abs(x)))), 0) / pow(10.0, 2.0 - floor(log10(abs(x)))) END AS rounded
    FROM (SELECT *, l_extendedprice * l_discount AS x FROM lineitem)""")
def sigfig_round(spark, sf_dir):
    x = F.col("l_extendedprice") * F.col("l_discount")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.significant(x, 3).alias("rounded"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'error') AS has_error FROM events GROUP BY 1""")
def source_explode_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"))
    return E.source_flags(e, "sources", ["click", "error"], "has_")


@query("""WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS l FROM events GROUP BY 1), x AS (SELECT user_id, list_filter(l, lambda t: t NOT IN ('click', 'view')) AS l FROM e)
    SELECT user_id, array_to_string(l, ',') AS sources FROM x WHERE len(l) > 0""")
def subset_by_source(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"), F.count("*").alias("n_click"))
    return E.without_sources(e, ["click", "view"], "sources")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d %B %Y') AS shown, strftime(o_orderdate, '%B %Y') AS release, o_orderdate >= TIMESTAMP '1996-07-01' AS recent,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1997-01-01' OR o_orderpriority = '2-HIGH' AND o_orderdate < TIMESTAMP '1995-01-01' THEN NULL ELSE o_orderstatus END AS status FROM orders""")
def date_forms(spark, sf_dir):
    from ..functions import dates as D2

    day, text = F.col("o_orderdate").cast("timestamp"), F.date_format("o_orderdate", "MMMM d, yyyy")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", D2.iso_date(text).alias("iso"), D2.display_date(text).alias("shown"), D2.release_date(text).alias("release"), D2.since(day, "1996-07-01").alias("recent"),
        D2.hide_before(F.col("o_orderstatus"), F.col("o_orderpriority"), day, {"1-URGENT": "1997-01-01", "2-HIGH": "1995-01-01"}).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - 25) / 14, 9) AS z, l_tax = l_discount OR abs(l_tax - l_discount) <= greatest(greatest(abs(l_tax), abs(l_discount)) * 0.25, 0.005) AS near,
    l_quantity = l_linenumber AS same, greatest(l_quantity / 100, l_discount) AS most FROM lineitem""")
def number_forms(spark, sf_dir):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(M.z_score(q, 25.0, 14.0), 9).alias("z"), M.close(t, d, 0.25, 0.005).alias("near"),
        M.same_value(q.cast("string"), F.col("l_linenumber").cast("string")).alias("same"), M.greatest_number((q / 100).cast("string"), d.cast("string")).alias("most"))


@query("""SELECT p_partkey, CAST(least(length(p_name), length(p_type)) AS INTEGER) AS changed, CAST(length(p_name) - least(length(p_name), length(p_type)) AS INTEGER) AS deleted, CAST(length(p_type) - least(length(p_name), length(p_type)) AS INTEGER) AS inserted,
    CASE WHEN length(p_name) = 1 AND length(p_type) = 1 THEN 'substitution' WHEN length(p_name) = 1 AND length(p_type) > 1 AND left(p_type, 1) = p_name THEN 'insertion' WHEN length(p_type) = 1 AND length(p_name) > 1 AND left(p_name, 1) = p_type THEN 'deletion' ELSE 'delins' END AS kind,
    regexp_full_match(upper(p_name), '[ACTGNRY]+') AS bases FROM part""")
def change_sizes(spark, sf_dir):
    from ..operators import splice as P

    n, t = F.col("p_name"), F.col("p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in M.change_size(n, t).items()], P.variant_type(n, t).alias("kind"), T.sequence_only(F.upper(n)).alias("bases"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_quantity) >= 20")
def common_sites(spark, sf_dir):
    return I.common_sites(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 20.0)


@query("""SELECT p_partkey AS site, coalesce(round(avg(l_discount), 9), 0.0) AS mean_r2, count(l_discount) > 0 AS found FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) ON l_partkey = p_partkey GROUP BY 1""")
def linkage(spark, sf_dir):
    near = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("site"), F.col("l_discount").alias("r2"))
    return I.linkage(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("site")), near).select("site", F.round("mean_r2", 9).alias("mean_r2"), "found")


# -- comparison ----------------------------------------------------------------------------------------------------

@query("""WITH o AS (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal, c_name AS name FROM customer WHERE c_acctbal >= 0),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal,
        CASE WHEN c_custkey % 3 = 0 THEN c_name || 'x' ELSE c_name END AS name FROM customer WHERE c_acctbal < 9000)
    SELECT c_custkey, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'deleted' WHEN o.seg <> n.seg THEN 'changed_classification'
        WHEN o.bal <> n.bal THEN 'changed_information' WHEN o.name <> n.name THEN 'added_information' END AS change_type,
        CASE WHEN o.name IS NULL OR n.name IS NULL THEN NULL ELSE CAST((o.seg <> n.seg) AS INTEGER) + CAST((o.bal <> n.bal) AS INTEGER) + CAST((o.name <> n.name) AS INTEGER) END AS fields
    FROM o FULL JOIN n USING (c_custkey)""")
def release_diff(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.filter("c_acctbal >= 0").select(k, F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), F.col("c_name").alias("name"))
    new = c.filter("c_acctbal < 9000").select(k, F.when(k % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("bal"),
                                       F.when(k % 3 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")).alias("name"))
    d = D.release_diff(old, new, D.DiffRules("c_custkey", "seg"))
    return d.select("c_custkey", "change_type", F.when(F.col("diff").isNotNull(), F.size("diff")).alias("fields"))


@query("""WITH l AS (SELECT o_custkey, year(o_orderdate) AS y, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY ALL),
    j AS (SELECT a.o_custkey, a.y, a.p AS old, b.p AS new FROM l a JOIN l b ON b.o_custkey = a.o_custkey AND b.y = a.y + 1)
    SELECT o_custkey, CAST(y AS INTEGER) AS y, array_to_string(list_filter(new, lambda x: NOT list_contains(old, x)), ',') AS added, array_to_string(list_filter(old, lambda x: NOT list_contains(new, x)), ',') AS removed FROM j""")
def list_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    l = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))  # noqa: E741
    j = l.select("o_custkey", "y", F.col("p").alias("old")).join(l.select("o_custkey", (F.col("y") - 1).alias("y"), F.col("p").alias("new")), ["o_custkey", "y"])
    added, removed = R.list_change(F.col("old"), F.col("new"))
    return j.select("o_custkey", "y",F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
    (SELECT k, 'left' AS side FROM (FROM a EXCEPT FROM b)) UNION ALL (SELECT k, 'right' FROM (FROM b EXCEPT FROM a))""")
def symmetric_difference(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    a, b = (li.filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k")) for flag in ("R", "A"))
    return D.symmetric_difference(a, b, ["k"])


# -- search --------------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT p_type = 'ECONOMY' AND starts_with(p_brand, 'Brand#1')""")
def facet_filter_or_and(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumns({"small": F.col("p_size") < 10, "big": F.col("p_size") > 40, "economy": F.col("p_type") == "ECONOMY"})
    return S.by_values(S.by_sources(p, ["small", "big", "economy"], ["small", "big"], ["economy"]), {"p_brand": "Brand#1"}).select("p_partkey")


_PART = S.SearchColumns(gene="p_type", transcript="p_brand", cdna="p_name", protein="p_name", protein_short="p_type", synonyms="p_brand", registry="p_brand", digest="p_brand", accessions=("p_name",),
                        designation="p_type", coordinates="p_name", genomic="p_type", older_coordinates="p_brand", older_genomic="p_brand", genes=("economy", "standard"))


@query("""SELECT count(*) FILTER (p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR starts_with(lower(p_brand), 'ring') OR p_brand ILIKE '%,ring%' OR p_brand ILIKE '%:ring%' OR p_brand ILIKE '%ring%') AS count,
    count(*) FILTER (p_brand ILIKE '%ring%' AND NOT (p_name ILIKE '%ring%' OR p_type ILIKE '%ring%')) AS synonyms_count FROM part""")
def search_generic(spark, sf_dir):
    return S.search(_t(spark, sf_dir, "part"), " RING ", _PART)[1]


@query("""SELECT p_partkey FROM part WHERE (lower(p_type) = 'economy' AND (p_name ILIKE '%sm%' OR starts_with(lower(p_type), 'sm') OR starts_with(lower(p_brand), 'sm') OR p_brand ILIKE '%,sm%' OR p_brand ILIKE '%:sm%'))
    OR p_brand ILIKE '%economy:sm%'""")
def search_prefixed(spark, sf_dir):
    return S.search(_t(spark, sf_dir, "part"), "economy:sm", _PART)[0].select("p_partkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def ordered_page(spark, sf_dir):
    o = S.ordered(_t(spark, sf_dir, "orders"), "o_shown", False, {"o_shown": "o_totalprice"}, ["o_orderkey"])
    return S.page(o, 50, 2).select("o_orderkey", "o_totalprice")


@query("""SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) WHERE starts_with(w, 's') AND length(w) >= 3 ORDER BY 1 LIMIT 5""")
def autocomplete(spark, sf_dir):
    return S.complete(S.words(_t(spark, sf_dir, "part"), ["p_name", "p_type"]), "S", 5)


@query("""SELECT lower(p_brand) AS word FROM part UNION SELECT unnest(string_split(lower(p_name), ' ')) FROM part UNION SELECT lower(c_mktsegment) FROM customer UNION SELECT lower(n_name) FROM nation""")
def words_union_distinct(spark, sf_dir):
    parts = [S.words(_t(spark, sf_dir, t), c) for t, c in (("part", ["p_brand", "p_name"]), ("customer", ["c_mktsegment"]), ("nation", ["n_name"]))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


# -- sequences and information -------------------------------------------------------------------------------------

@query("""WITH w AS (SELECT p_partkey, i, substr(p_name, CAST(i AS BIGINT) + 1, 5) AS win FROM part, range(0, 60) t(i) WHERE i <= length(p_name) - 5),
    s AS (SELECT *, len(win) - len(replace(win, 'e', '')) AS score FROM w)
    SELECT p_partkey, CAST(arg_max(i, score * 1000 - i) AS INTEGER) AS "offset", arg_max(win, score * 1000 - i) AS "window", CAST(max(score) AS INTEGER) AS score FROM s GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    score = lambda w: F.length(w) - F.length(F.replace(w, F.lit("e"), F.lit("")))
    p = _t(spark, sf_dir, "part").withColumn("w", X.sequence_windows(F.col("p_name"), 5)).filter("w is not null")
    return p.select("p_partkey", X.best_window(F.col("w"), score).alias("b")).select("p_partkey", "b.offset", "b.window", "b.score")


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc FROM part")
def reverse_complement(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.reverse_complement(F.upper("p_name")).alias("rc"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(sum(p * p), 6) AS simpson FROM p GROUP BY 1""")
def entropy(spark, sf_dir):
    d = I.diversity(_t(spark, sf_dir, "events"), ["user_id"], "event_type")
    return d.select("user_id", (F.round("entropy", 6) + 0.0).alias("entropy"), F.round("simpson", 6).alias("simpson"))


@query("""WITH g AS (SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS p FROM orders GROUP BY 1), c AS (SELECT p, count(*) AS n FROM g GROUP BY 1)
    SELECT round(count(*) / sum(n), 9) AS distinct_share, round(count(*) FILTER (n = 1) / sum(n), 9) AS unique_share, CAST(sum(n) AS BIGINT) AS individuals FROM c""")
def identifiability(spark, sf_dir):
    i = I.identifiability(I.profiles(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus"))
    return i.select(F.round("distinct_share", 9).alias("distinct_share"), F.round("unique_share", 9).alias("unique_share"), "individuals")


@query("""WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_linestatus, l_returnflag, n, round(n / sum(n) OVER (), 9) AS joint, round(n / sum(n) OVER (PARTITION BY l_linestatus), 9) AS conditional FROM c""")
def conditional_dist(spark, sf_dir):
    c = I.conditional(_t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag")
    return c.select("l_linestatus", "l_returnflag", "n", F.round("joint", 9).alias("joint"), F.round("conditional", 9).alias("conditional"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, event_type, round(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING), 9) AS cumulative FROM p""")
def cumulative_shares(spark, sf_dir):
    return I.cumulative_shares(_t(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", "event_type", F.round("cumulative", 9).alias("cumulative"))


@query("SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)) AS digest FROM customer")
def hash_records(spark, sf_dir):
    p = _t(spark, sf_dir, "customer").withColumn("profile", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"))
    return I.hashed_profiles(p).select("c_custkey", "digest")


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS shared FROM t a JOIN t b USING (user_id) WHERE a.event_type <= b.event_type GROUP BY ALL""")
def source_overlap(spark, sf_dir):
    return I.source_overlap(_t(spark, sf_dir, "events"), "user_id", "event_type")


def _pairs(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
    l(node, component) USING KEY (node) AS (
        SELECT node, node FROM (SELECT a AS node FROM e UNION SELECT b FROM e)
        UNION SELECT x.node, min(l.component) FROM (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) x JOIN l ON l.node = x.other
            JOIN recurring.l o ON o.node = x.node WHERE l.component < o.component GROUP BY x.node)
    SELECT node, component FROM l""")
def haplotype_components(spark, sf_dir):
    return I.components(_pairs(spark, sf_dir))


@query()
def knapsack(spark, sf_dir):
    items = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("long").alias("weight"), F.col("p_retailprice").alias("value"))
    return I.knapsack(items, 60, 6)


@query("""WITH RECURSIVE c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
    d AS MATERIALIZED (SELECT user_id AS site, row_number() OVER (ORDER BY round(-sum(p * ln(p)), 9) DESC, user_id) AS place FROM p GROUP BY 1),
    n AS MATERIALIZED (SELECT a.site, b.site AS better FROM d a JOIN d b ON abs(a.site - b.site) = 1 AND b.place < a.place),
    s(site, status) USING KEY (site) AS (
        SELECT site, CASE WHEN site IN (SELECT site FROM n) THEN 'open' ELSE 'taken' END FROM d
        UNION SELECT o.site, CASE WHEN bool_or(b.status = 'taken') THEN 'gone' ELSE 'taken' END
            FROM recurring.s o JOIN n ON n.site = o.site JOIN recurring.s b ON b.site = n.better
            WHERE o.status = 'open' AND EXISTS (SELECT 1 FROM s) GROUP BY o.site HAVING bool_or(b.status = 'taken') OR bool_and(b.status = 'gone'))
    SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank, site FROM s JOIN d USING (site) WHERE status = 'taken' ORDER BY place LIMIT 20""")
def low_redundancy(spark, sf_dir):
    d = I.diversity(_t(spark, sf_dir, "events"), ["user_id"], "event_type").select(F.col("user_id").alias("site"), F.round("entropy", 9).alias("score"))
    near = d.select("site", (F.col("site") + 1).alias("proxy"))
    return I.select_uncorrelated(d, near, 20)

