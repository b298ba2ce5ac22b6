"""What the serving side asks for: assembled records, report groups, literature, page order, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as M
from ..functions import text as T


def assemble(variants: DataFrame, lookups: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Variants with one struct per lookup table (name -> table, key column in both), NULL where there is none.

    Lookup tables have one row per key; a table small enough is broadcast by Spark.
    """
    out = variants
    for name, (table, key) in lookups.items():
        one = table.dropDuplicates([key]).select(F.col(key).alias("_k"), F.struct(*[c for c in table.columns if c != key]).alias(name))
        out = out.join(one, out[key] == F.col("_k"), "left").drop("_k")
    return out


def attach_diffs(diffs: DataFrame, variants: DataFrame, release: int, key: str = "key") -> DataFrame:
    """Diff entries with the ids of the release's variants; keys the release lacks go."""
    own = variants.filter(F.col("release") == release).select("variant_id", key)
    return diffs.join(own, key).select("variant_id", "diff")


def attach_report_diffs(diffs: DataFrame, reports: DataFrame, release: int) -> DataFrame:
    """As attach_diffs for reports, whose key is an accession where it looks like one, else a submission id."""
    own = reports.filter(F.col("release") == release).select(
        "report_id", F.explode(F.array(T.blank_to_null(F.col("scv")), T.blank_to_null(F.col("submission")))).alias("value"))
    keyed = diffs.withColumn("_accession", F.col("key").startswith("SCV"))
    owned = own.withColumn("_accession", F.col("value").startswith("SCV"))
    return keyed.join(owned, (keyed["key"] == owned["value"]) & (keyed["_accession"] == owned["_accession"])).select("report_id", "diff")


def reports_of_latest(reports: DataFrame, source: str = "Source", release: str = "release") -> DataFrame:
    """Reports of each source's newest release."""
    return reports.withColumn("_m", F.max(release).over(W.partitionBy(source))).filter(F.col(release) == F.col("_m")).drop("_m")


def report_spans(reports: DataFrame, group: list[str], release: str = "release", columns: tuple[str, ...] = ()) -> DataFrame:
    """Per group the oldest and the newest release and what columns held in each."""
    pick = [x for c in columns for x in (F.min_by(c, release).alias(f"oldest_{c}"), F.max_by(c, release).alias(f"newest_{c}"))]
    return reports.groupBy(*group).agg(F.min(release).alias("oldest"), F.max(release).alias("newest"), F.count("*").alias("versions"), *pick)


def by_review(df: DataFrame, status: str, date: Column, stars: dict[str, int]) -> DataFrame:
    """Submissions by review stars, then by date, both falling; unknown statuses have no star."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in stars.items() for x in kv])[F.lower(F.col(status))], F.lit(0))
    return df.orderBy(F.desc(rank), date.desc_nulls_last())


def literature(papers: DataFrame, variant_papers: DataFrame, variant: str | None = None) -> DataFrame:
    """Papers with the variants they mention, newest first, papers without a year last; deleted ones are not left out."""
    met = variant_papers.join(papers, "pmid")
    met = met.filter(F.col("variant") == variant) if variant is not None else met
    year = F.col("year").try_cast("int")
    shown = met.withColumn("year", F.when(year == 0, "Unknown").otherwise(F.col("year")))
    return shown.orderBy(year.desc_nulls_last(), F.col("pmid").desc())


def paired_versions(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each version beside the one that follows it, as structs ``before`` and ``after``; the last has none."""
    w = W.partitionBy(*key).orderBy(order)
    return df.select(*key, F.struct("*").alias("before"), F.lead(F.struct("*")).over(w).alias("after"))


def counts_by_source(df: DataFrame, source: str, change: str) -> DataFrame:
    """Per source of a list column: rows, and rows by type of change; the row for NULL counts all rows once."""
    kinds = ["new", "deleted", "changed_classification", "changed_information", "added_information"]
    facets = [F.count_if(F.col(change) == k).alias(k) for k in kinds]
    per = df.select(F.explode(T.split_list(F.col(source))).alias("source"), change).groupBy("source").agg(F.count("*").alias("rows"), *facets)
    return per.unionByName(df.agg(F.count("*").alias("rows"), *facets).withColumn("source", F.lit(None).cast("string")))


def missing_reports(sent: DataFrame, built: DataFrame, discarded: DataFrame, source: str = "source", ids: str = "ids") -> DataFrame:
    """Report ids that one side has and the other lacks, per source; discarded ids count as built."""
    one = lambda d: d.select(source, F.explode(T.split_list(F.col(ids))).alias("id")).distinct()
    have = one(built).unionByName(one(discarded)).distinct().withColumn("_b", F.lit(True))
    both = one(sent).withColumn("_s", F.lit(True)).join(have, [source, "id"], "full_outer").filter("_s is null or _b is null")
    return both.select(source, "id", F.when(F.col("_b").isNull(), "missing").otherwise("unexpected").alias("problem"))


def assert_same_count(before: DataFrame, after: DataFrame) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{a} rows went in, {b} came out")


def max_over(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The largest number among columns, those without one skipped."""
    return df.withColumn(name, M.greatest_number(*[F.col(c) for c in columns]))


def flag_change(variant: Column, relevant: list[tuple[int, int]], protein: Column, ref: Column, alt: Column) -> Column:
    """Whether a variant can be shown on a structure: one base for one, in a covered range, with a protein change that
    is known, is not silent and does not stop."""
    inside = T.any_of([variant.between(a, b) for a, b in relevant])
    shown = ~protein.rlike("[?=*]|Ter") & protein.rlike("[0-9]")
    return (F.length(ref) == 1) & (F.length(alt) == 1) & inside & F.coalesce(shown, F.lit(False))


def rewrite_hgvs_filters(term: str, filters: dict[str, str]) -> tuple[str, dict[str, str]]:
    """A search for ``pathogenic`` or ``benign`` alone becomes a filter on the classification; others stay searches."""
    word = term.strip().lower()
    return ("", {**filters, "Pathogenicity_expert": word.capitalize()}) if word in ("pathogenic", "benign") else (term, filters)


def round_stored(df: DataFrame, columns: list[str], figures: int, diff: str | None = None) -> DataFrame:
    """Stored frequencies rounded to significant figures, in columns and, if named, in the diff entries of them."""
    sig = lambda c: F.coalesce(M.significant(T.blank_to_null(c).try_cast("double"), figures).cast("string"), c)
    out = df.withColumns({c: sig(F.col(c)) for c in columns})
    if diff:
        fixed = lambda e: F.when(e["field"].isin(columns), F.struct(e["field"].alias("field"), e["field_type"].alias("field_type"), F.transform(e["added"], lambda x: sig(x)).alias("added"), F.transform(e["removed"], lambda x: sig(x)).alias("removed"))).otherwise(e)
        out = out.withColumn(diff, F.transform(diff, fixed))
    return out
