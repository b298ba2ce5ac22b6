"""Merging sources: alleles apart, repeats together, one row per key over all sources, equivalence classes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class SourceSpec:
    """How a source takes part in the merge: output field -> key in its info map, and how repeated values combine."""

    name: str
    fields: dict[str, str]
    stacked: frozenset[str] = frozenset()  # newest value first, repeats kept, so that such lists stay aligned
    summed: frozenset[str] = frozenset()
    single: frozenset[str] = frozenset()  # at most one value: the first seen stays
    optional: bool = False
    extra: dict[str, str] = field(default_factory=dict)


def explode_alleles(df: DataFrame, alts: str = "alts", info: str = "info", ordinal: list[str] | None = None, id_name: str = "allele_id") -> DataFrame:
    """One row per alternative allele, numbered within the file.

    An info value with as many items as there are alleles is cut to the allele's own; others are copied whole.
    ``ordinal`` names the columns that give the file's order (a file is numbered as a whole); without it there are
    no numbers.
    """
    n = F.size(alts)
    out = df.withColumn("_n", n).select("*", F.posexplode(alts).alias("allele", "alt")).withColumn(
        info, F.transform_values(info, lambda k, v: F.when((F.col("_n") > 1) & (F.size(v) == F.col("_n")), F.array(F.get(v, F.col("allele")))).otherwise(v)))
    out = out.drop("_n", alts)
    if ordinal:
        *file, line = ordinal
        out = out.withColumn(id_name, F.row_number().over(W.partitionBy(*file).orderBy(line, "allele")))
    return out


def _distinct_values(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(c)), lambda x: x.isNotNull() & (x != ""))))


def merge_repeats(df: DataFrame, key: list[str], order: str, spec: SourceSpec) -> DataFrame:
    """One row per key of a source, from rows whose value columns are arrays of texts.

    Stacked fields are joined newest first, summed ones added up, single ones keep the first row's value, all others
    become the sorted different values.
    """
    aggs = []
    for c in spec.fields:
        if c in spec.stacked:
            ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v"))), asc=False)
            aggs.append(F.flatten(F.transform(ordered, lambda x: x["v"])).alias(c))
        elif c in spec.summed:
            aggs.append(F.array(F.sum(F.get(c, F.lit(0)).try_cast("long")).cast("string")).alias(c))
        elif c in spec.single:
            aggs.append(F.min_by(c, F.when(F.size(c) > 0, F.col(order))).alias(c))
        else:
            aggs.append(_distinct_values(c).alias(c))
    return df.groupBy(*key).agg(*aggs)


def merge_sources(sources: list[tuple[SourceSpec, DataFrame]], key: list[str]) -> DataFrame:
    """The full outer merge of all sources by key, in one shuffle: union, then one group per key.

    A source's fields become ``<field>_<source>`` arrays; ``Source`` lists the sources of a key in their given order.
    Equal values of a key are dropped before the shuffle, so a group gathers its different values only.
    """
    wide = None
    columns: list[str] = []
    for i, (spec, df) in enumerate(sources):
        part = df.select(*key, F.lit(i).alias("_rank"), F.lit(spec.name).alias("_source"), *[F.col(f).alias(f"{f}_{spec.name}") for f in spec.fields])
        columns += [f"{f}_{spec.name}" for f in spec.fields]
        wide = part if wide is None else wide.unionByName(part, allowMissingColumns=True)
    ranked = F.array_sort(F.collect_set(F.struct("_rank", "_source")))
    return wide.groupBy(*key).agg(
        F.array_join(F.transform(ranked, lambda x: x["_source"]), ",").alias("Source"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in columns],
    )


def upsert(df: DataFrame, key: list[str], order: str, fixed: list[str]) -> DataFrame:
    """Rows of one key in one: fixed columns of the first row, others the different non-blank values in order."""
    value = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])))
    lists = [c for c in df.columns if c not in (*key, *fixed, order)]
    return df.groupBy(*key).agg(*[F.min_by(c, order).alias(c) for c in fixed], *[value(c).alias(c) for c in lists])


def validate(df: DataFrame, regions: DataFrame, width: int = 1 << 17) -> DataFrame:
    """Adds ``reason``: NULL for valid rows, else the first of outside boundaries, incorrect reference, no change.

    ``regions`` holds chrom, start, end (inclusive, extended by one as configured ends are) and the sequence from
    ``seq_start`` on. Of regions that overlap, the first by start decides.
    """
    cells = regions.withColumn("_end", F.col("end") + 1).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") + 1) / width))))
    r = cells.select(F.col("chrom").alias("_chrom"), "_cell", F.col("start").alias("_start"), "_end", "seq", "seq_start")
    p = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_pcell", F.floor(F.col("pos") / width))
    hit = p.join(r, (p["chrom"] == r["_chrom"]) & (p["_pcell"] == r["_cell"]) & p["pos"].between(r["_start"], r["_end"]), "left")
    first = F.row_number().over(W.partitionBy("_row").orderBy("_start"))
    hit = hit.withColumn("_k", first).filter("_k = 1")
    there = F.upper(F.substring("seq", (F.col("pos") - F.col("seq_start") + 1).cast("int"), F.length("ref")))
    reason = (
        F.when(F.col("_start").isNull(), "outside boundaries").when(~F.startswith(F.upper("ref"), there) | (F.length(there) == 0), "incorrect reference")
        .when(F.col("ref") == F.col("alt"), "no change")
    )
    return hit.withColumn("reason", reason).select(*df.columns, "reason")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the reason, and the rejected ones with it."""
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null")


def rejected_log(rejected: DataFrame, ids: str, source: str, key: list[str]) -> DataFrame:
    """One line per report id of the rejected rows: id, source, reason, key."""
    return rejected.select(F.explode(F.split(F.col(ids), ",")).alias("id"), F.col(source).alias("source"), "reason", *key).filter("trim(id) not in ('', '-')")


def equivalence_key(df: DataFrame, regions: DataFrame, work_columns: tuple[str, str, str, str] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """Adds ``canonical``, equal exactly for edits that give the same sequence: the leftmost writing of each edit.

    Inside its region an edit is trimmed and, if it only inserts or deletes, moved left while the base before it equals
    its last base. That is one short string per row, where the edited sequence would be a whole region.
    """
    chrom, pos, ref, alt = work_columns
    r = regions.select(F.col("chrom").alias("_chrom"), "seq", "seq_start", (F.col("seq_start") + F.length("seq")).alias("seq_end"))
    m = df.join(r, (F.col(chrom) == F.col("_chrom")) & (F.col(pos) >= F.col("seq_start")) & (F.col(pos) < F.col("seq_end")), "left")
    # Without common ends: suffix first, here down to nothing.
    k = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(ref), F.length(alt))), lambda n: F.right(F.col(ref), n) == F.right(F.col(alt), n)))
    m = m.withColumn("_k", k)
    m = m.withColumns({"_r": F.expr(f"left({ref}, length({ref}) - _k)"), "_a": F.expr(f"left({alt}, length({alt}) - _k)")})
    j = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("_r"), F.length("_a"))), lambda n: F.left(F.col("_r"), n) == F.left(F.col("_a"), n)))
    m = m.withColumn("_j", j)
    m = m.withColumns({"_p": F.col(pos) + F.col("_j"), "_r": F.expr("substring(_r, _j + 1)"), "_a": F.expr("substring(_a, _j + 1)")})
    # A pure edit of length n can move left over every base that equals the one n places after it in the edited text.
    unit = F.concat("_r", "_a")
    pure = (F.length("_r") == 0) != (F.length("_a") == 0)
    before = F.reverse(F.substring("seq", F.lit(1), (F.col("_p") - F.col("seq_start")).cast("int")))
    back = F.reverse(unit)
    n = F.length(unit)
    same = lambda i: F.substring(before, i + 1, F.lit(1)) == F.when(i < n, F.substring(back, i + 1, F.lit(1))).otherwise(F.substring(before, i - n + 1, F.lit(1)))
    longest = F.length(before)
    shift = F.aggregate(
        F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")),
        lambda s, i: F.struct((s["go"] & F.coalesce(same(i), F.lit(False)) & (i < longest)).alias("go"), (s["n"] + F.when(s["go"] & F.coalesce(same(i), F.lit(False)) & (i < longest), 1).otherwise(0)).alias("n")),
        lambda s: s["n"],
    )
    m = m.withColumn("_shift", F.when(pure & F.col("seq").isNotNull(), shift).otherwise(0))
    rotate = lambda c: F.when(F.length(c) == 0, c).otherwise(F.expr(f"concat(right({c}, cast(_shift % length({c}) as int)), left({c}, cast(length({c}) - _shift % length({c}) as int)))"))
    canonical = F.concat_ws(":", F.col(chrom).cast("string"), (F.col("_p") - F.col("_shift")).cast("string"), rotate("_r"), rotate("_a"))
    return m.withColumn("canonical", canonical).select(*df.columns, "canonical")


def merge_equivalent(df: DataFrame, class_id: str, key: str, descending: Column, lists: list[str]) -> DataFrame:
    """One row per class. The base is the smallest key, or the largest where ``descending`` holds for the class; its
    blanks are filled and different values are listed in order of key."""
    scalars = [c for c in df.columns if c not in (class_id, *lists)]
    down = F.bool_or(descending)
    value = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])))
    pick = lambda c: F.when(down, F.max_by(c, F.when(F.col(c).isNotNull(), F.col(key)))).otherwise(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))))
    return df.groupBy(class_id).agg(*[pick(c).alias(c) for c in scalars], *[value(c).alias(c) for c in lists], F.count("*").alias("members"))


def combine_submissions(df: DataFrame, key: list[str], summed: list[str]) -> DataFrame:
    """Submissions of one key in one: numbers added, differing values listed, sorted."""
    others = [c for c in df.columns if c not in (*key, *summed)]
    return df.groupBy(*key).agg(
        *[F.sum(F.col(c).try_cast("long")).cast("string").alias(c) for c in summed],
        *[F.array_join(F.array_sort(F.collect_set(T.blank_to_null(F.col(c)))), ",").alias(c) for c in others],
    )


def submission_key(*columns: str) -> Column:
    return F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns])


def check_unique(df: DataFrame, key: list[str]) -> None:
    """Raises if a key repeats."""
    again = df.groupBy(*key).count().filter("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"keys that repeat: {[tuple(r)[:-1] for r in again]}")
