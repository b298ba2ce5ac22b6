"""Comparing two releases field by field."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import collections as R
from ..functions import dates as D
from ..functions import numbers as M
from ..functions import text as T

NEW, DELETED, CLASSIFICATION, CHANGED, ADDED = "new", "deleted", "changed_classification", "changed_information", "added_information"  # fixed values


@dataclass(frozen=True)
class DiffRules:
    """Which columns are compared and how."""

    key: str
    classification: str
    lists: frozenset[str] = frozenset()
    dates: frozenset[str] = frozenset()
    rounded: dict[str, int] = field(default_factory=dict)  # column -> significant figures
    ignored: frozenset[str] = frozenset()
    renamed: dict[str, str] = field(default_factory=dict)  # old name -> new name
    class_sources: tuple[str, ...] = ()


def normalise(c: Column, name: str, rules: DiffRules) -> Column:
    """A value as it is compared: blanks as NULL, lists without empty items, dates and frequencies in one form."""
    v = T.blank_to_null(c.cast("string"))
    if name in rules.dates:
        v = D.iso_date(v)
    if name in rules.rounded:
        v = F.coalesce(M.significant(v.try_cast("double"), rules.rounded[name]).cast("string"), v)
    if name in rules.lists:
        v = F.array_join(T.split_list(v), ",")
    return v


def field_outcome(old: Column, new: Column, is_list: bool = False, is_new: bool = False) -> Column:
    """``changed``, ``added`` or NULL for one field of two rows.

    A value in a column that the old release lacks is added. Equal numbers, equal texts and equal lists are no change;
    a value where there was none, or one that holds the old text, is added; all else is changed.
    """
    blank_new, blank_old = new.isNull(), old.isNull()
    if is_new:
        return F.when(~blank_new, "added")
    same = M.same_value(old, new)
    if is_list:
        same = same | F.coalesce(R.same_list(F.split(old, ","), F.split(new, ",")), F.lit(False))
    return F.when(same, None).when(blank_old, "added").when(blank_new, "changed").when(new.contains(old), "added").otherwise("changed")


def release_diff(old: DataFrame, new: DataFrame, rules: DiffRules, order: str | None = None) -> DataFrame:
    """One row per key in either release: key, change_type (NULL if nothing changed) and diff.

    ``diff`` is an array of (field, field_type, added, removed). One outer join on the key compares all fields in place.
    Of rows that repeat a key, the last by ``order`` counts (any, if none is given).
    """
    k = rules.key
    if order:
        last = lambda d: d.groupBy(k).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        old, new = last(old), last(new)
    else:
        old, new = old.dropDuplicates([k]), new.dropDuplicates([k])
    renamed = {o: n for o, n in rules.renamed.items() if o in old.columns}
    o_cols = {renamed.get(c, c): c for c in old.columns if c != k}
    compared = [c for c in new.columns if c != k and c not in rules.ignored and c != order]
    dropped = [c for c in o_cols if c not in new.columns and c not in rules.ignored and c != order]
    o = old.select(F.col(k), F.struct(*[F.col(src).alias(c) for c, src in o_cols.items()]).alias("o"), F.lit(True).alias("_old"))
    n = new.select(F.col(k), F.struct(*[c for c in new.columns if c != k]).alias("n"), F.lit(True).alias("_new"))
    both = o.join(n, k, "full_outer")
    outcomes, entries = {}, []
    for c in compared:
        a = normalise(F.col(f"o.{c}"), c, rules) if c in o_cols else F.lit(None).cast("string")
        b = normalise(F.col(f"n.{c}"), c, rules)
        outcomes[c] = field_outcome(a, b, c in rules.lists, c not in o_cols)
        if c == rules.classification and rules.class_sources:
            plus, minus = R.class_changes(a, b, list(rules.class_sources))
            entry = F.struct(F.lit(c).alias("field"), F.lit("list").alias("field_type"), F.when(F.size(plus) > 0, plus).alias("added"), F.when(F.size(minus) > 0, minus).alias("removed"))
        else:
            entry = R.diff_entry(c, a, b, c in rules.lists)
        entries.append(F.when(outcomes[c].isNotNull(), entry))
    for c in dropped:
        a = normalise(F.col(f"o.{c}"), c, rules)
        outcomes[c] = F.when(a.isNotNull(), "changed")
        entries.append(F.when(a.isNotNull(), R.diff_entry(c, a, F.lit(None).cast("string"), c in rules.lists)))
    hit = lambda what, cols: T.any_of([F.coalesce(outcomes[c] == what, F.lit(False)) for c in cols])
    matched = F.col("_old") & F.col("_new")
    own = [c for c in outcomes if c == rules.classification]
    change = (
        F.when(F.col("_old").isNull(), NEW).when(F.col("_new").isNull(), DELETED)
        .when(hit("changed", own) | hit("added", own), CLASSIFICATION).when(hit("changed", outcomes), CHANGED).when(hit("added", outcomes), ADDED)
    )
    diff = F.when(matched, F.filter(F.array(*entries), lambda x: x.isNotNull())) if entries else F.array()
    return both.select(k, change.alias("change_type"), diff.alias("diff"))


def removed_and_added(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    return old.join(new.select(*key), key, "left_anti"), new.join(old.select(*key), key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys in one side only, with ``side`` left or right."""
    l, r = a.select(*key).distinct().withColumn("_l", F.lit(1)), b.select(*key).distinct().withColumn("_r", F.lit(1))  # noqa: E741
    both = l.join(r, key, "full_outer").filter("_l is null or _r is null")
    return both.select(*key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def differing_rows(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys in both exports whose other columns are not all equal (NULLs equal each other)."""
    cols = [c for c in a.columns if c in b.columns and c not in key]
    x, y = a.select(*key, F.struct(*cols).alias("a")), b.select(*key, F.struct(*cols).alias("b"))
    return x.join(y, key).filter(~F.col("a").eqNullSafe(F.col("b")))


def report_key(source: Column, scv: Column, submission: Column) -> Column:
    """What a report is compared by: an accession or a submission id by source; NULL for sources without either."""
    return F.when(source == "ClinVar", T.blank_to_null(scv)).when(source == "LOVD", T.blank_to_null(submission))
