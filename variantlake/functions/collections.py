"""Expressions over arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, split_list


def info_map(c: Column) -> Column:
    """``a=1;b=x=y;flag`` as a map; a value may hold ``=``, a key without value maps to NULL, the first of a key counts."""
    pairs = F.filter(F.split(c, ";"), lambda x: x != "")
    keys = F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)))
    value = lambda k: F.get(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), F.lit(0))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.when(value(k).contains("="), F.regexp_replace(value(k), "^[^=]*=", "")).alias("v"))))


def pipe_fields(c: Column, names: list[str], sep: str = "|") -> dict[str, Column]:
    """The named fields of a pipe-delimited text."""
    parts = F.split(c, "\\" + sep)
    return {n: blank_to_null(F.get(parts, F.lit(i))) for i, n in enumerate(names)}


def same_list(a: Column, b: Column) -> Column:
    """Equal as sets of values, however ordered or repeated."""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def without(a: Column, b: Column) -> Column:
    """The values of ``a`` that ``b`` lacks, in order and with their repeats (unlike array_except)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def list_change(old: Column, new: Column) -> tuple[Column, Column]:
    """What a list gained and what it lost; NULL lists count as empty."""
    empty = F.array().cast("array<string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return without(n, o), without(o, n)


def diff_entry(field: str, old: Column, new: Column, is_list: bool) -> Column:
    """One field's change as a struct: field, field_type, added, removed (arrays for lists, one value otherwise)."""
    added, removed = list_change(split_list(old), split_list(new)) if is_list else (
        F.filter(F.array(blank_to_null(new)), lambda x: x.isNotNull()), F.filter(F.array(blank_to_null(old)), lambda x: x.isNotNull()))
    nonempty = lambda a: F.when(F.size(a) > 0, a)
    return F.struct(F.lit(field).alias("field"), F.lit("list" if is_list else "individual").alias("field_type"), nonempty(added).alias("added"), nonempty(removed).alias("removed"))


def classes_by_source(c: Column) -> Column:
    """``a,b(X); c (Y)`` as a map from source to its classes."""
    items = F.filter(F.split(c, ";"), lambda x: F.trim(x) != "")
    entry = lambda x: F.struct(
        F.regexp_extract(x, "\\(([^()]*)\\)\\s*$", 1).alias("k"), F.array_distinct(F.transform(F.split(F.regexp_replace(x, "\\([^()]*\\)\\s*$", ""), ","), lambda x: F.trim(x))).alias("v"))
    entries = F.transform(items, entry)
    # A source that occurs twice keeps its first entry.
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["k"] == k), F.lit(0))))


def class_changes(old: Column, new: Column, sources: list[str]) -> tuple[Column, Column]:
    """Classes added and removed per source, written ``class (source)``."""
    o, n = classes_by_source(F.coalesce(old, F.lit(""))), classes_by_source(F.coalesce(new, F.lit("")))
    added, removed = [], []
    for s in sources:
        plus, minus = list_change(o[F.lit(s)], n[F.lit(s)])
        tag = lambda a, s=s: F.transform(a, lambda x: F.concat(x, F.lit(f" ({s})")))
        added.append(tag(plus))
        removed.append(tag(minus))
    return F.flatten(F.array(*added)), F.flatten(F.array(*removed))


def first_matching(structs: Column, field: str, allowed: list[str]) -> Column:
    """The first struct whose field starts with one of the allowed names; NULL if there is none."""
    def fits(x: Column) -> Column:
        cond = F.lit(False)
        for a in allowed:
            cond = cond | x[field].startswith(a)
        return cond

    return F.get(F.filter(structs, fits), F.lit(0))


def id_in_url(c: Column, pattern: str = "^CA[0-9]+$") -> Column:
    """The last part of an address if it is an id of the wanted form."""
    last = F.substring_index(c, "/", -1)
    return F.when(last.rlike(pattern), last)


def text_or_attribute(element: Column, attribute: Column) -> Column:
    return F.coalesce(blank_to_null(element), blank_to_null(attribute))
