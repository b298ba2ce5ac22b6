"""Faceted filters, free-text search, ordering, paging and completion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


# -- facets --------------------------------------------------------------------------------------------------------

def by_sources(df: DataFrame, flags: list[str], include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Rows of any included source and of no excluded one; without included sources only rows of none at all."""
    if include == ["all"]:
        kept = F.lit(True)
    elif include:
        kept = T.any_of([F.col(c) for c in include])
    else:
        kept = T.all_of([~F.col(c) for c in flags])
    return df.filter(kept & T.all_of([~F.col(c) for c in exclude]))


# How a filter's values are written in the data.
SPELLINGS = {"Likely Benign": "Likely benign", "Likely Pathogenic": "Likely pathogenic"}


def by_values(df: DataFrame, values: dict[str, str | int], exact: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows whose columns all start with the given values, case kept; ``exact`` columns must equal them. Values that the
    data spell otherwise are respelled first, wherever they stand in a value."""
    def spelled(v: str | int) -> str:
        v = str(v)
        for a, b in SPELLINGS.items():
            v = v.replace(a, b)
        return v

    return df.filter(T.all_of([F.col(c) == v if c in exact else F.col(c).cast("string").startswith(spelled(v)) for c, v in values.items()]))


def by_release(df: DataFrame, release: int | None, changes: list[str] | None = None, release_column: str = "release", change: str = "change_type", deleted: str = "deleted") -> tuple[DataFrame, Column]:
    """Rows of a release and its change types, and a count of deleted rows; without a release, deleted rows go."""
    count = F.count_if(F.col(change) == deleted)
    if release is None:
        return df.filter(~F.col(change).eqNullSafe(F.lit(deleted))), count
    out = df.filter(F.col(release_column) == release)
    return (out.filter(F.col(change).isin(changes)) if changes else out), count


def all_terms(df: DataFrame, terms: str, columns: list[str]) -> DataFrame:
    """Rows in which every word of ``terms`` occurs in some column, case ignored."""
    return df.filter(T.all_of([T.any_of([F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w.lower()) for c in columns]) for w in terms.split()]))


def mask(df: DataFrame, hide: Column, columns: list[str], value: str | None = "") -> DataFrame:
    return df.withColumns({c: F.when(hide, F.lit(value)).otherwise(F.col(c)) for c in columns})


# -- free text -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class SearchColumns:
    """The roles that columns play in a search. Columns of the older assembly find rows, but count as synonyms do."""

    gene: str
    transcript: str
    cdna: str
    protein: str
    protein_short: str
    synonyms: str
    registry: str
    digest: str
    accessions: tuple[str, ...]
    designation: str  # the older nomenclature
    coordinates: str
    genomic: str  # full genomic names
    older_coordinates: str
    older_genomic: str
    also: tuple[str, ...] = ()  # searched by terms without a prefix only, as classifications are
    genes: tuple[str, ...] = ("brca1", "brca2")
    sequences: tuple[str, ...] = ("chr17:", "chr13:", "nc_000013.11:", "nc_000017.11:", "nc_000013.10:", "nc_000017.10:")


@dataclass(frozen=True)
class Term:
    kind: str
    prefix: str
    rest: str
    whole: str


def classify(term: str, cols: SearchColumns) -> Term:
    """What a search term is; the first that fits of registry id, digest, protein, gene, transcript, accession, any.

    Coordinates anywhere in the term may lack ``g.``; where a term has none, it is added behind the sequence's name.
    """
    t = term.lower().strip().replace("\x00", "")
    if t.startswith("ca"):
        return Term("registry", "", t, t)
    if t.startswith("ga4gh"):
        return Term("digest", "", t, t)
    for name in cols.sequences:
        if "g." not in t:
            t = t.replace(name, name + "g.")
    if re.match(r"np_[0-9]{6}.[0-9][: ]", t):
        return Term("protein", t[:11], T.open_protein(t[12:]), t)
    for g in cols.genes:
        if t.startswith((g + ":", g + " ")):
            return Term("gene", g, T.open_protein(t[len(g) + 1:]), t)
    if re.match(r"nm_[0-9]{6}.[0-9][: ]", t):
        return Term("transcript", t[:11], t[12:], t)
    if t.startswith("scv") and len(t) >= 12:
        return Term("accession", "", t, t)
    return Term("any", "", t, t)


def predicates(term: Term, c: SearchColumns) -> tuple[Column, Column]:
    """Which rows match, and which of them count as found without synonyms (all cases ignored; nulls match nothing)."""
    has = lambda name, s: F.coalesce(F.lower(F.col(name)).contains(s), F.lit(False))
    begins = lambda name, s: F.coalesce(F.lower(F.col(name)).startswith(s), F.lit(False))
    s, whole = term.rest, term.whole
    listed = has(c.synonyms, "," + s) | begins(c.synonyms, s)
    if term.kind in ("registry", "digest"):
        hit = has(c.registry if term.kind == "registry" else c.digest, s)
        return hit, hit
    if term.kind == "accession":
        hit = T.any_of([has(a, s) for a in c.accessions])
        return hit, hit
    if term.kind == "protein":
        named = begins(c.protein, term.prefix) & (begins(c.protein_short, s) | has(c.protein, s) | listed)
        hit = named | has(c.protein, whole) | has(c.synonyms, whole)
        return hit, (hit & begins(c.protein_short, s)) | has(c.protein, whole)
    if term.kind in ("gene", "transcript"):
        own = F.coalesce(F.lower(F.col(c.gene if term.kind == "gene" else c.transcript)) == term.prefix, F.lit(False))
        shown = has(c.cdna, s) | T.any_of([begins(x, s) for x in (c.coordinates, c.genomic, c.designation)])
        if term.kind == "gene":
            shown = shown | has(c.protein, s) | begins(c.protein_short, s)
            listed = listed | has(c.synonyms, ":" + s)
        older = begins(c.older_coordinates, s) | begins(c.older_genomic, s)
        hit = (own & (shown | older | listed)) | has(c.synonyms, whole)
        return hit, hit & shown
    shown = T.any_of([has(x, s) for x in (*c.also, c.coordinates, c.gene, c.cdna, c.designation, c.protein, c.protein_short)]) | begins(c.genomic, s)
    return shown | has(c.older_coordinates, s) | begins(c.older_genomic, s) | has(c.synonyms, s), shown


def search(df: DataFrame, term: str, cols: SearchColumns) -> tuple[DataFrame, DataFrame]:
    """Matching rows, and one row with ``count`` and ``synonyms_count`` (hits that only a synonym or the older assembly
    explains)."""
    hit, shown = predicates(classify(term, cols), cols)
    found = df.filter(hit)
    return found, df.agg(F.count_if(hit).alias("count"), (F.count_if(hit) - F.count_if(hit & shown)).alias("synonyms_count"))


def trim_term(term: str, most: int = 200) -> str:
    """A term cut at its last colon while it is longer than ``most``."""
    while len(term) > most and ":" in term:
        term = term.rsplit(":", 1)[0]
    return term[:most]


# -- order, pages, completion --------------------------------------------------------------------------------------

def ordered(df: DataFrame, by: str, descending: bool, redirect: dict[str, str], tie: list[str]) -> DataFrame:
    """Sorted with names of changes redirected to coordinates; NULLs last ascending, first descending."""
    c = F.col(redirect.get(by, by))
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), *tie)


def page(df: DataFrame, size: int, number: int) -> DataFrame:
    """A page of a sorted frame; size 0 is everything."""
    return df.offset(size * number).limit(size) if size else df


def words(df: DataFrame, columns: list[str], keep: list[str] = (), longest: int = 300) -> DataFrame:
    """The different words in the columns, in lower case, cut at white space, bars and quotes."""
    text = F.lower(F.concat_ws(" ", *columns))
    return df.select(*keep, F.explode(F.split(text, "[\\s|'\"]+")).alias("word")).filter("word <> ''").withColumn("word", F.left("word", F.lit(longest))).distinct()


def complete(vocabulary: DataFrame, prefix: str, limit: int, least: int = 3, release: int | None = None) -> DataFrame:
    """The first words that begin with the prefix. Where words have a ``release``, those of the given one count, or
    of the newest."""
    if release is not None:
        vocabulary = vocabulary.filter(F.col("release") == release)
    elif "release" in vocabulary.columns:
        vocabulary = vocabulary.join(F.broadcast(vocabulary.agg(F.max("release").alias("release"))), "release")
    return vocabulary.filter(F.col("word").startswith(prefix.lower()) & (F.length("word") >= least)).select("word").distinct().orderBy("word").limit(limit)
