"""String expressions: alleles, coordinates, names of changes, lists in text, display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter and one-letter amino acid codes.
AMINO_ACIDS = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}


# -- emptiness at the edges ----------------------------------------------------------------------------------------

def blank_to_null(c: Column) -> Column:
    """NULL for the in-band marks of emptiness: empty text, ``-`` and ``None``, spaces around them ignored."""
    t = F.trim(c)
    return F.when(~t.isin("", "-", "None"), t)


def null_to_dash(c: Column) -> Column:
    return F.coalesce(c, F.lit("-"))


def clean_list(c: Column) -> Column:
    """An array of texts without blanks, trimmed, each value once, in order; NULL if nothing is left."""
    kept = F.array_distinct(F.filter(F.transform(c, blank_to_null), lambda x: x.isNotNull()))
    return F.when(F.size(kept) > 0, kept)


def split_list(c: Column, sep: str = ",") -> Column:
    """The clean list written in a delimited text."""
    return clean_list(F.split(c, "\\" + sep if sep in "|.*+?" else sep))


# -- alleles -------------------------------------------------------------------------------------------------------

def _common(ref: Column, alt: Column, side) -> Column:
    """Length of the longest common end of two alleles that leaves a base of each."""
    most = F.greatest(F.least(F.length(ref), F.length(alt)) - 1, F.lit(0))
    return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda k: side(ref, k) == side(alt, k)))


def trim_trailing(ref: Column, alt: Column) -> tuple[Column, Column]:
    """Both alleles without their common suffix, at least one base of each kept."""
    k = _common(ref, alt, lambda s, n: F.right(s, n))
    cut = lambda s: F.substring(s, F.lit(1), F.length(s) - k)
    return cut(ref), cut(alt)


def trim_leading(pos: Column, ref: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Both alleles without their common prefix, the position moved by its length."""
    k = _common(ref, alt, lambda s, n: F.left(s, n))
    cut = lambda s: F.substring(s, k + 1, F.length(s))
    return pos + k, cut(ref), cut(alt)


def add_leading_base(pos: Column, ref: Column, alt: Column, seq: Column, seq_start: Column) -> tuple[Column, Column, Column]:
    """A base of the reference put before an empty allele: the base at ``pos`` if REF is empty, that before if ALT is."""
    r, a = F.coalesce(blank_to_null(ref), F.lit("")), F.coalesce(blank_to_null(alt), F.lit(""))
    here = F.substring(seq, (pos - seq_start + 1).cast("int"), F.lit(1))
    before = F.substring(seq, (pos - seq_start).cast("int"), F.lit(1))
    no_ref, no_alt = r == "", (a == "") & (r != "")
    base = F.when(no_ref, here).when(no_alt, before).otherwise("")
    return F.when(no_alt, pos - 1).otherwise(pos), F.concat(base, r), F.concat(base, a)


def edited_sequence(seq: Column, seq_start: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The reference with ``ref`` at ``pos`` replaced by ``alt``."""
    at = (pos - seq_start).cast("int")
    return F.concat(F.substring(seq, F.lit(1), at), alt, F.substring(seq, at + F.length(ref) + 1, F.length(seq)))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def bases_only(c: Column) -> Column:
    return c.rlike("^[-ACTG]*$")


def sequence_only(c: Column) -> Column:
    return c.rlike("^[ACTGNRY]+$")


# -- coordinates and names -----------------------------------------------------------------------------------------

def coordinate(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """``chr13:g.100:A>T``."""
    return F.concat(F.lit("chr"), chrom.cast("string"), F.lit(":g."), pos.cast("string"), F.lit(":"), ref, F.lit(">"), alt)


def parse_coordinate(c: Column) -> dict[str, Column]:
    """chrom, pos, ref, alt of a coordinate with or without ``g.``; NULL where it isn't one."""
    pattern = "^chr([0-9XYM]+):(?:g\\.)?([0-9]+):?([A-Za-z-]*)>([A-Za-z-]*)(?:\\r\\n|[\\n\\r\\u0085\\u2028\\u2029])?\\z"
    found = F.regexp_replace(c, pattern, "$1:$2:$3:$4")  # matched once for all parts, none of which has a colon
    parts = F.when(found != c, F.split(found, ":"))
    return {"chrom": parts[0], "pos": parts[1].try_cast("long"), "ref": parts[2], "alt": parts[3]}


def _after_colon(c: Column) -> Column:
    """What follows the first colon; the whole where there is none."""
    return F.when(c.contains(":"), F.substr(c, F.instr(c, ":") + 1)).otherwise(c)


def accession_to_chromosome(c: Column) -> Column:
    """``NC_000013.11`` as ``chr13``: the digits without leading zeros."""
    digits = F.regexp_extract(c, "^NC_0*([1-9][0-9]*)", 1)
    return F.when(digits != "", F.concat(F.lit("chr"), digits))


def harmonise_key(c: Column) -> Column:
    """Coordinate keys of either writing in one: accessions as chromosomes, no colon between position and bases.

    Each step names its text once: Spark doesn't compile expressions that repeat what they are made of many times.
    """
    c = F.regexp_replace(c, "^([^:]*)\\z", "$1:$1")
    c = F.regexp_replace(c, "^NC_0*([1-9][0-9]*)[^:]*", "chr$1")
    return add_g(F.regexp_replace(c, "(^[^:]*:)|([0-9]):", "$1$2"))  # behind the first colon only


def add_g(c: Column) -> Column:
    """``chr13:100`` as ``chr13:g.100``; what already has it stays."""
    return F.regexp_replace(c, "^(?![\\s\\S]*:g\\.)([^:]*):", "$1:g.")


def unpack_change(c: Column) -> tuple[Column, Column]:
    """Sequence name and change of ``NM_1.2:c.3A>T``; also of ``NM_1.2.c.3A>T``, and of a change alone."""
    pattern = "^(.*?)[:.]([cgn]\\..*)$"
    has = c.contains(":")
    found = F.when(~has, F.regexp_extract(c, pattern, 2))  # not empty where it matches
    named = F.when(found != "", F.regexp_extract(c, pattern, 1)).otherwise(F.when(has, F.substring_index(c, ":", 1)))
    return named, F.when(found != "", found).otherwise(_after_colon(c))


def strip_protein_suffix(c: Column) -> Column:
    """A change without a trailing ``(p...)`` and without white space or characters beyond ASCII."""
    return F.regexp_replace(F.regexp_replace(c, "\\s*\\(p\\.[^)]*\\)\\s*$", ""), "[^\\x21-\\x7E]", "")


def is_old_nomenclature(c: Column) -> Column:
    """Whether a synonym is a designation of the older style: no sequence prefix, but digits with an edit or ``ins/del``."""
    return ~c.rlike("[:]|^[cgpn]\\.") & c.rlike("[0-9]") & c.rlike("(?i)(>|del|ins|dup|^[A-Z][0-9]+[A-Z]$)")


def preferred_change(name: Column, listed: Column, synonyms: Column, prefix: str = "NM_") -> Column:
    """The change to show: one in the record's name, else the listed one, else the first synonym on ``prefix``."""
    pattern = f"({prefix}[0-9]+\\.[0-9]+)(?:\\([^)]*\\))?(:c\\.[^ ]+)"
    in_name = F.when(name.rlike(pattern), F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)))
    return F.coalesce(in_name, blank_to_null(listed), F.get(F.filter(synonyms, lambda s: s.startswith(prefix)), F.lit(0)))


def protein_position(c: Column) -> Column:
    """The first whole number of a protein change."""
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def amino_acid_code(c: Column) -> Column:
    """``p.(Arg12Cys)`` as ``R12C``; ``Ter`` and ``*`` as ``*``; NULL for what isn't a substitution."""
    pattern = "([A-Z][a-z]{2})([0-9]+)([A-Z][a-z]{2}|\\*|=)"
    codes = F.create_map(*[F.lit(x) for pair in {**AMINO_ACIDS, "Ter": "*", "*": "*", "=": "="}.items() for x in pair])
    a, b = codes[F.regexp_extract(c, pattern, 1)], codes[F.regexp_extract(c, pattern, 3)]
    return F.when(c.rlike(pattern), F.concat(a, F.regexp_extract(c, pattern, 2), b))


def open_protein(term: str) -> str:
    """A protein search term with the opening parenthesis its stored form has; NUL characters go."""
    term = term.replace("\x00", "")
    return "p.(" + term[2:] if term.startswith("p.") and "(" not in term else term


# -- lists and display ---------------------------------------------------------------------------------------------

def split_outside_parentheses(c: Column) -> Column:
    """A comma list whose items may hold commas in parentheses."""
    return F.split(c, ",\\s*(?![^()]*\\))")


def union_lists(*lists: Column) -> Column:
    """All values of several arrays once, in order of value; NULL arrays add nothing."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(x, empty) for x in lists]))))


def merge_synonyms(old: Column, new: Column, shown: list[Column]) -> Column:
    """Old and new synonyms as a sorted comma list, without those shown in columns of their own."""
    known = F.filter(F.array(*shown), lambda x: x.isNotNull())
    return F.array_join(F.array_except(union_lists(split_list(old), split_list(new)), known), ",")


def source_urls(ids: Column, prefix: str) -> Column:
    """A comma list of addresses, one for each id of a comma list."""
    return F.array_join(F.transform(split_list(ids), lambda x: F.concat(F.lit(prefix), x)), ",")


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def vcf_value(c: Column) -> Column:
    """A value as a VCF INFO field can hold it: no semicolons at the ends, those inside and ``:`` as ``.``, spaces as ``_``."""
    return F.translate(F.regexp_replace(F.trim(c), "^;+|;+$", ""), ";: ", ".._")


def has_bad_parentheses(c: Column) -> Column:
    """Whether a name's parentheses don't pair: unequal numbers, or a closing one first. Any depth is counted."""
    marks = F.filter(F.split(c, ""), lambda x: x.isin("(", ")"))
    depth = F.aggregate(marks, F.lit(0), lambda d, x: F.when(d < 0, d).when(x == "(", d + 1).otherwise(d - 1))
    return depth != 0


def strip_parentheses(c: Column) -> Column:
    return F.translate(c, "()", "")


def display_field(c: Column) -> Column:
    """Underscores as spaces, and a comma list without blanks, separated by comma and space."""
    return F.array_join(F.filter(F.transform(F.split(F.translate(c, "_", " "), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-")), ", ")


def links(c: Column, prefix: str | None = None) -> Column:
    """Anchors for a comma list of addresses, or of ids after ``prefix``; the label follows the last ``/`` or ``=``."""
    def anchor(x: Column) -> Column:
        address = F.concat(F.lit(prefix), x) if prefix else x
        label = F.substring_index(F.substring_index(address, "/", -1), "=", -1)
        return F.concat(F.lit('<a href="'), address, F.lit('">'), label, F.lit("</a>"))

    return F.array_join(F.transform(split_list(c), anchor), ", ")


def class_colour(c: Column) -> Column:
    """A track colour by classification. Uncertain words come first, as they hold the other words."""
    low = F.lower(c)
    return (
        F.when(low.contains("uncertain") | low.contains("not yet") | c.isNull(), "100,100,100")
        .when(low.rlike("likely[ _]benign"), "60,150,60").when(low.contains("benign"), "0,120,0")
        .when(low.rlike("likely[ _]pathogenic"), "210,90,60").when(low.contains("pathogenic"), "190,0,0").otherwise("100,100,100")
    )


def short_authors(c: Column, most: int, ends: int = 1) -> Column:
    """A comma list of authors; above ``most`` the first ``most - ends``, an ellipsis and the last ``ends``."""
    all_ = F.transform(F.split(c, ","), lambda x: F.trim(x))
    cut = F.concat(F.slice(all_, 1, most - ends), F.array(F.lit("...")), F.slice(all_, F.size(all_) - ends + 1, F.lit(ends)))
    return F.array_join(F.when(F.size(all_) > most, cut).otherwise(all_), ", ")


def joint_symbol(symbols: list[str]) -> str:
    """One name for a family of symbols: the common stem with the different ends, else the names joined by ``_``."""
    names = sorted(set(symbols))
    stem = names[0] if names else ""
    for n in names:
        while not n.startswith(stem):
            stem = stem[:-1]
    ends = [n[len(stem):] for n in names]
    return stem + "".join(ends) if stem and all(e.isdigit() for e in ends) else "_".join(names)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
