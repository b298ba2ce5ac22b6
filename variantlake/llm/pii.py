"""Personal data in texts: fixed patterns as seeds, then bootstrapped contextual extraction."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, give_back, join_split, slices

KINDS = ("email", "ip", "card", "phone")  # fixed values, in the order in which spans are listed

# Fixed patterns. A match can't begin inside a run of digits that it could also begin before, hence the look-behind;
# possessive repeats then keep every search linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9]")
_GROUPS = re.compile(r"(?<![0-9])\(?[0-9]++(?:(?:\) |[ ./()-])[0-9]++)++")  # digit groups joined by one mark
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_EDGES = ".,;:!?()[]{}<>\"'|"

WINDOW = 80  # characters of context in which the words before and after are looked for
GROUP_DIGITS = (7, 19)  # digits that a candidate of several groups has: fewer say too little, more are tables
LONG = 100  # characters from which on an instance is known by its digest in the graph
MIN_SEEDS = 3  # different known instances that a pattern must have found
MIN_PATTERN = 0.7  # trust from which on a pattern counts
UNKNOWN = 0.25  # what an instance of no known kind counts against a pattern; one of another kind counts 1
MIN_INSTANCE = 0.8  # noisy-or of the patterns that found it
ITEM = "struct<kind:string,start:int,end:int,inst:string,patterns:array<string>>"
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Seed spans of one text, by kind as listed, then start; leftmost and non-overlapping within a kind."""
    spans = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _HINT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _words(s: str) -> list[str]:
    return [re.sub(r"[0-9]+", "9", w.strip(_EDGES).lower()) for w in s.split()]


def _candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches outside the base spans that may be identifiers: digit groups joined by single marks or blanks, and
    other tokens with four digits or an inner ``@``."""
    taken = sorted((s, e) for _, s, e in base)
    for begin, stop in zip([0, *itertools.accumulate((e for _, e in taken), max)], [*(s for s, _ in taken), len(text)]):
        groups = []
        for m in _GROUPS.finditer(text, begin, max(begin, stop)):
            if GROUP_DIGITS[0] <= sum(map(str.isdigit, m.group())) <= GROUP_DIGITS[1]:
                # Only whole tokens: nothing but blanks and punctuation may stand next to a group.
                before, after = text[m.start() - 1:m.start()], text[m.end():m.end() + 1]
                if not (before.isalnum() or after.isalnum() or before in ("@", "_") or after in ("@", "_")):
                    groups.append(m.span())
        yield from groups
        for a, b in zip([begin, *(e for _, e in groups)], [*(s for s, _ in groups), stop]):
            pos = a
            while pos < b and (m := _MARK.search(text, pos, b)):
                start = m.start()
                while start > pos and not text[start - 1].isspace():
                    start -= 1
                blank = _BLANK.search(text, m.start(), b)
                pos = blank.start() if blank else b
                token = text[start:pos]
                lead = len(token) - len(token.lstrip(_EDGES))
                token = token.strip(_EDGES)
                if len(token) >= 5 and (sum(c.isdigit() for c in token) >= 4 or "@" in token[1:-1]):
                    yield start + lead, start + lead + len(token)


def items(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """Known instances and candidates with their patterns: (kind or None, start, end, text, patterns).

    A pattern is what stands around an instance: the two or three words before it, or the word before and the one
    after. Digits in words are written as 9, so a pattern covers all words of one shape.
    """
    out = []
    for kind, s, e in [*base, *((None, s, e) for s, e in _candidates(text, base))]:
        # A word that touches the instance belongs to neither side's words.
        before = _words(text[max(0, s - WINDOW):s] + (" " if kind is None else ""))[-3:]
        after = _words(text[e:e + WINDOW])[:1]
        patterns = [" ".join(before[-n:]) + " _" for n in (2, 3) if len(before) >= n]
        if before and after:
            patterns.append(f"{before[-1]} _ {after[0]}")
        if patterns:
            inst = text[s:e] if e - s < LONG else hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()
            out.append((kind, s, e, inst, patterns))
    return out


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, _k (a hash of key and text), base spans, and items for the bootstrap."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, _k long, base {SPAN}, items array<{ITEM}>"
    span_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    item_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("inst", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for t in slices(b.column(2)):
                spans = base_spans(t) if t else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                more.append([{"kind": k, "start": s, "end": e, "inst": x, "patterns": p} for k, s, e, x, p in items(t, spans)] if t else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, span_t), pa.array(more, item_t)], names=[key, "_k", "base", "items"])
        give_back()

    return docs.select(key, F.xxhash64(key, text).alias("_k"), text).mapInArrow(scan, schema)


def _bootstrap(scanned: DataFrame, key: str, work: Workspace) -> DataFrame:
    """Spans that trusted patterns add: key, _k, kind, start, end.

    The graph joins patterns with the different instances they found. In each round a pattern's trust in a kind is
    the share of its instances known to be of that kind, given at least MIN_SEEDS of them; those of another kind count
    whole against it, unknown ones UNKNOWN, so a pattern may discover more than it knew. An unknown instance is accepted
    for a kind when the noisy-or of its trusted patterns reaches MIN_INSTANCE, and counts as known in the next round. The
    rounds end when one finds nothing new. Both sides are sums by key over distinct edges.
    """
    one = scanned.select(key, "_k", F.explode("items").alias("i")).select(key, "_k", "i.*")
    one = work.keep(one, "items")
    edges = work.keep(one.select("inst", F.explode("patterns").alias("pattern")).distinct(), "edges")
    known = work.keep(one.filter("kind is not null").select("inst", "kind").distinct(), "known-0")
    totals = work.keep(edges.groupBy("pattern").agg(F.count("*").alias("total")), "totals")
    before = known.count()
    for r in itertools.count(1):  # what is known only grows, so this ends
        told = join_split(edges, known, "inst", "pattern", work).groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        of_any = told.groupBy("pattern").agg(F.sum("n").alias("known"))
        against = F.col("known") + UNKNOWN * F.greatest(F.col("total") - F.col("known"), F.lit(0))
        trusted = told.filter(F.col("n") >= MIN_SEEDS).join(of_any, "pattern").join(totals, "pattern").withColumn("trust", F.col("n") / against)
        trusted = work.keep(trusted.filter(F.col("trust") >= MIN_PATTERN).select("pattern", "kind", "trust"), f"trusted-{r}")
        open_edges = edges.join(known.select("inst"), "inst", "left_anti")
        scores = (
            join_split(open_edges, trusted, "pattern", "inst", work)
            .groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score"))
            .filter(F.col("score") >= MIN_INSTANCE)
        )
        best = scores.groupBy("inst").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        known = work.keep(known.unionByName(best), f"known-{r}")
        work.drop(f"known-{r - 1}")
        after = known.count()
        if after == before:
            break
        before = after
    learned = known.groupBy("inst").agg(F.min("kind").alias("as"))
    found = one.filter("kind is null").drop("kind", "patterns")
    added = join_split(found, learned, "inst", "_k", work).select(key, "_k", F.col("as").alias("kind"), "start", "end").distinct()
    added = work.keep(added, "added")
    work.drop("items", "edges", "totals", f"known-{r}", *[f"trusted-{i}" for i in range(1, r + 1)])
    return added


def find_private(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, base and spans (both array of (kind, start, end), by kind as listed, then start) per document.

    ``base`` are the seed spans, ``spans`` those and what the bootstrap adds; offsets are code points of the whole
    text, end exclusive. Null text counts as empty and has no spans; a null key is a key like others; repeated rows get
    equal spans; an empty table gives no rows; other columns are not carried. Each document yields only its own
    identifier-like tokens to the graph, so a text of any length is scanned once, in linear time.
    """
    scanned = work.keep(_scan(docs, key, text), "scanned")
    added = _bootstrap(scanned, key, work)
    more = added.groupBy(key, "_k").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    m = more.select(F.col(key).alias("_key"), F.col("_k").alias("_k2"), "more")
    out = scanned.join(m, (F.col("_k") == F.col("_k2")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "base", _ordered(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def _ordered(spans):
    """Spans by kind as listed, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each private span of ``text`` replaced by its kind in brackets, overlapping spans by one mark.

    Other columns stay; null text stays null. Rules for nulls, repeats and empty tables as in find_private. The base
    spans are found again in the pass that rewrites, so only what the bootstrap added has to meet the texts.
    """
    scanned = work.keep(_scan(docs, key, text), "scanned")
    added = _bootstrap(scanned, key, work)
    work.drop("scanned")
    more = work.keep(added.groupBy(key, "_k").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more")), "more")
    m = more.select(F.col(key).alias("_key"), F.col("_k").alias("_k2"), "_more")

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, more: pa.Array) -> pa.Array:
        out = []
        for t, extra in zip(slices(texts), slices(more)):
            if t:
                spans = base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in extra or ()]
                if spans:
                    parts, at = [], 0
                    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            parts += [t[at:s], f"[{k.upper()}]"]
                        at = max(at, e)
                    t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    keyed = docs.withColumn("_k", F.xxhash64(key, text))
    met = keyed.join(m, (F.col("_k") == F.col("_k2")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn(text, rewrite(F.col(text), F.col("_more"))).drop("_k", "_k2", "_key", "_more")
