"""Near-duplicate texts: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, give_back, join_split, slices
from .components import connected_components, local_components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
IDF = 0.1  # what the logarithm of (texts / document frequency) adds to a shingle's weight of 1
CELLS, CELL_PARTS, CELL_SALTS = 1 << 24, 256, 1024  # counters, parts of them, and most groups of tasks that are summed first
FEW = 1 << 22  # shingles up to which a task keeps a list of cells instead of all counters
STEPS = 8  # document frequencies are kept as whole steps of 1/STEPS in the logarithm
TABLE = 1 << 16
CACHE = 200_000
SMALL_GROUP = 48  # members up to which the pairs left open in a group are compared one by one
CHUNK = 128
BROADCAST_ROWS = 250_000  # digests, about 60 bytes each when broadcast: larger tables of them are joined by shuffle

_rng = np.random.default_rng(20240607)
_WEIGHTS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PICKS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.gamma(2, 1, TABLE).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2, 1, TABLE)).astype(np.float32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


class Shingler:
    """Hashes of a text's shingles: five words in lower case (A to Z), or the whole of a shorter text."""

    def __init__(self):
        self.hash = _Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        if len(h) > WORDS:
            n = len(h) - WORDS + 1
            s = h[:n] * _WEIGHTS[0]
            for i in range(1, WORDS):
                s = s + h[i:i + n] * _WEIGHTS[i]
        else:
            s = (h * _WEIGHTS[:len(h)]).sum(keepdims=True) if len(h) else h
        return _mix(s)


class Idf:
    """Shingle weights: term frequency times 1 + IDF * ln(texts / df), df being the number of different texts with it.

    The logarithm is taken at IDF strength, so that shingles that only one text has don't outweigh those that a large
    group of near copies shares. Frequencies come from a sketch: each shingle adds to the cell of its hash, once per
    text, and what other shingles add to a cell on average is taken off. So a frequency is off by the spread of that, a
    few at 1e8 shingles and never more than about 1 / CELLS of all shingles; equal shingles always weigh the same.
    """

    def __init__(self, texts: int, steps: np.ndarray):
        self.steps = steps  # by cell: ln(df) * STEPS, as a byte
        top = np.log(max(texts, 1))
        self.weight = (1 + IDF * np.maximum(top - np.arange(256) / STEPS, 0)).astype(np.float32)

    @staticmethod
    def from_counts(texts: int, counts: np.ndarray) -> Idf:
        return Idf(texts, _steps(counts, counts.sum() / len(counts)))

    def weigh(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different shingles, sorted, with term frequency times idf."""
        e, tf = np.unique(shingles, return_counts=True)
        return e, tf * self.weight[self.steps[_cell(e, len(self.steps))]]


def _cell(e: np.ndarray, cells: int) -> np.ndarray:
    return (e & np.uint64(cells - 1)).astype(np.int64)


def _steps(counts: np.ndarray, others: float) -> np.ndarray:
    return np.minimum(np.round(np.log(np.maximum(counts - others, 1)) * STEPS), 255).astype(np.uint8)


class Sampler:
    """Improved consistent weighted sampling.

    Sample k of a text is the shingle with the smallest a = c / (y e^r), y = e^(r (t - b)), t = floor(ln w / r + b);
    two texts share a sample with a probability equal to their weighted Jaccard similarity. Each (shingle, sample) has
    r, c and b of its own: 16 bits each of one hash, r and c by tables of values of their distribution.
    """

    def bands(self, e: np.ndarray, w: np.ndarray) -> np.ndarray:
        best = np.full(SAMPLES, np.inf, np.float32)
        pick, t_of = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
        k, logs = np.arange(SAMPLES), np.log(w).astype(np.float32)
        for s in range(0, len(e), 512):
            x = e[s:s + 512]
            bits = (x[:, None] * _PICKS).view(np.uint16).reshape(len(x), SAMPLES, 4)
            r = _R[bits[:, :, 3]]
            b = bits[:, :, 1] * np.float32(1 / TABLE)
            t = np.floor(logs[s:s + 512, None] / r + b)
            a = _LOG_C[bits[:, :, 2]] - r * (t - b + 1)
            at = a.argmin(0)
            low = a[at, k]
            better = low < best
            best = np.where(better, low, best)
            pick = np.where(better, x[at], pick)
            t_of = np.where(better, t[at, k], t_of)
        s = _mix(pick + t_of.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
        h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for r in range(ROWS):
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + s[:, r])
        return h.view(np.int64)


def _texts(b: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    return slices(b.column(column).cast(pa.binary()))


def fit_idf(texts: DataFrame, text: str = "text") -> Idf:
    """Document frequencies over ``texts``, which should all be different, from one pass.

    Tasks add to CELLS counters each, made when they have met more than FEW shingles; the counters are summed in Spark by
    parts, first within salted groups of tasks, and the driver gets one byte for each cell.
    """
    n_texts, n_cells, n_parts = texts.count(), CELLS, CELL_PARTS
    salts = min(CELL_SALTS, math.isqrt(texts.rdd.getNumPartitions()) + 1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, cells, held, size, most = Shingler(), None, [], 0, FEW
        for b in batches:
            for t in _texts(b, "text"):
                held.append(_cell(np.unique(shingle(t)), n_cells).astype(np.uint32))
                size += len(held[-1])
                if size > most:
                    cells, most = np.zeros(n_cells, np.uint32) if cells is None else cells, 500_000
                    for x in held:  # the cells of a text can repeat
                        np.add.at(cells, x, np.uint32(1))
                    held.clear()
                    size = 0
        last = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
        held.clear()
        salt, width = TaskContext.get().partitionId() % salts, n_cells // n_parts
        cuts = np.searchsorted(last, np.arange(n_parts + 1) * width)
        for i in range(n_parts):
            part = np.bincount(last[cuts[i]:cuts[i + 1]] - np.uint32(i * width), minlength=width)
            if cells is not None:
                part += cells[i * width:(i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([_pack(part)], pa.binary())], names=["part", "salt", "cells"])
        del cells, last
        shingle.hash.clear()
        give_back()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum((_unpack(c) for c in group["cells"]), np.zeros(n_cells // n_parts, np.uint64))
        return pd.DataFrame({"part": group["part"].iloc[:1], "salt": group["salt"].iloc[:1], "cells": [_pack(total)]})

    spec = "part int, salt int, cells binary"
    summed = texts.select(F.col(text).alias("text")).mapInArrow(sketch, spec).groupBy("part", "salt").applyInPandas(add, spec)
    counts, total = np.zeros((n_parts, n_cells // n_parts), np.float32), 0
    for r in summed.groupBy("part").applyInPandas(add, spec).toLocalIterator():  # CELL_PARTS rows of fixed size
        row = _unpack(r["cells"])
        counts[r["part"]] = row
        total += int(row.sum())
    return Idf(n_texts, _steps(counts.ravel(), total / n_cells))


def _pack(counts: np.ndarray) -> bytes:
    """Counters compressed in the smallest unsigned type that holds them; the first byte is its width."""
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.uint64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    e, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.zeros(len(e)), np.zeros(len(e))
    x[inverse[:len(a[0])]], y[inverse[len(a[0]):]] = a[1], b[1]
    most = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / most) if most else 0.0


def near_duplicate_classes(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and class_id, the smallest key of its class.

    Classes are the connected components of links; two documents link when their texts are equal or the weighted
    Jaccard similarity of their TF-IDF shingles is at least SIMILAR. Null text counts as empty; texts without words
    link only with texts that are equal. A null key can't be a class id unless its whole class has null keys. Repeated
    rows fall in one class. Keys need not be unique: each row's class is that of its own text, so rows that share a key
    can be in different classes. An empty table gives no rows; extra columns are ignored.

    Texts are known by their digests throughout; equal texts are one member and are never expanded. Members that share
    a band are candidates: in each band's group all meet the group's centre. Where a group still holds several classes
    then, members of different classes meet too, in small groups one by one, in large ones in blocks of bounded size,
    so no link between different texts is lost to the shortcut, and no group's pairs are ever written out.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    classes = _digest_classes(base, work)
    keyed = base.select("key", F.unhex(F.md5("text")).alias("digest"))
    return join_split(keyed, classes.select("digest", "class_id"), "digest", "key", work).select(F.col("key").alias(key), "class_id")


def _digest_classes(base: DataFrame, work: Workspace) -> DataFrame:
    """(digest, rep, class, class_id) of each different text of ``base``: its smallest key, the digest and the smallest
    key of its class."""
    spark = base.sparkSession
    digest = F.unhex(F.md5("text")).alias("digest")
    unique = work.keep(base.select("key", digest, "text").groupBy("digest").agg(F.min("key").alias("rep"), F.first("text").alias("text")), "unique")
    idf = spark.sparkContext.broadcast(fit_idf(unique))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sampler = Shingler(), Sampler()
        for b in batches:
            rows = []
            for t in _texts(b, "text"):
                e, w = idf.value.weigh(shingle(t))
                rows.append(sampler.bands(e, w) if len(e) else None)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(rows, pa.list_(pa.int64()))], names=["digest", "bands"])
        shingle.hash.clear()
        give_back()

    signed = work.keep(unique.select("digest", "text").mapInArrow(sign, "digest binary, bands array<long>"), "signed")
    entries = signed.select("digest", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    entries = work.keep(join_split(entries, sizes, "band", "digest", work), "entries")
    links = _verified_links(unique, entries, idf, work)
    reps = unique.select("digest", "rep")
    if links is None:
        out = reps.select("digest", "rep", F.col("digest").alias("class"), F.col("rep").alias("class_id"))
    else:
        comps = connected_components(links, work).withColumnRenamed("node", "digest")
        named = reps.join(comps, "digest", "left").withColumn("class", F.coalesce("component", "digest")).drop("component")
        low = named.join(comps.select("digest"), "digest", "left_semi").groupBy("class").agg(F.min("rep").alias("low"))
        out = join_split(named, low, "class", "digest", work, "left").select("digest", "rep", "class", F.coalesce("low", "rep").alias("class_id"))
    out = work.keep(out, "classes")
    idf.destroy()
    work.drop("unique", "signed", "entries", "ids", "texts", "pairs-0", "checked-0", "pairs-1", "checked-1", "open", "chunked", "meetings", "blocks")
    return out


def _verified_links(unique: DataFrame, entries: DataFrame, idf, work: Workspace) -> DataFrame | None:
    """(a, b) of members with similarity of SIMILAR or more that share a band: a set of links with the same components
    as all of them."""
    ids = work.keep(entries.select("digest").distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = work.keep(unique.select("digest", "text").join(few, "digest", "left_semi"), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, left = Shingler(), None, None
        for b in batches:
            hit = []
            for a, x, y in zip(b.column("a").to_pylist(), _texts(b, "text_a"), _texts(b, "text_b")):
                if a != last:
                    last, left = a, idf.value.weigh(shingle(x))
                hit.append(weighted_jaccard(left, idf.value.weigh(shingle(y))) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(hit, pa.bool_())], names=["a", "b", "linked"])
        shingle.hash.clear()
        give_back()

    def checked(pairs: DataFrame, n: int) -> DataFrame:
        pairs = work.keep(pairs.distinct(), f"pairs-{n}")
        met = join_split(pairs, texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b", "a", work)
        met = join_split(met, texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a", "b", work)
        return work.keep(met.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary, linked boolean"), f"checked-{n}")

    # Every member of a group meets its centre: the member whose groups are largest, which is the text that the others
    # were made from more often than not.
    weight = entries.groupBy("digest").agg(F.sum("n").alias("weight"))
    centre = entries.join(weight, "digest").groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("digest").alias("centre"))).alias("c")).select("band", "c.centre")
    meets = join_split(entries.select("band", "digest"), centre, "band", "digest", work).filter("digest <> centre")
    first = checked(meets.select(F.col("centre").alias("a"), F.col("digest").alias("b")), 0)
    if first.isEmpty():
        return None
    links = first.filter("linked").select("a", "b")
    comps = connected_components(links, work, name="cc-first")
    labelled = entries.filter("n > 2").join(comps, F.col("digest") == F.col("node"), "left").select("band", "n", "digest", F.coalesce("component", "digest").alias("class"))
    # Groups of one class, or of two members, which have met, are settled.
    still = labelled.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("band")
    label = work.keep(join_split(labelled, still, "band", "digest", work), "open")
    if label.isEmpty():
        return links
    small = label.filter(F.col("n") <= SMALL_GROUP)
    x, y = small.select("band", F.col("digest").alias("a"), F.col("class").alias("class_a")), small.select("band", F.col("digest").alias("b"), F.col("class").alias("class_b"))
    pairs = x.join(y, "band").filter("a < b and class_a <> class_b").select("a", "b")
    met = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(checked(pairs.join(met, ["a", "b"], "left_anti"), 1).filter("linked").select("a", "b"))
    large = label.filter(F.col("n") > SMALL_GROUP)
    return links if large.isEmpty() else links.unionByName(_links_in_blocks(large, texts, idf, work))


def _links_in_blocks(label: DataFrame, texts: DataFrame, idf, work: Workspace) -> DataFrame:
    """Links across the classes of large groups, whose members are cut into chunks and compared chunk by chunk.

    A class that holds many members of a group has chunks of its own, which don't meet each other; all other members
    are mixed. A meeting multiplies two small matrices of shingles and returns its local components, not its pairs.
    """
    sizes = label.groupBy("band", "class").agg(F.count("*").alias("m"))
    own = label.join(sizes, ["band", "class"]).withColumn("cls", F.when(F.col("m") >= CHUNK, F.col("class")).otherwise(F.lit(b"")))
    totals = own.groupBy("band", "cls").agg(F.ceil(F.count("*") / CHUNK).alias("k"))
    chunked = own.join(totals, ["band", "cls"]).select("band", "digest", "cls", F.pmod(F.xxhash64("digest"), F.col("k")).alias("chunk"))
    chunked = work.keep(chunked, "chunked")
    side = lambda s: totals.select("band", F.col("cls").alias(f"cls_{s}"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias(f"chunk_{s}"))
    order = (F.col("cls_a") < F.col("cls_b")) | ((F.col("cls_a") == b"") & (F.col("cls_b") == b"") & (F.col("chunk_a") <= F.col("chunk_b")))
    meetings = work.keep(side("a").join(side("b"), "band").filter(order), "meetings")
    group = ["band", "cls_a", "chunk_a", "cls_b", "chunk_b"]

    def members(s: str) -> DataFrame:
        named = chunked.withColumnsRenamed({"cls": f"cls_{s}", "chunk": f"chunk_{s}"})
        met = meetings.join(named, ["band", f"cls_{s}", f"chunk_{s}"])
        return met.join(texts, "digest").select(*group, "digest", "text")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        shingle = Shingler()
        one = g.drop_duplicates("digest").sort_values("digest").reset_index(drop=True)
        i, j = similar_pairs([idf.value.weigh(shingle(t.encode())) for t in one["text"]])
        keys = one["digest"].to_numpy()
        root = local_components(i, j, len(keys))  # the smallest digest stands for a local component
        linked = np.flatnonzero(root != np.arange(len(keys)))
        return pd.DataFrame({"a": keys[root[linked]], "b": keys[linked]})

    met = members("a").unionByName(members("b")).groupBy(*group).applyInPandas(compare, "a binary, b binary")
    return work.keep(met.distinct(), "blocks")


def similar_pairs(vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of weighted shingle vectors with a similarity of SIMILAR or more.

    The smaller weight of two is the largest level that both reach, so with the levels of a shingle as features of
    their own, sums of smaller weights are products of sparse matrices, taken in slices of features.
    """
    n = len(vectors)
    row = np.repeat(np.arange(n), [len(e) for e, _ in vectors])
    e, w = np.concatenate([e for e, _ in vectors]), np.concatenate([w for _, w in vectors])
    total = np.bincount(row, w, n)
    order = np.lexsort((w, e))
    e, w, row = e[order], w[order], row[order]
    new = np.concatenate([[True], e[1:] != e[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    level = new | np.concatenate([[True], w[1:] != w[:-1]])
    number = np.cumsum(level) - 1  # the feature (shingle, level) at which a row stands
    at = np.flatnonzero(level)
    rise = w[at] - np.where(new[at], 0.0, w[np.maximum(at - 1, 0)])
    first = number[start]
    # A row has all levels of its shingle up to its own.
    counts = number - first + 1
    cols = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.repeat(row, counts)
    used = np.bincount(cols, minlength=len(at)) > 1
    keep = used[cols]
    rename = np.cumsum(used) - 1
    rows, cols, rise = rows[keep], rename[cols[keep]], rise[used]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    inter = np.zeros((n, n))
    for s in range(0, len(rise), 4096):
        a, b = np.searchsorted(cols, (s, s + 4096))
        m = np.zeros((n, min(4096, len(rise) - s)))
        m[rows[a:b], cols[a:b] - s] = 1
        inter += (m * rise[s:s + 4096]) @ m.T
    union = total[:, None] + total[None, :] - inter
    i, j = np.nonzero(np.triu((inter >= SIMILAR * union - 1e-9) & (union > 0), 1))
    return i, j


def deduplicate(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest key. See near_duplicate_classes.

    Nulls come last, so a document with a null key stays only if its whole class has none. If two texts of a class
    share the smallest key, that with the smaller digest stays; of rows equal in key and text, one. Other columns stay.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    classes = _digest_classes(base, work)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("digest").alias("digest"))).alias("one")
    kept = classes.groupBy("class").agg(first).select(F.col("one.digest").alias("digest"), F.col("one.rep").alias("rep"), F.lit(True).alias("stays"))
    # What goes: rows whose digest isn't its class's, or whose key isn't the class's smallest.
    rows = work.keep(base.select("key", F.unhex(F.md5("text")).alias("digest")).groupBy("digest", "key").agg(F.count("*").alias("n")), "rows")
    told = join_split(rows, kept, "digest", "key", work, "left").withColumn("stays", F.coalesce("stays", F.lit(False)) & F.col("key").eqNullSafe(F.col("rep")))
    gone = work.keep(told.filter("not stays or n > 1").select(F.col("digest").alias("_digest"), F.col("key").alias("_key"), F.col("stays").alias("_stays")), "gone")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    named = docs.withColumn("_is", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    at = (F.col("_is") == F.col("_digest")) & F.col(key).cast("long").eqNullSafe(F.col("_key"))
    found = named.join(small, at, "left")
    once = named.join(F.broadcast(gone.filter("_stays")) if gone.filter("_stays").count() <= BROADCAST_ROWS else gone.filter("_stays"), at, "left_semi").dropDuplicates(["_is", key])
    return found.filter(F.col("_digest").isNull()).select(*docs.columns).unionByName(once.select(*docs.columns))
