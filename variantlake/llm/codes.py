"""Product codes of vectors: codebooks fitted over Hilbert-sorted flat blocks whose boxes rule out most entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, give_back, join_split
from .vectors import common_size

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256.0
LIMIT = 1 << 26  # components are held within this after scaling, so that squares and their sums stay exact in 64 bits
BLOCK_ROWS = 64  # points of a flat block
CHUNK_BYTES = 8 << 20  # integers that one task sorts together
KERNEL = 1 << 21  # products formed at once


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Positions along a Hilbert curve through the box of the points (n, w); the first 60 dimensions, one bit or more each."""
    x = points[:, :60]
    n, w = x.shape
    bits = max(1, min(16, 60 // w))
    low = x.min(0)
    span = np.maximum(x.max(0) - low, 1)
    x = ((x - low) * ((1 << bits) - 1) // span).astype(np.int64)
    m = 1 << bits - 1
    q = m
    while q > 1:  # undo the curve's reflections and exchanges, from the coarsest bit on
        p = q - 1
        for i in range(w):
            flip = (x[:, i] & q) > 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(flip, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(flip, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, w):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = m
    while q > 1:
        t = np.where(x[:, w - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(w):
            key = key << 1 | x[:, i] >> bit & 1
    return key


def blocks(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points (n, w) along the curve, and where each block begins in it."""
    return np.argsort(hilbert_keys(points), kind="stable"), np.arange(0, len(points), BLOCK_ROWS)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries): which entries can be nearest, ties included, to some point of a block.

    An entry is out when its distance to the box is above the smallest distance within which some entry, the leader, has
    the whole box, or when all the box is nearer to the leader: the difference of the squared distances to both is
    linear along each axis, so its least value over a box is a sum over the nearer corners.
    """
    out = np.empty((len(low), len(entries)), bool)
    step = max(1, KERNEL // max(1, entries.size))
    for a in range(0, len(low), step):
        down, up = low[a:a + step, None, :] - entries, high[a:a + step, None, :] - entries
        gap, far = np.maximum(np.maximum(down, -up), 0), np.maximum(-down, up)
        near, far = (gap * gap).sum(2), (far * far).sum(2)
        lead = far.argmin(1)
        rows = np.arange(len(lead))
        below, above = down * down, up * up
        lead_below, lead_above = below[rows, lead][:, None, :], above[rows, lead][:, None, :]
        least = np.minimum(below - lead_below, above - lead_above).sum(2)
        out[a:a + step] = (near <= far[rows, lead][:, None]) & (least <= 0)
    return out


def assign(points: np.ndarray, starts: np.ndarray, allowed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, ties to the lower one, and squared distance of each point; blocks with equally long lists go together."""
    n = len(points)
    best, error = np.empty(n, np.int64), np.empty(n, np.int64)
    ends = np.append(starts[1:], n)
    size = allowed.sum(1)
    lists = np.argsort(~allowed, axis=1, kind="stable")  # allowed entries first, ascending
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        step = max(1, KERNEL // (BLOCK_ROWS * int(s) * points.shape[1]))
        for a in range(0, len(at), step):
            some = at[a:a + step]
            rows = starts[some][:, None] + np.arange(BLOCK_ROWS)
            inside = rows < ends[some][:, None]
            few = lists[some, :s]
            d = points[np.minimum(rows, n - 1)][:, :, None, :] - entries[few][:, None, :, :]
            d = (d * d).sum(3)
            i = d.argmin(2)
            best[rows[inside]] = np.take_along_axis(few, i, 1)[inside]
            error[rows[inside]] = np.take_along_axis(d, i[:, :, None], 2)[:, :, 0][inside]
    return best, error


def _integers(values: pa.Array, width: int) -> np.ndarray:
    """The vectors as integers floor(SCALE * x), padded with zeros to PARTS equal parts: (n, parts, width of a part)."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)
    each = -(-width // PARTS)
    return np.pad(x, ((0, 0), (0, each * PARTS - width))).reshape(len(x), PARTS, each)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(BLOCK_ROWS, CHUNK_BYTES // (8 * width))
    for b in batches:
        for a in range(0, len(b), rows):
            part = b.slice(a, rows)
            yield part, _integers(part.column(column), width)


BLOCKS = "part int, n int, points binary, low binary, high binary, sums binary"


def flat_blocks(vectors: DataFrame, width: int) -> DataFrame:
    """One row per block and part: its points in the curve's order, the corners of their box, and their sums."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _chunks(batches, 0, width):
            for p in range(PARTS):
                order, starts = blocks(x[:, p])
                s = x[order, p]
                low, high, sums = (f.reduceat(s, starts, axis=0) for f in (np.minimum, np.maximum, np.add))
                size = np.diff(np.append(starts, len(s)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(starts), p, np.int32)), pa.array(size.astype(np.int32)),
                    pa.array([s[a:a + BLOCK_ROWS].astype(np.int32).tobytes() for a in starts], pa.binary()),
                    *[pa.array([row.tobytes() for row in t], pa.binary()) for t in (low, high, sums)],
                ], names=["part", "n", "points", "low", "high", "sums"])
        give_back()

    return vectors.mapInArrow(build, BLOCKS)


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64).reshape(-1, width)


def moved(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floored means of the points nearest to them, unused ones stay.

    A block whose list has one entry gives it the stored sums; only the others' points are looked at. Tasks send one row
    per part, entry and component at most, so the driver gets as many numbers as the codebooks have.
    """
    parts, k, each = books.shape
    shared = stored.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, each), object), np.zeros((parts, k), np.int64)
        for b in batches:
            part = b.column(0).to_numpy()
            for p in np.unique(part):
                mine = b.filter(pa.array(part == p))
                entries = shared.value[p]
                n = mine.column(1).to_numpy().astype(np.int64)
                low, high = _rows(mine.column(3), np.int64, each), _rows(mine.column(4), np.int64, each)
                allowed = shortlists(low, high, entries)
                single = allowed.sum(1) == 1
                got = np.zeros((k, each), np.int64)
                whole = allowed.argmax(1)[single]
                np.add.at(got, whole, _rows(mine.column(5), np.int64, each)[single])
                counts[p] += np.bincount(whole, n[single], k).astype(np.int64)
                open_ = np.flatnonzero(~single)
                if len(open_):
                    points = _rows(mine.column(2).take(pa.array(open_)), np.int32, each)
                    starts = np.cumsum(n[open_]) - n[open_]
                    best, _ = assign(points, starts, allowed[open_], entries)
                    np.add.at(got, best, points)
                    counts[p] += np.bincount(best, minlength=k)
                sums[p] += got
        p, e = np.nonzero(counts)
        rows = [(int(a), int(c), i, Decimal(int(sums[a, c, i])), int(counts[a, c])) for a, c in zip(p, e) for i in range(each)]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()))], names=["part", "entry", "i", "total", "n"])

    out = books.copy()
    added = stored.mapInArrow(add, "part int, entry int, i int, total decimal(38,0), n long")
    for r in added.groupBy("part", "entry", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"], r["entry"], r["i"]] = int(r["total"]) // r["n"]
    return out


def first_books(vectors: DataFrame, key: str, vector: str, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest keys, ascending; null keys last, equal keys by their vectors."""
    first = vectors.orderBy(F.asc_nulls_last(key), vector).limit(entries).select(F.col(vector).cast("array<double>")).collect()
    x = _integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def encode(vectors: DataFrame, books: np.ndarray, vector: str, width: int) -> DataFrame:
    """Adds code (two hex digits a part) and error (squared distances summed) to the rows; nothing is shuffled."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("struct<code:string,error:long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            codes, errors = [], []
            for part, x in _chunks([pa.RecordBatch.from_arrays([values], names=["v"])], 0, width):
                code, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p in range(PARTS):
                    order, starts = blocks(x[:, p])
                    s = x[order, p]
                    low, high = np.minimum.reduceat(s, starts, axis=0), np.maximum.reduceat(s, starts, axis=0)
                    best, d = assign(s, starts, shortlists(low, high, shared.value[p]), shared.value[p])
                    code[order, p] = best
                    error[order] += d
                text = code.tobytes().hex()
                codes += [text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                errors.append(error)
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(error)], ["code", "error"])
        give_back()

    return vectors.withColumn("_c", of(F.col(vector))).withColumns({"code": F.col("_c.code"), "error": F.col("_c.error")}).drop("_c")


def compress(df: DataFrame, work: Workspace, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """key, label, code, error, label_error and codebooks_sha256 of every usable vector.

    Vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not the
    most frequent one (the shorter of equally frequent ones), as one codebook fits one length; empty vectors have no
    code. Lengths that 16 doesn't divide are padded with zeros. Scaled components beyond 2**26 count as that. Equal
    vectors get equal codes; repeated keys stay as rows. With fewer than 64 vectors there are as many entries. Other
    columns are left aside. An empty table gives no rows.
    """
    df = df.select(F.col(key), F.col(vector), F.col(label))
    odd_free = df.filter(F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
    width = common_size(odd_free, vector)
    if not width:
        return df.filter(F.lit(False)).select(key, label, F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    vectors = odd_free.filter(F.size(vector) == width)
    books = first_books(vectors, key, vector, width)
    stored = work.keep(flat_blocks(vectors.select(vector), width), "blocks")
    for _ in range(rounds):
        books = moved(stored, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = work.keep(encode(vectors, books, vector, width).select(key, label, "code", "error"), "coded")
    work.drop("blocks")
    same = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")))
    sums = same.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return join_split(same, sums, "_label", "code", work).select(key, label, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
