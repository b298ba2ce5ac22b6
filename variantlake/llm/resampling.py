"""Importance resampling towards a target distribution; hashed n-grams come from the checksums of prefixes."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, give_back, slices

BUCKETS = 10_000
LEAST_WORDS = 20  # documents with fewer words aren't drawn
SEED = "2024"
GROUP = 1 << 18  # words whose n-grams are hashed together

# Word bytes are digits, a-z and all of multi-byte characters; A-Z are lower-cased first.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
POLYNOMIAL = 0xEDB88320  # of the usual CRC-32, bits reversed


@lru_cache(1)
def _byte_table() -> np.ndarray:
    """What each byte value leaves after eight steps of the division."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


@lru_cache(64)
def _zeros(power: int) -> np.ndarray:
    """Tables (4, 256) that shift a checksum by 2**power zero bytes: a linear map over GF(2), byte by byte."""
    if power == 0:
        t = _byte_table()
        one = lambda c: c >> np.uint32(8) ^ t[c & np.uint32(255)]
    else:
        half = _zeros(power - 1)
        one = lambda c: _apply(half, _apply(half, c))
    return one(np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None])


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each checksum multiplied by x**(8 * length) modulo the polynomial: as if so many zero bytes followed."""
    out, power = crc.astype(np.uint32), 0
    while (lengths >> power).any():
        some = np.flatnonzero(lengths >> power & 1)
        out[some] = _apply(_zeros(power), out[some])
        power += 1
    return out


def prefixes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running checksums of the words joined by single spaces: before each word, after it, and the words' lengths."""
    after, crc = np.empty(len(words), np.uint32), 0
    for i, w in enumerate(words):
        crc = zlib.crc32(w, zlib.crc32(b" ", crc) if i else 0)
        after[i] = crc
    before = np.zeros(len(words), np.uint32)
    c = ~after[:-1]
    before[1:] = ~(c >> np.uint32(8) ^ _byte_table()[(c ^ np.uint32(32)) & np.uint32(255)])
    return before, after, np.fromiter(map(len, words), np.int64, len(words))


def gram_crcs(words: list[bytes], low: int, high: int) -> Iterator[np.ndarray]:
    """For each n from low to high, the checksums of all runs of n words joined by single spaces, in order.

    crc(prefix + gram) = shift(crc(prefix), len(gram)) ^ crc(gram), so two prefixes give every gram's checksum and no
    byte is read twice.
    """
    before, after, size = prefixes(words)
    ends = np.cumsum(size + 1) - 1
    for n in range(low, high + 1):
        k = len(words) - n + 1
        if k > 0:
            yield after[n - 1:] ^ shift(before[:k], ends[n - 1:] - (ends[:k] - size[:k]))


class _Texts:
    """The features of texts; a text of more than GROUP words is hashed in portions that share the words which grams
    across a cut need."""

    def __init__(self, low: int, high: int, buckets: int):
        self.low, self.high, self.buckets = low, high, buckets

    def of(self, text: str | None) -> tuple[int, Iterator[np.ndarray]]:
        """The number of words, and the buckets of all features in portions."""
        words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
        return len(words), self._portions(words)

    def _portions(self, words: list[bytes]) -> Iterator[np.ndarray]:
        for start in range(0, len(words), GROUP):
            for n in range(self.low, self.high + 1):
                for crc in gram_crcs(words[start:start + GROUP + n - 1], n, n):
                    yield (crc % np.uint32(self.buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall into each bucket. Each task sums its own; ``buckets`` rows reach the driver."""
    texts = _Texts(*grams, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in slices(b.column(0)):
                for portion in texts.of(t)[1]:
                    total += np.bincount(portion, minlength=buckets)
        some = np.flatnonzero(total)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1)(S+b) / ((s+1)(T+b)))) by bucket, for b buckets: thousandths of a nat a feature speaks for the target."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel_scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", grams: tuple[int, int] = (1, 1), seed: str = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score; the score is the weight plus Gumbel noise from the key's digest.

    weight is the floored mean gain of a document's features, 0 without any. Null keys count as the empty text.
    """
    texts, table = _Texts(*grams, len(gain)), docs.sparkSession.sparkContext.broadcast(gain)
    kind = pa.struct([(n, pa.int64()) for n in ("n_words", "n_features", "weight", "score")])

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long,score:long>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, values in batches:
            rows = []
            for k, t in zip(keys.to_pylist(), slices(values)):
                n_words, portions = texts.of(t)
                n = total = 0
                for p in portions:
                    n, total = n + len(p), total + int(table.value[p].sum())
                weight = total // n if n else 0
                h = int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
                rows.append((n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))
        give_back()

    key_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = docs.withColumn("_s", score(key_text, F.col(text)))
    return found.select(*[c for c in docs.columns if c not in kind.names], *[F.col(f"_s.{n}").alias(n) for n in kind.names])


def draw(scored: DataFrame, share: tuple[int, int], work: Workspace, key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3... over the floor(share * N) best scores among the N rows with enough words, else null.

    Ties go to the smaller key (null last), then to fewer features. Scores are whole numbers within a range that the
    arithmetic bounds (about 1e5 different ones), so their counts reach the driver; rows are ordered only among equal
    scores, and only those drawn. No task orders the table.
    """
    kept = work.keep(scored, "scored")
    allowed = F.col("n_words") >= least_words
    sizes = sorted(((r["score"], r["count"]) for r in kept.filter(allowed).groupBy("score").count().collect()), reverse=True)
    take = share[0] * sum(n for _, n in sizes) // share[1]
    above, before = [], 0
    for s, n in sizes:
        if before >= take:
            break
        above.append((s, before))
        before += n
    if not above:
        return kept.withColumn("rank", F.lit(None).cast("long"))
    in_range = allowed & (F.col("score") >= above[-1][0])
    heads = kept.sparkSession.createDataFrame(above, "score long, _above long")
    order = W.partitionBy("score").orderBy(F.asc_nulls_last(key), "n_features", "n_words")
    best = kept.filter(in_range).join(F.broadcast(heads), "score").withColumn("rank", F.col("_above") + F.row_number().over(order))
    best = best.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).drop("_above")
    return best.select(*kept.columns, "rank").unionByName(kept.filter(~in_range).withColumn("rank", F.lit(None).cast("long")))


def rank_by_target(docs: DataFrame, target: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (10, 100), grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Scores every document by how much likelier its features are in ``target`` than in ``docs`` and ranks those drawn.

    Returns key, n_words, n_features, weight, score and rank (null: not drawn), one row per row of ``docs``. Null and
    empty texts have no features and weight 0; repeated rows score alike and are ranked one after the other; other
    columns are left aside, whatever their names. Empty tables give no rows, an empty target equal weights.
    """
    docs, target = docs.select(key, text), target.select(text)
    gain = gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, text, grams, buckets))
    scored = gumbel_scores(docs, gain, key, text, grams, seed).select(key, "n_words", "n_features", "weight", "score")
    return draw(scored, share, work, key)


def resample(docs: DataFrame, target: DataFrame, work: Workspace, text: str = "text", key: str = "doc_id", share: tuple[int, int] = (10, 100), grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs`` themselves, with all their columns: what a target-like corpus is made of.

    The text is not carried through the draw: rows meet their scores again by a number given to each row, so repeated
    keys don't multiply.
    """
    rows = work.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    slim = rows.select(F.col("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    gain = gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, text, grams, buckets))
    scored = gumbel_scores(slim, gain, "_key", "_text", grams, seed).drop("_text")
    best = draw(scored, share, work, "_key").filter("rank is not null").select("_row")
    return rows.join(best, "_row", "left_semi").drop("_row")
