"""Language-model scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, give_back, join_split, keep_freed

FOLD, HELD_OUT = 7, 2
TABLE = 2e-7  # share of all tokens from which on a word or n-gram is scored from a table in the task: 5e6 at most per depth
NO_VALUE = 2e-6  # share from which on the table also tells that an n-gram has no value
PACKED = 1 << 20  # rarer n-grams that a task packs together
BUCKET = 1 << 21  # training tokens for each bucket of them
MIN_CONTEXT = 5  # occurrences from which on a context can be a state
MIN_NEXT = 3  # occurrences from which on a state keeps the count of a next word
PASSES = ((1,), (2,), (3, 4, 5))  # depths of contexts, as they are counted together: the last is the tree's memory
ROUND = 0.5  # n-grams for each token that are counted at once at most; more are counted in rounds, by their hashes, which saves disk
PART = 0.25  # rarer n-grams for each token that are scored at once, about; documents are dealt by hashes of their keys, for the same reason
DIVERGE = 1.0  # nats by which a state must tell its own occurrences better than its suffix does: count times divergence
SMOOTH = 20.0  # weight, in observations, of the suffix's distribution in a state's
FLUSH = 1_000_000  # places counted together in a task
BYTES = 1 << 15  # bytes of text hashed together
FILTER = 1 << 27  # bits at most of a filter of hashes, which only saves rows


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
END, BEGIN = _P3, _P4  # in place of hashes: the token after the last word, and what stands before the first


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal to Spark's xxhash64(a, b); in place and in pieces that stay in a core's cache."""
    out = np.full(len(a), 42, np.uint64)
    x_, t_ = np.empty((2, min(len(a), 1 << 13)), np.uint64)
    for i in range(0, len(a), 1 << 13):
        h = out[i:i + (1 << 13)]
        x, t = x_[:len(h)], t_[:len(h)]
        for part in (a, b):
            np.multiply(part[i:i + (1 << 13)], _P2, out=x)
            _turn(x, 31, t)
            x *= _P1
            h += _P5 + np.uint64(8)
            h ^= x
            _turn(h, 27, t)
            h *= _P1
            h += _P4
            for n, p in ((33, _P2), (29, _P3), (32, None)):
                np.right_shift(h, np.uint64(n), out=t)
                h ^= t
                if p is not None:
                    h *= p
    return out


def _turn(x: np.ndarray, n: int, t: np.ndarray) -> None:
    np.right_shift(x, np.uint64(64 - n), out=t)
    x <<= np.uint64(n)
    x |= t


def _table(columns: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _powers(p: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [p] * BYTES, np.uint64))


_BYTE = _mix(np.arange(256, dtype=np.uint64), np.arange(256, dtype=np.uint64))  # a number of 64 bits for each byte
_BYTE[65:91] = _BYTE[97:123]  # A to Z in lower case
_POWER, _BACK = _powers(int(_P5)), _powers(pow(int(_P5), -1, 1 << 64))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words between the given places of the bytes, A to Z in lower case.

    Polynomials in _P5 over the bytes' numbers, modulo 2^64, then mixed: those of all words come from one running sum.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        if ends[i] - lo > BYTES:
            at = range(0, int(ends[i] - lo), BYTES)
            parts = (_BYTE[data[lo + k:min(lo + k + BYTES, ends[i])]] for k in at)
            out[i] = sum(int((x * _POWER[:len(x)]).sum()) * pow(int(_P5), k, 1 << 64) for k, x in zip(at, parts)) % (1 << 64)
            i += 1
            continue
        j = int(np.searchsorted(ends, lo + BYTES, "right"))
        x = np.zeros(ends[j - 1] - lo + 1, np.uint64)
        np.multiply(_BYTE.take(data[lo:ends[j - 1]], mode="wrap"), _POWER[:len(x) - 1], out=x[1:])
        np.cumsum(x, out=x)
        a = starts[i:j] - lo
        out[i:j] = (x[ends[i:j] - lo] - x[a]) * _BACK[a]
        i = j
    for n, p in ((32, _P2), (29, _P3), (32, None)):
        out ^= out >> np.uint64(n)
        if p is not None:
            out *= p
    return np.maximum(out, np.uint64(1), out=out)


def _words(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of BEGIN, the words and END of each text, a 0 before each text; and how many places each text takes.

    Words are what bytes.split() gives. A null text has none.
    """
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    texts = texts.fill_null(b"") if texts.null_count else texts
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
    at -= at[0]
    space = (data == 32) | (data - np.uint8(9) < 5)
    first, last, filled = ~space, ~space, at[1:] > at[:-1]
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    lo, hi = at[:-1][filled], at[1:][filled] - 1
    first[lo], last[hi] = ~space[lo], ~space[hi]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.diff(np.searchsorted(starts, at)) + 3
    stop = np.cumsum(sizes)
    out, word = np.zeros(stop[-1], np.uint64), np.ones(stop[-1], bool)
    for place, x in ((stop - sizes, 0), (stop - sizes + 1, BEGIN), (stop - 1, END)):
        out[place], word[place] = x, False
    out[word] = _hash_words(data, starts, ends)
    return out, sizes


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch a hundred rows at a time, with the hashes of the texts in a column."""
    for start in range(0, len(b), 100):
        part = b.slice(start, 100)
        yield part, *_words(part.column(column).cast(pa.binary()))


def _sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, the sorted keys, and where in them a new one begins.

    Numbers sort several times faster than places, so each key's last bits give way to its place, if that sorts them too.
    """
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    done = keys[order]
    if (done[1:] < done[:-1]).any():
        order = np.argsort(keys)
        done = keys[order]
    return order, done, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), done[1:] != done[:-1]]))


def _parts(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Bucket and columns, as bytes, for each bucket (the first bits of a hash) of sorted keys."""
    bounds = np.arange(1, buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length() if buckets > 1 else 0)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield i, *(x[a:b].tobytes() for x in columns)


def _by_context(keys: np.ndarray, contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by buckets, and in a bucket by contexts, so that equal ones stand together and compress; and keys in it."""
    bits = buckets.bit_length() - 1
    order, keys, _ = _sort(keys & ~np.uint64((1 << 64 - bits) - 1) | contexts >> np.uint64(bits))
    return order, keys


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])


def count_words(texts: DataFrame) -> DataFrame:
    """(g, n): hashes of all words and of the end, with their counts. Counted in the tasks, then summed in buckets of
    hashes that are packed, so no row is made for a word before it is summed."""
    buckets = 1 << (4 * texts.rdd.getNumPartitions()).bit_length()
    spec = [("bucket", pa.int32()), ("gs", pa.binary()), ("ns", pa.binary())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        held, size = [], 0

        def out():
            keys = np.sort(np.concatenate(held))
            held.clear()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.diff(np.append(first, len(keys))).astype(np.uint32)
            return _table(list(zip(*_parts(keys[first], buckets, keys[first], n))), spec)

        for b in batches:
            for _, g, _ in _batches(b, 0):
                held.append(g[(g != 0) & (g != BEGIN)])
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    size = 0
        if size:
            yield out()
        give_back()

    def merge(packed: pa.Table) -> pa.Table:
        order, keys, first = _sort(_column(packed, "gs", np.uint64))
        n = np.add.reduceat(_column(packed, "ns", np.uint32)[order].astype(np.int64), first)
        return pa.table({"g": keys[first].view(np.int64), "n": n})

    return texts.mapInArrow(count, "bucket int, gs binary, ns binary").groupBy("bucket").applyInArrow(merge, "g long, n long")


def _longer(g: np.ndarray) -> np.ndarray:
    """From hashes of the n words that end at each place (0 where there are fewer) those of n + 1 words."""
    out = np.zeros(len(g), np.uint64)
    at = np.flatnonzero((g[:-1] != 0) & (g[1:] != 0)) + 1
    out[at] = _mix(g[at - 1], g[at])
    return out


_BITS = (20, 26, 32)  # where in a hash the places of its bits in a word of the filter are read


def _filter(hashes: DataFrame) -> np.ndarray:
    """Three bits for each hash, all in one word of 64, of about 16 bits a hash and FILTER bits at most."""
    n = min(FILTER, 1 << (16 * hashes.count() + 64).bit_length()) // 64
    bit = [f"shiftleft(1L, cast(shiftrightunsigned(g, {64 - k}) & 63 as int))" for k in _BITS]
    words = hashes.groupBy((F.col("g").bitwiseAND(F.lit(n - 1))).alias("at")).agg(F.bit_or(F.expr(" | ".join(bit))).alias("bits")).toArrow()
    out = np.zeros(n, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    one, mask = np.uint64(1), np.zeros(len(g), np.uint64)
    for k in _BITS:
        mask |= one << ((g >> np.uint64(64 - k)) & np.uint64(63))
    return bits[(g & np.uint64(len(bits) - 1)).astype(np.int64)] & mask == mask


class _Lookup:
    """Places of hashes in a sorted array: hashes are even, so their first bits tell where to begin."""

    def __init__(self, keys: np.ndarray):
        k = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - k)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.start = np.searchsorted(keys, np.arange(1 << k, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its place, and whether it is there."""
        i = self.start[(g >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.keys[i] < g)
        while len(todo):
            i[todo] += 1
            todo = todo[self.keys[i[todo]] < g[todo]]
        return i, (self.keys[i] == g) & (i < len(self.keys) - 1)


def _count_level(texts: DataFrame, contexts, nexts, depths: tuple[int, ...], buckets: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(d, c, s, n): how often context c of d words stands before the last of the d words s, which are the context
    without its first word and the next one; from MIN_NEXT on. Of ``turns`` parts of the n-grams, dealt by hash, that of
    number ``turn``.

    The filters know n-grams as long as the first depth's contexts: of a context all of them have to pass ``contexts``,
    of s the last one ``nexts``. What tasks counted is packed by buckets of the hashes of both, where it is summed.
    """
    spec = [("d", pa.int32()), ("bucket", pa.int32()), ("cs", pa.binary()), ("ss", pa.binary()), ("ns", pa.binary())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        held, size = {d: [] for d in depths}, 0

        def out():
            for d, parts in held.items():
                c, s = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                order, keys, first = _sort(_mix(c, s))
                n = np.diff(np.append(first, len(keys))).astype(np.uint32)
                at = order[first]  # of equal ones any will do
                order, keys = _by_context(keys[first], c[at], buckets)
                at = at[order]
                rows = [(d, *x) for x in _parts(keys, buckets, c[at], s[at], n[order])]
                if rows:
                    yield _table(list(zip(*rows)), spec)

        for b in batches:
            for _, g, _ in _batches(b, 0):
                for _ in range(depths[0] - 1):
                    g = _longer(g)
                good, wanted = _passes(contexts.value, g), _passes(nexts.value, g)
                for d in depths:
                    if d > depths[0]:
                        g = _longer(g)
                        good[1:] &= good[:-1]
                    at = np.flatnonzero((g[:-1] != 0) & (g[1:] != 0) & good[:-1] & wanted[1:])
                    c, s = g[at], g[at + 1]
                    if turns > 1:
                        mine = (c ^ s) % np.uint64(turns) == turn
                        c, s = c[mine], s[mine]
                    held[d].append((c, s))
                    size += len(c)
                if size > FLUSH:
                    yield from out()
                    size = 0
        if size:
            yield from out()
        give_back()

    def merge(packed: pa.Table) -> pa.Table:
        c, s = _column(packed, "cs", np.uint64), _column(packed, "ss", np.uint64)
        order, _, first = _sort(_mix(c, s))
        n = np.add.reduceat(_column(packed, "ns", np.uint32)[order].astype(np.int64), first)
        at, n = order[first][n >= MIN_NEXT], n[n >= MIN_NEXT]
        return pa.table({"d": np.full(len(at), packed["d"][0].as_py(), np.int32), "c": c[at].view(np.int64), "s": s[at].view(np.int64), "n": n})

    return texts.mapInArrow(count, "d int, bucket int, cs binary, ss binary, ns binary").groupBy("d", "bucket").applyInArrow(merge, "d int, c long, s long, n long")


def _buckets(total: int) -> int:
    return 1 << (total // BUCKET).bit_length()


def _signed(g: np.uint64) -> int:
    return int(np.int64(g.astype(np.int64)))


def fit(texts: DataFrame, counts: DataFrame, total: int, distinct: int, work: Workspace) -> tuple[DataFrame, np.ndarray]:
    """Fits on all ``texts`` (one text column) given their word counts, with the sum and the number of those: (g, v, n) of all n-grams that
    have a value (and, with a value of 0, of those without one from NO_VALUE on, which would be hot), and a filter of all n-grams that were counted: what begins and what ends an n-gram with a value is in it.

    Every context of MIN_CONTEXT occurrences and no more words than the tree's memory is tested, and a next word is kept
    from MIN_NEXT on; both are counts, so the tree grows with the corpus. A context becomes a state if its occurrences
    times the divergence of its next-word distribution from that of the longest shorter state reach DIVERGE: by so much
    it tells what follows it better, in all, so a rare context must differ much and a frequent one little. The
    distribution is smoothed with that of the shorter state, and words not kept share the rest in proportion to it, so
    every state's distribution sums to one over all words.

    Words and n-grams are known by 64-bit hashes. ``v`` is what each occurrence of an n-gram adds to the log10 of its text: as a
    state, to the next word's score (its back-off), and as a state with a next word, to that word's score (what the
    state gives it beyond the back-off and the shorter state). So a text's score is a sum over its n-grams. Levels are
    joined as DataFrames; only filters of fixed size and the frequent n-grams pass through the driver. No n-gram meets
    more than a MIN_NEXTth of its occurrences in a join, so hot ones are known without counting the rows.
    """
    spark = texts.sparkSession
    level = counts.select("g", "n", ((F.col("n") + 1) / float(total + distinct + 1)).alias("p")).filter(F.col("n") >= MIN_NEXT)
    begin = counts.filter(F.col("g") == _signed(END)).select(F.lit(_signed(BEGIN)).alias("g"), "n")
    bare = lambda x: x.filter(F.col("n") >= NO_VALUE * total).select("g", F.lit(0.0).alias("v"), "n")
    values, kept, known = [bare(level)], [], [level.select("g"), begin.select("g")]
    for depths in PASSES:
        enough = level.filter(F.col("n") >= MIN_CONTEXT).select("g")
        filters = [spark.sparkContext.broadcast(_filter(x)) for x in (enough.unionByName(begin.select("g")) if depths[0] == 1 else enough, level)]
        counted, places = [], (level.filter(F.col("n") >= MIN_CONTEXT).agg(F.sum("n")).first()[0] or 0) * len(depths)
        rounds = max(1, int(np.ceil(places / (ROUND * max(1, total)))))
        for i in range(rounds):
            counted.append(work.keep(_count_level(texts, *filters, depths, _buckets(total), i, rounds), f"counted-{depths[0]}-{i}"))
            work.clean()
        for f in filters:
            f.destroy()
        counted = reduce(DataFrame.unionByName, counted)
        for depth in depths:
            below = level.select(F.col("g").alias("s"), F.col("p").alias("b"))
            own = level.select(F.col("g").alias("c"), F.col("n").alias("t"))
            own = own.unionByName(begin.select(F.col("g").alias("c"), F.col("n").alias("t"))) if depth == 1 else own
            most = own.select("c", (F.col("t") / MIN_NEXT).alias("n")), total // MIN_NEXT
            listed = counted.filter(F.col("d") == depth).drop("d")
            listed = work.keep(join_split(listed, below, "s", "c", work, most=(most[0].withColumnRenamed("c", "s"), most[1])), f"listed-{depth}")
            m = F.col("n") + SMOOTH * F.col("b")
            sums = listed.groupBy("c").agg(F.sum(m * F.log(m / F.col("b"))).alias("x"), F.sum(m).alias("m"), F.sum("b").alias("b"))
            sums = sums.join(own.filter(F.col("t") >= MIN_CONTEXT), "c")
            weight = F.col("t") + SMOOTH
            rest, rest_below = F.greatest(1 - F.col("m") / weight, F.lit(1e-9)), F.greatest(1 - F.col("b"), F.lit(1e-9))
            apart = (F.col("x") - F.log(weight) * F.col("m")) / weight + rest * F.log(rest / rest_below)
            states = work.keep(sums.filter(F.col("t") * apart >= DIVERGE).select("c", "t", F.log10(rest / rest_below).alias("backoff")), f"states-{depth}")
            p = F.coalesce(m / weight, F.col("b"))
            level = work.keep(join_split(listed, states, "c", "s", work, "left", most).select(
                F.xxhash64("c", "s").alias("g"), "n", p.alias("p"), (F.log10(p / F.col("b")) - F.col("backoff")).alias("v")
            ), f"level-{depth}")
            values += [bare(level.filter("v is null")), level.filter("v is not null").select("g", "v", "n"), states.select(F.col("c").alias("g"), F.col("backoff").alias("v"), F.col("t").alias("n"))]
            kept += [f"states-{depth}", f"level-{depth}"]
            known.append(level.select("g"))
            work.drop(f"listed-{depth}")
        work.drop(*(f"counted-{depths[0]}-{i}" for i in range(rounds)))
        work.clean()
    out = work.keep(reduce(DataFrame.unionByName, values).groupBy("g").agg(F.sum("v").alias("v"), F.max("n").alias("n")), "values")
    chain = _filter(reduce(DataFrame.unionByName, known))
    work.drop(*kept)
    work.clean()
    return out, chain


def _score_grams(g: np.ndarray, sizes: np.ndarray, table: _Lookup, adds: np.ndarray, bits: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (of ``sizes`` places) what its frequent n-grams add; the others that may have a value, and of which
    text each is.

    An n-gram is tried only where the two that it extends passed ``chain``.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    total, rest, of = np.zeros(len(sizes)), [], []
    ends = np.flatnonzero(g)
    for length in range(1, PASSES[-1][-1] + 2):
        h = g[ends]
        good = _passes(chain, h)
        ends, h = ends[good], h[good]
        good = _passes(bits, h)
        at, own = ends[good], h[good]
        i, hit = table.find(own)
        total += np.bincount(text[at[hit]], adds[i[hit]], len(sizes))
        rest.append(own[~hit])
        of.append(text[at[~hit]])
        both = np.flatnonzero(ends[1:] == ends[:-1] + 1) + 1
        longer = np.zeros(len(g), np.uint64)
        longer[ends[both]] = _mix(h[both - 1], h[both])
        g, ends = longer, ends[both]
    return total, np.concatenate(rest), np.concatenate(of)


def _pack(g: np.ndarray, what: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes with something of each, by bucket: the last bits of the hash. In a bucket they keep their order."""
    k = (g & np.uint64(buckets - 1)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(k, kind="stable")
    cuts = np.searchsorted(k[order], np.arange(buckets + 1))
    g, what = g[order], what[order]
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield i, g[cuts[i]:cuts[i + 1]], what[cuts[i]:cuts[i + 1]]


def _steps(rows: np.ndarray) -> bytes:
    """Rising row numbers below 2^16 as their differences, which compress well."""
    return np.diff(rows.astype(np.uint16), prepend=np.uint16(0)).tobytes()


def _rows(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.uint16).astype(np.int64)


def _pack_values(values: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gs, vs): the hashes g and their values v, packed by bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = [("bucket", pa.int32()), ("gs", pa.binary()), ("vs", pa.binary())]
        held, size = [], 0

        def out():
            g, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            rows = [(i, x.tobytes(), y.tobytes()) for i, x, y in _pack(g, v, buckets)]
            return _table(list(zip(*rows)), spec)

        for b in batches:
            if len(b):
                held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
                size += len(b)
            if size > PACKED:
                yield out()
                size = 0
        if held:
            yield out()

    return values.mapInArrow(pack, "bucket int, gs binary, vs binary")


def _sum_values(packed: DataFrame, values: DataFrame, buckets: int) -> DataFrame:
    """(row, states, hits): the sum of the values of each row's n-grams, and how many have one.

    ``packed`` has (bucket, batch, gs, at): hashes with the rows, from ``batch`` on, that they are in; ``values`` has (g, v)
    or is what _pack_values makes of those. Both sides meet by bucket, so no row is made for an n-gram; sums go back by batch.
    """

    def meet(texts: pa.Table, model: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(model):
            keys, v = (np.concatenate([np.frombuffer(x, t) for x in model[c].to_pylist()]) for c, t in (("gs", np.uint64), ("vs", float)))
            order = np.argsort(keys)
            table, v = _Lookup(keys[order]), v[order]
            for chunk in texts.to_batches():
                for batch, gs, at in zip(chunk.column("batch").to_pylist(), chunk.column("gs"), chunk.column("at")):
                    i, hit = table.find(np.frombuffer(gs.as_py(), np.uint64))
                    at = _rows(at.as_py())[hit]
                    if len(at):
                        sums, hits = np.bincount(at, v[i[hit]]), np.bincount(at)
                        there = np.flatnonzero(hits)
                        rows.append((batch, _steps(there), sums[there].tobytes(), hits[there].astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_table(list(zip(*rows)) or [[]] * 4, [("batch", pa.int64()), ("at", pa.binary()), ("sums", pa.binary()), ("hits", pa.binary())])])

    def add(met: pa.Table) -> pa.Table:
        total, hits = np.zeros(1 << 16), np.zeros(1 << 16, np.int64)
        for at, sums, n in zip(met["at"], met["sums"], met["hits"]):
            at = _rows(at.as_py())
            total[at] += np.frombuffer(sums.as_py(), float)
            hits[at] += np.frombuffer(n.as_py(), np.uint32)
        at = np.flatnonzero(hits)
        return pa.table({"row": pa.array(met["batch"][0].as_py() + at, pa.int64()), "states": pa.array(total[at]), "hits": pa.array(hits[at])})

    model = values if "gs" in values.columns else _pack_values(values, buckets)
    met = packed.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(meet, "batch long, at binary, sums binary, hits binary")
    return met.groupBy("batch").applyInArrow(add, "row long, states double, hits long")


def _score_parts(values: int, bits: np.ndarray, total: int) -> int:
    """In how many parts documents are scored: after the occurrences in training of the rarer n-grams that have a value,
    and those of others that pass the filter by chance."""
    chance = (np.bitwise_count(bits).sum() / (64 * len(bits))) ** len(_BITS) * (PASSES[-1][-1] + 1)
    return max(1, int(np.ceil((values / max(1, total) + chance) * FOLD / (FOLD - 1) / PART)))


def score_texts(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32 of the key is not HELD_OUT modulo FOLD and scores all whole texts.
    ``score`` is the tree's log10 probability of the text's tokens, ``base_score`` that of add-one word frequencies.
    Null text counts as empty: its one token is the end. A null key hashes as empty text; repeated rows are separate
    documents; an empty table gives no rows; without training documents every token has probability 1 / 1. Extra
    columns are ignored.

    Frequent words and n-grams are scored in the tasks from tables. Each other word or n-gram of a document meets its
    count or value packed in buckets of hashes, whose number follows the training tokens. None of those makes up more
    than TABLE or NO_VALUE of the training tokens. A word that training lacks and other texts repeat is packed with the
    rest of its bucket, 10 bytes for each time, and no filter keeps it back. The base score takes words by their hashes too: of
    1e8 distinct words 3e-4 pairs are expected to share one.
    """
    with work.freed():
        return _score_texts(docs, work, key, text)


def _score_texts(docs: DataFrame, work: Workspace, key: str, text: str) -> DataFrame:
    fold = crc_mod(key, FOLD)
    train = docs.filter(fold != HELD_OUT).select(F.col(text).alias("text"))
    counts = work.keep(count_words(train), "counts")
    work.clean()
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(totals[0] or 0), int(totals[1])
    values, chain = fit(train, counts, total, distinct, work)
    seen = counts.select("g", F.log10(F.col("n") + 1).alias("v"), "n")
    tables = []
    for known in (seen, values):
        frequent = known.filter(F.col("n") >= TABLE * total).select("g", "v").toArrow()  # at most 1 / TABLE rows per depth
        g, v = frequent["g"].to_numpy().view(np.uint64), frequent["v"].to_numpy()
        order = np.argsort(g)
        tables.append((g[order], v[order]))
    bits = _filter(values)
    places = sum(x.filter(F.col("n") < TABLE * total).agg(F.sum("n")).first()[0] or 0 for x in (values, seen))
    parts = _score_parts(places, bits, total)
    shared = docs.sparkSession.sparkContext.broadcast((*tables, bits, chain))
    work.clean()
    kind = docs.schema[key].dataType.simpleString()
    spec = f"row long, `{key}` {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, bucket int, batch long, gs binary, at binary"
    buckets, unseen = _buckets(total), -float(np.log10(total + distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        (words, logs), (keys, adds), bits, chain = shared.value
        words, table = _Lookup(words), _Lookup(keys)
        row = TaskContext.get().partitionId() << 33
        since, held, size = row, ([], []), 0

        def out(like: pa.RecordBatch):
            packs = []
            for sign, parts in zip((1, -1), held):
                g, at = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                packs += [(i if sign > 0 else -1 - i, since, x.tobytes(), _steps(y)) for i, x, y in _pack(g, at, buckets)]
            mine = _table(list(zip(*packs)) or [[]] * 4, [("bucket", pa.int32()), ("batch", pa.int64()), ("gs", pa.binary()), ("at", pa.binary())])
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(mine), f.type) for f in like.schema)][:7] + mine.columns, names=like.schema.names)

        for b in batches:
            for part, g, sizes in _batches(b, 2):
                of = np.repeat(np.arange(len(part)), sizes)
                own = (g != 0) & (g != BEGIN)
                word, in_ = g[own], of[own]
                i, hit = words.find(word)
                base = (sizes - 2) * unseen + np.bincount(in_[hit], logs[i[hit]], len(part))
                known = np.bincount(in_[hit], minlength=len(part))
                held[1].append((word[~hit], in_[~hit] + (row - since)))
                model, rest, of = _score_grams(g, sizes, table, adds, bits, chain)
                order = np.argsort(of, kind="stable")
                held[0].append((rest[order], of[order] + (row - since)))
                size += len(rest) + len(held[1][-1][0])
                rows = pa.array(range(row, row + len(part)), pa.int64())
                row += len(part)
                done = pa.RecordBatch.from_arrays(
                    [rows, part.column(0), part.column(1), *map(pa.array, (sizes - 2, known, base, base + model)), *(pa.nulls(len(part), x) for x in (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["row", key, "held_out", "n_tokens", "n_known", "base", "score", "bucket", "batch", "gs", "at"],
                )
                yield done
                if size > PACKED or row - since > 1 << 15:
                    yield out(done)
                    since, size = row, 0
        if held[0]:
            yield out(done)
        give_back()

    rarer = [work.keep(_pack_values(x.filter(F.col("n") < TABLE * total).select("g", "v"), buckets), f"rarer-{i}") for i, x in enumerate((values, seen))]
    work.drop("values", "counts")
    done = []
    for i in range(parts):
        part = docs.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i).select(key, (fold == HELD_OUT).alias("held_out"), F.col(text))
        scored = work.keep(part.mapInArrow(score, spec), f"scored-{i}")
        packed, scored = scored.filter("bucket is not null").select("bucket", "batch", "gs", "at"), scored.filter("bucket is null").drop("bucket", "batch", "gs", "at")
        deep = work.keep(_sum_values(packed.filter("bucket >= 0"), rarer[0], buckets).drop("hits"), f"deep-{i}")
        work.clean()
        rare = work.keep(_sum_values(packed.filter("bucket < 0").withColumn("bucket", -1 - F.col("bucket")), rarer[1], buckets).withColumnRenamed("states", "rest"), f"rare-{i}")
        more = F.coalesce("rest", F.lit(0.0))
        done.append(work.keep(scored.join(rare, "row", "left").join(deep, "row", "left").select(
            key, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more + F.coalesce("states", F.lit(0.0))).alias("score"),
        ), f"done-{i}"))
        work.drop(f"scored-{i}")
        work.clean()
    shared.destroy()
    return reduce(DataFrame.unionByName, done)
