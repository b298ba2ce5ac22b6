"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices

MARK = "▁"  # fixed value: how a space is written inside pieces
_OTHER = 1 << 21  # symbols from here on are single characters outside the vocabulary
_NONE = np.int64(1 << 40)
CACHE_BYTES = 24 << 20  # what the ids of words already met may take in a task
FLUSH, FLUSH_CHARS = 8192, 400_000  # words, and characters, that go through the rounds together
GROUP = 1_000_000
LONG_WORD = 256


class PieceModel:
    """A BPE vocabulary as arrays: symbols of characters, merge pairs with ranks, and the bytes of each piece.

    The size of a vocabulary is fixed, so the model is sent to the tasks as it is.
    """

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int], unknown: int, control: set[int]):
        self.pieces, self.unknown = pieces, unknown
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        chars = {c for p in ids for c in p}
        extra = sorted(c for c in chars if c not in ids)
        self.symbol = {c: ids.get(c) for c in chars if c in ids} | {c: len(pieces) + i for i, c in enumerate(extra)}
        text_of = lambda s: s in ids or s in self.symbol
        number = lambda s: ids[s] if s in ids else self.symbol[s]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = {p: order[scores[i]] for p, i in ids.items()}
        pairs = [(number(p[:k]) << 22 | number(p[k:]), rank[p], i, p[:k], p[k:]) for p, i in ids.items() if len(p) > 1 for k in range(1, len(p)) if text_of(p[:k]) and text_of(p[k:])]
        pairs.sort(key=lambda x: x[0])
        self.keys = np.array([x[0] for x in pairs] + [_NONE << 20], np.int64)
        self.ranks = np.array([x[1] for x in pairs] + [_NONE], np.int64)
        self.merged = np.array([x[2] for x in pairs] + [-1], np.int64)
        # Merging all leftmost pairs of a rank at once is what merging one by one gives unless a new symbol can take
        # part in a pair of a better or equal rank: ``before`` and ``after`` tell by how many characters what grows from
        # a piece of a rank that way can reach beyond the piece. Both are 0 for most ranks.
        self.before, self.after = np.zeros(len(order) + 1, np.int64), np.zeros(len(order) + 1, np.int64)
        self.single = np.bincount([rank[p] for p in ids if len(p) > 1], minlength=len(order) + 1) > 1
        for whole, r in rank.items():
            for i in range(len(whole)):
                for j in range(i + 2, len(whole) + 1):
                    at = rank.get(whole[i:j])
                    if at is not None and at >= r and j - i < len(whole):
                        self.single[at] = True
                        self.before[at], self.after[at] = max(self.before[at], i), max(self.after[at], len(whole) - j)
        self.longest = max(map(len, ids), default=1)
        self.bigrams = np.unique(np.array([ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])] or [-1], np.int64))
        self.by_code = np.full(0x110000, -1, np.int32)
        self.by_code[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        self.extra, self.byte_ids = extra, byte_ids
        self.newline_splits = not any("\n" in p and len(p) > 1 for p in ids)
        self.output = [b"" if i in control else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.output[unknown] = " ⁇ ".encode()
        for value, i in enumerate(byte_ids):
            self.output[i] = bytes([value])
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[byte_ids] = True

    @staticmethod
    def load(path: str) -> PieceModel:
        """Reads the vocabulary of a model file on the driver."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        normal = [not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i)) for i in range(n)]
        by_name = {x: i for i, x in enumerate(pieces)}
        byte_ids = [by_name[f"<0x{v:02X}>"] for v in range(256)] if p.is_byte(by_name.get("<0x00>", 0)) else []
        control = {i for i in range(n) if p.is_control(i)}
        return PieceModel(pieces, [p.get_score(i) for i in range(n)], normal, byte_ids, p.unk_id(), control)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes of 32-bit integers, by rounds over flat arrays of all words' symbols.

        A segment is a word, cut also where two characters stand together that no piece holds together. Short words
        go through rounds by segment, long ones through rounds by window, so neither grows with a word's length.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.by_code[points].astype(np.int64)
        sym = np.where(sym >= 0, sym, _OTHER + points)
        starts = np.zeros(len(sym) + 1, bool)
        starts[np.concatenate([[0], np.cumsum(lengths)])] = True
        starts = starts[:len(sym)]
        both = points[:-1] << 21 | points[1:]
        hit = np.searchsorted(self.bigrams, both)
        hit[hit == len(self.bigrams)] = 0
        starts[1:] |= self.bigrams[hit] != both
        rounds = self._by_window if len(words) and lengths.max() > LONG_WORD else self._by_segment
        flat, where = rounds(sym, np.cumsum(starts) - 1)
        odd = flat >= len(self.pieces)
        if odd.any():
            flat, where = self._spell(flat, where, odd)
        cuts = (np.searchsorted(where, np.cumsum(lengths)) * 4).tolist()
        data = flat.astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs and what they merge to."""
        key = left << 22 | right
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.ranks[i], _NONE), self.merged[i]

    def _by_segment(self, sym: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges and the places where they begin.

        A round finds the rank of every neighbouring pair and the smallest rank in each segment, merges the leftmost
        non-overlapping pairs of that rank in all segments at once (only the first, where the new symbol could take
        part in a better pair), and closes the gaps; segments without a pair that can merge leave.
        """
        n = len(sym)
        place = np.arange(n)  # where a symbol stood at first: sorts finished symbols back
        rank, merged = np.full(n, _NONE), np.full(n, -1)  # of the pair of a symbol and the next one
        fresh = np.flatnonzero(segment[:-1] == segment[1:])
        done_sym, done_place = [sym[:0]], [place[:0]]
        while n:
            rank[fresh], merged[fresh] = self._look_up(sym[fresh], sym[fresh + 1])
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, n))
            alive = np.repeat(least < _NONE, sizes)
            if not alive.all():
                done_sym.append(sym[~alive])
                done_place.append(place[~alive])
                if not alive.any():
                    break
            low = np.repeat(least, sizes)
            run = np.flatnonzero((rank == low) & alive)
            # Of pairs that overlap, every second one from the left merges.
            if len(run) > 1:
                begins = np.concatenate([[True], (run[1:] != run[:-1] + 1) | (segment[run[1:]] != segment[run[:-1]])])
                offset = np.arange(len(run)) - np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
                run = run[offset % 2 == 0]
            one = self.single[low[run]]
            if one.any():
                seg = segment[run]
                run = run[~one | np.concatenate([[True], seg[1:] != seg[:-1]])]
            sym[run] = merged[run]
            new = np.zeros(n, bool)
            new[run] = True
            stay = alive
            stay[run + 1] = False
            sym, place, segment, rank, merged, new = sym[stay], place[stay], segment[stay], rank[stay], merged[stay], new[stay]
            n = len(sym)
            # Only pairs with a merged symbol have to be looked up again.
            rank[new] = _NONE
            touched = new.copy()
            touched[:-1] |= new[1:]
            rank[touched] = _NONE
            fresh = np.flatnonzero(touched[:-1] & (segment[:-1] == segment[1:]))
        flat, where = np.concatenate(done_sym), np.concatenate(done_place)
        order = np.argsort(where, kind="stable")
        return flat[order], where[order]

    def _by_window(self, sym: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _by_segment, with the smallest rank taken in a window around each pair instead of the whole segment.

        No piece is longer than ``longest``, so a pair whose rank is the smallest among those of the ``longest`` symbols
        on either side can't be reached by what better pairs elsewhere grow to, and merges now, whatever happens there.
        Pairs of equal rank wait for those to their left that overlap them or from which something of a better or
        equal rank could grow as far as to them. Symbols far from any pair that can merge leave.
        """
        n, w = len(sym), self.longest
        place, size = np.arange(n), np.ones(n, np.int64)
        rank, merged = np.full(n, _NONE), np.full(n, -1)
        fresh = np.flatnonzero(segment[:-1] == segment[1:])
        done_sym, done_place = [], []
        while True:
            rank[fresh], merged[fresh] = self._look_up(sym[fresh], sym[fresh + 1])
            pairs = np.flatnonzero(rank < _NONE)
            if len(pairs) * 4 * w < n:
                near = np.zeros(n + 1, np.int64)
                np.add.at(near, np.maximum(pairs - w - 1, 0), 1)
                np.add.at(near, np.minimum(pairs + w + 3, n), -1)
                stay = np.cumsum(near[:-1]) > 0
                done_sym.append(sym[~stay])
                done_place.append(place[~stay])
                apart = np.concatenate([[False], ~stay[:-1]]) | np.concatenate([[True], segment[1:] != segment[:-1]])
                segment = np.cumsum(apart)[stay]
                sym, place, size, rank, merged = sym[stay], place[stay], size[stay], rank[stay], merged[stay]
                n, pairs = len(sym), np.flatnonzero(rank < _NONE)
            if not len(pairs):
                break
            low = _sliding_least(rank, w)
            order = np.argsort(rank[pairs].astype(np.uint16) if len(self.before) < 1 << 16 else rank[pairs], kind="stable")
            at = pairs[order]
            r, begin = rank[at], place[at]
            end = begin + size[at] + size[at + 1]
            same = np.concatenate([[False], r[1:] == r[:-1]])
            overlaps = same & np.concatenate([[False], (at[1:] == at[:-1] + 1)])
            linked = same & np.concatenate([[False], begin[1:] - end[:-1] < (self.before + self.after)[r[1:]]])
            count = np.arange(len(at))
            offset = count - np.maximum.accumulate(np.where(overlaps, 0, count))
            first = offset % 2 == 0  # of pairs that overlap, every second one from the left merges
            stop = first & (low[at] < r)
            sensitive = np.flatnonzero(first & self.single[r])
            if len(sensitive):
                stop[sensitive] |= self._grows_on(sym, segment, merged, at, r, first, sensitive)
            stops = np.cumsum(stop)
            base = np.maximum.accumulate(np.where(linked | overlaps, 0, stops - stop))
            run = np.sort(at[first & (low[at] == r) & (stops - stop == base)])
            sym[run] = merged[run]
            size[run] += size[run + 1]
            new, stay = np.zeros(n, bool), np.ones(n, bool)
            new[run], stay[run + 1] = True, False
            sym, place, size, segment, rank, merged, new = (x[stay] for x in (sym, place, size, segment, rank, merged, new))
            n = len(sym)
            touched = new.copy()
            touched[:-1] |= new[1:]
            rank[touched] = _NONE
            fresh = np.flatnonzero(touched[:-1] & (segment[:-1] == segment[1:]))
        flat, where = np.concatenate([*done_sym, sym]), np.concatenate([*done_place, place])
        order = np.argsort(where, kind="stable")
        return flat[order], where[order]

    def _grows_on(self, sym, segment, merged, at, r, first, some) -> np.ndarray:
        """Whether the symbol that a pair merges to makes a pair of a better or equal rank with a neighbour, when all
        pairs of its rank to its left have merged."""
        p = at[some]
        new, rank, n = merged[p], r[some], len(sym)
        before = np.maximum(p - 1, 0)
        left = sym[before]
        known = np.flatnonzero(first)  # the last one of its rank that merges before
        i = np.searchsorted(known, some) - 1
        prior = known[np.maximum(i, 0)]
        joined = (i >= 0) & (r[prior] == rank) & (at[prior] + 2 == p)
        left = np.where(joined, merged[at[prior]], left)
        got, _ = self._look_up(left, new)
        grows = (p > 0) & (segment[before] == segment[p]) & (got <= rank)
        after = np.minimum(p + 2, n - 1)
        got, _ = self._look_up(new, sym[after])
        return grows | ((p + 2 < n) & (segment[after] == segment[p]) & (got <= rank))

    def _spell(self, flat: np.ndarray, where: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their UTF-8 bytes' pieces, or the unknown id if there are none."""
        out, at = [], []
        for s, w, o in zip(flat.tolist(), where.tolist(), odd.tolist()):
            if not o:
                out.append(s)
                at.append(w)
                continue
            c = chr(s - _OTHER) if s >= _OTHER else self.extra[s - len(self.pieces)]
            ids = [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
            out += ids
            at += [w] * len(ids)
        return np.array(out, np.int64), np.array(at, np.int64)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the values at most ``w`` places away, by doubling."""
    n, width, m = len(x), 1, np.concatenate([np.full(w, _NONE), x, np.full(w, _NONE)])
    while 2 * width <= 2 * w + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = 2 * w + 1 - width
    return np.minimum(m[:n], m[rest:rest + n])


class Encoder:
    """Encodes texts of one task; ids of frequent words are kept, in CACHE_BYTES at most."""

    def __init__(self, model: PieceModel):
        self.m, self.cache, self.held = model, {}, 0
        # A word is a run of spaces with what follows; no piece reaches from a word into the spaces of the next one.
        self.cut = re.compile(r"\n| *[^ \n]+| +" if model.newline_splits else r" *[^ ]+| +").findall

    def words(self, text: str) -> list[str]:
        return self.cut(" " + text.replace(MARK, " ")) if text else []

    def encode_all(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as a leading space and the whole text give them; an empty text has none.

        Texts are taken in groups of about GROUP characters, so that the new words of many go through the rounds at
        once; a longer text is a group of its own.
        """
        group, held = [], 0
        for t in texts:
            group.append(self.words(t))
            held += len(t)
            if held >= GROUP:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        missing = {w for words in group for w in words if w not in self.cache}
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held, missing = 0, {w for words in group for w in words}
        order = sorted(missing, key=len)  # words of like lengths end after like numbers of rounds
        new, i = {}, 0
        while i < len(order):
            j = i + max(1, min(FLUSH, FLUSH_CHARS // len(order[min(i + FLUSH, len(order)) - 1])))
            part = order[i:j]
            new.update(zip(part, self.m.merge([x.replace(" ", MARK) for x in part])))
            i = j
        self.cache.update((w, b) for w, b in new.items() if len(w) <= LONG_WORD)
        self.held += sum(len(w) + len(b) + 200 for w, b in new.items() if len(w) <= LONG_WORD)
        get = lambda w: self.cache[w] if len(w) <= LONG_WORD else new[w]
        for words in group:
            yield np.frombuffer(b"".join(map(get, words)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: pieces joined, marks as spaces, the leading space dropped, and byte pieces put
        together to characters, where bytes that form none become U+FFFD each."""
        m = self.m
        ids = np.asarray(ids)
        parts = list(map(m.output.__getitem__, ids.tolist()))
        raw = b"".join(parts)
        if len(ids) and m.is_byte[ids].any():
            try:
                whole = b"" in parts or raw.decode()  # an empty control piece ends a run of bytes
            except UnicodeDecodeError:
                whole = True
            raw = _by_runs(parts, m.is_byte[ids].tolist()) if whole is True else raw
        first = next((i for i, p in enumerate(parts) if p), None)
        if first is not None and not m.is_byte[ids[first]] and ids[first] != m.unknown and raw.startswith(b" "):
            raw = raw[1:]
        return raw


def _by_runs(parts: list[bytes], is_byte: list[bool]) -> bytes:
    out, i = [], 0
    while i < len(parts):
        if not is_byte[i]:
            out.append(parts[i])
            i += 1
            continue
        j = i
        while j < len(parts) and is_byte[j]:
            j += 1
        run, k = b"".join(parts[i:j]), 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[k:k + n].decode().encode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                k += 1
        i = j
    return b"".join(out)


def _shared(spark, model_path: str):
    return spark.sparkContext.broadcast(PieceModel.load(model_path))


def encode_column(docs: DataFrame, model_path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Adds the array of ids of each whole text; null text has an empty array. Other columns stay."""
    model = _shared(docs.sparkSession, model_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(model.value)
        for texts in batches:
            yield pa.array(list(e.encode_all(t or "" for t in slices(texts))), pa.list_(pa.int32()))
        e.cache.clear()
        give_back()

    return docs.withColumn(name, ids(F.col(text)))


def decode_column(df: DataFrame, model_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Adds the text of each array of ids; a null array gives the empty text, null ids are skipped."""
    model = _shared(df.sparkSession, model_path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(model.value)
        for arrays in batches:
            yield pa.array([e.decode(np.array([i for i in (a.as_py() or ()) if i is not None], np.int64)).decode("utf-8", "replace") for a in arrays], pa.string())

    return df.withColumn(name, texts(F.col(ids)))


def encode_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: what a round trip through encoding and decoding gives.

    The ids are digested where they are made, so they are neither stored nor moved. Null text counts as empty, with no
    ids; repeated rows get equal results; an empty table gives no rows; columns of the added names are replaced. A
    text is encoded whole; the symbols in flight are those of at most FLUSH different words at once.
    """
    model = _shared(docs.sparkSession, model_path)

    @F.arrow_udf("struct<n:long,ids:string,text:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(model.value)
        decimal = [str(i) for i in range(len(model.value.pieces))]
        kind = pa.struct([("n", pa.int64()), ("ids", pa.string()), ("text", pa.string())])
        for texts in batches:
            rows = []
            for ids in e.encode_all(t or "" for t in slices(texts)):
                told = ",".join(map(decimal.__getitem__, ids.tolist()))
                rows.append({"n": len(ids), "ids": hashlib.sha256(told.encode()).hexdigest(), "text": hashlib.sha256(e.decode(ids)).hexdigest()})
            yield pa.array(rows, kind)
        e.cache.clear()
        give_back()

    return docs.withColumn("_d", digests(F.col(text))).select(
        *[c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")],
        F.col("_d.n").alias("n_tokens"), F.col("_d.ids").alias("ids_sha256"), F.col("_d.text").alias("decoded_sha256"),
    )
