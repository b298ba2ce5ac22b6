"""Toxicity: disguised words are decoded as through a noisy channel, then restored texts are scored by learned words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, give_back, slices
from .langid import _tables, grams

FIT_ROWS = 16_000  # expected bound of labelled rows that the weights are fitted on, taken by a hash of the row
ALPHABET = 96  # letters that the character model tells apart, the most frequent ones; all others count as one
BACKOFF = 5.0  # strength of the shorter context in each probability
LEXICON, EVIDENCE, LEAST_DOCS = 400, 16.0, 4  # features at most; least log-likelihood ratio and documents of one
STEMS = (4, 5, 6, 7)  # letters of a word's beginning that are features of their own, beside whole words
MOST = 7  # occurrences from which on more of them say nothing new
RIDGE = 0.05
GROUP = 200_000  # different words of a task that are counted together
NODES = 64  # characters, repeated ones as one, that one search goes over
CACHE = 1 << 16

# What characters stand for in disguised words.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
# Costs of the channel in nats: a character read as a letter, a sign between letters dropped, a blank of a spaced word
# dropped, a sign left as it is inside or before a word, and after it; a repeated letter taken as fewer ones, or two as one.
READ, DROP, JOIN, INSIDE, AFTER, SHRINK, HALVE, DECORATION = 1.5, 2.5, 0.5, 3.0, 1.5, 1.0, 3.0, 3.0

LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?=[.,;:!?)]*(?!\S))")
SPACE = re.compile(r"\s")
EDGES = ".,;:!?()\"'"


class Characters:
    """Costs (negative log probabilities) of a letter after two others; 0 is the edge of a word, the last code any other letter."""

    def __init__(self, letters: list[str], costs: np.ndarray):
        self.code = {c: i for i, c in enumerate(letters, 1)}
        self.n = len(letters) + 2
        self.costs = np.ascontiguousarray(costs, np.float32)
        self._flat: memoryview | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_flat": None}

    def cost(self, a: int, b: int, c: int) -> float:
        if self._flat is None:
            self._flat = memoryview(self.costs.ravel())
        return self._flat[(a * self.n + b) * self.n + c]

    def of(self, letter: str) -> int:
        return self.code.get(letter, self.n - 1)


def fit_characters(docs: DataFrame, work: Workspace, text: str = "text", alphabet: int = ALPHABET) -> Characters:
    """Counts letter trigrams of all words of all texts that consist of letters but for punctuation around them, without
    runs of single characters.

    Tasks count their words first; trigrams are summed by key, then by the codes of the most frequent letters, so the
    driver gets (alphabet + 2) cubed numbers at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for b in batches:
            for t in slices(b.column(0)):
                words.update(SPACED.sub(" ", t).split() if t else ())  # spaced words would teach single letters
                if len(words) > GROUP:
                    yield from _trigrams(words)
                    words = Counter()
        yield from _trigrams(words)
        give_back()

    counts = work.keep(docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "trigrams")
    point = F.shiftright("key", 21).bitwiseAND(F.lit((1 << 21) - 1))
    top = counts.groupBy(point.alias("point")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(alphabet).collect()
    letters = sorted(chr(r["point"]) for r in top)
    code = np.full(1 << 21, len(letters) + 1, np.int64)
    code[0] = 0
    code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    n = len(letters) + 2

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            a, c, d = (code[k >> s & (1 << 21) - 1] for s in (42, 21, 0))
            yield pa.RecordBatch.from_arrays([pa.array((a * n + c) * n + d), b.column(1)], names=["key", "n"])

    three = np.zeros(n ** 3)
    for r in counts.mapInArrow(coded, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        three[r["key"]] = r["n"]
    work.drop("trigrams")
    three = three.reshape(n, n, n)
    three[0, 0] = three[0].sum(1)  # how words begin
    two = three.sum(0)
    one = (two.sum(0) + 1) / (two.sum() + n)
    second = (two + BACKOFF * one) / (two.sum(1, keepdims=True) + BACKOFF)
    return Characters(letters, -np.log((three + BACKOFF * second) / (three.sum(2, keepdims=True) + BACKOFF)))


def _trigrams(words: Counter) -> Iterator[pa.RecordBatch]:
    clean: Counter = Counter()
    for w, n in words.items():
        w = w.strip(EDGES).lower()
        if w.isalpha():
            clean[w] += n
    if not clean:
        return
    word, key, _ = grams(list(clean))
    times = np.fromiter(clean.values(), np.int64, len(clean))
    found, back = np.unique(key, return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(back, times[word], len(found)).astype(np.int64))], names=["key", "n"])


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 1 a letter, 2 a character with a reading, 3 white space, 0 anything else."""
    kinds = _tables()[0].astype(np.uint8)
    kinds[[i for i in range(0x3001) if chr(i).isspace()]] = 3
    kinds[[ord(c) for c in READINGS]] = 2
    return kinds


def odd_places(text: str) -> np.ndarray:
    """Where a word may be disguised: a character with a reading, a sign inside a word, a letter for the third time."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    odd = kind == 2
    if len(points) > 2:
        odd[1:-1] |= (kind[1:-1] == 0) & (kind[2:] == 1) & (kind[:-2] != 3)
        odd[2:] |= (kind[2:] == 1) & (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
    return np.flatnonzero(odd)


class Decoder:
    """Finds the most probable words behind disguised ones, stretch by stretch."""

    def __init__(self, characters: Characters):
        self.lm, self.seen, self.words = characters, {}, {}

    def text(self, text: str) -> str:
        """The text with its disguised words restored; everything else stays as it is.

        Looked at are runs of three or more single characters with one blank between them, and words with a letter
        and an odd place: a character with a reading, a sign between letters, or a letter three times.
        """
        spans = [m.span() for m in SPACED.finditer(text) if len(LETTERS.findall(m.group())) >= 2]
        odd = odd_places(text)
        done, more, i, k = 0, [], 0, 0
        while i < len(odd):
            start = int(odd[i])
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            if k < len(spans) and spans[k][0] <= start:
                done = spans[k][1]
            else:
                end = SPACE.search(text, start)
                end = end.start() if end else len(text)
                while start > done and not text[start - 1].isspace():
                    start -= 1
                done = end
                more.append((start, end))
            i += 1
            if i < len(odd) and odd[i] < done:
                i = int(np.searchsorted(odd, done))
        out, at = [], 0
        for a, b in sorted(spans + more):
            word = text[a:b]
            found = self.words.get(word)
            if found is None:
                found = self.word(word)
                if len(word) <= NODES:
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    self.words[word] = found
            out += [text[at:a], found]
            at = b
        return "".join(out) + text[at:] if out else text

    def word(self, word: str) -> str:
        """One word, or one run of single characters."""
        if not LETTERS.search(word):
            return word
        nodes = [(m.group(), m.group()[0]) for m in re.finditer(r"(.)\1*", word, re.S)]
        fixed = [len(run) == 1 and c.isalpha() for run, c in nodes]  # one reading
        out, a, b, i = [], 0, 0, 0
        while i < len(nodes):
            if fixed[i]:  # no search before the next open place
                out.append(nodes[i][0])
                a, b, i = b, self.lm.of(nodes[i][1].lower()[0]), i + 1
                continue
            j, sure = i, 0
            while j < len(nodes) and sure < 2 and j - i < NODES:
                sure = sure + 1 if fixed[j] else 0
                j += 1
            choices = [self._choices(x, nodes) for x in range(i, j)]
            picked, a, b = self._search(a, b, choices, j == len(nodes))
            out += [c[x][1] for c, x in zip(choices, picked)]
            i = j
        return "".join(out)

    def _choices(self, i: int, nodes: list[tuple[str, str]]) -> list[tuple[tuple[int, ...], str, float]]:
        """What a character, with its repetitions, may stand for: codes, text, cost. Code 0 leaves it, as an edge."""
        run, c = nodes[i]
        r, low = len(run), c.lower()
        if c.isalpha():
            x = self.lm.of(low[0])
            if r == 1:
                return [((x,), run, 0.0)]
            if r == 2:
                return [((x, x), run, 0.0), ((x,), c, HALVE)]
            return ([((x,) * r, run, 0.0)] if r <= 4 else []) + [((x, x), c * 2, SHRINK), ((x,), c, SHRINK)]
        if c.isspace():
            return [((0,), run, 0.0), ((), "", JOIN)]
        spaced = 2 if any(x.isspace() for _, x in nodes[max(0, i - 1):i + 2]) else 1
        before, after = (any(x.isalpha() for _, x in near) for near in (nodes[max(0, i - spaced):i], nodes[i + 1:i + 1 + spaced]))
        ornament = DECORATION if r >= 3 else 0.0
        readings = READINGS.get(c, "")
        leave = 0.0 if ornament or not (before or after) or c in EDGES and not after else AFTER if not after else INSIDE if readings else 0.0
        out = [((0,), run, leave)]
        for x in readings:
            for k in range(1, min(r, 2) + 1):
                out.append(((self.lm.of(x),) * k, x * k, READ + ornament + (HALVE if k < r else 0.0)))
        if spaced == 1 and not c.isdigit() and before and i + 1 < len(nodes):
            out.append(((), "", DROP))
        return out

    def _search(self, a: int, b: int, choices: list, last: bool) -> tuple[tuple[int, ...], int, int]:
        key = (a, b, last, *[tuple((x, c) for x, _, c in o) for o in choices])
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            found = self.seen[key] = self._viterbi(a, b, choices, last)
        return found

    def _viterbi(self, a: int, b: int, choices: list, last: bool) -> tuple[tuple[int, ...], int, int]:
        """The cheapest choices from the letters a, b on; states are the last two letters, ties go to the first choice."""
        cost = self.lm.cost
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(a, b): (0.0, None)}
        for options in choices:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, path) in states.items():
                for k, (codes, _, price) in enumerate(options):
                    total, x, y = so_far + price, a, b
                    for c in codes:
                        if c:
                            total += cost(x, y, c)
                            x, y = y, c
                        else:
                            total += cost(x, y, 0) if y else 0.0
                            x = y = 0
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, (path, k)
            states = new
        end = (lambda s: states[s][0] + (cost(*s, 0) if s[1] else 0.0)) if last else (lambda s: states[s][0])
        best = min(states, key=end)
        picked, path = [], states[best][1]
        while path:
            path, k = path
            picked.append(k)
        return tuple(picked[::-1]), *best


def restore(docs: DataFrame, characters: Characters, text: str = "text", to: str = "restored") -> DataFrame:
    """``docs`` with the restored text in ``to``; null stays null, empty stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for values in batches:
            yield pa.array([None if t is None else decoder.text(t) for t in slices(values)], pa.string())
        give_back()

    return docs.withColumn(to, decode(F.col(text)))


def features(words: dict[str, int]) -> Counter:
    """How often each word and each beginning of a longer word occurs; beginnings end in ``*``."""
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


class Lexicon:
    """Features with weights: a score is the logistic of the bias, the features' weighted log counts and the length's."""

    def __init__(self, weights: dict[str, float], bias: float, length: float = 0.0):
        self.weights, self.bias, self.length = weights, bias, length
        self.heads = {f[:min(STEMS)] for f in weights}

    def values(self, restored: str) -> tuple[dict[str, int], int]:
        """Counts of the known features, and the number of words."""
        words = LETTERS.findall(restored.lower())
        near = {w: n for w, n in Counter(words).items() if w[:min(STEMS)] in self.heads}
        return {f: n for f, n in features(near).items() if f in self.weights}, len(words)

    def score(self, restored: str) -> float:
        known, n = self.values(restored)
        z = self.bias + self.length * math.log1p(n) + math.fsum(self.weights[f] * amount(k) for f, k in known.items())
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def amount(n: int) -> float:
    return math.log2(1 + min(n, MOST))


def fit_lexicon(docs: DataFrame, characters: Characters, work: Workspace, text: str = "text", label: str = "toxic", seed: str = "doc_id", max_rows: int = FIT_ROWS) -> Lexicon:
    """Learns features and weights from rows with a text and a label of 0 or 1.

    Above ``max_rows`` labelled rows, those whose hash of ``seed`` falls below the share that leaves about ``max_rows``
    are used, whole, the same on every run. Features that go with the label (log-likelihood ratio over the documents
    that hold them) get the weights of a ridge regression. Without labels every score is a fourth, with one label the
    smoothed share. The driver gets the chosen features and, per sampled row, how often each occurs.
    """
    labelled = docs.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1))
    share = min(1.0, max_rows / max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.xxhash64(seed), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = work.keep(restore(sample.select(text, F.col(label).cast("int").alias("label")), characters, text).select("label", "restored"), "fit")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n, n1 = total["n"], total["n1"]
    bias = math.log((n1 + 0.5) / (n - n1 + 1.5))
    if not 0 < n1 < n:
        return Lexicon({}, bias)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(seen)
            columns = [pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())]
            seen.clear()
            toxic.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "k", "k1"])

        for b in batches:
            for one, t in zip(b.column(0).to_pylist(), slices(b.column(1))):
                fs = features(Counter(LETTERS.findall(t.lower()))).keys()
                seen.update(fs)
                if one:
                    toxic.update(fs)
                if len(seen) > GROUP:
                    yield out()
        yield out()
        give_back()

    counts = rows.mapInArrow(count, "feature string, k long, k1 long").groupBy("feature").agg(F.sum("k").alias("k"), F.sum("k1").alias("k1"))
    side = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    k, k1 = F.col("k"), F.col("k1")
    k0, n0 = k - k1, n - n1
    ratio = side(k1, k * n1 / n) + side(k0, k * n0 / n) + side(n1 - k1, (n - k) * n1 / n) + side(n0 - k0, (n - k) * n0 / n)
    best = counts.filter(k >= LEAST_DOCS).withColumn("ratio", 2 * ratio).filter(F.col("ratio") >= EVIDENCE)
    chosen = [r["feature"] for r in best.orderBy(F.desc("ratio"), "feature").limit(LEXICON).collect()]
    plain = Lexicon(dict.fromkeys(chosen, 0.0), bias)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(chosen)}
        for b in batches:
            found = [plain.values(t) for t in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([m for _, m in found], pa.int64()),
                pa.array([[at[f] for f in fs] for fs, _ in found], pa.list_(pa.int32())), pa.array([list(fs.values()) for fs, _ in found], pa.list_(pa.int64())),
            ], names=["label", "words", "at", "times"])

    sampled = rows.mapInArrow(known, "label int, words long, at array<int>, times array<long>").orderBy("label", "words", "at", "times").collect()
    work.drop("fit")
    x = np.zeros((len(sampled), len(chosen) + 2), np.float32)
    x[:, 0], x[:, 1] = 1, [math.log1p(r["words"]) for r in sampled]
    for i, r in enumerate(sampled):
        x[i, [j + 2 for j in r["at"]]] = [amount(m) for m in r["times"]]
    w = _logistic(x, np.ones(len(x)), np.array([r["label"] for r in sampled], float))
    return Lexicon(dict(zip(chosen, w[2:].tolist())), float(w[0]), float(w[1]))


def _logistic(x: np.ndarray, n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Ridge regression by Newton steps; row i stands for n[i] documents, n1[i] of them positive. The bias is free."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    w[0] = math.log((n1.sum() + 0.5) / (n.sum() - n1.sum() + 0.5))
    ridge[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((n * np.logaddexp(0, z) - n1 * z).sum() + (ridge * v * v).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n1 - n * p) - ridge * w)
        size, now = 1.0, loss(w)
        while loss(w + size * step) > now and size > 1e-4:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def score_texts(docs: DataFrame, characters: Characters, lexicon: Lexicon, text: str = "text", to: str = "toxic_score") -> DataFrame:
    """``docs`` with a score between 0 and 1; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((characters, lexicon))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        characters, lexicon = shared.value
        decoder = Decoder(characters)
        for values in batches:
            yield pa.array([lexicon.score(decoder.text(t or "")) for t in slices(values)], pa.float64())
        give_back()

    return docs.withColumn(to, score(F.col(text)))


def toxic_scores(docs: DataFrame, labels: DataFrame, training: Column, work: Workspace, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key and score of each row of ``docs``; ``labels`` (key, label) teaches where ``training``, a condition on the key, holds.

    The character model counts all texts, the weights come from labelled training rows only. Of several labels of one
    key the largest counts, null labels and keys teach nothing. Repeated rows score alike; whole texts are read, however
    long; columns besides key and text are left aside. Empty tables give no rows.
    """
    docs = docs.select(key, text)
    characters = fit_characters(docs, work, text)
    taught = labels.filter(training & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_toxic")).filter("_toxic is not null")
    lexicon = fit_lexicon(docs.join(taught, key), characters, work, text, "_toxic", key)
    return score_texts(docs, characters, lexicon, text, "score").select(key, "score")
