"""Language identification: script ranges narrow the candidates, Viterbi over words labels mixed-language spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, slices

TRAIN_ROWS = 16_000  # expected bound of labelled rows that the model is fitted on, taken by a hash of the row
MAX_GRAMS = 60_000  # most frequent letter trigrams kept per language
MIN_SCRIPT = 0.01  # share of a language's letters from which on a script is one of its own
SWITCH = 9.0  # cost of changing the language between two words, in natural log units
CLIP = 5.0  # most by which one word can set two languages apart
MARGIN = 3.0  # nats a letter that a word may fall short of a language's own words before no language claims it
CACHE = 1 << 17
UNKNOWN = "und"

# First and last code point of the main blocks of each script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
GROUP = 1_000_000  # characters of text whose new words are scored together


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """By code point: whether it is a letter, and the number of its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    names = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = names.index(name)
    return letter, script, names


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the lower-cased words: the word's number, its trigram, and the script's number.

    A letter's trigram holds its neighbours, or the edge of the run of letters, so a run has as many trigrams as
    letters. Trigrams are numbers, 21 bits for each code point and 0 for an edge.
    """
    letter, script, _ = _tables()
    points = np.frombuffer("\n".join(words).lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    is_letter = letter[points]
    padded = np.concatenate([[0], np.where(is_letter, points, 0), [0]])
    at = np.flatnonzero(is_letter)
    word = np.cumsum(points == 10)[at]
    return word, padded[at] << 42 | points[at] << 21 | padded[at + 2], script[points[at]]


class Model:
    """Trigram log probabilities by language, and each language's scripts. Its size is bounded by MAX_GRAMS."""

    def __init__(self, langs: list[str], keys: np.ndarray, logs: np.ndarray, floor: np.ndarray, scripts: np.ndarray, unknown: float):
        self.langs, self.scripts, self.unknown = langs, scripts, unknown
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.logs = np.concatenate([logs, floor[None, :]])  # the last row stands for unknown trigrams

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language and, last, of no learned language; zero for the best and clipped. And the number of letters.

        Only languages that use the script of most of a word's letters are candidates for it, if there are any. No
        language has ``unknown`` for each letter, so it wins where trigrams are rare in all of them, or their scripts new.
        """
        word, key, script = grams(words)
        n, k = len(words), len(self.langs)
        i = np.searchsorted(self.keys, key)
        i = np.where(self.keys[i] == key, i, len(self.keys) - 1)
        s = np.stack([np.bincount(word, self.logs[i, j], n) for j in range(k)], 1)
        letters = np.bincount(word, minlength=n)
        kinds = len(_tables()[2])
        main = np.bincount(word * kinds + script, minlength=n * kinds).reshape(n, kinds).argmax(1)
        allowed = self.scripts[main]
        s[~allowed & allowed.any(1)[:, None] & (letters > 0)[:, None]] = -np.inf
        s = np.concatenate([s, (letters * self.unknown)[:, None]], 1)
        return np.maximum(s - s.max(1, keepdims=True), -CLIP), letters


class _Words(dict):
    """Row numbers of words in a table of scores, which is emptied between groups of texts once it is full."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.scores, self.letters = np.zeros((0, len(self.model.langs) + 1)), np.zeros(0, np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        new = list({w for words in texts for w in words if w not in self})
        if len(self) + len(new) > CACHE:
            self._reset()
            new = list({w for words in texts for w in words})
        if new:
            scores, letters = self.model.score(new)
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, where every change of language costs ``switch``; ties go to the first language.

    If no stretch of words speaks for another language than the best overall by more than one change costs, and no
    beginning and end together do, the best path never changes; prefix sums show that without walking the words.
    """
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], 0)
    low = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]])), 0)
    ends = max(gain.max(), 0) + (gain[-1] - np.minimum(gain.min(0), 0)).max()
    if (gain - low).max() <= switch and ends <= switch:
        return np.full(n, best)
    back = np.empty((n, k), np.int16)
    now = scores[0].tolist()
    for i, row in enumerate(scores[1:].tolist(), 1):
        top = max(now)
        at, over = now.index(top), top - switch
        for j in range(k):
            if now[j] >= over:
                back[i, j] = j
                row[j] += now[j]
            else:
                back[i, j] = at
                row[j] += over
        now = row
    path = np.empty(n, np.int64)
    path[-1] = now.index(max(now))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", seed: str = "doc_id", max_rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on whole labelled texts; rows with a null text or label teach nothing.

    Above ``max_rows`` labelled rows, the rows whose hash of ``seed`` falls below the share that leaves about
    ``max_rows`` are used, the same on every run. Trigrams are counted in the tasks and summed by (lang, trigram).
    """
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    share = min(1.0, max_rows / max(1, labelled.count()))
    cut = int(share * (1 << 30))
    sample = labelled.filter(F.pmod(F.xxhash64(seed), F.lit(1 << 30)) < cut).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = {}
            for code, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(code, Counter()).update(t.split())
            for code, ws in words.items():
                if not ws:
                    continue
                times = np.fromiter(ws.values(), np.int64, len(ws))
                word, key, script = grams(list(ws))
                for what, item in (("gram", key), ("script", script.astype(np.int64))):
                    found, back = np.unique(item, return_inverse=True)
                    n = np.bincount(back, times[word], len(found)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([code] * len(found), pa.string()), pa.array([what] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "what", "item", "n"])

    counts = sample.mapInArrow(count, "lang string, what string, item long, n long").groupBy("lang", "what", "item").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang", "what").orderBy(F.col("n").desc(), "item")
    rows = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= MAX_GRAMS).select("lang", "what", "item", "n").collect()
    langs = sorted({r[0] for r in rows})
    at = {code: i for i, code in enumerate(langs)}
    keys = np.array(sorted({r[2] for r in rows if r[1] == "gram"}), np.int64)
    table, letters = np.zeros((len(keys), len(langs))), np.zeros((len(_tables()[2]), len(langs)))
    for code, what, item, n in rows:
        if what == "gram":
            table[np.searchsorted(keys, item), at[code]] = n
        else:
            letters[item, at[code]] = n
    a, v = 0.1, len(keys) + 1
    total = table.sum(0)
    scripts = (letters > 0) & (letters >= MIN_SCRIPT * letters.sum(0))
    logs, floor = np.log((table + a) / (total + a * v)), np.log(a / (total + a * v))
    own = (table * logs).sum(0) / np.maximum(total, 1)
    unknown = float((own - np.minimum(MARGIN, (own - floor) / 2)).min()) if langs else 0.0
    return Model(langs, keys, logs, floor, scripts, unknown)


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score and lang_spans to ``docs``.

    lang_pred is the language with most letters in the labelled words, lang_score its share of all letters, lang_spans
    the stretches of one language as (lang, start, end) in code points; stretches that no learned language claims are
    ``und`` there. A text in which none claims a word gets the language that its words speak for most, with score 0.
    Ties go to the first language by name. ``und`` with score 0 and no spans stands for a null text, a text without
    letters, or a model that has learned no language. Whole texts are read, however long; repeated rows get equal results.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<lang:string,start:int,end:int>>>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        words = _Words(m)
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for texts in batches:
            rows, group, held = [], [], 0
            for t in slices(texts):
                group.append((t, t.split() if t and m.langs else []))
                held += len(t or "")
                if held >= GROUP:
                    rows += _group(m, words, group)
                    group, held = [], 0
            yield pa.array(rows + _group(m, words, group), kind)
        words.clear()
        give_back()

    found = predict(F.col(text))
    return docs.withColumn("_found", found).select(
        *[c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_spans")],
        F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("lang_score"), F.col("_found.spans").alias("lang_spans"),
    )


def _group(m: Model, words: _Words, group: list[tuple[str | None, list[str]]]) -> list[dict]:
    words.learn([tokens for _, tokens in group])
    return [_one(m, words, t, tokens) for t, tokens in group]


def _one(m: Model, words: _Words, text: str | None, tokens: list[str]) -> dict:
    none = {"lang": UNKNOWN, "score": 0.0, "spans": []}
    if not tokens:
        return none
    rows = words.rows(tokens)
    letters = words.letters[rows]
    total = int(letters.sum())
    if not total:
        return none
    scores = words.scores[rows]
    path = viterbi(scores)
    k = len(m.langs)
    share = np.bincount(path, letters, k + 1)
    best = int((share[:k] if share[:k].any() else scores[:, :k].sum(0)).argmax())
    names = [*m.langs, UNKNOWN]
    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
    starts = [x.start() for x in re.finditer(r"\S+", text)] if len(cuts) > 2 else [0]
    spans = [{"lang": names[path[a]], "start": starts[a] if a else 0, "end": starts[b] if b < len(path) else len(text)} for a, b in zip(cuts, cuts[1:])]
    return {"lang": m.langs[best], "score": float(share[best] / total), "spans": spans}


def identify(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Fits on the rows where ``training`` holds and labels all; see fit and label. An empty table gives no rows."""
    return label(docs, fit(docs.filter(training), text, lang, key), text)


def kept(docs: DataFrame, training: Column, least: float = 0.3, **names: str) -> DataFrame:
    """``docs`` without those that no language claims: ``und``, or less than ``least`` of the letters in one language,
    as in texts of a language that wasn't learned."""
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)
    return identify(docs, training, **names).filter(good).select(*docs.columns)

