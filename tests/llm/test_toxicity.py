import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlake.llm import toxicity

WORDS = "you are such a stupid idiot moron and the weather is nice today we like to read good books in the morning because it is quiet please bring some coffee loser pathetic".split()


def plain_model(words):
    """Character costs counted and smoothed in the plainest way."""
    letters = sorted(set("".join(words)))
    n = len(letters) + 2
    code = {c: i for i, c in enumerate(letters, 1)}
    three = np.zeros((n, n, n))
    for w in words:
        x = [0, 0, *[code[c] for c in w], 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            three[a, b, c] += 1
    two = np.zeros((n, n))
    one = np.zeros(n)
    for a, b, c in itertools.product(range(n), repeat=3):
        two[b, c] += three[a, b, c]
        one[c] += three[a, b, c]
    p1 = (one + 1) / (one.sum() + n)
    cost = np.zeros((n, n, n))
    for a, b, c in itertools.product(range(n), repeat=3):
        p2 = (two[b, c] + 5 * p1[c]) / (two[b].sum() + 5)
        cost[a, b, c] = -np.log((three[a, b, c] + 5 * p2) / (three[a, b].sum() + 5))
    return toxicity.Characters(letters, cost)


@pytest.fixture(scope="module")
def decoder():
    return toxicity.Decoder(plain_model(WORDS * 20))


def brute(decoder, word):
    """The least cost over all combinations of choices, and the costs of a given text's choices."""
    import re

    nodes = [(m.group(), m.group()[0]) for m in re.finditer(r"(.)\1*", word, re.S)]
    choices = [decoder._choices(i, nodes) for i in range(len(nodes))]
    best = {}
    for combo in itertools.product(*choices):
        cost, a, b = 0.0, 0, 0
        for codes, _, price in combo:
            cost += price
            for c in codes:
                cost += decoder.lm.cost(a, b, c) if c or b else 0.0
                a, b = (b, c) if c else (0, 0)
        cost += decoder.lm.cost(a, b, 0) if b else 0.0
        text = "".join(t for _, t, _ in combo)
        best[text] = min(best.get(text, np.inf), cost)
    return best


def test_search_equals_all_combinations(decoder):
    rng = random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("aidiotsumnrp10$@!.-") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(2, 8)))
        if toxicity.LETTERS.search(word):
            costs = brute(decoder, word)
            assert abs(costs[decoder.word(word)] - min(costs.values())) < 1e-4, word


@pytest.mark.parametrize("seen,meant", [
    ("1d10t", "idiot"), ("you are $tupid!", "you are stupid!"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("i d i o t", "idiot"), ("L0$3R", "LoseR"),
    ("stuuuupid", "stupid"), ("idi-ot", "idiot"), ("p@theticccc", "pathetic"), ("so i d 1 0 t, you", "so idiot, you"),
    ("good coffee", "good coffee"), ("we like to read", "we like to read"), ("2024-01-02", "2024-01-02"), ("", ""), ("the&&& good*** books###", "the&&& good*** books###"), ("| a | b |", "| a | b |"),
])
def test_restored_words(decoder, seen, meant):
    assert decoder.text(seen) == meant


def test_long_texts_take_linear_time(decoder):
    import time

    for text in ("a" * 1_000_000, "1a$" * 80_000, "1" * 1_000_000, "a b " * 60_000, "x.y" * 60_000, "$!" * 100_000 + "a"):
        start = time.time()
        decoder.text(text)
        assert time.time() - start < 30


SCHEMA = "doc_id long, text string, toxic string, score int"


def corpus(n=900):
    rng = random.Random(7)
    hide = {"idiot": ["1d10t", "i d i o t", "idiooot", "id.iot"], "stupid": ["$tupid", "stup1d", "s t u p i d", "stuuupid"], "moron": ["m0r0n", "moroooon", "m.o.r.o.n", "m o r o n"]}
    good = [w for w in WORDS if w not in (*hide, "loser", "pathetic")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                bad = rng.choice(list(hide))
                words.insert(rng.randrange(len(words)), bad if i % 12 else rng.choice(hide[bad]))
        rows.append((i, " ".join(words), "1", 9))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_scores_of_plain_and_disguised_words(spark, work):
    rows, labels = corpus()
    fold = F.col("doc_id") % 5 != 0
    odd = [(None, None, "", 0), (5000, "", "", 0), (5001, None, "", 0), (5002, "coffee " * 100_000 + "1d10t and m0r0n", "", 0), (1, rows[1][1], "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    taught = spark.createDataFrame([(k, q, t) for k, q, t in labels] + [(None, 0, 1), (7, None, None), (6001, 0, 1)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.score) for r in toxicity.toxic_scores(docs, taught, fold, work).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    for i, _, t in labels:
        assert (by[i] >= 0.5) == bool(t), (i, rows[i][1])
    assert by[5000] == by[5001] < 0.5 and by[5002] >= 0.5 and len({s for k, s in got if k == 1}) == 1


def test_characters_equal_plain_counts(spark, work):
    rows = [("The Cat, (sat)",), ("the   cat x1y a-b",), (None,), ("Öl öl! zzz",), ("",)]
    got = toxicity.fit_characters(spark.createDataFrame(rows, "text string"), work)
    want = plain_model("the cat sat the cat öl öl zzz".split())
    assert got.code == want.code and np.abs(got.costs - want.costs).max() < 1e-5
    few = toxicity.fit_characters(spark.createDataFrame(rows, "text string"), work, alphabet=3)
    assert len(few.code) == 3 and few.of("q") == 4


def test_restore_and_weights(spark, work):
    characters = plain_model(WORDS * 20)
    docs = spark.createDataFrame([("you m0r0n", 1), (None, 2), ("", 3)], "text string, restored int")
    assert [r.restored for r in toxicity.restore(docs, characters).orderBy("text").collect()] == [None, "", "you moron"]
    x = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 1], [1, 1, 1]], np.float32)
    w = toxicity._logistic(x, np.array([900, 50, 40, 10.0]), np.array([20, 45, 4, 10.0]))
    z = x @ w
    p = 1 / (1 + np.exp(-z))
    slope = x.T @ (np.array([20, 45, 4, 10]) - np.array([900, 50, 40, 10]) * p) - np.array([1e-6, toxicity.RIDGE, toxicity.RIDGE]) * w
    assert np.abs(slope).max() < 1e-3


def test_nothing_to_learn(spark, work):
    docs = spark.createDataFrame([(1, "a b", "", 0), (2, None, "", 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxic_scores(docs, none, F.lit(True), work).collect()] == [pytest.approx(0.25)] * 2
    assert toxicity.toxic_scores(docs.limit(0), none, F.lit(True), work).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert len(toxicity.toxic_scores(docs, one, F.lit(True), work).collect()) == 2
