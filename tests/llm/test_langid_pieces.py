import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from variantlake.llm import langid, pieces
from variantlake.llm.common import crc_mod

WORDS = {"en": "the of and that with from this have which their would about people".split(), "de": "der und nicht eine ich auch werden einer durch über schön können".split(), "ru": "это что как его она они было только если когда".split()}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_labels_and_mixed_spans(spark):
    rng = random.Random(1)
    rows = [(i, text(c, 40, rng), c, "x") for i, c in enumerate(["en", "de", "ru"] * 40)]
    mixed = text("en", 30, rng) + ". " + text("ru", 20, rng) + ". " + text("de", 30, rng)
    rows += [(1000, mixed, None, "x"), (1001, None, "en", "x"), (1002, "12 34 -- |", "de", "x"), (1003, "", None, "x"), (1004, text("de", 30000, rng), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df, crc_mod("doc_id", 4) != 2).collect()}
    assert len(got) == len(rows) and all(got[r[0]].lang_pred == r[2] for r in rows[:120])
    spans = got[1000].lang_spans
    assert [s.lang for s in spans] == ["en", "ru", "de"] and spans[0].start == 0 and spans[-1].end == len(mixed)
    assert [mixed[s.start:s.end].split()[0] in WORDS[s.lang] for s in spans] == [True] * 3
    assert 0 < got[1000].lang_score < 1
    for i in (1001, 1002, 1003):
        assert got[i].lang_pred == "und" and got[i].lang_score == 0
    assert got[1004].lang_pred == "de"
    kept = {r.doc_id for r in langid.kept(df, F.lit(True)).collect()}
    assert set(range(120)) <= kept and not kept & {1001, 1002, 1003}


FOREIGN = {
    2000: "az ember nem tudja hogy mikor volt szép az élet mert mindig csak később érti meg a múltat és a jövőt",
    2001: "これは日本語で書かれた文章であり学習された言語とは異なる文字を使っています",
    2002: "человек должен знать что завтра будет новый день для всех людей которые живут здесь",
}


def test_unlearned_languages_get_a_low_score(spark):
    rng = random.Random(5)
    rows = [(i, text(c, 60, rng), c) for i, c in enumerate(["en", "de"] * 60)] + [(i, t, None) for i, t in FOREIGN.items()]
    rows += [(2003, text("en", 50, rng) + " " + FOREIGN[2002], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, F.lit(True)).collect()}
    for i in FOREIGN:
        assert got[i].lang_pred in ("en", "de") and got[i].lang_score < 0.3, got[i]
    assert all(got[i].lang_score > 0.9 for i in range(120)) and [s.lang for s in got[2003].lang_spans] == ["en", "und"]
    kept = {r.doc_id for r in langid.kept(df, F.lit(True)).collect()}
    assert kept == {*range(120), 2003}


def plain_predictions(train, texts):
    """Counts, scores and paths in plain loops: dictionaries of trigrams, and dynamic programming without shortcuts."""
    import math
    from collections import defaultdict

    def trigrams(word):
        run, out = "", []
        for c in word.lower() + " ":
            if c.isalpha():
                run += c
            elif run:
                padded = "^" + run + "^"
                out += [padded[i:i + 3] for i in range(len(run))]
                run = ""
        return out

    counts = {code: defaultdict(int) for code in sorted({c for _, c in train})}
    scripts = {code: defaultdict(int) for code in counts}
    letter, script, _ = langid._tables()
    for t, code in train:
        for w in t.split():
            for g in trigrams(w):
                counts[code][g] += 1
                scripts[code][script[ord(g[1])]] += 1
    langs, known = list(counts), {g for c in counts.values() for g in c}
    total = {c: sum(counts[c].values()) for c in langs}
    log = lambda c, g: math.log((counts[c].get(g, 0) + 0.1) / (total[c] + 0.1 * (len(known) + 1)))
    own = {c: sum(n * log(c, g) for g, n in counts[c].items()) / total[c] for c in langs}
    unknown = min(own[c] - min(langid.MARGIN, (own[c] - math.log(0.1 / (total[c] + 0.1 * (len(known) + 1)))) / 2) for c in langs)
    out = []
    for t in texts:
        rows, sizes = [], []
        for w in t.split():
            gs = trigrams(w)
            kinds = defaultdict(int)
            for g in gs:
                kinds[script[ord(g[1])]] += 1
            main = max(sorted(kinds), key=lambda k: kinds[k]) if gs else None
            able = [c for c in langs if gs and scripts[c][main] > 0 and scripts[c][main] >= langid.MIN_SCRIPT * total[c]] or langs
            row = [sum(log(c, g) for g in gs) if c in able else -math.inf for c in langs] + [unknown * len(gs)]
            rows.append([max(x - max(row), -langid.CLIP) for x in row])
            sizes.append(len(gs))
        if not sum(sizes):
            out.append(("und", 0.0))
            continue
        best = [(x, [i]) for i, x in enumerate(rows[0])]
        for row in rows[1:]:
            step = []
            for j, x in enumerate(row):
                score, path = max([(best[j][0], best[j][1])] + [(s - langid.SWITCH, p) for i, (s, p) in enumerate(best) if i != j], key=lambda z: z[0])  # staying wins ties
                step.append((score + x, path + [j]))
            best = step
        path = max(best, key=lambda z: z[0])[1]
        share = [sum(n for n, p in zip(sizes, path) if p == j) for j in range(len(langs))]
        if not any(share):
            share = [0.0] * len(langs)
            sums = [sum(r[j] for r in rows) for j in range(len(langs))]
            out.append((langs[sums.index(max(sums))], 0.0))
        else:
            out.append((langs[share.index(max(share))], max(share) / sum(sizes)))
    return out


def test_predictions_equal_a_plain_model(spark):
    rng = random.Random(8)
    train = [(text(c, 50, rng), c) for c in ["en", "de", "ru"] * 20]
    texts = [t for t, _ in train] + list(FOREIGN.values()) + ["", "12 !!"]
    for _ in range(120):
        texts.append(" ".join(text(rng.choice(list(WORDS)), rng.randint(1, 12), rng) + rng.choice(["", " xyzzy", " быть", " 語", ", schön"]) for _ in range(rng.randint(1, 4))))
    rows = [(i, t, c) for i, (t, c) in enumerate(train)] + [(1000 + i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    for i, (code, score) in enumerate(plain_predictions(train, texts)):
        assert (got[1000 + i].lang_pred, round(got[1000 + i].lang_score, 9)) == (code, round(score, 9)), texts[i]


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(df, F.lit(True)).first().lang_pred == "und"
    assert langid.identify(df.limit(0), F.lit(True)).collect() == []


def test_viterbi_equals_trying_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(200):
        s = -rng.integers(0, 6, (6, 3)).astype(float)
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert cost(langid.viterbi(s, 3.0).tolist()) == max(map(cost, product(range(3), repeat=6)))


PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_equals_the_library():
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Encoder(pieces.PieceModel.load(PATH))
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("abcdethins ▁  \n\t.,é中文字漢\x00\U0001F600ñ<s>0x0A") for _ in range(rng.randint(0, 40)))
        ids = lib.encode(t)
        assert enc.encode(t).tolist() == ids
        assert enc.decode(np.array(ids, int)).decode() == lib.decode(ids)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.choice([0, 1, 2])]) for _ in range(rng.randint(0, 8))]
        assert enc.decode(np.array(ids, int)).decode() == lib.decode(ids)
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    assert enc.encode(long).tolist() == lib.encode(long)


def test_long_words_equal_the_library(monkeypatch):
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Encoder(pieces.PieceModel.load(PATH))
    rng = random.Random(4)
    for letters in ("ab", "acgt", "=-", "etaoinshrdlu"):  # seconds each
        long = "".join(rng.choices(letters, k=1_000_000))
        assert enc.encode(long).tolist() == lib.encode(long)
    for long in ("a" * 200_000, "ab" * 100_000, "the" * 100_000):
        assert enc.encode(long).tolist() == lib.encode(long)
    monkeypatch.setattr(pieces, "LONG_WORD", 1)  # short words too go through rounds by window
    for letters in ("ab", "acgt", "=-", "a", "etaoin", "0123456789", "éèàaei", "ab c"):
        for n in (1, 2, 7, 40, 300):
            for _ in range(12):
                t = "".join(rng.choices(letters, k=n))
                assert enc.encode(t).tolist() == lib.encode(t)


def test_columns(spark):
    rows = [(1, "Hello  world\n", 5), (1, "Hello  world\n", 5), (2, None, 5), (3, "", 5), (None, "größe " * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r, (i, t, _) in zip(pieces.encode_digests(df, PATH).collect(), rows):
        ids = lib.encode(t or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = pieces.decode_column(pieces.encode_column(df, PATH), PATH, name="again").collect()
    assert [r.again for r in back] == [t or "" for _, t, _ in rows]
    assert pieces.encode_digests(df.limit(0), PATH).collect() == []
