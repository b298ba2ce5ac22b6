import hashlib
import random
import sys
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

from variantlake.llm import neardup

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and that with from this have which their would about people".split(), "de": "der und nicht eine ich auch werden einer durch über schön können".split()}
NAMES = [n for n, _ in cp.STAGES]


@pytest.fixture(autouse=True)
def small_sketch(monkeypatch):
    monkeypatch.setattr(neardup, "CELLS", 1 << 16)


def corpus():
    rng = random.Random(1)
    text = lambda c, n=60: " ".join(rng.choice(WORDS[c]) for _ in range(n))
    rows = [(i, text(c), c, f"s{i % 3}", 0) for i, c in enumerate(["en", "de"] * 20)]
    rows += [(50, rows[3][1], "de", None, 0), (51, rows[4][1] + " people", "en", "s1", 0)]  # an exact and a near copy
    rows += [(52, "write to me at a.b@example.com or 10.0.0.1 about people and that", "en", "s2", 0)]
    rows += [(60, None, "en", "s0", None), (61, "", "en", "s0", 0), (62, "12 34 | --", "en", None, 0)]
    rows += [(None, text("de"), None, None, None), (70, text("en"), None, "s1", 5), (70, text("de"), None, "s1", 5), (7, rows[7][1], rows[7][2], rows[7][3], 0)]
    return rows


def test_stages_in_turn(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert NAMES == ["language_id", "near_duplicates", "private_data", "mix", "tokenize"] and cp.ORACLE_SQL is None
    seen, now = {}, docs
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path / "sf"))
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != NAMES[-1]:
            assert now.columns == list(cp.COLUMNS)
    # Rejected are exactly the documents without a letter.
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(repr, map(tuple, seen["language_id"]))) == sorted(map(repr, kept))
    # Of copies that of the smallest key stays, and rows that share a key but not a text stay.
    gone = {50, 51}
    left = sorted({repr(r) for r in kept if r[0] not in gone})
    assert sorted(map(repr, map(tuple, seen["near_duplicates"]))) == left
    marked = {r.doc_id: r for r in seen["private_data"]}
    assert marked[52].text == "write to me at [EMAIL] or [IP] about people and that" and marked[52].n_chars == len(marked[52].text)
    assert sorted((repr(r.doc_id), r.text) for r in seen["private_data"] if r.doc_id != 52) == sorted((repr(r.doc_id), r.text) for r in seen["near_duplicates"] if r.doc_id != 52)
    from collections import Counter

    times = Counter((r.doc_id, r.text) for r in seen["mix"])
    assert set(times) <= {(r.doc_id, r.text) for r in seen["private_data"]} and max(times.values()) == 2
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in seen["mix"]:
        ids = lib.encode(r.text)
        want.append((repr(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen["tokenize"]) == sorted(want)
    run = cp.run(spark, str(tmp_path / "sf"))
    assert sorted(map(repr, run.collect())) == sorted(map(repr, seen["tokenize"]))


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_empty_tables_and_extra_columns(spark, name, stage):
    docs = spark.createDataFrame([], SCHEMA + ", class_id string, lang_pred string, size string, ids string, spans string")
    out = stage(spark, docs, "")
    assert out.collect() == []
    assert name == "tokenize" or out.columns == list(cp.COLUMNS)
    assert zlib.crc32(b"") == 0
