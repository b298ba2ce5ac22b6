import gzip
import hashlib
import io
import re

import pytest
from pyspark.sql import functions as F

from variantlake.llm import pii, warc
from variantlake.llm.common import Workspace


def test_round_trip(spark, work, monkeypatch):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "http://a", big, 0), (5, "http://b", big, 0), (3, None, big, 0), (4, "http://c\nd", other, 0), (6, "u", other, 0), (7, "u", None, 0), (8, "u", "", 0), (None, "n", "z" * 2000, 0), (9, "u", "y" * 3_000_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    got = {r.page_id: r for r in warc.warc_round_trip(df, work).collect()}
    assert len(got) == len(rows) and all(r.digest_ok for r in got.values())
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest()
    assert [got[i].record_type for i in (1, 3, 5)] == ["revisit", "revisit", "response"]
    assert got[1].refers_to == got[3].refers_to == 5 and got[5].refers_to is None
    assert {got[i].record_type for i in (4, 6, 7, 8, None, 9)} == {"response"}
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    again = warc.warc_round_trip(df, Workspace(spark, "again")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got.values()))
    assert warc.warc_round_trip(df.limit(0), Workspace(spark, "none")).collect() == []


def test_one_member_per_record_and_broken_archives():
    data = b"".join(warc.encode_record("response", f"<urn:page:{i}>", "u", "d", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, i) for i in range(3))
    found = [warc.parse_record(m) for m in warc.members(io.BytesIO(data))]
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == [b"", b"p", b"pp"]
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        warc.parse_record(gzip.decompress(data)[:-9])


def test_archives_cut_between_members_are_found(spark, tmp_path):
    parts = [warc.encode_record("response", f"<urn:page:{i}>", "u", "d", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, i) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:2]))
    paths = lambda n: spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", n)], "path string, records long")
    assert warc.read_archives(paths(2)).count() == warc.read_archives(paths(None)).count() == 2
    with pytest.raises(Exception, match="2 records, not 3"):
        warc.read_archives(paths(3)).count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii._luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_plain_patterns():
    import random

    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice(["@", ".", "-", " ", "+", "(", ")", "a", "b.", "%", "1", "25", "4111111111111111", "é", "٣", "@x.y", "1.2.3.4", "+1 (988) 555-2485"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_are_scanned_in_linear_time():
    for t in ("1" * 300_000, "a@" * 150_000, "1." * 150_000, "a" * 300_000 + "@", "+1" * 100_000, "@" * 300_000):
        pii.items(t, pii.base_spans(t))


def test_candidates_hold_blanks_and_marks():
    found = lambda t: [t[s:e] for s, e in pii._candidates(t, pii.base_spans(t))]
    assert found("call 555 123 4567, or (555) 123-4567 now") == ["555 123 4567", "(555) 123-4567"]
    assert found("id 4111 1111 1111 1112; a1b2c3d4 x@y; 12 34 56") == ["4111 1111 1111 1112", "a1b2c3d4"]
    assert found("mail a@b.co 0555/0101234") == ["0555/0101234"]
    assert found("1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2") == [] == found("")


def test_bootstrap_with_half_of_the_instances_unseen(spark, work):
    known = [(i, f"please reach my desk at phone +1 (555) 010-{1000 + i} during the day") for i in range(10)]
    unseen = [(100 + i, f"please reach my desk at phone 555 010 {2000 + i} during the day") for i in range(10)]
    clean = [(200 + i, f"the sum of all parts was 555 010 {3000 + i} in total") for i in range(10)]
    df = spark.createDataFrame(known + unseen + clean, "doc_id long, text string")
    by = {r.doc_id: r for r in pii.find_private(df, work).select("doc_id", pii.spans_text(F.col("spans")).alias("spans")).collect()}
    assert all(by[i].spans.startswith("phone:30:") and by[i].spans.count(":") == 2 for i, _ in known + unseen)
    assert all(by[i].spans == "" for i, _ in clean)


def test_bootstrap_finds_unseen_identifiers(spark, work):
    known = [(i, f"please mail your answer to reach me under phone +1 (555) 010-{1000 + i} thanks a lot") for i in range(12)]
    rows = known + [(100, "you can reach me under phone 0555/0101234 thanks"), (101, "the year 20241231 was fine"), (102, None), (None, "x@y.de"), (103, ""), (104, "a@b.co " * 2), (104, "a@b.co " * 2)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, spans string")
    got = pii.find_private(df, work).select("doc_id", pii.spans_text(F.col("base")).alias("base"), pii.spans_text(F.col("spans")).alias("spans")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[100].base == "" and by[100].spans == "phone:29:41"
    assert by[101].spans == by[102].spans == by[103].spans == "" and by[None].spans == "email:0:6"
    assert by[104].spans == "email:0:6,email:7:13"
    red = {r.doc_id: r.text for r in pii.redact(df, work).collect()}
    assert red[100] == "you can reach me under phone [PHONE] thanks" and red[102] is None and red[101] == rows[13][1]
    assert red[None] == "[EMAIL]" and pii.find_private(df.limit(0), work).collect() == []


def _hop(k):
    """Phone-like numbers of group k, each in a context of the group before it and in one of its own."""
    shape = lambda i: f"555 0{k} {20 + k}{10 + i:02d} {i:02d}"
    return [shape(i) for i in range(8)]


def test_bootstrap_goes_on_until_nothing_is_new(spark, work):
    names = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]
    rows = [f"ring me under {names[0]} line: +1 (555) 010-{1000 + i} today" for i in range(10)]
    for k in range(6):
        for number in _hop(k):
            rows.append(f"ring me under {names[k]} line: {number} today")
            rows.append(f"ring me under {names[k + 1]} line: {number} today")
    got = pii.find_private(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), work)
    spans = {r.doc_id: r.spans for r in got.select("doc_id", pii.spans_text(F.col("spans")).alias("spans")).collect()}
    assert all(spans[i].startswith("phone:") for i in range(len(rows))), [rows[i] for i in range(len(rows)) if not spans[i]]


def plain_bootstrap(texts):
    """The same graph in plain loops: trust of patterns, noisy-or of instances, until nothing is new."""
    import math
    from collections import defaultdict

    known, edges = defaultdict(set), defaultdict(set)
    for t in texts:
        for kind, _, _, inst, patterns in pii.items(t, pii.base_spans(t)):
            if kind:
                known[inst].add(kind)
            for p in patterns:
                edges[p].add(inst)
    while True:
        trust = {}
        for p, instances in edges.items():
            told = defaultdict(int)
            for i in instances:
                for k in known.get(i, ()):
                    told[k] += 1
            all_told = sum(told.values())
            for k, n in told.items():
                if n >= pii.MIN_SEEDS and n / (all_told + pii.UNKNOWN * max(len(instances) - all_told, 0)) >= pii.MIN_PATTERN:
                    trust[p, k] = n / (all_told + pii.UNKNOWN * max(len(instances) - all_told, 0))
        score = defaultdict(float)
        for (p, k), t in trust.items():
            for i in edges[p]:
                if i not in known:
                    score[i, k] += math.log(max(1 - t, 1e-9))
        new = {}
        for (i, k), s in score.items():
            if 1 - math.exp(s) >= pii.MIN_INSTANCE and (1 - math.exp(s), k) > new.get(i, (0, "")):
                new[i] = (1 - math.exp(s), k)
        if not new:
            return {i: min(k) for i, k in known.items()}
        for i, (_, k) in new.items():
            known[i].add(k)


def test_added_spans_equal_plain_loops(spark, work):
    import random

    rng = random.Random(11)
    verbs, places = ["ring", "mail", "pay", "reach"], ["desk", "home", "office", "shop"]
    numbers = [f"+1 (555) 01{i % 10}-{1000 + i}" for i in range(25)] + [f"555 01{i % 10} {1000 + i}" for i in range(25)] + [f"u{i}x{7000 + i}" for i in range(20)] + [f"{i}.1.2.{i}" for i in range(10)]
    texts = [" ".join(f"{rng.choice(verbs)} the {rng.choice(places)} {rng.choice(['at', 'by', 'no'])} {rng.choice(numbers)} now" for _ in range(rng.randint(1, 4))) for _ in range(150)]
    want = plain_bootstrap(texts)
    got = pii.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), work).collect()
    added = 0
    for r in got:
        base = pii.base_spans(texts[r.doc_id])
        more = {(want[x], s, e) for kind, s, e, x, _ in pii.items(texts[r.doc_id], base) if kind is None and x in want}
        added += len(more)
        assert {tuple(s) for s in r.spans} == set(base) | more
    assert added > 20


def test_one_very_long_text_through_spark(spark, work):
    text = "1234567a" * 150_000 + " phone +1 (555) 010-1234 and a@b.co " + "word " * 200_000
    got = pii.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), work).collect()
    assert [s["kind"] for s in got[0].spans] == ["email", "phone"]
