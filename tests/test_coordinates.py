import base64
import hashlib
import random

from pyspark.sql import functions as F

from variantlake.operators import coordinates as C
from variantlake.operators import splice

FLIP = str.maketrans("ACGT", "TGCA")


def flip(s):
    return s.translate(FLIP)[::-1]


def keeper(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rounds")
    n = iter(range(10_000))

    def keep(df):
        path = f"{folder}/{next(n)}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    return keep


def world(seed, size=700):
    """A sequence with repeats, and two coding transcripts on either strand: chrom 1 from position 101."""
    rng = random.Random(seed)
    seq = "".join(rng.choice(["A", "C", "G", "T", "AAAA", "CACACA", "TTT"]) for _ in range(size))[:size]
    exons = {"T1": ("+", [(120, 180), (230, 261), (300, 420)]), "T2": ("-", [(450, 530), (560, 600), (640, 760)])}
    coding = {"T1": (140, 380), "T2": (470, 720)}
    seq = list(seq)
    for t, (strand, ex) in exons.items():  # begin with ATG, no stop but the last codon
        bases = [g for s, e in ex for g in range(s + 1, e + 1)]
        bases = bases if strand == "+" else bases[::-1]
        inside = [g for g in bases if coding[t][0] < g <= coding[t][1]]
        inside = inside[:len(inside) // 3 * 3]
        codons = ["ATG"] + [rng.choice(["GCA", "AAA", "CAC", "GAG", "TGG", "CTT", "AGA"]) for _ in range(len(inside) // 3 - 2)] + ["TAA"]
        for g, b in zip(inside, "".join(codons)):
            seq[g - 101] = b if strand == "+" else b.translate(FLIP)
    return "".join(seq), exons, coding


def frames(spark, seq, exons, coding):
    rows = [(t, "1", s, ",".join(str(a) for a, _ in ex) + ",", ",".join(str(b) for _, b in ex) + ",", *coding[t]) for t, (s, ex) in exons.items()]
    tx = spark.createDataFrame(rows, "transcript string, chrom string, strand string, exon_starts string, exon_ends string, cds_start long, cds_end long")
    regions = spark.createDataFrame([("1", 101, seq)], "chrom string, seq_start long, seq string")
    ex = splice.exons(tx)
    return ex, C.segments(ex), regions


def plain_names(exons, coding, t):
    """Each position of a transcript by walking its bases in order."""
    strand, ex = exons[t]
    bases = [g for s, e in ex for g in range(s + 1, e + 1)]
    bases = bases if strand == "+" else bases[::-1]
    step = 1 if strand == "+" else -1
    first = next(i for i, g in enumerate(bases) if coding[t][0] < g <= coding[t][1])
    last = max(i for i, g in enumerate(bases) if coding[t][0] < g <= coding[t][1])
    label = lambda i: str(i - first) if i < first else f"*{i - last}" if i > last else str(i - first + 1)
    out = {g: label(i) for i, g in enumerate(bases)}
    for i, (g, h) in enumerate(zip(bases, bases[1:])):
        gap = list(range(g + step, h, step))
        for k, x in enumerate(gap, 1):
            out[x] = f"{label(i)}+{k}" if k <= len(gap) + 1 - k else f"{label(i + 1)}-{len(gap) + 1 - k}"
    return out, bases, first


def test_positions_equal_a_walk(spark):
    seq, exons, coding = world(1)
    _, seg, _ = frames(spark, seq, exons, coding)
    points = spark.createDataFrame([("1", g) for g in range(101, 800)], "chrom string, pos long")
    got = {(r.transcript, r.pos): r.c for r in C.transcript_positions(points, seg, width=64).collect()}
    want = {(t, g): n for t in exons for g, n in plain_names(exons, coding, t)[0].items()}
    assert got == want


def writings(seq, pos, ref, alt):
    """All places at which the same pure edit of the same length gives the same sequence."""
    edited = seq[:pos - 101] + alt + seq[pos - 101 + len(ref):]
    n = max(len(ref), len(alt))
    out = []
    for p in range(101, 101 + len(seq) - len(ref) + 1):
        if ref and seq[:p - 101] + seq[p - 101 + n:] == edited:
            out.append((p, seq[p - 101:p - 101 + n], ""))
        if alt:
            a = edited[p - 101:p - 101 + n]
            if seq[:p - 101] + a + seq[p - 101:] == edited:
                out.append((p, "", a))
    return out


def edits(seq, seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.randint(102, 780)
        ref = seq[p - 101:p - 101 + rng.choice([0, 0, 1, 1, 2, 3, 6])]
        alt = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 1, 2, 3]))) if rng.random() < 0.6 else seq[p - 101:p - 101 + rng.choice([1, 2, 3])]
        out.append((i, "1", p, ref, alt))
    return out


def trimmed(p, r, a):
    while r and a and r[-1] == a[-1]:
        r, a = r[:-1], a[:-1]
    while r and a and r[0] == a[0]:
        p, r, a = p + 1, r[1:], a[1:]
    return p, r, a


def test_shifts_equal_all_writings(spark, tmp_path_factory):
    seq, exons, coding = world(2)
    _, _, regions = frames(spark, seq, exons, coding)
    rows = edits(seq, 5, 200) + [(900, "2", 5, "A", ""), (901, "1", 101, seq[0], ""), (902, "1", 801, "", seq[-1])]
    df = C.trim(spark.createDataFrame(rows, "id long, chrom string, pos long, ref string, alt string"))
    small = C.tiles(regions, 16, 4)  # many edits run over the edges of tiles
    keep = keeper(tmp_path_factory)
    for right in (False, True):
        got = {r.id: (r.pos, r.ref, r.alt) for r in C.shift(df, small, F.lit(right), keep).collect()}
        assert len(got) == len(rows)
        for i, chrom, p, r, a in rows:
            p, r, a = trimmed(p, r, a)
            if chrom == "1" and bool(r) != bool(a):
                found = writings(seq, p, r, a)
                assert got[i] == (max(found) if right else min(found)), (i, p, r, a)
            else:
                assert got[i] == (p, r, a)


def plain_change(seq, exons, coding, t, p, r, a):
    names, bases, first = plain_names(exons, coding, t)
    strand = exons[t][0]
    p, r, a = trimmed(p, r, a)
    if not r and not a:
        return "=", None
    if bool(r) != bool(a):
        found = writings(seq, p, r, a)
        p, r, a = max(found) if strand == "+" else min(found)
    on = (lambda s: s) if strand == "+" else flip
    span = lambda lo, hi: (lambda x, y: names[x] if x == y else f"{names[x]}_{names[y]}")(*((lo, hi) if strand == "+" else (hi, lo)))
    try:
        if not r:
            n = len(a)
            if strand == "+" and seq[p - 101 - n:p - 101] == a and p - n >= 101:
                return "c." + span(p - n, p - 1) + "dup", (p, r, a)
            if strand == "-" and seq[p - 101:p - 101 + n] == a:
                return "c." + span(p, p + n - 1) + "dup", (p, r, a)
            return "c." + span(p - 1, p) + "ins" + on(a), (p, r, a)
        if len(r) == len(a) == 1:
            return f"c.{names[p]}{on(r)}>{on(a)}", (p, r, a)
        return "c." + span(p, p + len(r) - 1) + ("del" if not a else "delins" + on(a)), (p, r, a)
    except KeyError:
        return None, None


def proteins(seq, exons, coding, t, edit):
    """Both proteins up to their first stop, by editing the transcript's bases, and whether the edit is within the coding bases."""
    names, bases, first = plain_names(exons, coding, t)
    strand = exons[t][0]
    p, r, a = edit
    spliced = {g: seq[g - 101] for g in bases}
    changed = dict(spliced)
    if r:
        for k, g in enumerate(range(p, p + len(r))):
            if g not in spliced:
                return None
            changed[g] = ""
        changed[p] = a
    else:
        if p not in spliced or p - 1 not in spliced:
            return None
        changed[p] = a + changed[p]
    text = lambda d: "".join(d[g] if strand == "+" else flip(d[g]) for g in bases[first:])
    def protein(s):
        out = ""
        for i in range(0, len(s) - 2, 3):
            out += C.CODONS[s[i:i + 3]]
            if out[-1] == "*":
                break
        return out
    return protein(text(spliced)), protein(text(changed))


def test_changes_and_proteins_equal_plain_ones(spark, tmp_path_factory):
    keep = keeper(tmp_path_factory)
    seq, exons, coding = world(3)
    ex, seg, regions = frames(spark, seq, exons, coding)
    rows = edits(seq, 6, 500)
    df = spark.createDataFrame(rows, "id long, chrom string, pos long, ref string, alt string")
    named = keep(C.cdna_names(df, seg, C.tiles(regions, 64, 8), keep, 64))
    got = C.protein_names(named, C.coding_sequences(ex, seg, regions)).collect()
    assert {(r.id, r.pos, r.ref, r.alt) for r in got} <= {(i, p, r, a) for i, _, p, r, a in rows}
    by = {(r.id, r.transcript): r for r in got}
    seen = {}
    for i, _, p, r, a in rows:
        for t in exons:
            want, edit = plain_change(seq, exons, coding, t, p, r, a)
            if want is None or (i, t) not in by and want == "=":
                continue
            assert (i, t) in by, (i, t, want)
            assert by[i, t].cdna == want, (i, t, want, by[i, t].cdna)
            if want == "=" or any(x in want.split("c.")[1].split("del")[0] for x in "*+") or "-" in want:
                continue
            two = proteins(seq, exons, coding, t, edit)
            if two is None:
                continue
            old, new = two
            name = by[i, t].protein
            if name is None:
                assert by[i, t].cds_pos > 3 * len(old), (want, name)
                continue
            kind = "=" if old == new else "fs" if "fs" in name else "Ter" if name.endswith("Ter)") else "other"
            seen[kind] = seen.get(kind, 0) + 1
            k = next((j for j, (x, y) in enumerate(zip(old, new)) if x != y), None)
            if old == new:
                assert name.endswith("=)"), (want, name)
            elif k == 0:
                assert name == "p.(Met1?)"
            elif "fs" in name:
                assert name == f"p.({C._LONG[old[k]]}{k + 1}{C._LONG[new[k]]}fsTer{len(new) - k if new[-1] == '*' else '?'})", (want, name)
            elif name.endswith("Ter)") and "delins" not in name and "ext" not in name:
                assert name == f"p.({C._LONG[old[k]]}{k + 1}Ter)" and new[k] == "*"
            elif "ext" not in name:
                assert applied(old, name) == new, (want, name, old, new)
    assert min(seen.get(k, 0) for k in ("fs", "other")) > 5 and seen.get("="), seen
    joined = C.SHARED_BASES
    C.SHARED_BASES = 0
    try:
        again = C.protein_names(named, C.coding_sequences(ex, seg, regions)).select("id", "transcript", "protein").collect()
    finally:
        C.SHARED_BASES = joined
    assert {(r.id, r.transcript): r.protein for r in again} == {k: r.protein for k, r in by.items()}


def applied(protein, name):
    """The protein that a name describes, up to its first stop."""
    import re

    short = {v: k for k, v in C._LONG.items()}
    letters = lambda s: "".join(short[x] for x in re.findall("[A-Z][a-z]{2}", s))
    body = name[3:-1]
    m = re.match(r"([A-Z][a-z]{2})(\d+)(?:_([A-Z][a-z]{2})(\d+))?(delins|del|dup|ins)?(.*)$", body)
    a, b = int(m[2]), int(m[4] or m[2])
    assert protein[a - 1] == short[m[1]] and (not m[3] or protein[b - 1] == short[m[3]])
    new = {"del": lambda: protein[:a - 1] + protein[b:], "dup": lambda: protein[:b] + protein[a - 1:b] + protein[b:], "ins": lambda: protein[:a] + letters(m[6]) + protein[b - 1:],
           "delins": lambda: protein[:a - 1] + letters(m[6]) + protein[b:], None: lambda: protein[:a - 1] + letters(m[6]) + protein[b:]}[m[5]]()
    return new[:new.index("*") + 1] if "*" in new else new


def test_known_protein_names():
    c = "ATGAAAAAACGTCAGTGGTAACCCTGA"
    name = lambda at, ref, alt: C.protein_name(c, at, ref, alt)
    assert name(10, "C", "A") == "p.(Arg4Ser)" and name(12, "T", "C") == "p.(Arg4=)" and name(13, "C", "T") == "p.(Gln5Ter)"
    assert name(1, "A", "G") == "p.(Met1?)" and name(19, "T", "C") == "p.(Ter7GlnextTer2)" and name(4, "AAA", "") == "p.(Lys3del)"
    assert name(10, "", "AAA") == "p.(Lys3dup)" and name(10, "CGT", "") == "p.(Arg4del)" and name(13, "", "TTT") == "p.(Arg4_Gln5insPhe)"
    assert name(10, "C", "") == "p.(Arg4ValfsTer?)" and name(5, "", "A") == "p.(Arg4ThrfsTer?)" and name(10, "G", "A") is None and name(40, "A", "C") is None
    assert name(4, "AAAAAACGT", "TGG") == "p.(Lys2_Arg4delinsTrp)" and C.protein_name(None, 1, "A", "C") is None


def test_published_digests(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.digest(F.lit(""))) == "z4PhNX7vuL3xVChQ1m2AB9Yg5AULVxXc" and one(C.digest(F.lit("ACGT"))) == "aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2"
    got = one(C.allele_digest(F.lit("IIB53T8CNeJJdUqzn9V_JnRtQadwWCbl"), F.lit(44908821), F.lit(44908822), F.lit("T")))
    assert got == "ga4gh:VA.EgHPXXhULTwoP4-ACfs-YCXaeUQJBjH_"


def test_allele_ids_are_equal_exactly_for_equal_edits(spark, tmp_path_factory):
    seq, exons, coding = world(4)
    regions = spark.createDataFrame([("1", 101, seq)], "chrom string, seq_start long, seq string")
    rng = random.Random(9)
    rows = []
    for i in range(150):
        p = rng.randint(110, 380)
        kind = rng.choice("dis")
        ref = seq[p - 101:p - 101 + rng.randint(1, 4)] if kind != "i" else seq[p - 101]
        alt = {"d": seq[p - 101], "i": ref + seq[p - 100:p - 101 + rng.randint(1, 4)], "s": rng.choice("ACGT")}[kind]
        rows.append((i, "1", p, ref, alt))
    df = spark.createDataFrame([*rows, (999, "X", 5, "A", "C")], "id long, chrom string, pos long, ref string, alt string")
    ids = spark.createDataFrame([("1", "SQ")], "chrom string, sequence_id string")
    got = C.allele_ids(df, C.tiles(regions, 32, 8), ids, keeper(tmp_path_factory))
    assert got.columns == [*df.columns, "allele_id"]
    by = {r.id: r.allele_id for r in got.collect()}
    assert by.pop(999) is None
    edited = {i: seq[:p - 101] + a + seq[p - 101 + len(r):] for i, _, p, r, a in rows}
    for i in by:
        for j in by:
            assert (by[i] == by[j]) == (edited[i] == edited[j]) or edited[i] == seq or edited[j] == seq

    def plain(i):  # all writings at once: what differs between the two sequences, widened over the repeat
        _, _, p, r, a = rows[i]
        p, r, a = trimmed(p, r, a)
        lo = hi = p
        if bool(r) != bool(a):
            found = [w[0] for w in writings(seq, p, r, a)]
            lo, hi = min(found), max(found)
        end = hi + len(r)
        state = edited[i][lo - 101:end - 101 + len(a) - len(r)]
        d = lambda s: base64.urlsafe_b64encode(hashlib.sha512(s.encode()).digest()[:24]).decode()
        location = d('{"interval":{"end":%d,"start":%d,"type":"SimpleInterval"},"sequence_id":"SQ","type":"SequenceLocation"}' % (end - 1, lo - 1))
        return "ga4gh:VA." + d('{"location":"%s","state":{"sequence":"%s","type":"SequenceState"},"type":"Allele"}' % (location, state))

    assert all(by[i] == plain(i) for i in by)
