"""From substitutions to classes, against plain loops over SURVEY A.7, on both strands."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_coordinates import FLIP

from variantlake.functions import numbers
from variantlake.operators import coordinates, splice

EXONS = {"T1": ("+", [(120, 180), (240, 300), (380, 470)]), "T2": ("-", [(600, 690), (740, 800), (860, 920)])}
REGIONS = [("T1", "domain", 130, 150), ("T1", "domain", 275, 299), ("T1", "grey_zone", 400, 420), ("T1", "after_grey_zone", 421, 440), ("T1", "utr", 110, 125), ("T2", "domain", 760, 775), ("T2", "domain", 796, 800), ("T2", "utr", 905, 930)]


def scorer(length, seed):
    rng = np.random.default_rng(seed)
    step = 3 if length == 9 else 4
    return numbers.WindowScorer(length, [(tuple(range(a, min(a + step, length))), rng.uniform(0.05, 20, 4 ** (min(a + step, length) - a)), 1) for a in range(0, length, step)])


SCORES = splice.SiteScores(scorer(9, 1), scorer(23, 2), (0.5, 2.5), (1.0, 3.0))


def plain(seq, t, pos, ref, alt, consequence, protein, capped):
    strand, exons = EXONS[t]
    sign = 1 if strand == "+" else -1
    order = exons if sign == 1 else exons[::-1]
    firsts = [s + 1 if sign == 1 else e for s, e in order]
    lasts = [e if sign == 1 else s + 1 for s, e in order]

    def around(at, before, after, change=False):
        out = ""
        for k in range(-before, after + 1):
            g = at + sign * k
            if not 101 <= g < 101 + len(seq):
                return None
            b = alt if change and g == pos else seq[g - 101]
            out += b if sign == 1 else b.translate(FLIP)
        return out

    one = lambda f, s, scale: None if s is None else (float(f([s])[0]) - scale[0]) / scale[1]
    d = lambda s: one(SCORES.donor, s, SCORES.donor_scale)
    a = lambda s: one(SCORES.acceptor, s, SCORES.acceptor_scale)
    if not min(s for s, _ in exons) < pos <= max(e for _, e in exons):
        return {"location": "outside_transcript", "prior": 0.99 if False else 0.02, "class": "class_2"}
    i = max(k for k in range(3) if k == 0 or sign * (pos - (firsts[k] - sign * 20)) >= 0)
    last = i == 2
    kinds = {k for tx, k, s, e in REGIONS if tx == t and s <= pos <= e}
    in_exon = any(s < pos <= e for s, e in exons)
    donor = any(-2 <= sign * (pos - lasts[k]) <= 6 for k in range(2))
    acceptor = any(-20 <= sign * (pos - firsts[k]) <= 2 for k in (1, 2))
    if in_exon:
        location = ("domain_donor" if donor else "domain_acceptor" if acceptor else "domain") if "domain" in kinds else "donor" if donor else "acceptor" if acceptor else next((k for k in ("grey_zone", "after_grey_zone", "utr") if k in kinds), "exon")
    else:
        location = "donor" if donor else "acceptor" if acceptor else "utr" if "utr" in kinds else "intron"
    dr, da = (None, None) if last else (d(around(lasts[i], 2, 6)), d(around(lasts[i], 2, 6, True)))
    ar, aa = (None, None) if i == 0 else (a(around(firsts[i], 20, 2)), a(around(firsts[i], 20, 2, True)))
    windows = []
    for k in range(9):
        before, after = around(pos + sign * (k - 8), 0, 8), around(pos + sign * (k - 8), 0, 8, True)
        if after is not None and around(pos, 8, 8) is not None:
            windows.append((float(SCORES.donor([after])[0]), -k, before))
    new = None
    if windows:
        mes, k, before = max(windows)
        k = -k
        nr, na = d(before), (mes - SCORES.donor_scale[0]) / SCORES.donor_scale[1]
        at = pos + sign * (k + 2 - 8)
        frame = not last and (at - lasts[i]) % 3 == 0
        lost = False
        if not last:
            span = {at + sign * x for x in range(1, sign * (lasts[i] - at) + 1)} if sign * (lasts[i] - at) > 0 else {lasts[i] + sign * x for x in range(1, sign * (at - lasts[i]) + 1)}
            lost = any(tx == t and kind == "domain" and any(s <= g <= e for g in span) for tx, kind, s, e in REGIONS)
        exonic = 8 - k < 3
    closest = (da if "donor" in location else dr)
    cut = lambda p, top: 0.5 if capped and p == top else p

    def site(r, x, weak, strong, gone):
        if r is None or x is None:
            return None
        if x >= r:
            return 0.04
        if r < weak and r - x > 0.5:
            return cut(0.97, 0.97)
        if r < weak and r - x < 0.5:
            return 0.34
        return 0.04 if x > strong else 0.34 if x >= gone else cut(0.97, 0.97)

    reference = site(dr, da, -1.5, 0.0, -2.0) if "donor" in location else site(ar, aa, -1.0, 0.5, -1.5) if "acceptor" in location else None
    fresh = None
    if windows and not last:
        step = 0 if na <= nr or na < -2 else 1 if na < 0 else 2
        if na > nr and closest is not None and na > closest:
            step = min(step + 1, 2)
        fresh = 0.02 if frame and not lost or step == 0 else 0.3 if step == 1 else cut(0.64, 0.64)
    rescued = False
    if consequence == "stop_gained" and not last and windows and not exonic and frame and not lost and na > nr and mes >= 6.2:
        rescued = mes > 8.5 or (dr is not None and na > dr)
    most = lambda *x: max((y for y in x if y is not None), default=None)
    if consequence == "stop_gained" and (location in ("exon", "domain", "domain_donor", "domain_acceptor") or location in ("donor", "acceptor") and in_exon):
        prior = None if rescued else 0.5 if capped else 0.99
    elif "donor" in location:
        prior = most(fresh, reference, protein)
    elif "acceptor" in location:
        prior = most(fresh, reference, protein) if in_exon else reference
    elif location in ("exon", "domain"):
        prior = most(protein, fresh)
    elif location == "grey_zone":
        prior = 0.5 if protein is not None and protein >= 0.99 else protein
    elif location == "after_grey_zone":
        prior = None
    elif location == "utr":
        prior = fresh if in_exon and fresh is not None else 0.02
    else:
        prior = None if windows and (na > nr or dr is not None and na > dr) else 0.02
    label = "class_2" if prior is None else "class_5" if prior >= 0.99 else "class_4" if prior >= 0.95 else "class_1" if prior < 0.001 else "class_2" if prior < 0.05 else "class_3"
    return {"location": location, "prior": prior, "class": label, "rescued": rescued, "donor_ref_z": dr, "donor_alt_z": da, "acceptor_alt_z": aa, "reference_prior": reference, "de_novo_prior": fresh, "exon": i + 1}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(12)
    seq = "".join(rng.choice("ACGT") for _ in range(880))
    rows = []
    for t, positions in (("T1", range(101, 500)), ("T2", range(580, 981))):
        for pos in positions:
            if pos - 101 < len(seq):
                ref = seq[pos - 101]
                alt = rng.choice([b for b in "ACGT" if b != ref])
                rows.append((len(rows), t, "1", pos, ref, alt, rng.choice(["missense", "stop_gained", None]), rng.choice([None, 0.01, 0.3, 0.99])))
    tx = spark.createDataFrame([(t, "1", s, ",".join(str(a) for a, _ in ex), ",".join(str(b) for _, b in ex)) for t, (s, ex) in EXONS.items()], "transcript string, chrom string, strand string, exon_starts string, exon_ends string")
    regions = spark.createDataFrame(REGIONS, "transcript string, kind string, start long, end long")
    tiles = coordinates.tiles(spark.createDataFrame([("1", 101, seq)], "chrom string, seq_start long, seq string"), 64, 32)
    df = spark.createDataFrame([*rows, (99999, "T9", "1", 5, "A", "C", None, None)], "id int, transcript string, chrom string, pos long, ref string, alt string, consequence string, protein_prior double")
    got = splice.splice_priors(df, splice.exons(tx), regions, tiles, SCORES, (F.col("transcript") == "T1") & (F.col("exon") == 2), 64).collect()
    return seq, rows, {r.id: r for r in got}, len(got)


def test_priors_and_classes_equal_plain_loops(scored):
    seq, rows, by, n = scored
    assert n == len(rows) + 1 and by[99999].location == "outside_transcript" and by[99999].prior == 0.02
    seen = {}
    for i, t, _, pos, ref, alt, consequence, protein in rows:
        capped = t == "T1" and 221 <= pos <= 360  # the second exon's zone
        want = plain(seq, t, pos, ref, alt, consequence, protein, capped)
        for k, v in want.items():
            x = by[i][k]
            assert x is v is None or x == v or isinstance(v, float) and x is not None and abs(x - v) < 1e-9, (t, pos, k, v, x, want, by[i])
        seen[want["location"]] = seen.get(want["location"], 0) + 1
    assert len(seen) >= 11 and len({want for want in (r.prior for r in by.values())}) >= 7, seen


def test_parts_of_the_rules(spark):
    one = lambda **c: spark.range(1).select(*[x.alias(k) for k, x in c.items()]).first().asDict()
    f = F.lit
    kind = lambda r, a: splice.variant_type(f(r), f(a))
    assert list(one(a=kind("A", "C"), b=kind("A", "AC"), c=kind("AC", "A"), d=kind("AC", "GT"), e=kind("A", "CG")).values()) == ["substitution", "insertion", "deletion", "delins", "delins"]
    assert one(a=splice.same_frame(f(-1), f(2)), b=splice.same_frame(f(4), f(6))) == {"a": True, "b": False}
    save = lambda last=False, exonic=False, frame=True, lost=False, div=True, ref=0.0, alt=1.0, mes=9.0, close=5.0: splice.rescue(*map(f, (last, exonic, frame, lost, div, ref, alt, mes, close)))
    cases = {"ok": (save(), True), "last": (save(last=True), False), "exonic": (save(exonic=True), False), "frame": (save(frame=False), False), "lost": (save(lost=True), False), "div": (save(div=False), False),
             "weaker": (save(alt=0.0), False), "low": (save(mes=6.1), False), "middle": (save(mes=7.0), False), "closer": (save(mes=7.0, close=0.5), True)}
    assert one(**{k: c for k, (c, _) in cases.items()}) == {k: w for k, (_, w) in cases.items()}
    ok = lambda change, r, a, s: splice.consistent_edit(f(change), f(r), f(a), f(s))
    got = one(a=ok("c.5A>T", "A", "T", "+"), b=ok("c.5A>T", "T", "A", "-"), c=ok("c.5A>T", "A", "T", "-"), d=ok("c.5_6delCG", "ACG", "A", "+"), e=ok("c.5_6delCG", "ACG", "A", "-"), g=ok("c.5_6insTT", "A", "AAA", "-"), h=ok("c.5dup", "A", "AA", "+"))
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": True, "g": True, "h": None}
    site = lambda r, a, donor=True, cap=False: splice.reference_site_prior(f(r), f(a), donor, f(cap))
    got = one(a=site(1.0, 1.0), b=site(-1.75, -2.5), c=site(-1.75, -2.0), e=site(1.0, 0.25), g=site(1.0, -2.0), h=site(1.0, -2.25), i=site(1.0, -2.25, cap=True), j=site(0.0, -1.75, False), k=site(-1.75, -2.25))
    assert got == {"a": 0.04, "b": 0.97, "c": 0.34, "e": 0.04, "g": 0.34, "h": 0.97, "i": 0.5, "j": 0.97, "k": 0.97}
    table = spark.createDataFrame([("G", "p.(A1C)", "0.81"), ("G", "A1C", "0.03"), ("G", "A1C", "0.03"), ("G", "bad", "x")], "gene string, change string, prior string")
    v = spark.createDataFrame([(1, "G", "p.(A1C)", "A1C"), (2, "G", "none", "A1C"), (3, "H", "p.(A1C)", "A1C"), (4, "G", "bad", None)], "id int, g string, c string, o string")
    assert {r.id: r.protein_prior for r in splice.protein_prior(v, table, "g", "c", "o").collect()} == {1: 0.81, 2: 0.03, 3: None, 4: None}
