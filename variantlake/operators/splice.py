"""Splice evidence: variant types, locations against transcript structure, site and de novo priors, classes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as M
from ..functions import text as T
from . import ranges as X

# Prior probabilities and score limits.
LOW, REFERENCE_LOW, DE_NOVO_MEDIUM, MODERATE, CAP, DE_NOVO_HIGH, HIGH, PATHOGENIC = 0.02, 0.04, 0.3, 0.34, 0.5, 0.64, 0.97, 0.99
DONOR_WEAK, DONOR_STRONG, DONOR_LOST = -1.5, 0.0, -2.0
ACCEPTOR_WEAK, ACCEPTOR_STRONG, ACCEPTOR_LOST = -1.0, 0.5, -1.5
DE_NOVO_LOW_Z, DE_NOVO_HIGH_Z, LEAST_GAIN = -2.0, 0.0, 0.5
RESCUE_LOW, RESCUE_HIGH = 6.2, 8.5
DONOR_EXONIC, DONOR_INTRONIC, ACCEPTOR_INTRONIC, ACCEPTOR_EXONIC = 3, 6, 20, 3


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r == 1) & (a == 1), "substitution").when((r == 1) & (a > 1) & (F.left(alt, F.lit(1)) == ref), "insertion")
        .when((a == 1) & (r > 1) & (F.left(ref, F.lit(1)) == alt), "deletion").otherwise("delins")
    )


def exons(transcripts: DataFrame) -> DataFrame:
    """One row per exon of transcripts (transcript, strand, exon_starts, exon_ends as comma lists), numbered in
    transcript order, with first and last marked."""
    pair = F.arrays_zip(F.split(F.regexp_replace("exon_starts", ",$", ""), ",").alias("s"), F.split(F.regexp_replace("exon_ends", ",$", ""), ",").alias("e"))
    rows = transcripts.select("*", F.size(pair).alias("n_exons"), F.posexplode(pair).alias("i", "x")).select(
        *[c for c in transcripts.columns if c not in ("exon_starts", "exon_ends")], "n_exons", "i", F.col("x.s").cast("long").alias("start"), F.col("x.e").cast("long").alias("end"))
    number = F.when(F.col("strand") == "-", F.col("n_exons") - F.col("i")).otherwise(F.col("i") + 1)
    return rows.withColumns({"exon": number}).withColumns({"is_first": F.col("exon") == 1, "is_last": F.col("exon") == F.col("n_exons")}).drop("i")


def sites(exon_rows: DataFrame) -> DataFrame:
    """Donor and acceptor regions of each exon as closed ranges; the last exon has no donor, the first no acceptor.

    An exon covers start < position <= end.
    """
    plus = F.col("strand") != "-"
    donor = F.when(plus, F.struct((F.col("end") - DONOR_EXONIC + 1).alias("s"), (F.col("end") + DONOR_INTRONIC).alias("e"))).otherwise(
        F.struct((F.col("start") - DONOR_INTRONIC + 1).alias("s"), (F.col("start") + DONOR_EXONIC).alias("e")))
    acceptor = F.when(plus, F.struct((F.col("start") - ACCEPTOR_INTRONIC + 1).alias("s"), (F.col("start") + ACCEPTOR_EXONIC).alias("e"))).otherwise(
        F.struct((F.col("end") - ACCEPTOR_EXONIC + 1).alias("s"), (F.col("end") + ACCEPTOR_INTRONIC).alias("e")))
    both = F.array(
        F.when(~F.col("is_last"), F.struct(F.lit("donor").alias("site"), donor.alias("r"))),
        F.when(~F.col("is_first"), F.struct(F.lit("acceptor").alias("site"), acceptor.alias("r"))),
    )
    found = exon_rows.select("transcript", "strand", "exon", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"))
    return found.select("transcript", "strand", "exon", "x.site", F.col("x.r.s").alias("start"), F.col("x.r.e").alias("end"))


def locate(variants: DataFrame, exon_rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds in_exon, in_donor, in_acceptor and one flag per kind of ``regions`` (transcript, kind, start, end), and
    ``location``.

    Structures are small per transcript, so they are held as arrays and met by transcript, without a range join; Spark
    broadcasts them where their size is small.
    """
    ex = exon_rows.groupBy("transcript").agg(F.collect_list(F.struct("start", "end", "exon")).alias("_exons"), F.min("start").alias("_tx_start"), F.max("end").alias("_tx_end"))
    st = sites(exon_rows).groupBy("transcript").agg(F.collect_list(F.struct("site", "start", "end")).alias("_sites"))
    rg = regions.groupBy("transcript").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_regions"))
    v = variants.join(ex, "transcript", "left").join(st, "transcript", "left").join(rg, "transcript", "left")
    p = F.col("pos")
    inside = lambda arr, cond: F.coalesce(F.exists(arr, cond), F.lit(False))
    closed = lambda r: p.between(r["start"], r["end"])
    v = v.withColumns({
        "in_exon": inside("_exons", lambda r: (r["start"] < p) & (p <= r["end"])),
        "in_donor": inside("_sites", lambda r: (r["site"] == "donor") & closed(r)),
        "in_acceptor": inside("_sites", lambda r: (r["site"] == "acceptor") & closed(r)),
        "in_domain": inside("_regions", lambda r: (r["kind"] == "domain") & closed(r)),
        "in_grey": inside("_regions", lambda r: (r["kind"] == "grey_zone") & closed(r)),
        "after_grey": inside("_regions", lambda r: (r["kind"] == "after_grey_zone") & closed(r)),
        "in_utr": inside("_regions", lambda r: (r["kind"] == "utr") & closed(r)),
        "in_transcript": F.coalesce((p > F.col("_tx_start")) & (p <= F.col("_tx_end")), F.lit(False)),
    })
    c = F.col
    location = (
        F.when(~c("in_transcript"), "outside_transcript")
        .when(c("in_exon") & c("in_domain") & c("in_donor"), "domain_donor").when(c("in_exon") & c("in_domain") & c("in_acceptor"), "domain_acceptor")
        .when(c("in_exon") & c("in_domain"), "domain").when(c("in_exon") & c("in_donor"), "donor").when(c("in_exon") & c("in_acceptor"), "acceptor")
        .when(c("in_exon") & c("in_grey"), "grey_zone").when(c("in_exon") & c("after_grey"), "after_grey_zone")
        .when(c("in_exon") & c("in_utr"), "utr").when(c("in_exon"), "exon")
        .when(c("in_donor"), "donor").when(c("in_acceptor"), "acceptor").when(c("in_utr"), "utr").otherwise("intron")
    )
    return v.withColumn("location", location).drop("_exons", "_sites", "_regions", "_tx_start", "_tx_end")


def same_frame(a: Column, b: Column) -> Column:
    return F.pmod(a, F.lit(3)) == F.pmod(b, F.lit(3))


def reference_site_prior(ref_z: Column, alt_z: Column, donor: bool, capped: Column) -> Column:
    """Prior that a variant harms a reference site, by the z scores of the site without and with it."""
    weak, strong, lost = (DONOR_WEAK, DONOR_STRONG, DONOR_LOST) if donor else (ACCEPTOR_WEAK, ACCEPTOR_STRONG, ACCEPTOR_LOST)
    drop = ref_z - alt_z
    prior = (
        F.when(alt_z >= ref_z, REFERENCE_LOW).when((ref_z < weak) & (drop > LEAST_GAIN), HIGH).when((ref_z < weak) & (drop < LEAST_GAIN), MODERATE)
        .when(alt_z > strong, REFERENCE_LOW).when(alt_z >= lost, MODERATE).otherwise(HIGH)
    )
    return F.when(capped & (prior == HIGH), CAP).otherwise(prior)


def de_novo_donor_prior(ref_z: Column, alt_z: Column, closest_z: Column, in_frame_and_safe: Column, capped: Column) -> Column:
    """Prior that a variant makes a new donor: by its z score, one step more if it beats the closest site, and the
    least if the new exon stays in frame without losing a domain."""
    step = F.when(alt_z <= ref_z, 0).when(alt_z < DE_NOVO_LOW_Z, 0).when(alt_z < DE_NOVO_HIGH_Z, 1).otherwise(2)
    promoted = F.when((alt_z > ref_z) & F.coalesce(alt_z > closest_z, F.lit(False)), F.least(step + 1, F.lit(2))).otherwise(step)
    prior = F.when(in_frame_and_safe | (promoted == 0), LOW).when(promoted == 1, DE_NOVO_MEDIUM).otherwise(DE_NOVO_HIGH)
    return F.when(capped & (prior == DE_NOVO_HIGH), CAP).otherwise(prior)


def rescue(is_last_exon: Column, in_exonic_part: Column, in_frame: Column, loses_domain: Column, divisible: Column, ref_z: Column, alt_z: Column, alt_mes: Column, closest_z: Column) -> Column:
    """Whether splicing at a new site rescues a truncation; any condition against it decides."""
    against = is_last_exon | in_exonic_part | ~in_frame | loses_domain | ~divisible | (alt_z <= ref_z) | (alt_mes < RESCUE_LOW)
    return F.when(against, False).when(alt_mes > RESCUE_HIGH, True).otherwise(F.coalesce(alt_z > closest_z, F.lit(False)))


def applicable_prior(location: Column, consequence: Column, protein: Column, reference: Column, de_novo: Column, rescued: Column, capped: Column, in_exon: Column, beats_reference: Column) -> Column:
    """The prior that applies at a location; NULL where none does. Missing parts are skipped, never taken as largest."""
    at_donor, at_acceptor = location.isin("donor", "domain_donor"), location.isin("acceptor", "domain_acceptor")
    truncating = (consequence == "stop_gained") & (location.isin("exon", "domain", "domain_donor", "domain_acceptor") | (location.isin("donor", "acceptor") & in_exon))
    stop = F.when(rescued, F.lit(None).cast("double")).when(capped, CAP).otherwise(PATHOGENIC)
    grey = F.when(protein >= PATHOGENIC, CAP).otherwise(protein)
    none = F.lit(None).cast("double")
    return (
        F.when(truncating, stop).when(location == "outside_transcript", LOW).when(at_donor, F.greatest(de_novo, reference, protein))
        .when(at_acceptor & ~in_exon, F.greatest(reference, none)).when(at_acceptor, F.greatest(de_novo, protein, reference))
        .when(location.isin("exon", "domain"), F.greatest(protein, de_novo)).when(location == "grey_zone", grey).when(location == "after_grey_zone", none)
        .when((location == "utr") & in_exon & de_novo.isNotNull(), de_novo).when(location == "utr", LOW).when(beats_reference, none).otherwise(LOW)
    )


def prior_class(p: Column) -> Column:
    return F.when(p >= 0.99, "class_5").when(p >= 0.95, "class_4").when(p < 0.001, "class_1").when(p < 0.05, "class_2").when(p.isNotNull(), "class_3").otherwise("class_2")


# -- from variants to classes ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class SiteScores:
    """How windows of nine (three of the exon, six of the intron) and 23 bases (twenty and three) are scored, and the mean
    and standard deviation by which scores become z scores."""

    donor: Callable[[list[str | None]], np.ndarray]
    acceptor: Callable[[list[str | None]], np.ndarray]
    donor_scale: tuple[float, float]
    acceptor_scale: tuple[float, float]


def zones(exon_rows: DataFrame) -> DataFrame:
    """One row per exon with the stretch it answers for, lo to hi: from its acceptor region to before that of the next exon.

    ``donor_at`` is its last base in transcript order, ``acceptor_at`` its first; the last exon has no donor, the first
    no acceptor. Every position of a transcript lies in one zone.
    """
    order = W.partitionBy("transcript").orderBy("exon")
    plus = F.col("strand") != "-"
    first, last = F.when(plus, F.col("start") + 1).otherwise(F.col("end")), F.when(plus, F.col("end")).otherwise(F.col("start") + 1)
    z = exon_rows.withColumns({"_first": first, "_last": last})
    begin = lambda at: F.when(plus, at - ACCEPTOR_INTRONIC).otherwise(at + ACCEPTOR_INTRONIC)
    head = F.when(F.col("is_first"), F.col("_first")).otherwise(begin(F.col("_first")))
    tail = F.when(F.col("is_last"), F.col("_last")).otherwise(F.when(plus, begin(F.lead("_first").over(order)) - 1).otherwise(begin(F.lead("_first").over(order)) + 1))
    z = z.withColumns({"_head": head, "_tail": tail})
    return z.select(
        "transcript", "chrom", "strand", "exon", "is_last", F.least("_head", "_tail").alias("lo"), F.greatest("_head", "_tail").alias("hi"),
        F.when(~F.col("is_last"), F.col("_last")).alias("donor_at"), F.when(~F.col("is_first"), F.col("_first")).alias("acceptor_at"), (F.col("end") - F.col("start")).alias("exon_size"))


def _cut(bases: str, origin: str, strand: str, at: str, before: int, after: int) -> Column:
    """Bases around a position in transcript order, null where they leave the sequence."""
    low = f"{at} - (case when {strand} = '-' then {after} else {before} end)"
    size = before + after + 1
    text = F.expr(f"substring({bases}, cast({low} - {origin} + 1 as int), {size})")
    text = F.when(F.expr(f"{low} >= {origin}") & (F.length(text) == size), text)
    return F.when(F.col(strand) == "-", T.reverse_complement(text)).otherwise(text)


def _swap(window: Column, place: Column, base: Column) -> Column:
    """The window with another base at a place from 0, where that lies inside."""
    inside = (place >= 0) & (place < F.length(window))
    return F.when(inside, F.concat(F.substring(window, F.lit(1), place), base, F.substring(window, place + 2, F.length(window)))).otherwise(window)


def splice_priors(variants: DataFrame, exon_rows: DataFrame, regions: DataFrame, sequence_tiles: DataFrame, scores: SiteScores, capped: Column, width: int = 1 << 14) -> DataFrame:
    """From single-base substitutions to priors and classes.

    ``variants`` hold transcript, chrom, pos, ref, alt, consequence and protein_prior; ``exon_rows`` those of ``exons`` with
    chrom; ``regions`` transcript, kind, start, end as in ``locate``; ``capped`` tells by the variant's columns and ``exon``
    where the highest priors are cut. Adds location, exon, the z scores of the sites and of the best new donor with and
    without the variant, de_novo_acceptor_z, the parts of the prior, ``rescued``, ``prior`` and ``class``.

    Each variant meets its zone and its sequence tile by key, then all its windows are scored as two arrays: its exon's
    donor as it is and as changed and the nine donor windows over the variant before and after, and alike for acceptors.
    The best new donor is the highest changed window, the first of equal ones. A new donor is in frame if it lies a
    multiple of three bases from the exon's own; it is safe if no domain lies between. Windows that leave the sequence
    have no score and take no part; variants on no transcript are ``outside_transcript``.
    """
    v = locate(variants, exon_rows, regions).withColumn("_row", F.monotonically_increasing_id())
    z = zones(exon_rows).drop("chrom", "strand").withColumnRenamed("transcript", "_tx")
    cells = X.with_cells(z, F.col("lo"), F.col("hi"), width)
    v = v.withColumn("_at", F.floor(F.col("pos") / width)).join(cells, (F.col("transcript") == F.col("_tx")) & (F.col("_at") == F.col("_cell")) & F.col("pos").between(F.col("lo"), F.col("hi")), "left").drop("_tx", "_at", "_cell", "lo", "hi")
    strands = exon_rows.select(F.col("transcript").alias("_tx"), F.col("strand").alias("_strand")).distinct()
    v = v.join(strands, F.col("transcript") == F.col("_tx"), "left").drop("_tx")
    size = sequence_tiles.select("size").first()[0]
    t = sequence_tiles.select(F.col("chrom").alias("_chrom"), "tile", "origin", "bases")

    def met(df: DataFrame, at: str, cuts: dict[str, tuple[int, int]], how: str = "left") -> DataFrame:
        m = df.join(t, (F.col("chrom") == F.col("_chrom")) & (F.floor(F.col(at) / size) == F.col("tile")), how)
        return m.withColumns({name: _cut("bases", "origin", "_strand", at, *around) for name, around in cuts.items()}).drop("_chrom", "tile", "origin", "bases")

    near = DONOR_EXONIC + DONOR_INTRONIC - 1
    far = ACCEPTOR_INTRONIC + ACCEPTOR_EXONIC - 1
    v = met(v, "pos", {"_near": (near, near), "_far": (far, far)})
    v = met(v, "donor_at", {"_donor": (DONOR_EXONIC - 1, DONOR_INTRONIC)})
    v = met(v, "acceptor_at", {"_acceptor": (ACCEPTOR_INTRONIC, ACCEPTOR_EXONIC - 1)})
    base = F.when(F.col("_strand") == "-", T.reverse_complement(F.col("alt"))).otherwise(F.col("alt"))
    sign = F.when(F.col("_strand") == "-", -1).otherwise(1)
    place = lambda at, before: (sign * (F.col("pos") - F.col(at)) + before).cast("int")
    v = v.withColumns({
        "_donor_alt": _swap(F.col("_donor"), place("donor_at", DONOR_EXONIC - 1), base), "_acceptor_alt": _swap(F.col("_acceptor"), place("acceptor_at", ACCEPTOR_INTRONIC), base),
        "_near_alt": _swap(F.col("_near"), F.lit(near), base), "_far_alt": _swap(F.col("_far"), F.lit(far), base),
    })
    cuts = lambda c, n: [F.substring(c, i + 1, n) for i in range(n)]
    donors, acceptors = DONOR_EXONIC + DONOR_INTRONIC, ACCEPTOR_INTRONIC + ACCEPTOR_EXONIC
    v = v.withColumns({
        "_d": M.array_score_udf(scores.donor)(F.array("_donor", "_donor_alt", *cuts("_near", donors), *cuts("_near_alt", donors))),
        "_a": M.array_score_udf(scores.acceptor)(F.array("_acceptor", "_acceptor_alt", *cuts("_far", acceptors), *cuts("_far_alt", acceptors))),
    })
    best = lambda c, n: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get(c, i + 2 + n).isNotNull(), F.struct(F.get(c, i + 2 + n).alias("alt"), (-i).alias("i"), F.get(c, i + 2).alias("ref")))))
    v = v.withColumns({"_bd": best("_d", donors), "_ba": best("_a", acceptors)})
    dz, az = (lambda c, s=s: (c - s[0]) / s[1] for s in (scores.donor_scale, scores.acceptor_scale))
    i = -F.col("_bd.i")
    v = v.withColumns({
        "donor_ref_z": dz(F.col("_d")[0]), "donor_alt_z": dz(F.col("_d")[1]), "acceptor_ref_z": az(F.col("_a")[0]), "acceptor_alt_z": az(F.col("_a")[1]),
        "new_donor_ref_z": dz(F.col("_bd.ref")), "new_donor_alt_z": dz(F.col("_bd.alt")), "_mes": F.col("_bd.alt"), "de_novo_acceptor_z": az(F.col("_ba.alt")),
        "new_donor_at": F.col("pos") + sign * (i + DONOR_EXONIC - 1 - near), "_exonic": near - i < DONOR_EXONIC,
    })
    low, high = F.least("new_donor_at", "donor_at") + F.when(F.col("_strand") == "-", 0).otherwise(1), F.greatest("new_donor_at", "donor_at") - F.when(F.col("_strand") == "-", 1).otherwise(0)
    domains = regions.filter("kind = 'domain'").groupBy(F.col("transcript").alias("_tx")).agg(F.collect_list(F.struct("start", "end")).alias("_domains"))
    v = v.join(domains, F.col("transcript") == F.col("_tx"), "left").drop("_tx")
    v = v.withColumns({"_lo": low, "_hi": high})
    v = v.withColumns({
        "in_frame": F.coalesce(same_frame(F.col("new_donor_at"), F.col("donor_at")), F.lit(False)),
        "loses_domain": F.coalesce(F.exists("_domains", lambda r: (r["start"] <= F.col("_hi")) & (r["end"] >= F.col("_lo"))), F.lit(False)), "_capped": F.coalesce(capped, F.lit(False)),
    })
    closest = F.when(F.col("location").contains("donor"), F.col("donor_alt_z")).otherwise(F.col("donor_ref_z"))
    at_donor, at_acceptor = F.col("location").contains("donor"), F.col("location").contains("acceptor")
    reference = F.when(at_donor, reference_site_prior(F.col("donor_ref_z"), F.col("donor_alt_z"), True, F.col("_capped"))).when(at_acceptor, reference_site_prior(F.col("acceptor_ref_z"), F.col("acceptor_alt_z"), False, F.col("_capped")))
    new = F.when(F.col("new_donor_alt_z").isNotNull() & F.col("donor_at").isNotNull(), de_novo_donor_prior(F.col("new_donor_ref_z"), F.col("new_donor_alt_z"), closest, F.col("in_frame") & ~F.col("loses_domain"), F.col("_capped")))
    v = v.withColumns({"reference_prior": reference, "de_novo_prior": new})
    rescued = F.coalesce(rescue(F.coalesce("is_last", F.lit(True)), F.col("_exonic"), F.col("in_frame"), F.col("loses_domain"), F.col("in_frame"), F.col("new_donor_ref_z"), F.col("new_donor_alt_z"), F.col("_mes"), F.col("donor_ref_z")), F.lit(False))
    v = v.withColumn("rescued", F.coalesce(F.col("consequence") == "stop_gained", F.lit(False)) & rescued)
    beats = F.coalesce((F.col("new_donor_alt_z") > F.col("new_donor_ref_z")) | (F.col("new_donor_alt_z") > F.col("donor_ref_z")), F.lit(False))
    v = v.withColumn("prior", applicable_prior(F.col("location"), F.coalesce("consequence", F.lit("")), F.col("protein_prior"), F.col("reference_prior"), F.col("de_novo_prior"), F.col("rescued"), F.col("_capped"), F.col("in_exon"), beats))
    return v.withColumn("class", prior_class(F.col("prior"))).select(
        *variants.columns, "location", "exon", "donor_ref_z", "donor_alt_z", "acceptor_ref_z", "acceptor_alt_z", "new_donor_at", "new_donor_ref_z", "new_donor_alt_z", "de_novo_acceptor_z",
        "in_frame", "loses_domain", "reference_prior", "de_novo_prior", "rescued", "prior", "class")


def protein_prior(variants: DataFrame, table: DataFrame, gene: str, change: str, other: str) -> DataFrame:
    """Adds ``protein_prior`` by (gene, change), or by the other name of the change where that has none."""
    t = table.select(F.col("gene").alias("_g"), F.col("change").alias("_c"), F.col("prior").alias("_p")).dropDuplicates(["_g", "_c"])
    one = variants.join(t, (F.col(gene) == F.col("_g")) & (F.col(change) == F.col("_c")), "left").drop("_g", "_c").withColumnRenamed("_p", "_p1")
    two = one.join(t, (F.col(gene) == F.col("_g")) & (F.col(other) == F.col("_c")), "left")
    return two.withColumn("protein_prior", F.coalesce(F.col("_p1").try_cast("double"), F.col("_p").try_cast("double"))).drop("_g", "_c", "_p", "_p1")


def consistent_edit(change: Column, ref: Column, alt: Column, strand: Column) -> Column:
    """Whether a named substitution, deletion or insertion agrees with the alleles on the gene's strand."""
    on_gene = lambda c: F.when(strand == "-", T.reverse_complement(c)).otherwise(c)
    sub, dele, ins = "([ACGT])>([ACGT])$", "del([ACGT]+)$", "ins([ACGT]+)$"
    return (
        F.when(change.rlike(sub), (F.regexp_extract(change, sub, 1) == on_gene(ref)) & (F.regexp_extract(change, sub, 2) == on_gene(alt)))
        .when(change.rlike(dele), F.regexp_extract(change, dele, 1) == on_gene(F.substring(ref, F.length(alt) + 1, F.length(ref))))
        .when(change.rlike(ins), F.regexp_extract(change, ins, 1) == on_gene(F.substring(alt, F.length(ref) + 1, F.length(alt))))
    )
