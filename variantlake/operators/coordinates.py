"""Edits on sequences: sliding along repeats, transcript and protein positions and names, computed allele identifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranges as X
from .rounds import keeper

TILE, FLANK = 1 << 14, 1 << 10  # bases of a sequence tile, and how far it reaches into its neighbours
CELL = 1 << 14
SHARED_BASES = 1 << 26  # bases of transcripts that are sent to every worker; beyond, each row is joined with its own

# The standard genetic code, codons in the order T, C, A, G.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
_LONG = {v: k for k, v in T.AMINO_ACIDS.items()} | {"*": "Ter"}


# -- sliding edits -------------------------------------------------------------------------------------------------

def tiles(regions: DataFrame, size: int = TILE, flank: int = FLANK) -> DataFrame:
    """Sequences (chrom, seq_start, seq; not overlapping) cut into pieces that overlap by ``flank`` on either side.

    Rows: chrom, tile, origin (position of the first base), bases, first and last (whether it reaches the sequence's ends).
    A table of any size meets edits by key (chrom, tile).
    """
    end = F.col("seq_start") + F.length("seq")
    t = regions.withColumn("tile", F.explode(F.sequence(F.floor(F.col("seq_start") / size), F.floor((end - 1) / size))))
    t = t.withColumns({"origin": F.greatest("seq_start", F.col("tile") * size - flank), "_to": F.least(end, (F.col("tile") + 1) * size + flank)})
    bases = F.upper(F.expr("substring(seq, cast(origin - seq_start + 1 as int), cast(_to - origin as int))"))
    return t.select("chrom", "tile", "origin", bases.alias("bases"), (F.col("origin") == F.col("seq_start")).alias("first"), (F.col("_to") == end).alias("last"), F.lit(size).alias("size"))


def trim(df: DataFrame, pos: str = "pos", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """Edits without what both alleles share, the end first; either allele may become empty."""
    shared = lambda side: F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(ref), F.length(alt))), lambda n: side(F.col(ref), n) == side(F.col(alt), n)))
    df = df.withColumn("_k", shared(F.right)).withColumns({ref: F.expr(f"left({ref}, length({ref}) - _k)"), alt: F.expr(f"left({alt}, length({alt}) - _k)")})
    df = df.withColumn("_k", shared(F.left))
    return df.withColumns({pos: F.col(pos) + F.col("_k"), ref: F.expr(f"substring({ref}, _k + 1)"), alt: F.expr(f"substring({alt}, _k + 1)")}).drop("_k")


def _slide(pos: int, ref: str, alt: str, origin: int, bases: str, first: bool, last: bool, right: bool) -> tuple[int, str, str, bool]:
    """A pure insertion or deletion moved as far as the bases allow; and whether the tile's edge did not cut that short."""
    unit, k = ref or alt, 0
    n = len(unit)
    if right:
        at = pos + len(ref) - origin  # the base behind the edit
        while at + k < len(bases) and bases[at + k] == unit[k % n]:
            k += 1
        turn, done = k % n, last or at + k < len(bases)
    else:
        at = pos - 1 - origin
        while at >= k and bases[at - k] == unit[-1 - k % n]:
            k += 1
        turn, done, k = -k % n, first or at >= k, -k
    moved = unit[turn:] + unit[:turn]
    return (pos + k, moved, "", done) if ref else (pos + k, "", moved, done)


def _slid(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in columns:
        rows = [
            (p, r, a, True) if bases is None or bool(r) == bool(a) else _slide(p, r, a, o, bases, f, la, right)
            for p, r, a, o, bases, f, la, right in zip(*(c.to_pylist() for c in batch))
        ]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["pos", "ref", "alt", "done"])


def shift(df: DataFrame, sequence_tiles: DataFrame, right: Column, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Trimmed edits (chrom, pos, ref, alt) moved to the rightmost of the equal writings where ``right`` holds, else the
    leftmost.

    Only pure insertions and deletions move; what lies in no sequence stays. An edit that reaches the edge of its tile
    goes on in the next one, in further rounds until all are done, so repeats may have any length. ``keep`` materialises
    a round (Parquet by default).
    """
    keep = keep or keeper(df.sparkSession)
    columns = df.columns
    t = sequence_tiles.withColumnRenamed("chrom", "_chrom")
    slid = F.arrow_udf(_slid, "struct<pos:long,ref:string,alt:string,done:boolean>")
    size = sequence_tiles.select("size").first()
    todo, finished = df.withColumn("_right", right), None
    while True:
        if size is None:
            return df
        near = F.when(F.col("_right"), F.col("pos") + F.length("ref")).otherwise(F.col("pos") - 1)  # the base that is looked at first
        met = todo.join(t, (F.col("chrom") == F.col("_chrom")) & (F.floor(near / size[0]) == F.col("tile")), "left")
        met = met.withColumn("_s", slid("pos", "ref", "alt", "origin", "bases", "first", "last", "_right"))
        moved = keep(met.select(*[F.col(f"_s.{c}").alias(c) if c in ("pos", "ref", "alt") else F.col(c) for c in columns], "_right", F.col("_s.done").alias("_done")))
        part = moved.filter("_done").select(*columns)
        finished = part if finished is None else finished.unionByName(part)
        todo = moved.filter("not _done").drop("_done")
        if todo.isEmpty():
            return finished


# -- transcripts ---------------------------------------------------------------------------------------------------

def segments(exon_rows: DataFrame) -> DataFrame:
    """Exons and introns of transcripts as closed ranges with what positions in them are counted from.

    ``exon_rows`` are those of splice.exons with chrom, cds_start and cds_end (start < position <= end; null: not coding).
    ``n`` counts transcript bases from 1: that of an exon's first base in transcript order, or of the last base before an
    intron. It is a prefix sum of exon lengths.
    """
    order = W.partitionBy("transcript").orderBy("exon")
    whole = W.partitionBy("transcript")
    plus = F.col("strand") != "-"
    e = exon_rows.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = lambda g: F.when((F.col("start") < g) & (g <= F.col("end")), F.col("offset") + F.when(plus, g - F.col("start")).otherwise(F.col("end") - g + 1))
    begin, finish = F.when(plus, F.col("cds_start") + 1).otherwise(F.col("cds_end")), F.when(plus, F.col("cds_end")).otherwise(F.col("cds_start") + 1)
    e = e.withColumns({
        "first_n": F.max(number(begin)).over(whole), "last_n": F.max(number(finish)).over(whole),
        "_start": F.lead("start").over(order), "_end": F.lead("end").over(order),
    })
    common = [F.col(c) for c in ("transcript", "chrom", "strand", "exon", "first_n", "last_n")]
    exons = e.select(*common, F.lit("exon").alias("kind"), (F.col("start") + 1).alias("lo"), F.col("end").alias("hi"), (F.col("offset") + 1).alias("n"))
    lo, hi = F.when(plus, F.col("end") + 1).otherwise(F.col("_end") + 1), F.when(plus, F.col("_start")).otherwise(F.col("start"))
    introns = e.filter("_start is not null").select(*common, F.lit("intron").alias("kind"), lo.alias("lo"), hi.alias("hi"), (F.col("offset") + F.col("end") - F.col("start")).alias("n"))
    return exons.unionByName(introns.filter("lo <= hi"))


def transcript_positions(df: DataFrame, segment_rows: DataFrame, pos: str = "pos", to: str = "c", width: int = CELL) -> DataFrame:
    """Genomic positions on each transcript that holds them: transcript, strand, n, offset and the name in ``to``.

    In introns the nearer exon counts, the one before in the middle: ``c.76+2``, ``c.77-1``. Before the first coding base
    names are negative, after the last they begin with ``*``; without a coding part they count from the start, ``n.76``.
    """
    hit = X.point_lookup(df, segment_rows.drop("exon"), ["chrom"], pos, "lo", "hi", width, "inner", closed=True)
    along = F.when(F.col("strand") != "-", F.col(pos) - F.col("lo")).otherwise(F.col("hi") - F.col(pos))
    size = F.col("hi") - F.col("lo") + 1
    near = along + 1 <= size - along
    in_exon = F.col("kind") == "exon"
    hit = hit.withColumns({"_n": F.when(in_exon, F.col("n") + along).when(near, F.col("n")).otherwise(F.col("n") + 1),
                           "offset": F.when(in_exon, 0).when(near, along + 1).otherwise(along - size)})
    hit = hit.drop("n", "lo", "hi", "kind").withColumnRenamed("_n", "n")
    return hit.withColumn(to, position_name(F.col("n"), F.col("offset"), F.col("first_n"), F.col("last_n")))


def position_name(n: Column, offset: Column, first: Column, last: Column) -> Column:
    """The name of a transcript position without its prefix."""
    base = F.when(n < first, (n - first).cast("string")).when(n > last, F.concat(F.lit("*"), n - last)).otherwise(F.coalesce(n - first + 1, n).cast("string"))
    return F.concat(base, F.when(offset > 0, F.concat(F.lit("+"), offset)).when(offset < 0, offset.cast("string")).otherwise(""))


def cdna_names(variants: DataFrame, segment_rows: DataFrame, sequence_tiles: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, width: int = CELL) -> DataFrame:
    """Adds transcript, strand, cds_pos and ``cdna``: the change (``c.76A>T``, ``c.76_78del``, ``dup``, ``ins``,
    ``delins``) on each transcript that holds both ends of an edit.

    Edits are trimmed and moved to the 3' end on the transcript's strand first. ``cds_pos`` is the place of the first
    changed base in the coding sequence (of an insertion the base behind it), null outside exons; g_pos, g_ref and g_alt are
    the edit as moved, on the forward strand. Rows on no transcript are left out; no change (equal alleles) gives ``=``.
    """
    keep = keep or keeper(variants.sparkSession)
    own = segment_rows.groupBy("transcript").agg(F.first("chrom").alias("_c"), F.first("strand").alias("strand"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    v = trim(variants.withColumns({"_pos": F.col("pos"), "_ref": F.col("ref"), "_alt": F.col("alt")}))
    v = X.point_lookup(v, own.withColumnRenamed("_c", "chrom"), ["chrom"], "pos", "_lo", "_hi", width, "inner", closed=True).drop("_lo", "_hi")
    v = shift(v, sequence_tiles, F.col("strand") != "-", keep)
    v = v.withColumns({"g_pos": F.col("pos"), "g_ref": F.col("ref"), "g_alt": F.col("alt")})
    v = v.withColumns({"pos": F.col("_pos"), "ref": F.col("_ref"), "alt": F.col("_alt")}).drop("_pos", "_ref", "_alt").withColumn("_id", F.monotonically_increasing_id())
    v = keep(v)
    n, m = F.length("g_ref"), F.length("g_alt")
    inserted = n == 0
    plus = F.col("strand") != "-"
    # A repeat of the bases before it, in transcript order: it could move back by its own length.
    back = shift(v.filter(inserted & (m > 0)).select("chrom", F.col("g_pos").alias("pos"), F.col("g_ref").alias("ref"), F.col("g_alt").alias("alt"), "strand", "_id"), sequence_tiles, ~plus, keep)
    v = v.join(back.select("_id", F.col("pos").alias("_back")), "_id", "left")
    dup = F.coalesce(F.abs(F.col("g_pos") - F.col("_back")) >= m, F.lit(False))
    low = F.when(dup & plus, F.col("g_pos") - m).when(dup, F.col("g_pos")).when(inserted, F.col("g_pos") - 1).otherwise(F.col("g_pos"))
    high = F.when(dup, low + m - 1).when(inserted, F.col("g_pos")).otherwise(F.col("g_pos") + n - 1)
    v = v.withColumns({"_dup": dup, "_low": low, "_high": F.greatest(high, low)})
    ends = v.select("_id", F.col("transcript").alias("_t"), "chrom", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_low").alias("g")), F.struct(F.lit(1).alias("side"), F.col("_high").alias("g")))).alias("x")).select("_id", "_t", "chrom", "x.side", "x.g")
    named = transcript_positions(ends, segment_rows, "g", "name", width).filter("transcript = _t")
    pair = named.groupBy("_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("name"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("name"))).alias("_b"), F.max("first_n").alias("_first"),
        F.max(F.when(F.col("side") == 0, F.struct("n", "offset"))).alias("_na"), F.max(F.when(F.col("side") == 1, F.struct("n", "offset"))).alias("_nb"))
    v = v.join(pair, "_id").filter("_a is not null and _b is not null")
    from_, to = F.when(plus, F.col("_a")).otherwise(F.col("_b")), F.when(plus, F.col("_b")).otherwise(F.col("_a"))
    span = F.when(from_ == to, from_).otherwise(F.concat_ws("_", from_, to))
    on_gene = lambda c: F.when(plus, F.col(c)).otherwise(T.reverse_complement(F.col(c)))
    change = (
        F.when((n == 0) & (m == 0), F.lit("=")).when((n == 1) & (m == 1), F.concat(span, on_gene("g_ref"), F.lit(">"), on_gene("g_alt"))).when(m == 0, F.concat(span, F.lit("del")))
        .when(F.col("_dup"), F.concat(span, F.lit("dup"))).when(inserted, F.concat(span, F.lit("ins"), on_gene("g_alt"))).otherwise(F.concat(span, F.lit("delins"), on_gene("g_alt")))
    )
    # Where a coding edit begins: a duplication's copy stands behind the bases it repeats.
    head, tail = F.when(plus, F.col("_na")).otherwise(F.col("_nb")), F.when(plus, F.col("_nb")).otherwise(F.col("_na"))
    place = F.when(inserted & F.col("_dup"), tail["n"] + 1).when(inserted, tail["n"]).otherwise(head["n"])
    exonic = (F.col("_na")["offset"] == 0) & (F.col("_nb")["offset"] == 0)
    v = v.withColumns({"cdna": F.when(change == "=", change).otherwise(F.concat(F.when(F.col("_first").isNull(), "n.").otherwise("c."), change)), "cds_pos": F.when(exonic, place - F.col("_first") + 1)})
    return v.drop("_id", "_back", "_dup", "_low", "_high", "_a", "_b", "_first", "_na", "_nb")


# -- proteins ------------------------------------------------------------------------------------------------------

def coding_sequences(exon_rows: DataFrame, segment_rows: DataFrame, regions: DataFrame) -> DataFrame:
    """transcript and ``coding``: its spliced bases from the first coding one to the transcript's end, on its strand."""
    r = regions.select(F.col("chrom").alias("_chrom"), "seq", "seq_start")
    e = exon_rows.join(r, (F.col("chrom") == F.col("_chrom")) & (F.col("start") + 1 >= F.col("seq_start")) & (F.col("end") < F.col("seq_start") + F.length("seq")))
    bases = F.upper(F.expr("substring(seq, cast(start + 1 - seq_start + 1 as int), cast(end - start as int))"))
    piece = F.when(F.col("strand") == "-", T.reverse_complement(bases)).otherwise(bases)
    spliced = e.groupBy("transcript", "n_exons").agg(F.sort_array(F.collect_list(F.struct("exon", piece.alias("b")))).alias("p")).filter(F.size("p") == F.col("n_exons"))
    first = segment_rows.groupBy("transcript").agg(F.max("first_n").alias("first_n")).filter("first_n is not null")
    text = F.array_join(F.transform("p", lambda x: x["b"]), "")
    return spliced.join(first, "transcript").select("transcript", F.substring(text, F.col("first_n").cast("int"), F.length(text)).alias("coding"))


def protein_name(coding: str | None, at: int | None, ref: str, alt: str) -> str | None:
    """The predicted change of the protein by an edit of the coding sequence, whose base ``at`` (from 1) is the first changed.

    Null if the edit lies outside the coding sequence or the reference bases disagree.
    """
    if coding is None or at is None or at < 1 or coding[at - 1:at - 1 + len(ref)] != ref:
        return None
    new = coding[:at - 1] + alt + coding[at - 1 + len(ref):]
    aa = lambda s, i: CODONS.get(s[3 * i:3 * i + 3], "X") if len(s) >= 3 * i + 3 else ""
    name = lambda i: f"{_LONG.get(aa(coding, i), 'Xaa')}{i + 1}"
    listed = lambda x: "".join(_LONG.get(c, "Xaa") for c in x)
    i = start = max(0, (at - 1) // 3)
    stop = next((j for j in range(len(coding) // 3) if coding[3 * j:3 * j + 3] in ("TAA", "TAG", "TGA")), None)
    if stop is None or i > stop:
        return None
    framed = (len(alt) - len(ref)) % 3 == 0
    last = (at - 1 + max(len(ref), 1) - 1) // 3
    while aa(coding, i) == aa(new, i) and (i <= last or not framed) and i <= stop:
        i += 1
    if coding == new or framed and len(ref) == len(alt) and i > last or i > stop:
        return f"p.({name(start)}=)"
    if i == 0 and aa(coding, 0) == "M":
        return "p.(Met1?)"
    if i == stop:
        more = next((j for j in range(i, len(new) // 3) if aa(new, j) == "*"), None)
        return f"p.(Ter{i + 1}{listed(aa(new, i))}extTer{more - i if more is not None else '?'})"
    if aa(new, i) == "*":
        return f"p.({name(i)}Ter)"
    if not framed:
        more = next((j for j in range(i, len(new) // 3) if aa(new, j) == "*"), None)
        return f"p.({name(i)}{listed(aa(new, i))}fsTer{more - i + 1 if more is not None else '?'})"
    d = (len(alt) - len(ref)) // 3
    gone = "".join(aa(coding, j) for j in range(i, max(last + 1, i - min(d, 0))))
    came = "".join(aa(new, j) for j in range(i, i + len(gone) + d))
    while gone and came and gone[-1] == came[-1]:
        gone, came = gone[:-1], came[:-1]
    if len(gone) == len(came) == 1:
        return f"p.({name(i)}{listed(came)})"
    if "*" in came:
        came = came[:came.index("*") + 1]
    if not came:
        while i + len(gone) < stop and gone[0] == aa(coding, i + len(gone)):
            gone, i = gone[1:] + gone[0], i + 1
        return f"p.({name(i)}del)" if len(gone) == 1 else f"p.({name(i)}_{name(i + len(gone) - 1)}del)"
    if not gone:
        while i < stop and came[0] == aa(coding, i):
            came, i = came[1:] + came[0], i + 1
        k = len(came)
        if i >= k and came == "".join(aa(coding, j) for j in range(i - k, i)):
            return f"p.({name(i - k)}dup)" if k == 1 else f"p.({name(i - k)}_{name(i - 1)}dup)"
        return f"p.({name(i - 1)}_{name(i)}ins{listed(came)})"
    whole = name(i) if len(gone) == 1 else f"{name(i)}_{name(i + len(gone) - 1)}"
    return f"p.({whole}delins{listed(came)})"


def protein_names(named: DataFrame, coding: DataFrame, to: str = "protein") -> DataFrame:
    """Adds the protein change to the rows of cdna_names. ``coding`` is that of coding_sequences.

    Up to SHARED_BASES bases in all are sent to the workers once; beyond, each row meets its transcript by a join.
    """
    plus = F.col("strand") != "-"
    ref, alt = (F.when(plus, F.col(c)).otherwise(T.reverse_complement(F.col(c))) for c in ("g_ref", "g_alt"))
    total = coding.agg(F.sum(F.length("coding"))).first()[0] or 0
    if total <= SHARED_BASES:
        shared = named.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in coding.select("transcript", "coding").collect()})

        @F.arrow_udf("string")
        def name(transcript: pa.Array, at: pa.Array, ref: pa.Array, alt: pa.Array) -> pa.Array:
            return pa.array([protein_name(shared.value.get(t), *x) for t, *x in zip(*(c.to_pylist() for c in (transcript, at, ref, alt)))], pa.string())

        return named.withColumn(to, name("transcript", "cds_pos", ref, alt))

    @F.arrow_udf("string")
    def name_joined(bases: pa.Array, at: pa.Array, ref: pa.Array, alt: pa.Array) -> pa.Array:
        return pa.array([protein_name(b, *x) for b, *x in zip(*(c.to_pylist() for c in (bases, at, ref, alt)))], pa.string())

    return named.join(coding.select("transcript", "coding"), "transcript", "left").withColumn(to, name_joined("coding", "cds_pos", ref, alt)).drop("coding")


# -- identifiers ---------------------------------------------------------------------------------------------------

def digest(c: Column) -> Column:
    """The first 24 bytes of SHA-512 in base64 for addresses."""
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(c.cast("binary"), 512), 1, 48))), "+/", "-_")


def allele_digest(sequence_id: Column, start: Column, end: Column, state: Column) -> Column:
    """Identifier of an allele by its canonical text: the bases between ``start`` and ``end`` (from 0, end exclusive) of
    a sequence, known by its digest, are ``state``."""
    location = digest(F.concat(F.lit('{"interval":{"end":'), end.cast("string"), F.lit(',"start":'), start.cast("string"), F.lit(',"type":"SimpleInterval"},"sequence_id":"'), sequence_id, F.lit('","type":"SequenceLocation"}')))
    return F.concat(F.lit("ga4gh:VA."), digest(F.concat(F.lit('{"location":"'), location, F.lit('","state":{"sequence":"'), state, F.lit('","type":"SequenceState"},"type":"Allele"}'))))


def allele_ids(variants: DataFrame, sequence_tiles: DataFrame, sequence_ids: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``allele_id``, equal for all writings of an edit; ``sequence_ids`` (chrom, sequence_id) names the sequences.

    An insertion or deletion in a repeat is written over all places where it could stand: between its leftmost and its
    rightmost writing, the bases follow from the unit alone. Null for unknown sequences.
    """
    v = trim(variants.withColumns({"_pos": F.col("pos"), "_ref": F.col("ref"), "_alt": F.col("alt")}))
    left = shift(v, sequence_tiles, F.lit(False), keep).withColumns({"_p": F.col("pos"), "_r": F.col("ref"), "_a": F.col("alt")})
    both = shift(left, sequence_tiles, F.lit(True), keep).withColumn("_k", F.col("pos") - F.col("_p"))
    unit = F.concat("_r", "_a")
    longer = F.when(F.length(unit) == 0, F.lit("")).otherwise(F.expr("left(repeat(concat(_r, _a), cast(ceil((length(concat(_r, _a)) + _k) / greatest(length(concat(_r, _a)), 1)) as int)), cast(length(concat(_r, _a)) + _k as int))"))
    both = both.withColumn("_longer", longer).withColumn("_shorter", F.expr("left(_longer, cast(_k as int))"))
    pure = (F.length("_r") == 0) != (F.length("_a") == 0)
    wide_ref = F.when(pure, F.when(F.col("_r") == "", F.col("_shorter")).otherwise(F.col("_longer"))).otherwise(F.col("_r"))
    state = F.when(pure, F.when(F.col("_r") == "", F.col("_longer")).otherwise(F.col("_shorter"))).otherwise(F.col("_a"))
    s = sequence_ids.select(F.col("chrom").alias("_chrom"), "sequence_id")
    out = both.join(s, F.col("chrom") == F.col("_chrom"), "left")
    out = out.withColumn("allele_id", allele_digest(F.col("sequence_id"), F.col("_p") - 1, F.col("_p") - 1 + F.length(wide_ref), state))
    return out.select(*[F.col(f"_{c}").alias(c) if c in ("pos", "ref", "alt") else F.col(c) for c in variants.columns], "allele_id")
