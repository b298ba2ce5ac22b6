"""Enrichment: annotation joins, evidence codes, labels, flags, subsets by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as M
from ..functions import text as T
from .ranges import band_statistics

# Thresholds of the frequency evidence.
RARE, SUPPORTING, STRONG = 0.00002, 0.0001, 0.001
DEPTH_RARE, DEPTH_COMMON = 25, 20
# Codes, the benign ones strongest first, then those that decide nothing.
BA1, BS1, BS1_SUPPORTING = "BA1", "BS1", "BS1_Supporting"
PM2, NO_CODE, NO_CODE_NON_SNV = "PM2_Supporting", "no code met", "no code met (non-SNV)"
FAIL_QC, FAIL_DEPTH = "fail: not observable", "fail: read depth or flags"
RANK = [BA1, BS1, BS1_SUPPORTING, NO_CODE, NO_CODE_NON_SNV, PM2, FAIL_QC, FAIL_DEPTH]

# Words that make a classification pathogenic or benign when lists are compared.
PATHOGENIC = ("pathogenic", "pathologic", "likely_pathogenic", "probable_pathogenic")
BENIGN = ("benign", "probably_not_pathogenic", "likely_benign", "no_known_pathogenicity", "variant_of_unknown_significance", "uncertain_significance")


def annotate(df: DataFrame, scores: DataFrame, on: list[str], columns: list[str], blank: str | None = None) -> DataFrame:
    """A left join of annotation columns, blanks filled if asked for; of repeated annotations of a key one is used."""
    one = scores.select(*on, *columns).dropDuplicates(on)
    out = df.join(one, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(blank)) for c in columns}) if blank is not None else out


def unscored(df: DataFrame, scored: DataFrame, on: list[str], batch: int | None = None) -> DataFrame:
    """Rows without a score, a batch of them in order of key if asked for."""
    left = df.join(scored.select(*on), on, "left_anti")
    return left.orderBy(*on).limit(batch) if batch else left


def must_exist(df: DataFrame, lookup: DataFrame, on: list[str], column: str) -> DataFrame:
    """A left join in which every row must find its value: a miss fails the job."""
    out = df.join(lookup.select(*on, column).dropDuplicates(on), on, "left")
    return out.withColumn(column, F.when(F.assert_true(F.col(column).isNotNull(), F.lit(f"no {column} for a key")).isNull(), F.col(column)))


def dataset_code(initial: Column, faf: Column, count: Column, depth: Column, flagged: Column, is_snv: Column, measured: Column, parsed: bool = False) -> Column:
    """The evidence code of one dataset; ``initial`` where the variant isn't in it or can't be observed. ``parsed``:
    frequency and count are numbers already, not texts."""
    number = (lambda c: c) if parsed else M.number
    f, count = number(faf), number(count)
    rare = f.isNull() | F.isnan(f) | (f <= RARE)
    code = (
        F.when(depth < F.when(rare, DEPTH_RARE).otherwise(DEPTH_COMMON), FAIL_DEPTH).when(flagged, FAIL_DEPTH)
        .when(~rare & (f > STRONG), BA1).when(~rare & (f > SUPPORTING), BS1).when(~rare, BS1_SUPPORTING)
        .when(count.isNull() | (count > 0), NO_CODE).when(is_snv, PM2).otherwise(NO_CODE_NON_SNV)
    )
    return F.when(measured, code).otherwise(initial)


def initial_code(observable: Column, is_snv: Column) -> Column:
    return F.when(is_snv & observable, PM2).when(is_snv, FAIL_QC).otherwise(NO_CODE_NON_SNV)


def consensus_code(first: Column, second: Column) -> Column:
    """The code over two datasets, the second being the newer.

    Benign against absent asks for review; two failures leave the newer; absence confirmed or unopposed stays absence;
    else the stronger of both in the order of RANK.
    """
    rank = F.array(*[F.lit(x) for x in RANK])
    a, b = F.array_position(rank, first), F.array_position(rank, second)
    benign, absent, failed = (lambda x: x <= 3), (lambda x: x == 6), (lambda x: x >= 7)
    return (
        F.when((benign(a) & absent(b)) | (absent(a) & benign(b)), "review: datasets contradict")
        .when(failed(a) & failed(b), second)
        .when((absent(a) | failed(a)) & (absent(b) | failed(b)), PM2)
        .when(b <= a, second).otherwise(first)
    )


def frequency_evidence(variants: DataFrame, coverage: dict[str, DataFrame], flags: dict[str, DataFrame], key: str = "id", width: int = 1 << 14) -> DataFrame:
    """Evidence codes of two datasets and their consensus for variants with chrom, start, end, ref, alt and, for each
    dataset d, ``id_d``, ``faf_d``, ``count_d``. Coverage has chrom, pos and mean; flags have id and Filters."""
    out = variants
    names = list(coverage)
    is_snv = (F.col("start") == F.col("end")) & (F.length("ref") == 1) & (F.length("alt") == 1)
    for d in names:
        bands = band_statistics(out.select(key, "chrom", "start", "end").distinct(), coverage[d], [key], ["chrom"], "pos", "start", "end", "mean", width)
        out = out.join(bands.select(key, F.col("mean").alias(f"depth_{d}"), F.col("observable").alias(f"observable_{d}")), key, "left")
        f = flags[d].select(F.col("id").alias(f"id_{d}"), (F.col("Filters") != "PASS").alias(f"flagged_{d}")).dropDuplicates([f"id_{d}"])
        out = out.join(f, f"id_{d}", "left")
        observable = F.coalesce(F.col(f"observable_{d}"), F.lit(False))
        measured = observable & T.blank_to_null(F.col(f"id_{d}").cast("string")).isNotNull()
        code = dataset_code(initial_code(observable, is_snv), F.col(f"faf_{d}").cast("string"), F.col(f"count_{d}").cast("string"), F.col(f"depth_{d}"), F.coalesce(F.col(f"flagged_{d}"), F.lit(False)), is_snv, measured)
        out = out.withColumn(f"code_{d}", code)
    return out.withColumn("code", consensus_code(F.col(f"code_{names[0]}"), F.col(f"code_{names[1]}")))


def discordant(*lists: Column) -> Column:
    """``Discordant`` if comma lists hold both a pathogenic and a benign word, else ``Concordant``."""
    tokens = F.flatten(F.array(*[F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)) for c in lists]))
    both = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in PATHOGENIC])) & F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in BENIGN]))
    return F.when(both, "Discordant").otherwise("Concordant")


def classification_labels(expert: Column, others: dict[str, Column], expert_name: str) -> tuple[Column, Column]:
    """The expert label and the list of all labels. Without any label the list is empty text."""
    e = T.blank_to_null(expert)
    shown = F.when(e.isNull(), "Not Yet Reviewed").when(e == "Benign", "Benign / Little Clinical Significance").otherwise(e)
    parts = [F.concat(e, F.lit(f"({expert_name})"))] + [F.concat(T.blank_to_null(c), F.lit(f" ({n})")) for n, c in others.items()]
    return shown, F.concat_ws("; ", *parts)


def truncating_code(protein: Column) -> Column:
    return F.when(protein.contains("Ter"), "PVS1").otherwise("")


def in_domain(df: DataFrame, domains: DataFrame, gene: str, pos: Column, name: str = "in_domain") -> DataFrame:
    """Whether the position lies in a functional domain (gene, start, end) of its gene."""
    d = domains.select(F.col("gene").alias("_g"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    tagged = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", pos)
    per_gene = d.groupBy("_g").agg(F.collect_list(F.struct("_s", "_e")).alias("_ranges"))
    met = tagged.join(per_gene, tagged[gene] == per_gene["_g"], "left")
    return met.withColumn(name, F.coalesce(F.exists("_ranges", lambda r: F.col("_p").between(r["_s"], r["_e"])), F.lit(False))).drop("_id", "_p", "_g", "_ranges")


def prediction_code(effect: Column, domain: Column, score: Column, splice: Column, pathogenic_score: float = 0.28, benign_score: float = 0.15, splice_high: float = 0.2, splice_low: float = 0.1) -> Column:
    """PP3 or BP4 from predictions: splicing decides first, then the protein score inside functional domains."""
    s, p = M.number(splice), M.number(score)
    missense = effect == "missense"
    return (
        F.when(s >= splice_high, "PP3").when(missense & domain & (p >= pathogenic_score), "PP3")
        .when((s <= splice_low) & missense & domain & (p <= benign_score), "BP4").when((s <= splice_low) & (missense & ~domain), "BP1_Strong")
        .when((s <= splice_low) & effect.isin("synonymous", "intronic"), "BP4").otherwise("")
    )


def source_flags(df: DataFrame, source: str, names: list[str], prefix: str = "Variant_in_") -> DataFrame:
    parts = F.transform(F.split(F.coalesce(F.col(source), F.lit("")), ","), lambda x: F.trim(x))
    return df.withColumns({f"{prefix}{n}": F.array_contains(parts, n) for n in names})


def without_sources(df: DataFrame, excluded: list[str], source: str = "Source") -> DataFrame:
    """Without the excluded sources' columns (by their endings) and members of the list; rows left without any go."""
    columns = [c for c in df.columns if not any(c.lower().endswith("_" + s.lower()) for s in excluded)]
    left = F.array_except(F.transform(F.split(F.col(source), ","), lambda x: F.trim(x)), F.array(*[F.lit(s) for s in excluded]))
    return df.select(*columns).withColumn(source, F.array_join(left, ",")).filter(F.col(source) != "")


def output_columns(columns: list[str], remove: list[str], add: list[str], rename: dict[str, str]) -> list[str]:
    """Column order of a rebuilt table: those kept, then those added, then those renamed, in their given order."""
    kept = [c for c in columns if c not in remove and c not in rename]
    return kept + [c for c in add if c not in kept] + [n for o, n in rename.items() if o in columns]


def apply_metadata(df: DataFrame, meta: DataFrame, first: list[str] = ()) -> DataFrame:
    """Columns renamed, dropped and ordered by a table of (source_name, name, category, action), one row per column.

    ``skip`` drops a column, ``copy`` keeps its name, ``rename`` gives it ``name``. Columns in ``first`` lead, the rest
    follow by category and name.
    """
    rows = [r for r in meta.select("source_name", "name", "category", "action").collect() if r["action"] != "skip" and r["source_name"] in df.columns]
    named = {(r["source_name"] if r["action"] == "copy" else r["name"]): r for r in rows}
    order = [c for c in first if c in named] + sorted((c for c in named if c not in first), key=lambda c: (named[c]["category"] or "", c))
    return df.select(*[F.col(named[c]["source_name"]).alias(c) for c in order])


def expand_pipes(c: Column, n: int, sep_item: str = ",", sep_field: str = "\\|") -> list[Column]:
    """The n fields of pipe-delimited items of a comma list, each as the different values over the items."""
    items = F.transform(F.split(c, sep_item), lambda x: F.split(x, sep_field))
    return [_field(items, k) for k in range(n)]


def _field(items: Column, k: int) -> Column:
    values = F.transform(items, lambda x: F.get(x, F.lit(k)))
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), "&")


def blacklist(df: DataFrame, listed: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """The given columns as ``-`` for listed keys."""
    hit = listed.select(*on).distinct().withColumn("_hit", F.lit(True))
    out = df.join(hit, on, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.lit("-")).otherwise(F.col(c)) for c in columns}).drop("_hit")


def weighted_coverage(a: DataFrame, b: DataFrame, on: list[str], mean: str = "mean", weight: str = "depth") -> DataFrame:
    """Two coverage tables in one: the mean weighted by depth where both have a locus, else the one there is."""
    x = a.select(*on, F.col(mean).alias("m1"), F.col(weight).alias("w1"))
    y = b.select(*on, F.col(mean).alias("m2"), F.col(weight).alias("w2"))
    both = (F.col("m1") * F.col("w1") + F.col("m2") * F.col("w2")) / (F.col("w1") + F.col("w2"))
    return x.join(y, on, "full_outer").select(*on, F.coalesce(both, "m1", "m2").alias(mean))


def best_structure(df: DataFrame, key: list[str]) -> DataFrame:
    """Per key the structure with the smallest preference (0 is last), then most hits, then most residues."""
    w = W.partitionBy(*key).orderBy((F.col("preference") == 0).cast("int"), "preference", F.desc("hits"), F.desc("residues"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
