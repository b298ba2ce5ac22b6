"""Sources: delimited text, VCF, XML, JSON, BED, coverage and configuration tables, release snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import collections as R
from ..functions import text as T

BED = "chrom string, start long, end long, name string"
COVERAGE = "chrom string, pos long, mean double, median double"


def tsv(spark: SparkSession, path: str | list[str], schema: str | None = None, blanks: bool = True) -> DataFrame:
    """Tab-separated text with a header; all columns are text without a schema. Blanks and ``-`` become NULL, or,
    with ``blanks`` off, stay what they are. Several files with one header are read as one."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "\u0000" if not blanks else "").option("emptyValue", "")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    texts = [f.name for f in df.schema if isinstance(f.dataType, ST.StringType)]
    if blanks:
        return df.withColumns({c: T.blank_to_null(F.col(f"`{c}`")) for c in texts})
    return df.na.fill("", texts)


def csv_table(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t") -> DataFrame:
    return spark.read.option("sep", sep).option("header", header).option("comment", "#").schema(schema).csv(path)


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """VCF records: chrom, pos, id, ref, alts, qual, filter, info (map of texts to arrays), file and line order.

    The text is read in splits; header lines go. ``line`` orders the records of a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    listed = lambda c: F.split(c, ",")
    info = F.transform_values(R.info_map(F.get(f, F.lit(7))), lambda k, v: listed(F.coalesce(v, F.lit(""))))
    return lines.select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(3)).alias("ref"),
        listed(F.get(f, F.lit(4))).alias("alts"), F.get(f, F.lit(5)).alias("qual"), F.split(F.get(f, F.lit(6)), ";").alias("filter"), info.alias("info"), "file", "line",
    )


def vcf_subfields(spark: SparkSession, path: str, key: str) -> list[str]:
    """Names of a pipe-delimited INFO field's parts, from ``Format: a|b|c`` in its header line."""
    head = spark.read.text(path).filter(F.col("value").startswith(f"##INFO=<ID={key},")).limit(1).collect()
    if not head or "Format:" not in head[0][0]:
        return []
    return [x.strip(' ">\'') for x in head[0][0].split("Format:")[1].split("|")]


def vcf_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return df.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def xml(spark: SparkSession, path: str, row_tag: str, schema: ST.StructType | str) -> DataFrame:
    """XML records by their tag, with a given schema (inference would take ids for numbers)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def with_gene(df: DataFrame, genes: str, wanted: list[str]) -> DataFrame:
    return df.filter(F.exists(genes, lambda g: g.isin(wanted)))


def with_submitter(df: DataFrame, submitters: str, pattern: str) -> DataFrame:
    return df.filter(F.exists(submitters, lambda s: s.rlike(pattern)))


def not_only_somatic(df: DataFrame, origins: str) -> DataFrame:
    return df.filter(~((F.size(origins) == 1) & (F.get(F.col(origins), F.lit(0)) == "somatic")))


def first_reviewed(df: DataFrame, assertions: str, status: str = "reviewed by expert panel", name: str = "assertion") -> DataFrame:
    """Adds the first assertion with the review status; records without one go."""
    hit = F.get(F.filter(assertions, lambda a: a["status"] == status), F.lit(0))
    return df.withColumn(name, hit).filter(F.col(name).isNotNull())


def json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.option("multiLine", not lines).schema(schema).json(path)


def flatten_populations(df: DataFrame, key: str, populations: str, names: list[str], values: list[str], skip: str = "^(1kg|hgdp)") -> DataFrame:
    """Columns ``<population>_<value>`` from an array of structs with ``id``; populations that match ``skip`` go."""
    one = lambda p: F.get(F.filter(populations, lambda x: (x["id"] == p) & ~x["id"].rlike(skip)), F.lit(0))
    return df.withColumns({f"{p}_{v}": one(p)[v] for p in names for v in values})


def bed(spark: SparkSession, path: str, schema: str = BED) -> DataFrame:
    return csv_table(spark, path, schema)


def coverage(df: DataFrame, genes: DataFrame, width: int = 1 << 17) -> DataFrame:
    """Coverage rows (locus or chrom and pos, mean, median or median_approx) in the genes' ranges, in one shape.

    Chromosomes lose their prefix; X and Y go.
    """
    from ..operators.ranges import point_lookup

    if "locus" in df.columns:
        df = df.withColumns({"chrom": F.split("locus", ":")[0], "pos": F.split("locus", ":")[1].try_cast("long")}).drop("locus")
    if "median_approx" in df.columns:
        df = df.withColumnRenamed("median_approx", "median")
    df = df.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).filter(~F.col("chrom").isin("X", "Y"))
    df = df.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("mean").try_cast("double").alias("mean"), F.col("median").try_cast("double").alias("median"))
    return point_lookup(df, genes.select("chrom", "start", "end"), ["chrom"], "pos", "start", "end", width, "left_semi", closed=True)


def gene_config(spark: SparkSession, path: str, schema: str, defaults: dict[str, str]) -> DataFrame:
    """The region table; a column that is empty takes another's value (legacy boundaries those of today)."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.col(d)) for c, d in defaults.items()})


def proxies(df: DataFrame, known: DataFrame) -> DataFrame:
    """Proxy lines (value) as site, proxy, r2; warnings go, both ends must be known sites, a site is no proxy of itself."""
    f = F.split("value", "\t")
    rows = df.filter(~F.col("value").rlike("WARNING|ERROR|^SNP\t")).select(f[0].alias("site"), f[1].alias("proxy"), f[2].try_cast("double").alias("r2")).filter("site <> proxy and r2 is not null")
    return rows.join(known.select("site"), "site", "left_semi").join(known.select(F.col("site").alias("proxy")), "proxy", "left_semi").select("site", "proxy", "r2")


def sequence_at(df: DataFrame, regions: DataFrame, chrom: str, start: str, length: str, name: str = "bases", width: int = 1 << 17) -> DataFrame:
    """Adds the reference bases from ``start`` on, from regions (chrom, seq_start, seq) met by grid cell."""
    from ..operators.ranges import point_lookup

    r = regions.select(F.col("chrom").alias(chrom), "seq_start", (F.col("seq_start") + F.length("seq")).alias("_seq_end"), "seq")
    out = point_lookup(df, r, [chrom], start, "seq_start", "_seq_end", width)
    return out.withColumn(name, F.expr(f"substring(seq, cast({start} - seq_start + 1 as int), cast({length} as int))")).drop("seq_start", "_seq_end", "seq")


def snapshot(spark: SparkSession, base: str, release: int) -> DataFrame:
    return spark.read.parquet(f"{base}/release={release}")
