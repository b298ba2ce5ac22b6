"""Sinks: delimited text, VCF, BED, JSON, checksums, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T


def as_text(df: DataFrame, blank: str = "-", sep: str = ",") -> DataFrame:
    """All columns as text: lists joined, NULLs as the blank."""
    def one(f: ST.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ST.ArrayType):
            c = F.when(F.size(c) > 0, F.array_join(c.cast("array<string>"), sep))
        return F.coalesce(c.cast("string"), F.lit(blank)).alias(f.name)

    return df.select(*[one(f) for f in df.schema])


def tsv(df: DataFrame, path: str, order: list[str] | None = None, blank: str = "-") -> None:
    out = as_text(df.orderBy(*order) if order else df, blank)
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def vcf_lines(df: DataFrame, info: list[str], chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt", id_: str | None = None) -> DataFrame:
    """Record lines in order of chromosome and position, with cleaned INFO values; blanks are left out of INFO."""
    def pair(c: str) -> Column:
        v = T.blank_to_null(F.col(c).cast("string"))
        return F.when(v.isNotNull(), F.concat(F.lit(f"{c}="), T.vcf_value(v)))

    fields = F.concat_ws(";", *[pair(c) for c in info])
    line = F.concat_ws("\t", F.col(chrom).cast("string"), F.col(pos).cast("string"), F.coalesce(F.col(id_), F.lit(".")) if id_ else F.lit("."), ref, alt, F.lit("."), F.lit("."), F.when(fields == "", ".").otherwise(fields))
    return df.orderBy(F.col(chrom).try_cast("int").asc_nulls_last(), chrom, F.col(pos).cast("long"), ref, alt).select(line.alias("value"))


def vcf_header(info: list[str]) -> list[str]:
    return ["##fileformat=VCFv4.1", *[f'##INFO=<ID={c},Number=.,Type=String,Description="">' for c in info], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def vcf(df: DataFrame, path: str, info: list[str], **names: str) -> None:
    """A folder of VCF text: the header as a file of its own that sorts before the records."""
    spark = df.sparkSession
    head = spark.createDataFrame([(x,) for x in vcf_header(info)], "value string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/header")
    vcf_lines(df, info, **names).write.mode("overwrite").text(f"{path}/records")


def unambiguous(df: DataFrame, alt: str = "alt") -> DataFrame:
    return df.filter(F.col(alt).rlike("^[ACTG]*$"))


def bed_rows(df: DataFrame, chrom: str, start: str, end: str, name: str, colour: str, extra: list[str], most: int = 50) -> tuple[DataFrame, DataFrame]:
    """BED9+ rows, starts from 0, of short and of structural variants (``most`` bases or more)."""
    rows = df.select(
        F.col(chrom).alias("chrom"), (F.col(start) - 1).alias("chromStart"), F.col(end).alias("chromEnd"), F.col(name).alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"),
        (F.col(start) - 1).alias("thickStart"), F.col(end).alias("thickEnd"), T.class_colour(F.col(colour)).alias("itemRgb"), *extra,
    ).filter("chrom is not null and chromStart >= 0 and chromEnd > chromStart")
    length = F.col("chromEnd") - F.col("chromStart")
    sort = lambda d: d.orderBy("chrom", "chromStart", "chromEnd", "name")
    return sort(rows.filter(length < most)), sort(rows.filter(length >= most))


def bed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", False).option("quote", "").csv(path)


def json_page(df: DataFrame, count: int, synonyms: int, deleted: int) -> DataFrame:
    """One row with the JSON of a result page; a page is bounded by its size."""
    data = F.collect_list(F.struct(*df.columns))
    return df.agg(F.to_json(F.struct(F.lit(count).alias("count"), F.lit(synonyms).alias("synonyms"), F.lit(deleted).alias("deletedCount"), data.alias("data"))).alias("value"))


def diff_json(df: DataFrame, path: str, key: str) -> None:
    df.filter(F.size("diff") > 0).select(key, "diff").write.mode("overwrite").json(path)


def checksums(files: DataFrame, keep: list[str], discard: list[str]) -> DataFrame:
    """(name, md5) of ``binaryFile`` rows to keep; a name in neither list, or in both, fails."""
    if both := set(keep) & set(discard):
        raise ValueError(f"kept and discarded: {sorted(both)}")
    named = files.select(F.substring_index("path", "/", -1).alias("name"), F.md5("content").alias("md5"))
    known = F.col("name").isin(keep + discard)
    return named.filter(F.coalesce(F.assert_true(known, F.concat(F.lit("unknown file "), F.col("name"))).isNull(), F.lit(True))).filter(F.col("name").isin(keep)).orderBy("name")


def sitemap(df: DataFrame, ids: str, base: str, pages: list[str]) -> DataFrame:
    fixed = df.sparkSession.createDataFrame([(base + p,) for p in pages], "url string")
    return fixed.unionByName(df.select(F.concat(F.lit(base), F.col(ids).cast("string")).alias("url")))


def version_metadata(spark, fields: dict[str, str]) -> DataFrame:
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])
    return one.select(F.to_json(F.struct("*")).alias("value"))
