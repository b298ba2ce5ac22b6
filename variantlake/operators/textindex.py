"""Full-text search by an inverted index on disk: words to sorted record ids, added to release by release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .search import words

BLOCK = 1 << 16  # ids by which a posting list is cut: a frequent word has one row per block
HEADS = 64  # folders that words are dealt over, by their first two letters


class TextIndex:
    """An index below ``root``: ``postings`` (head, release, word, block, ids) and ``versions`` (id, release, digest, live).

    A release writes the words of new and changed records only, and one version row for each new, changed or removed
    record. A record's words are those of its newest version up to the release that is asked for, so older releases stay
    searchable and nothing is rewritten. Ids are whole numbers; words are as in ``search.words``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{what}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def postings(self) -> DataFrame:
        return self._read("postings", "word string, block long, ids array<long>, release int, head int")

    def versions(self, release: int | None = None) -> DataFrame:
        """The newest version of each record up to the release: id, digest, live and its own release."""
        v = self._read("versions", "id long, digest string, live boolean, release int")
        v = v.filter(F.col("release") <= release) if release is not None else v
        newest = F.max_by(F.struct("digest", "live", "release"), "release").alias("v")
        return v.groupBy("id").agg(newest).select("id", "v.*")

    def add(self, df: DataFrame, key: str, columns: list[str], release: int) -> None:
        """Adds a release, given all its live records. Rows of one key count as one record; null keys are left out.

        Adding a release again replaces it, so an attempt that failed half-way is simply repeated; releases are added in
        rising order.
        """
        text = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        now = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.array_sort(F.collect_set(text)).alias("_t"))
        now = now.select("id", F.array_join("_t", "\n").alias("text")).withColumn("digest", F.sha2("text", 256))
        old = self.versions(release - 1).filter("live").select("id", F.col("digest").alias("_old"))
        both = now.join(old, "id", "full")
        changed = both.filter("digest is not null and not (digest <=> _old)").select("id", "text", "digest")
        gone = both.filter("digest is null").select("id", F.lit(None).cast("string").alias("digest"), F.lit(False).alias("live"))
        by = changed.withColumn("block", F.floor(F.col("id") / BLOCK))
        rows = words(by, ["text"], ["id", "block"]).groupBy("word", "block").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        rows = rows.withColumn("head", head(F.col("word"))).repartition("head").sortWithinPartitions("head", "word", "block")
        rows.withColumn("release", F.lit(release)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release", "head").parquet(f"{self.root}/postings")
        marks = changed.select("id", "digest", F.lit(True).alias("live")).unionByName(gone).withColumn("release", F.lit(release))
        marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release").parquet(f"{self.root}/versions")

    def matches(self, terms: str, release: int | None = None) -> DataFrame:
        """Postings that some term begins: term (its number), word, ids, release. Only the folders of the terms' first
        letters are read, of those only the parts whose words can begin so."""
        p = self.postings()
        p = p.filter(F.col("release") <= release) if release is not None else p
        wanted = sorted(set(terms.lower().split()))
        out = self.spark.createDataFrame([], "term int, word string, ids array<long>, release int")
        for i, t in enumerate(wanted):
            hit = p.filter(F.col("word").startswith(t) & (F.col("word") >= t))
            hit = hit.filter(F.col("head") == head(F.lit(t))) if len(t) >= 2 else hit
            out = out.unionByName(hit.select(F.lit(i).alias("term"), "word", "ids", "release"))
        return out

    def find(self, terms: str, release: int | None = None) -> DataFrame:
        """Ids of the records that hold, for each term, a word that begins with it; no term finds every record."""
        wanted = set(terms.lower().split())
        live = self.versions(release).filter("live")
        if not wanted:
            return live.select("id")
        hits = self.matches(terms, release).select("term", F.explode("ids").alias("id"), "release").distinct()
        return hits.join(live.select("id", "release"), ["id", "release"]).groupBy("id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def head(word: Column) -> Column:
    """The folder of a word: a number of its first two letters, so all words that begin with a term of two letters share it."""
    return F.pmod(F.xxhash64(F.left(word, F.lit(2))), F.lit(HEADS)).cast("int")
