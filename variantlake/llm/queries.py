"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, langid, mixing, neardup, pieces, pigeonhole, pii, resampling, sharding, suffix_tree, toxicity, warc
from .common import Workspace, crc_mod

SHARD_BYTES = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.extendible_shards(docs, Workspace(spark, "op1"), "doc_id", F.col("n_bytes"), SHARD_BYTES)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_weights(_read(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"), Workspace(spark, "op3"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(_read(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op4"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_mod("doc_id", 4)
    return langid.identify(docs, fold != 2).select(
        "doc_id", (fold == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans")
    )


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, Workspace(spark, "op6"))


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(_read(spark, sf_dir, "documents"), Workspace(spark, "op7"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_digests(docs, tokenizer_path()).drop("text")


def op9_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_duplicate_classes(_read(spark, sf_dir, "documents"), Workspace(spark, "op9"))
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.link_near(_read(spark, sf_dir, "embeddings"), Workspace(spark, "op10"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.rank_by_target(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), Workspace(spark, "op11"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress(_read(spark, sf_dir, "embeddings"), Workspace(spark, "op12"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, labels = crc_mod("doc_id", 5), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.toxic_scores(_read(spark, sf_dir, "documents"), labels, fold != 0, Workspace(spark, "op13"))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_extendible_sharding, op2_entropy_mixing, op3_warc, op4_private_data, op5_language_id, op6_nearest_neighbours,
    op7_suffix_tree_scores, op8_sentencepiece, op9_minhash_classes, op10_embedding_links, op11_target_resampling, op12_vector_codes, op13_toxicity, pipeline,
)}

def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Assignments and means written out round by round."""
    steps = [f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (
            SELECT vec_id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM v, range(0, {parts}) r(part)),
        book0 AS MATERIALIZED (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p
            QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        near{i} AS MATERIALIZED (
            SELECT vec_id, part, min(d * {entries} + entry) AS best, any_value(x) AS x FROM (
                SELECT vec_id, part, entry, x, CAST(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                FROM p JOIN book{i} USING (part)) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""
        mean{i} AS (
            SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS e FROM (
                SELECT part, best % {entries} AS entry, i, sum(x[i]) AS s, count(*) AS n
                FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{i}) GROUP BY ALL) GROUP BY part, entry),
        book{i + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))""")
    return ",".join(steps) + f""",
        digest AS (
            SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
            FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN v USING (vec_id), digest"""


ORACLE_SQL = {
    "op1_extendible_sharding": f"""
        WITH d AS (
            SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
            FROM documents),
        nodes AS (
            SELECT CAST(depth AS INTEGER) AS depth, h >> CAST(60 - depth AS INTEGER) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes
            FROM d, range(0, 61) t(depth) GROUP BY 1, 2),
        leaves AS (
            SELECT n.* FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
            WHERE (n.bytes <= {SHARD_BYTES} OR n.depth = 60) AND (n.depth = 0 OR p.bytes > {SHARD_BYTES}))
        SELECT doc_id, n_bytes, depth AS shard_depth, prefix AS shard_prefix, bytes AS shard_bytes
        FROM d JOIN leaves ON h >> (60 - depth) = prefix""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN last IS NOT NULL AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN last IS NOT NULL AND page_id <> last THEN last END AS refers_to, url, true AS digest_ok
        FROM p LEFT JOIN g ON p.html = g.html""",
    "op10_embedding_links": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM comp""",
    "op11_target_resampling": r"""
        WITH bytes AS MATERIALIZED (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
                FROM range(0, 256) r(i))),
        d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        texts AS (SELECT 0 AS side, row, text FROM d UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
        w AS MATERIALIZED (
            SELECT side, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
        c AS MATERIALIZED (
            SELECT word, xor(list_reduce(list_transform(range(0, strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                   lambda a, b: xor(a >> 8, bytes.t[CAST(xor(a & 255, b) + 1 AS BIGINT)]), 4294967295), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT word FROM w), bytes),
        n AS MATERIALIZED (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN c USING (word) GROUP BY bucket),
        g AS MATERIALIZED (
            SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
            FROM n, (SELECT CAST(sum(s) AS BIGINT) AS ss, CAST(sum(t) AS BIGINT) AS tt FROM n)),
        f AS (
            SELECT row, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
            FROM w JOIN c USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY row),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                   (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM d LEFT JOIN f USING (row)),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
                   10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM r""",
    "op12_vector_codes": _codes_sql(codes.PARTS, codes.ENTRIES, codes.ROUNDS),
}
