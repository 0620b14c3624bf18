"""The queries op1_ to op10_ over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import archive, bpe, exact_dedup, katz, language_id, metric_tree, mixing, near_dedup, token_files, url_filter
from gleaner.llm.shared import ship


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decisions(_table(spark, sf_dir, "documents"))


def op3_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.neighbours(_table(spark, sf_dir, "embeddings"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.held_out_scores(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_weights(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), bpe.vocabulary("word_bpe_49k.json"), 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_metric_tree, op4_katz, op5_warc, op6_language_id, op7_url_filter, op8_mixing, op9_bpe, op10_token_files)
}
#: For the others see the tests: hashes, vocabularies and models are beyond SQL.
ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
        WINDOW w AS (PARTITION BY bare ORDER BY length(t) DESC, doc_id)""",
    "op3_metric_tree": """
        WITH v AS (SELECT vec_id, list_resize(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))), (SELECT max(len(embedding)) FROM embeddings), 0.0) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 20""",
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        quality AS (SELECT doc_id, avg(0.5 + coalesce(CAST(quality AS DOUBLE), 0.5)) AS weight FROM labels GROUP BY doc_id),
        drawn AS (SELECT d.*, -ln((CAST('0x' || left(md5('mix-1:' || d.doc_id), 13) AS BIGINT) + 0.5) / 4503599627370496.0) / coalesce(q.weight, 1.0) AS draw FROM d LEFT JOIN quality q USING (doc_id)),
        sources AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS ratio FROM (SELECT *, CAST([5, 2, 1][i % 3 + 1] AS DOUBLE) AS weight FROM (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source))),
        levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM sources WINDOW b AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, (ratio, i)) FROM levels WHERE level <= ratio)) AS target FROM levels),
        plan AS (SELECT *, least(3, floor(target / source_size)) AS epochs, target - least(3, floor(target / source_size)) * source_size AS rest FROM targets),
        walked AS (SELECT r.doc_id, r.size, p.*, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.draw, r.doc_id ROWS UNBOUNDED PRECEDING) AS total FROM drawn r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN total - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM walked""",
}
