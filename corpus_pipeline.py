"""The corpus pipeline: five stages over documents, each calling one operator of gleaner.llm.

Each stage takes what its predecessor kept, and its decisions take effect: rejected and duplicate documents go, and a
document that the mix takes several times comes as several rows. The last returns the ids of each row's text,
two bytes each, with digests of them and of the text decoded from them.

Defined results: texts that are null or hold no letter go in the first stage, as do those nearest to no language's
codeword; if no row has a lang, nothing is learned and all rows go. Rows are found again by doc_id and text, so ids may be
null or repeated; of rows equal in both, one stays, the same in each run. Columns besides the four that are read may have
any names and come through unchanged up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from gleaner.llm.shared import materialise, retain, scratch, ship


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return retain(docs, exact_dedup.groups(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return retain(docs, near_dedup.classes(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixture(docs, mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(docs, bpe.vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, folder)
    return docs


#: Models, signatures and vocabularies are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
