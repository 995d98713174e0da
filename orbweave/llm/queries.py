"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import mixing, page_captures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_hnsw_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.hnsw import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.store import fold
    from orbweave.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return score(docs, model, fold(F.col("doc_id"), 3) == 1)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.suffix_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.language import identify, learn
    from orbweave.llm.store import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(docs["doc_id"], 3) == 1
    return identify(docs, learn(docs.filter(~held_out)), held_out)


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), repeats=1.25)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.quality import learn, score
    from orbweave.llm.store import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score(docs, model, fold(F.col("doc_id"), 4) == 2)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbweave.llm.page_captures import resolved

    return resolved(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_hnsw_ann": op2_hnsw_ann,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc_revisits": op10_warc_revisits,
}

#: DuckDB SQL for those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op7_temperature_mixing": mixing.ORACLE,
    "op10_warc_revisits": page_captures.ORACLE,
}
