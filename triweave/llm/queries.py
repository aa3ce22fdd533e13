"""The queries of this subpackage: one for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm import mixing, topk_search, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.token_ids import token_id_output

    return token_id_output(spark, _table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.toxicity import score_toxicity

    return score_toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.ngram_join import similar_groups

    return similar_groups(spark, _table(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.decontaminate import benchmark_matches

    matches = benchmark_matches(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return matches.select("doc_id", "item_id", F.round("lcs_share", 6).alias("lcs_share"), F.round("answer_share", 6).alias("answer_share"), "paraphrase")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.url_filter import url_verdicts

    return url_verdicts(spark, _table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.quality import quality_digest

    return quality_digest(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.mixing import mixing_digest

    return mixing_digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.line_dedup import line_digest

    return line_digest(spark, _table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.topk_search import top_k_digest

    return top_k_digest(spark, _table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.chat import chat_digest

    return chat_digest(_table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.periodic_runs import runs_digest

    return runs_digest(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.llm.language_id import language_digest

    return language_digest(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_topk_search": op9_topk_search,
    "op10_chat": op10_chat,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language_id": op12_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_topk_search": topk_search.ORACLE_SQL,
}
