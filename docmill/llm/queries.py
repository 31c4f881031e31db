"""The queries of this subpackage, by name, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import ann, bpe, brown_lm, chat, decontaminate, html_extract, language_id, pii, simhash, token_counts
from docmill.llm._util import deleted, remainder, scratch_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path("byte_bpe_50k.tiktoken")).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "tokens")
    counts = token_counts.document_counts(docs, folder, path("byte_bpe_50k.tiktoken"), eod=50256).select("doc_id", "n_tokens")
    deleted(spark, folder)
    return counts


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


_ALL = (op1_language_id, op2_simhash_near_dedup, op3_byte_bpe, op4_token_counts, op5_html_extraction, op6_chat_formatting, op7_decontamination, op8_pii, op9_lm_scoring, op10_nearest_neighbours)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op6_chat_formatting": chat.SQL, "op7_decontamination": decontaminate.SQL}
