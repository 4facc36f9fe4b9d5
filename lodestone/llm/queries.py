"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, chat, langid, minhash, ngram, sql, suffix, superkmer, topk, urlrules, wavelet
from .common import crc_mod, table

#: Where the public vocabulary lies; the operators take any path.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train_on(docs.where(~held_out), "text", "lang", F.col("doc_id"))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_windows")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"))


#: A conversation whose texts are made of control strings.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat.digest_chats(chat.format_chats(rows.unionByName(tricky)))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_token_files(table(spark, sf_dir, "documents"), VOCABULARY))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("weights"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, keep="digests")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.remove_repeats(table(spark, sf_dir, "documents"), keep="digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_rules, op3_chat_format, op4_lm_score, op5_decontaminate, op6_token_files, op7_top_k, op8_bpe, op9_near_dedup, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": sql.OP2, "op3_chat_format": sql.OP3, "op5_decontaminate": sql.OP5, "op7_top_k": sql.OP7, "op9_near_dedup": sql.OP9, "op10_substring_dedup": sql.OP10}
