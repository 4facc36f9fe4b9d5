"""From raw documents to token ids in five stages, each a call of one operator of lodestone.llm.

A stage takes (spark, docs, sf_dir) and returns documents with the columns it got; the last
returns token ids.  Between stages the table is written and read again.

Every stage judges rows, not ids: repeated rows, rows of one id with different texts and rows
without an id are each kept, cut or dropped by their own text.  The row's other columns travel
as one struct, so their names are free; no stage joins texts by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_automaton, langid, minhash, queries, suffix, superkmer
from lodestone.llm.common import broadcast_if_small, materialise, packed, release_tables, table, tables_written

#: A document is rejected if no language is recognised, or none with this mean probability.
MIN_SCORE = 0.4


def _column(name: str) -> Column:
    return F.col(f"carried.`{name}`").alias(name)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go. Null, empty and letterless texts go; repeated rows go or stay together."""
    model = langid.train_on(docs, "text", "lang", F.col("doc_id"))
    judged = langid.identify(docs, model, carry=docs.columns)
    clear = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return judged.where(clear).select(*map(_column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id, null ids last; repeated rows are such a group.

    Rows without words belong to no group and stay.
    """
    rows = materialise(docs.select(packed(docs.columns), F.monotonically_increasing_id().alias("row")), "rows")
    found = minhash.near_duplicates(rows.select("row", "carried.text"), shingle=5, threshold=80, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("carried.doc_id").isNull(), "carried.doc_id", "row")
    grouped = materialise(found.join(rows.select("row", "carried.doc_id"), "row").select("row", "component_id", F.struct("doc_id").alias("carried")), "grouped")
    first = materialise(grouped.groupBy("component_id").agg(F.min(order)["row"].alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    gone = materialise(grouped.join(broadcast_if_small(first, 24), "component_id").where("row <> first").select("row"), "gone")
    return rows.join(broadcast_if_small(gone, 16), "row", "left_anti").select(*map(_column, docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier in the corpus go; every document stays, if with less text.

    Order is by id, null ids first, then text. Null texts stay null; n_chars follows a text that was cut.
    """
    others = [c for c in docs.columns if c != "text"]
    missing = next(n for n in ("no_text", *(f"no_text_{i}" for i in range(len(others) + 1))) if n not in others)
    rows = superkmer.remove_repeats(docs.withColumn(missing, F.col("text").isNull()), keep="text", carry=[*others, missing])
    columns = {c: _column(c) if c != "text" else F.when(~_column(missing), F.col("kept_text")).alias("text") for c in docs.columns}
    if "n_chars" in columns:
        own = F.col("carried.n_chars")
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own).alias("n_chars")
    return rows.select(*columns.values())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with or without an id; wordless and null texts stay."""
    judged = suffix.contamination(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return judged.where(~F.col("contaminated")).select(*map(_column, docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, input_ids, decoded) of every row; null texts have no tokens."""
    return bpe_automaton.encode_documents(docs, queries.VOCABULARY)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("bpe", tokenize)]

#: Trained classification, word automata and exact components are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself is deleted once its rows are written, and so are the rows before."""
    docs, before = table(spark, sf_dir, "documents"), tables_written(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release_tables(spark, before)
    return docs
