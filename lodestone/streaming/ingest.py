"""Response files as a stream: rows land exactly once, a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_responses(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, max_files: int = 1000) -> None:
    """Append every response file not yet seen to a Parquet table, batch by batch, then stop.

    The checkpoint is the record of what is done; each batch is written under its own number, so a repeated
    batch replaces itself.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source).withColumn("file_name", F.col("_metadata.file_name"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(spark: SparkSession, target: str, n_questions: int) -> DataFrame:
    """(condition, model, n, n_error, state) of ingested responses: done, failed or pending."""
    rows = spark.read.parquet(target)
    bad = (F.coalesce(F.col("error"), F.lit("")) != "") | (F.trim(F.coalesce("raw_answer", F.lit(""))) == "")
    g = rows.groupBy("condition", "model").agg(F.countDistinct("qid").alias("n"), F.count(F.when(bad, 1)).alias("n_error"))
    return g.withColumn("state", F.when(F.col("n_error") > 0, "failed").when(F.col("n") >= n_questions, "done").otherwise("pending"))
