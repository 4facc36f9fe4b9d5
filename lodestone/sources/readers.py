"""Readers: JSON lines and documents, polymorphic records, delimited files, forms, responses, paged services."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def json_lines(spark: SparkSession, path: str | list[str], schema: str, optional: bool = False, tolerant: bool = False) -> DataFrame:
    """Rows of JSON lines under a schema; blank lines are skipped, a broken one fails the job, or, if ``tolerant``, is left out
    (``broken_lines`` counts those).  ``optional``: a missing path is an empty table.
    """
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def broken_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n): lines that are neither blank nor JSON, per file that has any."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull()).groupBy("file").agg(F.count("*").alias("n"))


def versions(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, pos, record, key, version): all versions of a folder of record files, each version named by its file, one a key and file."""
    rows = records(spark, path).withColumn("key", F.try_variant_get(F.try_parse_json("record"), key, "string"))
    leaf = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    first = F.row_number().over(Window.partitionBy("file", "key").orderBy("pos"))
    return rows.withColumn("version", leaf).withColumn("_i", first).where("_i = 1").drop("_i")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON object or array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, record): raw JSON records of a directory or file that holds an array, one object, or one object a line.

    The shape is told per file from its text; the record stays a string for from_json or parse_json.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("t"))
    as_array = F.try_parse_json("t")
    whole = F.try_variant_get(as_array, "$", "array<variant>")
    many = F.transform(whole, lambda v: F.to_json(v))
    lines = F.filter(F.transform(F.split("t", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    by_line = F.forall(lines, lambda x: x.startswith("{") & x.endswith("}") & F.try_parse_json(x).isNotNull())
    parts = F.when(F.col("t").startswith("["), many).when(by_line, lines).when(as_array.isNotNull(), F.array("t")).otherwise(lines)
    return files.select("file", F.posexplode(parts).alias("pos", "record"))


def first_per_key(records_: DataFrame, key: str) -> DataFrame:
    """Of records with the same key the one of the first file and place."""
    w = Window.partitionBy(key).orderBy("file", "pos")
    return records_.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


def responses(spark: SparkSession, path: str, schema: str, closed_book: str | None = None) -> DataFrame:
    """All response files of a directory, with file_name; a closed-book directory is added with arm = closedbook."""
    out = spark.read.schema(schema).json(f"{path}/responses_*.jsonl").withColumn("file_name", F.col("_metadata.file_name")).withColumn("arm", F.lit("rag"))
    if closed_book:
        other = spark.read.schema(schema).json(f"{closed_book}/responses_*.jsonl").withColumn("file_name", F.col("_metadata.file_name")).withColumn("arm", F.lit("closedbook"))
        out = out.unionByName(other)
    return out


def form(text: DataFrame) -> DataFrame:
    """(qid, field, value) of Markdown forms: `## qid` sections, `- field: value` entries that may run on, fenced blocks ignored.

    ``text`` is (file, value) with whole files.
    """
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fence", fence).withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1).where(~F.col("inside") & ~F.col("fence"))
    head, entry = F.regexp_extract("line", r"^##\s+(\S+)", 1), F.regexp_extract("line", r"^-\s*([^:：]+?)\s*[:：]", 1)
    lines = lines.withColumn("qid", F.last(F.when(head != "", head), ignorenulls=True).over(w)).withColumn("entry", F.when(entry != "", F.struct("pos", entry.alias("field"))).otherwise(F.when(head != "", F.struct("pos", F.lit("").alias("field")))))
    lines = lines.withColumn("at", F.last("entry", ignorenulls=True).over(w)).where("qid is not null and at.field <> ''")
    own = F.regexp_replace("line", r"^-\s*[^:：]+?\s*[:：]\s*", "")
    g = lines.groupBy("file", "qid", F.col("at.pos").alias("at"), F.col("at.field").alias("field")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", own.alias("v")))), lambda s: s["v"]), "\n").alias("value"))
    return g.select("qid", "field", F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def manifest_conditions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a condition of coverage manifests."""
    schema = "source string, mode string, total_chars bigint, conditions array<struct<mode:string,target_cov:int,strategy:string,unit:string,removed_doc_count:int,kept_unit_count:int,kept_chars:bigint,char_ratio:double,`full`:int,partial:int,none:int,actual_cov:double,target_char_pct:int,char_floor_pct:double,file:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(paths).select("source", F.explode("conditions").alias("c")).select("source", "c.*")


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, fetch: Callable[[int], list[dict]], pages: int):
        self.fields, self.fetch, self.pages = schema.fieldNames(), fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in self.fetch(partition.number):
            yield tuple(r.get(f) for f in self.fields)


def paged_source(name: str, schema: str, fetch: Callable[[int], list[dict]], total: Callable[[], int], page_size: int = 100) -> type[DataSource]:
    """A data source over a paged service: one partition a page. ``fetch(page)`` returns its records, retrying by itself."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return PagedReader(schema, fetch, -(-total() // page_size))

    return Paged


def with_retries(get: Callable[[], str], retries: int = 3, wait: Callable[[float], None] | None = None) -> dict:
    """JSON of a request, tried again with linearly growing pauses."""
    for attempt in range(1, retries + 1):
        try:
            return json.loads(get())
        except (OSError, ValueError):
            if attempt == retries:
                raise
            if wait:
                wait(1.5 * attempt)
    return {}
