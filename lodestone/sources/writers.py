"""Writers: JSON lines, delimited files, reports, guarded overwrite, content-keyed caches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_document(df: DataFrame, path: str, wrap: str | None = None) -> None:
    """One JSON document: an array of the rows, or an object that has it under ``wrap``. For small tables: one task gathers them, in order of their text."""
    rows = F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))
    body = F.concat(F.lit("["), F.array_join(rows, ",\n"), F.lit("]"))
    whole = body if wrap is None else F.concat(F.lit("{" + f'"{wrap}": '), body, F.lit("}"))
    df.agg(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def delimited(df: DataFrame, path: str, sep: str = ",", bom: bool = False) -> None:
    """CSV or TSV with a header, as one file a task; ``bom`` puts a byte-order mark before the header, for spreadsheet programs (small tables: one file)."""
    if not bom:
        df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
        return
    quote = lambda c: F.when(c.rlike(f'[{sep}"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(sep, *(quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    head = df.sparkSession.createDataFrame([("﻿" + sep.join(df.columns), 0)], "value string, _i int")
    head.unionByName(df.select(line.alias("value"), F.lit(1).alias("_i"))).coalesce(1).sortWithinPartitions("_i").select("value").write.mode("overwrite").text(path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of a small aggregate; numbers to four digits; rows beyond ``limit`` are counted below the table."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    found = df.limit(limit + 1).collect()
    rows = [" | ".join(map(show, r)) for r in found[:limit]]
    if len(found) > limit:
        rows.append(f"... {df.count() - limit} more" + " | " * (len(df.columns) - 1))
    return "\n".join([f"## {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {r} |" for r in rows), ""])


def report(sections: Sequence[tuple[str, DataFrame]]) -> str:
    return "\n".join(markdown(df, title) for title, df in sections)


def guarded(df: DataFrame, path: str, spark: SparkSession, fmt: str = "parquet", shrink: float = 0.1) -> str:
    """Write next to ``path`` and check the count against what is there; refuses to lose more than ``shrink`` of the rows. Returns the new path."""
    fresh = f"{path}.new"
    df.write.mode("overwrite").format(fmt).save(fresh)
    now = spark.read.schema(df.schema).format(fmt).load(fresh).count()
    try:
        before = spark.read.format(fmt).load(path).count()
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = 0
    if now < before * (1 - shrink):
        raise ValueError(f"{now} rows would replace {before}")
    return fresh


def content_key(df: DataFrame, *columns: str) -> str:
    """md5 of a table's rows, whatever their order: sums of two 32-bit parts of row digests."""
    d = F.md5(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    part = lambda i: F.sum(F.conv(F.substring(d, i, 8), 16, 10).cast("long")).alias(f"p{i}")
    r = df.agg(part(1), part(9), F.count("*").alias("n")).first()
    return f"{r['n']}-{r['p1'] or 0:x}-{r['p9'] or 0:x}"


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a content key; made and written if it isn't there."""
    path = f"{root}/cache-{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)
