"""Shared plumbing: tables, the shared folder, byte-level tokenising, hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import broadcast_if_small, shared_dir  # noqa: F401  operators take both from here

#: Broadcast or driver-held data never exceeds this many bytes; larger inputs go by blocks.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that this process wrote into the shared folder: (application, path, catalogue name or None).
_written: list[tuple[str, str, str | None]] = []


def written(spark: SparkSession, path: str, name: str | None = None) -> None:
    _written.append((spark.sparkContext.applicationId, path, name))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until ``release_tables``, as a result that was not yet read may need it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written(spark: SparkSession) -> int:
    """How many such tables of this application there are."""
    return sum(x[0] == spark.sparkContext.applicationId for x in _written)


def release_tables(spark: SparkSession, since: int = 0, last: bool = True) -> None:
    """Delete the tables that operators wrote after there were ``since`` of them, but for the last one if ``last`` is to stay.

    For when all results that read them have been read or written themselves.
    """
    mine = [x for x in _written if x[0] == spark.sparkContext.applicationId][since:]
    for entry in mine[:-1] if last else mine:
        _, path, name = entry
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove(entry)


def packed(columns: Sequence[str]) -> Column:
    """The columns as one struct, `carried`: no name of theirs can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("carried")


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1).cast("long"))


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Just (doc_id, text as UTF-8 bytes): extra or clashing columns never reach Python, but as `carried` where asked for."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"), *([packed(carry)] if carry else []))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z, every other byte unchanged."""
    return text.translate(_LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of UTF-8 text: bytes.split() splits on exactly these bytes."""
    return text.split() if text else []


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def release_memory() -> None:
    """Give freed memory back to the system: reused workers would keep each stage's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass
