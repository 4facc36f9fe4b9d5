"""Getting the package to where its Python functions run, and tables to where all machines read them."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application: their workers import it without an installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "tree", os.path.basename(package))
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(folder, "lodestone-package"), "zip", os.path.dirname(copy))
        folder_kept = tempfile.mkdtemp(prefix="lodestone-ship-")
        atexit.register(shutil.rmtree, folder_kept, ignore_errors=True)
        keep = os.path.join(folder_kept, os.path.basename(archive))
        shutil.move(archive, keep)
    spark.sparkContext.addPyFile(keep)
    _shipped.add(app)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder within the one that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a folder of our own serves, in local mode only: on a cluster a machine-local
    folder would not be visible to other machines.  It is removed when the interpreter ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = f"{found.rstrip('/') if found else 'file://' + tempfile.gettempdir()}/lodestone-{app}"
        atexit.register(_delete, spark.sparkContext._jvm, _own_dirs[app])
    return _own_dirs[app]


def _delete(jvm, path: str) -> None:
    """Remove a folder, on whichever store; at the interpreter's end the JVM may be gone already, and its folder stays."""
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except (Py4JError, OSError):
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back: for tables that a plan reads several times. Survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """A stored table, marked for broadcast if its rows are within the limit."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df
