"""What the operators of this package share: inputs, shared folders, texts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


#: Bytes of an Arrow batch: with long texts, batches by rows alone fill the workers' memory.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2_000_000


def size_of(setting: str) -> int:
    """Bytes of a size with or without a unit; what isn't positive is no bound."""
    number, unit = re.match(r"(-?\d+)([kmgtp]?)b?$", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ") if int(number) > 0 else 1 << 62


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for those that don't have it installed; bound the batches that they get."""
    if size_of(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(_local_dir()) / f"basalt-package-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors see.

    Where that setting is absent, a temporary folder is taken on a single machine
    (master local); on a cluster, whose machines don't share one, it's an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{_local_dir()}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@cache
def _local_dir() -> str:
    """The temporary folder of a single machine; it goes with the process."""
    folder = tempfile.mkdtemp(prefix="basalt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def passing(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: the lineage ends there. The folder goes when the application ends."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a list (of two longs, or a digest) that is broadcast: some 50 MB where it is looked up.
LIST_ROWS = 500_000


def listed(rows: DataFrame) -> DataFrame:
    """A written table as a side of a join: broadcast if it's a short list, so that hot keys of the other side stay spread."""
    return F.broadcast(rows) if rows.count() <= LIST_ROWS else rows


def tidied(run):
    """A function over batches that gives back, after each task, what its process holds but doesn't use: workers live on from task to task."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return call


def backquoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that columns of other names can't clash."""
    return df.select(*[F.col(backquoted(n)).alias(n) for n in names])


def texts_of(column) -> list[str]:
    """An Arrow string column as Python strings; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]
