"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs no more than the stage that reads the table. Only a local session may run without
that setting; it then gets a folder of its own below ``/tmp``.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: The folder of a local session without the setting, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get(_KEY, None) or context.getConf().get(_KEY) or _LOCAL.get(context.applicationId)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
        base = _LOCAL[context.applicationId] = f"file:///tmp/orrery-scratch-{uuid.uuid4().hex[:12]}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return base.rstrip("/")


class Scratch:
    """A folder for one run of an operator; tables are dropped as soon as nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        # whole texts and packed blocks are large rows; the default of 10,000 to a batch is for small ones
        if spark.conf.get(_BATCH, "10000") == "10000":
            spark.conf.set(_BATCH, "1024")
        self.root = f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, tag: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{tag}"

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(tag)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give the memory of a finished step back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not glibc: the allocator decides
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """``run`` over batches, after which the worker, which later tasks use again, gives its memory back."""

    def out(batches):
        yield from run(batches)
        release()

    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
