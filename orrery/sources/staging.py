"""Written tables that cut the lineage of loops.

They lie below ``spark.checkpoint.dir``, which driver and executors share; a local session without the
setting gets a folder below ``/tmp``. Nothing is kept on one executor alone.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


#: The folder of a local session without the setting, by application.
_LOCAL: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    context = spark.sparkContext
    where = spark.conf.get(_KEY, None) or context.getConf().get(_KEY) or _LOCAL.get(context.applicationId)
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
        where = _LOCAL[context.applicationId] = f"file:///tmp/orrery-{uuid.uuid4().hex[:12]}"
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
    return where.rstrip("/")


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df`` as a table written now; later plans start from its files."""
    spark = df.sparkSession
    path = f"{base(spark)}/staging/{tag}-{uuid.uuid4().hex[:16]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``cut``, once nothing reads it."""
    path = getattr(df, "_staged", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
