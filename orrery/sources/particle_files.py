"""Particle and spectrum files: Parquet particle tables, cubes of counts, and spectrum text. Snapshots: ``snapshots``.

Particle rows are ``ptype INT, id BIGINT, x, y, z, vx, vy, vz, mass``.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ptype int, id bigint, x double, y double, z double, vx double, vy double, vz double, mass double"
_COLS = ["ptype", "id", "x", "y", "z", "vx", "vy", "vz", "mass"]


def number_rows(df: DataFrame, *keys: str, name: str = "row") -> DataFrame:
    """Consecutive numbers from 0 in the order of ``keys``: ranges are sorted in parallel, and one count per
    range comes to the driver."""
    from orrery.sources.staging import cut

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_p": F.spark_partition_id(), "_q": F.monotonically_increasing_id()}), "rows")
    ordered = ordered.withColumn("_q", F.col("_q").bitwiseAND(F.lit((1 << 33) - 1)))
    before, start = 0, []
    for r in ordered.groupBy("_p").count().orderBy("_p").collect():
        start.append((r["_p"], before))
        before += r["count"]
    at = spark.createDataFrame(start or [(0, 0)], "_p int, _at long")
    return ordered.join(F.broadcast(at), "_p").withColumn(name, F.col("_at") + F.col("_q")).drop("_p", "_q", "_at")


def split_counts(counts: list[int], files: int) -> list[list[tuple[int, int]]]:
    """Per file and type, the segment [start, stop): count // files + 1 rows per file until they run out."""
    out = []
    for f in range(files):
        out.append([(min(c, f * (c // files + 1)), min(c, (f + 1) * (c // files + 1))) for c in counts])
    return out


def file_of(rows: DataFrame, files: int) -> DataFrame:
    """Add ``file`` to rows numbered by type (ptype, row): a type goes to files by ``split_counts``, in order."""
    size = rows.groupBy("ptype").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    out = rows.join(F.broadcast(size), "ptype")  # a row per type
    return out.withColumn("file", F.expr(f"(row - _first) div (_n div {files} + 1)").cast("int")).drop("_n", "_first")


def save_particles(particles: DataFrame, path: str) -> None:
    """A particle table as Parquet, one partition per type."""
    particles.write.mode("errorifexists").partitionBy("ptype").parquet(path)


def load_particles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*_COLS)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """A NumPy ``.npy`` cube as ``cell, v``."""

    def cells(batches):
        import io

        for b in batches:
            for content in b["content"]:
                v = np.load(io.BytesIO(content), allow_pickle=False).ravel()
                for at in range(0, len(v), 1 << 18):
                    yield pd.DataFrame({"cell": np.arange(at, min(len(v), at + (1 << 18))), "v": v[at : at + (1 << 18)].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "cell long, v double")


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """``k, p`` from white-space separated text with ``#`` comments."""
    line = F.trim(F.col("value"))
    parts = F.split(line, r"\s+")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts[0].cast("double").alias("k"), parts[1].cast("double").alias("p"))


def write_spectrum(spectrum: DataFrame, path: str, notes: list[str] = ()) -> None:
    """``kmin kmax kvol P err`` lines below ``#`` notes, in bin order, in one file."""
    spark = spectrum.sparkSession
    head = [f"# {x}" for x in notes] + ["# kmin kmax kvol P err"]
    body = spectrum.select(F.col("bin").alias("o"), F.format_string("%.10e %.10e %.10e %.10e %s", "kmin", "kmax", "kvol", "p", F.coalesce(F.format_string("%.10e", "err"), F.lit("nan"))).alias("value"))
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "o long, value string")
    top.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("errorifexists").text(path)
