"""As-of lookups and interpolation in tables of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orrery.sources.staging import cut

_SIDE, _SALT, _AT, _PART, _FOUND = "_side", "_salt", "_at", "_part", "_found"


def _carry(names: list[str]):
    """Over rows in order, gives every row the columns ``names`` of the last table row at or before it.

    What a task has carried at its end goes out as a row of the table's side, for the tasks after it.
    """

    def run(batches):
        part, last, end = TaskContext.get().partitionId(), None, None
        for b in batches:
            b = pa.Table.from_batches([b])
            table = b.column(_SIDE).to_numpy() == 0
            at = np.maximum.accumulate(np.where(table, np.arange(b.num_rows) + 1, 0))
            values = [pa.concat_arrays([last[k] if last else pa.nulls(1, b.schema.field(n).type), *b.column(n).chunks]) for k, n in enumerate(names)]
            filled = b
            for n, v in zip(names, values, strict=True):
                filled = filled.set_column(filled.column_names.index(n), n, v.take(pa.array(at)))
            found = pa.array((at > 0) | (last is not None))
            filled = filled.append_column(_PART, pa.array(np.full(b.num_rows, part, np.int32))).append_column(_FOUND, found)
            if table.any():
                k = len(table) - int(np.argmax(table[::-1]))
                last = [v.slice(k, 1) for v in values]
                end = filled.slice(k - 1, 1)
            yield from filled.filter(pa.array(~table)).combine_chunks().to_batches()
        if end is not None:
            yield from end.combine_chunks().to_batches()

    return run


def asof(points: DataFrame, at: str, table: DataFrame, x: str, strict: bool = False, parts: int | None = None) -> DataFrame:
    """``points`` with the other columns of the row of ``table`` that has the largest ``x`` not above (``strict``: below) ``at``.

    Both sides are sorted together by ranges of the value, and of a hash behind it, so that one value which very many rows have
    is split, too. A task carries the last table row on to the points after it. Points ahead of the first table row of a
    task take what the tasks before carried: a row a task, so the table is never collected or sent. The table's ``x``
    must be unique; rows with a null or NaN value on either side, and points before the first table row, are left out. Column
    names of both sides must differ.
    """
    names = [c for c in table.columns if c != x]
    key = lambda c: F.col(f"`{c}`").cast("double")
    p = points.where(key(at).isNotNull() & ~F.isnan(key(at))).select("*", *(F.lit(None).cast(table.schema[n].dataType).alias(n) for n in names), key(at).alias(_AT), F.lit(-1 if strict else 1).alias(_SIDE), F.xxhash64(*(F.col(f"`{c}`") for c in points.columns)).alias(_SALT))
    t = table.where(key(x).isNotNull() & ~F.isnan(key(x))).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema), *names, key(x).alias(_AT), F.lit(0).alias(_SIDE), F.lit(0).cast("long").alias(_SALT))
    parts = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [_AT, _SIDE, _SALT]
    both = p.unionByName(t).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in both.schema), T.StructField(_PART, T.IntegerType()), T.StructField(_FOUND, T.BooleanType())])
    filled = cut(both.mapInArrow(_carry(names), schema), "asof")
    # a row for each task that carried something, and for each that has points ahead of its table rows
    ends = filled.where(f"{_SIDE} = 0").select(_PART, F.struct(*names).alias("_carried"))
    asks = filled.where(f"{_SIDE} <> 0 and not {_FOUND}").select(_PART).distinct().select(_PART, F.lit(None).cast(ends.schema["_carried"].dataType).alias("_carried"))
    before = Window.orderBy(_PART, F.col("_carried").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    given = ends.unionByName(asks).withColumn("_given", F.last("_carried", True).over(before)).where("_carried is null and _given is not null").select(_PART, "_given")
    own = filled.where(f"{_SIDE} <> 0")
    done = own.where(_FOUND).select(*points.columns, *names)
    late = own.where(f"not {_FOUND}").join(F.broadcast(given), _PART)  # at most a row for each of the tasks
    return done.unionByName(late.select(*points.columns, *(F.col(f"_given.{n}").alias(n) for n in names)))


def interpolate(points: DataFrame, table: DataFrame, at: str, parts: int | None = None) -> DataFrame:
    """Add ``y``: linear interpolation in ``table(x, y)`` at column ``at``; points outside [first, last) are left out.

    Each table row learns the next one by a lookup of its own in the table turned round, then each point looks up its
    interval. Of rows with equal x the one with the smallest y counts; null or NaN x, null y and null ``at`` are left out.
    """
    t = table.where("x is not null and y is not null and not isnan(x)").groupBy(F.col("x").cast("double").alias("_x0")).agg(F.min(F.col("y").cast("double")).alias("_y0"))
    t = cut(t, "table")
    back = t.select((-F.col("_x0")).alias("_k"), F.col("_x0").alias("_x1"), F.col("_y0").alias("_y1"))
    pieces = asof(t.withColumn("_back", -F.col("_x0")), "_back", back, "_k", strict=True, parts=parts).drop("_back")
    # the last row has no next one; it stays, so that points from there on find it and are left out
    last = t.join(pieces.select("_x0"), "_x0", "left_anti").select("_x0", "_y0", F.lit(None).cast("double").alias("_x1"), F.lit(None).cast("double").alias("_y1"))
    pieces = pieces.unionByName(last).withColumn("_k", F.col("_x0"))
    out = asof(points, at, pieces, "_k", parts=parts).where("_x1 is not null")
    v = F.col("_y0") + (F.col(f"`{at}`").cast("double") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    return out.select(*points.columns, v.alias("y"))
