"""Interaction audit of five filters under all 120 orders of applying them.

Method: first-failure lookup. A document is five bits, one for each filter that it fails. ``TABLE`` has, for each
of the 32 patterns and 120 orders, the step that removes such a document (0: none). ``mapInArrow`` indexes it with
the patterns of a batch, ``np.bincount`` adds removals up by part, order, step and label, and the arrays of all tasks are
summed. All columns follow from those sums: what fails a filter is what it removes when it stands first, what fails it
alone is what it removes when it stands last.

Plan at scale: the texts are read once, by a map that keeps a row of some 60 bytes a document, which is written. Repeated
texts are found by a partial aggregation over 128-bit digests; only digests with two rows or more are joined back, and what
hot texts would gather is split by the skew join, as a row joins one row. A task sends a row per part and 512 parts at a time.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.scratch import Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Characters that filter D looks for.
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
#: Parts that a task holds counts of at a time (23 KB each).
PARTS = 512


def first_failures() -> np.ndarray:
    """[pattern, order]: the step, from 1, whose filter the pattern fails first; 0 if none."""
    failed = np.arange(32)[:, None, None] >> np.array([[FILTERS.index(f) for f in o] for o in ORDERS])[None] & 1
    return np.where(failed.any(2), failed.argmax(2) + 1, 0).astype(np.int64)


TABLE = first_failures()


def _measure(batches):
    for b in batches:
        texts = b.column("_text")
        points = pc.utf8_length(texts).to_pylist()
        bits, digests = [], []
        for t, chars in zip(texts.cast(pa.binary()).to_pylist(), points, strict=True):
            words = t.split()  # of bytes: the same six characters separate
            n = len(words)
            upper = len(t) - len(t.translate(None, _UPPER))
            symbols = len(t.translate(None, SYMBOLS)) < len(t)
            bits.append((n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 3 * chars) << 2 | symbols << 3)
            digests.append(hashlib.blake2b(t, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "bits", "digest"])


def patterns(docs: DataFrame) -> DataFrame:
    """``doc_id, part, bits``: a row per row of ``docs``, with bit i of ``bits`` set if it fails filter i of ``ABCDE``."""
    src = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(lang as string), '') as part", "coalesce(cast(text as string), '') as _text")
    rows = Scratch(docs.sparkSession, "audit").cut(src.mapInArrow(_measure, "doc_id long, part string, bits int, digest binary"), "patterns")
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(copied, "digest", "left")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return out.select("doc_id", "part", F.col("bits").bitwiseOR(F.when(again, 16).otherwise(0)).alias("bits"))


def _count(batches):
    """A row per part with the removals [order, step] of all rows, those with quality 1, and those with toxic 1."""
    sums: dict[str, np.ndarray] = {}
    orders = np.arange(len(ORDERS)) * 6

    def flushed():
        parts = list(sums)
        cells = [np.stack([sums[p][:, k] for p in parts]) for k in range(3)]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * 720), pa.array(c.reshape(-1))) for c in cells]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *lists], names=["part", "removed", "good", "toxic"])

    for b in batches:
        coded = b.column("part").dictionary_encode()
        names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        bits, good, toxic = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bits", "good", "toxic"))
        label = good.astype(np.int64) | toxic.astype(np.int64) << 1
        for at in range(0, b.num_rows, 4096):
            few, own = np.unique(part[at : at + 4096], return_inverse=True)
            if sums and len(sums) + len(few) > PARTS:
                yield flushed()
            # bounded by the rows of the slice and PARTS at once
            for lo in range(0, len(few), PARTS):
                of = (own >= lo) & (own < lo + PARTS)
                cell = (own[of] - lo)[:, None] * 720 + orders + TABLE[bits[at : at + 4096][of]]
                n = min(PARTS, len(few) - lo)
                got = np.bincount((cell * 4 + label[at : at + 4096][of][:, None]).ravel(), minlength=n * 2880).reshape(n, 720, 4)
                for k, c in enumerate(few[lo : lo + PARTS]):
                    v = np.stack([got[k].sum(1), got[k][:, 1] + got[k][:, 3], got[k][:, 2] + got[k][:, 3]], 1)
                    sums[names[c]] = sums[names[c]] + v if names[c] in sums else v
                if len(sums) >= PARTS:
                    yield flushed()
    if sums:
        yield flushed()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A part is a value of ``lang`` (null: the empty string). Every part has a row for each order and step. ``shapley`` is
    what the step's filter removes, summed over all orders; divided by 120 it is its Shapley value.

    Null texts count as empty ones, which equal each other. A null id is never larger than another, so such a row repeats
    nothing, and it has no label. Rows that repeat an id count each; with equal texts they do not repeat each other, as no id
    is smaller. Of several labels of an id, 1 wins. No rows give none.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    rows = patterns(docs).join(marks, "doc_id", "left").select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    cells = rows.mapInArrow(_count, "part string, removed array<long>, good array<long>, toxic array<long>")
    cells = cells.select("part", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("cell", "v"))
    sums = cells.groupBy("part", "cell").agg(*(F.sum(f"v.{c}").alias(c) for c in ("removed", "good", "toxic")))
    names = F.array(*map(F.lit, ORDERS))
    step = (F.col("cell") % 6).cast("int")
    sums = sums.withColumns({"filter_order": F.get(names, (F.col("cell") / 6).cast("int")), "step": step})
    order = Window.partitionBy("part", "filter_order")
    done = F.sum(F.when(F.col("step") > 0, F.col("removed")).otherwise(0)).over(order.orderBy("step"))
    sums = sums.withColumn("kept", F.sum("removed").over(order) - done).where("step > 0")
    sums = sums.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    one = Window.partitionBy("part", "filter")
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(one)
    return sums.select(
        "part", "filter_order", "step", "filter", "kept", "removed",
        (at(1) - F.col("removed")).alias("redundant"),
        at(len(FILTERS)).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("removed").over(one).alias("shapley"),
    )
