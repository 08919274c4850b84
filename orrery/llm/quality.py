"""Quality by hierarchical empirical Bayes.

A document classifier (logistic, over measures of the text) gives each document its evidence. Labels and
evidence are then pooled along the tree all, host, path: a path's rate is a posterior mean whose prior is
its host's rate, and a host's prior is the global rate. Prior strengths are estimated from the spread of
the rates (method of moments), so a site with few documents stays close to its parent. A document's score
adds, on the log-odds scale, what the rest of its site says beyond the global rate to its own evidence.

Plan at scale: one pass over the texts for the measures; all else is grouped aggregation of sums per host
and path, combined before the shuffle, and a join of documents with their path's one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkernel as tk
from orrery.llm.scratch import Scratch
from orrery.llm.toxicity import logistic

FEATURES = ["log_words", "mean_length", "upper", "digits", "symbols", "distinct", "longest_run", "lines", "stops"]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = True


def measures(w: tk.Words) -> np.ndarray:
    """FEATURES of each text of a run; zeros for a text without words."""
    n = np.diff(w.doc).astype(float)
    e = w.edges

    def per_text(mask):
        c = np.r_[0, np.cumsum(mask)]
        return (c[e[1:]] - c[e[:-1]]).astype(float)

    size = np.maximum(1.0, (e[1:] - e[:-1]).astype(float))
    words = np.maximum(1.0, n)
    length = np.r_[0, np.cumsum(w.end - w.start)]
    row = np.repeat(np.arange(len(n)), np.diff(w.doc))
    distinct, longest, stops = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    if len(row):
        o = np.lexsort((w.hash, row))
        new = np.r_[True, (row[o][1:] != row[o][:-1]) | (w.hash[o][1:] != w.hash[o][:-1])]
        np.add.at(distinct, row[o][new], 1.0)
        turn = np.r_[True, (row[1:] != row[:-1]) | (w.hash[1:] != w.hash[:-1])]
        at = np.flatnonzero(turn)
        np.maximum.at(longest, row[at], np.diff(np.r_[at, len(row)]).astype(float))
        np.add.at(stops, row[(w.end - w.start) <= 3], 1.0)
    out = np.stack([np.log1p(n), (length[w.doc[1:]] - length[w.doc[:-1]]) / words / 10, per_text(_UPPER[w.bytes]) / size * 5, per_text(_DIGIT[w.bytes]) / size * 5, per_text(_SYMBOL[w.bytes]) / size * 10, distinct / words, np.log1p(longest), np.log1p(per_text(w.bytes == 10)) / 3, stops / words], 1)
    out[n == 0] = 0
    return out


def _measure(batches):
    for b in batches:
        for at, w in tk.runs(b.column(b.num_columns - 1)):
            x = measures(w)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(c.slice(at, len(x)) for c in b.columns[:-1]), flat], names=[*b.schema.names[:-1], "x"])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: str, parent: str) -> float:
    """Prior strength (pseudo-documents) from the spread of group rates around their parents.

    ``groups`` has n, the rate and the parent's rate. Between-group variance is total less binomial;
    no spread beyond chance gives a strong prior, bounded to 1 .. 1,000.
    """
    p = F.col(parent)
    r = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col(rate) - p) ** 2).alias("ss"), F.sum(p * (1 - p)).alias("noise"), F.sum(F.col("n") * p * (1 - p)).alias("base")).first()
    if not r["n"]:
        return 10.0
    between = max(0.0, r["ss"] - r["noise"]) / r["n"]
    within = r["base"] / r["n"]
    return float(min(1000.0, max(1.0, within / between - 1 if between > 0 else 1000.0)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = 20_000, evidence_weight: float = 0.25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Return ``doc_id, held_out, evidence, host_rate, path_rate, score, predicted`` for every row of ``docs``.

    Labels of rows whose crc32(id as text) mod 5 is 0 are held out: nothing learns from them. The classifier learns
    from at most ``sample`` of the other labelled ids (those of smallest hash). A labelled row counts as one
    document in its site's sums, any other as ``evidence_weight`` of a document with its evidence as the
    outcome. The rates that a row is given leave the row itself out, so neither its label nor its evidence
    comes back to it through its site. ``score`` is the probability of label 1, ``predicted`` 1 from 0.5.

    Null or empty text: measures of 0, scored like the rest. Null host or path: the site "(none)". Null
    ids: scored, never labelled, not held out. Several labels of an id: their mean; several texts of an id: the
    classifier learns from that with the least measures. No labels: the evidence is 0.5. Repeated rows
    keep their rows. Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    none = F.lit("(none)")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), none).alias("host"), F.coalesce(path.cast("string"), none).alias("path"), F.col(text_col).cast("string").alias("text"))
    seen = scratch.cut(base.mapInArrow(_measure, "doc_id long, host string, path string, x array<double>"), "measures")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).where(~held)
    some = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows
    got = seen.select("doc_id", "x").join(some, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas()
    if len(got) and 0 < got["y"].mean() < 1:
        got = got.sort_values("doc_id")
        x = np.stack(got["x"].to_numpy())
        mean, sd = x.mean(0), x.std(0) + 1e-9
        z = (x - mean) / sd
        w, b = logistic(np.c_[z, z**2], got["y"].to_numpy())
    else:
        mean, sd, w, b = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES)), 0.0
    terms = [(F.col("x")[i] - float(mean[i])) / float(sd[i]) for i in range(len(FEATURES))]
    logit = F.lit(float(b))
    for i, t in enumerate(terms):
        logit = logit + t * float(w[i]) + t * t * float(w[len(FEATURES) + i])
    logit = F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))
    scored = seen.select("doc_id", "host", "path", (1 / (1 + F.exp(-logit))).alias("evidence"))
    scored = scored.join(marks, "doc_id", "left").withColumn("own_n", F.when(F.col("y").isNotNull(), 1.0).otherwise(evidence_weight))
    scored = scratch.cut(scored.withColumn("own_k", F.col("own_n") * F.coalesce("y", "evidence")), "scored")
    paths = scratch.cut(scored.groupBy("host", "path").agg(F.sum("own_n").alias("n"), F.sum("own_k").alias("k")), "paths")
    top = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = min(1 - 1e-6, max(1e-6, top["k"] / top["n"])) if top["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    sh = _strength(hosts.select(F.col("host_n").alias("n"), (F.col("host_k") / F.col("host_n")).alias("raw"), F.lit(rate).alias("up")), "raw", "up")
    hosts = scratch.cut(hosts, "hosts")
    paths = paths.join(hosts, "host")
    up = (F.col("host_k") + sh * rate) / (F.col("host_n") + sh)
    sp = _strength(paths.select("n", (F.col("k") / F.col("n")).alias("raw"), up.alias("up")), "raw", "up")
    out = scored.join(paths, ["host", "path"])
    n, k = F.col("own_n"), F.col("own_k")
    # sums without the row; a table of one row leaves the global rate as it is
    all_n = F.lit(float(top["n"] or 0.0)) - n
    all_rate = F.when(all_n > 1e-9, (F.lit(float(top["k"] or 0.0)) - k) / all_n).otherwise(rate)
    all_rate = F.least(F.greatest(all_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    host_rate = (F.col("host_k") - k + sh * all_rate) / (F.col("host_n") - n + sh)
    path_rate = (F.col("k") - k + sp * F.col("host_rate")) / (F.col("n") - n + sp)
    out = out.withColumn("all_rate", all_rate).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    lo, hi = F.lit(1e-6), F.lit(1 - 1e-6)
    site = _logit(F.least(F.greatest("path_rate", lo), hi)) - _logit(F.col("all_rate"))
    own = _logit(F.least(F.greatest("evidence", lo), hi))
    score = 1 / (1 + F.exp(-(own + site)))
    out = out.withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "evidence", "host_rate", "path_rate", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
