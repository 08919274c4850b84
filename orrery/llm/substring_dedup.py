"""Substring dedup: remove words inside passages of ``window`` words that occur earlier.

Method: super-k-mer partitioning. The minimiser of a window is the least hash of the ``gram`` consecutive
words in it, frequent ones last. Consecutive windows that share a minimiser travel as one packed string of word hashes to
the bucket of the minimiser; equal windows share a minimiser, so each bucket can sort its windows and
tell the first of each exactly.

Plan at scale: a first pass counts grams in a slot table of fixed size, which tells the frequent ones. A phrase that
stands in many different contexts is then no window's minimiser unless all of the window is frequent, so no
bucket gathers its contexts. Windows that repeat inside a run of texts (about a megabyte) are settled there, so that a
passage in a third of all documents sends one string per run. Strings are first compared as wholes, by
128-bit fingerprints: all but the first of equal strings are repeats, and a string whose minimiser has no
other string is settled too. A task sends only the first of equal strings (those that repeat in it are held until its
end), so a passage that stands everywhere costs its bucket one row a task, not one a run. Only minimisers with different
strings travel packed, in a second pass, again the first of equal strings of each task; a bit
table of fixed size says which. The second pass may meet other runs than the first (file splits and shuffles
differ between jobs), so it goes by minimiser, not by string, and settles the repeats in its own runs
anew. What comes back are spans of words, joined to the texts by id and text hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import slots
from orrery.llm import textkernel as tk
from orrery.llm.scratch import Scratch, fresh, release, trimmed

U = np.uint64
_MARK = np.dtype([("fp", "<u8"), ("fp2", "<u8"), ("least", "<u4"), ("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("n", "<i4")])
_HEAD = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("n", "<i4")])
_NO_ID = (1 << 63) - 1


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (w - have)], a[w - have :]) if w > have else a


def _same(h: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    ok = np.ones(len(i), bool)
    for d in range(k):
        ok &= h[i + d] == h[j + d]
    return ok


def _later(h: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows h[at : at + k] have an equal one with smaller (doc, start)."""
    if not len(at):
        return np.zeros(0, bool)
    code = tk.rolling(h, k)[at]
    o = np.lexsort((start, doc, code))
    head = np.r_[True, code[o][1:] != code[o][:-1]]
    first = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
    if not _same(h, at[o], at[first], k).all():  # two windows share a code: order by the words themselves
        cols = [h[at + d] for d in range(k)]
        o = np.lexsort((start, doc, *cols))
        new = np.zeros(len(o), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[o][1:] != c[o][:-1]
        first = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(at), bool)
    out[o] = (doc[o] != doc[first]) | (start[o] != start[first])
    return out


def _gram_counts(m: int, bits: int):
    def run(batches):
        p = slots.Partial(bits, np.uint16)
        for b in batches:
            for _, w in tk.runs(b.column(0)):
                if len(w.hash) >= m:
                    p.add(tk.rolling(w.hash, m))
        yield from p.batches()

    return run


def _windows(w: tk.Words, ids: np.ndarray, k: int, m: int, frequent: np.ndarray):
    """Of a run: word index, row, word number, minimiser and 'repeats here' of every window.

    Grams are ordered by whether they are frequent, then by 63 bits of their hash.
    """
    n = np.diff(w.doc)
    per = np.maximum(0, n - k + 1)
    row = np.repeat(np.arange(len(n)), per)
    num = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    at = w.doc[:-1][row] + num
    if not len(at):
        return at, row, num, np.empty(0, U), np.zeros(0, bool)
    code = tk.rolling(w.hash, m)
    code = (code >> U(1)) | (slots.test_bits(frequent, code).astype(U) << U(63))
    least = _sliding_min(code, k - m + 1)[at]
    return at, row, num, least, _later(w.hash, at, ids[row], num, k)


def _spans(num: np.ndarray, k: int) -> bytes:
    """Ascending window numbers as (first word, end word) pairs of int32."""
    cut = np.flatnonzero(np.r_[True, num[1:] > num[:-1] + k])
    end = np.r_[num[cut[1:] - 1], num[-1:]] + k
    return np.stack([num[cut], end], 1).astype("<i4").tobytes()


def _strings(row, num, least, keep):
    """Cut the kept windows into super-k-mers: index of the first window, number of windows."""
    i = np.flatnonzero(keep)
    if not len(i):
        return i, i
    new = np.r_[True, (i[1:] != i[:-1] + 1) | (row[i][1:] != row[i][:-1]) | (least[i][1:] != least[i][:-1])]
    s = np.flatnonzero(new)
    return i[s], np.diff(np.r_[s, len(i)])


def _fingerprints(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each stretch of word hashes."""
    out = []
    for salt, p in ((U(0x2545F4914F6CDD1D), 0xD1342543DE82EF95), (U(0x9FB21C651E98DF25), 0xAF251AF3B0F025B5)):
        with np.errstate(over="ignore"):
            up, down = np.full(len(h) + 1, p, U), np.full(len(h) + 1, pow(p, -1, 1 << 64), U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
            total = np.zeros(len(h) + 1, U)
            np.cumsum(tk.mix(h ^ salt) * up[:-1], out=total[1:], dtype=U)
            out.append(tk.mix((total[end] - total[start]) * down[start] + (end - start).astype(U)))
    return out[0], out[1]


def _kind(least: np.ndarray) -> np.ndarray:
    """Code of a minimiser in the bit table."""
    return tk.mix(least.astype(U) & U(0xFFFFFFFF))


def _bucket(least: np.ndarray, buckets: int) -> np.ndarray:
    return (_kind(least) % U(buckets)).astype(np.int64)


def _order(x: np.ndarray):
    """Of marks: their order by string, document and start; in it, which head a string, which repeat an
    earlier one, and which differ from the mark before (equal rows stand for one).

    Marks at one start of one document do not repeat each other.
    """
    o = np.lexsort((x["text"], x["start"], x["doc"], x["fp2"], x["fp"]))
    y = x[o]
    if not len(y):
        none = np.zeros(0, bool)
        return o, none, none, none
    head = np.r_[True, (y["fp"][1:] != y["fp"][:-1]) | (y["fp2"][1:] != y["fp2"][:-1])]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (y["doc"] != y["doc"][first]) | (y["start"] != y["start"][first])
    new = head | np.r_[True, (y["doc"][1:] != y["doc"][:-1]) | (y["start"][1:] != y["start"][:-1]) | (y["text"][1:] != y["text"][:-1])]
    return o, head, late, new


def _whole(y: np.ndarray, k: int) -> list[tuple[int, int, bytes]]:
    """(doc, text, spans) of strings that go as wholes."""
    y = y[np.lexsort((y["start"], y["text"], y["doc"]))]
    if not len(y):
        return []
    cut = np.flatnonzero(np.r_[True, (y["doc"][1:] != y["doc"][:-1]) | (y["text"][1:] != y["text"][:-1])])
    span = np.stack([y["start"], y["start"] + y["n"] + k - 1], 1).astype("<i4")
    return [(int(y["doc"][i]), int(y["text"][i]), span[i:j].tobytes()) for i, j in zip(cut.tolist(), np.r_[cut[1:], len(y)].tolist(), strict=True)]


def _picked(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``size`` words from ``at`` on, one after another."""
    return words[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class _Pool:
    """Strings of a task, of which only the first of equal ones goes out.

    ``limit`` strings are held. When they are full the strings that occurred once go out, and those that repeat stay
    for the rest of the task (half of ``limit`` at most, so that there is always room; others go out too, which costs rows).
    """

    def __init__(self, k: int, limit: int):
        self.k, self.limit = k, limit
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, mark: np.ndarray, words: np.ndarray) -> bool:
        """Hold marks (and the words of their strings, or none at all); True when full."""
        self.held.append((mark, words))
        self.n += len(mark)
        return self.n >= self.limit

    def take(self, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks that go out, their words, and marks that repeat an earlier one of the task."""
        mark = np.concatenate([m for m, _ in self.held] or [np.empty(0, _MARK)])
        words = np.concatenate([w for _, w in self.held] or [np.empty(0, U)])
        self.held, self.n = [], 0
        size = mark["n"].astype(np.int64) + self.k - 1 if len(words) else np.zeros(len(mark), np.int64)
        at = np.cumsum(size) - size
        o, head, late, new = _order(mark)
        if not len(o):
            return mark, words, mark
        often = np.diff(np.r_[np.flatnonzero(head), len(o)])[np.cumsum(head) - 1] > 1
        keep = new & ~late
        stay = keep & often & (not last)
        stay &= np.cumsum(stay) <= self.limit // 2
        if stay.any():
            i = o[stay]
            self.add(mark[i], _picked(words, at[i], size[i]))
        i = o[keep & ~stay]
        return mark[i], _picked(words, at[i], size[i]), mark[o[late]]


def _grouped(to: np.ndarray):
    """(value, from, end) of each stretch of equal values."""
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return zip(to[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(to)].tolist(), strict=True)


_SENT = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("text", pa.int64()), ("data", pa.binary())])
_SENT_SQL = "bucket int, doc long, text long, data binary"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SENT, strict=True)], schema=_SENT)


def _runs(batches, k: int, m: int, frequent: np.ndarray):
    """Of each run: its words, ids, text hashes, windows, and the strings of windows new to it."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        texts = b.column(1).to_numpy(zero_copy_only=False)
        for at0, w in tk.runs(b.column(2)):
            at, row, num, least, again = _windows(w, ids[at0:], k, m, frequent)
            if len(at):
                s, n = _strings(row, num, least, ~again)
                yield w, ids[at0:], texts[at0:], at, row, num, least, again, s, n


def _settled(ids, texts, row, num, r: np.ndarray, k: int, buckets: int) -> list[tuple]:
    """Rows with the spans of the windows r, on any bucket."""
    return [(int(ids[d]) % buckets, int(ids[d]), int(texts[d]), _spans(num[r[i:j]], k)) for d, i, j in _grouped(row[r])] if len(r) else []


def _marks(w, ids, texts, at, row, num, least, s, n, k: int) -> np.ndarray:
    mark = np.empty(len(s), _MARK)
    mark["fp"], mark["fp2"] = _fingerprints(w.hash, at[s], at[s] + n + k - 1)
    mark["least"], mark["doc"], mark["text"], mark["start"], mark["n"] = least[s] & U(0xFFFFFFFF), ids[row[s]], texts[row[s]], num[s], n
    return mark


def _announce(k: int, m: int, frequent, buckets: int, hold: int = 1 << 18):
    """Fingerprints of strings for a bucket, and spans settled in a task (rows with a document), on any."""
    none = np.empty(0, U)

    def run(batches):
        pool = _Pool(k, hold)

        def out(last=False):
            mark, _, late = pool.take(last)
            rows = [(d % buckets, d, t, data) for d, t, data in _whole(late, k)]
            to = _bucket(mark["least"], buckets)
            o = np.argsort(to, kind="stable")
            if len(o):
                rows += [(t, None, None, mark[o[i:j]].tobytes()) for t, i, j in _grouped(to[o])]
            return [_batch(rows)] if rows else []

        for w, ids, texts, at, row, num, least, again, s, n in _runs(batches, k, m, frequent.value):
            rows = _settled(ids, texts, row, num, np.flatnonzero(again), k, buckets)
            if rows:
                yield _batch(rows)
            if len(s) and pool.add(_marks(w, ids, texts, at, row, num, least, s, n, k), none):
                yield from out()
        yield from out(last=True)

    return run


def _compare(k: int):
    """Of a bucket: spans of strings that repeat an earlier one whole, and (rows without a document) the
    codes of minimisers with different strings."""

    def run(t: pa.Table) -> pa.Table:
        settled = t.filter(pa.compute.is_valid(t.column("doc"))).select(["doc", "text", "data"])
        t = t.filter(pa.compute.is_null(t.column("doc")))
        x = np.frombuffer(b"".join(t.column("data").to_pylist()), _MARK)
        if not len(x):
            return settled
        o, head, late, _ = _order(x)
        own = x[o[head]]
        kinds = np.sort(own["least"])
        at = np.searchsorted(kinds, own["least"])
        many = np.searchsorted(kinds, own["least"], side="right") - at > 1
        rows = [(None, None, _kind(np.unique(own["least"][many])).tobytes())] if many.any() else []
        rows += _whole(x[o[late]], k)
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        new = pa.table({"doc": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary())})
        del x, own, o, head, late
        release()
        return pa.concat_tables([new, settled])

    return run


def _wanted(bits: int):
    def run(batches):
        p = slots.Bits(bits)
        for b in batches:
            for data in b.column(0).to_pylist():
                p.add(np.frombuffer(data, "<u8"))
        yield from p.batches()

    return run


def _send(k: int, m: int, frequent, wanted, buckets: int, hold: int = 1 << 17):
    """Packed strings whose minimiser is wanted, for its bucket, and (rows with a document) spans of windows
    of wanted minimisers that repeat in the task."""

    def run(batches):
        table = wanted.value
        pool = _Pool(k, hold)

        def out(last=False):
            mark, words, late = pool.take(last)
            rows = [(d % buckets, d, t, data) for d, t, data in _whole(late, k)]
            to = _bucket(mark["least"], buckets)
            o = np.argsort(to, kind="stable")
            if len(o):
                size = mark["n"].astype(np.int64) + k - 1
                words = _picked(words, (np.cumsum(size) - size)[o], size[o])
                edge = np.r_[0, np.cumsum(size[o])]
                head = np.empty(len(o), _HEAD)
                for name in _HEAD.names:
                    head[name] = mark[name][o]
                rows += [(t, None, None, np.int32(j - i).tobytes() + head[i:j].tobytes() + words[edge[i] : edge[j]].tobytes()) for t, i, j in _grouped(to[o])]
            return [_batch(rows)] if rows else []

        for w, ids, texts, at, row, num, least, again, s, n in _runs(batches, k, m, frequent.value):
            r = np.flatnonzero(again)
            rows = _settled(ids, texts, row, num, r[slots.test_bits(table, _kind(least[r]))], k, buckets)
            if rows:
                yield _batch(rows)
            ok = slots.test_bits(table, _kind(least[s]))
            s, n = s[ok], n[ok]
            if len(s) and pool.add(_marks(w, ids, texts, at, row, num, least, s, n, k), _picked(w.hash, at[s], n + k - 1)):
                yield from out()
        yield from out(last=True)

    return run


def _sort_bucket(k: int):
    def run(t: pa.Table) -> pa.Table:
        settled = t.filter(pa.compute.is_valid(t.column("doc"))).select(["doc", "text", "data"])
        t = t.filter(pa.compute.is_null(t.column("doc")))
        if not len(t):
            return settled
        heads, words = [], []
        for d in t.column("data").to_pylist():
            n = int(np.frombuffer(d, "<i4", 1)[0])
            heads.append(np.frombuffer(d, _HEAD, n, 4))
            words.append(np.frombuffer(d, "<u8", -1, 4 + n * _HEAD.itemsize))
        head, h = np.concatenate(heads), np.concatenate(words)
        n = head["n"].astype(np.int64)
        first = np.cumsum(n + k - 1) - (n + k - 1)
        # equal strings of different tasks: only the first one's windows are laid out
        mark = np.zeros(len(head), _MARK)
        for name in _HEAD.names:
            mark[name] = head[name]
        mark["fp"], mark["fp2"] = _fingerprints(h, first, first + n + k - 1)
        o, _, late, new = _order(mark)
        out = _whole(mark[o[late]], k)
        own = o[new & ~late]
        head, n, first = head[own], n[own], first[own]
        rec = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
        doc, start = head["doc"][rec], head["start"][rec] + off
        hit = np.flatnonzero(_later(h, first[rec] + off, doc, start, k))
        text = head["text"][rec]
        hit = hit[np.lexsort((start[hit], text[hit], doc[hit]))]
        if len(hit):
            cut = np.flatnonzero(np.r_[True, (doc[hit][1:] != doc[hit][:-1]) | (text[hit][1:] != text[hit][:-1])])
            out += [(int(doc[x[0]]), int(text[x[0]]), _spans(start[x], k)) for x in np.split(hit, cut[1:])]
        new = pa.table({"doc": pa.array([x[0] for x in out], pa.int64()), "text": pa.array([x[1] for x in out], pa.int64()), "data": pa.array([x[2] for x in out], pa.binary())})
        del head, h, heads, words, mark, rec, off, doc, start, hit, text
        release()
        return pa.concat_tables([new, settled])

    return run


def _cut_texts(text_at: int, names: list[str]):
    def run(batches):
        for b in batches:
            kept, total, gone = [], [], []
            for t, spans in zip(b.column(text_at).cast(pa.large_binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                words = (t or b"").split()
                n = len(words)
                if spans:
                    drop = np.zeros(n + 1, np.int32)
                    for s in spans:
                        s = np.frombuffer(s, "<i4").reshape(-1, 2)
                        np.add.at(drop, s[:, 0], 1)
                        np.add.at(drop, s[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:n]) == 0).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                total.append(n)
                gone.append(n - len(words))
            cols = b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 5, bits: int = 27, gram_bits: int = 22, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``docs`` with ``kept_text``, ``n_words``, ``n_removed`` appended.

    Words are runs of non-space characters (ASCII space and controls 9-13), unchanged. A word goes if a
    window of ``window`` words of its document covers it whose word sequence also starts earlier
    (smaller id, or same id and earlier start) in the input. Kept words are joined by one space.
    ``bits`` bounds the broadcast filter (2**bits / 8 bytes), ``gram_bits`` that of frequent grams, ``bucket_bytes`` the text whose strings meet in
    one bucket, about.

    Null text: no words, empty kept text. Null id: after all other ids; rows with null ids are one
    document, as are rows that repeat an id, so windows at equal starts of them do not remove each other.
    Empty table: no rows. Other columns pass through; a column that has the name of an added one is
    replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    added = ["kept_text", "n_words", "n_removed"]
    docs = docs.drop(*added)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    src = docs.select(key.alias("doc"), F.xxhash64(F.col(text_col)).alias("text"), F.col(text_col).alias("body"))
    total = src.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(64, -(-total // bucket_bytes))
    share = 2.0 ** (5 - gram_bits)  # 32 times a slot's even share
    frequent = src.select("body").mapInArrow(trimmed(_gram_counts(gram, gram_bits)), slots.SCHEMA)
    frequent = spark.sparkContext.broadcast(slots.heavy(frequent, gram_bits, share, 500))
    told = src.mapInArrow(trimmed(_announce(window, gram, frequent, buckets)), _SENT_SQL)
    spans_sql = "doc long, text long, data binary"
    told = scratch.cut(told.groupBy("bucket").applyInArrow(_compare(window), spans_sql), "told")
    wanted = slots.bit_table(told.where("doc is null").select("data").mapInArrow(_wanted(bits), slots.SCHEMA), bits)
    wanted = spark.sparkContext.broadcast(wanted)
    sent = src.mapInArrow(trimmed(_send(window, gram, frequent, wanted, buckets)), _SENT_SQL)
    spans = sent.groupBy("bucket").applyInArrow(_sort_bucket(window), spans_sql).union(told.where("doc is not null"))
    spans = scratch.cut(spans, "spans").groupBy("doc", "text").agg(F.collect_list("data").alias("_spans"))
    scratch.drop(told)
    wanted.destroy()
    frequent.destroy()
    del wanted, frequent
    release()
    names = docs.columns
    d, t, found = fresh(docs, "_doc", "_text", "_spans")
    keyed = docs.select("*", key.alias(d), F.xxhash64(F.col(text_col)).alias(t))
    joined = keyed.join(spans.withColumnsRenamed({"doc": d, "text": t, "_spans": found}), [d, t], "left").select(*names, found)
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(trimmed(_cut_texts(names.index(text_col), [*names, *added])), schema)


def digest(df: DataFrame) -> DataFrame:
    """``kept_sha256``: lowercase hex SHA-256 of the kept text in UTF-8."""
    return df.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))
