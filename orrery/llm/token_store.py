"""Token ids in a content-addressed store.

Each document's ids are cut where a rolling hash of 16 ids meets a pattern, so equal passages make equal
chunks wherever they stand. A chunk is named by its SHA-256. The store is a Parquet table in ascending id
order, a row per document: its recipe (chunk names and lengths), the bytes of the chunks that it owns,
and for chunks owned by an earlier document a reference. A chunk's owner is its first document, so
each is stored once. Digests form a Merkle tree: chunks, documents (over their chunk names), shards
(over their documents) and a manifest (over the shards), which reading and ``verify`` recompute.

Plan at scale: texts are encoded once; what is shuffled after that is chunk names (to find repeats), the
ids once by ranges of document id, and on reading only chunks that are shared.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkernel as tk
from orrery.llm.scratch import Scratch

U = np.uint64
WINDOW, AVERAGE, LEAST, MOST = 16, 256, 64, 1024
#: Words whose ids a Python worker keeps.
CACHE = 600_000
_RECENT = 1 << 16
_ROW = "doc_id long, leaf binary, kind int, n_tokens long, names binary, sizes binary, data binary, refs binary"
#: Classes of bytes: 0 white space, 1 letters (ASCII, and both bytes of Latin-1 letters), 2 digits, 3 others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
#: ASCII bytes that the fast way leaves to the library: controls, and the apostrophe of contractions.
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = _ODD[39] = True
_ODD[[9, 10, 13]] = False


#: The parts of a tokenizer that the fast way of ``Encoder`` stands for. Fixed values.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def splits_by_word(spec: str) -> bool:
    """Whether a tokenizer's JSON says that it encodes words one by one, as the fast way of ``Encoder`` takes it to.

    Its normalizer and pre-tokenizer must be those of _BY_WORD, its model a deterministic BPE, and its special tokens
    must begin with "<|" (texts with that go to the library whole).
    """
    d = json.loads(spec)
    model = d.get("model") or {}
    added = all(t["content"].startswith("<|") for t in d.get("added_tokens") or [])
    return added and all(d.get(k) == v for k, v in _BY_WORD.items()) and model.get("type") == "BPE" and not model.get("dropout")


def plain_texts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts hold ASCII and Latin-1 letters alone, with none of _ODD and no special token."""
    bad = _ODD[data]
    high = data >= 128
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    bad |= high & ~lead & ~after
    bad |= after & ((data == 0x97) | (data == 0xB7) | (data < 128))
    bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # how special tokens begin
    total = np.r_[0, np.cumsum(bad)]
    return total[edges[1:]] == total[edges[:-1]]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals, as UTF-8 bytes, to lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    up = np.zeros(len(data), bool)
    up[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out[up] += 32
    return out


class Encoder:
    """The tokenizers library over runs of texts, with the ids of recent words kept.

    Where the tokenizer lower-cases, drops white space, and splits in contractions, runs of letters, single
    digits, and runs of the rest (``splits_by_word``), plain texts (see ``plain_texts``) are split on
    whole runs at once, and each word not met before goes to the library's model alone: the same ids,
    without its bookkeeping of offsets. All other texts, and all texts of other tokenizers, go to
    the library whole. Words are told apart by 64-bit hashes.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from orrery.llm.bpe import byte_letters

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.by_word = splits_by_word(spec)
        self.letters = byte_letters()
        self._forget()

    def _forget(self) -> None:
        # hashes of known words, sorted, with their number; the latest are in a dict until they are merged
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.recent: dict[int, int] = {}
        self.count = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, "<u4")
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, keys: list[int], words: list[bytes]) -> np.ndarray:
        """Number new words and keep their ids."""
        tokenize, letters = self.model.tokenize, self.letters
        # words have no white space or controls: their ASCII characters stand for themselves
        found: list[int] = []
        upto = [0]
        for w in words:
            found += [t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(letters))]
            upto.append(len(found))
        ids, size = np.array(found, np.uint32), np.diff(upto).astype(np.int32)
        n, to, used = self.count, self.count + len(words), self.used + len(ids)
        while to > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[n:to], self.size[n:to] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : used] = ids
        self.recent.update(zip(keys, range(n, to), strict=True))
        self.count, self.used = to, used
        return np.arange(n, to)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes, -1 where unknown."""
        if len(self.recent) > _RECENT:
            keys = np.concatenate([self.keys, np.array(list(self.recent), np.uint64)])
            number = np.concatenate([self.number, np.array(list(self.recent.values()), np.int32)])
            o = np.argsort(keys)
            self.keys, self.number, self.recent = keys[o], number[o], {}
        where = np.full(len(key), -1, np.int64)
        if len(self.keys):
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            where[hit] = self.number[at[hit]]
        lost = np.flatnonzero(where < 0)
        recent = self.recent.get
        where[lost] = [recent(k, -1) for k in key[lost].tolist()]
        return where

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text]))[0]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        out: list[np.ndarray] = []
        if not self.by_word:
            return [self.whole(t or "") for t in texts.to_pylist()]
        for at, data, edges in tk.raw_runs(texts):
            plain = plain_texts(data, edges)
            if self.count > CACHE:
                self._forget()
            w = tk.Words(lower_latin(data), edges, False, _CLASS)
            key, back = np.unique(w.hash, return_inverse=True)
            where = self._find(key)
            miss = np.flatnonzero(where < 0)
            if len(miss):
                first = np.full(len(key), -1, np.int64)
                inside = np.flatnonzero(np.repeat(plain, np.diff(w.doc)))
                first[back[inside]] = inside  # one occurrence in a plain text
                miss = miss[first[miss] >= 0]
                all_bytes, i = w.bytes.tobytes(), first[miss]
                words = [all_bytes[x:y] for x, y in zip(w.start[i].tolist(), w.end[i].tolist(), strict=True)]
                where[miss] = self._learn(key[miss].tolist(), words)
            word = np.maximum(where, 0)[back]
            size = np.where(where[back] < 0, 0, self.size[word]).astype(np.int64)
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(self.start[word] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            edge = np.r_[0, ends][w.doc]
            for k, ok in enumerate(plain.tolist()):
                out.append(ids[edge[k] : edge[k + 1]] if ok else self.whole(texts[at + k].as_py() or ""))
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(spec) -> Encoder:
    key = hash(spec.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value)
    return _encoders[key]


#: ``tk.mix`` of an id and 1, for ids of two bytes.
_MIXED = tk.mix(np.arange(1, (1 << 16) + 1, dtype=U))


def cuts(ids: np.ndarray) -> np.ndarray:
    """Chunk lengths of one document's ids, from the ids alone."""
    return np.array(cuts_of(ids, [0, len(ids)])[0], np.int64)


def cuts_of(ids: np.ndarray, edges: list[int]) -> list[list[int]]:
    """``cuts`` of each of the documents whose ids lie between ``edges``."""
    found: np.ndarray = np.empty(0, np.int64)
    if len(ids) >= WINDOW:
        with np.errstate(over="ignore"):
            h = _MIXED.take(ids) if ids.max() < len(_MIXED) else tk.mix(ids.astype(U) + U(1))
            p, step = U(0x9E3779B97F4A7C15), 1
            while step < WINDOW:
                t = h[:-step] * p
                t += h[step:]
                h, p, step = t, p * p, step * 2
        # windows over the end of a document are left out below
        found = np.flatnonzero(tk.mix(h) % U(AVERAGE) == 0) + WINDOW
    first = np.searchsorted(found, np.asarray(edges[:-1]) + WINDOW).tolist()
    last = np.searchsorted(found, edges[1:], side="right").tolist()
    ends, out = found.tolist(), []
    for begin, end, i, j in zip(edges[:-1], edges[1:], first, last, strict=True):
        n = end - begin
        if n <= LEAST:
            out.append([n] if n else [])
            continue
        size, at = [], begin
        for e in [*ends[i:j], end]:
            while e - at > MOST:
                size.append(MOST)
                at += MOST
            if e - at >= LEAST or e == end and e > at:
                size.append(e - at)
                at = e
        out.append(size)
    return out


def _edges(size, width: int) -> list[int]:
    """Where chunks of so many ids begin and end, in bytes."""
    return [0, *accumulate([n * width for n in size])]


def _sizes(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 2}H", data)


def _encode(spec, end_id: int, width: int):
    kind = f"<u{width}"

    def run(batches):
        enc = _encoder(spec)
        end = np.array([end_id], "<u4")
        pack = zstandard.ZstdCompressor(level=3).compress
        sha = hashlib.sha256
        for b in batches:
            for c in range(0, b.num_rows, 256):
                part = b.slice(c, 256)
                lists = enc.encode_all(part.column(1))
                ids = np.concatenate([x for own in lists for x in (own, end)])
                at = [0, *accumulate([len(x) + 1 for x in lists])]
                data = memoryview(ids.astype(kind).tobytes())
                rows = []
                for i, j, size in zip(at[:-1], at[1:], cuts_of(ids, at), strict=True):
                    own = data[i * width : j * width]
                    edge = _edges(size, width)
                    names = b"".join([sha(own[x:y]).digest() for x, y in zip(edge[:-1], edge[1:], strict=True)])
                    rows.append((sha(names).digest(), 1, j - i, names, struct.pack(f"<{len(size)}H", *size), pack(own), None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.binary())], names=["doc_id", "leaf", "kind", "n_tokens", "names", "sizes", "data", "refs"])

    return run


def _names(batches):
    """Rows (chunk name, document, place) of the recipes."""
    for b in batches:
        doc, leaf, names = b.column(0), b.column(1), b.column(2).to_pylist()
        n = [len(x) // 32 for x in names]
        row = pa.array(np.repeat(np.arange(len(n)), n))
        place = np.concatenate([np.arange(k) for k in n]) if n else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array([x[i : i + 32] for x in names for i in range(0, len(x), 32)], pa.binary()), doc.take(row), leaf.take(row), pa.array(place.astype(np.int32))], names=["name", "doc_id", "leaf", "place"])


def _strip(width: int):
    """Rows of a shard in order: leave out chunks owned elsewhere; add the shard and the start in it.

    The references of a document come just before its row. Places are int32, negative for a chunk
    that is owned here and used elsewhere.
    """
    from pyspark import TaskContext

    def run(batches):
        shard, start, refs, last = TaskContext.get().partitionId(), 0, {}, None
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for r in b.to_pylist():
                key = (r["doc_id"], r["leaf"])
                if r["kind"] == 0:
                    refs[key] = np.frombuffer(r["refs"], "<i4")
                    if len(refs) > 1:
                        refs = {key: refs[key]}
                    continue
                mine = refs.get(key, np.empty(0, np.int32))
                lent, out = -1 - mine[mine < 0], mine[mine >= 0]
                if key == last:  # the same row again: all it lends is there already
                    out, lent = np.unique(np.concatenate([out, lent])), lent[:0]
                data = unpack(r["data"])
                if len(out):
                    edge, gone = _edges(_sizes(r["sizes"]), width), set(out.tolist())
                    data = b"".join([data[edge[i] : edge[i + 1]] for i in range(len(edge) - 1) if i not in gone])
                rows.append((r["doc_id"], shard, start, r["n_tokens"], r["leaf"], r["names"], r["sizes"], data, np.sort(out).astype("<i4").tobytes(), np.sort(lent).astype("<i4").tobytes()))
                start += r["n_tokens"]
                last = key
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=["doc_id", "shard", "shard_start", "n_tokens", "leaf", "names", "sizes", "data", "missing", "lent"])

    return run, "doc_id long, shard int, shard_start long, n_tokens long, leaf binary, names binary, sizes binary, data binary, missing binary, lent binary"


def merkle(leaves: list[bytes]) -> bytes:
    """Root over ordered digests; an odd one at a level's end moves up as it is."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _shard_roots(batches):
    stack: dict[int, list[bytes]] = {}
    first: dict[int, tuple[int, int]] = {}
    for b in batches:
        for s, leaf, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            stack.setdefault(s, []).append(leaf)
            docs, tokens = first.get(s, (0, 0))
            first[s] = docs + 1, tokens + n
    for s, leaves in stack.items():
        yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "docs": pa.array([first[s][0]], pa.int64()), "tokens": pa.array([first[s][1]], pa.int64()), "root": pa.array([merkle(leaves)], pa.binary())})


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, vocab: int = 1 << 16, shard_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs``, append ``end_id`` to each, and write the store below ``path``.

    Ids take two bytes each where ``vocab`` allows, else four. Null text counts as empty; null ids come
    first; rows with equal ids are ordered by content, and a row that repeats whole is stored as
    references. Other columns are ignored. Empty table: a store without rows.
    """
    spark = docs.sparkSession
    width = 2 if vocab <= 1 << 16 else 4
    end = 0 if end_id is None else end_id
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    scratch = Scratch(spark, "tokens")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = scratch.cut(src.mapInArrow(_encode(spec, end, width), _ROW), "coded")
    chunks = coded.select("doc_id", "leaf", "names").mapInArrow(_names, "name binary, doc_id long, leaf binary, place int")
    at = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "leaf", "place")
    twice = chunks.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("owner")).where("n > 1").select("name", "owner")
    refs = chunks.join(twice, "name").withColumn("p", F.when(at == F.col("owner"), -1 - F.col("place")).otherwise(F.col("place")))
    refs = refs.groupBy("doc_id", "leaf").agg(F.collect_set("p").alias("p")).select("doc_id", "leaf", F.lit(0).alias("kind"), "p")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("n_tokens", "long"), ("names", "binary"), ("sizes", "binary"), ("data", "binary"))]
    both = coded.drop("refs").withColumn("p", F.lit(None).cast("array<int>")).unionByName(refs.select("doc_id", "leaf", "kind", *empty, "p"))
    shards = max(1, -(-coded.count() // shard_rows))
    ordered = both.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "leaf", "kind")
    run, schema = _strip(width)
    ordered.mapInArrow(_pack_refs(run), schema).write.option("compression", "zstd").parquet(f"{path}/documents")
    scratch.drop(coded)
    stored = spark.read.parquet(f"{path}/documents")
    roots = stored.select("shard", "leaf", "n_tokens", "shard_start").repartition("shard").sortWithinPartitions("shard", "shard_start", "leaf").select("shard", "leaf", "n_tokens").mapInArrow(_shard_roots, "shard int, docs long, tokens long, root binary")
    # a shard is some 20,000 documents; one row for each comes to the driver
    rows = sorted(roots.collect(), key=lambda r: r["shard"])
    before, out = 0, []
    for r in rows:
        out.append((r["shard"], before, r["docs"], r["tokens"], bytearray(r["root"])))
        before += r["tokens"]
    out.append((-1, 0, sum(r["docs"] for r in rows), before, bytearray(merkle([bytes(r["root"]) for r in rows]))))
    spark.createDataFrame(out, "shard int, start long, docs long, tokens long, root binary").coalesce(1).withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")


def _pack_refs(run):
    """Turns the array of places into the bytes that the rest works with."""

    def outer(batches):
        def inner():
            for b in batches:
                p = [None if x is None else np.array(x, "<i4").tobytes() for x in b.column("p").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != "p"), pa.array(p, pa.binary())], names=[*(n for n in b.schema.names if n != "p"), "refs"])

        yield from run(inner())

    return outer


def _lend(width: int):
    """Chunks that other documents need: (name, bytes)."""

    def run(batches):
        for b in batches:
            names, datas = [], []
            for all_names, sizes, data, missing, lent in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                gone, size = set(np.frombuffer(missing, "<i4").tolist()), np.frombuffer(sizes, "<u2").astype(np.int64) * width
                here = [i for i in range(len(size)) if i not in gone]
                edge = np.r_[0, np.cumsum(size[here])]
                at = {p: k for k, p in enumerate(here)}
                for p in np.frombuffer(lent, "<i4").tolist():
                    names.append(all_names[32 * p : 32 * p + 32])
                    datas.append(data[edge[at[p]] : edge[at[p] + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(datas, pa.binary())], names=["name", "chunk"])

    return run


def _borrow(batches):
    for b in batches:
        names, row, place = [], [], []
        for r, (all_names, missing) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            for p in np.frombuffer(missing, "<i4").tolist():
                names.append(all_names[32 * p : 32 * p + 32])
                row.append(r)
                place.append(p)
        row = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), b.column(0).take(row), b.column(1).take(row), pa.array(place, pa.int32())], names=["name", "shard", "shard_start", "place"])


def _assemble(width: int):
    """Documents and the chunks they borrow (before them, by place) to ids, all digests checked."""

    def run(batches):
        key, got, sha = None, {}, hashlib.sha256
        for b in batches:
            rows = []
            for r in b.to_pylist():
                k = (r["shard"], r["shard_start"])
                if r["place"] is not None:
                    if k != key:
                        key, got = k, {}
                    got[r["place"]] = r["data"]
                    continue
                use = got if k == key else {}
                gone, at, parts, data, names = set(np.frombuffer(r["missing"], "<i4").tolist()), 0, [], r["data"], r["names"]
                for i, n in enumerate(_sizes(r["sizes"])):
                    if i in gone:
                        parts.append(use[i])
                    else:
                        parts.append(data[at : at + n * width])
                        at += n * width
                    if sha(parts[-1]).digest() != names[32 * i : 32 * i + 32]:
                        raise ValueError(f"chunk {i} of document {r['doc_id']} does not have its digest")
                if sha(names).digest() != r["leaf"]:
                    raise ValueError(f"the recipe of document {r['doc_id']} does not have its digest")
                ids = np.frombuffer(b"".join(parts), f"<u{width}").astype("<u4")
                rows.append((r["doc_id"], r["shard"], r["shard_start"], len(ids), ids.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    return run


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document of a store.

    ``start`` is the number of ids of all documents before. Raises where a digest does not match: the Merkle tree
    is recomputed up to the manifest first (one pass over leaves), chunks and recipes as they are read.
    """
    if not verify(spark, path):
        raise ValueError(f"the recipes below {path} do not have the manifest's roots")
    stored = spark.read.parquet(f"{path}/documents")
    manifest = spark.read.parquet(f"{path}/manifest")
    width = manifest.first()["width"]
    lack = F.length("missing") > 0
    lent = stored.where(F.length("lent") > 0).select("names", "sizes", "data", "missing", "lent").mapInArrow(_lend(width), "name binary, chunk binary").dropDuplicates(["name"])
    want = stored.where(lack).select("shard", "shard_start", "names", "missing").mapInArrow(_borrow, "name binary, shard int, shard_start long, place int")
    cols = ["doc_id", "shard", "shard_start", "leaf", "names", "sizes", "missing"]
    chunks = want.join(lent, "name").select("shard", "shard_start", "place", F.col("chunk").alias("data"))
    for c in cols:
        if not c.startswith("shard"):
            chunks = chunks.withColumn(c, F.lit(None).cast(stored.schema[c].dataType))
    whole = stored.withColumn("place", F.lit(None).cast("int")).select(*cols, "place", "data")
    partial = whole.where(lack).unionByName(chunks).repartition("shard", "shard_start").sortWithinPartitions("shard", "shard_start", F.col("place").asc_nulls_last())
    schema = "doc_id long, shard int, shard_start long, n_tokens long, ids binary"
    ids = whole.where(~lack).mapInArrow(_assemble(width), schema).union(partial.mapInArrow(_assemble(width), schema))
    starts = manifest.where("shard >= 0").select("shard", F.col("start").alias("shard_at"))
    return ids.join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_at") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def verify(spark, path: str) -> bool:
    """Recompute shard roots and the manifest root from the stored recipes."""
    stored = spark.read.parquet(f"{path}/documents")
    kept = {r["shard"]: bytes(r["root"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
    top = kept.pop(-1)
    roots = stored.select("shard", "leaf", "n_tokens", "shard_start").repartition("shard").sortWithinPartitions("shard", "shard_start", "leaf").select("shard", "leaf", "n_tokens").mapInArrow(_shard_roots, "shard int, docs long, tokens long, root binary")
    found = {r["shard"]: bytes(r["root"]) for r in roots.collect()}
    return found == kept and merkle([found[s] for s in sorted(found)]) == top


def _crc(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([zlib.crc32(x) for x in b.column(3).to_pylist()], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def with_crc(df: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read`` returns."""
    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
