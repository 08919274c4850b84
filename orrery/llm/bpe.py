"""Byte-level BPE encoding and decoding.

Method: contiguous rank array. A word is held as an array of parts and an array with the rank of each
adjacent pair of parts; the least rank is found by scanning, its boundary is deleted, and the ranks at
either side are refreshed. For a short word that is faster than any queue. Words over ``LONG`` bytes, where
repeated scans would grow with the square, go through a heap with the same order (rank, then place).

Plan at scale: one pass over the texts without a shuffle. The vocabulary (its file's size is the bound) is
broadcast; each Python worker keeps the ids of recent words, up to ``CACHE`` of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern that splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 256
CACHE = 400_000
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else 256 upwards."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(odd)) for b in range(256)]


class Bpe:
    """A byte-level BPE tokenizer read from the JSON text of its public file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        vocab: dict[str, int] = d["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.bytes[i] = b"".join(bytes([back[c]]) if c in back else c.encode() for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self._split = regex.compile(SPLIT)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._cache: dict[str, bytes] = {}

    def word(self, data: bytes) -> list[int]:
        """Merge one word."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > LONG:
            return self._long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == _NONE:
                break
            i = ranks.index(r)
            ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.made[r]
            live[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, live, strict=True) if ok]

    def _piece(self, text: str) -> list[bytes]:
        words = self._split.findall(text)
        cache = self._cache
        for w in set(words).difference(cache):
            if len(cache) >= CACHE:
                cache.clear()
                return self._piece_slow(words)
            cache[w] = np.array(self.word(w.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        return list(map(cache.__getitem__, words))

    def _piece_slow(self, words: list[str]) -> list[bytes]:
        own = {w: np.array(self.word(w.encode("utf-8", "surrogatepass")), "<u4").tobytes() for w in set(words)}
        return list(map(own.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens become those tokens."""
        if self._marks is not None and any(s in text for s in self.special):
            out: list[bytes] = []
            for part in self._marks.split(text):
                out += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self._piece(part)
        else:
            out = self._piece(text)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def _tokenizer(spec) -> Bpe:
    """One tokenizer (and word cache) per vocabulary in a Python worker."""
    text = spec.value
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(text)
    return _loaded[key]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _round_trip(spec, text_at: int, names: list[str]):
    def run(batches):
        t = _tokenizer(spec)
        for b in batches:
            for c in range(0, b.num_rows, 256):
                part = b.slice(c, 256)
                ids = [t.encode(x or "") for x in part.column(text_at).to_pylist()]
                lists = [x.tolist() for x in ids]
                coded = [hashlib.sha256(",".join(map(t.decimal.__getitem__, x)).encode()).hexdigest() for x in lists]
                texts = [t.decode(x) for x in lists]
                plain = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(texts, pa.string()), pa.array(coded), pa.array(plain)], names=names)

    return run


_ADDED = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Append ``n_tokens, ids, decoded, ids_sha256, decoded_sha256`` to every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file on the driver. ``decoded`` is made from ``ids``.
    The digests are lowercase hex SHA-256 of the decimal ids joined by commas and of the decoded text.

    Null text: encoded as an empty one (no ids). Columns with the names of added ones are replaced,
    others pass through. Rows are handled alone: ties and repeats keep their rows. Empty table: no rows.
    """
    docs = docs.drop(*[n for n, _ in _ADDED])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in _ADDED]])
    return docs.mapInArrow(_round_trip(_shared(docs, tokenizer), docs.columns.index(text_col), schema.names), schema)


def _digests(spec):
    run = _round_trip(spec, 1, ["doc_id", "text", *[n for n, _ in _ADDED]])

    def narrow(batches):
        for b in run(batches):
            yield b.select(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As ``encode_decode``, of ``doc_id, text`` alone, without the ids and texts leaving the worker."""
    src = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return src.mapInArrow(_digests(_shared(docs, tokenizer)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
