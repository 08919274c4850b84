"""Alignment of the tokens of two tokenizers.

Method: packed bitsets. The token ends of a block of texts are bits at their byte offsets, one bitset for each
tokenizer. Their AND has the cuts that both share; popcount ranks map each cut to the numbers of tokens before it on
either side, so the tokens between two cuts form a group, and every A token of a group links with every B token of it.

Plan at scale. One map over the texts encodes, aligns and sums up a block of texts (``BLOCK_BYTES``, or one longer text) to a
row: what holds for each document, the distinct linked id pairs of the block with the number of its documents that have
them, and each document's pairs as packed places in that list. That row is written. The corpus-wide counts are a sum over
the lists: a pair that every document has comes once a block, and is summed before and after the shuffle. Counts go back
by joining the lists, not the documents' pairs, with them (a hot pair is again a row a block, which the skew join splits),
and the blocks meet their lists again. Nothing is broadcast or collected; no group is larger than a block.

A worker keeps the tokens of up to ``CACHE`` short words: where a space precedes a character that is no white space, neither
tokenizer has a token across it, so a text without other spaces is its words. Other texts are encoded as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.bpe import SPLIT, byte_letters
from orrery.llm.scratch import Scratch, trimmed

BLOCK_BYTES = 3 << 20
CACHE = 200_000
#: Longer words are not kept.
SHORT = 32
#: Links expanded at a time.
CHUNK = 1 << 20
_U = np.uint64
_NEW = object()
#: Bits of a B id in an id pair, and of an id pair below a document's number in a key: vocabularies hold up to 2**20 ids.
_ID, _PAIR = 20, 40
_ODD = re.compile(r" (?=\s|$)")


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the tokens of recent words."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(a_spec)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max([*vocab.values(), *special]))
        for t, i in vocab.items():
            self.a_bytes[i] = t.encode() if i in special else bytes(map(back.__getitem__, t))
        made = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        ordered = all(x < y for x, y in zip(made, made[1:], strict=False)) and len(made) + 256 == len(vocab.keys() - set(special.values()))
        if ordered and _space_splits(spec):  # ids rise with the order of merges: they are ranks, which the faster library takes
            ranks = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
            self.encode_a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            own = Tokenizer.from_str(a_spec)
            own.no_padding()
            own.no_truncation()
            own.encode_special_tokens = True
            self.encode_a = lambda t: own.encode(t, add_special_tokens=False).ids
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: no piece has a space after something else, so none goes across a space
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and _space_splits(spec)
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        #: decimal ids with what follows them: another of the group, the other side, another group
        self.names = [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(self.width)]
        self.recent: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def _encode(self, keys: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of a space and each key, packed; None where the bytes of the tokens are others."""
        out: list = []
        for y, k in zip(self.b.encode(keys, num_threads=1), keys, strict=True):
            raw, x = b" " + k.encode(), self.encode_a(f" {k}")
            same = b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw
            out.append((np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes()) if same else None)
        return out

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts for A and for B, and each text's number of ids of A and of B."""
        split = [[] if not t else t.split(" ") if self.by_word and not _ODD.search(f" {t}") else [t] for t in texts]
        keys = list(dict.fromkeys(chain.from_iterable(split)))
        own = dict(zip(keys, map(self._known, keys), strict=True))
        new = [k for k in keys if own[k] is _NEW]
        fresh = dict(zip(new, self._encode(new), strict=True))
        own |= fresh
        self.recent |= {k: v for k, v in fresh.items() if len(k) <= SHORT}
        if len(self.recent) > CACHE // 2:
            self.older, self.recent = self.recent, {}
        bad = {k for k in keys if own[k] is None}
        if bad:
            split = [ws if bad.isdisjoint(ws) else [] for ws in split]
        out = []
        for side in (0, 1):
            ids = {k: v[side] for k, v in own.items() if v}
            rows = [b"".join(map(ids.__getitem__, ws)) for ws in split]
            out.append((np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.fromiter(map(len, rows), np.int64, len(rows)) // 4))
        (a, na), (b, nb) = out
        return a, b, na, nb

    def _known(self, key: str):
        """What is kept of a word; words that no longer occur go with the older half."""
        found = self.recent.get(key, _NEW)
        if found is _NEW and (found := self.older.get(key, _NEW)) is not _NEW:
            self.recent[key] = found
        return found

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the groups as numbers of tokens of A and of B (popcount rank at each shared cut)."""
        at_a, at_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        bits_a, bits_b = (_bitset(x, at_a[-1] if len(a) else 0) for x in (at_a, at_b))
        cuts = np.flatnonzero(np.unpackbits((bits_a & bits_b).view(np.uint8), bitorder="little"))
        return _rank(bits_a, cuts), _rank(bits_b, cuts)

    def group_codes(self, a, b, end_a, end_b) -> np.ndarray:
        """Places in ``names`` of all tokens in the order of the groups, A's first."""
        g_a, g_b = np.repeat(np.arange(len(end_a)), np.diff(end_a, prepend=0)), np.repeat(np.arange(len(end_b)), np.diff(end_b, prepend=0))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], end_b])[g_a]] = a
        code[np.arange(len(b)) + end_a[g_b]] = b
        code[end_a - 1 + np.concatenate([[0], end_b[:-1]])] += self.width
        code[end_a + end_b - 1] += 2 * self.width
        return code


def _space_splits(spec: dict) -> bool:
    """Whether A cuts before a space and what is no white space: its pre-tokenizer is byte-level with the usual pattern."""
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False) and not spec.get("normalizer")


def _bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Bits at the last byte of every token, 64 to a word."""
    bits = np.zeros((size + 63) // 64 * 64, bool)
    bits[ends - 1] = True
    return np.packbits(bits, bitorder="little").view(_U)


def _rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    rest = bits[at >> 6] & (_U(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(_U))
    return before[at >> 6] + np.bitwise_count(rest)


def _links(a, b, end_a, end_b, doc_a):
    """Keys of document and id pair, ascending, and how many links each has. ``doc_a``: the document of each A token."""
    start_a, start_b = (np.concatenate([[0], x[:-1]]) for x in (end_a, end_b))
    na, nb = end_a - start_a, end_b - start_b
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(keys, times):
        order = np.argsort(keys) if times is not None else None
        keys = np.sort(keys) if order is None else keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        found.append((keys[first], np.diff(np.append(first, len(keys))) if order is None else np.add.reduceat(times[order], first) if len(keys) else times))

    size = na * nb
    for g in np.flatnonzero(size > CHUNK):  # a group without cuts over very many tokens: by distinct ids
        (x, cx), (y, cy) = (np.unique(v, return_counts=True) for v in (a[start_a[g] : end_a[g]], b[start_b[g] : end_b[g]]))
        rows = max(1, CHUNK // len(y))
        for at in range(0, len(x), rows):
            part = slice(at, at + rows)
            add((doc_a[start_a[g]] << _PAIR) + (x[part, None] << _ID | y).ravel(), (cx[part, None] * cy).ravel())
    few = np.flatnonzero(size <= CHUNK)
    done = np.cumsum(size[few])
    for part in np.split(few, np.searchsorted(done, np.arange(CHUNK, done[-1] if len(done) else 0, CHUNK))):
        n = size[part]
        g = np.repeat(part, n)
        k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        i, j = start_a[g] + k // nb[g], start_b[g] + k % nb[g]
        add((doc_a[i] << _PAIR) + (a[i] << _ID | b[j]), None)
    if len(found) > 1:
        add(np.concatenate([x for x, _ in found]), np.concatenate([t for _, t in found]))
    return found[-1]


_loaded: dict[int, Aligner] = {}


def _aligner(shared) -> Aligner:
    """One for each pair of tokenizers in a Python worker."""
    value = shared.value
    if (key := hash(value)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(*value)
    return _loaded[key]


def _shared(df: DataFrame, a_path: str, b_path: str):
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return df.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def _blocks(batches, id_at: int, text_at: int):
    """Ids and texts of about ``BLOCK_BYTES``, over the bounds of batches."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1]) + 64  # so that empty texts do not gather without bound
            if size >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the least type that holds them, whose size is the first byte."""
    x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    return bytes([x.itemsize]) + x.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


_BLOCK = "block long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, n_pairs: long>>, pairs array<long>, n array<int>, places binary, times binary"


def _align(shared):
    def run(batches):
        t = _aligner(shared)
        block = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks(batches, 0, 1):
            a, b, n_a, n_b = t.tokens(texts)
            end_a, end_b = t.groups(a, b)
            stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
            cut = np.searchsorted(end_a, np.concatenate([[0], stop_a]), "right") if len(end_a) else np.zeros(len(ids) + 1, np.int64)
            size = np.diff(end_a, prepend=0) * np.diff(end_b, prepend=0)
            links = np.concatenate([[0], np.cumsum(size)])
            codes = t.group_codes(a, b, end_a, end_b)
            keys, times = _links(a, b, end_a, end_b, np.repeat(np.arange(len(ids)), n_a))
            doc, pair = keys >> _PAIR, keys & ((1 << _PAIR) - 1)
            pairs, place, n = np.unique(pair, return_inverse=True, return_counts=True)
            first = np.searchsorted(doc, np.arange(len(ids) + 1))
            # places ascend within a document: differences are small
            step = np.diff(place, prepend=0)
            starts = first[:-1][first[:-1] < first[1:]]
            step[starts] = place[starts]
            lo = 0
            docs = []
            for k, i in enumerate(ids):
                hi = int(stop_a[k] + stop_b[k])
                sha = hashlib.sha256(b"".join(map(t.names.__getitem__, codes[lo:hi].tolist()))[:-1]).hexdigest() if hi > lo else ""
                docs.append((i, int(n_a[k]), int(n_b[k]), int(cut[k + 1] - cut[k]), int(links[cut[k + 1]] - links[cut[k]]), sha, int(first[k + 1] - first[k])))
                lo = hi
            columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")
            heads = pa.StructArray.from_arrays([pa.array(c, pa.string() if x == "groups_sha256" else pa.int64()) for x, c in zip(columns, zip(*docs, strict=True), strict=True)], names=columns)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), one(heads), one(pa.array(pairs)), one(pa.array(n.astype(np.int32))), pa.array([_packed(step)], pa.binary()), pa.array([_packed(times)], pa.binary())],
                names=["block", "docs", "pairs", "n", "places", "times"],
            )
            block += 1

    return trimmed(run)


_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(batches):
    """Sums over each document's links of the counts that its block was told."""
    for batch in batches:
        for r in range(batch.num_rows):
            docs = batch.column("docs")[r].values
            n = docs.field("n_pairs").to_numpy()
            stop = np.concatenate([[0], np.cumsum(n)])
            step, times = _unpacked(batch.column("places")[r].as_py()), _unpacked(batch.column("times")[r].as_py())
            run = np.concatenate([[0], np.cumsum(step)])
            place = run[1:] - np.repeat(run[stop[:-1]], n)
            told = batch.column("told")[r].values
            pair, count, best = (told.field(k).to_numpy(zero_copy_only=False) for k in range(3)) if told is not None else (np.empty(0, np.int64),) * 3
            order = np.argsort(pair)
            sums = [np.concatenate([[0], np.cumsum(times * v[order][place])]) for v in (best.astype(np.int64), count)]
            extra = [pa.array(s[stop[1:]] - s[stop[:-1]]) for s in sums]
            own = [docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*own, *extra, docs.field("groups_sha256")], names=[x.split()[0] for x in _DIGEST.split(", ")])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many documents an id pair is linked, and whether that is the most of its A id."""
    asked = blocks.select(F.inline(F.arrays_zip("pairs", "n")).alias("pair", "n"))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    a = F.shiftright("pair", _ID)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """A written row for each block of ``docs`` (``doc_id`` and ``text``), as ``align`` and ``pair_counts`` take them."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = _shared(docs, a_path, b_path)
    scratch = Scratch(docs.sparkSession, "align")
    return scratch.cut(src.mapInArrow(_align(shared), _BLOCK), "blocks")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``a_path`` is a byte-level BPE file, which encodes a space and the text; ``b_path`` a sentencepiece model that adds
    that space. Strings of special tokens in texts are plain text. ``n_best`` counts links whose id pair is linked in as
    many documents as any of its A id (ties included), ``count_sum`` adds these numbers up over links.

    Texts that are null, empty, or not given back by the bytes of either's tokens have no tokens: zeros and an empty
    digest. Every row counts as a document: repeated rows and ids add up; a null id stays null. No rows give none.
    A text is never cut; its distinct linked pairs must fit in a worker's memory.
    """
    blocks = aligned_blocks(docs, a_path, b_path, text)
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    told = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("told"))
    return blocks.drop("pairs", "n").join(told, "block", "left").mapInArrow(trimmed(_score), _DIGEST)


def token_groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``a_ids, b_ids``, and ``a_ends, b_ends``: how many ids of each the groups end after. No shuffle.

    Columns of these names are replaced. Nulls, empty texts and those that the tokens do not give back have empty lists.
    """
    names = ("a_ids", "b_ids", "a_ends", "b_ends")
    docs = docs.drop(*names)
    at, columns = docs.columns.index(text), [*docs.columns, *names]
    shared = _shared(docs, a_path, b_path)

    def run(batches):
        t = _aligner(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                a, b, n_a, n_b = t.tokens([x or "" for x in part.column(at).to_pylist()])
                cols: list[list] = [[], [], [], []]
                for i, j, n, m in zip(np.cumsum(n_a), np.cumsum(n_b), n_a, n_b, strict=True):
                    x, y = a[i - n : i], b[j - m : j]
                    for c, v in zip(cols, (x, y, *t.groups(x, y)), strict=True):
                        c.append(v.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.list_(pa.int32())) for c in cols)], names=columns)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)])
    return docs.mapInArrow(run, schema)
