"""Token alignment against a plain reading with the two libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orrery.llm import alignment, queries
from orrery.llm.bpe import byte_letters

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_groups(texts):
    """Per text the groups as pairs of id lists; none without tokens."""
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for t in texts:
        groups = []
        if t:
            a, b = a_tok.encode(f" {t}", add_special_tokens=False).ids, b_tok.encode(t)
            a_raw = [bytes(back[c] for c in a_tok.id_to_token(i)) for i in a]
            b_raw = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_raw) == b"".join(b_raw) == f" {t}".encode():
                ends = [list(np.cumsum(list(map(len, x)))) for x in (a_raw, b_raw)]
                i = j = 0
                for c in sorted({*ends[0]} & {*ends[1]}):
                    x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        out.append(groups)
    return out


def plain(rows):
    groups = plain_groups([t for _, t in rows])
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for n in links for p in n)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, n in zip(rows, groups, links, strict=True):
        text = ";".join("|".join(",".join(map(str, x)) for x in pair) for pair in g)
        best = sum(k for p, k in n.items() if count[p] == most[p[0]])
        sizes = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()))
        out.append((i, *sizes, best, sum(k * count[p] for p, k in n.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *map(str, r)))


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \nb", "a\n b", "it's <|endoftext|> </s> here", "été naïve \U0001f600 ok", "▁under ▁ score", "tab\there", "nb sp  x",
    "x" * 3000, "line\nline\n\nline", "ﬁ ligature", "\x00 nul", "日本語 テキスト", "12345 3.14 !!??", "a\u0085b \x1c c", "word " * 50, "  sep", "don't can't I'll",
]


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (None, "a  b"), (30, "the cat"), (30, "the cat")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, pairs string, block string").repartition(3)
    assert by_key(alignment.align(df, A, B).collect()) == by_key(plain(rows))
    assert alignment.align(df.limit(0), A, B).count() == 0


@pytest.mark.parametrize("chunk", [2, 50])
def test_chunks_do_not_matter(spark, monkeypatch, chunk):
    """Groups beyond the bound of expansion, and links cut into chunks, give the same counts."""
    t = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    texts = ["x" * 400, "naïve été " * 20, "\U0001f600\U0001f601 end"]
    a, b, n_a, _ = t.tokens(texts)
    ends = t.groups(a, b)
    doc = np.repeat(np.arange(3), n_a)
    whole = alignment._links(a, b, *ends, doc)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    for x, y in zip(whole, alignment._links(a, b, *ends, doc), strict=True):
        assert x.tolist() == y.tolist()


def test_blocks(spark):
    """Blocks go over the bounds of batches, and empty texts do not gather without end."""
    batch = pa.record_batch([pa.array(range(50_000)), pa.array([None] * 50_000, pa.string())], names=["doc_id", "text"])
    got = [len(ids) for ids, _ in alignment._blocks(iter([batch, batch]), 0, 1)]
    assert sum(got) == 100_000 and max(got) * 64 <= alignment.BLOCK_BYTES + 64
    assert list(alignment._blocks(iter([]), 0, 1)) == []


def test_token_groups(spark):
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(ODD)], "doc_id long, text string, a_ids string")
    got = {r["doc_id"]: r for r in alignment.token_groups(df, A, B).collect()}
    for k, g in enumerate(plain_groups(ODD)):
        r = got[k]
        assert r["a_ids"] == [i for a, _ in g for i in a] and r["b_ids"] == [i for _, b in g for i in b]
        assert r["a_ends"] == list(np.cumsum([len(a) for a, _ in g])) and r["b_ends"] == list(np.cumsum([len(b) for _, b in g]))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert by_key(queries.QUERIES["op12_token_alignment"](spark, sf).collect()) == by_key(plain(rows))


def test_ranks_and_words_across_blocks():
    """Popcount ranks against sums of bits; words kept from block to block encode as they did."""
    rng = np.random.RandomState(5)
    for n in (1, 63, 64, 65, 1000):
        ends = np.unique(rng.randint(1, n + 1, n // 2 + 1))
        bits = alignment._bitset(ends, n)
        at = np.arange(n)
        assert alignment._rank(bits, at).tolist() == np.searchsorted(ends, at + 1, "right").tolist()
    t = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    first = t.tokens(["some words here", "▁bad"])
    t.recent, t.older = {}, t.recent
    for x, y in zip(first, t.tokens(["some words here", "▁bad"]), strict=True):
        assert x.tolist() == y.tolist()
