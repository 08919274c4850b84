"""Toxicity by weak supervision.

Many voters look at a document, none of which is its label: three lexicons written by hand (insults, contempt,
threats); lexicons mined from labelled rows, one for whole words and one for word beginnings of each of five
lengths (sure terms, terms that a text repeats, and likely and unsure terms where they stand dense); two and
four sure words; and patterns (shouting, capitals, an insult addressed to somebody, insults that come again). A
generative label model (expectation-maximisation over the votes) estimates how often each voter fires in
either class and how far pairs of voters fire together beyond that; voters that repeat each other share
their weight. Its posteriors are the targets of a linear (logistic) classifier over the voters' strengths,
which scores every document. Labels choose the mined terms; neither votes nor targets are made of them.

A mined term needs more evidence than the luckiest of all candidates would have by chance (its log-likelihood
ratio beats the logarithm of their number), so a lexicon fits the rows it is mined from no better than others.

Fitting reads a bounded sample of labelled rows (``sample``), which count as many rows as they stand for, so that
class shares are those of all labelled rows at every size; scoring is one pass over all texts without a
shuffle, with a model of a few hundred kilobytes (``terms`` bounds it).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import textkernel as tk
from orrery.llm.scratch import Scratch, release, trimmed

U = np.uint64
#: Lexicons written by hand: fixed values.
INSULTS = ["idiot", "moron", "loser", "stupid", "imbecile", "dumb", "fool", "jerk", "dimwit", "halfwit", "cretin", "dunce"]
CONTEMPT = ["scum", "pathetic", "worthless", "disgusting", "trash", "vermin", "filth", "garbage", "subhuman", "parasite", "degenerate"]
THREATS = ["kill", "hate", "shoot", "stab", "murder", "strangle", "slaughter"]
ADDRESS = ["you", "your", "youre", "u", "ur", "du", "ihr", "tu", "vous", "usted"]
SEEDS = [INSULTS, CONTEMPT, THREATS]
#: Kinds of mined terms: whole words, and beginnings of so many bytes.
KINDS = (0, 4, 5, 6, 7, 8)
#: A density votes where it is beyond that of this share of clean rows.
RARE = 0.99
#: Log rate ratios from which a term is sure, and from which it is likely.
SURE, LIKELY = 5.0, 3.5
#: A repeated term counts from so many occurrences in a text.
AGAIN = 3
PATTERNS = ["shouting", "capitals", "addressed", "insulted again", "length"]
_SALT = {k: U(0x5851F42D4C957F2D * (k + 1) & ((1 << 64) - 1)) for k in KINDS}
_SURE, _REPEATED, _LIKELY, _UNSURE, LEXICONS = (len(SEEDS) + i * len(KINDS) for i in range(5))
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


def features(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term codes of a run, the word of each, and the place of its kind in KINDS."""
    word = np.arange(len(w.start))
    size = w.end - w.start
    codes, words, kinds = [], [], []
    for i, k in enumerate(KINDS):
        on = size > k if k else size > 0
        h = w.hash[on] if not k else w.span_hash(w.start[on], w.start[on] + k)
        codes.append(tk.mix(h ^ _SALT[k]))
        words.append(word[on])
        kinds.append(np.full(len(h), i, np.int8))
    return np.concatenate(codes), np.concatenate(words), np.concatenate(kinds)


def _rows(w: tk.Words) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))


def term_code(word: str, k: int = 0) -> int:
    w = next(tk.runs(pa.array([word]), lower=True, sep=tk.NON_ALNUM))[1]
    h = w.hash[:1] if not k else w.span_hash(w.start[:1], w.start[:1] + k)
    return int(tk.mix(h ^ _SALT[k])[0])


def _occurrences(code: np.ndarray, row: np.ndarray, *more: np.ndarray):
    """Distinct (row, code) pairs, how often each occurs, and the further arrays at its first occurrence."""
    o = np.lexsort((row, code))
    code, row = code[o], row[o]
    at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])][: len(code)])
    return code[at], row[at], np.diff(np.r_[at, len(code)]), *(m[o][at] for m in more)


_WHOLE = {x: term_code(x) for words in [*SEEDS, ADDRESS] for x in words}
_SEED_CODE = np.sort(np.array([_WHOLE[x] for words in SEEDS for x in words], U))
_ADDRESS_CODE = np.sort(np.array([_WHOLE[x] for x in ADDRESS], U))


def _among(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return table[i] == codes


def patterns(w: tk.Words) -> np.ndarray:
    """PATTERNS of each text of a run, 0 to 1."""
    n = len(w.doc) - 1
    words = np.maximum(1, np.diff(w.doc))
    row = _rows(w)
    e = w.edges

    def per_text(mask):
        c = np.r_[0, np.cumsum(mask)]
        return c[e[1:]] - c[e[:-1]]

    whole = tk.mix(w.hash ^ _SALT[0])
    seed, named = _among(whole, _SEED_CODE), _among(whole, _ADDRESS_CODE)
    near = np.zeros(len(seed), bool)
    for d in (1, 2, 3):
        near[d:] |= named[:-d] & (row[d:] == row[:-d])
    hits = np.bincount(row[seed], minlength=n)
    return np.stack([
        np.minimum(1.0, per_text(w.bytes == 33) / words),
        per_text(_CAPITAL[w.raw]) / np.maximum(1, per_text(_LETTER[w.raw])),
        np.minimum(1.0, np.bincount(row[seed & near], minlength=n) / 2),
        np.minimum(1.0, np.maximum(0, hits - 1) / 4),
        np.minimum(1.0, words / 1000.0),
    ], 1)


@dataclass
class Model:
    """Sorted term codes, the voters and worth of each, vote thresholds, and the linear classifier."""

    codes: np.ndarray = field(default_factory=lambda: np.empty(0, U))
    voter: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # counts with each occurrence; -1: none
    worth: np.ndarray = field(default_factory=lambda: np.empty(0))
    again: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # counts once, if a text repeats it; -1: none
    dense: np.ndarray = field(default_factory=lambda: np.full(2 * len(KINDS), np.inf))
    weight: np.ndarray = field(default_factory=lambda: np.r_[np.full(_LIKELY, 3.0), np.zeros(2 * len(KINDS) + 1 + len(PATTERNS))])
    bias: float = -2.0
    prior: float | None = None
    accuracy: np.ndarray | None = None
    overlap: np.ndarray | None = None

    def strengths(self, w: tk.Words) -> np.ndarray:
        """Per document: log(1 + summed worth of hits) of each lexicon, log(1 + words hit for sure), the patterns.

        A word counts in one lexicon of occurrences only, that where it is worth most.
        """
        n = len(w.doc) - 1
        out = np.zeros((n, LEXICONS + 1))
        if len(self.codes) and len(w.hash):
            code, word, _ = features(w)
            i = np.searchsorted(self.codes, code)
            i[i == len(self.codes)] = 0
            hit = self.codes[i] == code
            i, word = i[hit], word[hit]
            row = _rows(w)[word]
            one = np.flatnonzero(self.voter[i] >= 0)
            one = one[np.lexsort((self.voter[i[one]], -self.worth[i[one]], word[one]))]
            one = one[np.r_[True, word[one][1:] != word[one][:-1]][: len(one)]]
            np.add.at(out, (row[one], self.voter[i[one]]), self.worth[i[one]])
            sure = one[self.voter[i[one]] < _REPEATED]
            np.add.at(out, (row[sure], LEXICONS), 1.0)
            i, row, times = _occurrences(i, row)
            rep = (self.again[i] >= 0) & (times >= AGAIN)
            np.add.at(out, (row[rep], self.again[i[rep]]), 1.0)
        return np.c_[np.log1p(out), patterns(w)]

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Binary votes from strengths: sure and repeated lexicons, two and four sure words, dense lexicons, patterns."""
        many = x[:, LEXICONS : LEXICONS + 1] > np.log1p([1.5, 3.5])
        pat = x[:, LEXICONS + 1 :] > np.array([0.2, 0.5, 0.0, 0.0, np.inf])
        return np.c_[x[:, :_LIKELY] > 0, many, _density(x) > self.dense, pat[:, :-1]]

    def score(self, strengths: np.ndarray) -> np.ndarray:
        z = strengths @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _density(x: np.ndarray) -> np.ndarray:
    """Worth of likely and unsure terms to the length of a text (which counts as 1,000 words at most)."""
    return np.expm1(x[:, _LIKELY:LEXICONS]) / (0.02 + x[:, -1:])


_COUNTS = "code long, kind byte, again boolean, n1 long, n0 long"


def _count_terms(batches, most: int = 1 << 19):
    """Rows of each class that have a term, and that have it AGAIN times; partial sums of some ``most`` terms."""
    held = None

    def total(code, tag, n1, n0):
        o = np.lexsort((tag, code))
        code, tag, n1, n0 = code[o], tag[o], n1[o], n0[o]
        at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tag[1:] != tag[:-1])][: len(code)])
        return code[at], tag[at], np.add.reduceat(n1, at) if len(at) else n1, np.add.reduceat(n0, at) if len(at) else n0

    def rows(code, tag, n1, n0):
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(tag >> 1), pa.array(tag & 1 > 0), pa.array(n1.astype(np.int64)), pa.array(n0.astype(np.int64))], names=["code", "kind", "again", "n1", "n0"])

    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False) == 1
        for at, w in tk.runs(b.column(0), lower=True, sep=tk.NON_ALNUM):
            code, word, kind = features(w)
            code, row, times, kind = _occurrences(code, _rows(w)[word], kind)
            rep = times >= AGAIN
            y = toxic[at:][row].astype(np.int32)
            y = np.r_[y, y[rep]]
            new = np.r_[code, code[rep]], np.r_[kind * 2, kind[rep] * 2 + 1].astype(np.int8), y, 1 - y
            if held is not None:
                new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            held = total(*new)
            if len(held[0]) > most:
                yield rows(*held)
                held = None
    if held is not None:
        yield rows(*held)


def _strengths(model):
    """A row per run of texts: its labels and strengths, packed."""

    def run(batches):
        m = model.value
        for b in batches:
            for at, w in tk.runs(b.column(0), lower=True, sep=tk.NON_ALNUM):
                x = m.strengths(w)
                y = b.column(1).slice(at, len(x)).to_numpy(zero_copy_only=False) == 1
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["y", "x"])

    return run


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30, weight: np.ndarray | None = None):
    """EM for binary votes: posterior of class 1, firing rates (2, voters), and pair correlations.

    ``start`` is the first posterior; a row counts ``weight`` times (once). Correlation is what is left of two voters' co-firing inside the
    classes; a voter's evidence is divided by one plus the sum of its positive correlations.
    """
    v = votes.astype(float)
    q = start.astype(float)
    c = np.ones(len(v)) if weight is None else weight
    total = c.sum()
    share = np.ones(v.shape[1])
    rho = np.zeros((v.shape[1], v.shape[1]))
    rate = np.full((2, v.shape[1]), 0.5)
    for _ in range(rounds):
        q1, q0 = c * q, c * (1 - q)
        prior = (q1.sum() + 1) / (total + 2)
        rate = np.stack([((q0 @ v) + 0.05) / (q0.sum() + 1), ((q1 @ v) + 0.05) / (q1.sum() + 1)])
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        res = v - ((1 - q)[:, None] * rate[0] + q[:, None] * rate[1])
        sd = np.sqrt((c @ res**2) / total) + 1e-9
        rho = ((res * c[:, None]).T @ res) / total / np.outer(sd, sd)
        np.fill_diagonal(rho, 0)
        share = 1 / (1 + np.maximum(rho, 0).sum(1))
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        z = np.log(prior / (1 - prior)) + (v * on + (1 - v) * off) @ share
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return q, rate, rho


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 40, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Newton's method for soft targets; a row counts ``weight`` times (once), the bias is not shrunk."""
    a = np.c_[x, np.ones(len(x))]
    c = np.ones(len(x)) if weight is None else weight
    w = np.zeros(a.shape[1])
    pen = np.full(len(w), ridge)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (c * (p - target)) + pen * w
        h = (a * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, g)
        big = np.abs(step).max()
        w -= step * min(1.0, 5 / max(big, 1e-12))
        if big < 1e-7:
            break
    return w[:-1], float(w[-1])


def _mine(train: DataFrame, pos: int, neg: int, terms: int, least_docs: int):
    """Terms that toxic rows have oftener than chance explains, with their log rate ratio (``gain``).

    All terms of the sample are counted in both classes. With n1 toxic and n0 clean rows, the evidence is
    the log-likelihood ratio of their share against the classes' shares; it must beat the logarithm of
    the number of candidates (terms of ``least_docs`` toxic rows or more). Beyond ``terms`` terms of a list
    those with the most evidence stay. Lists: sure (no clean row has it, or ``gain`` is over SURE), repeated,
    likely, unsure; each with code, kind and gain.
    """
    scratch = Scratch(train.sparkSession, "terms")
    counts = train.select("text", "toxic").mapInArrow(trimmed(_count_terms), _COUNTS)
    counts = counts.groupBy("code", "kind", "again").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= least_docs)
    n1, n0 = F.col("n1"), F.col("n0")
    base = pos / (pos + neg)
    share = n1 / (n1 + n0)
    part = F.when(n0 > 0, n0 * F.log((1 - share) / (1 - base))).otherwise(0.0)
    gain = F.log((n1 + 0.5) / (pos + 1)) - F.log((n0 + 0.5) / (neg + 1))
    counts = counts.withColumns({"gain": gain, "evidence": n1 * F.log(share / base) + part})
    counts = scratch.cut(counts.select("code", "kind", "again", "gain", "evidence", (n0 == 0).alias("never")), "terms")
    need = float(np.log(max(1, counts.count())))
    good = counts.where((F.col("gain") > 1.2) & (F.col("evidence") > need))
    once, gain = good.where("not again"), F.col("gain")
    sure = (gain > SURE) | F.col("never")
    lists = [once.where(sure), good.where("gain > 3 and again"), once.where((gain > LIKELY) & ~sure), once.where((gain <= LIKELY) & ~sure)]
    out = [x.orderBy(F.desc("evidence"), "code").limit(terms).toPandas() for x in lists]
    scratch.drop(counts)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 40_000, terms: int = 8_192, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled rows whose crc32(id as text) mod 5 is not 0.

    The sample takes the rows with the smallest hash of the id, up to half of it toxic ones. A sampled row
    counts as many rows as its class has for each one sampled. Mined terms need ``least_docs`` toxic rows
    and more evidence than chance gives the best of all candidates; the four lists of them (sure, repeated,
    likely, unsure) hold at most ``terms`` terms each, those with the most evidence.
    Rows with a null id, label or text are not used. Without labelled rows of both classes, the lexicons
    written by hand decide.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    seed = [(term_code(x), v) for v, words in enumerate(SEEDS) for x in words]
    codes, voter = np.array([c for c, _ in seed], U), np.array([v for _, v in seed])
    worth, again = np.ones(len(seed)), np.full(len(seed), -1)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).dropDuplicates(["_id"])
    quota = {True: sample // 2, False: sample - sample // 2}
    some = [rows.where(c).orderBy(F.xxhash64("_id"), "_id").limit(quota[t]) for c, t in (("toxic = 1", True), ("toxic <> 1", False))]
    picked = F.broadcast(some[0].union(some[1]))  # at most ``sample`` ids
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(picked, "_id").where("text is not null").select("text", "toxic")
    train = scratch.cut(train, "train")
    size = {r["toxic"] == 1: r["count"] for r in train.groupBy(F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).count().collect()}
    pos, neg = size.get(True, 0), size.get(False, 0)
    if pos and neg:
        # rows of its class that a sampled one stands for
        stands = {r["t"]: max(1.0, r["n"] / quota[r["t"]]) for r in rows.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count("*").alias("n")).collect()}
        lists = _mine(train, pos, neg, terms, least_docs)
        mined = [np.concatenate([x["code"].to_numpy(np.int64) for x in lists]).view(U)]
        kind = np.concatenate([x["kind"].to_numpy(np.int64) for x in lists])
        group = np.repeat([_SURE, _REPEATED, _LIKELY, _UNSURE], [len(x) for x in lists])
        alone = np.r_[np.full(len(seed), True), group != _REPEATED]
        codes = np.concatenate([codes, *mined])
        voter = np.concatenate([voter, group + kind])
        worth = np.concatenate([worth, *(x["gain"].to_numpy(float) for x in lists)])
        every = np.unique(codes)
        at = np.searchsorted(every, codes)
        one, two, value = np.full(len(every), -1), np.full(len(every), -1), np.zeros(len(every))
        # a seed word that is mined as well votes as what was mined
        one[at[alone]], value[at[alone]] = voter[alone], worth[alone]
        two[at[~alone]] = voter[~alone]
        codes, voter, worth, again = every, one, value, two
    o = np.argsort(codes)
    model = Model(codes[o], voter[o], worth[o], again[o])
    if pos and neg:
        got = train.mapInArrow(trimmed(_strengths(spark.sparkContext.broadcast(model))), "y binary, x binary").collect()
        y = np.concatenate([np.frombuffer(r["y"], bool) for r in got])
        x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in got]).reshape(len(y), -1).astype(float)
        weight = np.where(y, stands[True], stands[False])
        model.dense = np.maximum(np.quantile(_density(x[~y]), RARE, axis=0), 1e-9)
        votes = model.votes(x)
        # sure and repeated lexicons start the estimate
        q, rate, rho = label_model(votes, np.where(votes[:, :_LIKELY].any(1), 0.9, 0.02), weight=weight)
        model.weight, model.bias = logistic(x, q, weight=weight)
        model.prior, model.accuracy, model.overlap = float((q * weight).sum() / weight.sum()), rate, rho
    scratch.drop(train)
    release()
    return model


def cross_validate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", **options) -> DataFrame:
    """``doc_id, label, fold, score, predicted`` of the labelled rows that ``fit`` may learn from, each scored
    by a model that did not see its fold (crc32(id as text) mod 5, from 1 to 4). Rows of remainder 0 have no part,
    so choices made by these figures leave the held-out rows unseen.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 5
    out = None
    for k in (1, 2, 3, 4):
        rows = labels.where((fold == k) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
        some = docs.join(rows, F.col(id_col) == F.col("_id")).drop("_id")
        part = score(some, fit(docs, labels.where(fold != k), id_col=id_col, label_col=label_col, **options))
        part = part.select(F.col(id_col).alias("doc_id"), "label", F.lit(k).alias("fold"), "score", "predicted")
        out = part if out is None else out.union(part)
    return out


def _score(model, text_at: int, names: list[str]):
    def run(batches):
        m = model.value
        for b in batches:
            s = [m.score(m.strengths(w)) for _, w in tk.runs(b.column(text_at), lower=True, sep=tk.NON_ALNUM)]
            s = np.concatenate(s) if s else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 where score is at least 0.5) to every row.

    Null or empty text gets the score of a text without hits. Columns named score or predicted are
    replaced, all others pass through. Empty table: no rows.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(trimmed(_score(shared, docs.columns.index(text_col), schema.names)), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Keep the documents that the classifier does not call toxic, with their columns as they were."""
    kept = score(docs.select("*"), fit(docs, labels, **options))
    return kept.where("predicted = 0").select(*docs.columns)
