"""N-gram Jaccard join: near-duplicate texts by exact set similarity of word shingles.

Method: set-relation skipping. Shingles are put in one global order, rare first, and each set is indexed
under its prefix (no two sets reach the threshold without a common prefix token).

Index-level skipping. The place of a token in a set says how large a partner may be that meets the set there
first (its ``reach``); a list is laid out in blocks by size, and an entry visits the block of the next
sizes only if its position lets it reach that far, else the block is skipped whole. Blocks of one component
carry their least size and greatest reach, so that two blocks which cannot hold a pair, or which have the
answer already, are skipped without a look at their entries.

Answer-level skipping. Equal sets share all answers and are joined once. A set is first compared with one
leader, the set that shares most of its lists; where they link, it takes over all that is known of the
leader (its component), and is never compared inside it. Members that the leader refuses are compared with the
other members below it, in tiles: there a set's overlaps are derived from those of the most similar set before
it, corrected through the lists of the tokens in which the two differ. A list whose sets are of one
component, or all below one leader, has all its answers and is dropped. Blocks of different components and
leaders that remain after some rounds of leaders are compared in the same way.

Plan at scale: two passes over the texts make the index. The first counts shingles in a slot table of fixed size
(the order) and digests each set; the second sends packed prefixes to buckets of shingle ranges. Only tokens
of two or more different sets that may meet there leave the buckets. A round sends each set to one leader, so
its shuffle is linear; tiles hold ``block`` sets a side and return a forest of their links, never pairs. No step
forms the closure of anything but links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import slots
from orrery.llm import textkernel as tk
from orrery.llm.components import components
from orrery.llm.scratch import Scratch, fresh, release, trimmed

U = np.uint64
_PREFIX = np.dtype([("token", "<u8"), ("set", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def min_overlap(a, b, num: int, den: int):
    """Smallest common count c with c / (a + b - c) >= num / den."""
    return -((-num * (a + b)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _part_id(g: bytes) -> int:
    """Half of a digest stands for a set in the index; a clash of halves only adds a candidate."""
    return int.from_bytes(g[:8], "little", signed=True)


def _digest(words: int, bits: int):
    """One row per document (id, set size, set digest), and the task's slot counts at the end."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("part_id", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        p = slots.Partial(bits, np.uint8)
        seen: set[bytes] = set()
        for b in batches:
            ids = b.column(0)
            for at, w in tk.runs(b.column(1), lower=True):
                sets = tk.shingle_sets(w, words)
                sig = [_set_id(s) if len(s) else None for s in sets]
                new = [s for s, g in zip(sets, sig, strict=True) if g is not None and g not in seen]
                if len(seen) < 1 << 18:
                    seen.update(g for g in sig if g is not None)
                if new:
                    p.add(np.concatenate(new))
                n = len(sets)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array([None if g is None else _part_id(g) for g in sig], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        for part, data in p.rows():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], schema=schema)

    return run, "doc_id long, n_shingles long, set_id binary, part_id long, part int, counts binary"


def _prefixes(words: int, num: int, den: int, level, buckets: int, hot: int):
    """Packed prefix entries, one row per run of texts and bucket of tokens.

    An entry's token holds its level (how frequent its slot is) in the top byte, so that ascending
    tokens are the global order. A set that repeats in a run is sent once. Tokens of the level ``hot``
    or above are dealt over all buckets, by token and set.
    """

    def run(batches):
        tab = level.value
        for b in batches:
            for _, w in tk.runs(b.column(0), lower=True):
                rows, seen = [], set()
                for s in tk.shingle_sets(w, words):
                    n = len(s)
                    if not n:
                        continue
                    g = _set_id(s)
                    if g in seen:
                        continue
                    seen.add(g)
                    key = (slots.lookup(tab, s).astype(U) << U(56)) | (tk.mix(s) >> U(8))
                    p = prefix_length(n, num, den)
                    key = np.sort(np.partition(key, p - 1)[:p])
                    e = np.empty(p, _PREFIX)
                    e["token"], e["set"], e["size"], e["pos"] = key, _part_id(g), n, np.arange(p)
                    rows.append(e)
                if not rows:
                    continue
                e = np.concatenate(rows)
                kb = (tk.mix(e["token"]) % U(buckets)).astype(np.int64)
                many = (e["token"] >> U(56)).astype(np.int64) >= hot
                kb[many] = (tk.mix(e["token"][many] ^ tk.mix(e["set"][many].astype(U))) % U(buckets)).astype(np.int64)
                o = np.argsort(kb, kind="stable")
                kb, e = kb[o], e[o]
                at = np.flatnonzero(np.r_[True, kb[1:] != kb[:-1]])
                to = np.r_[at[1:], len(kb)]
                yield pa.RecordBatch.from_arrays([pa.array(kb[at].astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(at.tolist(), to.tolist(), strict=True)], pa.binary())], names=["bucket", "entries"])

    return run


def reach(size, pos, num: int, den: int):
    """Largest partner of a set of ``size`` that may share the token at ``pos`` first and still link."""
    return (den * size - (num + den) * pos) // num


def _others(v: np.ndarray, head: np.ndarray, pick) -> np.ndarray:
    """For each value the extreme (``pick``) of the other values of its stretch; stretches begin at ``head``."""
    at = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    none = np.iinfo(np.int64).max if pick is np.minimum else -1
    best = pick.reduceat(v, at)
    mine = v == best[group]
    twice = np.add.reduceat(mine.astype(np.int64), at) > 1
    second = pick.reduceat(np.where(mine, none, v), at)
    return np.where(mine & ~twice[group], second[group], best[group])


def _repeated(hot: int, num: int, den: int):
    """Of a bucket: entries whose token stands in two different sets or more, or may do so elsewhere."""

    def run(t: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(t.column("entries").to_pylist()), _PREFIX)
        e = e[np.lexsort((e["set"], e["token"]))]
        same = np.zeros(len(e), bool)
        same[1:] = (e["token"][1:] == e["token"][:-1]) & (e["set"][1:] == e["set"][:-1])
        e = e[~same]
        keep = np.zeros(len(e), bool)
        eq = e["token"][1:] == e["token"][:-1]
        keep[1:] |= eq
        keep[:-1] |= eq
        keep |= (e["token"] >> U(56)).astype(np.int64) >= hot
        far = reach(e["size"].astype(np.int64), e["pos"].astype(np.int64), num, den)
        keep &= far * den >= e["size"].astype(np.int64) * num  # beyond that position it meets nobody
        e, far = e[keep], far[keep]
        # an entry stays if some other set of its list is small enough for it, and some other reaches as far as it
        if len(e):
            head = np.r_[True, e["token"][1:] != e["token"][:-1]]
            size = e["size"].astype(np.int64)
            ok = (_others(size, head, np.minimum) <= far) & (_others(far, head, np.maximum) >= size)
            ok |= (e["token"] >> U(56)).astype(np.int64) >= hot
            e, far = e[ok], far[ok]
        return pa.table({"token": e["token"].astype(np.int64), "part_id": e["set"].astype(np.int64), "size": e["size"].astype(np.int32), "reach": far.astype(np.int32)})

    return run, "token long, part_id long, size int, reach int"


def _sets_of(words: int, wanted):
    def run(batches):
        tab = wanted.value
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            hit = np.flatnonzero((slots.test_bits(tab, tk.mix(ids))) & ~np.asarray(b.column(0).is_null()))
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            for at, w in tk.runs(b.column(1), lower=True):
                sets = tk.shingle_sets(w, words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "set_id", "shingles"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int((b[i] == a).sum())


def _keyed(batches, keys: int):
    """Rows of sorted batches as (key, the other columns), one by one."""
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for r in zip(*cols, strict=True):
            yield r[:keys], r[keys:]


_EDGE = "src long, dst long, linked boolean"


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["src", "dst", "linked"])


def _against_leader(num: int, den: int):
    """Rows (leader, part, member?, rep, shingles), sorted, a leader's own rows first: does a member link with it?"""

    def run(batches):
        at, own, out = None, [], []
        for (leader, part, member), (rep, data) in _keyed(batches, 3):
            x = np.frombuffer(data, U)
            if (leader, part) != at:
                at, own = (leader, part), []
            if not member:
                own.append(x)
                continue
            ok = False
            for y in own:
                c = _common(x, y)
                ok |= den * c >= num * (len(x) + len(y) - c)
            out.append((rep, leader, ok))
            if len(out) >= 4096:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def links(xs: list[np.ndarray], ys: list[np.ndarray], num: int, den: int, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked xs[i] and ys[j] that span the components which such links form.

    Sets are sorted, distinct and not empty; ``same[i]`` is the place in ``ys`` that xs[i] has itself (-1: none).
    A set's overlaps with all of ``ys`` are derived from those of the most similar set before it: the lists of
    the tokens in which the two differ correct them. Only the first set, and one that is like no other, reads
    the lists of all its tokens.
    """
    n = len(ys)
    if not xs or not n:
        return []
    size = np.array([len(y) for y in ys])
    token = np.concatenate(ys)
    owner = np.repeat(np.arange(n), size)
    o = np.argsort(token, kind="stable")
    token, owner = token[o], owner[o]

    def overlaps(t):
        lo, hi = np.searchsorted(token, t), np.searchsorted(token, t, side="right")
        k = hi - lo
        at = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
        return np.bincount(owner[at], minlength=n)

    up = np.arange(len(xs) + n)

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    if same is not None:
        for i in np.flatnonzero(same >= 0).tolist():
            up[find(i)] = find(len(xs) + int(same[i]))
    out: list[tuple[int, int]] = []
    kept: list[tuple[np.ndarray, np.ndarray]] = []  # a few sets before, with their overlaps
    for i, x in enumerate(xs):
        plus, minus, base = x, x[:0], None
        for s, c in kept:
            more, less = np.setdiff1d(x, s, assume_unique=True), np.setdiff1d(s, x, assume_unique=True)
            if len(more) + len(less) < len(plus) + len(minus):
                plus, minus, base = more, less, c
        c = overlaps(plus) if base is None else base + overlaps(plus) - overlaps(minus)
        kept = [*kept[-3:], (x, c)]
        for j in np.flatnonzero(den * c >= num * (len(x) + size - c)).tolist():
            u, v = find(i), find(len(xs) + j)
            if u != v:
                up[u] = v
                out.append((i, j))
    return out


def _settle(num: int, den: int):
    """Rows (a, b, i, j, side, rep, shingles), sorted: links between the two sides of each tile, without cycles."""

    def run(batches):
        at, reps, sets, out = None, ([], []), ([], []), []

        def tile():
            place = {r: k for k, r in enumerate(reps[1])}
            same = np.array([place.get(r, -1) for r in reps[0]], np.int64)
            out.extend((reps[0][i], reps[1][j], True) for i, j in links(*sets, num, den, same))

        for key, (side, rep, data) in _keyed(batches, 4):
            if key != at:
                if at is not None:
                    tile()
                at, reps, sets = key, ([], []), ([], [])
                if len(out) >= 4096:
                    yield _edges(out)
                    out = []
            reps[side].append(rep)
            sets[side].append(np.frombuffer(data, U))
        if at is not None:
            tile()
        if out:
            yield _edges(out)

    return run


def _met(entries: DataFrame, hot: int, scratch: Scratch) -> DataFrame:
    """``entries`` without the hot tokens that stand in one set alone: these were dealt over buckets, none of which saw
    the whole list. Spark counts each list in parts before it moves.
    """
    many = F.shiftrightunsigned("token", 56) >= hot
    long = entries.where(many)
    lists = long.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("reach").alias("far")).where("n > 1")
    long = long.join(lists, "token").where("least <= reach and size <= far").select(entries.columns)
    out = scratch.cut(entries.where(~many).union(long), "lists")
    scratch.drop(entries)
    return out


_SALTS = 32


class _Index:
    """Lists of (token, rep, size, reach), and the sets of their members."""

    def __init__(self, scratch: Scratch, entries: DataFrame, sets: DataFrame, num: int, den: int, hot: int, block: int):
        self.scratch, self.entries, self.sets, self.num, self.den, self.block = scratch, entries, sets, num, den, block
        self.step = math.log(den / num)
        self.labels: list[str] = []
        # a list that may be very long is dealt over several tasks wherever it is joined
        self.long = F.shiftrightunsigned("token", 56) >= hot
        self.salt = F.when(self.long, F.pmod(F.xxhash64("rep"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
        self.salts = F.explode(F.when(self.long, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")

    def named(self, comp: DataFrame | None) -> DataFrame:
        """Entries with the component of each set."""
        if comp is None:
            return self.entries.withColumn("comp", F.col("rep"))
        e = self.entries.join(comp, self.entries["rep"] == comp["node"], "left")
        return e.select(*self.entries.columns, F.coalesce("component", "rep").alias("comp"))

    def advance(self, comp: DataFrame | None, led: DataFrame, label: str) -> None:
        """Mark entries with the leader of the round (0: none), and drop lists whose sets have all their answers:
        those of one component, and those whose sets were compared with each other below one leader.
        """
        old = self.entries
        e = self.named(comp).join(led.select("rep", F.col("leader").alias(label)), "rep", "left")
        # a set without a leader heads, if any, its own group
        e = e.withColumn(label, F.coalesce(label, "rep"))
        live = e.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min(label).alias("c"), F.max(label).alias("d"))
        live = live.where("a <> b and c <> d").select("token")
        self.entries = self.scratch.cut(e.join(live, "token", "left_semi").drop("comp"), "entries")
        self.labels.append(label)
        self.scratch.drop(old)

    def _class(self, size):
        return F.floor(F.log(size + F.lit(0.5)) / self.step).cast("int")

    def leaders(self, comp: DataFrame | None, turn: int) -> DataFrame:
        """(rep, leader): for each set the leader, of another component, with which it shares most lists.

        Each block (token, class of sizes) has one leader. A set looks into the block of its sizes, and into the
        next one if its position reaches there.
        """
        e = self.named(comp).withColumn("cls", self._class(F.col("size")))
        pick = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("leader"), F.col("size").alias("l_size"), F.col("reach").alias("l_reach"), F.col("comp").alias("l_comp"))).alias("l")
        lead = e.groupBy("token", "cls").agg(pick).select("token", "cls", "l.*").select("*", self.salts)
        further = self._class(F.col("reach")) > F.col("cls")
        seek = e.withColumn("cls", F.explode(F.when(further, F.array(F.col("cls"), F.col("cls") + 1)).otherwise(F.array("cls")))).select("*", self.salt)
        can = seek.join(lead, ["token", "cls", "salt"]).where("comp <> l_comp and l_size <= reach and size <= l_reach")
        shared = can.groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("n"))
        best = shared.groupBy("rep").agg(F.max(F.struct("n", -F.col("leader"), "leader")).alias("m"))
        return best.select("rep", F.col("m.leader").alias("leader"))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, linked) of (rep, leader) pairs; a leader of many is compared in parts."""
        parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("parts"))
        member = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"), "rep")
        heads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("leader").alias("rep"))
        rows = member.union(heads).join(self.sets, "rep").select("leader", "part", "member", "rep", "shingles")
        rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "member")
        return rows.mapInArrow(trimmed(_against_leader(self.num, self.den)), _EDGE)

    def below_leaders(self, found: DataFrame) -> DataFrame:
        """Links that members which do not link with their leader have with other members of it."""
        lost = found.where("not linked").select(F.col("dst").alias("a"), F.col("src").alias("rep"), F.lit(0).alias("side"))
        every = found.select(F.col("dst").alias("a"), F.col("src").alias("rep"), F.lit(1).alias("side"))
        return self.settle(lost.union(every).withColumn("b", F.col("a")))

    def open_pairs(self, comp: DataFrame | None) -> DataFrame:
        """(a, b, side, rep): members that may link components a < b, as far as lists and leaders tell."""
        e = self.named(comp)
        by = ["comp", *self.labels]
        block = e.groupBy("token", *by).agg(F.min("size").alias("least"), F.max("reach").alias("reach"))
        block = block.withColumnRenamed("comp", "rep")
        x, y = block.select("*", self.salt).alias("x"), block.select("*", self.salts).alias("y")
        two = x.join(y, ["token", "salt"]).where("x.rep < y.rep and x.least <= y.reach and y.least <= x.reach")
        for label in self.labels:
            two = two.where(f"x.{label} <> y.{label}")
        two = two.selectExpr("token", "x.rep as a", "y.rep as b", *(f"x.{n} as a_{n}" for n in (*self.labels, "least", "reach")), *(f"y.{n} as b_{n}" for n in (*self.labels, "least", "reach")))
        out = None
        for side, me, you in ((0, "a", "b"), (1, "b", "a")):
            part = two.select("token", "a", "b", F.col(me).alias("comp"), *(F.col(f"{me}_{n}").alias(n) for n in self.labels), F.col(f"{you}_least").alias("o_least"), F.col(f"{you}_reach").alias("o_reach"))
            part = part.join(e, ["token", *by]).where("size <= o_reach and o_least <= reach").select("a", "b", F.lit(side).alias("side"), "rep")
            out = part if out is None else out.union(part)
        return out.distinct()

    def settle(self, halves: DataFrame) -> DataFrame:
        """Links between the two sides of (a, b, side, rep), in tiles of ``block`` sets a side."""
        n = lambda side: F.ceil(F.count(F.when(F.col("side") == side, 1)) / self.block).cast("int")
        count = halves.groupBy("a", "b").agg(n(0).alias("na"), n(1).alias("nb")).where("na > 0 and nb > 0")
        keyed = halves.join(count, ["a", "b"])
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nb"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nb")).otherwise(F.col("na")) - 1)).alias("o")
        dealt = keyed.select("a", "b", "side", "rep", own.alias("me"), other)
        i, j = (F.when(F.col("side") == k, F.col("me")).otherwise(F.col("o")) for k in (0, 1))
        rows = dealt.select("a", "b", i.alias("i"), j.alias("j"), "side", "rep").join(self.sets, "rep").select("a", "b", "i", "j", "side", "rep", "shingles")
        rows = rows.repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j")
        return rows.mapInArrow(trimmed(_settle(self.num, self.den)), _EDGE)


def jaccard_components(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = 26, block: int = 512, bucket_entries: int = 400_000, hot_level: int = slots.TOP, rounds: int = 2) -> DataFrame:
    """Return ``doc_id, n_shingles, set_id, component_id`` for every row of ``docs``.

    ``threshold`` (num, den): documents link when den * intersection >= num * union of their sets of
    ``words``-word shingles (A-Z lower-cased, words split at ASCII space; fewer words: one shingle).
    ``component_id`` is the smallest id reachable by links. These decide speed alone: ``sketch_bits`` bounds the
    broadcast order table (2**sketch_bits / 2 bytes), ``block`` the sets of a tile's side, ``rounds`` the
    rounds of leaders (pairs that they leave open are settled after them); a task of the first pass counts a
    repeated set's shingles once, as far as it remembers sets (262,144 digests).

    Null or empty text: size 0, linked with nothing, component its own id. Null id: its size, a null
    component, links nothing. Repeated ids name one node: rows sharing an id share its component, whatever
    their texts. Empty table: no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    num, den = threshold
    scratch = Scratch(spark, "ngram")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _digest(words, sketch_bits)
    first = scratch.cut(src.mapInArrow(trimmed(run), schema), "digest")
    own = scratch.cut(first.where("part is null").select("doc_id", "n_shingles", "set_id", "part_id"), "own")
    total = own.where("doc_id is not null").agg(F.sum("n_shingles")).first()[0] or 0
    level = spark.sparkContext.broadcast(slots.table(first.where("part is not null"), sketch_bits, total))
    scratch.drop(first)

    full = own.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("part_id").alias("part_id"))
    buckets = max(64, math.ceil(total * (den - num) / den / bucket_entries))
    packed = src.select("text").mapInArrow(trimmed(_prefixes(words, num, den, level, buckets, hot_level)), "bucket int, entries binary")
    run, schema = _repeated(hot_level, num, den)
    entries = packed.groupBy("bucket").applyInArrow(run, schema)
    entries = scratch.cut(entries.join(classes.select("part_id", "rep"), "part_id").select("token", "rep", "size", "reach"), "entries")
    level.destroy()
    entries = _met(entries, hot_level, scratch)
    wanted = spark.sparkContext.broadcast(slots.members(entries, "rep", 27))
    sets = src.mapInArrow(trimmed(_sets_of(words, wanted)), "rep long, set_id binary, shingles binary")
    same = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("k > 1")
    same = scratch.cut(same, "repeated")
    if not same.isEmpty():
        sets = sets.dropDuplicates(["rep", "set_id"])
    sets = scratch.cut(sets.select("rep", "shingles"), "sets")
    wanted.destroy()
    del level, wanted
    release()

    # classes that an id is in belong together
    many = full.join(same.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_id").distinct()
    edges = [scratch.cut(many.join(classes, "set_id").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"), F.lit(True).alias("linked")), "same")]
    index = _Index(scratch, entries, sets, num, den, hot_level, block)
    comp = None if edges[0].isEmpty() else components(edges[0], scratch)
    known: list[DataFrame] = []
    for turn in range(rounds):
        led = scratch.cut(index.leaders(comp, turn), "leaders")
        found = scratch.cut(index.compare(led), "round")
        edges += [found, scratch.cut(index.below_leaders(found), "below")]
        comp = components(_union([*known, *edges]).where("linked"), scratch)
        index.advance(comp, led, f"leader_{turn}")
        scratch.drop(led, *edges)
        # what is known so far stands in for its edges
        known, edges = [comp.select(F.col("node").alias("src"), F.col("component").alias("dst"), F.lit(True).alias("linked"))], []
        if index.entries.isEmpty():
            break
    halves = scratch.cut(index.open_pairs(comp), "open")
    edges.append(scratch.cut(index.settle(halves), "settled"))
    linked = components(_union([*known, *edges]).where("linked"), scratch)
    scratch.drop(index.entries, sets, halves, *edges, same)
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    low = own.join(named, "set_id", "left")
    return low.select("doc_id", "n_shingles", "set_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Drop every document that is not the smallest id of its near-duplicate component.

    Documents without words stay (nothing links them). Columns of ``docs`` are returned as they were.
    Null ids stay. Of rows that repeat one id, all stay or none.
    """
    found = jaccard_components(docs, id_col=id_col, **options)
    (name,) = fresh(docs, "_gone")
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
