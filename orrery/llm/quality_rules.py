"""Quality rules whose thresholds follow the data.

Every text is measured once: words, word characters, symbols, repeated lines and words in repeated windows. Each measure
is turned into a rate in whole numbers and counted in a quantile sketch of its language and source: a histogram that
is exact below 128 and has 64 bins for each doubling above, so quantiles are at most 1/64 too low. Counts of bins add
up, whatever the order, so sketches of sources are merged into those of languages and of the whole table by sums. From
the quartiles of its sketch each group gets fences (as in a box plot); documents outside any of them go.

Plan at scale: one pass over the texts, by built-in functions alone. What is measured (some 60 bytes a document) is
written; the sketches are a partial aggregation of it with a row per group and filled bin, and the fences, a row per
group, are joined to it. Which side of that join is sent is left to Spark, which knows the sizes; a source with a third of
all rows is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.scratch import Scratch, fresh

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Rates in whole numbers: what is divided, the factor, by what; and the least spread that fences are built on.
RATES = {
    "mean_length": ("word_chars", 1000, "n_words", 600),
    "symbols": ("n_symbols", 10_000, "word_chars", 100),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 150),
    "repeats": ("n_repeat_words", 1000, "n_words", 90),
}
#: Rates that can also be too low.
TWO_SIDED = ("mean_length",)
#: Fences lie so many spreads beyond the quartiles.
REACH = 3
#: Groups with fewer documents use the sketch of their language, such languages that of the table.
LEAST = 100
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the columns of ``MEASURES`` (long). A null text counts as an empty one.

    ``n_lines`` counts lines with a word, ``n_dup_lines`` those that equal an earlier one. ``n_repeat_words`` counts the
    words in windows of ``WINDOW`` words that stand in the text twice or more; windows are told apart by 64-bit hashes.
    Columns of these names are replaced. Texts of any length are handled whole, in time n log n.
    """
    docs = docs.drop(*MEASURES)
    words, hashes, order, hits, size = fresh(docs, "_words", "_hashes", "_order", "_hits", "_lines")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.size(words)
    # of a text without repeated windows, which is the rule, nothing below the hashes is evaluated
    odd = F.size(F.array_distinct(hashes)) < F.size(hashes)
    same = lambda k, j: F.get(F.col(order), k)["h"] == F.get(F.col(order), j)["h"]
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    plain = body
    for c in " \t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    out = docs.withColumn(words, F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).withColumn(size, lines)
    # hashes of 2, 4 and 8 words from those of half as many
    out = out.withColumn(hashes, _doubled(words, 1))
    for half in (2, 4):
        out = out.withColumn(hashes, _doubled(hashes, half))
    out = out.withColumn(hashes, F.slice(hashes, 1, F.greatest(F.lit(0), n - WINDOW + 1)))
    out = out.withColumn(order, F.when(odd, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    out = out.withColumn(hits, F.when(F.col(order).isNotNull(), F.array_sort(F.transform(at, lambda k: F.get(F.col(order), k)["i"]))))
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns if c != text),
        n.cast("long").alias("n_words"),
        F.length(plain).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(size) - F.size(F.array_distinct(size))).cast("long").alias("n_dup_lines"),
        F.size(size).cast("long").alias("n_lines"),
        F.when(F.col(hits).isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _doubled(each: str, by: int) -> Column:
    """Hashes of twice as many words from ``each``, which has one for each start; those past the end mean nothing."""
    return F.zip_with(each, F.slice(each, by + 1, F.greatest(F.lit(0), F.size(each) - by)), lambda a, b: F.xxhash64(a, b))


def rate(name: str) -> Column:
    """A rate in whole numbers, rounded down; null where its divisor is 0."""
    over, factor, under, _ = RATES[name]
    return F.expr(f"case when `{under}` > 0 then `{over}` * {factor} div `{under}` end")


def bin_of(x: str) -> Column:
    """The bin of a whole number from 0: 64 bins for each doubling from 64 on, one for each number below 128."""
    return F.expr(f"case when {x} < 128 then {x} else (length(bin({x})) - 7) * 64 + shiftright({x}, length(bin({x})) - 7) end")


def bin_start(b: str) -> Column:
    """The least number of a bin."""
    return F.expr(f"case when {b} < 128 then {b} else shiftleft({b} - ({b} div 64 - 1) * 64, cast({b} div 64 - 1 as int)) end")


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """``level, lang, source, rate, bin, n``: how many documents have a rate in a bin.

    Level 0 is a source within a language, 1 a language (source null), 2 the whole table (both null).
    """
    rows = F.array(*(F.struct(F.lit(r).alias("rate"), rate(r).alias("x")) for r in RATES))
    each = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(rows)).where("x is not null")
    counts = each.withColumn("bin", bin_of("x")).groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n"))
    levels = counts.groupingSets([["rate", "bin", "lang", "source"], ["rate", "bin", "lang"], ["rate", "bin"]], "rate", "bin", "lang", "source")
    return levels.agg(F.sum("n").alias("n"), F.bit_count(F.grouping_id()).alias("level"))


def fences(sketch: DataFrame) -> DataFrame:
    """``level, lang, source, docs, fences``: a map from each rate to its least and most allowed value (null: any)."""
    keys = ["level", "lang", "source", "rate"]
    by = Window.partitionBy(*keys)
    run = sketch.select(*keys, "bin", "n", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("docs"))
    part = lambda num: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * num, F.col("bin")))
    q = run.groupBy(*keys).agg(F.first("docs").alias("docs"), part(1).alias("b1"), part(3).alias("b3")).select(*keys, "docs", bin_start("b1").alias("q1"), bin_start("b3").alias("q3"))
    least = F.create_map(*(F.lit(x) for r in RATES for x in (r, RATES[r][3])))
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("rate")])
    low = F.when(F.col("rate").isin(*TWO_SIDED), F.col("q1") - REACH * spread)
    q = q.withColumn("fence", F.struct(low.alias("low"), (F.col("q3") + REACH * spread).alias("high")))
    return q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("rate", "fence"))).alias("fences"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, level, fences``: of every pair of language and source, the fences of the least level with ``LEAST`` documents."""
    f = fences(sketches(measured, lang, source))
    wide = F.explode(F.array(*map(F.lit, range(3)))).alias("level")
    asked = f.where("level = 0").select("lang", "source", wide)
    at_lang, at_source = F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source"))
    f = f.select(F.col("level").alias("_level"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "docs", "fences")
    found = asked.join(f, (F.col("level") == F.col("_level")) & at_lang.eqNullSafe(F.col("_lang")) & at_source.eqNullSafe(F.col("_source")))
    found = found.where((F.col("docs") >= LEAST) | (F.col("level") == 2))
    return found.groupBy("lang", "source").agg(F.min("level").alias("level"), F.min_by("fences", "level").alias("fences"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without ``text``, with ``MEASURES``, ``base_failed``, ``failed`` and ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. ``failed``: names of the rates outside
    their fences, ordered. ``kept``: neither. Columns of these names are replaced, others pass through.

    Null texts count as empty; without words a document has no rates and fails the base alone. Null languages and
    sources are groups of their own. Repeated rows and ids are rows like others, and count each. An empty table gives none.
    """
    docs = docs.drop("base_failed", "failed", "kept")
    own_lang, own_source, fence, key_lang, key_source = fresh(docs, "_lang", "_source", "_fences", "_key_lang", "_key_source")
    src = docs.withColumns({own_lang: F.col(lang), own_source: F.col(source)})
    scratch = Scratch(docs.sparkSession, "rules")
    measured = scratch.cut(measure(src, text), "measured")
    t = thresholds(measured, own_lang, own_source).select(F.col("lang").alias(key_lang), F.col("source").alias(key_source), F.col("fences").alias(fence))
    out = measured.join(t, F.col(own_lang).eqNullSafe(F.col(key_lang)) & F.col(own_source).eqNullSafe(F.col(key_source)), "left")
    outside = lambda r: F.coalesce(rate(r) > F.col(fence)[r]["high"], F.lit(False)) | F.coalesce(rate(r) < F.col(fence)[r]["low"], F.lit(False))
    base = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    failed = F.array_compact(F.array(*(F.when(outside(r), F.lit(r)) for r in sorted(RATES))))
    out = out.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.drop(own_lang, own_source, key_lang, key_source, fence)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their texts and columns as they were. Texts are written once more."""
    (copy,) = fresh(docs, "_text")
    named = docs.withColumn(copy, F.col(text))
    clash = {c: f"further column {i}" for i, c in enumerate(docs.columns) if c.lower() in {*MEASURES, "base_failed", "failed", "kept"}}
    out = judge(named.withColumnsRenamed(clash), copy, clash.get(lang, lang), clash.get(source, source)).where("kept")
    return out.select(*(F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns))
