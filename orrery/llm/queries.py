"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_join(spark, sf_dir):
    from orrery.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Words of a text, and the same with A-Z lower-cased, in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE["op1_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOW} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.sh) + len(b.sh) - n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = s.doc_id"""


@query
def op5_substring_dedup(spark, sf_dir):
    from orrery.llm.substring_dedup import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op5_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest([md5(array_to_string(ws[j:j+19], ' ')) FOR j IN range(1, len(ws) - 18)]) AS h FROM w WHERE len(ws) >= 20),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
m AS (SELECT p.doc_id, p.i, word, max(rep.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hit
      FROM p LEFT JOIN rep ON rep.doc_id = p.doc_id AND rep.i = p.i),
k AS (SELECT doc_id, count(*) AS n, count(hit) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (hit IS NULL) AS txt FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""


@query
def op9_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from orrery.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


#: Weights of the mixing query: domains, languages, sources (equal).
MIX_WEIGHTS = [{"web": 4, "news": 3, "forum": 2, "books": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {}]


@query
def op4_mixing(spark, sf_dir):
    from orrery.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, budget_share=(1, 2), max_epochs=4, seed=17)
    return out.selectExpr("doc_id", "mix_domain as domain", "mix_lang as lang", "mix_source as source", "n_tokens", "copies")


def _split_sql(level: str, parent: list[str], name: str, weight: str) -> str:
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keep = ", ".join([*parent, name])
    return f"""
{level}_a AS (SELECT *, CASE WHEN w > 0 THEN cap::DOUBLE / w::DOUBLE END AS ratio FROM (SELECT *, {weight} AS w FROM {level}_n)),
{level}_b AS (SELECT *, coalesce(sum(cap) OVER l, 0)::HUGEINT AS filled, (sum(w) OVER p - coalesce(sum(w) OVER l, 0))::HUGEINT AS rest_w FROM {level}_a
  WINDOW p AS ({by}), l AS ({by} ORDER BY ratio ASC NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{level}_c AS (SELECT *, cap::HUGEINT * rest_w <= (budget - filled) * w AS fl FROM {level}_b),
{level}_d AS (SELECT *, (budget - coalesce(sum(cap) FILTER (fl) OVER ({by}), 0))::HUGEINT AS lft, (sum(w) FILTER (NOT fl) OVER ({by}))::HUGEINT AS open_w FROM {level}_c),
{level}_e AS (SELECT *, CASE WHEN fl THEN cap WHEN w > 0 THEN (lft * w) // open_w ELSE 0 END AS share FROM {level}_d),
{level}_f AS (SELECT *, lft - sum(CASE WHEN fl THEN 0 ELSE share END) OVER ({by}) AS odd, sum(CASE WHEN NOT fl AND w > 0 THEN 1 ELSE 0 END) OVER ({by} ORDER BY {name}) AS turn FROM {level}_e),
{level} AS (SELECT {keep}, (share + CASE WHEN NOT fl AND w > 0 AND turn <= odd THEN 1 ELSE 0 END)::BIGINT AS target FROM {level}_f)"""


def _mix_sql() -> str:
    case = lambda col, w: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END" if w else "1"
    return f"""
WITH base AS (SELECT doc_id, CASE WHEN g < '4' THEN 'web' WHEN g < '8' THEN 'news' WHEN g < 'c' THEN 'forum' ELSE 'books' END AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, n FROM (
  SELECT doc_id, substr(md5(coalesce(source, '')), 1, 1) AS g, lang, source, len({_WORDS})::BIGINT AS n FROM documents)),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * 4)::BIGINT AS cap FROM base GROUP BY ALL),
total AS (SELECT least(coalesce(sum(tokens), 0) // 2, coalesce(sum(cap), 0))::HUGEINT AS budget FROM leaf),
a_n AS (SELECT domain, sum(cap)::HUGEINT AS cap, any_value(budget) AS budget FROM leaf, total GROUP BY 1),
{_split_sql("a", [], "domain", case("domain", MIX_WEIGHTS[0]))},
b_n AS (SELECT l.domain, l.lang, sum(cap)::HUGEINT AS cap, any_value(target)::HUGEINT AS budget FROM leaf l JOIN a ON a.domain = l.domain GROUP BY 1, 2),
{_split_sql("b", ["domain"], "lang", case("lang", MIX_WEIGHTS[1]))},
c_n AS (SELECT l.domain, l.lang, l.source, sum(cap)::HUGEINT AS cap, any_value(target)::HUGEINT AS budget FROM leaf l JOIN b ON b.domain = l.domain AND b.lang = l.lang GROUP BY 1, 2, 3),
{_split_sql("c", ["domain", "lang"], "source", "1")},
plan AS (SELECT l.*, target // tokens AS epochs, target % tokens AS lack FROM leaf l JOIN c USING (domain, lang, source) WHERE target > 0 AND tokens > 0),
h AS (SELECT base.*, epochs, lack, md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM base JOIN plan USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n) OVER (PARTITION BY domain, lang, source, h) AS done FROM h)
SELECT doc_id, domain, lang, source, n AS n_tokens, (epochs + CASE WHEN done < lack THEN 1 ELSE 0 END)::INTEGER AS copies FROM o WHERE epochs + CASE WHEN done < lack THEN 1 ELSE 0 END > 0"""


ORACLE["op4_mixing"] = _mix_sql()


@query
def op2_bpe(spark, sf_dir):
    import public_tokenizers

    from orrery.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_VEC = "embedding IS NOT NULL AND len([z FOR z IN embedding IF z IS NULL OR NOT isfinite(z)]) = 0 AND len([z FOR z IN embedding IF z <> 0]) > 0"


@query
def op7_embedding_dedup(spark, sf_dir):
    from orrery.llm.embedding_dedup import dedup

    return dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


ORACLE["op7_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_VEC}),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""


@query
def op10_nearest(spark, sf_dir):
    from orrery.llm.nearest import search

    base = table(spark, sf_dir, "embeddings")
    return search(base, base.where("vec_id % 20 = 0"), k=20)


ORACLE["op10_nearest"] = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_VEC}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20"""


@query
def op3_token_store(spark, sf_dir):
    import public_tokenizers

    from orrery.llm import token_store
    from orrery.llm.scratch import Scratch

    path = Scratch(spark, "store").path("ids")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocab=49_408)
    return token_store.with_crc(token_store.read(spark, path))


@query
def op6_warc(spark, sf_dir):
    from orrery.llm import warc
    from orrery.llm.scratch import Scratch

    path = Scratch(spark, "warc").path("store")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.resolve(spark, path, warc.read(spark, path))


ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND page_id > f THEN f END AS refers_to FROM q"""


@query
def op8_quality(spark, sf_dir):
    from pyspark.sql import functions as F

    from orrery.llm.quality import classify

    # documents carry no URL: the source is the host, and the language its first path segment
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


@query
def op11_quality_rules(spark, sf_dir):
    from orrery.llm.quality_rules import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql() -> str:
    # num, factor, den, least spread, two-sided: the parameters of the operator's rates
    rates = {"mean_length": ("word_chars", 1000, "n_words", 600, True), "symbols": ("n_symbols", 10000, "word_chars", 100, False),
             "dup_lines": ("n_dup_lines", 1000, "n_lines", 150, False), "repeats": ("n_repeat_words", 1000, "n_words", 90, False)}
    values = "\n  UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rate, {a} * {k} // {b} AS x, {s} AS least, {str(two).lower()} AS two FROM m WHERE {b} > 0" for r, (a, k, b, s, two) in rates.items())
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM w),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest([array_to_string(ws[j:j+7], ' ') FOR j IN range(1, len(ws) - 6)]) AS g FROM w WHERE len(ws) >= 8),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
gap AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM hit),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, sum(n) AS n FROM gap GROUP BY 1) r ON r.doc_id = w.doc_id),
v AS ({values}),
b AS (SELECT *, CASE WHEN x < 128 THEN x ELSE (length(bin(x)) - 7) * 64 + (x >> (length(bin(x)) - 7)) END AS bin FROM v),
g AS (SELECT bit_count(grouping(lang, source)) AS lev, lang, source, rate, bin, any_value(least) AS least, bool_or(two) AS two, count(*) AS n FROM b
  GROUP BY GROUPING SETS ((lang, source, rate, bin), (lang, rate, bin), (rate, bin))),
c AS (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lev, lang, source, rate) AS docs FROM g),
q AS (SELECT lev, lang, source, rate, any_value(docs) AS docs, any_value(least) AS least, bool_or(two) AS two, min(bin) FILTER (upto * 4 >= docs) AS b1, min(bin) FILTER (upto * 4 >= docs * 3) AS b3 FROM c GROUP BY 1, 2, 3, 4),
e AS (SELECT * EXCLUDE (b1, b3), CASE WHEN b1 < 128 THEN b1 ELSE (b1 - (b1 // 64 - 1) * 64) << (b1 // 64 - 1) END AS q1, CASE WHEN b3 < 128 THEN b3 ELSE (b3 - (b3 // 64 - 1) * 64) << (b3 // 64 - 1) END AS q3 FROM q),
f AS (SELECT lev, lang, source, rate, max(docs) OVER (PARTITION BY lev, lang, source) AS docs, CASE WHEN two THEN q1 - 3 * greatest(q3 - q1, least) END AS lo, q3 + 3 * greatest(q3 - q1, least) AS hi FROM e),
o AS (SELECT v.doc_id, coalesce(bool_or(x > k.hi OR x < coalesce(k.lo, x)), false) AS bad FROM v
  JOIN (SELECT DISTINCT lev, lang, source, docs FROM f WHERE lev = 0) a ON a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
  JOIN (SELECT DISTINCT lev, lang, docs FROM f WHERE lev = 1) y ON y.lang IS NOT DISTINCT FROM v.lang
  JOIN f k ON k.rate = v.rate AND k.lev = CASE WHEN a.docs >= 100 THEN 0 WHEN y.docs >= 100 THEN 1 ELSE 2 END
   AND (k.lev = 2 OR k.lang IS NOT DISTINCT FROM v.lang) AND (k.lev > 0 OR k.source IS NOT DISTINCT FROM v.source) GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(bad, false) AS kept FROM m LEFT JOIN o ON o.doc_id = m.doc_id"""


ORACLE["op11_quality_rules"] = _rules_sql()


@query
def op13_filter_audit(spark, sf_dir):
    from orrery.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


ORACLE["op13_filter_audit"] = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
   || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
   || (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS bad FROM w LEFT JOIN y ON y.doc_id = w.doc_id),
p AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT part, filter_order, step, filter_order[step] AS flt, n, good, tox, bad, contains(bad, filter_order[step]) AS fails,
   len([k FOR k IN range(1, step) IF contains(bad, filter_order[k])]) > 0 AS gone FROM p, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INTEGER AS step, any_value(flt) AS flt, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad = flt), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
   coalesce(sum(tox) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM s GROUP BY 1, 2, 3)
SELECT * EXCLUDE (flt), (sum(removed) OVER (PARTITION BY part, flt))::BIGINT AS shapley FROM r"""


@query
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    from orrery.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
