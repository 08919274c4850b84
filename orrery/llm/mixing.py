"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a tree (by default domain, language, source). At each node it is split among
the children by weight; a child that cannot use its share (its tokens times ``max_epochs``) is filled,
and what it leaves goes to its siblings by weight. As a node never gets more than its whole subtree can
use, a shortage reaches an ancestor's other children only when all siblings are full. A leaf takes whole
epochs of its documents, then a prefix, in tokens, of the next epoch's order, which a seeded hash gives.

Plan at scale: texts are read once for their token counts and once for the result. The order of a leaf is
never sorted as a whole: tokens are summed by leading digits of the hash, the digits that hold the end
of the prefix are found on those sums, and only their documents are put in order. What the last pass
joins is one row per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.scratch import Scratch, fresh

_NONE = "(none)"
#: Documents that one stretch of a leaf's order holds, about.
_STRETCH = 2000


def default_tree() -> list[tuple[str, Column]]:
    """Domain (a fixed assignment of sources), language, source."""
    digit = F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 1)
    domain = F.when(digit < "4", "web").when(digit < "8", "news").when(digit < "c", "forum").otherwise("books")
    return [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))]


def token_count(text: Column) -> Column:
    """Words of a text, split at ASCII space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(F.col(name) == k, int(v)).otherwise(out)
    return out.cast("decimal(38,0)")


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _split(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """``budget`` (of the parent) and ``cap`` to ``target`` of each child."""
    over = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    n = nodes.withColumn("w", _weight(name, weights)).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")))
    line = over.orderBy(F.col("ratio").asc_nulls_last(), name)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({"filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest_w": F.sum("w").over(over) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    n = n.withColumn("full", (F.col("w") > 0) & (_big(F.col("cap")) * _big(F.col("rest_w")) <= _big(F.col("budget") - F.col("filled")) * F.col("w")))
    n = n.withColumns({"left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(over), F.lit(0)), "open_w": F.sum(F.when(~F.col("full"), F.col("w"))).over(over)})
    n = n.withColumn("share", F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, F.expr("cast(left as decimal(38,0)) * w div open_w")).otherwise(0).cast("long"))
    n = n.withColumn("odd", F.col("left") - F.sum(F.when(~F.col("full"), F.col("share")).otherwise(0)).over(over))
    n = n.withColumn("turn", F.sum(F.when(~F.col("full") & (F.col("w") > 0), 1).otherwise(0)).over(over.orderBy(name)))
    extra = F.when(~F.col("full") & (F.col("w") > 0) & (F.col("turn") <= F.col("odd")), 1).otherwise(0)
    return n.select(*parent, name, (F.col("share") + extra).cast("long").alias("target"))


def budgets(leaves: DataFrame, names: list[str], weights: list[dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """Targets of leaves (names..., tokens): the leaves with ``target`` appended."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = None
    for k, name in enumerate(names):
        nodes = leaves.groupBy(*names[: k + 1]).agg(F.sum("cap").alias("cap"))
        if above is None:
            every = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("all"))
            nodes = nodes.join(F.broadcast(every), F.lit(True)).withColumn("budget", F.least(F.lit(int(budget)), F.col("all"))).drop("all")
        else:
            nodes = nodes.join(above.withColumnRenamed("target", "budget"), names[:k])
        above = _split(nodes, names[:k], name, weights[k])
    return leaves.drop("cap").join(above, names)


def mix(docs: DataFrame, weights: list[dict[str, int]], budget: int | None = None, budget_share: tuple[int, int] = (1, 2), max_epochs: int = 4, seed: int = 17, tree: list[tuple[str, Column]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return the selected rows of ``docs`` with the tree's columns, ``n_tokens`` and ``copies`` appended.

    ``weights`` has a dict per level (name to integer weight, 1 where absent). The budget is ``budget``
    tokens or the share (num, den) of all tokens. ``copies`` (1 to ``max_epochs``) says how often a row
    enters the mix. The prefix takes documents while the tokens before them are below what the leaf
    still lacks, so a leaf ends less than one document above its target.

    Null text: 0 tokens. Null level values: the name "(none)". Rows with equal ids (or null ids) in a leaf
    have one place in the order and are taken together. Appended names are prefixed with ``mix_`` for
    the tree's columns, so that they do not meet those of ``docs``; other clashing columns are
    replaced. Empty table or no tokens: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    tree = tree or default_tree()
    names = [f"mix_{n}" for n, _ in tree]
    docs = docs.drop("n_tokens", "copies", *names)
    level = {f"mix_{n}": F.coalesce(c.cast("string"), F.lit(_NONE)) for n, c in tree}
    slim = scratch.cut(docs.select(*[c.alias(n) for n, c in level.items()], F.col(id_col).cast("string").alias("id"), token_count(F.col(text_col)).alias("n")), "tokens")
    leaves = slim.groupBy(*names).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    if budget is None:
        total = slim.agg(F.sum("n")).first()[0] or 0
        budget = total * budget_share[0] // budget_share[1]
    plan = budgets(leaves, names, weights, budget, max_epochs).where("target > 0 and tokens > 0")
    plan = plan.withColumns({"epochs": F.expr("target div tokens"), "lack": F.expr("target % tokens"), "digits": F.greatest(F.lit(0), F.ceil(F.log(F.col("rows") / _STRETCH) / F.log(F.lit(16.0)))).cast("int")})
    plan = scratch.cut(plan, "plan")

    def order(epochs: Column, ident: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.coalesce(ident, F.lit(""))).cast("binary"))

    part = slim.join(plan.where("lack > 0").select(*names, "epochs", "lack", "digits"), names)
    part = part.withColumn("h", order(F.col("epochs"), F.col("id"))).withColumn("stretch", F.expr("substring(h, 1, digits)"))
    sums = part.groupBy(*names, "stretch").agg(F.sum("n").alias("t"), F.first("lack").alias("lack"))
    line = Window.partitionBy(*names).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("done", F.coalesce(F.sum("t").over(line), F.lit(0))).where("done < lack and done + t >= lack").select(*names, "stretch", "done")
    # documents of the stretch in which the prefix ends; those before the end by hash
    last = part.groupBy(*names, "stretch", "h").agg(F.sum("n").alias("t"), F.first("lack").alias("lack")).join(ends, [*names, "stretch"])
    inner = Window.partitionBy(*names, "stretch").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cut = last.withColumn("done", F.col("done") + F.coalesce(F.sum("t").over(inner), F.lit(0))).where("done < lack").groupBy(*names).agg(F.max("h").alias("cut"))
    keys = fresh(docs, *[f"_{n}" for n in names], "_epochs", "_cut")
    final = plan.join(cut, names, "left").select(*names, "epochs", "cut").withColumnsRenamed(dict(zip([*names, "epochs", "cut"], keys, strict=True)))
    final = scratch.cut(final, "final")
    out = docs.withColumns(level).join(final, [F.col(n) == F.col(k) for n, k in zip(names, keys, strict=False)])
    epochs, end = F.col(keys[-2]), F.col(keys[-1])
    copies = epochs + F.when(order(epochs, F.col(id_col).cast("string")) <= end, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn("n_tokens", token_count(F.col(text_col))).select(*docs.columns, *names, "n_tokens", "copies")
