"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source).  A token budget goes down the tree: at
every node the children share the node's budget by their weights, none beyond
what its subtree can give (its tokens times ``max_epochs``); what one child
cannot give goes to its siblings first, by their weights, and only what all
siblings together cannot give goes to the parent's siblings, because a parent
never receives more than its subtree holds.  Sharing with limits is computed in
closed form with window functions over the children of a node: children are
sorted by limit / weight, and a child is full when its limit lies below its part
of what the fuller ones before it leave.

A leaf's tokens are chosen as a prefix of a seeded sequence of epochs: every full
epoch holds each document once, and the last, unfinished one takes documents in
the order of a seeded md5 until the budget is reached (the document that reaches
it is included).  The order is cut by the md5's first two digits and, where the
budget ends, by the next two: tokens are summed up over at most 256 buckets per
leaf each time, and only the one bucket (of 65,536) in which the budget ends is
ordered row by row, so a leaf with a third of all rows is never in one task.

Defined results: null and empty texts have no tokens and are taken in no
unfinished epoch; null domain, language or source is a leaf value of its own,
written ``null``; rows repeated whole are ordered by id and text hash and share
one place; unlisted weights count as 1; a weight of 0 gives nothing as long as
others can; an empty table or budget gives no copies; input columns named like
an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, fresh_names

LEVELS = ("domain", "lang", "source")
LEAST_WEIGHT = 1e-9  # stands in for a weight of 0


def token_count(text_col: str) -> Column:
    """Words of the text (runs without whitespace)."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", -1)
    empty = (F.element_at(parts, 1) == "").cast("int") + F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return (F.size(parts) - empty).cast("long")


def epoch_key(seed: int, epoch: Column, id_col: str, hash_col: str) -> Column:
    """md5 that orders an epoch's documents."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(hash_col)))


def _ends_in(sums: DataFrame, levels: list[str], bucket: str) -> DataFrame:
    """Of bucket sums (levels, rest, start, bucket, t) the bucket in which ``rest`` is reached, with the tokens before it."""
    line = Window.partitionBy(*levels).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("t").over(line), F.lit(0)))
    return sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))


def _weights(values: dict[str, float], level: str) -> Column:
    """Weight of a child: by its name, 1 if not listed."""
    if not values:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, max(float(v), LEAST_WEIGHT))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1.0))


def share(children: DataFrame, parent: list[str], child: str, weight: Column) -> DataFrame:
    """Adds ``part``: each child's part of ``budget`` within its ``cap`` (columns of every row).

    Children are taken by cap / weight (ties by name); with B the budget, C the
    caps and W the weights of those before, a child's level is
    (B - C) / (total W - W before), and its part min(cap, level * weight).
    """
    rows = children.withColumn("w", weight).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.partitionBy(*parent).orderBy("ratio", child).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy("ratio", child).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w0", F.sum("w").over(after))
    level = F.greatest(F.col("budget") - F.col("c0"), F.lit(0.0)) / F.col("w0")
    rows = rows.withColumn("full", F.col("ratio") <= level)
    # Everyone from the first child that is not full on gets that child's level.
    line = Window.partitionBy(*parent).orderBy("ratio", child)
    first = F.first(F.when(~F.col("full"), level), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.when(first.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("w")))
    return rows.withColumn("part", part).drop("w", "ratio", "c0", "w0", "full")


def leaf_budgets(leaves: DataFrame, budget: float, weights: dict[str, dict[str, float]], max_epochs: int,
                 levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels..., tokens, budget): whole tokens that each leaf of (levels..., tokens) has to give."""
    nodes = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    for depth, level in enumerate(levels):
        parent, here = list(levels[:depth]), list(levels[:depth + 1])
        kids = nodes.groupBy(*here).agg(F.sum("cap").alias("cap"))
        if depth:
            kids = kids.join(given.select(*parent, F.col("part").alias("budget")), parent)  # noqa: F821
        else:
            kids = kids.withColumn("budget", F.lit(float(budget)))
        given = share(kids, parent or [F.lit(0)], level, _weights(weights.get(level, {}), level))
    return leaves.join(given.select(*levels, F.floor(F.col("part") + 1e-6).alias("budget")), list(levels))


def mix(spark: SparkSession, docs: DataFrame, domain: Column, budget_share: float = 0.5,
        weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 4, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, __hash, domain, lang, source, n_tokens, leaf_budget, copies.  A written table.

    The budget is ``budget_share`` of all tokens; ``weights`` has a dict of
    weights for any of the levels domain, lang and source; ``copies`` is how
    often the mixture takes the document (0: not at all).
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("null"))).alias("__hash"),
                       name(domain).alias("domain"), name(F.col(lang_col)).alias("lang"), name(F.col(source_col)).alias("source"),
                       token_count(text_col).alias("n_tokens"))
    levels = list(LEVELS)
    with Scratch(spark) as own:
        rows = own.write(rows, "docs")
        leaves = own.write(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        plan = own.write(leaf_budgets(leaves, int(total * budget_share), weights or {}, max_epochs).withColumn(
            "epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")).withColumn(
            "rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)), "plan")
        keyed = rows.join(checked_broadcast(plan), levels).withColumn("k", epoch_key(seed, F.col("epochs"), "id", "__hash"))
        high, low = F.substring("k", 1, 2), F.substring("k", 3, 2)
        sums = keyed.groupBy(*levels, "rest", F.lit(0).cast("long").alias("start"), high.alias("high")).agg(F.sum("n_tokens").alias("t"))
        edge = own.write(_ends_in(sums, levels, "high").select(*levels, F.col("high").alias("edge"), F.col("before").alias("start")), "edge")
        near = keyed.join(checked_broadcast(edge), levels).filter(high == F.col("edge"))
        sums = near.groupBy(*levels, "rest", "start", "edge", low.alias("low")).agg(F.sum("n_tokens").alias("t"))
        edge = own.write(_ends_in(sums, levels, "low").select(*levels, F.concat("edge", "low").alias("edge"), "before"), "edge")
        # md5 digits are in lower case, so text order is number order.
        marked = keyed.withColumn("bucket", F.substring("k", 1, 4)).join(checked_broadcast(edge), levels, "left")
        order = Window.partitionBy(*levels).orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        inside = marked.filter(F.col("bucket") == F.col("edge"))
        upto = F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")
        inside = inside.withColumn("taken", (upto < F.col("rest")) & (F.col("n_tokens") > 0))
        outside = marked.filter(~F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))).withColumn(
            "taken", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)) & (F.col("n_tokens") > 0))
        both = inside.unionByName(outside)
        return own.write(both.select(
            F.col("id").alias(id_col), "__hash", *levels, "n_tokens", F.col("budget").alias("leaf_budget"),
            (F.col("epochs") + F.col("taken").cast("int")).alias("copies")), "mixture", keep=True)


def keep_mixture(spark: SparkSession, docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` repeated as often as the mixture takes them, all columns kept."""
    got = mix(spark, docs, domain, id_col=id_col, text_col=text_col, **params)
    own_id, own_hash, copies, again = fresh_names(docs, "__id", "__hash", "_copies", "_copy")
    rest = Scratch(spark).write(got.filter("copies <> 1").select(
        F.col(id_col).alias(own_id), F.col("__hash").alias(own_hash), F.col("copies").alias(copies)).distinct(), "copies", keep=True)
    match = (F.md5(F.coalesce(F.col(text_col), F.lit("null"))) == F.col(own_hash)) & F.col(id_col).eqNullSafe(F.col(own_id))
    out = docs.join(checked_broadcast(rest), match, "left").withColumn(copies, F.coalesce(copies, F.lit(1))).filter(F.col(copies) > 0)
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
