"""Mixing sources to target weights by hierarchical token budgets (operator 1).

Sources form a tree of levels (by default domain, language, source). A token budget flows down: each node
splits its share over its children by their weights, no child gets more than its texts can give in
``max_epochs`` readings, and what one cannot take goes to its siblings by their weights. As a parent's share
never exceeds what its subtree can give, shortages are made up among siblings before they reach an ancestor.
A leaf reads whole seeded epochs of its documents, then a prefix, in tokens, of one more.

All arithmetic is on integers, so the result does not hang on the order of additions. The prefix's end is
found from sums over hash ranges: documents of one range only, not of the leaf, are put in order, so a leaf
with a third of all rows stays spread. There are about as many ranges as documents in each.

Defined results: texts of any length are counted whole; documents whose places tie are ordered by id; null levels are a node of their own; documents without tokens are never chosen; rows
that share an id and leaf are one unit (a unit cut by the prefix's end shares the rest in proportion, rounded
down); empty tables and a budget of 0 give no rows; weights not given are 1, and a weight of 0 closes a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .workspace import materialize

LEAST_RANGE_BITS = 9
HASH_BITS = 60
DEC = "decimal(38,0)"


def default_levels() -> dict[str, Column]:
    """Domain (one of four, by the first digit of the source's MD5: the tables have none), language and source."""
    return {
        "domain": F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 1), 16, 10).cast("int") % 4).cast("string")),
        "lang": F.coalesce(F.col("lang"), F.lit("")),
        "source": F.coalesce(F.col("source"), F.lit("")),
    }


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of the MD5 of seed, epoch and id: the place of a document in an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def split_budget(nodes: DataFrame, parent: list[str], budget: str, weight: str, capacity: str) -> DataFrame:
    """``nodes`` with ``share``: each parent's ``budget`` over its children by ``weight``, none above ``capacity``.

    Children fill in the order of capacity over weight; a child is full if its part of what the fuller ones have
    left is at least its capacity. Integers throughout; what rounding leaves over is not given out.
    """
    by = W.Window.partitionBy(*parent).orderBy(F.col("_fill"), *[c for c in nodes.columns if c not in (budget, weight, capacity)])
    before = by.rowsBetween(W.Window.unboundedPreceding, -1)
    rest = by.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
    open_ = nodes.where(f"{weight} > 0 and {capacity} > 0").withColumn("_fill", F.col(capacity).cast("double") / F.col(weight).cast("double"))
    filled = open_.withColumn("_left", F.col(budget).cast(DEC) - F.coalesce(F.sum(capacity).over(before), F.lit(0)).cast(DEC)).withColumn("_weights", F.sum(weight).over(rest).cast(DEC))
    part = F.expr(f"(greatest(_left, cast(0 as {DEC})) * cast({weight} as decimal(18,0))) div _weights")
    filled = filled.withColumn("_part", part.cast("bigint"))
    # the first child that is not full has the most left and the most weight: its level holds for all after it
    level = W.Window.partitionBy(*parent).orderBy("_fill").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    is_open = F.col("_part") < F.col(capacity)
    filled = filled.withColumn("_l", F.max(F.when(is_open, F.col("_left"))).over(level)).withColumn("_w", F.max(F.when(is_open, F.col("_weights"))).over(level))
    share = F.when(is_open, F.expr(f"(greatest(_l, cast(0 as {DEC})) * cast({weight} as decimal(18,0))) div _w").cast("bigint")).otherwise(F.col(capacity))
    return filled.withColumn("share", F.coalesce(share, F.lit(0).cast("bigint"))).drop("_fill", "_left", "_weights", "_part", "_l", "_w")


def leaf_budgets(leaves: DataFrame, levels: list[str], total: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """levels..., tokens, docs, share of each leaf. leaves: levels..., tokens, docs."""
    given = None
    for depth in range(len(levels)):
        own, up = levels[: depth + 1], levels[:depth]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        known = weights.get(levels[depth], {})
        weight = F.lit(1).cast("bigint")
        for name, w in known.items():
            weight = F.when(F.col(levels[depth]) == name, F.lit(int(w)).cast("bigint")).otherwise(weight)
        nodes = nodes.withColumn("weight", weight)
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("bigint"))
        else:
            nodes = nodes.join(given, up)
        given = split_budget(nodes, up, "budget", "weight", "capacity").select(*own, F.col("share").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "share"), levels)


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, percent: int = 75, max_epochs: int = 2, seed: int = 42, levels: dict[str, Column] | None = None, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns of ``docs`` (all, or those in ``keep``) with ``mix_epoch`` and ``mix_tokens`` for each document and epoch chosen.

    The budget is ``percent`` of all tokens of ``docs``. ``mix_tokens`` says how many of the text's first tokens count.
    """
    levels = levels or default_levels()
    names = [f"_{k}" for k in levels]
    kept = [c for c in docs.columns if (keep is None or c in keep) and c not in ("mix_epoch", "mix_tokens")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.col(id_col).alias("_id"), *[c.alias(f"_{k}") for k, c in levels.items()], count_tokens(F.col(text_col)).alias("tokens"))
    slim = text_col not in kept  # rows without their texts are written with their counts; texts are rather counted twice than copied
    units = materialize(packed if slim else packed.drop("_doc"), "mix-tokens").where("tokens > 0")
    leaves = materialize(units.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    tokens, largest = leaves.agg(F.sum(F.col("tokens").cast(DEC)), F.max("docs")).first()
    total = int(tokens or 0) * int(percent) // 100
    range_bits = max(LEAST_RANGE_BITS, ((largest or 1).bit_length() + 1) // 2)
    plan = leaf_budgets(leaves, names, total, {f"_{k}": v for k, v in (weights or {}).items()}, max_epochs)
    plan = materialize(plan.withColumn("whole", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")).select(*names, "whole", "rest"), "mix-plan")
    plan = materialize(plan.join(prefix_ends(units.drop("_doc"), plan, names, seed, range_bits), names, "left"), "mix-ends")  # as a table its size is known, and Spark broadcasts it or not
    placed = (units if slim else packed.where("tokens > 0")).join(plan, names)
    tie = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    placed = placed.withColumns({"key": order_key(seed, F.col("whole"), F.col("_id")), "tie": tie})
    early = "end_key is not null and (key < end_key or (key = end_key and tie < end_tie))"
    part = F.expr(f"case when {early} then tokens when key = end_key and tie = end_tie then cast((cast(end_rest as {DEC}) * tokens) div end_tokens as bigint) else 0L end")
    readings = F.expr("""concat(
        case when whole > 0 then transform(sequence(0L, whole - 1), e -> struct(e as epoch, tokens as tokens)) else cast(array() as array<struct<epoch:bigint,tokens:bigint>>) end,
        case when part > 0 then array(struct(whole as epoch, part as tokens)) else cast(array() as array<struct<epoch:bigint,tokens:bigint>>) end)""")
    read = placed.withColumn("part", part).select("_doc", F.explode(readings).alias("_reading"))
    others = [F.col("_doc").getField(c).alias(c) for c in kept]
    return read.select(*others, F.col("_reading.epoch").alias("mix_epoch"), F.col("_reading.tokens").alias("mix_tokens"))


def prefix_ends(units: DataFrame, plan: DataFrame, names: list[str], seed: int, range_bits: int = LEAST_RANGE_BITS) -> DataFrame:
    """names..., end_key, end_tie, end_rest, end_tokens: the unit of each leaf at which the prefix of its last epoch ends."""
    keyed = units.join(plan.where("rest > 0"), names).withColumn("key", order_key(seed, F.col("whole"), F.col("_id"))).withColumn("tie", F.coalesce(F.col("_id").cast("string"), F.lit("")))
    keyed = keyed.withColumn("range", F.shiftright("key", HASH_BITS - range_bits))
    sums = keyed.groupBy(*names, "range", "rest").agg(F.sum("tokens").alias("tokens"))
    along = W.Window.partitionBy(*names).orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(along), F.lit(0)))
    cut = sums.where("before < rest and rest <= before + tokens").select(*names, "range", "before")
    inside = keyed.join(cut, [*names, "range"]).groupBy(*names, "key", "tie", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    within = W.Window.partitionBy(*names).orderBy("key", "tie").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return inside.where("start < rest and rest <= start + tokens").select(*names, F.col("key").alias("end_key"), F.col("tie").alias("end_tie"), (F.col("rest") - F.col("start")).alias("end_rest"), F.col("tokens").alias("end_tokens"))
