"""Mixing sources to target weights.

A tree of sources (by default domain, language, source) gets a token budget at its root. A node's budget goes to its
children by weight; a child that has fewer tokens than its share gives the rest back to its siblings, and only what all
siblings together can't use stays with the ancestor's other children. Each leaf then reads whole seeded epochs of its
lines and a token prefix of the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise

LEVELS = ("domain", "lang", "source")
NO_NAME = "(none)"
_EXACT = "decimal(20,0)"


def leaf_budgets(
    leaves: DataFrame, weights: DataFrame, *, levels: Sequence[str] = LEVELS, total_percent: int, epochs: int
) -> DataFrame:
    """The token budget of each leaf.

    `leaves` has one row for each leaf: the level columns and tokens (one epoch). `weights` has level (a level's name),
    name and weight (whole, 0 or more) of nodes against their siblings; nodes without a row weigh 1, nodes of weight 0 get
    nothing, and neither does what lies below them. The root has `total_percent` of all tokens, a leaf can use `epochs` times its own. Returns the level columns,
    tokens and budget. Budgets are whole and never above what is due; an empty table gives no rows.
    """
    sized = leaves.withColumn("_room", F.col("tokens").cast(_EXACT) * F.lit(epochs).cast(_EXACT))
    for level in levels:
        # What may get nothing is no room of the nodes above it, or their budget would be lost to its siblings.
        named = weights.where(F.col("level") == level).groupBy(F.col("name").alias(level))
        none = named.agg(F.max("weight").alias("_most")).where(F.col("_most") <= 0).select(level, F.lit(True).alias("_none"))
        sized = sized.join(none, level, "left").withColumn(
            "_room", F.when(F.col("_none"), F.lit(0).cast(_EXACT)).otherwise(F.col("_room"))
        ).drop("_none")
    above = sized.agg(F.expr(f"(coalesce(sum(tokens), 0) * {int(total_percent)}) div 100").cast(_EXACT).alias("_due"))
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = sized.groupBy(*path).agg(F.sum("_room").cast(_EXACT).alias("_room"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(above)  # one row
        own = weights.where(F.col("level") == path[-1]).groupBy(F.col("name").alias(path[-1])).agg(
            F.max("weight").alias("_weight")
        )
        nodes = nodes.join(own, path[-1], "left").withColumn(
            "_weight", F.greatest(F.coalesce("_weight", F.lit(1)), F.lit(0)).cast(_EXACT)
        )
        above = _share_out(nodes, parent, path)
    return leaves.join(above.withColumn("budget", F.col("_due").cast("long")).drop("_due"), list(levels))


def _share_out(nodes: DataFrame, parent: list[str], path: list[str]) -> DataFrame:
    """Split each parent's _due among its children: small ones in full, the rest by weight."""
    family = Window.partitionBy(*(parent or [F.lit(0)]))
    ratio = F.col("_room").cast("double") / F.when(F.col("_weight") > 0, F.col("_weight").cast("double"))
    ordered = family.orderBy(ratio.asc_nulls_last(), F.col(path[-1]))
    zero = F.lit(0).cast(_EXACT)
    before = F.coalesce(F.sum("_room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), zero)
    after = F.sum("_weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = (F.col("_weight") > 0) & (
        F.col("_room") * F.col("_after").cast(_EXACT) <= F.col("_weight") * (F.col("_due") - F.col("_before")).cast(_EXACT)
    )
    marked = (
        nodes.withColumn("_before", before.cast(_EXACT)).withColumn("_after", after.cast(_EXACT)).withColumn("_full", full)
    )
    used = F.sum(F.when(F.col("_full"), F.col("_room")).otherwise(zero)).over(family).cast(_EXACT)
    left = F.sum(F.when(~F.col("_full"), F.col("_weight")).otherwise(zero)).over(family).cast(_EXACT)
    shared = marked.withColumn("_rest", (F.col("_due") - used).cast(_EXACT)).withColumn("_left", left)
    due = F.when(F.col("_full"), F.col("_room")).when(
        F.col("_weight") > 0, F.expr("(_weight * _rest) div nullif(_left, 0)").cast(_EXACT)
    )
    return shared.select(*path, F.coalesce(due, zero).cast(_EXACT).alias("_due"))


def epoch_rank(seed: int, epoch: Column, number: Column) -> Column:
    """The place of a line in an epoch of its leaf, as text that sorts."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(number.cast("string"), F.lit(""))))


def mix_lines(
    lines: DataFrame,
    weights: DataFrame,
    *,
    levels: Sequence[str] = LEVELS,
    total_percent: int,
    epochs: int = 1,
    seed: int = 17,
) -> DataFrame:
    """Choose lines so that the leaves of the source tree meet their token budgets.

    The project's own records carry no domain or language, so the operator is general: `lines` needs line_number, n_tokens
    and the level columns, whatever they are called. `weights`: see leaf_budgets. Returns the chosen rows with all their
    columns and n_epochs, how often each is read: the whole epochs of its leaf's budget, and one more for lines in the
    prefix of the next epoch, whose order is an md5 of seed, epoch and line number. The prefix ends before the first line
    that would exceed the budget.

    A null level counts as the name (none); null or negative n_tokens as 0; a null line number has its own fixed place. Rows
    with one line number follow each other by n_tokens. An empty table gives no rows. A leaf with only empty lines has no
    budget, and none of its lines is chosen.
    """
    leaf = list(levels)
    columns = [c for c in lines.columns if c != "n_epochs"]
    # The row travels as one value, so that no column of it can clash with the ones made here.
    named = lines.select(
        F.struct(*[F.col(c) for c in columns]).alias("_row"),
        F.col("line_number").alias("_number"),
        F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("_tokens"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(NO_NAME)).alias(c) for c in leaf],
    )
    leaves = materialise(named.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens")))
    tokens = F.greatest(F.col("tokens"), F.lit(1))
    plan = (
        leaf_budgets(leaves, weights, levels=levels, total_percent=total_percent, epochs=epochs)
        .withColumn("_whole", F.expr("budget div greatest(tokens, 1)"))
        .withColumn("_rest", F.col("budget") - F.col("_whole") * tokens)
        .select(*leaf, "_whole", "_rest")
    )
    plan = materialise(plan)
    placed = named.join(plan, leaf).withColumn("_rank", epoch_rank(seed, F.col("_whole"), F.col("_number")))
    placed = placed.withColumn("_cell", F.substring("_rank", 1, 3))
    # Prefix sums by cells of the order; only the cell in which the budget ends is put in order.
    cells = placed.groupBy(*leaf, "_rest", "_cell").agg(F.sum("_tokens").alias("_sum"))
    running = Window.partitionBy(*leaf).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        cells.withColumn("_through", F.sum("_sum").over(running))
        .where(F.col("_through") > F.col("_rest"))
        .groupBy(*leaf)
        .agg(F.min(F.struct("_cell", (F.col("_through") - F.col("_sum")).alias("_before"))).alias("_last"))
        .select(*leaf, F.col("_last._cell").alias("_last_cell"), F.col("_last._before").alias("_before"))
    )
    known = placed.join(materialise(last), leaf, "left")
    settled = known.where(F.col("_last_cell").isNull() | (F.col("_cell") != F.col("_last_cell"))).withColumn(
        "_more", F.col("_last_cell").isNull() | (F.col("_cell") < F.col("_last_cell"))
    )
    within = Window.partitionBy(*leaf).orderBy("_rank", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = known.where(F.col("_cell") == F.col("_last_cell")).withColumn(
        "_more", F.col("_before") + F.sum("_tokens").over(within) <= F.col("_rest")
    )
    chosen = settled.unionByName(split).withColumn("n_epochs", F.col("_whole") + (F.col("_more") & (F.col("_rest") > 0)).cast("long"))
    return chosen.where(F.col("n_epochs") > 0).select(*[F.col("_row")[c].alias(c) for c in columns], "n_epochs")
