"""Set-based forms of change detection, merging, per-group choice and range merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_set(stored: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: new, changed or deleted; unchanged rows are left out.  One full outer join."""
    both = stored.select(key, F.col(digest).alias("_old")).join(current.select(key, F.col(digest).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored with incoming rows in place of those of equal key, and the new ones."""
    names = [c for c in stored.columns if c != key]
    inc = incoming.select(key, F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in names])
    pick = [F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names]
    return stored.join(inc, key, "full").select(key, *pick)


def top_per(rows: DataFrame, group: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def merged_ranges(ranges: DataFrame, group: str) -> DataFrame:
    """group, first, last: ranges that overlap or touch, united."""
    order = Window.partitionBy(group).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") > F.coalesce(F.col("reach"), F.lit(-2)) + 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = ranges.select(group, "first", "last").distinct().withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(group, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def best_per(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """group and the tie column, of any type, and score of its best row, the smallest tie first; one aggregate."""
    best = F.min_by(F.struct(score, tie), F.struct(-F.col(score), F.col(tie)))
    return rows.groupBy(group).agg(best.alias("b")).select(group, F.col(f"b.{tie}").alias(tie), F.col(f"b.{score}").alias(score))


def budget_fold(pieces: DataFrame, group: str, budget: int) -> DataFrame:
    """group, rank, piece, tokens, used: the pieces that a token budget admits, and the tokens used before each.

    pieces: group, rank (of the file), piece (its place there), whole (whether it is the whole file), tokens.  They
    are taken by rank and piece while less than the budget is used; a group's first piece always fits.  A whole file
    that does not fit ends the group, a range that does not fit only its file.  A group is one ranked list, which
    the fold holds in one row."""
    item = F.struct(F.col("rank").cast("long").alias("rank"), F.col("piece").cast("long").alias("piece"), "whole", F.col("tokens").cast("long").alias("tokens"))

    def step(state: Column, x: Column) -> Column:
        closed = state["stop"] | (state["used"] >= budget) | (~x["whole"] & state["shut"].eqNullSafe(x["rank"]))
        over = (F.size(state["taken"]) > 0) & (state["used"] + x["tokens"] > budget)
        take, refused = ~closed & ~over, ~closed & over
        row = F.struct(x["rank"].alias("rank"), x["piece"].alias("piece"), x["tokens"].alias("tokens"), state["used"].alias("used"))
        return F.struct(
            F.when(take, state["used"] + x["tokens"]).otherwise(state["used"]).alias("used"),
            (state["stop"] | (refused & x["whole"])).alias("stop"),
            F.when(refused & ~x["whole"], x["rank"]).otherwise(state["shut"]).alias("shut"),
            F.when(take, F.concat(state["taken"], F.array(row))).otherwise(state["taken"]).alias("taken"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("stop"), F.lit(None).cast("long").alias("shut"), F.from_json(F.lit("[]"), "array<struct<rank: long, piece: long, tokens: long, used: long>>").alias("taken"))
    listed = pieces.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select(group, F.inline(F.aggregate("items", start, step, lambda s: s["taken"])))
