"""Ranked lists: ranks, reciprocal rank fusion, de-duplication, blending and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def ranked(frame: DataFrame, *lists: str, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """Add rank, from 1, by descending score and then key, within each of ``lists``."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*lists).orderBy(F.desc(score), key)))


def top(frame: DataFrame, n: int, *by: Column | str) -> DataFrame:
    return frame.orderBy(*by).limit(n)


def top_per_group(frame: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps no more than n rows of a group in each task."""
    return frame.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def fuse(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = 60, limit: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, source, score, rank): the weights over k + rank, summed.

    Gives key, fused, best_source (of the best original score) and ranks by source.
    """
    if not lists:
        raise ValueError("no ranked lists; an empty fusion has no schema")
    if weights is not None and len(weights) != len(lists):
        raise ValueError("as many weights as lists are needed")
    parts = [f.select(key, "source", "score", "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for f, w in zip(lists, weights or [1.0] * len(lists), strict=True)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    fused = merged.groupBy(key).agg(F.sum("part").alias("fused"), F.max_by("source", F.struct("score", "source")).alias("best_source"), F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("ranks"))
    ordered = fused.orderBy(F.desc(F.round("fused", 12)), key)
    return ordered if limit is None else ordered.limit(limit)


def keep_best(frame: DataFrame, key: str = "chunk_id", score: str = "score", arrival: str = "arrival") -> DataFrame:
    """One row a key: the best score, of equals the first to arrive."""
    return top_per_group(frame, [key], [F.desc(score), arrival], 1)


def keep_first_by_id_and_text(frame: DataFrame, group: str) -> DataFrame:
    """Group, arrival, id and text_key of the rows whose id and text are both new among those kept so far, in order of arrival.

    A row that goes registers neither, so the passes cannot be taken one after the other.  Needs the
    group column, arrival, id and text_key.  A fold over the group's sorted rows in one expression; a
    group is one query's result list.
    """
    item = F.struct("arrival", "id", "text_key")
    kinds = {n: frame.schema[n].dataType.simpleString() for n in ("arrival", "id", "text_key")}
    start = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in kinds.items()) + ">>")

    def step(kept: Column, row: Column) -> Column:
        known = F.exists(kept, lambda k: (k["id"] == row["id"]) | (k["text_key"] == row["text_key"]))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(row)))

    rows = frame.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return rows.select(group, F.explode(F.aggregate("rows", start, step)).alias("x")).select(group, "x.*")


def within_budget(frame: DataFrame, group: str, budget: int) -> DataFrame:
    """Rows that fit: sections in order, each adding rows until the first that does not fit.

    Later sections go on with what is left.  Needs group, section, ord and cost.  A fold over the
    group's sorted rows in one expression; a group is one query's candidates.
    """
    item = F.struct("section", "ord", "id", "cost")
    rows = frame.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("closed"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, row: Column) -> Column:
        shut = acc["closed"] == row["section"]
        fits = ~shut & (acc["used"] + row["cost"] <= budget)
        return F.struct(
            F.when(fits, acc["used"] + row["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(shut | fits, acc["closed"]).otherwise(row["section"].cast("long")).alias("closed"),
            F.when(fits, F.concat(acc["ids"], F.array(row["id"]))).otherwise(acc["ids"]).alias("ids"))

    return rows.select(group, F.aggregate("rows", start, step).alias("got")).select(group, F.col("got.used").alias("used"), F.col("got.ids").alias("ids"))


def packed(frame: DataFrame, group: Sequence[str], budget: int, order: str = "pos", size: str = "words") -> DataFrame:
    """Greedy packing: (group, pos, pack), a new pack whenever the next item would go over the budget.

    The fold keeps where packs start, not an entry for each item; items then count the starts before them.
    """
    item = F.struct(F.col(order).cast("long").alias("pos"), F.col(size).cast("long").alias("size"))
    rows = frame.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("fill"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, row: Column) -> Column:
        over = (F.size(acc["starts"]) == 0) | (acc["fill"] > 0) & (acc["fill"] + row["size"] > budget)
        return F.struct(F.when(over, row["size"]).otherwise(acc["fill"] + row["size"]).alias("fill"), F.when(over, F.concat(acc["starts"], F.array(row["pos"]))).otherwise(acc["starts"]).alias("starts"))

    starts = rows.select(*group, F.explode(F.aggregate("rows", start, step)["starts"]).alias("pos"), F.lit(1).alias("_start"))
    placed = frame.select(*group, F.col(order).cast("long").alias("pos")).join(starts, [*group, "pos"], "left")
    upto = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(*group, "pos", (F.count("_start").over(upto) - 1).cast("int").alias("pack"))


def numbered(frame: DataFrame, group: str, order: str) -> DataFrame:
    """Add number, from 0, in order within each group; counted by ranges, so that no group is one task.

    Ranges are set down by a checkpoint; a row's number is its place in its range and the sizes of the
    group's ranges before it.  ``order`` should have few ties, which come in no fixed order.
    """
    placed = cut(frame.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)))
    joined = inside.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("number", F.col("_rn") - 1 + F.col("_before")).drop("_g", "_p", "_before", "_rn", "_part")


def blended(frame: DataFrame, most: int, least_personal: int, group: str) -> DataFrame:
    """``most`` rows a group: the best personal ones up to ``least_personal`` first, then by score."""
    kind = F.col("source_class") == "personal"
    rn = F.row_number().over(Window.partitionBy(group, kind).orderBy(F.desc("score"), "id"))
    held = frame.withColumn("reserved", kind & (rn <= least_personal))
    return top_per_group(held, [group], [F.desc("reserved"), F.desc("score"), "id"], most)
