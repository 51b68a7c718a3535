"""Operator 5 (DataFrame functions only): mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a schedule of how its share of demand varies over training.  The integral
of a schedule is its source's cumulative token demand; inverting it turns the place of a document in
its source's stream of tokens into a training position, by which the documents are range-sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of, unused

#: Schedules as knots (time from 0 to 1, relative demand), linear between: falling, even, rising.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WEIGHTS = (3, 1, 2)
_PART_ROWS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def target_shares(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """source, number, weight, source_size and target from source and source_size.

    Sources are numbered by code point, null last, and take ``weights`` in turn.  Together they get
    ``share`` of all sizes in proportion to weight; none more than ``most`` times its size, what is
    above being shared again among the rest.  As the sources stop in order of size over weight, running
    sums in that order give the level at which the sharing ends, without iteration.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = sources.withColumn("number", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", pick)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    summed = numbered.withColumns({
        "stopped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all": F.sum("source_size").over(everything),
    })
    level = (share * F.col("all") - F.col("stopped")) / F.col("open")
    tried = summed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    end = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "number", "level"))).over(everything)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(end["level"], F.lit(float("inf"))) * F.col("weight"))
    return tried.withColumn("target", target).select("source", "number", "weight", "source_size", "target")


def position(done: Column, number: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Time at which a source's schedule has asked for the part ``done`` (0 to 1) of its demand."""
    cases = None
    for k, knots in enumerate(schedules):
        total = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
        asked, inverse = 0.0, None
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            area = (t1 - t0) * (a + b) / 2
            rest = done * total - asked
            slope = (b - a) / (t1 - t0)
            step = rest / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * rest)) - a) / slope
            here = F.lit(t0) + step
            inverse = F.when(done * total <= asked + area, here) if inverse is None else inverse.when(done * total <= asked + area, here)
            asked += area
        mine = inverse.otherwise(F.lit(float(knots[-1][0])))
        cases = F.when(number % len(schedules) == k, mine) if cases is None else cases.when(number % len(schedules) == k, mine)
    return cases


def place(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Add source_size, target, number, order, start and goal to ``rows`` (doc_id, source, size, and others).

    A source's documents form a stream in the order of a hash of their ids, and ``start`` is a document's
    place in it, in words.  The mix takes the stream's first ``goal`` (whole part of target) words, going
    around again where that exceeds the source.  So every document is taken whole, or whole and again,
    but the one on which the target falls, and a source's taken words differ from its target by less
    than one.  Places are running sums within the hash's first digits, as many as leave some thousand rows
    to a part, plus the sums of the parts before, so no source is gathered anywhere.
    """
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / _PART_ROWS, 16)))
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("order", 1, digits))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    shares = target_shares(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    parts = parts.alias("p").join(shares.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.source", "part", "before", "number", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("upto", F.sum("size").over(inside))
    joined = run.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    joined = joined.select("r.*", "p.before", "p.number", "p.source_size", "p.target")
    return joined.withColumns({"start": F.col("before") + F.col("upto") - F.col("size"), "goal": F.floor("target")}).drop("part", "upto", "before")


def _in_lap(lap: Column | int) -> Column:
    """Words that lap number ``lap`` of the stream takes of a document."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("source_size") * lap - F.col("start")))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = CURRICULUM, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position; by position.

    size is the number of words, 0 for null and empty texts, of which nothing is taken.  Null sources
    are one source, the last.  Repeated rows count each; of rows with equal ids the smaller is first.
    position is where in training (0 to 1) the document first comes.  An empty table gives an empty
    result; further columns are not read.  Documents that are not taken come last.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(_WORD)).cast("long").alias("size"))
    out = place(cut(slim), weights, share, most)
    out = out.withColumn("taken", sum((_in_lap(lap) for lap in range(most)), F.lit(0)).cast("long"))
    at = position(F.col("start") / F.nullif(F.col("goal"), F.lit(0)), F.col("number"), schedules)
    out = out.withColumn("position", F.when(F.col("taken") > 0, at)).orderBy(F.col("position").asc_nulls_last(), "order", "doc_id")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "position")


def materialise(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = CURRICULUM, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of the mix with the columns of ``docs`` (doc_id, text, source and others), by training position.

    A document comes whole, once for each lap that takes any of its words, so a source goes beyond its
    target by less than the document on which that falls.  Rows that agree in id, source and text are
    placed as one and share alike, so that the join has one decision for each row.  Null texts count as
    empty; documents without words never come, nor does anything of an empty table.  Null ids and sources are
    values; further columns pass through, whatever their names.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_of("text")).alias("hash")]
    slim = docs.select(*key, F.regexp_count(text_of("text"), F.lit(_WORD)).cast("long").alias("words"))
    rows = cut(slim.groupBy("doc_id", "source", "hash", "words").agg(F.count(F.lit(1)).alias("twins"))).withColumn("size", F.col("words") * F.col("twins"))
    placed = place(rows, weights, share, most)
    laps = F.array(*[F.struct(F.lit(lap).alias("lap"), _in_lap(lap).alias("taken"), position((F.col("start") + F.col("source_size") * lap) / F.nullif(F.col("goal"), F.lit(0)), F.col("number"), schedules).alias("position")) for lap in range(most)])
    plan = placed.withColumn("laps", F.filter(laps, lambda x: x["taken"] > 0)).filter(F.size("laps") > 0).select("doc_id", "source", "hash", "words", "order", "laps")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("p.source")) & (F.xxhash64(text_of("d.text")) == F.col("p.hash"))
    plan = plan.select("doc_id", "source", "hash", F.struct("words", "order", "laps").alias("plan"))
    whole, lap = unused(docs, "_plan"), unused(docs, "_lap")
    each = docs.alias("d").join(plan.alias("p"), on).select("d.*", F.col("p.plan").alias(whole)).withColumn(lap, F.explode(F.col(whole)["laps"]))
    return each.orderBy(F.col(lap)["position"], F.col(whole)["order"], F.col(lap)["lap"]).select(*docs.columns)
