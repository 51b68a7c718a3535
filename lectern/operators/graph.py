"""The typed graph as edge rows: traversal, patterns, upserts, merges and clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both ends."""
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows by key, those of ``new`` in place of those of ``old``; of equal keys in ``new`` the largest row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    latest = F.max(F.struct("_new", *rest)).alias("_row")
    return both.groupBy(*key).agg(latest).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both are nodes; others are silently not written."""
    keys = nodes.select("key").distinct()
    return edges.join(keys.select(F.col("key").alias("src")), "src", "left_semi").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi")


def paths(edges: DataFrame, seeds: DataFrame, depth: int, carry: Sequence[str] = ("link_type", "confidence")) -> DataFrame:
    """Paths of 1 to ``depth`` edges from ``seeds`` (node), no edge used twice: seed, node, hops, first edge's ``carry``.

    One row for each path.  Unrolled joins, one for each hop, on the edge's source.
    """
    e = edges.select("src", "dst", *carry)
    here = seeds.select(F.col("node").alias("seed"), "node").join(e, F.col("node") == F.col("src"))
    here = here.select("seed", F.col("dst").alias("node"), *carry, F.array(F.struct("src", "dst")).alias("used"))
    out = here.withColumn("hops", F.lit(1))
    step = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    for hop in range(2, depth + 1):
        here = here.join(step, F.col("node") == F.col("_s")).filter(~F.array_contains("used", F.struct(F.col("_s").alias("src"), F.col("_d").alias("dst"))))
        here = here.select("seed", F.col("_d").alias("node"), *carry, F.concat("used", F.array(F.struct(F.col("_s").alias("src"), F.col("_d").alias("dst")))).alias("used"))
        out = out.unionByName(here.withColumn("hops", F.lit(hop)))
    return out.drop("used")


def within_hops(edges: DataFrame, depth: int) -> DataFrame:
    """seed, node, hop: the nodes that ``depth`` edges or fewer lead to from each source, at their first hop, the seed left out.

    A hop starts from the nodes new in the one before, so none is followed twice from a seed.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    here = cut(edges.select(F.col("src").alias("seed"), F.col("dst").alias("node")).distinct().filter("seed <> node"))
    seen = here.withColumn("hop", F.lit(1))
    for hop in range(2, depth + 1):
        there = here.join(step, F.col("node") == F.col("at")).select("seed", F.col("next").alias("node")).distinct().filter("seed <> node")
        here = cut(there.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(here.withColumn("hop", F.lit(hop)))
    return seen


def overlap_tier(n: Column) -> tuple[Column, Column]:
    """Tier and score of a number of shared entities."""
    return F.when(n >= 5, "high").when(n >= 3, "medium").otherwise("low"), F.when(n >= 5, 0.95).when(n >= 3, 0.75).otherwise(0.5)


def without_linked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) that no link (src, dst) joins in either direction."""
    known = links.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
    return pairs.join(known, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def orphans(edges: DataFrame, nodes: DataFrame, most: int = 1) -> DataFrame:
    """Nodes (key) of degree ``most`` or less, with the degree."""
    d = degrees(edges)
    return nodes.select("key").join(d, F.col("key") == F.col("node"), "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree")).filter(F.col("degree") <= most)


def delete_nodes(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges that touch none of ``keys``."""
    gone = keys.select("key")
    return edges.join(gone.select(F.col("key").alias("src")), "src", "left_anti").join(gone.select(F.col("key").alias("dst")), "dst", "left_anti").select(*edges.columns)


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``mapping`` (old, new), duplicates and loops gone; idempotent."""
    out = edges.select("src", "type", "dst")
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias(end), "new")
        out = out.join(m, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return out.filter("src <> dst").distinct().select("src", "type", "dst")


def greedy_clusters(ranked: DataFrame, similar: DataFrame, spark) -> DataFrame:
    """item and representative: in order of rank, an item not yet taken takes all free items similar to it.

    ``ranked`` (item, rank) and ``similar`` (a, b, both directions).  An item represents itself exactly
    when no similar item of smaller rank represents itself; rounds settle all items whose smaller
    neighbours are settled, so there are as many rounds as the longest falling chain, not items.
    """
    near = similar.join(ranked.select(F.col("item").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("item").alias("b"), F.col("rank").alias("rb")), "b")
    smaller = cut(near.filter("rb < ra").select("a", "b", "rb"))
    state = cut(ranked.select("item", F.lit(None).cast("boolean").alias("head")))
    while True:
        seen = smaller.join(state, F.col("b") == F.col("item"), "left").groupBy("a").agg(F.max(F.col("head")).alias("some"), F.count_if(F.col("head").isNull()).alias("open"))
        step = state.join(seen, F.col("item") == F.col("a"), "left")
        settled = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("some"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = cut(step.select("item", settled.alias("head")))
        if state.filter("head is null").isEmpty():
            break
    heads = state.filter("head").select(F.col("item").alias("b"))
    first = smaller.join(heads, "b", "left_semi").groupBy("a").agg(F.min_by("b", "rb").alias("representative"))
    return state.join(first, F.col("item") == F.col("a"), "left").select("item", F.when(F.col("head"), F.col("item")).otherwise(F.col("representative")).alias("representative"))


def latest(frame: DataFrame, key: str, version: str) -> DataFrame:
    """Add is_current: whether the row has its key's largest version."""
    return frame.withColumn("is_current", F.col(version) == F.max(version).over(Window.partitionBy(key)))
