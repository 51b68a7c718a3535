"""Pairs that share most: top-k set-overlap joins by prefixes and a threshold that rises first.

Sources with the same targets are one class, so copies and hot groups cost a row each.  Rare targets give
pairs of classes cheaply, and the k-th best of these is a threshold that the answer cannot fall below.
Two classes that share that many targets share one among the first of each, targets being ordered by how
many classes have them; only these prefixes are joined, and what cannot reach the threshold from where the
two meet is left out before sets are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Classes that a rare target may have; lists up to that long give the first threshold.
RARE = 64


def _classes(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Classes (c, targets by number of classes, size, firsts: the first members of two owners) and members (src, owner, c)."""
    kinds = rows.select("targets").distinct().withColumn("c", F.monotonically_increasing_id())
    kinds = cut(kinds)
    members = cut(rows.join(kinds, "targets").select("src", "owner", "c"))
    each = kinds.select("c", F.explode("targets").alias("target"))
    order = each.join(each.groupBy("target").agg(F.count(F.lit(1)).alias("df")), "target")
    sets = order.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "target"))).alias("targets"))
    by_owner = members.groupBy("c", "owner").agg(F.min("src").alias("src"))
    first = by_owner.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("src"))).filter("n <= 2")
    firsts = first.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("src", "owner"))).alias("firsts"))
    return cut(sets.join(firsts, "c").select("c", "targets", F.size("targets").alias("size"), "firsts")), members


def _best(one: Column, other: Column) -> Column:
    """The least pair (a, b) of members with different owners, null without any."""
    met = F.flatten(F.transform(one, lambda p: F.transform(other, lambda q: F.when((p["owner"] != q["owner"]) & (p["src"] != q["src"]), F.struct(F.least(p["src"], q["src"]).alias("a"), F.greatest(p["src"], q["src"]).alias("b"))))))
    return F.array_min(F.filter(met, lambda x: x.isNotNull()))


def _compared(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """c, d, shared, best of pairs of classes (c, d) that share ``least`` targets and have members of different owners."""
    found = pairs
    for end in ("c", "d"):
        found = found.join(classes.select(F.col("c").alias(end), F.col("targets").alias(f"of_{end}"), F.col("firsts").alias(f"firsts_{end}")), end)
    shared = F.size(F.array_intersect("of_c", "of_d"))
    return found.select("c", "d", shared.alias("shared"), _best(F.col("firsts_c"), F.col("firsts_d")).alias("best")).filter((F.col("shared") >= least) & F.col("best").isNotNull())


def _top(compared: DataFrame, k: int) -> DataFrame:
    return compared.orderBy(F.desc("shared"), "best").limit(k)


def _members(members: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """c, src, owner: the first 2k members of each wanted class, at most k of an owner; the k least pairs need no others."""
    mine = members.join(F.broadcast(wanted), "c")  # at most 2k classes
    own = mine.withColumn("n", F.row_number().over(Window.partitionBy("c", "owner").orderBy("src"))).filter(F.col("n") <= k)
    return own.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("src"))).filter(F.col("n") <= 2 * k).select("c", "src", "owner")


def top_shared(edges: DataFrame, group: DataFrame, k: int, least: int = 2, rare: int = RARE) -> DataFrame:
    """The ``k`` pairs of sources of different owners (src, owner) that share most targets, ``least`` at least: a, b, shared, targets.

    Of equal counts the smaller (a, b) come first.  Exact.  Edges and sources without a null are read, repeated
    edges once, sources without an owner not at all; an empty table gives an empty result.
    """
    linked = edges.select("src", "dst").dropna().distinct()
    rows = linked.join(group.select("src", "owner").dropna(), "src").groupBy("src", "owner").agg(F.array_sort(F.collect_set("dst")).alias("targets")).filter(F.size("targets") >= least)
    classes, members = _classes(cut(rows), least)
    alone = classes.select("c", F.col("c").alias("d"), F.col("size").alias("shared"), _best(F.col("firsts"), F.col("firsts")).alias("best")).filter("best is not null")

    few = classes.select("c", F.explode("targets").alias("t")).filter(F.col("t.df").between(2, rare)).select("c", F.col("t.target").alias("target"))
    cheap = few.join(few.withColumnRenamed("c", "d"), "target").filter("c < d").select("c", "d").distinct()
    first = cut(_top(_compared(cheap, classes, least).unionByName(alone), k))
    reached = first.agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("shared")).first()
    threshold = max(least, reached.shared) if reached.n == k else least

    prefix = classes.filter(F.col("size") >= threshold).select("c", "size", F.posexplode(F.slice("targets", F.lit(1), F.col("size") - threshold + 1)).alias("at", "t")).select("c", "size", "at", F.col("t.target").alias("target"))
    other = prefix.select("target", F.col("c").alias("d"), F.col("size").alias("size_d"), F.col("at").alias("at_d"))
    reach = 1 + F.least(F.col("size") - F.col("at"), F.col("size_d") - F.col("at_d")) - 1
    met = prefix.join(other, "target").filter((F.col("c") < F.col("d")) & (reach >= threshold))
    best = cut(_top(_compared(met.select("c", "d").distinct(), classes, threshold).unionByName(alone), k))

    wanted = cut(_members(members, best.select("c").union(best.select(F.col("d").alias("c"))).distinct(), k))
    sides = [wanted.select(F.col("c").alias(name), F.struct("src", "owner").alias(f"of_{name}")) for name in ("c", "d")]
    pairs = best.select("c", "d", "shared").join(sides[0], "c").join(sides[1], "d")
    a, b = F.least("of_c.src", "of_d.src"), F.greatest("of_c.src", "of_d.src")
    named = pairs.filter("of_c.owner <> of_d.owner and of_c.src <> of_d.src").select(a.alias("a"), b.alias("b"), F.col("shared").cast("long").alias("shared"), "c", "d").dropDuplicates(["a", "b"])
    last = named.orderBy(F.desc("shared"), "a", "b").limit(k)
    sets = classes.select("c", F.transform("targets", lambda t: t["target"]).alias("of"))
    full = last.join(sets, "c").join(sets.select(F.col("c").alias("d"), F.col("of").alias("of_d")), "d")
    return full.select("a", "b", "shared", F.array_sort(F.array_intersect("of", "of_d")).alias("targets")).orderBy(F.desc("shared"), "a", "b")
