"""Related passages: strategies, confidence tiers, exclusion, grouping and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCE_RANK
from .fusion import top_per_group
from .graph import undirected

# Scores by strategy.
LINK_SCORES = {"high": 0.95, "medium": 0.7, "low": 0.4}
THEME_SCORE, REFLECTION_SCORE, REFLECTION_FACTOR, VECTOR_FACTOR = 0.6, 0.85, 0.7, 0.65


def tier(kind: Column, score: Column, link: Column | None = None, direct: Column | None = None) -> Column:
    """Confidence of a connection by its kind and score; ``link`` is a passage link's own confidence, ``direct`` a reflection on the passage itself."""
    own = F.lit(None).cast("string") if link is None else link
    straight = F.lit(False) if direct is None else F.coalesce(direct, F.lit(False))
    by_score = F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")
    return (
        F.when(kind == "passage_link", F.when((own == "high") | (score > 0.8), "high").when((own == "medium") | (score > 0.5), "medium").otherwise("low"))
        .when(kind == "reflection", F.when(straight | (score > 0.7), "high").when(score > 0.4, "medium").otherwise("low"))
        .when(kind == "entity_overlap", F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low"))
        .when(kind == "theme", F.when(score > 0.75, "medium").otherwise("low"))
        .otherwise(by_score)
    )


def tier_rank(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair])[level]


def by_links(edges: DataFrame) -> DataFrame:
    """id, other, kind, score of direct links, either way."""
    both = undirected(edges.select("src", "dst", "confidence"))
    scores = F.create_map(*[F.lit(x) for pair in LINK_SCORES.items() for x in pair])
    return both.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("passage_link").alias("kind"), scores[F.col("confidence")].alias("score"))


def by_themes(seeds: DataFrame, edges: DataFrame, works: DataFrame, n: int = 5, most: int = 20) -> DataFrame:
    """id, other: of each of a seed's first ``n`` themes the first ``most`` passages of other works.

    ``works`` (src, owner) names a passage's work.  What is left of a theme without one work is made once
    for every work among its first ``most`` passages; all other works see those passages as they are.
    So seeds meet lists of ``most``, never a whole theme.
    """
    e = edges.select("src", "dst").distinct().join(works.select("src", "owner"), "src")
    order = [F.col("src").try_cast("long"), "src"]
    few = top_per_group(e, ["dst", "owner"], order, most)
    first = top_per_group(few, ["dst"], order, most).select("dst", "owner", F.col("src").alias("other"))
    among = first.select("dst", F.col("owner").alias("without")).distinct()
    rest = top_per_group(few.join(among, "dst").filter("owner <> without"), ["dst", "without"], order, most)
    mine = top_per_group(seeds.select(F.col("id").alias("src")).distinct().join(e, "src"), ["src"], ["dst"], n).select(F.col("src").alias("id"), "dst", "owner")
    known = mine.join(among.select("dst", F.col("without").alias("owner"), F.lit(True).alias("inside")), ["dst", "owner"], "left")
    plain = known.filter("inside is null").join(first.select("dst", "other"), "dst").select("id", "other")
    made_up = known.filter("inside").join(rest.select("dst", F.col("without").alias("owner"), F.col("src").alias("other")), ["dst", "owner"]).select("id", "other")
    return plain.unionByName(made_up).select("id", "other", F.lit("theme").alias("kind"), F.lit(THEME_SCORE).alias("score")).distinct()


def theme_reflections(seeds: DataFrame, themes: DataFrame, reflections: DataFrame, works: DataFrame, n: int = 5, most: int = 10) -> DataFrame:
    """id, other: for each of a seed's first ``n`` themes the first ``most`` passages that reflect on it, itself left out."""
    order = [F.col("other").try_cast("long"), "other"]
    first = top_per_group(reflections.select("dst", F.col("src").alias("other")).distinct(), ["dst"], order, most + 1)
    e = themes.select("src", "dst").distinct().join(works.select("src"), "src", "left_semi")
    mine = top_per_group(seeds.select(F.col("id").alias("src")).distinct().join(e, "src"), ["src"], ["dst"], n).select(F.col("src").alias("id"), "dst")
    met = mine.join(first, "dst").filter("id <> other")
    return top_per_group(met, ["id", "dst"], order, most).select("id", "other").distinct()


def by_reflections(links: DataFrame, near: DataFrame) -> DataFrame:
    """id, other: direct reflections on a passage (``links``: id, other), and scaled nearby personal ones (``near``: id, other, score) not among them."""
    direct = links.select("id", "other", F.lit("reflection").alias("kind"), F.lit(REFLECTION_SCORE).alias("score")).distinct()
    more = near.join(links.select("id", "other"), ["id", "other"], "left_anti")
    return direct.unionByName(more.select("id", "other", F.lit("reflection").alias("kind"), F.round(F.col("score") * REFLECTION_FACTOR, 6).alias("score")))


def related(parts: list[DataFrame], limit: int) -> DataFrame:
    """The strategies' rows together: the best for each (id, other), and the first ``limit`` of an id, with tiers."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    best = merged.groupBy("id", "other").agg(F.max(F.struct("score", "kind")).alias("best")).select("id", "other", "best.kind", "best.score")
    out = top_per_group(best, ["id"], [F.desc("score"), "other"], limit)
    return out.withColumn("confidence", tier(F.col("kind"), F.col("score")))


def grouped(found: DataFrame, n: int = 3) -> DataFrame:
    """id, confidence, total and the first ``n`` others of each tier."""
    first = top_per_group(found, ["id", "confidence"], [F.desc("score"), "other"], n)
    shown = first.groupBy("id", "confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))), lambda x: x["other"]).alias("shown"))
    return found.groupBy("id", "confidence").agg(F.count(F.lit(1)).alias("total")).join(shown, ["id", "confidence"])


def report(found: DataFrame) -> DataFrame:
    """id and a line of text for each related passage, in order, as one report."""
    line = F.format_string("- %s (%s, %.2f): %s", "other", "kind", "score", "confidence")
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))


# How a level is put, and why passages are taken for connected.
LEVEL_LABELS = {"high": "This directly engages with", "medium": "This appears to connect to", "low": "You might find this relevant"}


def explanation(kind: Column, level: Column) -> Column:
    return (
        F.when(kind == "passage_link", F.concat(F.lit("This passage directly engages with the referenced content through "), F.when(level == "high", "explicit citation").otherwise("implicit engagement"), F.lit(".")))
        .when(kind == "theme", "These passages explore parallel thematic territory.")
        .when(kind == "vector", "Semantic similarity suggests these passages address related ideas.")
        .when(kind == "reflection", "Your personal reflection engages with this content.")
        .when(kind == "entity_overlap", "Both passages share multiple entities in the knowledge graph.")
        .otherwise("A potential connection was detected between these passages.")
    )


def staged(found: DataFrame, works: DataFrame, links: DataFrame, threshold: float = 0.4, most: int = 10) -> DataFrame:
    """Connections to be proposed: id, other, target_work, kind, score, confidence, label, why; ``most`` a passage.

    Of related passages (id, other, kind, score, confidence) those of the own work, those linked either way
    and low ones under ``threshold`` are left out.
    """
    both = found.join(works.select(F.col("src").alias("id"), F.col("owner").alias("own_work")), "id").join(works.select(F.col("src").alias("other"), F.col("owner").alias("target_work")), "other")
    open_ = both.filter((F.col("own_work") != F.col("target_work")) & ~((F.col("confidence") == "low") & (F.col("score") < threshold)))
    known = undirected(links.select("src", "dst")).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()
    kept = top_per_group(open_.join(known, ["id", "other"], "left_anti"), ["id"], [F.desc("score"), "other"], most)
    label = F.create_map(*[F.lit(x) for pair in LEVEL_LABELS.items() for x in pair])[F.col("confidence")]
    return kept.select("id", "other", "target_work", "kind", "score", "confidence", label.alias("label"), explanation(F.col("kind"), F.col("confidence")).alias("why"))
