"""A question answered by passages: its type picks the branches, then graph, evidence and a budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STRATEGIES
from . import fulltext, fusion
from .catalogue import question_type
from .graph import undirected
from .search import vector_search

#: What a link counts by its confidence, and passages from the graph.
LINK_SCORES = {"high": 0.95, "medium": 0.7, "low": 0.4}
FROM_GRAPH = 20


def _by_confidence(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LINK_SCORES.items() for x in pair]), level), F.lit(min(LINK_SCORES.values())))


def text_branch(passages: DataFrame, question: str, kind: str, limit: int) -> DataFrame:
    """chunk_id and score by words: for a question for a quotation its quoted part, or all of it, as a phrase."""
    if kind == "quote":
        quoted = re.search(r'"([^"]+)"', question)
        query = fulltext.phrase_query(quoted[1] if quoted else question)
    else:
        query = fulltext.web_query(" or ".join(re.findall(r"[^\W_]+", question)))
    if not query.any_of:
        return passages.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
    found = fulltext.found_positions(passages, query.lexemes)
    return fulltext.search_ranked(found, query, limit).withColumnRenamed("id", "chunk_id")


def retrieved(passages: DataFrame, vectors: DataFrame, links: DataFrame, question: str, query_vector: DataFrame, kind: str | None = None) -> DataFrame:
    """section, n, chunk_id, score of what a question finds, each passage in its first section alone.

    Section 0 fuses vectors of the granularity that the question's type prefers with passages that have
    its words or its phrase; 1 has what links (src, dst, confidence) join to these, 2 short passages
    near the question that are not among them.  ``passages`` has chunk_id, work_id, text, granularity.  The limits of the
    three are the type's strategy, so later steps handle a bounded number of rows.
    """
    spark = passages.sparkSession
    kind = kind or spark.range(1).select(question_type(F.lit(question)).alias("kind")).first().kind
    most, evidence, by_vector, by_words, level = STRATEGIES[kind]

    def near(granularity: str, limit: int, without: DataFrame | None = None) -> DataFrame:
        mine = passages.filter(F.col("granularity") == granularity).select("chunk_id")
        rows = vectors.join(mine, "chunk_id", "left_semi")
        rows = rows if without is None else rows.join(F.broadcast(without.select("chunk_id")), "chunk_id", "left_anti")  # no more than the limit of section 0
        return vector_search(rows, query_vector, limit, -1.0)

    lists = [fusion.ranked(f.withColumn("source", F.lit(name)), "source") for f, name in ((near(level, most), "vector"), (text_branch(passages, question, kind, most), "text"))]
    first = fusion.fuse([lists[0], lists[1].select(lists[0].columns)], [by_vector, by_words], limit=most).select("chunk_id", F.col("fused").alias("score"))
    first = fusion.cut(first)
    linked = undirected(links.select("src", "dst", "confidence")).join(F.broadcast(first.select(F.col("chunk_id").alias("src"))), "src")
    graph = linked.join(F.broadcast(first.select(F.col("chunk_id").alias("dst"))), "dst", "left_anti").groupBy(F.col("dst").alias("chunk_id")).agg(F.max(_by_confidence(F.col("confidence"))).alias("score"))
    graph = graph.orderBy(F.desc("score"), "chunk_id").limit(FROM_GRAPH)
    parts = [first, graph, near("micro", evidence, first)]
    sections = [fusion.ranked(p.select("chunk_id", "score").withColumn("section", F.lit(i)), "section") for i, p in enumerate(parts)]
    every = sections[0].unionByName(sections[1]).unionByName(sections[2])
    return fusion.top_per_group(every, ["chunk_id"], ["section"], 1).select("section", F.col("rank").alias("n"), "chunk_id", "score")


def answered(found: DataFrame, passages: DataFrame, works: DataFrame, budget: int = 100_000) -> DataFrame:
    """section, n, chunk_id, score, title, year of the passages that fit ``budget`` tokens (four characters each), section by section."""
    sized = found.join(passages.select("chunk_id", "work_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("cost")), "chunk_id")
    rows = sized.select(F.lit(0).alias("q"), "section", F.col("n").cast("long").alias("ord"), F.col("chunk_id").alias("id"), "cost")
    kept = fusion.within_budget(rows, "q", budget).select(F.explode("ids").alias("chunk_id"))
    named = works.select("work_id", "title", F.coalesce(F.col("publication_year").cast("string"), F.lit("undated")).alias("year"))
    return sized.join(kept, "chunk_id", "left_semi").join(named, "work_id").select("section", F.col("n").cast("long").alias("n"), "chunk_id", F.round("score", 9).alias("score"), "title", "year")
