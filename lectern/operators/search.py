"""Vector and text search over passages."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def vector_search(vectors: DataFrame, query: DataFrame, limit: int = 20, threshold: float = 0.0, filters: Column | None = None) -> DataFrame:
    """chunk_id and score of the nearest vectors to the one row of ``query`` (query_vector), filters first."""
    rows = vectors if filters is None else vectors.filter(filters)
    asked = query.limit(1).select("query_vector", V.norm(F.col("query_vector")).alias("query_norm"))
    scored = rows.crossJoin(F.broadcast(asked)).withColumn("score", F.round(V.cosine(F.col("embedding"), F.col("query_vector"), F.col("query_norm")), 6))
    return scored.filter(F.col("score") >= threshold).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(limit)


def similar_within(items: DataFrame, others: DataFrame, threshold: float, group: str = "group", block: int = 1024) -> DataFrame:
    """a, b, group, score: rows of ``items`` and ``others`` (id, embedding, group) of one group with a cosine of ``threshold`` or more.

    Groups are cut into blocks of about ``block`` rows a side, and every block of one side meets every block of
    the other as matrices; only pairs over the threshold leave a task.  An id does not meet itself.
    """
    parts = {}
    for name, frame in (("a", items), ("b", others)):
        parts[name] = frame.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"n_{name}"))
    sizes = parts["a"].join(parts["b"], group)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    one = items.join(sizes, group).select("id", "embedding", group, F.lit(0).alias("side"), own("n_a").alias("i"), every("n_b").alias("j"))
    two = others.join(sizes, group).select("id", "embedding", group, F.lit(1).alias("side"), every("n_a").alias("i"), own("n_b").alias("j"))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], group: [], "score": []}, dtype=object)
        unit = []
        for side in (left, right):
            x = np.stack(side["embedding"].to_numpy())
            size = np.linalg.norm(x, axis=1)
            unit.append(x / np.where(size == 0, 1, size)[:, None])
        score = np.round(unit[0] @ unit[1].T, 6)
        at, to = np.nonzero(score >= threshold)
        a, b = left["id"].to_numpy()[at], right["id"].to_numpy()[to]
        other = a != b
        a, b, found = a[other], b[other], score[at, to][other]
        return pd.DataFrame({"a": a, "b": b, group: pd.Series([frame[group].iloc[0]] * len(a), dtype=object), "score": found})

    return one.unionByName(two).groupBy(group, "i", "j").applyInPandas(work, f"a {kinds['id']}, b {kinds['id']}, {group} {kinds[group]}, score double")


@dataclass
class WebQuery:
    """A parsed search: alternatives of required terms and phrases, and what must not occur."""

    any_of: list[list[str]] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)


def parse_query(text: str) -> WebQuery:
    """Words are all required, ``or`` starts an alternative, ``-`` excludes, quotes make a phrase."""
    import re

    out, group = WebQuery(), []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|(\S+))', text):
        term = (phrase or word).lower()
        if minus:
            out.none_of.append(term)
        elif word and term == "or":
            out.any_of.append(group)
            group = []
        else:
            group.append(term)
    out.any_of.append(group)
    out.any_of = [g for g in out.any_of if g]
    return out


def word_text(text: Column) -> Column:
    """Lower-case words of letters and digits with a blank before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def matches(words: Column, query: WebQuery) -> Column:
    """Whether a passage's :func:`word_text` meets the query; phrases need their words side by side."""

    def has(term: str) -> Column:
        return words.contains(f" {term} ")

    found = F.lit(False)
    for group in query.any_of:
        every = F.lit(True)
        for term in group:
            every = every & has(term)
        found = found | every
    for term in query.none_of:
        found = found & ~has(term)
    return found


def occurrences(words: Column, term: str) -> Column:
    # Adjacent occurrences share a blank, so each is counted by its end.
    doubled = F.replace(words, F.lit(" "), F.lit("  "))
    mark = f" {term.replace(' ', '  ')} "
    return ((F.length(doubled) - F.length(F.replace(doubled, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def keyword_search(passages: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """chunk_id, score (term occurrences a hundred words) and snippet of passages that meet the query."""
    query = parse_query(text)
    rows = passages.withColumn("_words", word_text(F.col("text"))).filter(matches(F.col("_words"), query))
    terms = sorted({t for g in query.any_of for t in g})
    hits = sum((occurrences(F.col("_words"), t) for t in terms), F.lit(0))
    size = F.size(F.split(F.trim("_words"), " "))
    scored = rows.withColumn("score", F.round(100.0 * hits / size, 6))
    return scored.select("chunk_id", "score", snippet(F.col("text"), terms).alias("snippet")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def snippet(text: Column, terms: list[str], size: int = 160) -> Column:
    """The text around the first occurrence of the first term, every term between double asterisks."""
    flat = F.regexp_replace(text, r"\s+", " ")
    at = F.greatest(F.lit(1), F.instr(F.lower(flat), terms[0]) - 40) if terms else F.lit(1)
    part = F.substring(flat, at, F.lit(size))
    for term in terms:
        part = F.regexp_replace(part, rf"(?i)\b({term})\b", "**$1**")
    return part


def _gram_hashes(words: Column, n: int) -> Column:
    """Hash of the ``n`` words from each place on."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " ")))


def phrase_search(passages: DataFrame, phrases: DataFrame, gram: int = 5, most: int = 100_000) -> DataFrame:
    """Passages that hold a phrase of ``phrases`` (phrase_id, phrase of any length), once for each.

    A phrase's first ``gram`` words, all if it has fewer, are hashed; passages are searched for these hashes
    and only those that have one meet the phrase in full.  Up to ``most`` distinct hashes are broadcast, so
    passages are not shuffled; beyond, the hashes of words meet them by a sort-merge join, without texts.
    """
    asked = phrases.select("phrase_id", word_text(F.col("phrase")).alias("asked")).filter("asked <> '  '")
    word = F.split(F.trim("asked"), " ")
    asked = asked.withColumn("size", F.least(F.lit(gram), F.size(word))).withColumn("gram", F.xxhash64(F.array_join(F.slice(word, F.lit(1), F.col("size")), " ")))
    keys = asked.select("size", "gram").distinct()
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())
    few = keys.limit(most + 1).count() <= most
    texts = passages.select("chunk_id", word_text(F.col("text")).alias("words"))
    listed = texts.withColumn("w", F.split(F.trim("words"), " "))
    found = None
    for n in sizes:
        mine = listed.select("chunk_id", F.explode(F.array_distinct(_gram_hashes(F.col("w"), n))).alias("gram"))
        wanted = asked.filter(F.col("size") == n).select("phrase_id", "gram", "asked")
        hits = mine.join(F.broadcast(wanted.select("gram").distinct()) if few else wanted.select("gram").distinct(), "gram", "left_semi")
        part = hits.join(wanted, "gram")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.select(F.lit(None).alias("phrase_id"), "chunk_id").limit(0)
    return found.join(texts, "chunk_id").filter(F.col("words").contains(F.col("asked"))).select("phrase_id", "chunk_id").distinct()
