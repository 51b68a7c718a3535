"""Terminology, thematic index and voice from the words of a corpus alone.

Spelling variants meet on what is left of a word with a letter taken out; themes are communities of terms
that occur together; a voice is how an author's use of the commonest words differs from everyone's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .vectors import nearest


def counted_terms(words: DataFrame) -> DataFrame:
    """term and n from ``words`` (term); nulls count for nothing."""
    return words.dropna(subset=["term"]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def deletions(term: Column) -> Column:
    """``term`` and what is left of it without each one of its letters."""
    places = F.sequence(F.lit(1), F.length(term))
    left = F.transform(places, lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))))
    return F.array_distinct(F.concat(F.array(term), left))


def variant_pairs(terms: DataFrame) -> DataFrame:
    """a, b: ``terms`` (term) at most one edit apart, both ways.

    Terms an edit apart share an entry of their :func:`deletions`, and those that share one are compared.
    No more terms can share an entry than there are letters to put into each of its places, so no entry
    makes a large group, however many terms there are.
    """
    each = terms.select(F.col("term").alias("a"), F.explode(deletions(F.col("term"))).alias("key"))
    met = each.join(each.withColumnRenamed("a", "b"), "key").filter("a <> b").select("a", "b").distinct()
    return met.filter(F.levenshtein("a", "b") <= 1)


def normalised_terms(terms: DataFrame, ratio: int = 4) -> DataFrame:
    """term, n, canonical of ``terms`` (term, n).

    A term stands for the most frequent of its variants that is ``ratio`` times as frequent or more, of
    ties the first by code point, and for what that stands for; otherwise for itself.  Frequencies grow
    from step to step, so the way is short.
    """
    pairs = variant_pairs(terms)
    sized = pairs.join(terms.select(F.col("term").alias("a"), F.col("n").alias("n_a")), "a").join(terms.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")
    above = sized.filter(F.col("n_b") >= ratio * F.col("n_a")).groupBy("a").agg(F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("b"))).alias("x")).select(F.col("a").alias("term"), F.col("x.b").alias("up"))
    known = cut(terms.join(above, "term", "left").select("term", "n", F.coalesce("up", "term").alias("canonical")))
    while True:
        step = known.select(F.col("term").alias("canonical"), F.col("canonical").alias("next"))
        moved = cut(known.join(step, "canonical").select("term", "n", F.col("next").alias("canonical"), (F.col("next") != F.col("canonical")).alias("moved")))
        known = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return known


def passage_terms(words: DataFrame, least: int = 3, share: float = 0.1, most: int = 12) -> DataFrame:
    """chunk_id, term, n, weight: the ``most`` distinctive terms of each passage, from ``words`` (chunk_id, term).

    Terms of fewer than ``least`` passages, or more than ``share`` of them, tell nothing; the others weigh
    their number times the logarithm of passages by passages with the term.
    """
    rows = words.dropna().groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("n"))
    total = words.select("chunk_id").dropna().distinct().agg(F.count(F.lit(1)).alias("total"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).filter((F.col("df") >= least) & (F.col("df") <= share * F.col("total")))  # one row of total
    weighed = rows.join(df, "term").withColumn("weight", F.round(F.col("n") * F.ln(F.col("total") / F.col("df")), 6))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).select("chunk_id", "term", "n", "weight")


def term_graph(terms: DataFrame, least: int = 2) -> DataFrame:
    """a, b, w: in how many passages two distinctive terms occur together, ``least`` at least, both ways; a passage has few, so pairs are few."""
    other = terms.select("chunk_id", F.col("term").alias("b"))
    pairs = terms.select("chunk_id", F.col("term").alias("a")).join(other, "chunk_id").filter("a <> b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= least)


def communities(graph: DataFrame, rounds: int = 10) -> DataFrame:
    """term and label after ``rounds`` of label propagation over ``graph`` (a, b, w, both ways).

    In each round a term takes the label that weighs most among its neighbours, its own label counting as
    its heaviest edge; of ties the least label.  Ends early when no label changes.
    """
    graph = cut(graph)
    labels = cut(graph.groupBy("a").agg(F.max("w").alias("own")).select(F.col("a").alias("term"), F.col("a").alias("label"), "own"))
    for _ in range(rounds):
        votes = graph.join(labels.select(F.col("term").alias("b"), "label"), "b").select(F.col("a").alias("term"), "label", "w").unionByName(labels.select("term", "label", F.col("own").alias("w")))
        best = votes.groupBy("term", "label").agg(F.sum("w").alias("w")).groupBy("term").agg(F.min(F.struct((-F.col("w")).alias("less"), F.col("label").alias("label"))).alias("x"))
        step = cut(labels.join(best.select("term", F.col("x.label").alias("next")), "term").select("term", "label", "next", "own"))
        labels = step.select("term", F.col("next").alias("label"), "own")
        if step.filter("label <> next").isEmpty():
            break
    return labels.select("term", "label")


def thematic_index(words: DataFrame, *, rounds: int = 10, named: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """Themes (theme, name, terms) of a corpus and the theme and score of each passage that has one, from ``words`` (chunk_id, term).

    A theme is a community of two terms or more, named by those of most weight; a passage has the theme
    whose terms weigh most in it, of ties the least.
    """
    terms = cut(passage_terms(words, **options))
    found = communities(term_graph(terms), rounds)
    weights = terms.groupBy("term").agg(F.sum("weight").alias("weight")).join(found, "term")
    ordered = F.array_sort(F.collect_list(F.struct((-F.round("weight", 4)).alias("less"), "term")))
    themes = weights.groupBy(F.col("label").alias("theme")).agg(F.count(F.lit(1)).alias("terms"), F.array_join(F.transform(F.slice(ordered, 1, named), lambda x: x["term"]), ", ").alias("name")).filter("terms > 1")
    kept = found.join(themes.select(F.col("theme").alias("label")), "label", "left_semi")
    scores = terms.join(kept, "term").groupBy("chunk_id", "label").agg(F.round(F.sum("weight"), 4).alias("score"))
    best = scores.groupBy("chunk_id").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("label").alias("theme"))).alias("x"))
    return themes.select("theme", "name", "terms"), best.select("chunk_id", "x.theme", (-F.col("x.less")).alias("score"))


def voice_vectors(words: DataFrame, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """Scores (group, term, z) of each group's use of the ``most`` commonest words against all groups', and each group's vector of them.

    ``words`` has group and term; z is the share of a word among the group's words, less the mean over the
    groups, by the deviation over them (0 where all agree).  Nulls count for nothing.
    """
    counts = cut(words.dropna().groupBy("group", "term").agg(F.count(F.lit(1)).alias("n")))
    common = counts.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(most).select("term")
    sizes = counts.groupBy("group").agg(F.sum("n").alias("size"))
    grid = sizes.crossJoin(F.broadcast(common))  # a row for each of the few common words
    share = grid.join(counts, ["group", "term"], "left").select("group", "term", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("share"))
    stats = share.groupBy("term").agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"))
    z = share.join(F.broadcast(stats), "term").select("group", "term", F.when(F.col("sd") > 1e-12, (F.col("share") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))
    rows = z.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("term", "z"))), lambda x: x["z"]).alias("embedding"))
    return z, rows


def nearest_voices(words: DataFrame, limit: int = 3, most: int = 40) -> DataFrame:
    """group, other, score: the groups whose voices are nearest by cosine, compared in blocks of matrices."""
    _, rows = voice_vectors(words, most)
    numbered = cut(rows.withColumn("chunk_id", F.monotonically_increasing_id()))
    found = nearest(numbered.select("chunk_id", "embedding"), numbered.select(F.col("chunk_id").alias("id"), "embedding"), limit + 1)
    name = numbered.select("chunk_id", "group")
    full = found.join(name.select(F.col("chunk_id").alias("id"), "group"), "id").join(name.withColumnRenamed("group", "other"), "chunk_id")
    order = Window.partitionBy("group").orderBy(F.desc("score"), "other")
    return full.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).select("group", "other", "score")
