"""Nearest vectors, exact and by an index, and vectors at small angles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors as X
from ..operators.graph import degrees
from ..tables import edges, load, vectors, with_views
from .registry import query

ASKED = 20


def asked_vectors(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 20 is a question against all."""
    return vectors(spark, sf_dir).filter(F.col("chunk_id") % ASKED == 0).select(F.col("chunk_id").alias("id"), "embedding")


@query(with_views("vectors", f"""SELECT a.chunk_id AS id, b.chunk_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score FROM vectors a JOIN vectors b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % {ASKED} = 0
  QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 6) DESC, b.chunk_id) <= 10"""))
def nearest_exact(spark, sf_dir) -> DataFrame:
    """The ten nearest vectors to each question, all being compared in blocks."""
    rows, asked = vectors(spark, sf_dir), asked_vectors(spark, sf_dir)
    return X.best_in_lists(rows.select(F.lit(0).alias("list"), "chunk_id", "embedding"), asked.select(F.lit(0).alias("list"), "id", "embedding"), 10)


@query()
def nearest_indexed(spark, sf_dir) -> DataFrame:
    """The same from an inverted file over all vectors, each in two of 32 lists, of which 16 are probed; recall is tested."""
    return X.VectorIndex.build(vectors(spark, sf_dir).select("chunk_id", "embedding"), lists=32, copies=2).search(asked_vectors(spark, sf_dir), 10, 16)


_ALIKE = 0.97


@query(f"""WITH l AS (SELECT doc_id, lower(text) AS t, greatest(length(text), 1) AS n FROM documents), f AS (SELECT doc_id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(t) - length(replace(t, c, ''))) / n::DOUBLE) AS v FROM l),
  m AS (SELECT list(mean ORDER BY i) AS means FROM (SELECT i, avg(x) AS mean FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM f) GROUP BY i)),
  c AS (SELECT doc_id, list_transform(range(1, 27), lambda i: v[i] - means[i]) AS v FROM f, m)
  SELECT a.doc_id, count(b.doc_id) AS n_alike, min(b.doc_id) AS first_alike FROM c a LEFT JOIN c b ON a.doc_id <> b.doc_id AND round(list_cosine_similarity(a.v, b.v), 6) >= {_ALIKE} GROUP BY a.doc_id""")
def alike_by_letters(spark, sf_dir) -> DataFrame:
    """Of every document how many have almost the same share of each letter, and the first of them."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = X.cut(X.centred(docs.filter("text is not null").select("id", X.letter_frequencies(F.col("text")).alias("embedding"))))
    nodes = X.cut(rows.groupBy("embedding").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("first"), F.count(F.lit(1)).alias("n")).withColumn("first", F.slice("first", 1, 2)))
    near = X.alike_counts(nodes.select("id", "embedding", "n"), _ALIKE)
    full = nodes.join(near, "id", "left").select("embedding", "n", "first", F.coalesce("others", F.lit(0)).alias("others"), "least")
    own = F.when(F.col("id") == F.col("first")[0], F.try_element_at("first", F.lit(2))).otherwise(F.col("first")[0])
    found = rows.join(full, "embedding").select(F.col("id").alias("doc_id"), (F.col("others") + F.col("n") - 1).alias("n_alike"), F.least(own, "least").alias("first_alike"))
    return found.unionByName(docs.filter("text is null").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_alike"), F.lit(None).cast("long").alias("first_alike")))  # a null text is like none


@query()
def concepts_by_angle(spark, sf_dir) -> DataFrame:
    """Concepts of all vectors of each label clustered in order of degree, candidates by hyperplanes; tested on vectors that merge."""
    v = vectors(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("id"), "embedding", F.col("label").alias("group"))
    d = degrees(edges(spark, sf_dir)).withColumnRenamed("node", "item")
    ranked = v.select(F.col("id").alias("item")).join(d, "item", "left").select("item", F.struct((-F.coalesce("degree", F.lit(0))).alias("degree"), "item").alias("rank"))
    return X.greedy_similar(ranked, v, 0.85)
