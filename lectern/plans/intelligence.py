"""Terminology, themes and voices of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intelligence as N
from ..tables import chunks, load, with_views
from .registry import query

_WORD = r"[a-z]{5,}"


def words(frame: DataFrame, pattern: str = _WORD) -> DataFrame:
    return frame.withColumn("term", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({pattern})"), F.lit(1))))


@query(f"""WITH RECURSIVE t AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents) GROUP BY term),
  e AS (SELECT term AS a, n, key FROM (SELECT term, n, unnest(list_distinct(list_append(list_transform(range(1, length(term) + 1), lambda i: left(term, i - 1) || substr(term, i + 1)), term))) AS key FROM t)),
  p AS (SELECT DISTINCT x.a, x.n, y.a AS b, y.n AS m FROM e x JOIN e y ON x.key = y.key AND x.a <> y.a WHERE y.n >= 4 * x.n AND levenshtein(x.a, y.a) <= 1),
  u AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY m DESC, b) = 1),
  w AS (SELECT a, b FROM u UNION ALL SELECT w.a, u.b FROM w JOIN u ON u.a = w.b)
  SELECT w.a AS term, t.n, w.b AS canonical FROM w JOIN t ON t.term = w.a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.a = w.b)""")
def terminology(spark, sf_dir) -> DataFrame:
    """Words of all documents that are a spelling of a more frequent one."""
    terms = N.cut(N.counted_terms(words(load(spark, sf_dir, "documents").select("text")).select("term")))
    return N.normalised_terms(terms).filter("term <> canonical")


@query()
def thematic_index(spark, sf_dir) -> DataFrame:
    """All passages that have a theme, with it; the themes are communities of their distinctive terms (tested by loops)."""
    themes, found = N.thematic_index(words(chunks(spark, sf_dir).select("chunk_id", "text")).select("chunk_id", "term"))
    return found.join(themes, "theme")


_VOICE = with_views("chunks", r"""WITH $ w AS (SELECT work_id AS grp, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM chunks), c AS (SELECT grp, term, count(*) AS n FROM w GROUP BY ALL),
  k AS (SELECT term FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 40), s AS (SELECT grp, sum(n) AS size FROM c GROUP BY grp),
  h AS (SELECT s.grp, k.term, coalesce(c.n, 0) / s.size::DOUBLE AS share FROM s CROSS JOIN k LEFT JOIN c ON c.grp = s.grp AND c.term = k.term),
  z AS (SELECT grp, term, CASE WHEN sd > 1e-12 THEN (share - mean) / sd ELSE 0 END AS z FROM h JOIN (SELECT term, avg(share) AS mean, stddev_pop(share) AS sd FROM h GROUP BY term) USING (term))""")


@query(_VOICE + " SELECT grp AS work_id, term, round(z, 6) AS z FROM z")
def voice_scores(spark, sf_dir) -> DataFrame:
    """How each work's use of the forty commonest words differs from that of all works."""
    z, _ = N.voice_vectors(words(chunks(spark, sf_dir).select(F.col("work_id").alias("group"), "text"), "[a-z]+").select("group", "term"))
    return z.select(F.col("group").alias("work_id"), "term", F.round("z", 6).alias("z"))


@query(_VOICE + """, v AS (SELECT grp, list(z ORDER BY term) AS v FROM z GROUP BY grp), n AS (SELECT a.grp AS work_id, b.grp AS other, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.grp <> b.grp)
  SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY score DESC, other) <= 3""")
def nearest_voices(spark, sf_dir) -> DataFrame:
    """The three works whose voices are nearest to each work's."""
    rows = words(chunks(spark, sf_dir).select(F.col("work_id").alias("group"), "text"), "[a-z]+").select("group", "term")
    return N.nearest_voices(rows).withColumnRenamed("group", "work_id")
