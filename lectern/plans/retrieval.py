"""Retrieval: vector and text search, fusion, boosts, de-duplication, context and blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import fingerprint
from ..operators import fusion, search
from ..tables import chunks, edges, load, vectors, with_views, works
from .registry import query

_Q = "(SELECT embedding FROM vectors WHERE chunk_id = 0)"
_COS = f"round(list_cosine_similarity(v.embedding, {_Q}), 6)"


def query_vector(spark, sf_dir) -> DataFrame:
    """The vector of passage 0 stands for an embedded question."""
    return vectors(spark, sf_dir).filter("chunk_id = 0").select(F.col("embedding").alias("query_vector"))


def passages(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "work_id", "text", "granularity", "source_class")


_WORDS = r"' '||regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')||' '"
_HITS = "((length(replace(w, ' ', '  ')) - length(replace(replace(w, ' ', '  '), ' {0} ', ''))) // length(' {0} '))"


def _keyword_sql(all_terms: list[str], without: str, limit: int) -> str:
    hits = " + ".join(_HITS.format(t) for t in sorted(all_terms))
    every = " AND ".join(f"contains(w, ' {t} ')" for t in all_terms)
    return f"SELECT chunk_id, round(100.0::DOUBLE * ({hits}) / len(string_split(trim(w), ' ')), 6) AS score FROM (SELECT chunk_id, {_WORDS} AS w FROM chunks) WHERE {every} AND NOT contains(w, ' {without} ') ORDER BY score DESC, chunk_id LIMIT {limit}"


@query(with_views("chunks", _keyword_sql(["the", "thing"], "under", 25)))
def keyword_and_match(spark, sf_dir) -> DataFrame:
    return search.keyword_search(passages(spark, sf_dir), "the thing -under", 25).select("chunk_id", "score")


@query(with_views("chunks vectors", f"""WITH $ a AS (SELECT chunk_id, {_COS} AS score FROM vectors v JOIN chunks USING (chunk_id) WHERE granularity = 'meso' ORDER BY score DESC, chunk_id LIMIT 50),
  b AS ({_keyword_sql(["the"], "under", 50)}), r AS (SELECT chunk_id, 'vector' AS source, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM a UNION ALL SELECT chunk_id, 'keyword', score, row_number() OVER (ORDER BY score DESC, chunk_id) FROM b)
  SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, count(*) AS lists FROM r GROUP BY chunk_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, chunk_id LIMIT 20"""))
def hybrid_rrf_search(spark, sf_dir) -> DataFrame:
    c = passages(spark, sf_dir)
    meso = vectors(spark, sf_dir).join(c.filter("granularity = 'meso'").select("chunk_id"), "chunk_id", "left_semi")
    v = fusion.ranked(search.vector_search(meso, query_vector(spark, sf_dir), 50, -1.0).withColumn("source", F.lit("vector")), "source")
    k = fusion.ranked(search.keyword_search(c, "the -under", 50).withColumn("source", F.lit("keyword")), "source")
    return fusion.fuse([v, k.select(v.columns)], limit=20).select("chunk_id", F.round("fused", 9).alias("fused"), F.size("ranks").cast("long").alias("lists"))


@query(with_views("chunks vectors", f"""SELECT chunk_id, {_COS} AS score FROM vectors v JOIN chunks USING (chunk_id) WHERE source_class IN ('primary','contextual') AND granularity IN ('meso','micro') AND {_COS} >= 0.05 ORDER BY score DESC, chunk_id LIMIT 15"""))
def vector_topk_filtered(spark, sf_dir) -> DataFrame:
    c = passages(spark, sf_dir).filter(F.col("source_class").isin("primary", "contextual") & F.col("granularity").isin("meso", "micro")).select("chunk_id")
    return search.vector_search(vectors(spark, sf_dir).join(c, "chunk_id", "left_semi"), query_vector(spark, sf_dir), 15, 0.05)


@query(f"""WITH b AS (SELECT item_id, string_split(trim({_WORDS}), ' ') AS t FROM benchmark), p AS (SELECT item_id, ' '||array_to_string(t[i + 1:i + 8], ' ')||' ' AS p FROM (SELECT item_id, t, unnest(range(greatest(1, len(t) - 7))) AS i FROM b)), d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
  SELECT item_id AS phrase_id, doc_id AS chunk_id, count(*) AS windows FROM p JOIN d ON contains(w, p) GROUP BY ALL""")
def phrase_match(spark, sf_dir) -> DataFrame:
    """Documents that hold any eight words in a row of a benchmark item, and how many such windows."""
    words = F.split(F.trim(search.word_text(F.col("text"))), " ")
    b = load(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    b = b.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 7)), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(8)), " "))).alias("pos", "phrase"))
    found = search.phrase_search(passages(spark, sf_dir), b.select((F.col("item_id") * 1_000_000 + F.col("pos")).alias("phrase_id"), "phrase"))
    return found.groupBy(F.floor(F.col("phrase_id") / 1_000_000).alias("phrase_id"), "chunk_id").agg(F.count(F.lit(1)).alias("windows"))


@query(with_views("vectors", """WITH $ r AS (SELECT chunk_id, label % 3 AS list, row_number() OVER (PARTITION BY label % 3 ORDER BY embedding[1] DESC, chunk_id) AS rank FROM vectors),
  x AS (SELECT chunk_id // 3 AS item, list, min(rank) AS rank FROM r GROUP BY ALL) SELECT item, round(sum([1.0, 0.5, 2.0][list + 1]::DOUBLE / (60 + rank)), 9) AS fused, list_sort(list(list::VARCHAR||':'||rank)) AS ranks FROM x GROUP BY item"""))
def rrf_weighted(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", (F.col("label") % 3).alias("list"), F.element_at("embedding", 1).alias("score"))
    r = fusion.ranked(v, "list").groupBy(F.floor(F.col("chunk_id") / 3).alias("item"), "list").agg(F.min("rank").alias("rank"), F.max("score").alias("score")).withColumn("source", F.col("list").cast("string"))
    lists = [r.filter(F.col("list") == i) for i in range(3)]
    out = fusion.fuse(lists, [1.0, 0.5, 2.0], key="item")
    return out.select("item", F.round("fused", 9).alias("fused"), F.transform("ranks", lambda x: F.concat_ws(":", x["source"], x["rank"].cast("string"))).alias("ranks"))


@query(with_views("vectors edges", f"""WITH $ s AS (SELECT chunk_id, {_COS} AS score FROM vectors v), g AS (SELECT DISTINCT src FROM edges WHERE type = 'THEMATIC_PARALLEL'), h AS (SELECT DISTINCT dst FROM edges WHERE type = 'ENGAGES_WITH' AND confidence = 'high')
  SELECT chunk_id, round(score * CASE WHEN g.src IS NOT NULL THEN 1.5 ELSE 1 END * CASE WHEN h.dst IS NOT NULL THEN 1.3 ELSE 1 END, 4) AS boosted FROM s LEFT JOIN g ON g.src = chunk_id::VARCHAR LEFT JOIN h ON h.dst = chunk_id::VARCHAR"""))
def consensus_boost(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir)
    g = e.filter("type = 'THEMATIC_PARALLEL'").select(F.col("src").cast("long").alias("chunk_id")).distinct().withColumn("g", F.lit(1.5))
    h = e.filter("type = 'ENGAGES_WITH' and confidence = 'high'").select(F.col("dst").cast("long").alias("chunk_id")).distinct().withColumn("h", F.lit(1.3))
    s = vectors(spark, sf_dir).crossJoin(F.broadcast(query_vector(spark, sf_dir))).select("chunk_id", F.round(V.cosine(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    out = s.join(g, "chunk_id", "left").join(h, "chunk_id", "left").select("chunk_id", F.round(F.col("score") * F.coalesce("g", F.lit(1.0)) * F.coalesce("h", F.lit(1.0)), 4).alias("boosted"))
    return out


@query("""WITH RECURSIVE d AS (SELECT doc_id // 50 AS q, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS rn, (doc_id * 7) % 30 AS id, md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS tk, doc_id FROM documents),
  s AS (SELECT q, rn, [id] AS ids, [tk] AS tks, [doc_id] AS kept FROM d WHERE rn = 1 UNION ALL
    SELECT d.q, d.rn, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(tks, tk) ELSE tks END, CASE WHEN ok THEN list_append(kept, doc_id) ELSE kept END
    FROM (SELECT d.*, s.ids, s.tks, s.kept, NOT list_contains(s.ids, d.id) AND NOT list_contains(s.tks, d.tk) AS ok FROM s JOIN d ON d.q = s.q AND d.rn = s.rn + 1) d)
  SELECT q, unnest(kept) AS doc_id FROM (SELECT q, arg_max(kept, rn) AS kept FROM s GROUP BY q)""")
def find_quotes_dedup(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("q"), F.col("doc_id").alias("arrival"), (F.col("doc_id") * 7 % 30).alias("id"), F.md5(fingerprint(F.col("text"))).alias("text_key"))
    return fusion.keep_first_by_id_and_text(d, "q").select("q", F.col("arrival").alias("doc_id"))


@query(with_views("works chunks vectors edges", f"""WITH $ s AS (SELECT chunk_id, max(score) AS score FROM (SELECT chunk_id, {_COS} AS score FROM vectors v UNION ALL SELECT doc_id, 0.01 FROM documents WHERE contains(lower(text), ' the ')) GROUP BY chunk_id)
  SELECT s.chunk_id, score, w.title, CASE c.source_class WHEN 'primary' THEN 'quote as the author' WHEN 'personal' THEN 'quote as the reader' ELSE 'attribute to the critic' END AS provenance
  FROM s JOIN chunks c USING (chunk_id) JOIN works w USING (work_id) WHERE c.source_class IN ('primary','secondary') AND list_has_any(w.genre_tags, ['essay','fiction']) AND EXISTS (SELECT 1 FROM edges e WHERE e.src = s.chunk_id::VARCHAR AND e.type = 'EXPLORES_THEME' AND e.dst IN ('theme-1','theme-2','quality-1')) ORDER BY score DESC, s.chunk_id LIMIT 20"""))
def search_chunks_faceted(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).crossJoin(F.broadcast(query_vector(spark, sf_dir))).select("chunk_id", F.round(V.cosine(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    k = load(spark, sf_dir, "documents").filter(F.lower("text").contains(" the ")).select(F.col("doc_id").alias("chunk_id"), F.lit(0.01).alias("score"))
    themed = edges(spark, sf_dir).filter((F.col("type") == "EXPLORES_THEME") & F.col("dst").isin("theme-1", "theme-2", "quality-1")).select(F.col("src").cast("long").alias("chunk_id"))
    c = chunks(spark, sf_dir).filter(F.col("source_class").isin("primary", "secondary")).select("chunk_id", "work_id", "source_class")
    w = works(spark, sf_dir).filter(F.arrays_overlap("genre_tags", F.array(F.lit("essay"), F.lit("fiction")))).select("work_id", "title")
    s = v.unionByName(k).groupBy("chunk_id").agg(F.max("score").alias("score"))
    provenance = F.when(F.col("source_class") == "primary", "quote as the author").when(F.col("source_class") == "personal", "quote as the reader").otherwise("attribute to the critic")
    found = s.join(c, "chunk_id").join(w, "work_id").join(themed, "chunk_id", "left_semi")
    return found.select("chunk_id", "score", "title", provenance.alias("provenance")).orderBy(F.desc("score"), "chunk_id").limit(20)


@query("""WITH RECURSIVE c AS (SELECT doc_id // 40 AS q, doc_id % 3 AS section, doc_id AS id, greatest(1, n_chars // 4)::BIGINT AS cost, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id % 3, doc_id) AS rn FROM documents),
  s AS (SELECT q, 0::BIGINT AS rn, 0::BIGINT AS used, -1::BIGINT AS closed, []::BIGINT[] AS ids FROM (SELECT DISTINCT q FROM c) UNION ALL
    SELECT q, rn, CASE WHEN fits THEN used + cost ELSE used END, CASE WHEN closed = section OR fits THEN closed ELSE section END, CASE WHEN fits THEN list_append(ids, id) ELSE ids END
    FROM (SELECT c.q, c.rn, s.used, s.closed, s.ids, c.cost, c.section, c.id, s.closed <> c.section AND s.used + c.cost <= 12000 AS fits FROM s JOIN c ON c.q = s.q AND c.rn = s.rn + 1))
  SELECT q, arg_max(used, rn) AS used, arg_max(ids, rn) AS ids FROM s GROUP BY q""")
def context_budget(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 40).alias("q"), (F.col("doc_id") % 3).alias("section"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("cost"))
    return fusion.within_budget(d, "q", 12000)


@query(with_views("chunks vectors", """WITH $ s AS (SELECT label AS q, chunk_id AS id, source_class, round(embedding[2], 6) AS score FROM vectors JOIN chunks USING (chunk_id)),
  r AS (SELECT *, source_class = 'personal' AND row_number() OVER (PARTITION BY q, source_class = 'personal' ORDER BY score DESC, id) <= 2 AS reserved FROM s)
  SELECT q, id, reserved FROM r QUALIFY row_number() OVER (PARTITION BY q ORDER BY reserved DESC, score DESC, id) <= 6"""))
def blend_personal(spark, sf_dir) -> DataFrame:
    s = vectors(spark, sf_dir).join(passages(spark, sf_dir).select("chunk_id", "source_class"), "chunk_id").select(F.col("label").alias("q"), F.col("chunk_id").alias("id"), "source_class", F.round(F.element_at("embedding", 2), 6).alias("score"))
    return fusion.blended(s, 6, 2, "q").select("q", "id", "reserved")


@query(with_views("works chunks", """SELECT work_id, chunk_id, n_chars FROM chunks WHERE granularity = 'macro' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY position) <= 3"""))
def work_detail(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).filter("granularity = 'macro'").select("work_id", "chunk_id", "n_chars", "position")
    return fusion.top_per_group(c, ["work_id"], ["position"], 3).drop("position")


@query(with_views("chunks", """WITH $ a AS (SELECT work_id, chapter, chunk_id, row_number() OVER (PARTITION BY work_id, chapter ORDER BY md5(chunk_id::VARCHAR), chunk_id) AS r1 FROM chunks WHERE source_class = 'primary'), b AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY r1, md5(chunk_id::VARCHAR), chunk_id) AS r2 FROM a) SELECT work_id, chunk_id FROM b WHERE r2 <= 5"""))
def diverse_sample(spark, sf_dir) -> DataFrame:
    # Chapters first, then the rest, by a hash in place of chance.
    c = chunks(spark, sf_dir).filter("source_class = 'primary'").select("work_id", "chapter", "chunk_id").withColumn("h", F.md5(F.col("chunk_id").cast("string")))
    a = c.withColumn("r1", F.row_number().over(Window.partitionBy("work_id", "chapter").orderBy("h", "chunk_id")))
    return fusion.top_per_group(a, ["work_id"], ["r1", "h", "chunk_id"], 5).select("work_id", "chunk_id")


@query(with_views("chunks vectors", f"""WITH $ seeds AS (SELECT chunk_id FROM (SELECT chunk_id, {_COS} AS s FROM vectors v) ORDER BY s DESC, chunk_id LIMIT 10) SELECT chunk_id, {_COS} AS score FROM vectors v JOIN chunks USING (chunk_id) WHERE granularity = 'micro' AND chunk_id NOT IN (SELECT chunk_id FROM seeds) ORDER BY score DESC, chunk_id LIMIT 10"""))
def supporting_evidence(spark, sf_dir) -> DataFrame:
    v, q = vectors(spark, sf_dir), query_vector(spark, sf_dir)
    seeds = search.vector_search(v, q, 10, -1.0).select("chunk_id")
    micro = passages(spark, sf_dir).filter("granularity = 'micro'").select("chunk_id")
    return search.vector_search(v.join(micro, "chunk_id", "left_semi").join(seeds, "chunk_id", "left_anti"), q, 10, -1.0)


@query("""SELECT doc_id // 100 AS lst, doc_id, md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS fp FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 100, md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) ORDER BY n_chars DESC, doc_id) = 1""")
def keep_best_per_text(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("lst"), "doc_id", F.md5(fingerprint(F.col("text"))).alias("fp"), "n_chars")
    return fusion.top_per_group(d, ["lst", "fp"], [F.desc("n_chars"), "doc_id"], 1).drop("n_chars")
