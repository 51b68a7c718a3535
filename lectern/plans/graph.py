"""Graph queries and mutations, and the linkers of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion
from ..operators import graph as G
from ..operators.overlaps import top_shared
from ..operators.search import similar_within
from ..schema import STOP_WORDS
from ..tables import chunks, edges, load, vectors, with_views, works
from .registry import query


def of_type(spark, sf_dir, *types: str) -> DataFrame:
    return edges(spark, sf_dir).filter(F.col("type").isin(*types))


def owners(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("src"), F.col("work_id").alias("owner"))


@query(with_views("chunks edges", """SELECT dst AS theme, src AS chunk, work_id FROM edges JOIN chunks ON src = chunk_id::VARCHAR WHERE type = 'EXPLORES_THEME' QUALIFY row_number() OVER (PARTITION BY dst ORDER BY chunk_id) <= 20"""))
def theme_subgraph_top_n(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "EXPLORES_THEME").select(F.col("dst").alias("theme"), F.col("src").alias("chunk"))
    c = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk"), "work_id", "chunk_id")
    return fusion.top_per_group(e.join(c, "chunk"), ["theme"], ["chunk_id"], 20).select("theme", "chunk", "work_id")


@query(with_views("edges", """SELECT src AS node, dst AS other, link_type FROM edges WHERE type = 'ENGAGES_WITH' AND confidence <> 'low' UNION ALL SELECT dst, src, link_type FROM edges WHERE type = 'ENGAGES_WITH' AND confidence <> 'low'"""))
def linked_either_way(spark, sf_dir) -> DataFrame:
    return G.undirected(of_type(spark, sf_dir, "ENGAGES_WITH").filter("confidence <> 'low'")).select(F.col("src").alias("node"), F.col("dst").alias("other"), "link_type")


@query(with_views("edges", """WITH $ e AS (SELECT src, dst, link_type, confidence FROM edges WHERE type IN ('ENGAGES_WITH','THEMATIC_PARALLEL')),
  p AS (SELECT src AS seed, dst AS node, link_type, confidence, 1 AS hops, [src||'>'||dst] AS used FROM e UNION ALL
    SELECT p.seed, e.dst, p.link_type, p.confidence, hops + 1, list_append(used, e.src||'>'||e.dst) FROM p JOIN e ON p.node = e.src WHERE hops < 3 AND NOT list_contains(used, e.src||'>'||e.dst))
  SELECT seed, node, link_type, confidence, hops FROM p""", recursive=True))
def engagement_paths(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "ENGAGES_WITH", "THEMATIC_PARALLEL")
    seeds = e.select(F.col("src").alias("node")).distinct()
    return G.paths(e, seeds, 3)


@query(with_views("chunks edges", """SELECT m.dst AS argument, t.dst AS theme, count(DISTINCT m.src) AS passages, min(m.src::INT) AS first FROM edges m JOIN edges t ON t.src = m.src AND t.type = 'EXPLORES_THEME' WHERE m.type = 'MAKES_ARGUMENT' GROUP BY ALL"""))
def theme_arguments(spark, sf_dir) -> DataFrame:
    m = of_type(spark, sf_dir, "MAKES_ARGUMENT").select("src", F.col("dst").alias("argument"))
    t = of_type(spark, sf_dir, "EXPLORES_THEME").select("src", F.col("dst").alias("theme"))
    return m.join(t, "src").groupBy("argument", "theme").agg(F.countDistinct("src").alias("passages"), F.min(F.col("src").cast("int")).alias("first"))


@query(with_views("edges", """SELECT DISTINCT d.src AS later, d.dst AS earlier, t.dst AS theme FROM edges d JOIN edges m ON m.dst = d.src AND m.type = 'MAKES_ARGUMENT' JOIN edges t ON t.src = m.src AND t.type = 'EXPLORES_THEME' WHERE d.type = 'DEVELOPS_FROM'"""))
def argument_evolution(spark, sf_dir) -> DataFrame:
    d = of_type(spark, sf_dir, "DEVELOPS_FROM").select(F.col("src").alias("later"), F.col("dst").alias("earlier"))
    m = of_type(spark, sf_dir, "MAKES_ARGUMENT").select("src", F.col("dst").alias("later"))
    t = of_type(spark, sf_dir, "EXPLORES_THEME").select("src", F.col("dst").alias("theme"))
    return d.join(m, "later").join(t, "src").select("later", "earlier", "theme").distinct()


_ENTITIES = "type IN ('MAKES_ARGUMENT','CONCEPT_USED_IN','REFERENCES_PERSON')"


@query(with_views("chunks edges", f"""WITH $ e AS (SELECT DISTINCT src, dst, type, work_id FROM edges JOIN chunks ON src = chunk_id::VARCHAR WHERE {_ENTITIES}),
  p AS (SELECT x.src AS a, y.src AS b, count(DISTINCT x.dst) AS shared, list_sort(list(DISTINCT x.dst)) AS targets FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src AND x.work_id <> y.work_id GROUP BY ALL HAVING count(DISTINCT x.dst) >= 2)
  SELECT *, CASE WHEN shared >= 5 THEN 'high' WHEN shared >= 3 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN shared >= 5 THEN 0.95 WHEN shared >= 3 THEN 0.75 ELSE 0.5 END::DOUBLE AS score FROM p ORDER BY shared DESC, a, b LIMIT 100"""))
def entity_overlap_pairs(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "MAKES_ARGUMENT", "CONCEPT_USED_IN", "REFERENCES_PERSON").select("src", "type", "dst")
    pairs = top_shared(e, owners(spark, sf_dir), 100)
    tier, score = G.overlap_tier(F.col("shared"))
    return pairs.withColumns({"tier": tier, "score": score})


@query(with_views("chunks edges", """SELECT c.work_id, d.work_id AS other_work, type, count(*) AS links FROM edges e JOIN chunks c ON e.src = c.chunk_id::VARCHAR JOIN chunks d ON e.dst = d.chunk_id::VARCHAR WHERE type IN ('ENGAGES_WITH','THEMATIC_PARALLEL') AND c.work_id <> d.work_id GROUP BY ALL"""))
def cross_work_links(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "ENGAGES_WITH", "THEMATIC_PARALLEL").select("src", "dst", "type")
    o = owners(spark, sf_dir)
    joined = e.join(o.withColumnRenamed("owner", "work_id"), "src").join(o.select(F.col("src").alias("dst"), F.col("owner").alias("other_work")), "dst")
    return joined.filter("work_id <> other_work").groupBy("work_id", "other_work", "type").agg(F.count(F.lit(1)).alias("links"))


@query(with_views("chunks edges", """SELECT 'author-'||split_part(split_part(work_id, '--', 1), '-', 2) AS author, dst AS entity, count(DISTINCT src) AS passages FROM edges JOIN chunks ON src = chunk_id::VARCHAR WHERE type IN ('REFERENCES_PERSON','EXPLORES_THEME') GROUP BY ALL"""))
def author_network(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "REFERENCES_PERSON", "EXPLORES_THEME").select("src", F.col("dst").alias("entity"))
    return e.join(owners(spark, sf_dir), "src").groupBy(F.split_part("owner", F.lit("--"), F.lit(1)).alias("author"), "entity").agg(F.countDistinct("src").alias("passages"))


@query(with_views("chunks edges", """SELECT e.dst AS theme, chunk_id, day FROM edges e JOIN chunks ON e.src = chunk_id::VARCHAR WHERE type = 'USER_REFLECTS_ON' QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY day DESC, chunk_id) <= 20"""))
def reflections_of_theme(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "USER_REFLECTS_ON").select(F.col("src").cast("long").alias("chunk_id"), F.col("dst").alias("theme"))
    return fusion.top_per_group(e.join(chunks(spark, sf_dir).select("chunk_id", "day"), "chunk_id"), ["theme"], [F.desc("day"), "chunk_id"], 20).select("theme", "chunk_id", "day")


@query(with_views("edges", """WITH $ d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT node AS key, degree FROM d WHERE degree <= 2"""))
def orphan_entities(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).select("src", "dst")
    nodes = G.degrees(e).select(F.col("node").alias("key"))
    return G.orphans(e, nodes, 2)


@query(with_views("edges", """WITH $ k AS (SELECT src, dst, type FROM edges WHERE type = 'ENGAGES_WITH'), n AS (SELECT src, dst, type, link_type||'!' AS link_type FROM edges WHERE type = 'ENGAGES_WITH' AND confidence = 'high' UNION ALL SELECT src, 'new-'||dst, type, 'new' FROM edges WHERE type = 'ENGAGES_WITH' AND confidence = 'low')
  SELECT src, type, dst, link_type FROM n UNION ALL SELECT src, type, dst, link_type FROM edges e WHERE type = 'ENGAGES_WITH' AND NOT EXISTS (SELECT 1 FROM n WHERE n.src = e.src AND n.dst = e.dst)"""))
def edge_upsert(spark, sf_dir) -> DataFrame:
    e = of_type(spark, sf_dir, "ENGAGES_WITH").select("src", "type", "dst", "link_type", "confidence")
    changed = e.filter("confidence = 'high'").withColumn("link_type", F.concat("link_type", F.lit("!")))
    added = e.filter("confidence = 'low'").withColumns({"dst": F.concat(F.lit("new-"), "dst"), "link_type": F.lit("new")})
    return G.upsert(e.drop("confidence"), changed.unionByName(added).drop("confidence"), ["src", "type", "dst"])


@query(with_views("chunks edges", """SELECT src, dst FROM edges WHERE type = 'ENGAGES_WITH' AND src IN (SELECT chunk_id::VARCHAR FROM chunks WHERE source_class <> 'tertiary') AND dst IN (SELECT chunk_id::VARCHAR FROM chunks WHERE source_class <> 'tertiary')"""))
def edges_with_both_ends(spark, sf_dir) -> DataFrame:
    nodes = chunks(spark, sf_dir).filter("source_class <> 'tertiary'").select(F.col("chunk_id").cast("string").alias("key"))
    return G.with_both_ends(of_type(spark, sf_dir, "ENGAGES_WITH").select("src", "dst"), nodes).select("src", "dst")


@query(with_views("edges", """SELECT DISTINCT src, type, CASE WHEN dst IN ('theme-3','theme-4') THEN 'theme-2' ELSE dst END AS dst FROM edges WHERE type = 'EXPLORES_THEME'"""))
def theme_merge(spark, sf_dir) -> DataFrame:
    mapping = spark.createDataFrame([("theme-3", "theme-2"), ("theme-4", "theme-2")], "old string, new string")
    return G.merge_nodes(of_type(spark, sf_dir, "EXPLORES_THEME"), F.broadcast(mapping))


@query(with_views("edges chunks", """SELECT type, count(*) AS left_over FROM edges WHERE src NOT IN (SELECT chunk_id::VARCHAR FROM chunks WHERE ends_with(work_id, '--src1')) AND dst NOT IN (SELECT chunk_id::VARCHAR FROM chunks WHERE ends_with(work_id, '--src1')) GROUP BY type"""))
def delete_work_from_graph(spark, sf_dir) -> DataFrame:
    gone = chunks(spark, sf_dir).filter(F.col("work_id").endswith("--src1")).select(F.col("chunk_id").cast("string").alias("key"))
    return G.delete_nodes(edges(spark, sf_dir), gone).groupBy("type").agg(F.count(F.lit(1)).alias("left_over"))


@query(with_views("vectors edges", """WITH $ d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node),
  r AS (SELECT chunk_id::VARCHAR AS item, embedding, label, row_number() OVER (ORDER BY -coalesce(degree, 0), chunk_id::VARCHAR) AS rn FROM vectors LEFT JOIN d ON node = chunk_id::VARCHAR),
  near AS (SELECT x.rn, list(y.rn) AS smaller FROM r x JOIN r y ON x.label = y.label AND y.rn < x.rn WHERE round(list_cosine_similarity(x.embedding, y.embedding), 6) >= 0.85 GROUP BY x.rn),
  l AS (SELECT r.rn, coalesce(smaller, []) AS smaller FROM r LEFT JOIN near USING (rn)),
  s AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS heads, NULL::BIGINT AS rep UNION ALL
    SELECT l.rn, CASE WHEN len(list_intersect(l.smaller, s.heads)) = 0 THEN list_append(s.heads, l.rn) ELSE s.heads END, coalesce(list_min(list_intersect(l.smaller, s.heads)), l.rn) FROM s JOIN l ON l.rn = s.rn + 1)
  SELECT r.item, q.item AS representative FROM s JOIN r USING (rn) JOIN r q ON q.rn = s.rep""", recursive=True))
def theme_dedup(spark, sf_dir) -> DataFrame:
    """Concepts of all vectors of each label, clustered by cosine in order of degree."""
    v = vectors(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("id"), "embedding", F.col("label").alias("group"))
    d = G.degrees(edges(spark, sf_dir)).withColumnRenamed("node", "item")
    ranked = v.select(F.col("id").alias("item")).join(d, "item", "left").select("item", F.struct((-F.coalesce("degree", F.lit(0))).alias("degree"), "item").alias("rank"))
    return G.greedy_clusters(ranked, similar_within(v, v, 0.85).select("a", "b"), spark)


@query(with_views("chunks vectors edges", """WITH $ t AS (SELECT DISTINCT src::BIGINT AS chunk_id, dst FROM edges WHERE type = 'EXPLORES_THEME'), p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, list_sort(list(x.dst)) AS themes FROM t x JOIN chunks c ON c.chunk_id = x.chunk_id AND c.source_class = 'primary' JOIN t y ON x.dst = y.dst JOIN chunks d ON d.chunk_id = y.chunk_id AND d.source_class = 'contextual' GROUP BY ALL),
  s AS (SELECT a, b, themes, round(list_cosine_similarity(v.embedding, w.embedding), 6) AS score FROM p JOIN vectors v ON v.chunk_id = a JOIN vectors w ON w.chunk_id = b)
  SELECT a, b, themes, score FROM s WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE type = 'ENGAGES_WITH' AND ((e.src = a::VARCHAR AND e.dst = b::VARCHAR) OR (e.src = b::VARCHAR AND e.dst = a::VARCHAR)))"""))
def thematic_parallel(spark, sf_dir) -> DataFrame:
    t = of_type(spark, sf_dir, "EXPLORES_THEME").select(F.col("src").cast("long").alias("chunk_id"), "dst").distinct()
    c = chunks(spark, sf_dir).select("chunk_id", "source_class")

    def side(kind: str, name: str) -> DataFrame:
        return t.join(c.filter(F.col("source_class") == kind), "chunk_id").select(F.col("chunk_id").alias(name), "dst")

    v = vectors(spark, sf_dir).select("chunk_id", "embedding")
    one, two = (side(kind, "chunk_id").join(v, "chunk_id").select(F.col("chunk_id").alias("id"), "embedding", F.col("dst").alias("group")) for kind in ("primary", "contextual"))
    scored = similar_within(one, two, 0.3).groupBy("a", "b").agg(F.array_sort(F.collect_set("group")).alias("themes"), F.max("score").alias("score"))
    links = of_type(spark, sf_dir, "ENGAGES_WITH").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return G.without_linked(scored, links)


_TERMS = r"list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g'), '\b([a-z][a-z-]*[a-z])\b', 1)), lambda x: length(x) >= 4 AND NOT list_contains([" + ",".join(f"'{w}'" for w in STOP_WORDS) + "], x))"


@query(with_views("chunks", f"""WITH $ c AS (SELECT chunk_id, work_id, source_class, unnest({_TERMS}) AS term FROM chunks WHERE source_class IN ('primary','contextual')),
  n AS (SELECT count(DISTINCT work_id) AS n FROM chunks WHERE source_class = 'contextual'), f AS (SELECT term, 1 - count(DISTINCT work_id) / n.n AS weight FROM c, n WHERE source_class = 'contextual' GROUP BY term, n.n HAVING count(DISTINCT work_id) * 2 <= n.n),
  k AS (SELECT DISTINCT c.work_id, f.term, weight FROM c JOIN f USING (term) WHERE source_class = 'contextual'),
  m AS (SELECT p.chunk_id, k.work_id, count(DISTINCT p.term) AS shared, round(sum(weight), 6) AS score FROM c p JOIN k USING (term) WHERE p.source_class = 'primary' GROUP BY ALL HAVING count(DISTINCT p.term) >= 2)
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY shared DESC, score DESC, work_id) = 1"""))
def implicit_engagement(spark, sf_dir) -> DataFrame:
    """Primary passages and the contextual work whose distinctive terms they share most."""
    c = chunks(spark, sf_dir).filter(F.col("source_class").isin("primary", "contextual"))
    each = c.select("chunk_id", "work_id", "source_class", F.explode(T.terms(F.col("text"))).alias("term"))
    context = each.filter("source_class = 'contextual'").select("work_id", "term").distinct()
    n = c.filter("source_class = 'contextual'").agg(F.countDistinct("work_id").alias("n"))
    weights = context.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).filter(F.col("df") * 2 <= F.col("n")).select("term", (1 - F.col("df") / F.col("n")).alias("weight"))
    prints = context.join(weights, "term")
    shared = each.filter("source_class = 'primary'").select("chunk_id", "term").join(prints, "term").groupBy("chunk_id", "work_id").agg(F.count(F.lit(1)).alias("shared"), F.round(F.sum("weight"), 6).alias("score")).filter("shared >= 2")
    return fusion.top_per_group(shared, ["chunk_id"], [F.desc("shared"), F.desc("score"), "work_id"], 1)


_CITED = " UNION ALL ".join(f"SELECT chunk_id, work_id, '{form}' AS form, unnest(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM s" for form, p in T.CITATIONS)


@query(with_views("works chunks", rf"""WITH $ s AS (SELECT chunk_id, work_id, regexp_replace(text, '[^\x00-\x7F—–]', '_', 'g') AS t FROM chunks WHERE source_class = 'secondary'), n AS (SELECT chunk_id, work_id, form, lower(regexp_extract(name, '([A-Z][a-z]+)$', 1)) AS last FROM ({_CITED})),
  k AS (SELECT work_id, lower(split_part(author, '-', 2)) AS last FROM works UNION SELECT work_id, lower(title) FROM works)
  SELECT DISTINCT n.chunk_id, n.form, n.last, k.work_id FROM n LEFT JOIN k ON k.last = n.last AND k.work_id <> n.work_id"""))
def explicit_citations(spark, sf_dir) -> DataFrame:
    """Citations in the text of secondary passages, and the works their last names lead to, if any."""
    c = chunks(spark, sf_dir).filter("source_class = 'secondary'").select("chunk_id", "work_id", F.regexp_replace("text", r"[^\x00-\x7F—–]", "_").alias("t"))
    found = F.array(*[F.struct(F.lit(form).alias("form"), F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias("names")) for form, p in T.CITATIONS])
    each = c.select("chunk_id", "work_id", F.explode(found).alias("x")).select("chunk_id", F.col("work_id").alias("own"), "x.form", F.explode("x.names").alias("name"))
    named = each.select("chunk_id", "own", "form", F.lower(F.regexp_extract("name", r"([A-Z][a-z]+)$", 1)).alias("last"))
    w = works(spark, sf_dir)
    keys = w.select("work_id", F.lower(F.split_part("author", F.lit("-"), F.lit(2))).alias("key")).union(w.select("work_id", F.lower("title"))).distinct()
    return named.join(keys, (F.col("key") == F.col("last")) & (F.col("own") != F.col("work_id")), "left").select("chunk_id", "form", "last", "work_id").distinct()


@query(with_views("chunks edges", """SELECT chunk_id, 'EXPLORES_THEME' AS missing FROM chunks WHERE granularity IN ('meso','macro') AND section_type NOT IN ('index','bibliography') AND chunk_id::VARCHAR NOT IN (SELECT src FROM edges WHERE type = 'EXPLORES_THEME') UNION ALL SELECT chunk_id, 'node' FROM chunks WHERE chunk_id::VARCHAR NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)"""))
def backfill_plan(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", "granularity", "section_type")
    themed = of_type(spark, sf_dir, "EXPLORES_THEME").select(F.col("src").cast("long").alias("chunk_id"))
    known = G.degrees(edges(spark, sf_dir)).select(F.col("node").try_cast("long").alias("chunk_id"))
    wanted = c.filter(F.col("granularity").isin("meso", "macro") & ~F.col("section_type").isin("index", "bibliography")).join(themed, "chunk_id", "left_anti")
    return wanted.select("chunk_id", F.lit("EXPLORES_THEME").alias("missing")).unionByName(c.join(known, "chunk_id", "left_anti").select("chunk_id", F.lit("node").alias("missing")))


@query(with_views("works chunks", """SELECT 'works' AS tbl, replace(work_id, '--src1', '--renamed') AS work_id, count(*) AS n FROM works WHERE ends_with(work_id, '--src1') GROUP BY ALL UNION ALL SELECT 'chunks', replace(work_id, '--src1', '--renamed'), count(*) FROM chunks WHERE ends_with(work_id, '--src1') GROUP BY ALL"""))
def rename_work(spark, sf_dir) -> DataFrame:
    renamed = F.when(F.col("work_id").endswith("--src1"), F.replace("work_id", F.lit("--src1"), F.lit("--renamed"))).otherwise(F.col("work_id"))
    parts = [f.select(F.lit(name).alias("tbl"), renamed.alias("work_id")) for name, f in (("works", works(spark, sf_dir)), ("chunks", chunks(spark, sf_dir)))]
    return parts[0].unionByName(parts[1]).filter(F.col("work_id").endswith("--renamed")).groupBy("tbl", "work_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT label, count(*) AS vectors, round(avg(embedding[1]), 5) AS mean_first FROM embeddings GROUP BY label""")
def label_profile(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(F.element_at("embedding", 1).cast("double")), 5).alias("mean_first"))
