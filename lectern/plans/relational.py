"""Filters, joins, aggregates, orders and set operations over works, passages and the graph."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENTITY_EDGES
from ..tables import chunks, edges, load, vectors, with_views, works
from .registry import query


def all_of(*conditions: Column | None) -> Column:
    """The optional predicates that are given, joined by and; true without any."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_in(column: str, values: list[str]) -> Column | None:
    """A facet: overlap with the values, no condition if there are none."""
    return F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])) if values else None


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)


# ---- filters and projections

@query(with_views("works", """SELECT work_id, source_class, publication_year FROM works WHERE list_has_any(genre_tags, ['poetry','essay']) AND source_class IN ('primary','personal','contextual') AND publication_year >= 1902"""))
def works_by_facets(spark, sf_dir) -> DataFrame:
    wanted = all_of(any_in("genre_tags", ["poetry", "essay"]), any_in("genre_tags", []), F.col("source_class").isin("primary", "personal", "contextual"), F.col("publication_year") >= 1902, None)
    return works(spark, sf_dir).filter(wanted).select("work_id", "source_class", "publication_year")


@query(with_views("works", """SELECT work_id, publication_year, title FROM works WHERE json_extract_string(source_metadata, '$.slug') = 'author-en' OR lower(author) = 'author-fr' ORDER BY publication_year NULLS LAST, title"""))
def works_of_author(spark, sf_dir) -> DataFrame:
    w = works(spark, sf_dir).filter((F.get_json_object("source_metadata", "$.slug") == "author-en") | F.col("author").ilike("AUTHOR-FR"))
    return w.select("work_id", "publication_year", "title").orderBy(F.col("publication_year").asc_nulls_last(), "title")


@query(with_views("works", """SELECT work_id, json_extract_string(source_metadata, '$.classification_confidence')::DOUBLE AS confidence FROM works WHERE json_extract_string(source_metadata, '$.classification_confidence')::DOUBLE < 0.9"""))
def uncertain_works(spark, sf_dir) -> DataFrame:
    c = F.get_json_object("source_metadata", "$.classification_confidence").cast("double")
    return works(spark, sf_dir).filter(c.isNotNull() & (c < 0.9)).select("work_id", c.alias("confidence"))


_NOISE = "(granularity IN ('micro','nano') AND section_type IN ('index','bibliography')) OR length(text) < 50"


@query(with_views("chunks", f"SELECT chunk_id, granularity, section_type FROM chunks WHERE {_NOISE}"))
def noise_chunks(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).filter(is_noise()).select("chunk_id", "granularity", "section_type")


def is_noise() -> Column:
    return (F.col("granularity").isin("micro", "nano") & F.col("section_type").isin("index", "bibliography")) | (F.length("text") < 50)


@query(with_views("chunks", "SELECT chunk_id, granularity FROM chunks WHERE granularity IN ('macro','meso') OR length(trim(text, ' ' || chr(10) || chr(13) || chr(9))) >= 50"))
def min_size_filter(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).filter(F.col("granularity").isin("macro", "meso") | (F.length(F.trim("text", F.lit(" \n\r\t"))) >= 50)).select("chunk_id", "granularity")


@query(with_views("chunks", """SELECT work_id, count(*) FILTER (section_type IN ('chapter','preface','back_matter')) AS content, count(*) FILTER (section_type IN ('index','bibliography')) AS routable,
  count(*) FILTER (granularity IN ('meso','micro') AND section_type NOT IN ('toc','index','bibliography','front_matter')) AS extractable, count(*) FILTER (source_class = 'primary' AND granularity = 'meso' AND section_type IN ('chapter','back_matter')) AS voice FROM chunks GROUP BY work_id"""))
def section_split(spark, sf_dir) -> DataFrame:
    s, g = F.col("section_type"), F.col("granularity")
    return chunks(spark, sf_dir).groupBy("work_id").agg(
        F.count_if(s.isin("chapter", "preface", "back_matter")).alias("content"), F.count_if(s.isin("index", "bibliography")).alias("routable"),
        F.count_if(g.isin("meso", "micro") & ~s.isin("toc", "index", "bibliography", "front_matter")).alias("extractable"),
        F.count_if((F.col("source_class") == "primary") & (g == "meso") & s.isin("chapter", "back_matter")).alias("voice"))


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' AND user_id IN (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events))")
def dated_reflections(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    speakers = e.join(F.broadcast(first), F.col("event_type") == F.col("first")).select("user_id").distinct()
    days = F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-07").cast("timestamp_ntz"))
    return e.filter(days).join(speakers, "user_id", "left_semi").select("event_id", "ts")


@query(with_views("works", """SELECT work_id, 'dated' AS part, publication_year AS year FROM works WHERE publication_year IS NOT NULL AND source_class = 'primary' UNION ALL SELECT work_id, 'undated', NULL FROM works WHERE publication_year IS NULL"""))
def work_chronology(spark, sf_dir) -> DataFrame:
    w = works(spark, sf_dir)
    dated = w.filter("publication_year is not null and source_class = 'primary'").select("work_id", F.lit("dated").alias("part"), F.col("publication_year").alias("year"))
    return dated.unionByName(w.filter("publication_year is null").select("work_id", F.lit("undated").alias("part"), F.lit(None).cast("int").alias("year")))


@query(with_views("works", """SELECT work_id, list_filter([CASE WHEN publication_year IS NULL AND source_class = 'primary' THEN 'primary needs a year' END, CASE WHEN len(genre_tags) < 2 THEN 'few tags' END, CASE WHEN n_docs < 3 THEN 'too small' END], lambda x: x IS NOT NULL) AS broken
  FROM works WHERE (publication_year IS NULL AND source_class = 'primary') OR len(genre_tags) < 2 OR n_docs < 3"""))
def row_validation(spark, sf_dir) -> DataFrame:
    rules = (("primary needs a year", F.col("publication_year").isNull() & (F.col("source_class") == "primary")), ("few tags", F.size("genre_tags") < 2), ("too small", F.col("n_docs") < 3))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return works(spark, sf_dir).withColumn("broken", broken).filter(F.size("broken") > 0).select("work_id", "broken")


@query(with_views("works", "SELECT heading, count(*) AS works FROM (SELECT unnest(genre_tags) AS heading FROM works) WHERE lower(heading) NOT IN ('essay','fiction') GROUP BY heading"))
def vocabulary_gaps(spark, sf_dir) -> DataFrame:
    known = spark.createDataFrame([("Essay",), ("fiction",)], "term string").select(F.lower("term").alias("key"))
    each = works(spark, sf_dir).select(F.explode("genre_tags").alias("heading")).withColumn("key", F.lower("heading"))
    return each.join(F.broadcast(known), "key", "left_anti").groupBy("heading").agg(F.count(F.lit(1)).alias("works"))


@query(with_views("works", "SELECT work_id, author FROM works WHERE source_class <> 'primary' AND lower(author) = lower('Author-'||CASE WHEN num % 2 = 0 THEN substr(author, 8) ELSE 'zz' END)"))
def classification_anomalies(spark, sf_dir) -> DataFrame:
    subject = F.concat(F.lit("Author-"), F.when(F.col("num") % 2 == 0, F.substring("author", 8, 99)).otherwise("zz"))
    return works(spark, sf_dir).filter((F.col("source_class") != "primary") & (F.lower("author") == F.lower(subject))).select("work_id", "author")


# ---- joins

@query(with_views("chunks vectors", """SELECT w.author, c.granularity, count(*) AS n, count(DISTINCT v.label) AS labels FROM vectors v JOIN chunks c USING (chunk_id) JOIN (SELECT DISTINCT work_id, split_part(work_id, '--', 1) AS author FROM chunks) w USING (work_id) GROUP BY ALL"""))
def embedded_by_author(spark, sf_dir) -> DataFrame:
    w = works(spark, sf_dir).select("work_id", "author")
    joined = vectors(spark, sf_dir).select("chunk_id", "label").join(chunks(spark, sf_dir).select("chunk_id", "work_id", "granularity"), "chunk_id").join(w, "work_id")
    return joined.groupBy("author", "granularity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


@query(with_views("works chunks vectors", """SELECT w.work_id, count(DISTINCT c.chunk_id) AS chunks, count(DISTINCT v.chunk_id) AS embedded, count(c.chunk_id) AS chunks_compat,
  CASE WHEN count(DISTINCT c.chunk_id) > 0 THEN round(100.0 * count(DISTINCT v.chunk_id) / count(DISTINCT c.chunk_id), 1) ELSE 0 END AS coverage
  FROM works w LEFT JOIN chunks c ON c.work_id = w.work_id AND c.granularity <> 'nano' LEFT JOIN (SELECT chunk_id, 1 AS provider FROM vectors UNION ALL SELECT chunk_id, 2 FROM vectors) v ON v.chunk_id = c.chunk_id GROUP BY w.work_id"""))
def per_work_embedding_coverage(spark, sf_dir) -> DataFrame:
    # Both sides are summed to one row a passage before they meet, so providers multiply no rows.
    v = vectors(spark, sf_dir).select("chunk_id")
    providers = v.union(v).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("providers"))
    c = chunks(spark, sf_dir).filter("granularity <> 'nano'").select("chunk_id", "work_id").join(providers, "chunk_id", "left")
    sums = c.groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("providers").alias("embedded"), F.sum(F.coalesce("providers", F.lit(1))).alias("chunks_compat"))
    out = works(spark, sf_dir).select("work_id").join(sums, "work_id", "left").fillna(0)
    return out.withColumn("coverage", percent(F.col("embedded"), F.col("chunks")))


@query(with_views("works", """SELECT author, count(*) FILTER (source_class = 'primary') AS primaries, count(*) FILTER (source_class = 'secondary') AS secondaries, count(*) FILTER (source_class = 'contextual') AS contexts, max(publication_year) AS profile_version FROM works GROUP BY author"""))
def author_health(spark, sf_dir) -> DataFrame:
    w = works(spark, sf_dir).withColumn("slug", F.split_part("work_id", F.lit("--"), F.lit(1)))
    each = {name: w.filter(F.col("source_class") == kind).groupBy("slug").agg(F.count(F.lit(1)).alias(name)) for name, kind in (("primaries", "primary"), ("secondaries", "secondary"), ("contexts", "contextual"))}
    out = w.groupBy("slug").agg(F.max("publication_year").alias("profile_version"))
    for frame in each.values():
        out = out.join(frame, "slug", "left")
    return out.select(F.col("slug").alias("author"), *[F.coalesce(n, F.lit(0)).alias(n) for n in each], "profile_version")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf_dir) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left_anti")


@query(with_views("chunks edges", f"""SELECT chunk_id, granularity FROM chunks WHERE chunk_id::VARCHAR NOT IN (SELECT src FROM edges WHERE type IN {ENTITY_EDGES})"""))
def edgeless_chunks(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter(F.col("type").isin(*ENTITY_EDGES)).select(F.col("src").cast("long").alias("chunk_id"))
    return chunks(spark, sf_dir).select("chunk_id", "granularity").join(e, "chunk_id", "left_anti")


@query(with_views("works chunks edges", """SELECT work_id, EXISTS (SELECT 1 FROM chunks c JOIN edges e ON e.src = c.chunk_id::VARCHAR AND e.type = 'EXPLORES_THEME' WHERE c.work_id = w.work_id) AS themed FROM works w WHERE source_class = 'primary'"""))
def works_with_themes(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'EXPLORES_THEME'").select(F.col("src").cast("long").alias("chunk_id"))
    themed = chunks(spark, sf_dir).select("chunk_id", "work_id").join(e, "chunk_id", "left_semi").select("work_id").distinct().withColumn("themed", F.lit(True))
    return works(spark, sf_dir).filter("source_class = 'primary'").select("work_id").join(themed, "work_id", "left").fillna(False)


@query("""SELECT CASE WHEN v.vec_id IS NULL THEN 'only_left' WHEN d.doc_id IS NULL THEN 'only_right' WHEN d.n_chars % 10 IS DISTINCT FROM v.label THEN 'mismatch' ELSE 'same' END AS state, count(*) AS n, min(coalesce(doc_id, vec_id)) AS first
  FROM documents d FULL JOIN embeddings v ON d.doc_id = v.vec_id + 50 GROUP BY 1""")
def store_consistency(spark, sf_dir) -> DataFrame:
    left = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 10).alias("a"))
    right = load(spark, sf_dir, "embeddings").select((F.col("vec_id") + 50).alias("key"), "vec_id", "label")
    both = left.join(right, F.col("doc_id") == F.col("key"), "full_outer")
    state = F.when(F.col("vec_id").isNull(), "only_left").when(F.col("doc_id").isNull(), "only_right").when(~F.col("a").eqNullSafe(F.col("label")), "mismatch").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", "vec_id")).alias("first"))


@query("""WITH d AS (SELECT doc_id, lang, regexp_replace(lower(left(text, 150)), '\\s+', ' ', 'g') AS prefix, doc_id % 2 AS side FROM documents),
  l AS (SELECT lang, prefix, min(doc_id) AS old_id FROM d WHERE side = 0 GROUP BY ALL HAVING count(*) = 1), r AS (SELECT lang, prefix, min(doc_id) AS new_id FROM d WHERE side = 1 GROUP BY ALL HAVING count(*) = 1)
  SELECT old_id, new_id FROM l JOIN r USING (lang, prefix)""")
def remap_by_preview(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace(F.lower(F.left("text", F.lit(150))), r"\s+", " ").alias("prefix"))

    def unique(side: int, name: str) -> DataFrame:
        return d.filter(F.col("doc_id") % 2 == side).groupBy("lang", "prefix").agg(F.min("doc_id").alias(name), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")

    return unique(0, "old_id").join(unique(1, "new_id"), ["lang", "prefix"]).select("old_id", "new_id")


@query(with_views("works chunks", """SELECT cited, c.work_id, c.chunk_id IS NOT NULL AS verified, w.publication_year FROM (SELECT doc_id * 3 AS cited FROM documents) x LEFT JOIN chunks c ON c.chunk_id = x.cited LEFT JOIN works w ON w.work_id = c.work_id"""))
def citation_verification(spark, sf_dir) -> DataFrame:
    cited = load(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("cited"))
    c = chunks(spark, sf_dir).select("chunk_id", "work_id")
    w = works(spark, sf_dir).select("work_id", "publication_year")
    return cited.join(c, F.col("cited") == F.col("chunk_id"), "left").join(w, "work_id", "left").select("cited", "work_id", F.col("chunk_id").isNotNull().alias("verified"), "publication_year")


@query("""SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers, coalesce(round(max(c_acctbal), 2), 0) AS top FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def nation_overview(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("top"))
    s = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return out.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce(F.round("top", 2), F.lit(0.0)).alias("top"))


@query("""SELECT c_mktsegment, count(*) AS idle, round(avg(c_acctbal), 4) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY c_mktsegment""")
def customers_without_orders(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("idle"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query("""SELECT p_brand, count(*) AS parts, sum(l_quantity) AS quantity FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 20 AND l_returnflag = 'R' GROUP BY p_brand""")
def returned_by_brand(spark, sf_dir) -> DataFrame:
    p = load(spark, sf_dir, "part").filter("p_size < 20").select("p_partkey", "p_brand")
    l = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_quantity")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.sum("l_quantity").alias("quantity"))


# ---- aggregates

@query(with_views("works", """SELECT count(*) AS works, count(*) FILTER (source_class = 'primary') AS n_primary, count(*) FILTER (source_class = 'personal') AS n_personal, sum(total_chars)::BIGINT AS chars, count(DISTINCT author) AS authors, max(publication_year) AS latest FROM works"""))
def library_overview(spark, sf_dir) -> DataFrame:
    kind = F.col("source_class")
    return works(spark, sf_dir).agg(F.count(F.lit(1)).alias("works"), F.count_if(kind == "primary").alias("n_primary"), F.count_if(kind == "personal").alias("n_personal"), F.sum("total_chars").alias("chars"), F.countDistinct("author").alias("authors"), F.max("publication_year").alias("latest"))


@query(with_views("works", """SELECT author, count(*) AS works, count(*) FILTER (source_class = 'primary') AS n_primary, sum(n_docs)::BIGINT AS docs, min(publication_year) AS first_year, max(publication_year) AS last_year FROM works GROUP BY author"""))
def list_authors(spark, sf_dir) -> DataFrame:
    return works(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("source_class") == "primary").alias("n_primary"), F.sum("n_docs").alias("docs"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year")).orderBy(F.desc("works"), "author")


@query(with_views("chunks vectors", """SELECT granularity, count(*) AS chunks, count(v.chunk_id) AS embedded, round(100.0 * count(v.chunk_id) / count(*), 1) AS coverage FROM chunks c LEFT JOIN vectors v USING (chunk_id) GROUP BY granularity"""))
def chunk_stats(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", F.lit(1).alias("has"))
    return chunks(spark, sf_dir).select("chunk_id", "granularity").join(v, "chunk_id", "left").groupBy("granularity").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded"), percent(F.count("has"), F.count(F.lit(1))).alias("coverage"))


@query(with_views("chunks", "SELECT work_id, coalesce(chapter, 'body') AS section, count(*) AS n, sum(len(regexp_split_to_array(text, '\\s+')))::BIGINT AS pieces FROM chunks GROUP BY ALL"))
def section_breakdown(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("work_id", F.coalesce("chapter", F.lit("body")).alias("section")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("pieces"))


@query(with_views("edges", "SELECT 'edge' AS what, type AS name, count(*) AS n FROM edges GROUP BY type UNION ALL SELECT 'node', split_part(dst, '-', 1), count(DISTINCT dst) FROM edges WHERE contains(dst, '-') GROUP BY 2"))
def graph_counts(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir)
    kinds = e.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "name", "n")
    nodes = e.filter(F.col("dst").contains("-")).groupBy(F.split_part("dst", F.lit("-"), F.lit(1)).alias("name")).agg(F.countDistinct("dst").alias("n"))
    return kinds.unionByName(nodes.select(F.lit("node").alias("what"), "name", "n"))


@query(with_views("chunks edges", """SELECT dst AS theme, count(DISTINCT work_id) AS works, count(DISTINCT src) AS passages FROM edges JOIN chunks ON src = chunk_id::VARCHAR WHERE type = 'EXPLORES_THEME' GROUP BY dst ORDER BY works DESC, passages DESC, theme LIMIT 15"""))
def top_themes(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'EXPLORES_THEME'").select(F.col("src").cast("long").alias("chunk_id"), F.col("dst").alias("theme"))
    c = chunks(spark, sf_dir).select("chunk_id", "work_id")
    return e.join(c, "chunk_id").groupBy("theme").agg(F.countDistinct("work_id").alias("works"), F.countDistinct("chunk_id").cast("long").alias("passages")).orderBy(F.desc("works"), F.desc("passages"), "theme").limit(15)


@query(with_views("edges", """SELECT count(*) AS themes, count(*) FILTER (d <= 1) AS singletons, round(avg(d), 4) AS mean_links, count(*) FILTER (d <= 1) * 10 > count(*) * 3 AS warn FROM (SELECT dst, count(*) AS d FROM edges WHERE type IN ('EXPLORES_THEME','CONCEPT_USED_IN') GROUP BY dst)"""))
def theme_connectivity(spark, sf_dir) -> DataFrame:
    d = edges(spark, sf_dir).filter(F.col("type").isin("EXPLORES_THEME", "CONCEPT_USED_IN")).groupBy("dst").agg(F.count(F.lit(1)).alias("d"))
    alone = F.count_if(F.col("d") <= 1)
    return d.agg(F.count(F.lit(1)).alias("themes"), alone.alias("singletons"), F.round(F.avg("d"), 4).alias("mean_links"), (alone * 10 > F.count(F.lit(1)) * 3).alias("warn"))


@query(with_views("chunks", "SELECT work_id, pass_number, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM chunks WHERE source_class <> 'personal' GROUP BY ALL"))
def pass_history(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).filter("source_class <> 'personal'").groupBy("work_id", "pass_number").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(with_views("chunks", "SELECT work_id, max(pass_number) AS passes, count(*) AS n, min(day) AS first_day, max(day) AS last_day, coalesce(max(pass_number), 0) + 1 AS current_pass, max(pass_number) > 1 AS reengaged FROM chunks GROUP BY work_id"))
def reengagement(spark, sf_dir) -> DataFrame:
    top = F.max("pass_number")
    return chunks(spark, sf_dir).groupBy("work_id").agg(top.alias("passes"), F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.coalesce(top, F.lit(0)) + 1).alias("current_pass"), (top > 1).alias("reengaged"))


@query("""SELECT n_regionkey, list_sort(list(n_nationkey)) AS keys, median(n_nationkey) AS middle, mode_first FROM nation JOIN (SELECT c_nationkey % 5 AS k, arg_min(c_mktsegment, (-n, first)) AS mode_first FROM (SELECT c_nationkey % 5 AS c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL) GROUP BY 1) ON k = n_regionkey GROUP BY n_regionkey, mode_first""")
def collected_groups(spark, sf_dir) -> DataFrame:
    n = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"), F.median("n_nationkey").alias("middle"))
    c = load(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("k"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    # The most frequent value; of equals the one seen first.
    mode = c.groupBy("k").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), F.col("first"))).alias("mode_first"))
    return n.join(mode, F.col("k") == F.col("n_regionkey")).select("n_regionkey", "keys", "middle", "mode_first")


@query(with_views("chunks", """SELECT granularity, coalesce(a, 0)::BIGINT AS first_pass, coalesce(b, 0)::BIGINT AS second_pass, (coalesce(b, 0) - coalesce(a, 0))::BIGINT AS shift FROM (SELECT granularity, count(*) AS a FROM chunks WHERE pass_number = 1 AND chunk_id % 2 = 0 GROUP BY 1) x FULL JOIN (SELECT granularity, count(*) AS b FROM chunks WHERE pass_number = 2 AND chunk_id % 5 = 0 GROUP BY 1) y USING (granularity)"""))
def histogram_shift(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir)
    a = c.filter("pass_number = 1 and chunk_id % 2 = 0").groupBy("granularity").agg(F.count(F.lit(1)).alias("first_pass"))
    b = c.filter("pass_number = 2 and chunk_id % 5 = 0").groupBy("granularity").agg(F.count(F.lit(1)).alias("second_pass"))
    return a.join(b, "granularity", "full_outer").fillna(0).withColumn("shift", F.col("second_pass") - F.col("first_pass"))


@query(with_views("chunks", r"""SELECT chunk_id, n, hits, n >= 5 AND hits > 0.4 * n AS index_like FROM (SELECT chunk_id, len(l) AS n, len(list_filter(l, lambda x: length(x) < 60)) AS hits FROM (SELECT chunk_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM chunks))"""))
def line_ratios(spark, sf_dir) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    c = chunks(spark, sf_dir).select("chunk_id", F.size(lines).cast("long").alias("n"), F.size(F.filter(lines, lambda x: F.length(x) < 60)).cast("long").alias("hits"))
    return c.withColumn("index_like", (F.col("n") >= 5) & (F.col("hits") > 0.4 * F.col("n")))


@query(with_views("works chunks vectors edges", """SELECT w.work_id, coalesce(c.n, 0) AS chunks, coalesce(c.e, 0) AS embedded, coalesce(c.noise, 0) AS noise, coalesce(c.linked, 0) AS linked,
  list_filter([CASE WHEN coalesce(c.n, 0) = 0 THEN 'no chunks' END, CASE WHEN coalesce(c.e, 0) < coalesce(c.n, 0) THEN 'missing embeddings' END, CASE WHEN c.noise * 10 > c.n THEN 'noise' END, CASE WHEN c.n - c.linked >= 10 OR (c.n - c.linked) * 10 >= c.n THEN 'entity gap' END], lambda x: x IS NOT NULL) AS warnings
  FROM works w LEFT JOIN (SELECT work_id, count(*) AS n, count(v.chunk_id) AS e, count(*) FILTER ((granularity IN ('micro','nano') AND section_type IN ('index','bibliography')) OR length(text) < 50) AS noise, count(s.src) AS linked
    FROM chunks LEFT JOIN vectors v USING (chunk_id) LEFT JOIN (SELECT DISTINCT src FROM edges WHERE type IN ('EXPLORES_THEME','MAKES_ARGUMENT','ATTRIBUTED_BY_CRITIC','CONCEPT_USED_IN','REFERENCES_PERSON')) s ON s.src = chunk_id::VARCHAR GROUP BY work_id) c USING (work_id)"""))
def audit_library(spark, sf_dir) -> DataFrame:
    linked = edges(spark, sf_dir).filter(F.col("type").isin(*ENTITY_EDGES)).select(F.col("src").cast("long").alias("chunk_id")).distinct().withColumn("linked", F.lit(1))
    v = vectors(spark, sf_dir).select("chunk_id", F.lit(1).alias("embedded"))
    c = chunks(spark, sf_dir).select("chunk_id", "work_id", is_noise().alias("noise")).join(v, "chunk_id", "left").join(linked, "chunk_id", "left")
    sums = c.groupBy("work_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedded").alias("embedded"), F.count_if("noise").alias("noise"), F.count("linked").alias("linked"))
    out = works(spark, sf_dir).select("work_id").join(sums, "work_id", "left").fillna(0)
    n, gap = F.col("chunks"), F.col("chunks") - F.col("linked")
    rules = (("no chunks", n == 0), ("missing embeddings", F.col("embedded") < n), ("noise", F.col("noise") * 10 > n), ("entity gap", (n > 0) & ((gap >= 10) | (gap * 10 >= n))))
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])))


@query(with_views("works chunks vectors edges", """WITH $ f AS (SELECT w.work_id, w.source_class, count(c.chunk_id) > 0 AS chunked, count(v.chunk_id) > 0 AS embedded, count(e.src) > 0 AS linked, w.source_class <> 'primary' OR count(v.chunk_id) > 2 AS voiced
    FROM works w LEFT JOIN chunks c USING (work_id) LEFT JOIN vectors v ON v.chunk_id = c.chunk_id LEFT JOIN (SELECT DISTINCT src FROM edges) e ON e.src = c.chunk_id::VARCHAR GROUP BY w.work_id, w.source_class)
  SELECT *, chunked AND embedded AND linked AND voiced AS fully_done FROM f"""))
def pipeline_status(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", F.lit(1).alias("v"))
    e = edges(spark, sf_dir).select(F.col("src").try_cast("long").alias("chunk_id")).distinct().withColumn("e", F.lit(1))
    c = chunks(spark, sf_dir).select("chunk_id", "work_id").join(v, "chunk_id", "left").join(e, "chunk_id", "left").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("v"), F.count("e").alias("e"))
    w = works(spark, sf_dir).select("work_id", "source_class").join(c, "work_id", "left").fillna(0)
    out = w.select("work_id", "source_class", (F.col("n") > 0).alias("chunked"), (F.col("v") > 0).alias("embedded"), (F.col("e") > 0).alias("linked"), ((F.col("source_class") != "primary") | (F.col("v") > 2)).alias("voiced"))
    return out.withColumn("fully_done", F.expr("chunked and embedded and linked and voiced"))


@query(with_views("works chunks", """WITH $ a AS (SELECT count(*) AS bad, (SELECT count(*) FROM chunks) AS total FROM chunks WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings)), b AS (SELECT count(*) AS bad, (SELECT count(*) FROM works) AS total FROM works WHERE publication_year IS NULL),
  c AS (SELECT count(*) AS bad, (SELECT count(*) FROM chunks) AS total FROM chunks WHERE length(text) < 50), u AS (SELECT 'embeddings' AS name, * FROM a UNION ALL SELECT 'years', * FROM b UNION ALL SELECT 'short', * FROM c)
  SELECT name, bad, total, CASE WHEN bad = 0 THEN 'ok' WHEN bad * 10 < total THEN 'warn' ELSE 'error' END AS status FROM u"""))
def health_checks(spark, sf_dir) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("v"))
    c = chunks(spark, sf_dir).select("chunk_id", F.length("text").alias("size")).join(v, "chunk_id", "left")
    total = F.count(F.lit(1)).alias("total")

    def row(frame: DataFrame, name: str, bad: Column) -> DataFrame:
        return frame.agg(F.count_if(bad).alias("bad"), total).select(F.lit(name).alias("name"), "bad", "total")

    out = row(c, "embeddings", F.col("v").isNull()).unionByName(row(works(spark, sf_dir), "years", F.col("publication_year").isNull())).unionByName(row(c, "short", F.col("size") < 50))
    return out.withColumn("status", F.when(F.col("bad") == 0, "ok").when(F.col("bad") * 10 < F.col("total"), "warn").otherwise("error"))


# ---- orders, limits and sets

@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query(with_views("works", "SELECT work_id, row_number() OVER (ORDER BY publication_year NULLS LAST, title, work_id) AS place FROM works"))
def nulls_last_order(spark, sf_dir) -> DataFrame:
    return works(spark, sf_dir).select("work_id", F.row_number().over(Window.orderBy(F.col("publication_year").asc_nulls_last(), "title", "work_id")).cast("long").alias("place"))


@query(with_views("edges", "SELECT dst, count(*) AS degree FROM edges GROUP BY dst ORDER BY degree DESC, dst LIMIT 100"))
def degree_topk(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).groupBy("dst").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "dst").limit(100)


@query(with_views("chunks edges", """WITH $ p AS (SELECT DISTINCT work_id, pass_number, dst AS theme FROM chunks JOIN edges ON src = chunk_id::VARCHAR AND type = 'EXPLORES_THEME'),
  q AS (SELECT work_id, list_sort(list(theme) FILTER (pass_number = 1)) AS a, list_sort(list(theme) FILTER (pass_number = 2)) AS b FROM p GROUP BY work_id)
  SELECT work_id, list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS added, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS gone, list_sort(list_intersect(coalesce(a, []), coalesce(b, []))) AS kept,
    len(coalesce(a, [])) > 0 AND len(coalesce(b, [])) > 0 AND len(list_intersect(a, b)) / greatest(len(a), len(b)) < 0.5 AS changed FROM q"""))
def pass_theme_delta(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'EXPLORES_THEME'").select(F.col("src").cast("long").alias("chunk_id"), F.col("dst").alias("theme"))
    p = chunks(spark, sf_dir).select("chunk_id", "work_id", "pass_number").join(e, "chunk_id")
    q = p.groupBy("work_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("pass_number") == n, F.col("theme")))).alias(c) for n, c in ((1, "a"), (2, "b"))])
    return q.select("work_id", F.array_except("b", "a").alias("added"), F.array_except("a", "b").alias("gone"), F.array_intersect("a", "b").alias("kept"), theme_change(F.col("a"), F.col("b")).alias("changed"))


def theme_change(a: Column, b: Column) -> Column:
    """Under half of the larger theme list in common; false if a list is empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) < 0.5)


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings) UNION ALL SELECT 'labels only', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT 'vectors only', count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels)""")
def id_set_algebra(spark, sf_dir) -> DataFrame:
    a, b = load(spark, sf_dir, "labels").select("doc_id"), load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    parts = (("both", a.intersect(b)), ("labels only", a.subtract(b)), ("vectors only", b.subtract(a)))
    out = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, f in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- extras that go beyond parity

@query("""SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_events(spark, sf_dir) -> DataFrame:
    w = F.window("ts", "1 hour")
    return load(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
