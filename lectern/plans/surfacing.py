"""Surfacing of related passages, governance records and catalogue steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import surfacing as S
from ..operators.fusion import top_per_group
from ..operators.vectors import nearest
from ..tables import chunks, edges, load, vectors, with_views, works
from .registry import query

#: Passages whose id this divides are the query set of the searches by vector, against all passages.
ASKED = 20
_TIER = """CASE kind WHEN 'passage_link' THEN CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END WHEN 'reflection' THEN CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END
    WHEN 'entity_overlap' THEN CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END WHEN 'theme' THEN CASE WHEN score > 0.75 THEN 'medium' ELSE 'low' END ELSE CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END END"""
def _related_sql(personal: bool = True) -> str:
    of_all = "" if personal else "WHERE source_class IS DISTINCT FROM 'personal'"
    more = "UNION ALL SELECT * FROM rf UNION ALL SELECT * FROM rv" if personal else ""
    return f"""WITH $ l AS (SELECT src AS id, dst AS other, 'passage_link' AS kind, CASE confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.7 ELSE 0.4 END::DOUBLE AS score FROM edges WHERE type = 'ENGAGES_WITH'
    UNION ALL SELECT dst, src, 'passage_link', CASE confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.7 ELSE 0.4 END FROM edges WHERE type = 'ENGAGES_WITH'),
  th AS (SELECT DISTINCT src, dst, work_id FROM edges JOIN chunks ON src = chunk_id::VARCHAR WHERE type = 'EXPLORES_THEME'), m AS (SELECT src AS id, dst, work_id FROM th QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 5),
  tw AS (SELECT DISTINCT dst, work_id FROM m), tt AS (SELECT tw.dst, tw.work_id, th.src AS other FROM tw JOIN th ON th.dst = tw.dst AND th.work_id <> tw.work_id QUALIFY row_number() OVER (PARTITION BY tw.dst, tw.work_id ORDER BY th.src::BIGINT) <= 20),
  t AS (SELECT DISTINCT id, other, 'theme' AS kind, 0.6::DOUBLE AS score FROM m JOIN tt USING (dst, work_id)),
  dr AS (SELECT DISTINCT e.dst AS dst, e.src AS other FROM edges e WHERE type = 'USER_REFLECTS_ON'), rf AS (SELECT DISTINCT m.id, dr.other, 'reflection' AS kind, 0.85::DOUBLE AS score FROM m JOIN dr ON dr.dst = m.dst WHERE dr.other <> m.id QUALIFY row_number() OVER (PARTITION BY m.id, m.dst ORDER BY dr.other::BIGINT) <= 10),
  nv AS (SELECT a.chunk_id::VARCHAR AS id, b.chunk_id::VARCHAR AS other, b.source_class, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cos FROM vectors a JOIN (SELECT v.*, source_class FROM vectors v LEFT JOIN chunks USING (chunk_id)) b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % {ASKED} = 0),
  v AS (SELECT id, other, 'vector' AS kind, round(0.65 * cos, 6) AS score FROM nv {of_all} QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, other::BIGINT) <= 15),
  pv AS (SELECT id, other, cos FROM nv WHERE source_class = 'personal' QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, other::BIGINT) <= 10),
  rv AS (SELECT id, other, 'reflection' AS kind, round(0.7 * cos, 6) AS score FROM pv WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.id = pv.id AND rf.other = pv.other)),
  u AS (SELECT * FROM l UNION ALL SELECT * FROM t UNION ALL SELECT * FROM v {more}), b AS (SELECT id, other, max({{'s': score, 'k': kind}}) AS x FROM u GROUP BY ALL),
  r AS (SELECT id, other, x.k AS kind, x.s AS score FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY x.s DESC, other) <= 20),
  c AS (SELECT *, {_TIER} AS confidence FROM r)
  """


_RELATED = _related_sql()


def related_rows(spark, sf_dir, personal: bool = True) -> DataFrame:
    """Of every passage the twenty most related: links, themes, reflections on its themes if ``personal``; of the asked ones nearby vectors too."""
    e = edges(spark, sf_dir)
    own = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("src"), F.col("work_id").alias("owner"), "source_class")
    links = S.by_links(e.filter("type = 'ENGAGES_WITH'"))
    themes = e.filter("type = 'EXPLORES_THEME'")
    seeds = themes.select(F.col("src").alias("id")).distinct()
    v = vectors(spark, sf_dir)
    asked = v.filter(F.col("chunk_id") % ASKED == 0).select(F.col("chunk_id").alias("id"), "embedding")
    text = lambda f: f.select(F.col("id").cast("string").alias("id"), F.col("chunk_id").cast("string").alias("other"), "score")
    mine = own.filter("source_class = 'personal'").select(F.col("src").cast("long").alias("chunk_id"))
    near = text(nearest(v if personal else v.join(mine, "chunk_id", "left_anti"), asked, 15)).select("id", "other", F.lit("vector").alias("kind"), F.round(S.VECTOR_FACTOR * F.col("score"), 6).alias("score"))
    parts = [links, S.by_themes(seeds, themes, own), near]
    if personal:
        reflections = S.theme_reflections(seeds, themes, e.filter("type = 'USER_REFLECTS_ON'"), own)
        parts.append(S.by_reflections(reflections, text(nearest(v.join(mine, "chunk_id", "left_semi"), asked, 10))))
    return S.related(parts, 20)


@query(with_views("chunks vectors edges", _RELATED + "SELECT id, other, kind, score, confidence FROM c"))
def find_related(spark, sf_dir) -> DataFrame:
    return related_rows(spark, sf_dir)


@query(with_views("chunks vectors edges", _related_sql(False) + """, s AS (SELECT c.*, y.work_id AS target_work FROM c JOIN chunks x ON x.chunk_id::VARCHAR = id JOIN chunks y ON y.chunk_id::VARCHAR = other WHERE x.work_id <> y.work_id AND NOT (confidence = 'low' AND score < 0.4)
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE type = 'ENGAGES_WITH' AND ((e.src = id AND e.dst = other) OR (e.src = other AND e.dst = id))))
  SELECT id, other, target_work, kind, score, confidence, CASE confidence WHEN 'high' THEN 'This directly engages with' WHEN 'medium' THEN 'This appears to connect to' ELSE 'You might find this relevant' END AS label,
    CASE kind WHEN 'theme' THEN 'These passages explore parallel thematic territory.' ELSE 'Semantic similarity suggests these passages address related ideas.' END AS why FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 10"""))
def connection_scan(spark, sf_dir) -> DataFrame:
    """Connections to propose for every passage: related ones of other works that no link joins yet."""
    own = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("src"), F.col("work_id").alias("owner"))
    return S.staged(related_rows(spark, sf_dir, personal=False), own, edges(spark, sf_dir).filter("type = 'ENGAGES_WITH'"))


@query(with_views("chunks vectors edges", _RELATED + ", g AS (SELECT *, row_number() OVER (PARTITION BY id, confidence ORDER BY score DESC, other) AS rn FROM c) SELECT id, confidence, count(*) AS total, list(other ORDER BY score DESC, other) FILTER (rn <= 3) AS shown FROM g GROUP BY id, confidence"))
def response_groups(spark, sf_dir) -> DataFrame:
    return S.grouped(related_rows(spark, sf_dir))


@query(with_views("chunks vectors edges", _RELATED + "SELECT id, string_agg(printf('- %s (%s, %.2f): %s', other, kind, score, confidence), chr(10) ORDER BY score DESC, other) AS report FROM c GROUP BY id"))
def surfacing_report(spark, sf_dir) -> DataFrame:
    return S.report(related_rows(spark, sf_dir))


@query(with_views("chunks edges vectors", f"""WITH $ q AS (SELECT 'passage_link' AS kind, score FROM edges WHERE type = 'ENGAGES_WITH' UNION ALL SELECT 'theme', score FROM edges WHERE type = 'THEMATIC_PARALLEL' UNION ALL SELECT ['vector','reflection','entity_overlap','temporal'][x.i], round(abs(embedding[x.i]), 6) FROM vectors, (SELECT unnest([1, 2, 3, 4]) AS i) x)
  SELECT kind, confidence, count(*) AS n FROM (SELECT kind, {_TIER} AS confidence FROM q) GROUP BY ALL"""))
def confidence_tiers(spark, sf_dir) -> DataFrame:
    """Tiers of the stored scores of links and parallels, and of every vector's first coordinates."""
    e = edges(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.round(F.abs(F.element_at("embedding", i + 1)), 6).alias("score")) for i, k in enumerate(("vector", "reflection", "entity_overlap", "temporal"))])
    parts = [e.filter(F.col("type") == t).select(F.lit(k).alias("kind"), "score") for t, k in (("ENGAGES_WITH", "passage_link"), ("THEMATIC_PARALLEL", "theme"))]
    q = parts[0].unionByName(parts[1]).unionByName(vectors(spark, sf_dir).select(F.explode(kinds).alias("x")).select("x.*"))
    return q.groupBy("kind", S.tier(F.col("kind"), F.col("score")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("chunks edges", """WITH $ l AS (SELECT src::BIGINT AS a, dst::BIGINT AS b, score FROM edges WHERE type = 'ENGAGES_WITH' AND score >= 0.3), k AS (SELECT src::BIGINT AS s, dst::BIGINT AS d FROM edges WHERE type = 'THEMATIC_PARALLEL')
  SELECT a, b, score FROM l JOIN chunks x ON x.chunk_id = a JOIN chunks y ON y.chunk_id = b WHERE x.work_id <> y.work_id AND NOT EXISTS (SELECT 1 FROM k WHERE (s = a AND d = b) OR (s = b AND d = a))"""))
def staged_connections(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).select("type", F.col("src").try_cast("long").alias("src"), F.col("dst").try_cast("long").alias("dst"), "score")
    found = e.filter("type = 'ENGAGES_WITH' and score >= 0.3").select(F.col("src").alias("a"), F.col("dst").alias("b"), "score")
    known = e.filter("type = 'THEMATIC_PARALLEL'").select("src", "dst")
    own = chunks(spark, sf_dir).select("chunk_id", "work_id")
    joined = found.join(own.select(F.col("chunk_id").alias("a"), F.col("work_id").alias("wa")), "a").join(own.select(F.col("chunk_id").alias("b"), F.col("work_id").alias("wb")), "b").filter("wa <> wb")
    return G.without_linked(joined, known).select("a", "b", "score")


@query(with_views("works chunks edges", """WITH $ s AS (SELECT 1 AS prio, src::BIGINT AS chunk_id FROM edges WHERE type = 'USER_REFLECTS_ON' AND dst = 'theme-1' UNION ALL SELECT 2, chunk_id FROM chunks JOIN works USING (work_id) WHERE author = 'author-en' UNION ALL SELECT 3, chunk_id FROM chunks WHERE contains(lower(text), ' the '))
  SELECT chunk_id, day, min(prio)::INT AS origin FROM s JOIN chunks USING (chunk_id) WHERE chunks.source_class = 'personal' AND day BETWEEN 21 AND 25 GROUP BY ALL"""))
def gathered_reflections(spark, sf_dir) -> DataFrame:
    """Personal passages of some days: on a theme, of a speaker, or with a prompt's word; the first way counts."""
    c = chunks(spark, sf_dir).filter("source_class = 'personal' and day between 21 and 25").select("chunk_id", "day", "work_id", "text")
    on_theme = edges(spark, sf_dir).filter("type = 'USER_REFLECTS_ON' and dst = 'theme-1'").select(F.col("src").try_cast("long").alias("chunk_id"))
    said = works(spark, sf_dir).filter("author = 'author-en'").select("work_id")
    ways = (c.join(on_theme, "chunk_id", "left_semi"), c.join(said, "work_id", "left_semi"), c.filter(F.lower("text").contains(" the ")))
    parts = [w.select("chunk_id", "day", F.lit(i + 1).alias("origin")) for i, w in enumerate(ways)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("chunk_id", "day").agg(F.min("origin").alias("origin"))


@query(with_views("works chunks edges", """SELECT author, count(DISTINCT c.work_id) AS works, sum(CASE WHEN e.src IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS theme_passages, coalesce(list_sort(list(DISTINCT chunk_id) FILTER (e.src IS NOT NULL))[1:2], []) AS samples
  FROM works w JOIN chunks c USING (work_id) LEFT JOIN (SELECT DISTINCT src FROM edges WHERE type = 'EXPLORES_THEME' AND dst = 'theme-1') e ON e.src = chunk_id::VARCHAR GROUP BY author"""))
def compare_ideas(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'EXPLORES_THEME' and dst = 'theme-1'").select(F.col("src").cast("long").alias("chunk_id")).distinct().withColumn("themed", F.lit(True))
    c = chunks(spark, sf_dir).select("chunk_id", "work_id").join(e, "chunk_id", "left").join(works(spark, sf_dir).select("work_id", "author"), "work_id")
    some = top_per_group(c.filter("themed"), ["author"], ["chunk_id"], 2).groupBy("author").agg(F.array_sort(F.collect_list("chunk_id")).alias("samples"))
    counts = c.groupBy("author").agg(F.countDistinct("work_id").alias("works"), F.count("themed").alias("theme_passages"))
    return counts.join(some, "author", "left").select("author", "works", "theme_passages", F.coalesce("samples", F.array().cast("array<bigint>")).alias("samples"))


@query(with_views("works chunks edges", """WITH $ t AS (SELECT c.work_id, c.chunk_id FROM edges e JOIN chunks c ON e.src = c.chunk_id::VARCHAR WHERE e.type = 'EXPLORES_THEME' AND e.dst = 'theme-2'), a AS (SELECT t.work_id, count(DISTINCT m.dst) AS arguments FROM t LEFT JOIN edges m ON m.src = t.chunk_id::VARCHAR AND m.type = 'MAKES_ARGUMENT' GROUP BY t.work_id),
  s AS (SELECT work_id, count(*) AS passages, list_sort(list(chunk_id))[1:3] AS samples FROM t GROUP BY work_id) SELECT work_id, publication_year, passages, arguments, samples FROM s JOIN a USING (work_id) JOIN works USING (work_id)"""))
def trace_theme(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir)
    t = e.filter("type = 'EXPLORES_THEME' and dst = 'theme-2'").select(F.col("src").cast("long").alias("chunk_id")).join(chunks(spark, sf_dir).select("chunk_id", "work_id"), "chunk_id")
    m = e.filter("type = 'MAKES_ARGUMENT'").select(F.col("src").cast("long").alias("chunk_id"), F.col("dst").alias("argument"))
    some = top_per_group(t, ["work_id"], ["chunk_id"], 3).groupBy("work_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("samples"))
    per = t.groupBy("work_id").agg(F.count(F.lit(1)).alias("passages")).join(some, "work_id")
    a = t.join(m, "chunk_id", "left").groupBy("work_id").agg(F.countDistinct("argument").alias("arguments"))
    return per.join(a, "work_id").join(works(spark, sf_dir).select("work_id", "publication_year"), "work_id").select("work_id", "publication_year", "passages", "arguments", "samples")


@query(with_views("edges", """WITH $ e AS (SELECT src, dst FROM edges WHERE type = 'ENGAGES_WITH'), h1 AS (SELECT DISTINCT src AS seed, dst AS node FROM e ), h2 AS (SELECT DISTINCT seed, e.dst AS node FROM h1 JOIN e ON e.src = node), n AS (SELECT src, count(*) AS further FROM e GROUP BY src)
  SELECT seed, node, min(hop) AS hop, max(coalesce(further, 0)) AS further FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) LEFT JOIN n ON n.src = node GROUP BY seed, node"""))
def passage_links(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'ENGAGES_WITH'").select("src", "dst", "link_type", "confidence")
    seeds = e.select(F.col("src").alias("node")).distinct()
    n = e.groupBy("src").agg(F.count(F.lit(1)).alias("further"))
    p = G.paths(e, seeds, 2).groupBy("seed", "node").agg(F.min("hops").alias("hop"))
    return p.join(n, F.col("node") == F.col("src"), "left").select("seed", "node", "hop", F.coalesce("further", F.lit(0)).alias("further"))


# ---- governance

@query("""WITH l AS (SELECT o_orderkey % 50 AS lesson, o_orderpriority AS problem, count(*) AS applied, count(*) FILTER (o_orderstatus = 'F') AS prevented FROM orders GROUP BY ALL) SELECT lesson, problem, round(0.5 + 0.5 * (prevented + 1) / greatest(applied, 1), 6) AS confidence FROM l WHERE 0.5 + 0.5 * (prevented + 1) / greatest(applied, 1) >= 0.6""")
def lesson_confidence(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("lesson"), F.col("o_orderpriority").alias("problem")).agg(F.count(F.lit(1)).alias("applied"), F.count_if(F.col("o_orderstatus") == "F").alias("prevented"))
    c = 0.5 + 0.5 * (F.col("prevented") + 1) / F.greatest("applied", F.lit(1))
    return o.withColumn("c", c).filter("c >= 0.6").select("lesson", "problem", F.round("c", 6).alias("confidence"))


@query("""SELECT l_orderkey % 20 AS lesson, arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) AS rule, count(*) AS versions FROM lineitem GROUP BY 1""")
def lesson_latest(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 20).alias("lesson")).agg(F.max_by("l_linenumber", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule"), F.count(F.lit(1)).alias("versions"))


@query(with_views("works", """WITH $ t AS (SELECT DISTINCT unnest(genre_tags) AS term FROM works), s AS (SELECT term, CASE term WHEN 'homily' THEN 'merged' WHEN 'fiction' THEN 'deprecated' WHEN 'poetry' THEN 'canonical' ELSE 'proposed' END AS status, CASE term WHEN 'homily' THEN 'sermon' END AS merged_into FROM t)
  SELECT term, status, merged_into, coalesce(merged_into, term) AS lookup, (SELECT count(*) FROM works WHERE list_contains(genre_tags, term)) AS affected FROM s"""))
def vocabulary_merge(spark, sf_dir) -> DataFrame:
    each = works(spark, sf_dir).select(F.explode("genre_tags").alias("term"))
    proposed = each.groupBy("term").agg(F.count(F.lit(1)).alias("affected"))
    start = proposed.select("term", F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("merged_into"))
    changes = spark.createDataFrame([("homily", "merged", "sermon"), ("fiction", "deprecated", None), ("poetry", "canonical", None)], "term string, status string, merged_into string")
    terms = G.upsert(start, changes, ["term"])
    return terms.join(proposed, "term").select("term", "status", "merged_into", F.coalesce("merged_into", "term").alias("lookup"), "affected")


@query(r"""WITH k AS (SELECT DISTINCT lower(trim(line)) AS citation FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(trim(line)) >= 10), l AS (SELECT DISTINCT lower(trim(line)) AS citation FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) >= 10)
  SELECT count(*) FILTER (k.citation IS NULL) AS added, count(k.citation) AS already, (SELECT count(*) FROM k) + count(*) FILTER (k.citation IS NULL) AS total FROM l LEFT JOIN k USING (citation)""")
def acquisition_flag(spark, sf_dir) -> DataFrame:
    """Lines of all documents as wanted items, against those of the benchmark as held ones."""
    def lines(name: str) -> DataFrame:
        each = load(spark, sf_dir, name).select(F.explode(F.split("text", "\n")).alias("line"))
        return each.select(F.lower(F.trim("line")).alias("citation")).filter(F.length("citation") >= 10).distinct()

    old = lines("benchmark")
    flagged = lines("documents").join(old.withColumn("known", F.lit(1)), "citation", "left")
    sums = flagged.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count("known").alias("already"))
    total = old.agg(F.count(F.lit(1)).alias("before"))
    return sums.crossJoin(total).select("added", "already", (F.col("before") + F.col("added")).alias("total"))


@query("""WITH v AS (SELECT c_nationkey AS author, c_custkey AS version, ['a'||(c_custkey % 3), 'b'||(c_custkey % 4)] AS phrases FROM customer), l AS (SELECT *, lag(phrases) OVER (PARTITION BY author ORDER BY version) AS old, version = max(version) OVER (PARTITION BY author) AS is_current FROM v)
  SELECT author, version, is_current, list_filter(phrases, lambda x: NOT list_contains(coalesce(old, []), x)) AS added, list_filter(coalesce(old, []), lambda x: NOT list_contains(phrases, x)) AS removed FROM l""")
def profile_versions(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    v = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("author"), k.alias("version"), F.array(F.concat(F.lit("a"), (k % 3).cast("string")), F.concat(F.lit("b"), (k % 4).cast("string"))).alias("phrases"))
    old = F.coalesce(F.lag("phrases").over(Window.partitionBy("author").orderBy("version")), F.array().cast("array<string>"))
    v = G.latest(v.withColumn("old", old), "author", "version")
    return v.select("author", "version", "is_current", F.array_except("phrases", "old").alias("added"), F.array_except("old", "phrases").alias("removed"))


@query(with_views("chunks vectors edges", """WITH $ n AS (SELECT count(*) AS chunks, count(v.chunk_id) AS embedded FROM chunks LEFT JOIN vectors v USING (chunk_id)), e AS (SELECT count(DISTINCT src) AS linked FROM edges JOIN chunks ON src = chunk_id::VARCHAR WHERE type <> 'ENGAGES_WITH')
  SELECT 'embedding coverage' AS name, round(100.0 * embedded / chunks, 1) AS value, embedded * 10 >= chunks * 9 AS passed FROM n UNION ALL SELECT 'entity coverage', round(100.0 * linked / chunks, 1), linked * 10 >= chunks * 9 FROM n, e"""))
def quality_gate(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", F.lit(1).alias("v"))
    e = edges(spark, sf_dir).filter("type <> 'ENGAGES_WITH'").select(F.col("src").try_cast("long").alias("chunk_id")).distinct().withColumn("e", F.lit(1))
    c = chunks(spark, sf_dir).select("chunk_id").join(v, "chunk_id", "left").join(e, "chunk_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("v"), F.count("e").alias("e"))
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.round(100.0 * F.col(k) / F.col("n"), 1).alias("value"), (F.col(k) * 10 >= F.col("n") * 9).alias("passed")) for name, k in (("embedding coverage", "v"), ("entity coverage", "e"))])
    return c.select(F.explode(rows).alias("x")).select("x.*")


@query("""SELECT user_id, count(*) FILTER (epoch(TIMESTAMP '2024-02-01' - ts) < (event_id % 20) * 86400) AS live, count(*) AS cached FROM events GROUP BY user_id""")
def cache_expiry(spark, sf_dir) -> DataFrame:
    # The present is a parameter, so reruns agree.
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    ttl = (F.col("event_id") % 20) * 86400
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.timestamp_diff("SECOND", "ts", now) < ttl).alias("live"), F.count(F.lit(1)).alias("cached"))


@query(with_views("works chunks", """WITH $ n AS (SELECT work_id, count(*) AS n, count(*) FILTER (pass_number <= 2) AS old, count(*) FILTER ((granularity IN ('micro','nano') AND section_type IN ('index','bibliography')) OR length(text) < 50) AS noise FROM chunks GROUP BY work_id)
  SELECT work_id, CASE WHEN n >= old * 1.1 THEN 're-extract' ELSE 'fresh' END AS voice, CASE WHEN noise * 10 <= n THEN 'ok' WHEN list_has_any(genre_tags, ['poetry','sermon']) THEN 'info' ELSE 'warning' END AS noise FROM works JOIN n USING (work_id)"""))
def chunk_noise_severity(spark, sf_dir) -> DataFrame:
    """Over a tenth of noise is a warning, of works in short lines a note; a tenth more passages since the second pass ask for a new voice."""
    noise = (F.col("granularity").isin("micro", "nano") & F.col("section_type").isin("index", "bibliography")) | (F.length("text") < 50)
    n = chunks(spark, sf_dir).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pass_number") <= 2).alias("old"), F.count_if(noise).alias("noise"))
    short = F.arrays_overlap("genre_tags", F.array(F.lit("poetry"), F.lit("sermon")))
    w = works(spark, sf_dir).select("work_id", "genre_tags").join(n, "work_id")
    return w.select("work_id", F.when(F.col("n") >= F.col("old") * 1.1, "re-extract").otherwise("fresh").alias("voice"), F.when(F.col("noise") * 10 <= F.col("n"), "ok").when(short, "info").otherwise("warning").alias("noise"))


@query(r"""SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '(?m)^#+ ([A-Z ]+)$', 1)] AS sections, len(regexp_extract_all(text, '\[REF-[0-9]+\]')) AS refs, len(regexp_extract_all(text, '(?m)^[A-Z][A-Za-z ]{2,30}:')) AS labels FROM documents""")
def structured_text(spark, sf_dir) -> DataFrame:
    """Section marks, reference marks and labels in the stored texts."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    heads = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^#+ ([A-Z ]+)$"), F.lit(1)), lambda x: F.lower(x))
    return load(spark, sf_dir, "documents").select("doc_id", heads.alias("sections"), count(r"\[REF-[0-9]+\]").alias("refs"), count(r"(?m)^[A-Z][A-Za-z ]{2,30}:").alias("labels"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length(html) AS size FROM pages""")
def html_titles(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside|form|iframe)\b.*?</(script|style|nav|header|footer|aside|form|iframe)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_strip_text(spark, sf_dir) -> DataFrame:
    block = "(script|style|nav|header|footer|aside|form|iframe)"
    bare = F.regexp_replace(F.regexp_replace("html", rf"(?is)<{block}\b.*?</{block}>", " "), r"(?s)<[^>]*>", " ")
    return load(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, r"\s+", " "))).alias("text_md5"))


@query(with_views("works chunks", """SELECT c.chunk_id, CASE WHEN c.source_class = 'personal' THEN least(s * 1.3, 1) ELSE s END AS boosted, w.title AS title FROM (SELECT *, (chunk_id % 100) / 100.0::DOUBLE AS s FROM chunks) c JOIN works w USING (work_id)"""))
def personal_boost(spark, sf_dir) -> DataFrame:
    s = F.col("chunk_id") % 100 / 100.0
    c = chunks(spark, sf_dir).join(works(spark, sf_dir).select("work_id", "title"), "work_id")
    return c.select("chunk_id", F.when(F.col("source_class") == "personal", F.least(s * 1.3, F.lit(1.0))).otherwise(s).alias("boosted"), "title")


@query("""SELECT p_partkey, '{"name":"'||p_name||'","size":'||p_size||'}' AS js FROM part""")
def json_output(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("js"))
