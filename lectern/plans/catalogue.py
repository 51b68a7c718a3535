"""Cataloguing, entities, expansions and the offline stand-ins for model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import word_count
from ..operators import catalogue as C
from ..operators import graph as G
from ..operators.chunking import paragraph_rows
from ..operators.fusion import packed
from ..operators.search import vector_search
from ..tables import chunks, edges, load, vectors, with_views, works
from .reading import _PARAS, _WC, _pack_sql, docs
from .registry import query


@query("SELECT item_id, " + C.question_type_sql("text") + " AS kind FROM benchmark")
def question_types(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", C.question_type(F.col("text")).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN contains(t, 'letters') THEN 'letters' WHEN contains(t, 'sermon') THEN 'sermon' WHEN contains(t, 'poem') THEN 'poetry' WHEN contains(t, 'interview') THEN 'interview' WHEN contains(t, 'essay') THEN 'essay' ELSE 'prose' END AS kind FROM (SELECT p_partkey, lower(p_name||' '||p_type) AS t FROM part)""")
def work_types(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", C.work_type(F.concat_ws(" ", "p_name", "p_type")).alias("kind"))


@query(with_views("chunks", r"""WITH $ x AS (SELECT chunk_id, split_part(text, chr(10), 1) AS heading, regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g') AS t FROM chunks)
  SELECT chunk_id, CASE WHEN NOT regexp_matches(heading, '(?i)introduction|foreword|editor|translator|about the author|afterword') THEN 'own' WHEN regexp_matches(t, '\b(i|my|me|mine)\b') THEN 'mixed' ELSE 'editorial' END AS authorship FROM x"""))
def mixed_authorship(spark, sf_dir) -> DataFrame:
    """By the first line of each stored passage and the persons of its text."""
    return chunks(spark, sf_dir).select("chunk_id", C.authorship(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")).alias("authorship"))


@query("""WITH x AS (SELECT doc_id::VARCHAR AS src, doc_id % 6 AS k, lang, source FROM documents), e AS (SELECT src, 'EXPLORES_THEME' AS type, source AS dst FROM x UNION ALL SELECT src, 'CONCEPT_USED_IN', lang||'-'||source FROM x UNION ALL SELECT src, 'REFERENCES_PERSON', 'author-'||lang FROM x
  UNION ALL SELECT src, 'MAKES_ARGUMENT', source||'-in-'||lang FROM x WHERE k = 0 UNION ALL SELECT src, 'ATTRIBUTED_BY_CRITIC', source||'-in-'||lang FROM x WHERE k = 1) SELECT DISTINCT * FROM e""")
def entity_persistence(spark, sf_dir) -> DataFrame:
    """Edges of the entities that the stored columns name."""
    one = lambda *parts: F.array(F.concat(*parts), F.lit(" "))
    c = chunks(spark, sf_dir).select("chunk_id", "source_class").join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source"), "chunk_id")
    x = c.select(F.col("chunk_id").cast("string").alias("chunk"), "source_class", one(F.lit(" "), F.initcap("source"), F.lit(" ")).alias("themes"), one("source", F.lit(" in "), "lang").alias("arguments"), one("lang", F.lit(" "), F.upper("source")).alias("concepts"), one(F.lit("Author "), "lang").alias("persons"))
    return C.entity_edges(x)


@query(with_views("edges", """WITH $ s AS (SELECT DISTINCT src AS node FROM edges WHERE type = 'EXPLORES_THEME' AND dst = 'theme-1'), a AS (SELECT DISTINCT dst AS node, 0 AS m FROM edges JOIN s ON src = node WHERE type = 'ENGAGES_WITH'),
  b AS (SELECT DISTINCT y.src AS node, 1 AS m FROM edges x JOIN s ON x.src = s.node JOIN edges y ON y.dst = x.dst AND y.type = 'CONCEPT_USED_IN' WHERE x.type = 'CONCEPT_USED_IN'), c AS (SELECT DISTINCT y.src AS node, 2 AS m FROM edges x JOIN s ON x.src = s.node JOIN edges y ON y.dst = x.dst AND y.type = 'MAKES_ARGUMENT' WHERE x.type = 'MAKES_ARGUMENT')
  SELECT node, min(m)::INT AS method FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE node NOT IN (SELECT node FROM s) GROUP BY node"""))
def graph_expansion(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).select("src", "type", "dst")
    links = e.filter("type = 'ENGAGES_WITH'")
    seeds = e.filter("type = 'EXPLORES_THEME' and dst = 'theme-1'").select(F.col("src").alias("node")).distinct()

    def through(kind: str) -> DataFrame:
        k = e.filter(F.col("type") == kind).select("src", "dst")
        return k.join(seeds, F.col("src") == F.col("node"), "left_semi").select("dst").distinct().join(k, "dst").select(F.col("src").alias("node")).distinct()

    direct = links.join(seeds, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
    return C.expansions([direct, through("CONCEPT_USED_IN"), through("MAKES_ARGUMENT")], seeds)


@query(f"""WITH RECURSIVE {_PARAS}, t AS (SELECT doc_id, sum(words)::BIGINT AS words FROM p GROUP BY doc_id), l AS (SELECT p.* FROM p JOIN t USING (doc_id) WHERE t.words > 300), {_pack_sql('l', 'doc_id', 120)}
  SELECT doc_id, 'meso' AS granularity, 0 AS position, words FROM t WHERE words <= 300 UNION ALL SELECT doc_id, 'meso', pack, sum(words)::BIGINT FROM s GROUP BY doc_id, pack UNION ALL SELECT doc_id, 'micro', pos, words FROM l WHERE words >= 30""")
def chunk_essays(spark, sf_dir) -> DataFrame:
    return C.essays(docs(spark, sf_dir), 300, 120, 30).withColumn("position", F.col("position").cast("long"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS q FROM conversations)
  SELECT conv_id AS doc_id, (q - 1)::INT AS pair, md5(max(text) FILTER (role = 'user')) AS question, md5(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'user')) AS answer FROM t WHERE q > 0 GROUP BY conv_id, q HAVING count(*) FILTER (role <> 'user') > 0""")
def labelled_interviews(spark, sf_dir) -> DataFrame:
    """Stored conversations written out with Q: and A: labels and read again."""
    line = F.concat(F.when(F.col("role") == "user", F.lit("Q: ")).otherwise(F.lit("A: ")), F.trim(F.regexp_replace("text", r"\s+", " ")))
    text = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    found = C.labelled_answers(text.select(F.col("conv_id").alias("doc_id"), "text"))
    return found.select("doc_id", "pair", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(with_views("chunks", """WITH $ x AS (SELECT *, last_value(CASE WHEN granularity = 'macro' THEN chunk_id END IGNORE NULLS) OVER w AS ma, last_value(CASE WHEN granularity = 'meso' THEN chunk_id END IGNORE NULLS) OVER w AS me FROM chunks WINDOW w AS (PARTITION BY work_id ORDER BY position ROWS UNBOUNDED PRECEDING))
  SELECT chunk_id, CASE granularity WHEN 'meso' THEN ma WHEN 'macro' THEN NULL ELSE coalesce(me, ma) END AS parent FROM x"""))
def parent_passages(spark, sf_dir) -> DataFrame:
    return C.parents(chunks(spark, sf_dir).select("chunk_id", "work_id", "granularity", "position"))


@query(with_views("chunks", r"""WITH $ w AS (SELECT work_id AS grp, unnest(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g'), '\b([a-z]{4,})\b', 1)) AS term FROM chunks), t AS (SELECT grp, term, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
  s AS (SELECT grp, term, tf, round(tf * (1 - df / (SELECT count(DISTINCT grp) FROM t)), 6) AS score FROM t JOIN d USING (term)) SELECT grp AS "group", term, tf, score FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) <= 5"""))
def distinctive_terms(spark, sf_dir) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{4,})\b"), F.lit(1)))
    return C.distinctive_terms(chunks(spark, sf_dir).select(F.col("work_id").alias("group"), words.alias("term")))


@query(with_views("chunks", r"""SELECT work_id, round(sum(length(regexp_replace(text, '\s+', '', 'g'))) / sum(""" + _WC.format("text") + r"""), 4) AS word_length, round(sum(""" + _WC.format("text") + r""") / sum(greatest(1, len(regexp_extract_all(text, '[.!?]')))), 4) AS sentence_length, sum(len(regexp_extract_all(text, '[?]')))::BIGINT AS questions FROM chunks GROUP BY work_id"""))
def voice_style(spark, sf_dir) -> DataFrame:
    return C.style(chunks(spark, sf_dir))


@query(with_views("chunks", """SELECT work_id, string_agg('['||n||'] '||left(replace(text, chr(10), ' '), 40), chr(10) ORDER BY n) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY position) AS n FROM chunks) WHERE n <= 3 GROUP BY work_id"""))
def numbered_samples(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).select("work_id", "position", F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(40)).alias("head"))
    return C.numbered(c, "work_id", "position", "head", 3)


@query(with_views("works chunks", """SELECT w.work_id, w.title, count(*) AS passages, count(*) FILTER (chunk_id NOT IN (SELECT vec_id FROM embeddings)) AS unembedded, string_agg(DISTINCT granularity, ', ' ORDER BY granularity) AS levels, coalesce(any_value(publication_year)::VARCHAR, 'undated') AS year FROM works w JOIN chunks c USING (work_id) GROUP BY ALL"""))
def ingestion_report(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", F.lit(1).alias("v"))
    c = chunks(spark, sf_dir).select("chunk_id", "work_id", "granularity").join(v, "chunk_id", "left").groupBy("work_id").agg(F.count(F.lit(1)).alias("passages"), F.count_if(F.col("v").isNull()).alias("unembedded"), F.array_join(F.array_sort(F.collect_set("granularity")), ", ").alias("levels"))
    w = works(spark, sf_dir).select("work_id", "title", F.coalesce(F.col("publication_year").cast("string"), F.lit("undated")).alias("year"))
    return w.join(c, "work_id").select("work_id", "title", "passages", "unembedded", "levels", "year")


@query(with_views("chunks", """SELECT work_id, pass_number, count(*) AS n, 'Pass '||pass_number||': '||count(*)||' captures in '||count(DISTINCT chapter)||' chapters' AS line FROM chunks GROUP BY work_id, pass_number"""))
def delta_presentation(spark, sf_dir) -> DataFrame:
    g = chunks(spark, sf_dir).groupBy("work_id", "pass_number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chapter").alias("chapters"))
    return g.select("work_id", "pass_number", "n", F.format_string("Pass %d: %d captures in %d chapters", "pass_number", "n", "chapters").alias("line"))


@query(with_views("chunks edges", """WITH $ t1 AS (SELECT src, dst FROM edges WHERE type = 'ENGAGES_WITH' AND confidence = 'high'), t2 AS (SELECT src, dst FROM edges WHERE type = 'ENGAGES_WITH' AND confidence = 'medium'), t3 AS (SELECT src, dst FROM edges WHERE type = 'THEMATIC_PARALLEL')
  SELECT src, dst, 'high' AS tier FROM t1 UNION ALL SELECT src, dst, 'medium' FROM t2 WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.src = t2.src AND t1.dst = t2.dst) UNION ALL
  SELECT src, dst, 'low' FROM t3 WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) k WHERE (k.src = t3.src AND k.dst = t3.dst) OR (k.src = t3.dst AND k.dst = t3.src))"""))
def linker_tiers(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).select("type", "src", "dst", "confidence")
    first = e.filter("type = 'ENGAGES_WITH' and confidence = 'high'").select("src", "dst")
    second = e.filter("type = 'ENGAGES_WITH' and confidence = 'medium'").select("src", "dst").join(first, ["src", "dst"], "left_anti")
    third = e.filter("type = 'THEMATIC_PARALLEL'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    third = G.without_linked(third, first.unionByName(second)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = [p.withColumn("tier", F.lit(t)) for p, t in ((first, "high"), (second, "medium"), (third, "low"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_views("chunks", """SELECT work_id, coalesce(max(position), -1) + 1 AS next_position, coalesce(max(pass_number), 0) + 1 AS next_pass, 'personal' AS source_class FROM chunks WHERE source_class <> 'tertiary' GROUP BY work_id"""))
def next_position(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).filter("source_class <> 'tertiary'")
    return c.groupBy("work_id").agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position"), (F.coalesce(F.max("pass_number"), F.lit(0)) + 1).alias("next_pass"), F.lit("personal").alias("source_class"))


@query(with_views("works", """SELECT work_id, coalesce(nullif(json_extract_string(source_metadata, '$.subject'), ''), nullif(json_extract_string(source_metadata, '$.slug'), ''), author) AS subject, upper(split_part(author, '-', 2)[1:1])||split_part(author, '-', 2)[2:] AS name FROM works"""))
def annotation_context(spark, sf_dir) -> DataFrame:
    field = lambda n: F.nullif(F.get_json_object("source_metadata", f"$.{n}"), F.lit(""))
    return works(spark, sf_dir).select("work_id", F.coalesce(field("subject"), field("slug"), F.col("author")).alias("subject"), F.initcap(F.split_part("author", F.lit("-"), F.lit(2))).alias("name"))


@query(f"""WITH {_PARAS}, c AS (SELECT doc_id, pos, words, trim(para) AS para, words <= 2 AS head FROM p) SELECT doc_id, count(*) FILTER (head) AS headings, count(*) FILTER (NOT head) AS bodies, coalesce(sum(words) FILTER (NOT head), 0)::BIGINT AS words FROM c GROUP BY doc_id""")
def chapter_list(spark, sf_dir) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("para")).withColumn("words", word_count(F.col("para")))
    head = F.col("words") <= 2
    return rows.groupBy("doc_id").agg(F.count_if(head).alias("headings"), F.count_if(~head).alias("bodies"), F.coalesce(F.sum(F.when(~head, F.col("words"))), F.lit(0)).alias("words"))


@query(with_views("works chunks vectors", """SELECT rank() OVER (ORDER BY score DESC, chunk_id) AS n, chunk_id, score, title, coalesce(publication_year::VARCHAR, 'undated') AS year FROM (SELECT chunk_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE chunk_id = 0)), 6) AS score FROM vectors ORDER BY score DESC, chunk_id LIMIT 20) JOIN chunks USING (chunk_id) JOIN works USING (work_id)"""))
def answer_citations(spark, sf_dir) -> DataFrame:
    """The passages an answer would cite, in order, with their works; writing it is left to a model."""
    v = vectors(spark, sf_dir)
    found = vector_search(v, v.filter("chunk_id = 0").select(F.col("embedding").alias("query_vector")), 20, -1.0)
    joined = found.join(chunks(spark, sf_dir).select("chunk_id", "work_id"), "chunk_id").join(works(spark, sf_dir).select("work_id", "title", "publication_year"), "work_id")
    n = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("long")
    return joined.select(n.alias("n"), "chunk_id", "score", "title", F.coalesce(F.col("publication_year").cast("string"), F.lit("undated")).alias("year"))


@query(with_views("chunks", """SELECT count(*) AS reflections, count(DISTINCT work_id) AS works, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (chunk_id * 2 IN (SELECT chunk_id FROM chunks)) AS verified FROM chunks WHERE source_class = 'personal'"""))
def synthesis_summary(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir)
    known = c.select(F.col("chunk_id").alias("cited"), F.lit(1).alias("known"))
    own = c.filter("source_class = 'personal'").select("work_id", "day", (F.col("chunk_id") * 2).alias("cited")).join(known, "cited", "left")
    return own.agg(F.count(F.lit(1)).alias("reflections"), F.countDistinct("work_id").alias("works"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("known").alias("verified"))


@query(with_views("works", """SELECT work_id, CASE WHEN author = 'author-en' THEN 'primary' WHEN contains(title, '1') THEN 'secondary' WHEN list_contains(genre_tags, 'fiction') THEN 'contextual' ELSE 'reference' END AS class, CASE WHEN author = 'author-en' THEN 0.9 WHEN contains(title, '1') THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM works"""))
def source_classes(spark, sf_dir) -> DataFrame:
    """Classification by rules on author, title and tags: the offline stand-in of a model's."""
    own, about = F.col("author") == "author-en", F.col("title").contains("1")
    kind = F.when(own, "primary").when(about, "secondary").when(F.array_contains("genre_tags", "fiction"), "contextual").otherwise("reference")
    return works(spark, sf_dir).select("work_id", kind.alias("class"), F.when(own, 0.9).when(about, 0.7).otherwise(0.5).alias("confidence"))


@query(with_views("works chunks", """SELECT work_id, publication_year, n, chunk_id FROM (SELECT w.work_id, publication_year, chunk_id, row_number() OVER (PARTITION BY w.work_id ORDER BY position) AS n FROM works w JOIN chunks c USING (work_id) WHERE w.source_class = 'primary' AND publication_year IS NOT NULL) WHERE n <= 5"""))
def evolution_samples(spark, sf_dir) -> DataFrame:
    w = works(spark, sf_dir).filter("source_class = 'primary' and publication_year is not null").select("work_id", "publication_year")
    c = chunks(spark, sf_dir).select("work_id", "chunk_id", "position").join(w, "work_id")
    n = F.row_number().over(Window.partitionBy("work_id").orderBy("position")).cast("long")
    return c.withColumn("n", n).filter("n <= 5").select("work_id", "publication_year", "n", "chunk_id")


@query(with_views("chunks", """SELECT work_id, count(*) AS filled, 1.0::DOUBLE AS length FROM chunks WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings) AND length(text) >= 50 GROUP BY work_id"""))
def embedding_backfill(spark, sf_dir) -> DataFrame:
    missing = chunks(spark, sf_dir).select("chunk_id", "work_id", "text").join(vectors(spark, sf_dir).select("chunk_id"), "chunk_id", "left_anti").filter(F.length("text") >= 50)
    made = missing.select("work_id", V.embed(F.col("text")).alias("e"))
    return made.groupBy("work_id").agg(F.count(F.lit(1)).alias("filled"), F.round(F.avg(V.norm(F.col("e"))), 6).alias("length"))


@query(with_views("chunks", """SELECT work_id, coalesce(a, 0) AS stored, coalesce(b, 0) AS in_graph, coalesce(a, 0) = coalesce(b, 0) AS in_sync FROM (SELECT work_id, count(*) AS a FROM chunks WHERE chunk_id % 7 <> 0 GROUP BY 1) FULL JOIN (SELECT work_id, count(*) AS b FROM chunks JOIN embeddings ON vec_id = chunk_id GROUP BY 1) USING (work_id)"""))
def sync_diagnosis(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", "work_id")
    a = c.filter("chunk_id % 7 <> 0").groupBy("work_id").agg(F.count(F.lit(1)).alias("stored"))
    b = c.join(vectors(spark, sf_dir).select("chunk_id"), "chunk_id").groupBy("work_id").agg(F.count(F.lit(1)).alias("in_graph"))
    return a.join(b, "work_id", "full_outer").fillna(0, ["stored", "in_graph"]).withColumn("in_sync", F.col("stored") == F.col("in_graph"))


@query(f"""WITH RECURSIVE {_PARAS}, e AS (SELECT * FROM p WHERE doc_id % 2 = 1), {_pack_sql('e', 'doc_id', 250)}
  SELECT doc_id, 'macro' AS granularity, 0::BIGINT AS position, sum(words)::BIGINT AS words FROM p GROUP BY doc_id UNION ALL SELECT doc_id, 'meso', pack, sum(words)::BIGINT FROM s GROUP BY doc_id, pack UNION ALL SELECT doc_id, 'micro', pos, words FROM e WHERE words >= 15""")
def chunk_poetry_collection(spark, sf_dir) -> DataFrame:
    """Poems (even ids) and essays (odd) both whole; essays also packed and by paragraph."""
    rows = paragraph_rows(docs(spark, sf_dir))
    essays = rows.filter("doc_id % 2 = 1")
    zero = F.lit(0).cast("long").alias("position")
    macro = rows.groupBy("doc_id").agg(F.sum("words").alias("words")).select("doc_id", F.lit("macro").alias("granularity"), zero, "words")
    meso = essays.join(packed(essays, ["doc_id"], 250), ["doc_id", "pos"]).groupBy("doc_id", F.col("pack").cast("long").alias("position")).agg(F.sum("words").alias("words")).select("doc_id", F.lit("meso").alias("granularity"), "position", "words")
    micro = essays.filter("words >= 15").select("doc_id", F.lit("micro").alias("granularity"), F.col("pos").cast("long").alias("position"), "words")
    return macro.unionByName(meso).unionByName(micro)
