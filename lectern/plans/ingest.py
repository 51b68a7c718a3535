"""Queries of ingestion: parsers over stored bytes, write order, links on demand, terms, audits and context text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion
from ..operators import ingest as I
from ..operators import surfacing as S
from ..schema import ENTITY_EDGES
from ..sources import files
from ..tables import chunks, edges, load, vectors, with_views, works
from .reading import _WC, _pack_sql
from .registry import query
from .scalars import _section_sql

_CHAPTER = "(?i)(" + "|".join(T.CHAPTER_LINES) + ")"
_CAPITALS = r"[IVXLCDM]+\.?|[A-Z][A-Z\s0-9:.,!?\-—–]{2,80}"
_BLOCKS = rf"""b AS (SELECT doc_id, pos, block, CASE WHEN regexp_full_match(block, '{_CHAPTER}') THEN 'chapter' WHEN regexp_full_match(block, '{_CAPITALS}') THEN 'section' ELSE 'paragraph' END AS kind
  FROM (SELECT doc_id, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS l FROM documents)))"""


def as_files(frame: DataFrame, key: str, content, extension: str) -> DataFrame:
    """Stored rows as files: path and bytes."""
    return frame.select(F.concat(F.col(key).cast("string"), F.lit(f".{extension}")).alias("path"), content.alias("content"))


def summed(books: DataFrame) -> DataFrame:
    """id of the file, nodes by type, and a digest of all texts in order, of a row a file."""
    key = F.split_part("doc_id", F.lit("."), F.lit(1)).cast("long").alias("id")
    count = lambda k: F.size(F.filter("nodes", lambda n: n["node_type"] == k)).cast("long").alias(f"{k}s")
    return books.select(key, *map(count, ("chapter", "section", "paragraph")), F.md5(F.array_join(F.transform("nodes", lambda n: n["text"]), "|")).alias("texts"))


@query(f"""WITH {_BLOCKS} SELECT d.doc_id AS id, count(*) FILTER (kind = 'chapter') AS chapters, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (kind = 'paragraph') AS paragraphs, md5(concat_ws('|', '', string_agg(block, '|' ORDER BY pos))) AS texts FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id""")
def parse_text_files(spark, sf_dir) -> DataFrame:
    """Every document's bytes as a plain text file through the parser."""
    d = load(spark, sf_dir, "documents")
    return summed(files.parsed(as_files(d, "doc_id", F.encode("text", "UTF-8"), "txt")))


def _book(extension: str):
    """Arrow function that makes an EPUB or DOCX file of each text, a paragraph for each line that is not blank."""

    def epub(lines: list[str], out: zipfile.ZipFile) -> None:
        out.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        out.writestr("o/c.opf", '<p:package xmlns:p="x" xmlns:d="http://purl.org/dc/elements/1.1/"><p:metadata><d:title>Made</d:title></p:metadata><p:manifest><p:item id="a" href="a.html"/></p:manifest><p:spine><p:itemref idref="a"/></p:spine></p:package>')
        out.writestr("o/a.html", "<body><h1>One</h1>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "</body>")

    def docx(lines: list[str], out: zipfile.ZipFile) -> None:
        p = lambda x, style="": f"<w:p>{style}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
        out.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + p("One", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + "".join(map(p, lines)) + "</w:body></w:document>")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch["text"]:
                lines = [" ".join(x.split()) for x in (text or "").split("\n")]
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    (epub if extension == "epub" else docx)([x for x in lines if x], z)
                made.append(buffer.getvalue())
            yield pd.DataFrame({"path": [f"{i}.{extension}" for i in batch["doc_id"]], "content": made})

    return work


_MADE = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM l)
  SELECT d.doc_id AS id, 1 AS chapters, 0 AS sections, count(k.line) AS paragraphs, md5(concat_ws('|', '{title}', 'One', string_agg(k.line, '|' ORDER BY i))) AS texts FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.line <> '' GROUP BY d.doc_id"""


@query(_MADE.replace("{title}", "Made"))
def parse_epub_files(spark, sf_dir) -> DataFrame:
    """Every document made into an EPUB file and parsed again."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return summed(files.parsed(d.mapInPandas(_book("epub"), "path string, content binary")))


@query(_MADE.replace("{title}", ""))
def parse_docx_files(spark, sf_dir) -> DataFrame:
    """Every document made into a DOCX file and parsed again."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return summed(files.parsed(d.mapInPandas(_book("docx"), "path string, content binary")))


@query()
def parse_html_files(spark, sf_dir) -> DataFrame:
    """Every stored page's bytes through the HTML parser; the tests hold its titles and texts against plain rules."""
    p = load(spark, sf_dir, "pages")
    return summed(files.parsed(as_files(p, "page_id", F.encode("html", "UTF-8"), "html")))


@query(with_views("chunks", """SELECT work_id, chunk_id, row_number() OVER (PARTITION BY work_id ORDER BY CASE granularity WHEN 'macro' THEN 0 WHEN 'meso' THEN 1 WHEN 'micro' THEN 2 WHEN 'nano' THEN 3 ELSE 9 END, position, chunk_id) - 1 AS written FROM chunks"""))
def passage_write_order(spark, sf_dir) -> DataFrame:
    return I.write_order(chunks(spark, sf_dir).select("work_id", "chunk_id", "granularity", "position")).select("work_id", "chunk_id", "written")


@query(rf"""WITH RECURSIVE {_BLOCKS}, p AS (SELECT doc_id, pos, {_WC.format('block')}::BIGINT AS words FROM b WHERE kind = 'paragraph' AND ({_section_sql('block')}) IS NULL), {_pack_sql('p', 'doc_id', I.MESO_WORDS)},
  m AS (SELECT doc_id, count(DISTINCT pack) AS meso FROM s GROUP BY doc_id), t AS (SELECT doc_id, sum(words)::BIGINT AS words, count(*) FILTER (words >= {I.MICRO_WORDS}) AS micro FROM p GROUP BY doc_id), v AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings)
  SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS macro, coalesce(meso, 0) AS meso, coalesce(micro, 0) AS micro, coalesce(words, 0) AS words, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 - (v.doc_id IS NOT NULL)::INT + meso + micro END AS to_embed,
    CASE WHEN t.doc_id IS NULL THEN 'empty' WHEN 1 - (v.doc_id IS NOT NULL)::INT + meso + micro > 0 THEN 'embed' ELSE 'done' END AS status FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN v USING (doc_id)""")
def full_ingestion(spark, sf_dir) -> DataFrame:
    """Every document through parsing, typing, chunking and the plan of what is to be embedded."""
    known = vectors(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), F.lit("macro").alias("granularity"), F.lit(0).cast("long").alias("position")).distinct()
    return I.ingested(load(spark, sf_dir, "documents").select("doc_id", "text"), known)


@query(r"""WITH d AS (SELECT regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS t FROM documents UNION ALL SELECT regexp_replace(html, '[^\x00-\x7F]', '_', 'g') FROM pages),
  c AS (SELECT unnest(regexp_extract_all(t, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b', 1)) AS term FROM d), q AS (SELECT trim(unnest(regexp_extract_all(t, '[''"]([A-Za-z][A-Za-z\s]{2,40})[''"]', 1))) AS term FROM d),
  a AS (SELECT term FROM c WHERE regexp_extract(term, '^(\S+)', 1) NOT IN ('The', 'This', 'That', 'These', 'Those', 'In', 'On', 'At') UNION ALL SELECT term FROM q WHERE len(regexp_split_to_array(term, '\s+')) <= 5)
  SELECT term, count(*) AS n FROM a GROUP BY term HAVING count(*) >= 2""")
def candidate_terms(spark, sf_dir) -> DataFrame:
    texts = load(spark, sf_dir, "documents").select("text").unionByName(load(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return I.candidate_terms(texts)


@query(with_views("chunks edges", """SELECT y.work_id AS target_work, count(*) AS connections, count(*) FILTER (score > 0.8 OR confidence = 'high') AS high, count(*) FILTER (NOT (score > 0.8 OR confidence = 'high') AND (score > 0.5 OR confidence = 'medium')) AS medium, count(DISTINCT x.work_id) AS from_works
  FROM edges JOIN chunks x ON x.chunk_id::VARCHAR = src JOIN chunks y ON y.chunk_id::VARCHAR = dst WHERE type = 'ENGAGES_WITH' AND x.work_id <> y.work_id GROUP BY y.work_id"""))
def connections_by_target(spark, sf_dir) -> DataFrame:
    """Links between works grouped by the work they lead to, with their tiers."""
    own = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("src"), "work_id")
    e = edges(spark, sf_dir).filter("type = 'ENGAGES_WITH'").join(own, "src").join(own.select(F.col("src").alias("dst"), F.col("work_id").alias("target_work")), "dst").filter("work_id <> target_work")
    level = S.tier(F.lit("passage_link"), F.col("score"), F.col("confidence"))
    return e.withColumn("level", level).groupBy("target_work").agg(F.count(F.lit(1)).alias("connections"), F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "medium").alias("medium"), F.countDistinct("work_id").alias("from_works"))


@query(with_views("works chunks edges", """SELECT x.work_id, y.work_id AS counterpart, any_value(w.title) AS title, count(*) AS reference_count, TRUE AS in_library FROM edges JOIN chunks x ON x.chunk_id::VARCHAR = src JOIN chunks y ON y.chunk_id::VARCHAR = dst JOIN works w ON w.work_id = y.work_id
  WHERE type IN ('ENGAGES_WITH','THEMATIC_PARALLEL') AND x.work_id <> y.work_id GROUP BY x.work_id, y.work_id"""))
def counterpart_references(spark, sf_dir) -> DataFrame:
    """How often each work's passages refer to each counterpart work, with its title."""
    own = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("src"), "work_id")
    e = edges(spark, sf_dir).filter(F.col("type").isin("ENGAGES_WITH", "THEMATIC_PARALLEL")).select("src", "dst")
    pairs = e.join(own, "src").join(own.select(F.col("src").alias("dst"), F.col("work_id").alias("counterpart")), "dst").filter("work_id <> counterpart").groupBy("work_id", "counterpart").agg(F.count(F.lit(1)).alias("reference_count"))
    return pairs.join(works(spark, sf_dir).select(F.col("work_id").alias("counterpart"), "title"), "counterpart").select("work_id", "counterpart", "title", "reference_count", F.lit(True).alias("in_library"))


@query(with_views("chunks edges", """SELECT work_id, n, linked, work_id||' ('||round(100.0 * linked / n)::INT||'%)' AS line FROM (SELECT work_id, count(*) AS n, count(s.src) AS linked FROM chunks LEFT JOIN (SELECT DISTINCT src FROM edges WHERE type IN ('EXPLORES_THEME','MAKES_ARGUMENT','ATTRIBUTED_BY_CRITIC','CONCEPT_USED_IN','REFERENCES_PERSON')) s ON s.src = chunk_id::VARCHAR GROUP BY work_id) WHERE linked < 0.9 * n"""))
def coverage_below(spark, sf_dir) -> DataFrame:
    """Works under nine tenths of whose passages have an entity."""
    linked = edges(spark, sf_dir).filter(F.col("type").isin(*ENTITY_EDGES)).select(F.col("src").try_cast("long").alias("chunk_id")).distinct().withColumn("linked", F.lit(1))
    w = chunks(spark, sf_dir).select("chunk_id", "work_id").join(linked, "chunk_id", "left").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count("linked").alias("linked")).filter("linked < 0.9 * n")
    return w.select("work_id", "n", "linked", F.format_string("%s (%d%%)", "work_id", F.round(100.0 * F.col("linked") / F.col("n")).cast("int")).alias("line"))


@query(r"""SELECT conv_id, turn, md5(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) AS words, len(list_distinct(w)) AS n FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)""")
def ordered_distinct(spark, sf_dir) -> DataFrame:
    """The distinct words of every turn in the order they first come."""
    w = F.array_distinct(T.tokens(F.col("text")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(w, " ")).alias("words"), F.size(w).cast("long").alias("n"))


@query(with_views("works", """SELECT work_id, 'checked' AS state, json_extract_string(source_metadata, '$.slug')||'!' AS slug, json_extract_string(source_metadata, '$.classification_confidence')::DOUBLE AS confidence FROM works"""))
def metadata_set(spark, sf_dir) -> DataFrame:
    """Stored metadata with one new entry and one changed; the others stay."""
    w = works(spark, sf_dir).select("work_id", "source_metadata", F.concat(F.get_json_object("source_metadata", "$.slug"), F.lit("!")).alias("s"))
    made = w.withColumn("m", I.json_set(I.json_set(F.col("source_metadata"), "state", F.lit("checked")), "slug", F.col("s")))
    return made.select("work_id", F.get_json_object("m", "$.state").alias("state"), F.get_json_object("m", "$.slug").alias("slug"), F.get_json_object("m", "$.classification_confidence").cast("double").alias("confidence"))


@query(with_views("chunks edges", """WITH $ e AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'EXPLORES_THEME'), a AS (SELECT dst, work_id, count(*) AS n FROM e JOIN chunks ON src = chunk_id::VARCHAR GROUP BY ALL), r AS (SELECT dst, 'In '||work_id||': '||n||' passages' AS line, row_number() OVER (PARTITION BY dst ORDER BY n DESC, work_id) AS rn FROM a),
  k AS (SELECT DISTINCT x.dst, y.dst AS other FROM (SELECT DISTINCT dst, work_id FROM a) x JOIN (SELECT DISTINCT dst, work_id FROM a) y USING (work_id) WHERE x.dst <> y.dst), l AS (SELECT dst, string_agg(other, ', ' ORDER BY other) AS others FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY other) AS rn FROM k) WHERE rn <= 5 GROUP BY dst)
  SELECT dst AS theme, 'Theme: '||dst||chr(10)||'  Author''s stance: '||(SELECT count(*) FROM a z WHERE z.dst = r.dst)||' works'||chr(10)||string_agg('  '||line, chr(10) ORDER BY rn)||CASE WHEN any_value(others) IS NULL THEN '' ELSE chr(10)||'  Related themes: '||any_value(others) END AS summary FROM r LEFT JOIN l USING (dst) WHERE rn <= 3 GROUP BY dst"""))
def theme_context(spark, sf_dir) -> DataFrame:
    """Each theme's summary text: its works by passages, and themes that share a work with it."""
    e = edges(spark, sf_dir).filter("type = 'EXPLORES_THEME'").select(F.col("src").try_cast("long").alias("chunk_id"), "dst").distinct()
    a = e.join(chunks(spark, sf_dir).select("chunk_id", "work_id"), "chunk_id").groupBy("dst", "work_id").agg(F.count(F.lit(1)).alias("n"))
    first = fusion.top_per_group(a, ["dst"], [F.desc("n"), "work_id"], 3)
    shown = first.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "work_id", "n"))), lambda x: F.struct(x["work_id"].alias("work_id"), F.concat(x["n"].cast("string"), F.lit(" passages")).alias("summary"))).alias("appearances"))
    # A theme meets the themes of its works; each pair of themes comes once a work, then once.
    pairs = a.select("dst", "work_id").join(a.select(F.col("dst").alias("other"), "work_id"), "work_id").filter("dst <> other").select("dst", "other").distinct()
    related = fusion.top_per_group(pairs, ["dst"], ["other"], 5).groupBy("dst").agg(F.array_sort(F.collect_list("other")).alias("related"))
    total = a.groupBy("dst").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" works")).alias("stance"))
    joined = total.join(shown, "dst").join(related, "dst", "left")
    return joined.select(F.col("dst").alias("theme"), I.theme_summary(F.col("dst"), F.col("stance"), F.col("appearances"), F.coalesce("related", F.array().cast("array<string>"))).alias("summary"))


@query(with_views("chunks edges", """SELECT chunk_id, md5('['||upper(source_class)||'] ['||work_id||']'||coalesce(' (via '||e.type||', confidence='||e.confidence||')', '')||chr(10)||text) AS passage, '['||work_id||']' AS citation FROM chunks LEFT JOIN (SELECT dst, min(type) AS type, min(confidence) AS confidence FROM edges WHERE type = 'ENGAGES_WITH' GROUP BY dst) e ON e.dst = chunk_id::VARCHAR"""))
def passage_context(spark, sf_dir) -> DataFrame:
    """Every passage as it goes into a context, with its header and citation."""
    e = edges(spark, sf_dir).filter("type = 'ENGAGES_WITH'").groupBy(F.col("dst").try_cast("long").alias("chunk_id")).agg(F.min("type").alias("type"), F.min("confidence").alias("confidence"))
    c = chunks(spark, sf_dir).join(e, "chunk_id", "left")
    via = F.when(F.col("type").isNotNull(), F.concat("type", F.lit(", confidence="), "confidence"))
    return c.select("chunk_id", F.md5(I.passage_text(F.col("text"), F.col("work_id"), F.col("source_class"), via)).alias("passage"), F.concat(F.lit("["), "work_id", F.lit("]")).alias("citation"))


@query(with_views("chunks edges", """WITH $ l AS (SELECT CASE WHEN type = 'THEMATIC_PARALLEL' THEN 'thematic' WHEN confidence = 'high' THEN 'explicit' ELSE 'implicit' END AS scan, src, dst, CASE WHEN type = 'THEMATIC_PARALLEL' THEN score ELSE CASE confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.7 ELSE 0.4 END END::DOUBLE AS score FROM edges WHERE type IN ('ENGAGES_WITH','THEMATIC_PARALLEL')),
  b AS (SELECT scan, score, x.work_id AS f, y.work_id AS t FROM l JOIN chunks x ON x.chunk_id::VARCHAR = src JOIN chunks y ON y.chunk_id::VARCHAR = dst WHERE x.work_id <> y.work_id AND score >= 0.5 AND scan IN ('explicit','implicit','thematic'))
  SELECT work_id, scan, direction, count(*) AS links, max(score) AS best FROM (SELECT f AS work_id, scan, 'forward' AS direction, score FROM b UNION ALL SELECT t, scan, 'retroactive', score FROM b) GROUP BY ALL"""))
def links_on_demand(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir).filter(F.col("type").isin("ENGAGES_WITH", "THEMATIC_PARALLEL"))
    parallel = F.col("type") == "THEMATIC_PARALLEL"
    scan = F.when(parallel, "thematic").when(F.col("confidence") == "high", "explicit").otherwise("implicit")
    score = F.when(parallel, F.col("score")).otherwise(F.create_map(*[F.lit(x) for p in I.TIER_SCORES.items() for x in p])[F.col("confidence")])
    own = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("src"), F.col("work_id").alias("owner"))
    return I.links_on_demand(e.select(scan.alias("scan"), "src", "dst", score.alias("score")), own, ("explicit", "implicit", "thematic"), 0.5)


@query("""SELECT p_partkey, p_name||CASE WHEN starts_with(lower(p_type), 'and ') THEN ' ' ELSE ': ' END||p_type AS title, p_name AS bare FROM part""")
def alt_titles(spark, sf_dir) -> DataFrame:
    """Stored names and types as labelled alternative texts, and the titles read from them."""
    alt = F.concat(F.lit("Book title, "), "p_name", F.lit(", subtitle, "), "p_type", F.lit(", author, "), "p_brand")
    bare = F.concat(F.lit("author, "), "p_brand", F.lit(", title, "), "p_name", F.lit(", imprint, x"))
    return load(spark, sf_dir, "part").select("p_partkey", I.title_of_alt(alt).alias("title"), I.title_of_alt(bare).alias("bare"))


@query(r"""WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS title, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents), e AS (SELECT *, lower(trim(title)) AS low, list_sum([length(trim(x)) FOR x IN ls]) / len(ls) AS width FROM d)
  SELECT doc_id, CASE WHEN low IN ('title page', 'dedication', 'contents', 'copyright', 'also by', 'about the author', 'acknowledgments') OR regexp_matches(low, '^(acknowledgments|about the author|also by|copyright|notes)') THEN 'skip' WHEN regexp_full_match(trim(title), '[0-9]+\s+.+') THEN 'chapter_intro'
    WHEN low IN ('introduction', 'preface', 'foreword', 'afterword', 'epilogue', 'prologue') OR (length(text) > 3000 AND len(ls) > 0 AND (width > 60 OR words > 1500)) THEN 'essay' ELSE 'poem' END AS kind FROM e""")
def poetry_entries(spark, sf_dir) -> DataFrame:
    """Every document as an entry of a poetry book, its first line being the title."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", I.entry_kind(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")).alias("kind"))


@query(with_views("chunks edges", """SELECT type, dst, count(*) AS n FROM (SELECT src, type, dst FROM edges WHERE type <> 'EXPLORES_THEME' UNION ALL SELECT DISTINCT doc_id::VARCHAR, 'EXPLORES_THEME', 'quality-'||quality FROM labels WHERE doc_id IN (SELECT chunk_id FROM chunks)) GROUP BY ALL"""))
def theme_restore(spark, sf_dir) -> DataFrame:
    """The graph with its themes taken from a backup, which here are the stored labels; edges of passages that are gone stay out."""
    saved = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("src"), F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("dst"))
    live = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("key"))
    out = I.restored(edges(spark, sf_dir), "EXPLORES_THEME", saved.select(F.col("dst").alias("key")), saved, live)
    return out.groupBy("type", "dst").agg(F.count(F.lit(1)).alias("n"))
