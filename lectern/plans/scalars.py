"""Scalar functions over the tables: text, names, dates, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue as C
from ..schema import LANGUAGES, ROUTES, STOP_WORDS, STRATEGIES, VAULT_FOLDERS
from ..tables import chunks, load, with_views, works
from .registry import query


def lit_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, len(regexp_split_to_array(text, '\s+')) AS pieces FROM documents")
def word_counts(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.size(F.split("text", r"\s+")).cast("long").alias("pieces"))


@query(r"""SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS context_tokens,
  greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.5))::BIGINT AS embedding_tokens FROM documents""")
def token_estimates(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.context_tokens(F.col("text")).alias("context_tokens"), T.embedding_tokens(F.col("text")).alias("embedding_tokens"))


@query(r"""SELECT p_partkey, slug, 'author-'||substr(sha256('!!!'), 1, 12) AS nothing_left FROM
  (SELECT p_partkey, left(replace(trim(regexp_replace(lower(p_name||' & '||p_type), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 128) AS slug FROM part)""")
def slugify_work_id(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", T.slugify(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"), T.slugify(F.lit("!!!")).alias("nothing_left"))


@query(r"""SELECT c_custkey, trim(c_name) AS as_is, 'First '||c_name AS turned, 'First '||c_name AS with_dates, 1900 + c_custkey % 100 AS year, NULL::INT AS no_year FROM
  (SELECT c_custkey, translate(c_name, '#0123456789', '-abcdefghij') AS c_name FROM customer)""")
def author_names(spark, sf_dir) -> DataFrame:
    name = F.translate("c_name", "#0123456789", "-abcdefghij")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", T.author_name(name).alias("as_is"), T.author_name(F.concat(name, F.lit(", First"))).alias("turned"),
        T.author_name(F.concat(name, F.lit(", First, 1850-1901"))).alias("with_dates"),
        T.year_of(F.concat((F.lit(1900) + F.col("c_custkey") % 100).cast("string"), F.lit("-05-01"))).cast("long").alias("year"), T.year_of(F.lit("n.d. 1900")).alias("no_year"))


@query(r"""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN trim(s_name) END AS publisher, left(replace(lower(s_name||' Press'), ' ', '-'), 12) AS capped, replace(lower(s_name||' Press'), ' ', '-') AS lookup FROM supplier""")
def publishers_and_keys(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, F.lit("Acrobat Distiller 9")).otherwise(F.concat(F.lit(" "), "s_name"))
    full = F.concat("s_name", F.lit(" Press"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", T.clean_publisher(name).alias("publisher"), T.canonical_key(full, 12).alias("capped"), T.canonical_key(full, None).alias("lookup"))


@query(r"""SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS plain, 'chunk-'||o_orderkey AS other, h[1:8]||'-'||h[9:12]||'-'||h[13:16]||'-'||h[17:20]||'-'||h[21:32] AS dashed FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders)""")
def chunk_ids(spark, sf_dir) -> DataFrame:
    hexa = F.md5(F.col("o_orderkey").cast("string"))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.plain_id(F.upper(T.dashed_id(hexa))).alias("plain"), T.plain_id(F.concat(F.lit("chunk-"), F.col("o_orderkey").cast("string"))).alias("other"), T.dashed_id(hexa).alias("dashed"))


@query(with_views("works", r"""SELECT work_id, regexp_full_match(work_id, '[a-z0-9]+(-[a-z0-9]+)*--[a-z0-9]+(-[a-z0-9]+)*') AND length(work_id) <= 128 AS valid, FALSE AS single_dash, split_part(work_id, '--', 1) AS author_part,
  upper(title[1:1])||lower(title[2:]) AS fallback_title, coalesce(publication_year::VARCHAR, 'undated') AS year_label FROM works"""))
def work_ids(spark, sf_dir) -> DataFrame:
    w = F.col("work_id")
    return works(spark, sf_dir).select("work_id", T.valid_work_id(w).alias("valid"), T.valid_work_id(F.replace(w, F.lit("--"), F.lit("-"))).alias("single_dash"), F.split_part(w, F.lit("--"), F.lit(1)).alias("author_part"), T.title_of_work(w).alias("fallback_title"), F.coalesce(F.col("publication_year").cast("string"), F.lit("undated")).alias("year_label"))


@query(r"""SELECT doc_id, lang AS plain, lang AS tagged, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' ELSE 'es' END AS three FROM documents""")
def language_codes(spark, sf_dir) -> DataFrame:
    three = lit_map({v: k for k, v in LANGUAGES.items()})
    return load(spark, sf_dir, "documents").select("doc_id", T.language_code(F.col("lang")).alias("plain"), T.language_code(F.concat(F.upper("lang"), F.lit("_XX"))).alias("tagged"), T.language_code(three[F.col("lang")]).alias("three"))


@query(r"SELECT doc_id, md5(regexp_replace(trim(lower(text)), '\s+', ' ', 'g')) AS fingerprint, left(text, 120) AS preview, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text) AS alnum FROM documents")
def fingerprints(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.fingerprint(t)).alias("fingerprint"), F.left(t, F.lit(120)).alias("preview"), T.alnum_ratio(t).alias("alnum"))


_MARK_SQL = "regexp_replace(text, '([.!?])\\s+([A-Z\"“])', '\\1' || chr(1) || '\\2', 'g')"


@query(f"SELECT doc_id, len(string_split({_MARK_SQL}, chr(1))) AS n, md5(string_split({_MARK_SQL}, chr(1))[1]) AS first FROM documents")
def sentence_split(spark, sf_dir) -> DataFrame:
    s = T.sentences(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.element_at(s, 1)).alias("first"))


_STOP_SQL = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query(f"""SELECT doc_id, len(t) AS n_terms, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id,
  list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7F]', '_', 'g'), '\\b([a-z][a-z-]*[a-z])\\b', 1)), lambda x: length(x) >= 4 AND NOT list_contains({_STOP_SQL}, x)) AS t
  FROM documents)""")
def term_extraction(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("t", T.terms(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("terms"))


@query(r"""WITH e AS (SELECT event_id, (epoch(date_trunc('second', ts))::BIGINT % 86400)::INT AS s FROM events), c AS (SELECT event_id, s, CASE WHEN s >= 3600 THEN printf('[%d:%02d:%02d]', s // 3600, s % 3600 // 60, s % 60) ELSE printf('[%d:%02d]', s // 60, s % 60) END AS stamp FROM e)
  SELECT event_id AS id, stamp, s AS parsed, NULL AS speaker FROM c UNION ALL
  SELECT conv_id, NULL, NULL, nullif(regexp_extract(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '^([A-Z][A-Za-z .''-]{0,40}):\s', 1), '') FROM conversations""")
def stamps_and_speakers(spark, sf_dir) -> DataFrame:
    """Times of day written as stamps and read again; speakers of the stored turns."""
    at = F.col("ts").cast("timestamp_ntz")
    s = (F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))).cast("int")
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.stamp(s).alias("stamp"))
    e = e.select("id", "stamp", T.stamp_seconds(F.concat_ws(" ", "stamp", F.lit("words"))).alias("parsed"), F.lit(None).cast("string").alias("speaker"))
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit(None).cast("string").alias("stamp"), T.stamp_seconds(F.col("text")).alias("parsed"), T.speaker_of(plain).alias("speaker"))
    return e.unionByName(c)


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, left(md5(url), 11) AS video,
  'video--'||left(md5(url), 11) AS video_key, 'media--'||left(sha256(url), 12) AS media_key, sha256('page|'||page_id||'|'||url) AS cache_key FROM pages""")
def url_parts(spark, sf_dir) -> DataFrame:
    watch = F.concat(F.lit("https://video.example/watch?list=a&v="), F.left(F.md5("url"), F.lit(11)))
    return load(spark, sf_dir, "pages").select(
        "page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"), T.video_id(watch).alias("video"),
        T.source_key(watch).alias("video_key"), T.source_key(F.col("url")).alias("media_key"), T.cache_key(F.lit("page"), F.lit(None).cast("string"), F.col("page_id").cast("string"), F.col("url")).alias("cache_key"))


def _section_sql(line: str) -> str:
    cases = " ".join(f"WHEN regexp_full_match(trim({line}), '(?i)({p.replace(chr(39), chr(39) * 2)})') THEN '{name}'" for name, p in T.SECTION_HEADINGS)
    return f"CASE {cases} END"


_SHARE_SQL = "len(list_filter(ls, lambda x: regexp_matches(x, '{}'))) / len(ls)"


@query(rf"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents),
  k AS (SELECT doc_id, count({_section_sql('line')}) AS typed, max({_section_sql('line')}) AS last_type, count(*) FILTER (regexp_full_match(trim(line), '(?i)({"|".join(T.CHAPTER_LINES)})')) AS chapters,
    count(*) FILTER (regexp_full_match(trim(line), '[IVXLCDM]+\.?') OR regexp_full_match(trim(line), '[A-Z][A-Z\s0-9:.,!?\-—–]{{2,80}}')) AS sections FROM l GROUP BY doc_id),
  c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
  SELECT doc_id, typed, last_type, chapters, sections, CASE WHEN len(ls) >= 5 AND {_SHARE_SQL.format(T.INDEX_LINE)} > 0.4 THEN 'index' WHEN len(ls) >= 3 AND {_SHARE_SQL.format(T.BIBLIOGRAPHY_LINE)} > 0.3 THEN 'bibliography' END AS by_content FROM k JOIN c USING (doc_id)""")
def section_types(spark, sf_dir) -> DataFrame:
    """Headings among the lines of every document, and its type by content."""
    line, d = F.col("line"), load(spark, sf_dir, "documents")
    kind = T.section_type(line)
    k = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count(kind).alias("typed"), F.max(kind).alias("last_type"), F.count_if(T.is_chapter_heading(line)).alias("chapters"), F.count_if(T.is_section_heading(line)).alias("sections"))
    return k.join(d.select("doc_id", T.section_type_by_content(F.col("text")).alias("by_content")), "doc_id")


@query(r"""SELECT 'document' AS kind, doc_id AS id, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b((?:[123] )?[A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}(?:-[0-9]{1,3})?)\b', 1))) AS refs FROM documents
  UNION ALL SELECT 'page', page_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(html, '[^\x00-\x7F]', '_', 'g'), '\b((?:[123] )?[A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}(?:-[0-9]{1,3})?)\b', 1))) FROM pages""")
def scripture_references(spark, sf_dir) -> DataFrame:
    refs = lambda c: F.array_sort(T.scripture_refs(F.regexp_replace(c, r"[^\x00-\x7F]", "_"))).alias("refs")
    d = load(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), refs("text"))
    return d.unionByName(load(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), refs("html")))


@query(with_views("works", """SELECT work_id, CASE source_class WHEN 'primary' THEN 'full_pipeline' WHEN 'secondary' THEN 'critical_pipeline' WHEN 'tertiary' THEN 'metadata_only' WHEN 'contextual' THEN 'context_pipeline' WHEN 'personal' THEN 'reflection_pipeline' ELSE 'lookup_pipeline' END AS route,
  coalesce(CASE num % 6 WHEN 0 THEN 'books' WHEN 1 THEN 'videos' WHEN 2 THEN 'audio' WHEN 3 THEN 'podcasts' WHEN 4 THEN 'articles' END, 'books') AS folder,
  CASE WHEN c < 0.7 AND source_class <> 'secondary' THEN 'secondary' ELSE source_class END AS safe_class, CASE WHEN c < 0.7 AND source_class <> 'secondary' THEN 'low confidence: rules' ELSE 'rules' END AS reasoning,
  round(c, 2) AS confidence FROM (SELECT *, json_extract_string(source_metadata, '$.classification_confidence')::DOUBLE AS c FROM works)"""))
def catalogue_labels(spark, sf_dir) -> DataFrame:
    w = works(spark, sf_dir).withColumn("c", F.get_json_object("source_metadata", "$.classification_confidence").cast("double"))
    media = F.element_at(F.array(*[F.lit(m) for m in (*VAULT_FOLDERS, "scroll")]), (F.col("num") % 6 + 1).cast("int"))
    low = (F.col("c") < 0.7) & (F.col("source_class") != "secondary")
    return w.select("work_id", lit_map(ROUTES)[F.col("source_class")].alias("route"), F.coalesce(lit_map(VAULT_FOLDERS)[media], F.lit("books")).alias("folder"), F.when(low, "secondary").otherwise(F.col("source_class")).alias("safe_class"), F.when(low, "low confidence: rules").otherwise("rules").alias("reasoning"), F.round("c", 2).alias("confidence"))


@query(with_views("works", """SELECT work_id, CASE source_class WHEN 'primary' THEN 'Primary text by '||author||', '||coalesce(publication_year::VARCHAR, 'undated') WHEN 'secondary' THEN 'Critical work on '||author WHEN 'contextual' THEN 'Context: '||title ELSE initial||title END AS annotation,
  '[VIDEO] ['||work_id||'] (via rules)' AS header, CASE WHEN list_has_any(genre_tags, ['poetry','sermon']) THEN 'short lines' ELSE 'prose' END AS form FROM (SELECT *, source_class||': ' AS initial FROM works)"""))
def annotation_templates(spark, sf_dir) -> DataFrame:
    kind = F.col("source_class")
    text = F.when(kind == "primary", F.concat(F.lit("Primary text by "), "author", F.lit(", "), F.coalesce(F.col("publication_year").cast("string"), F.lit("undated")))).when(kind == "secondary", F.concat(F.lit("Critical work on "), "author")).when(kind == "contextual", F.concat(F.lit("Context: "), "title")).otherwise(F.concat_ws(": ", kind, "title"))
    form = F.when(F.arrays_overlap("genre_tags", F.array(F.lit("poetry"), F.lit("sermon"))), "short lines").otherwise("prose")
    return works(spark, sf_dir).select("work_id", text.alias("annotation"), F.format_string("[%s] [%s] (via %s)", F.upper(F.lit("video")), "work_id", F.lit("rules")).alias("header"), form.alias("form"))


@query("""SELECT conv_id, turn, kind AS q, CASE kind WHEN 'thematic' THEN 20 WHEN 'generative' THEN 20 ELSE 15 END AS pass1_limit, CASE kind WHEN 'factual' THEN 5 ELSE 10 END AS pass3_limit,
  CASE kind WHEN 'factual' THEN 0.6 WHEN 'thematic' THEN 0.7 WHEN 'generative' THEN 0.8 ELSE 0.3 END::DOUBLE AS vector_weight, CASE kind WHEN 'factual' THEN 0.4 WHEN 'thematic' THEN 0.3 WHEN 'generative' THEN 0.2 ELSE 0.7 END::DOUBLE AS text_weight,
  CASE kind WHEN 'thematic' THEN 'macro' WHEN 'generative' THEN 'meso' ELSE 'micro' END AS granularity
  FROM (SELECT conv_id, turn, """ + C.question_type_sql("text") + """ AS kind FROM conversations WHERE role = 'user')""")
def question_strategies(spark, sf_dir) -> DataFrame:
    """Each stored question's type and the strategy that goes with it."""
    rows = spark.createDataFrame([(q, *v) for q, v in STRATEGIES.items()], "q string, pass1_limit int, pass3_limit int, vector_weight double, text_weight double, granularity string")
    asked = load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", C.question_type(F.col("text")).alias("q"))
    return asked.join(F.broadcast(rows), "q").select("conv_id", "turn", "q", "pass1_limit", "pass3_limit", "vector_weight", "text_weight", "granularity")


@query(r"""SELECT doc_id, md5(text) AS clean, length(text) AS n FROM documents""")
def sanitized_text(spark, sf_dir) -> DataFrame:
    """Whole texts that control characters were put into, cleaned; they come out as they were stored."""
    half = F.floor(F.length("text") / 2).cast("int")
    dirty = F.concat(F.lit("\x00"), F.substr(F.col("text"), F.lit(1), half), F.lit("\x07\x8f"), F.substr(F.col("text"), half + 1))
    clean = T.sanitize(dirty)
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean"), F.length(clean).cast("long").alias("n"))


@query(r"""WITH p AS (SELECT user_id, event_id, props, '{"k": '||json_extract_string(props, '$.k')||'}' AS ok FROM events) SELECT user_id, count(*) AS n, md5(string_agg(ok, '|' ORDER BY event_id)) AS parsed, md5(string_agg(ok, '|' ORDER BY event_id)) AS salvaged FROM p GROUP BY user_id""")
def json_repair(spark, sf_dir) -> DataFrame:
    """The stored properties, read from prose around them, and as an array that was cut off."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "props")
    each = e.withColumn("ok", T.json_in_prose(F.concat(F.lit("The answer is "), F.replace("props", F.lit("}"), F.lit(",}")), F.lit(" as asked"))))
    listed = each.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("event_id", "ok", "props"))).alias("x"))
    cut_off = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["props"]), ", "), F.lit(', {"cut":'))
    return listed.select("user_id", "n", F.md5(F.array_join(F.transform("x", lambda r: r["ok"]), "|")).alias("parsed"), F.md5(F.array_join(T.salvaged(cut_off), "|")).alias("salvaged"))


_CITED_SQL = " UNION ALL ".join(f"SELECT doc_id, '{form}' AS form, unnest(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM d" for form, p in T.CITATIONS)


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F—–]', '_', 'g') AS t FROM documents) SELECT doc_id, form, name, count(*) AS n FROM ({_CITED_SQL}) GROUP BY ALL""")
def citation_fields(spark, sf_dir) -> DataFrame:
    """Citations in the whole text of every document, by form and name."""
    t = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F—–]", "_").alias("t"))
    found = F.array(*[F.struct(F.lit(form).alias("form"), F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias("names")) for form, p in T.CITATIONS])
    each = t.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.form", F.explode("x.names").alias("name"))
    return each.groupBy("doc_id", "form", "name").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT l_orderkey, l_linenumber, (100 + l_linenumber)::INT AS repaired, datediff('day', date '1992-01-01', l_shipdate::DATE)::INT AS days, (epoch(l_shipdate)::BIGINT // 60) AS minutes, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""")
def dates_and_numbers(spark, sf_dir) -> DataFrame:
    scanned = F.concat(F.lit("lO"), F.translate(F.col("l_linenumber").cast("string"), "1", "I"))
    minutes = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 60)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.repair_number(scanned).alias("repaired"), F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).alias("days"), minutes.alias("minutes"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))
