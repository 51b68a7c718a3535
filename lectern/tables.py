"""The engine's tables derived from a folder of source tables, as DataFrames and as DuckDB SQL.

``load`` reads a source table; the functions below it make the corpus tables; ``VIEWS`` holds the same
definitions in SQL, put together by ``with_views`` for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SOURCE_CLASSES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in SOURCE_CLASSES]), (number % len(SOURCE_CLASSES) + 1).cast("int"))


def work_id_of(lang: str = "lang", source: str = "source") -> Column:
    return F.concat(F.lit("author-"), lang, F.lit("--"), source)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work for each language and source of the documents."""
    made = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("total_chars"))
    num = F.substring("source", 4, 9).cast("int")
    tags = F.when(num % 4 == 0, F.array(F.lit("essay"), F.lit("theology"))).when(num % 4 == 1, F.array(F.lit("poetry"))).when(num % 4 == 2, F.array(F.lit("sermon"), F.lit("homily"))).otherwise(F.array(F.lit("fiction")))
    return made.select(
        work_id_of().alias("work_id"), F.concat(F.lit("author-"), "lang").alias("author"), F.col("source").alias("title"), num.alias("num"),
        F.when(num % 7 != 0, 1900 + num).alias("publication_year"), class_of(num).alias("source_class"), tags.alias("genre_tags"),
        F.format_string('{"classification_confidence": 0.%02d, "slug": "author-%s"}', 50 + num * 2, F.col("lang")).alias("source_metadata"),
        "n_docs", "total_chars",
    )


def granularity_of(n_chars: Column) -> Column:
    return F.when(n_chars < 200, "nano").when(n_chars < 1200, "micro").when(n_chars < 3000, "meso").otherwise("macro")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages of their works."""
    d = F.col("doc_id")
    section = F.element_at(F.array(*[F.lit(x) for x in ("chapter", "preface", "index", "bibliography")]), (d % 4 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select(
        d.alias("chunk_id"), work_id_of().alias("work_id"), "text", "n_chars", granularity_of(F.col("n_chars")).alias("granularity"),
        class_of(d).alias("source_class"), F.when(d % 11 != 0, F.concat(F.lit("Chapter "), (d % 5 + 1).cast("string"))).alias("chapter"),
        section.alias("section_type"), d.alias("position"), (d % 3 + 1).cast("int").alias("pass_number"), (F.lit(20) + d % 7).alias("day"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed graph: entity edges of passages, links between them, development of arguments."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    size = v.agg(F.count(F.lit(1)).alias("size"))
    i = F.col("vec_id")
    chunk = i.cast("string")
    link = F.element_at(F.array(*[F.lit(x) for x in ("quotes", "alludes", "responds", "cites")]), (i % 4 + 1).cast("int"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low")]), (i % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")

    def rows(frame: DataFrame, src: Column, kind: str, dst: Column, link_type: Column = none, confidence: Column = none, score: Column | None = None) -> DataFrame:
        points = F.lit(None).cast("double") if score is None else score
        return frame.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), link_type.alias("link_type"), confidence.alias("confidence"), points.alias("score"))

    sized = v.crossJoin(F.broadcast(size))  # one row of size
    quality = load(spark, sf_dir, "labels")
    parts = [
        rows(v, chunk, "EXPLORES_THEME", F.concat(F.lit("theme-"), F.col("label").cast("string"))),
        rows(quality, F.col("doc_id").cast("string"), "EXPLORES_THEME", F.concat(F.lit("quality-"), F.col("quality").cast("string"))),
        rows(v.filter(i % 6 < 2), chunk, "MAKES_ARGUMENT", F.concat(F.lit("argument-"), (i % 17).cast("string"))),
        rows(v.filter(i % 2 == 0), chunk, "CONCEPT_USED_IN", F.concat(F.lit("concept-"), (i % 13).cast("string"))),
        rows(v.filter(i % 2 == 0), chunk, "REFERENCES_PERSON", F.concat(F.lit("person-"), (i % 7).cast("string"))),
        rows(sized, chunk, "ENGAGES_WITH", ((i * 7 + 3) % F.col("size")).cast("string"), link, level, (i % 10) / 10.0),
        rows(sized.filter(i % 5 == 0), chunk, "THEMATIC_PARALLEL", ((i * 3 + 1) % F.col("size")).cast("string"), none, F.lit("low"), F.lit(0.9)),
        rows(v.filter("vec_id between 1 and 16"), F.concat(F.lit("argument-"), chunk), "DEVELOPS_FROM", F.concat(F.lit("argument-"), (i - 1).cast("string"))),
        rows(v.filter(i % 6 == 4), chunk, "USER_REFLECTS_ON", F.concat(F.lit("theme-"), F.col("label").cast("string"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading captures of ten users: time, work and themes."""
    k = F.get_json_object("props", "$.k").cast("int")
    themes = F.array_distinct(F.array(F.concat(F.lit("t"), F.floor(k / 20).cast("string")), F.concat(F.lit("u"), (k % 3).cast("string"))))
    return load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("user_id"), F.col("event_id").alias("capture_id"), "ts", F.col("event_type").alias("work_id"), themes.alias("themes"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines; pairs of turns share a speaker."""
    return load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("S"), (F.floor(F.col("turn") / 2) % 3).cast("string")).alias("speaker"), "role", "text")


_CLASS = "['primary','secondary','tertiary','contextual','personal','reference']"
#: DuckDB definitions of the tables above.
VIEWS = {
    "works": f"""works AS (
  SELECT 'author-'||lang||'--'||source AS work_id, 'author-'||lang AS author, source AS title, num, CASE WHEN num % 7 <> 0 THEN 1900+num END AS publication_year,
         {_CLASS}[num % 6 + 1] AS source_class,
         CASE num % 4 WHEN 0 THEN ['essay','theology'] WHEN 1 THEN ['poetry'] WHEN 2 THEN ['sermon','homily'] ELSE ['fiction'] END AS genre_tags,
         printf('{{"classification_confidence": 0.%02d, "slug": "author-%s"}}', 50 + num * 2, lang) AS source_metadata, n_docs, total_chars
  FROM (SELECT lang, source, substr(source, 4, 9)::INT AS num, count(*) AS n_docs, sum(n_chars)::BIGINT AS total_chars FROM documents GROUP BY lang, source))""",
    "chunks": f"""chunks AS (
  SELECT doc_id AS chunk_id, 'author-'||lang||'--'||source AS work_id, text, n_chars,
         CASE WHEN n_chars < 200 THEN 'nano' WHEN n_chars < 1200 THEN 'micro' WHEN n_chars < 3000 THEN 'meso' ELSE 'macro' END AS granularity,
         {_CLASS}[doc_id % 6 + 1] AS source_class, CASE WHEN doc_id % 11 <> 0 THEN 'Chapter '||(doc_id % 5 + 1) END AS chapter,
         ['chapter','preface','index','bibliography'][doc_id % 4 + 1] AS section_type, doc_id AS position, (doc_id % 3 + 1)::INT AS pass_number, 20 + doc_id % 7 AS day
  FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)",
    "edges": """edges AS (
  SELECT vec_id::VARCHAR AS src, 'EXPLORES_THEME' AS type, 'theme-'||label AS dst, NULL::VARCHAR AS link_type, NULL::VARCHAR AS confidence, NULL::DOUBLE AS score FROM embeddings
  UNION ALL SELECT doc_id::VARCHAR, 'EXPLORES_THEME', 'quality-'||quality, NULL, NULL, NULL FROM labels
  UNION ALL SELECT vec_id::VARCHAR, 'MAKES_ARGUMENT', 'argument-'||(vec_id % 17), NULL, NULL, NULL FROM embeddings WHERE vec_id % 6 < 2
  UNION ALL SELECT vec_id::VARCHAR, 'CONCEPT_USED_IN', 'concept-'||(vec_id % 13), NULL, NULL, NULL FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id::VARCHAR, 'REFERENCES_PERSON', 'person-'||(vec_id % 7), NULL, NULL, NULL FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id::VARCHAR, 'ENGAGES_WITH', ((vec_id*7+3) % (SELECT count(*) FROM embeddings))::VARCHAR, ['quotes','alludes','responds','cites'][vec_id % 4 + 1], ['high','medium','low'][vec_id % 3 + 1], (vec_id % 10) / 10.0::DOUBLE FROM embeddings
  UNION ALL SELECT vec_id::VARCHAR, 'THEMATIC_PARALLEL', ((vec_id*3+1) % (SELECT count(*) FROM embeddings))::VARCHAR, NULL, 'low', 0.9 FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT 'argument-'||vec_id, 'DEVELOPS_FROM', 'argument-'||(vec_id-1), NULL, NULL, NULL FROM embeddings WHERE vec_id BETWEEN 1 AND 16
  UNION ALL SELECT vec_id::VARCHAR, 'USER_REFLECTS_ON', 'theme-'||label, NULL, NULL, NULL FROM embeddings WHERE vec_id % 6 = 4)""",
    "captures": """captures AS (
  SELECT user_id % 10 AS user_id, event_id AS capture_id, ts, event_type AS work_id,
         ['t'||(k // 20), 'u'||(k % 3)] AS themes
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))""",
    "turns": "turns AS (SELECT conv_id, turn AS ord, 'S'||((turn // 2) % 3) AS speaker, role, text FROM conversations)",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` (a SELECT, or further tables and a SELECT) after the definitions of the named tables."""
    head = ",\n".join(VIEWS[n] for n in names.split())
    rest = body.strip()
    joint = ",\n" if rest[:6].upper() == "WITH $" else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{joint}{rest.removeprefix('WITH $').lstrip()}"
