"""Full-text questions over all passages; the SQL stems every word by the same public rules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import FIRST_REGION, KEPT, REGION, SEARCH_STOP_WORDS, SPECIAL, STEP2, STEP3, STEP4
from ..operators import fulltext as T
from ..operators import ask
from ..tables import VIEWS, chunks, edges, load, vectors, works
from .registry import query


def _ends(column: str, steps, least) -> str:
    """CASE over endings: the first that fits decides; ``least`` gives the condition of each."""
    cases = []
    for end, new in steps:
        rest = f"left({column}, length({column}) - {len(end)})"
        cases.append(f"WHEN ends_with({column}, '{end}') THEN CASE WHEN length({column}) - {len(end)} >= {least(end, rest)} THEN {rest} || '{new}' ELSE {column} END")
    return f"CASE {' '.join(cases)} ELSE {column} END"


def _short(x: str) -> str:
    return f"((length({x}) = 2 AND regexp_matches({x}, '^[aeiouy][^aeiouy]$')) OR (length({x}) <> 2 AND regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$')))"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_FIRST, _REGION = f"^({FIRST_REGION.pattern})", f"^({REGION.pattern})"
_BASE = "left(b, length(b) - length(e))"
#: tokens (id, pos, word) and stems (word, lexeme) of all words of the documents, stop words left out.
_STEMS = f"""tokens AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)),
y AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS a FROM tokens WHERE word NOT IN ({_list(SEARCH_STOP_WORDS)})),
r AS (SELECT *, CASE WHEN regexp_matches(a, '{_FIRST}') THEN length(regexp_extract(a, '{_FIRST}', 1)) ELSE length(a) END AS r1 FROM y),
s AS (SELECT *, CASE WHEN regexp_matches(substr(a, r1 + 1), '{_REGION}') THEN r1 + length(regexp_extract(substr(a, r1 + 1), '{_REGION}', 1)) ELSE length(a) END AS r2 FROM r),
s1 AS (SELECT *, CASE WHEN ends_with(a, 'sses') THEN left(a, length(a) - 2) WHEN ends_with(a, 'ied') OR ends_with(a, 'ies') THEN left(a, length(a) - CASE WHEN length(a) > 4 THEN 2 ELSE 1 END)
  WHEN ends_with(a, 's') AND NOT ends_with(a, 'us') AND NOT ends_with(a, 'ss') AND regexp_matches(left(a, length(a) - 2), '[aeiouy]') THEN left(a, length(a) - 1) ELSE a END AS b FROM s),
s2 AS (SELECT *, regexp_extract(b, '(eedly|eed|ingly|edly|ing|ed)$', 1) AS e FROM s1),
s3 AS (SELECT *, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) - length(e) >= r1 THEN {_BASE} || 'ee' ELSE b END
  WHEN e <> '' AND regexp_matches({_BASE}, '[aeiouy]') THEN CASE WHEN regexp_matches({_BASE}, '(at|bl|iz)$') THEN {_BASE} || 'e' WHEN regexp_matches({_BASE}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - length(e) - 1)
  WHEN r1 >= length({_BASE}) AND {_short(_BASE)} THEN {_BASE} || 'e' ELSE {_BASE} END ELSE b END AS c FROM s2),
s4 AS (SELECT *, CASE WHEN length(c) > 2 AND regexp_matches(c, '[^aeiouy][yY]$') THEN left(c, length(c) - 1) || 'i' ELSE c END AS d FROM s3),
s5 AS (SELECT *, {_ends("d", STEP2, lambda end, rest: f"r1 AND right({rest}, 1) = 'l'" if end == "ogi" else f"r1 AND regexp_matches({rest}, '[cdeghkmnrt]$')" if end == "li" else "r1")} AS f FROM s4),
s6 AS (SELECT *, {_ends("f", STEP3, lambda end, rest: "r2" if end == "ative" else "r1")} AS g FROM s5),
s7 AS (SELECT *, {_ends("g", [(x, "") for x in STEP4], lambda end, rest: f"r2 AND regexp_matches({rest}, '[st]$')" if end == "ion" else "r2")} AS h FROM s6),
s8 AS (SELECT *, CASE WHEN ends_with(h, 'e') THEN CASE WHEN length(h) - 1 >= r2 OR (length(h) - 1 >= r1 AND NOT {_short("left(h, length(h) - 1)")}) THEN left(h, length(h) - 1) ELSE h END
  WHEN ends_with(h, 'll') AND length(h) - 1 >= r2 THEN left(h, length(h) - 1) ELSE h END AS k FROM s7),
stems AS (SELECT word, CASE {" ".join(f"WHEN word = '{w}' THEN '{x}'" for w, x in SPECIAL.items())} WHEN length(word) <= 2 THEN word WHEN b IN ({_list(KEPT)}) THEN b ELSE replace(k, 'Y', 'y') END AS lexeme FROM s8),
places AS (SELECT id, lexeme, pos FROM (SELECT DISTINCT id, lexeme, least(pos, {T.LAST_POSITION}) AS pos FROM tokens JOIN stems USING (word)) QUALIFY row_number() OVER (PARTITION BY id, lexeme ORDER BY pos) <= {T.MOST_POSITIONS}),
sizes AS (SELECT id, count(DISTINCT lexeme) AS lexemes, count(*) AS n_places FROM places GROUP BY id)"""


def _has(lexeme: str) -> str:
    return f"id IN (SELECT id FROM places WHERE lexeme = '{lexeme}')"


@query(f"WITH {_STEMS} SELECT lexeme, count(DISTINCT id) AS documents, count(*) AS occurrences, max(pos) AS last_position FROM places GROUP BY lexeme")
def fulltext_lexemes(spark, sf_dir) -> DataFrame:
    """All lexemes of all passages: in how many, how often, and how far in."""
    x = T.found_positions(chunks(spark, sf_dir)).select(F.explode("found").alias("x")).select("x.*")
    return x.groupBy("lexeme").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"), F.max(F.array_max("positions")).cast("long").alias("last_position"))


def _near(a: str, b: str) -> str:
    return f"1 - {T.WEIGHT} * sqrt(CASE WHEN abs({a} - {b}) > 100 THEN 1e-30 ELSE 1.0::DOUBLE / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs({a} - {b}) / 1.5::DOUBLE - 2)) END)"


_ALL = ("er", "ha", "thti")


@query(f"""WITH {_STEMS}, n AS (SELECT a.id, round(1 - product({_near('a.pos', 'b.pos')}), 9) AS score FROM places a JOIN places b ON a.id = b.id AND a.lexeme < b.lexeme AND a.pos <> b.pos
  WHERE a.lexeme IN ({_list((*_ALL, 'thre'))}) AND b.lexeme IN ({_list((*_ALL, 'thre'))}) GROUP BY a.id)
  SELECT id AS chunk_id, score FROM n WHERE {" AND ".join(map(_has, _ALL))} AND NOT {_has('thre')} ORDER BY score DESC, id LIMIT 40""")
def fulltext_all_words(spark, sf_dir) -> DataFrame:
    """Passages with all words in some form and without another, by how near these stand."""
    asked = T.web_query("the erly haing thties -threing")
    return T.search_ranked(T.found_positions(chunks(spark, sf_dir), asked.lexemes), asked, 40).withColumnRenamed("id", "chunk_id")


_ANY = ("rewh", "oning", "ingly", "der")
_ANY_LEXEMES = ("der", "ing", "one", "rewh")


@query(f"""WITH {_STEMS}, h AS (SELECT id, lexeme, sum(1.0::DOUBLE / (n * n)) AS part FROM (SELECT id, lexeme, row_number() OVER (PARTITION BY id, lexeme ORDER BY pos) AS n FROM places WHERE lexeme IN ({_list(_ANY_LEXEMES)})) GROUP BY ALL)
  SELECT id AS chunk_id, round(sum(part * {T.WEIGHT} / {T.SUM_OF_SQUARES}) / 4 / (ln(n_places + 1.0::DOUBLE) / {math.log(2.0)}) / (ln(lexemes + 1.0::DOUBLE) / {math.log(2.0)}), 9) AS score
  FROM h JOIN sizes USING (id) WHERE {_has('rewh')} OR {_has('one')} OR ({_has('ing')} AND NOT {_has('der')}) GROUP BY id, n_places, lexemes""")
def fulltext_any_word(spark, sf_dir) -> DataFrame:
    """All passages with one of several words, by occurrences, in view of their length and number of lexemes."""
    asked = T.web_query("rewhed or oned or ingly -der")
    return T.search_ranked(T.found_positions(chunks(spark, sf_dir), asked.lexemes), asked, None, 1 | 16).withColumnRenamed("id", "chunk_id")


_PHRASE = ("anea", "attion", "thanedbl")


@query(f"""WITH {_STEMS}, f AS (SELECT DISTINCT a.id FROM places a JOIN places b ON a.id = b.id AND b.pos = a.pos + 2 JOIN places c ON a.id = c.id AND c.pos = a.pos + 4 WHERE a.lexeme = 'attion' AND b.lexeme = 'thanedbl' AND c.lexeme = 'anea'),
  n AS (SELECT a.id, round(1 - product({_near('a.pos', 'b.pos')}), 9) AS score FROM places a JOIN places b ON a.id = b.id AND a.lexeme < b.lexeme AND a.pos <> b.pos WHERE a.lexeme IN ({_list(_PHRASE)}) AND b.lexeme IN ({_list(_PHRASE)}) GROUP BY a.id)
  SELECT id AS chunk_id, score FROM f JOIN n USING (id)""")
def fulltext_phrase(spark, sf_dir) -> DataFrame:
    """All passages with a phrase, a stop word inside standing for any word."""
    asked = T.phrase_query("attions to thanedble the aneas")
    return T.search_ranked(T.found_positions(chunks(spark, sf_dir), asked.lexemes), asked, None).withColumnRenamed("id", "chunk_id")


@query()
def fulltext_headlines(spark, sf_dir) -> DataFrame:
    """Ranked passages with headlines; tests hold them against loops."""
    return T.keyword_search(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), '"erin thanea" or rewhly or hehe oned', 50)


_ASKED, _BUDGET = 'Give the exact words around "thanedble the aneas"', 20_000
_COS = "round(list_cosine_similarity(v.embedding, (SELECT embedding FROM vectors WHERE chunk_id = 0)), 6)"


@query("WITH RECURSIVE " + VIEWS["chunks"] + ",\n" + VIEWS["works"] + ",\n" + VIEWS["vectors"] + ",\n" + VIEWS["edges"] + f""",
{_STEMS}, f AS (SELECT DISTINCT a.id FROM places a JOIN places b ON a.id = b.id AND b.pos = a.pos + 2 WHERE a.lexeme = 'thanedbl' AND b.lexeme = 'anea'),
  nn AS (SELECT a.id, round(1 - product({_near('a.pos', 'b.pos')}), 9) AS score FROM places a JOIN places b ON a.id = b.id AND a.lexeme < b.lexeme AND a.pos <> b.pos WHERE a.lexeme IN ('anea', 'thanedbl') AND b.lexeme IN ('anea', 'thanedbl') GROUP BY a.id),
  tx AS (SELECT id AS chunk_id, score FROM f JOIN nn USING (id) ORDER BY score DESC, id LIMIT 15), vc AS (SELECT chunk_id, {_COS} AS score FROM vectors v JOIN chunks USING (chunk_id) WHERE granularity = 'micro' ORDER BY score DESC, chunk_id LIMIT 15),
  p AS (SELECT chunk_id, 0.3::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS part FROM vc UNION ALL SELECT chunk_id, 0.7::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) FROM tx),
  a0 AS (SELECT chunk_id, sum(part) AS score FROM p GROUP BY chunk_id ORDER BY round(sum(part), 12) DESC, chunk_id LIMIT 15),
  l AS (SELECT src::BIGINT AS x, dst::BIGINT AS y, confidence FROM edges WHERE type = 'ENGAGES_WITH'), b AS (SELECT x, y, confidence FROM l UNION ALL SELECT y, x, confidence FROM l),
  a1 AS (SELECT y AS chunk_id, max(CASE confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.7 ELSE 0.4 END)::DOUBLE AS score FROM b WHERE x IN (SELECT chunk_id FROM a0) AND y NOT IN (SELECT chunk_id FROM a0) GROUP BY y ORDER BY score DESC, y LIMIT 20),
  a2 AS (SELECT chunk_id, {_COS} AS score FROM vectors v JOIN chunks USING (chunk_id) WHERE granularity = 'micro' AND chunk_id NOT IN (SELECT chunk_id FROM a0) ORDER BY score DESC, chunk_id LIMIT 10),
  u AS (SELECT 0 AS section, * FROM a0 UNION ALL SELECT 1, * FROM a1 UNION ALL SELECT 2, * FROM a2),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, chunk_id) AS n FROM u) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY section) = 1),
  i AS (SELECT o.*, c.work_id, greatest(1, length(text) // 4) AS cost, row_number() OVER (ORDER BY section, n, o.chunk_id) AS rn FROM o JOIN chunks c USING (chunk_id)),
  w AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, -1::BIGINT AS shut, NULL::BIGINT AS kept UNION ALL
    SELECT i.rn, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok OR shut = section THEN shut ELSE section END, CASE WHEN ok THEN chunk_id END FROM (SELECT i.*, used, shut, shut <> section AND used + cost <= {_BUDGET} AS ok FROM w JOIN i ON i.rn = w.rn + 1) i)
  SELECT section, n, chunk_id, round(score, 9) AS score, title, coalesce(publication_year::VARCHAR, 'undated') AS year FROM i JOIN works USING (work_id) WHERE chunk_id IN (SELECT kept FROM w)""")
def ask_passages(spark, sf_dir) -> DataFrame:
    """The passages that a question for a quotation is answered from: phrase and vectors, links, evidence, budget, works."""
    c = chunks(spark, sf_dir)
    v = vectors(spark, sf_dir)
    links = edges(spark, sf_dir).filter("type = 'ENGAGES_WITH'").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "confidence")
    found = ask.retrieved(c.select("chunk_id", "work_id", "text", "granularity"), v, links, _ASKED, v.filter("chunk_id = 0").select(F.col("embedding").alias("query_vector")))
    return ask.answered(found, c, works(spark, sf_dir), _BUDGET)
