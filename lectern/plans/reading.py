"""Chunking, sessions, windows over sequences, and re-reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stamp, word_count
from ..operators import chunking as K
from ..operators import fusion, sessions
from ..tables import captures, chunks, load, turns, with_views, works
from .registry import query

_WC = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
_PARAS = r"""p AS (SELECT doc_id, pos, para, """ + _WC.format("para") + r""" AS words FROM (SELECT doc_id, unnest(l) AS para, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))"""


def _pack_sql(source: str, keys: str, budget: int) -> str:
    """Greedy packing by recursion over ``source`` (keys, pos, words), its rows numbered by rn."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"n.{x} = s.{x}" for x in k)
    cols = ", ".join(f"n.{x}" for x in k)
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn FROM {source}),
  s AS (SELECT {keys}, pos, rn, words, 0 AS pack, words AS fill FROM n WHERE rn = 1 UNION ALL
    SELECT {cols}, n.pos, n.rn, n.words, CASE WHEN s.fill > 0 AND s.fill + n.words > {budget} THEN s.pack + 1 ELSE s.pack END, CASE WHEN s.fill > 0 AND s.fill + n.words > {budget} THEN n.words ELSE s.fill + n.words END FROM s JOIN n ON {on} AND n.rn = s.rn + 1)"""


def docs(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"""WITH RECURSIVE {_PARAS}, {_pack_sql('p', 'doc_id', 200)},
  g AS (SELECT doc_id, pack, min(pos) AS first, max(pos) AS last, sum(words)::BIGINT AS words, max(pack) OVER (PARTITION BY doc_id) AS top FROM s GROUP BY doc_id, pack),
  m AS (SELECT doc_id, CASE WHEN pack = top AND pack > 0 AND words < 60 THEN pack - 1 ELSE pack END AS pack, first, last, words FROM g)
  SELECT doc_id, 'meso' AS granularity, pack::BIGINT AS position, min(first) AS first, max(last) AS last, sum(words)::BIGINT AS words FROM m GROUP BY doc_id, pack
  UNION ALL SELECT doc_id, 'macro', 0, min(pos), max(pos), sum(words)::BIGINT FROM p GROUP BY doc_id
  UNION ALL SELECT doc_id, 'micro', row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1, pos, pos, words FROM p WHERE length(trim(para)) >= 50""")
def chunk_paragraphs_packed(spark, sf_dir) -> DataFrame:
    return K.scholarly(docs(spark, sf_dir), 200, 60).withColumns({c: F.col(c).cast("long") for c in ("first", "last")})


@query(r"""SELECT doc_id, 'meso' AS granularity, 0 AS position, n AS lines FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents)
  UNION ALL SELECT doc_id, 'micro', 0, len(string_split(trim(text), chr(10))) FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 20""")
def chunk_poetry(spark, sf_dir) -> DataFrame:
    return K.poetry(docs(spark, sf_dir), 20)


@query(f"""WITH {_PARAS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM p),
  z AS (SELECT *, greatest(1, n // least(5, greatest(3, n // 3))) AS size FROM c) SELECT doc_id, k // size AS movement, count(*) AS paragraphs, sum(words)::BIGINT AS words, sum(len(list_distinct(regexp_extract_all(regexp_replace(para, '[^\\x00-\\x7F]', '_', 'g'), '\\b((?:[123] )?[A-Z][a-z]+ [0-9]{{1,3}}:[0-9]{{1,3}}(?:-[0-9]{{1,3}})?)\\b', 1))))::INT AS refs FROM z GROUP BY ALL""")
def chunk_sermon(spark, sf_dir) -> DataFrame:
    return K.sermon(docs(spark, sf_dir)).withColumn("refs", F.size("refs"))


@query(f"""WITH RECURSIVE {_PARAS}, t AS (SELECT doc_id, sum(words)::BIGINT AS words FROM p GROUP BY doc_id), l AS (SELECT p.* FROM p JOIN t USING (doc_id) WHERE t.words > 400), {_pack_sql('l', 'doc_id', 150)}
  SELECT doc_id, 'letter' AS granularity, 0 AS position, words FROM t WHERE words <= 400 UNION ALL SELECT doc_id, 'pack', pack, sum(words)::BIGINT FROM s GROUP BY doc_id, pack""")
def chunk_letters(spark, sf_dir) -> DataFrame:
    return K.letters(docs(spark, sf_dir), 400, 150)


@query(with_views("turns", """WITH $ f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY ord)), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS turn FROM f)
  SELECT conv_id, turn::BIGINT AS turn, first(speaker) AS speaker, min(ord) AS first, count(*) AS lines, string_agg(text, chr(10) ORDER BY ord) AS text FROM g GROUP BY conv_id, turn"""))
def chunk_transcript_turns(spark, sf_dir) -> DataFrame:
    return K.speaker_turns(turns(spark, sf_dir))


@query(with_views("turns", """WITH $ f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY ord)), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS turn FROM f)
  SELECT conv_id, turn::BIGINT AS turn, sum(""" + _WC.format("text") + """)::BIGINT AS words FROM g GROUP BY conv_id, turn"""))
def transcript_pieces(spark, sf_dir) -> DataFrame:
    pieces = K.split_turns(K.speaker_turns(turns(spark, sf_dir)), 20, 10)
    return pieces.groupBy("conv_id", "turn").agg(F.sum("words").alias("words"))


@query("""WITH n AS (SELECT conv_id, text, row_number() OVER w - 1 AS n, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, n // 2 AS pair, text AS question, answer FROM n WHERE n % 2 = 0 AND answer IS NOT NULL""")
def qa_pairs(spark, sf_dir) -> DataFrame:
    return K.question_pairs(turns(spark, sf_dir))


@query("""WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM documents) SELECT doc_id, (i - 1) // 3 AS cluster, count(*) AS sentences FROM (SELECT doc_id, generate_subscripts(s, 1) AS i FROM m) GROUP BY ALL""")
def sentence_clusters(spark, sf_dir) -> DataFrame:
    return K.sentence_clusters(docs(spark, sf_dir)).select("doc_id", "cluster", "sentences")


@query(with_views("works", """SELECT work_id, CASE genre_tags[1] WHEN 'essay' THEN 'blog' WHEN 'poetry' THEN 'poetry' WHEN 'sermon' THEN 'sermon' ELSE 'scholarly' END AS strategy, CASE genre_tags[len(genre_tags)] WHEN 'poetry' THEN 'poetry' WHEN 'homily' THEN 'sermon' ELSE 'scholarly' END AS by_last, NULL::VARCHAR AS none FROM works"""))
def chunking_strategy(spark, sf_dir) -> DataFrame:
    return works(spark, sf_dir).select("work_id", K.strategy_of(F.col("genre_tags")).alias("strategy"), K.strategy_of(F.reverse("genre_tags")).alias("by_last"), K.strategy_of(F.array().cast("array<string>")).alias("none"))


@query(f"""WITH {_PARAS} SELECT doc_id, pos, last_value(CASE WHEN words <= 2 THEN trim(para) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter FROM p""")
def carried_chapters(spark, sf_dir) -> DataFrame:
    rows = K.paragraph_rows(docs(spark, sf_dir))
    return K.carried(rows, F.col("words") <= 2).select("doc_id", F.col("pos").cast("long").alias("pos"), "chapter")


@query("""WITH e AS (SELECT user_id, event_id, event_type, (epoch(date_trunc('second', ts))::BIGINT % 86400)::BIGINT AS at FROM events) SELECT c.user_id AS key, c.event_id AS capture_id, l.at AS second_at, count(*) AS lines FROM e c JOIN e l ON l.user_id = c.user_id AND l.event_type <> 'signup' AND l.at BETWEEN greatest(0, c.at - 30) AND c.at + 30 WHERE c.event_type = 'signup' GROUP BY ALL""")
def capture_windows(spark, sf_dir) -> DataFrame:
    """Lines of a user within half a minute of the time of day of each of its sign-ups."""
    t = F.col("ts").cast("timestamp_ntz")
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))).cast("int").alias("at"))
    lines = e.filter("event_type <> 'signup'").select("key", F.concat_ws(" ", stamp(F.col("at")), "event_type").alias("line"))
    c = e.filter("event_type = 'signup'").select("key", F.col("event_id").alias("capture_id"), F.col("at").cast("long").alias("second"))
    return K.in_window(lines, c).groupBy("key", "capture_id", F.col("at").cast("long").alias("second_at")).agg(F.count(F.lit(1)).alias("lines"))


_DECIDED = """WITH $ l AS (SELECT *, lag(ts) OVER w AS pts, lag(work_id) OVER w AS pwork, lag(themes) OVER w AS pthemes FROM captures WINDOW w AS (PARTITION BY user_id ORDER BY ts, capture_id)),
  g AS (SELECT *, date_sub('second', pts, ts) AS gap FROM l),
  r AS (SELECT *, CASE WHEN gap IS NULL THEN 'first' WHEN gap > 3600 THEN 'timeout' WHEN pwork = work_id THEN 'same_source' WHEN len(list_intersect(themes, pthemes)) / greatest(len(themes), len(pthemes)) < 0.5 AND gap > 1800 THEN 'theme_change' WHEN gap <= 1800 THEN 'recent' ELSE 'within_timeout' END AS reason FROM g),
  s AS (SELECT *, (sum(CASE WHEN reason IN ('first','timeout','theme_change') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, capture_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM r)
  """


@query(with_views("captures", _DECIDED + "SELECT user_id, capture_id, gap, reason, session FROM s"))
def sessionize_rules(spark, sf_dir) -> DataFrame:
    return sessions.decided(captures(spark, sf_dir)).select("user_id", "capture_id", "gap", "reason", "session")


@query(with_views("captures", _DECIDED + "SELECT user_id, session, count(*) AS captures, count(DISTINCT work_id) AS sources, date_sub('second', min(ts), max(ts)) // 60 AS minutes, arg_max(work_id, (ts, capture_id)) AS pick_up FROM s GROUP BY ALL"))
def session_summary(spark, sf_dir) -> DataFrame:
    return sessions.summaries(sessions.decided(captures(spark, sf_dir)))


@query(with_views("captures", _DECIDED + ", t AS (SELECT DISTINCT user_id, session, unnest(themes) AS theme FROM s), e AS (SELECT *, list(session) OVER (PARTITION BY user_id, theme ORDER BY session ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS earlier FROM t) SELECT * FROM e WHERE len(earlier) > 0"))
def session_threads(spark, sf_dir) -> DataFrame:
    return sessions.theme_threads(sessions.decided(captures(spark, sf_dir)))


@query(with_views("captures", """WITH $ l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, capture_id) AS p FROM captures), s AS (SELECT *, sum(CASE WHEN p IS NULL OR date_sub('second', p, ts) >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, capture_id ROWS UNBOUNDED PRECEDING) AS n FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.n"""))
def timeout_sessions(spark, sf_dir) -> DataFrame:
    # Windows of an hour after each capture; a gap of exactly an hour starts a new one here.
    w = F.session_window("ts", "3600 seconds")
    return captures(spark, sf_dir).groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


@query("""WITH c AS (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 1 AS position FROM documents) SELECT lang, doc_id, position, position // 10 AS batch FROM c""")
def running_positions(spark, sf_dir) -> DataFrame:
    rows = fusion.numbered(load(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")
    return rows.select("lang", "doc_id", F.col("number").cast("long").alias("position")).withColumn("batch", F.floor(F.col("position") / 10))


@query("""SELECT c_nationkey, c_custkey AS newest, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1""")
def latest_per_key(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("newest"), F.max_by("c_acctbal", "c_custkey").alias("c_acctbal"))


@query(with_views("chunks", """SELECT work_id, pass_number, count(*) AS n, count(DISTINCT chapter) AS chapters, list_sort(list(DISTINCT chapter)) AS names FROM chunks WHERE chapter IS NOT NULL GROUP BY ALL"""))
def pass_chapters(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).filter("chapter is not null")
    return c.groupBy("work_id", "pass_number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chapter").alias("chapters"), F.array_sort(F.collect_set("chapter")).alias("names"))


@query(with_views("chunks", """WITH $ h AS (SELECT work_id, granularity, count(*) FILTER (pass_number = 1) AS a, count(*) FILTER (pass_number = 2) AS b FROM chunks GROUP BY ALL),
  v AS (SELECT work_id, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM h GROUP BY work_id),
  x AS (SELECT work_id, list(DISTINCT chapter) FILTER (pass_number = 1) AS c1, list(DISTINCT chapter) FILTER (pass_number = 2) AS c2 FROM chunks WHERE chapter IS NOT NULL GROUP BY work_id)
  SELECT work_id, 'granularity' AS shift, granularity AS what, b - a AS delta FROM h WHERE a <> b UNION ALL SELECT work_id, 'volume', CASE WHEN b > a THEN 'more' ELSE 'less' END, b - a FROM v WHERE abs(b - a) > 2
  UNION ALL SELECT work_id, 'chapter', unnest(list_filter(coalesce(c2, []), lambda c: NOT list_contains(coalesce(c1, []), c))), 1 FROM x"""))
def pass_delta(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir)
    first, second = F.col("pass_number") == 1, F.col("pass_number") == 2
    h = c.groupBy("work_id", "granularity").agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    v = h.groupBy("work_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    x = c.filter("chapter is not null").groupBy("work_id").agg(*[F.collect_set(F.when(p, F.col("chapter"))).alias(n) for p, n in ((first, "c1"), (second, "c2"))])
    change = (F.col("b") - F.col("a")).alias("delta")
    out = h.filter("a <> b").select("work_id", F.lit("granularity").alias("shift"), F.col("granularity").alias("what"), change)
    out = out.unionByName(v.filter("abs(b - a) > 2").select("work_id", F.lit("volume").alias("shift"), F.when(F.col("b") > F.col("a"), "more").otherwise("less").alias("what"), change))
    return out.unionByName(x.select("work_id", F.lit("chapter").alias("shift"), F.explode(F.array_except("c2", "c1")).alias("what"), F.lit(1).cast("long").alias("delta")))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id // 20 AS grp, doc_id AS pos, greatest(1, floor({_WC.format('text')} * 1.5))::BIGINT AS words FROM documents), {_pack_sql('t', 'grp', 3000)} SELECT grp, pack, count(*) AS items, sum(words)::BIGINT AS tokens FROM s GROUP BY grp, pack""")
def embedding_batches(spark, sf_dir) -> DataFrame:
    t = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 20).alias("grp"), F.col("doc_id").alias("pos"), F.greatest(F.lit(1), F.floor(word_count(F.col("text")) * 1.5)).cast("long").alias("words"))
    return t.join(fusion.packed(t, ["grp"], 3000), ["grp", "pos"]).groupBy("grp", "pack").agg(F.count(F.lit(1)).alias("items"), F.sum("words").alias("tokens"))
