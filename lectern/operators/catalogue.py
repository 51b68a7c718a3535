"""Cataloguing: classification rules, entity rows, passages of essays and interviews, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from .chunking import paragraph_rows
from .fusion import packed, top_per_group


#: Words that tell the type of a question, in order; thematic if none does.
QUESTION_WORDS = (
    ("quote", r"quote|quotation|exact words|word for word|verbatim"),
    ("generative", r"write|draft|compose|imagine|in the style of|generate"),
    ("factual", r"who|when|where|which year|how many|what year|born|published"),
)


def question_type(text: Column) -> Column:
    """Type of a question by its words; the offline stand-in for a model's answer, thematic where that would fall back."""
    plain = F.regexp_replace(F.lower(text), r"[^\x00-\x7F]", "_")
    out = F.lit("thematic")
    for name, words in reversed(QUESTION_WORDS):
        out = F.when(plain.rlike(rf"\b({words})\b"), F.lit(name)).otherwise(out)
    return out


def question_type_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    cases = " ".join(rf"WHEN regexp_matches(regexp_replace(lower({text}), '[^\x00-\x7F]', '_', 'g'), '\b({words})\b') THEN '{name}'" for name, words in QUESTION_WORDS)
    return f"CASE {cases} ELSE 'thematic' END"


def work_type(title: Column) -> Column:
    """First keyword of a title that tells the kind of work."""
    out = F.lit("prose")
    for word, kind in reversed((("letters", "letters"), ("sermon", "sermon"), ("poem", "poetry"), ("interview", "interview"), ("essay", "essay"))):
        out = F.when(F.lower(title).contains(word), F.lit(kind)).otherwise(out)
    return out


def authorship(title: Column, text: Column) -> Column:
    """Whether a section is the author's own: editorial headings and a lack of first person tell against it."""
    editorial = title.rlike(r"(?i)introduction|foreword|editor|translator|about the author|afterword")
    first_person = text.rlike(r"(?i)\b(i|my|me|mine)\b")
    return F.when(editorial & ~first_person, "editorial").when(editorial, "mixed").otherwise("own")


def entity_edges(extractions: DataFrame) -> DataFrame:
    """Edge rows of extraction rows (chunk, source_class, themes, arguments, concepts, persons).

    Arguments are made only by primary passages; a secondary one attributes them; other classes have none.
    """
    kinds = (("themes", "EXPLORES_THEME", F.lit(True)), ("concepts", "CONCEPT_USED_IN", F.lit(True)), ("persons", "REFERENCES_PERSON", F.lit(True)), ("arguments", "MAKES_ARGUMENT", F.col("source_class") == "primary"), ("arguments", "ATTRIBUTED_BY_CRITIC", F.col("source_class") == "secondary"))
    groups = F.array(*[F.struct(F.lit(kind).alias("type"), F.when(when, F.col(name)).alias("names")) for name, kind, when in kinds])
    each = extractions.select("chunk", F.explode(groups).alias("g")).select("chunk", "g.type", F.explode("g.names").alias("name"))
    key = F.left(F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("-")), F.lit(80))
    return each.select(F.col("chunk").alias("src"), "type", key.alias("dst")).filter("dst <> ''").distinct()


def expansions(parts: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """Several expansions (node) in order of priority: each node once, at the first that has it, seeds left out."""
    merged = None
    for i, part in enumerate(parts):
        rows = part.select("node", F.lit(i).alias("method"))
        merged = rows if merged is None else merged.unionByName(rows)
    return merged.groupBy("node").agg(F.min("method").alias("method")).join(seeds.select("node"), "node", "left_anti")


def essays(docs: DataFrame, whole: int = 2000, most: int = 500, least: int = 30) -> DataFrame:
    """doc_id, granularity, position, words: posts up to ``whole`` words as one, else packed, with long paragraphs apart."""
    rows = paragraph_rows(docs)
    total = rows.groupBy("doc_id").agg(F.sum("words").alias("words"))
    one = total.filter(F.col("words") <= whole).select("doc_id", F.lit("meso").alias("granularity"), F.lit(0).alias("position"), "words")
    long = rows.join(total.filter(F.col("words") > whole).select("doc_id"), "doc_id", "left_semi")
    packs = long.join(packed(long, ["doc_id"], most), ["doc_id", "pos"]).groupBy("doc_id", F.col("pack").alias("position")).agg(F.sum("words").alias("words")).select("doc_id", F.lit("meso").alias("granularity"), "position", "words")
    micro = long.filter(F.col("words") >= least).select("doc_id", F.lit("micro").alias("granularity"), F.col("pos").alias("position"), "words")
    return one.unionByName(packs).unionByName(micro)


def labelled_answers(docs: DataFrame) -> DataFrame:
    """doc_id, pair, question, answer of texts with "Q:" and "A:" lines."""
    found = F.regexp_extract_all("text", F.lit(r"(?s)Q:\s*(.*?)\s*A:\s*(.*?)(?=\s*Q:|\s*$)"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("pair", "m"))
    part = lambda i: F.regexp_extract("m", r"(?s)Q:\s*(.*?)\s*A:\s*(.*?)\s*$", i)
    return rows.select("doc_id", "pair", part(1).alias("question"), part(2).alias("answer"))


def parents(chunks: DataFrame) -> DataFrame:
    """chunk_id and parent: the last wider passage of the work at or before it."""
    order = Window.partitionBy("work_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda g: F.last(F.when(F.col("granularity") == g, F.col("chunk_id")), ignorenulls=True).over(order)
    c = chunks.withColumns({"macro_id": last("macro"), "meso_id": last("meso")})
    parent = F.when(F.col("granularity") == "meso", F.col("macro_id")).when(F.col("granularity").isin("micro", "nano"), F.coalesce("meso_id", "macro_id"))
    return c.select("chunk_id", parent.alias("parent"))


def distinctive_terms(words: DataFrame, n: int = 5) -> DataFrame:
    """group, term, tf and score: the ``n`` terms of a group (group, term) that are frequent in it and rare elsewhere."""
    tf = words.groupBy("group", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    groups = tf.agg(F.countDistinct("group").alias("groups"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(groups)).withColumn("score", F.round(F.col("tf") * (1 - F.col("df") / F.col("groups")), 6))
    return top_per_group(scored, ["group"], [F.desc("score"), "term"], n).select("group", "term", "tf", "score")


def style(chunks: DataFrame, group: str = "work_id") -> DataFrame:
    """Mean word length, words a sentence and questions of each group: the offline voice profile."""
    words = word_count(F.col("text"))
    stops = F.greatest(F.lit(1), F.regexp_count("text", F.lit("[.!?]")))
    c = chunks.select(group, words.alias("words"), stops.alias("stops"), F.regexp_count("text", F.lit("[?]")).alias("questions"), F.length(F.regexp_replace("text", r"\s+", "")).alias("letters"))
    sums = c.groupBy(group).agg(*[F.sum(x).alias(x) for x in ("words", "stops", "questions", "letters")])
    return sums.select(group, F.round(F.col("letters") / F.col("words"), 4).alias("word_length"), F.round(F.col("words") / F.col("stops"), 4).alias("sentence_length"), "questions")


def numbered(rows: DataFrame, group: str, order: str, text: str, n: int) -> DataFrame:
    """group and sample: its first ``n`` texts with numbers before them, as prompts have them."""
    first = top_per_group(rows, [group], [order], n)
    line = F.row_number().over(Window.partitionBy(group).orderBy(order))
    listed = first.withColumn("line", F.format_string("[%d] %s", line, F.col(text)))
    return listed.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("sample"))
