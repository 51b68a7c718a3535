"""Chunking strategies: documents and transcripts to passages at several granularities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import paragraphs, scripture_refs, sentences, stamp_seconds, word_count
from .fusion import packed

#: The genre tags of each strategy, in order of registration; a tag named twice is its later strategy's.
STRATEGY_TAGS = {
    "poetry_collection": ("poetry_collection", "blessings", "mixed_poetry_prose"),
    "poetry": ("poetry", "poems", "verse", "sonnet_sequence"),
    "transcript": ("transcript", "video-transcript", "audio-transcript", "podcast-transcript", "youtube-captions", "interview-transcript"),
    "interview": ("interview", "dialogue", "conversation", "q_and_a"),
    "letters": ("letters", "correspondence", "epistolary"),
    "blog": ("blog", "blog_post", "essay", "short_essay", "online"),
    "sermon": ("sermon", "lecture", "transcript", "homily", "address"),
    "scholarly": ("scholarly_prose", "monograph", "academic_paper", "academic", "theology", "literary_criticism"),
}
#: Strategy of each tag; the first tag of a work that has one decides, without any it is scholarly.
GENRES = {tag: name for name, tags in STRATEGY_TAGS.items() for tag in tags}


def strategy_of(tags: Column) -> Column:
    """Name of the strategy for an array of tags; an empty array has none (null)."""
    table = F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair])
    known = F.filter(F.transform(tags, lambda t: table[F.lower(t)]), lambda s: s.isNotNull())
    return F.when(F.size(tags) > 0, F.coalesce(F.get(known, 0), F.lit("scholarly")))


def paragraph_rows(docs: DataFrame, pattern: str = r"\n") -> DataFrame:
    """doc_id, pos, para and words of the paragraphs that are not blank."""
    parts = F.filter(F.split("text", pattern), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "para")).withColumn("words", word_count(F.col("para")))


def carried(rows: DataFrame, is_heading: Column, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """Add chapter: the last heading at or before a row."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chapter", F.last(F.when(is_heading, F.trim("para")), ignorenulls=True).over(w))


def scholarly(docs: DataFrame, most: int = 500, least_tail: int = 150, least_chars: int = 50) -> DataFrame:
    """doc_id, granularity, position, first, last and words of the passages of each document.

    macro is the document, meso paragraphs packed up to ``most`` words with a short tail joined to the
    pack before, micro each paragraph of ``least_chars`` characters at least.
    """
    rows = paragraph_rows(docs)
    packs = rows.join(packed(rows, ["doc_id"], most), ["doc_id", "pos"]).groupBy("doc_id", "pack").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("words").alias("words"))
    end = Window.partitionBy("doc_id")
    short = (F.col("pack") == F.max("pack").over(end)) & (F.col("pack") > 0) & (F.col("words") < least_tail)
    meso = packs.withColumn("pack", F.when(short, F.col("pack") - 1).otherwise(F.col("pack"))).groupBy("doc_id", "pack").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("words").alias("words"))
    meso = meso.select("doc_id", F.lit("meso").alias("granularity"), F.col("pack").cast("long").alias("position"), "first", "last", "words")
    macro = rows.groupBy("doc_id").agg(F.lit("macro").alias("granularity"), F.lit(0).cast("long").alias("position"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("words").alias("words"))
    kept = rows.filter(F.length(F.trim("para")) >= least_chars)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    micro = kept.select("doc_id", F.lit("micro").alias("granularity"), place.cast("long").alias("position"), F.col("pos").alias("first"), F.col("pos").alias("last"), "words")
    return macro.unionByName(meso).unionByName(micro)


def poetry(docs: DataFrame, long_poem: int = 40) -> DataFrame:
    """doc_id, granularity, position, lines: the poem whole, its stanzas only if it has over ``long_poem`` lines."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    d = docs.withColumn("lines", lines)
    meso = d.select("doc_id", F.lit("meso").alias("granularity"), F.lit(0).alias("position"), "lines")
    stanza = d.filter(F.col("lines") > long_poem).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("position", "s"))
    micro = stanza.select("doc_id", F.lit("micro").alias("granularity"), "position", F.size(F.split("s", "\n")).cast("long").alias("lines"))
    return meso.unionByName(micro)


def sermon(docs: DataFrame) -> DataFrame:
    """doc_id, movement, paragraphs, words, refs: three to five movements of equal numbers of paragraphs."""
    rows = paragraph_rows(docs)
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    count = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n / 3)))
    size = F.greatest(F.lit(1), F.floor(n / count))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    placed = rows.withColumn("movement", F.floor(at / size))
    return placed.groupBy("doc_id", "movement").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("words").alias("words"), F.flatten(F.collect_list(scripture_refs(F.col("para")))).alias("refs"))


def letters(docs: DataFrame, whole: int = 2000, most: int = 500) -> DataFrame:
    """doc_id, granularity, position, words: a letter whole up to ``whole`` words, else packed paragraphs."""
    rows = paragraph_rows(docs)
    total = rows.groupBy("doc_id").agg(F.sum("words").alias("words"))
    one = total.filter(F.col("words") <= whole).select("doc_id", F.lit("letter").alias("granularity"), F.lit(0).alias("position"), "words")
    long = rows.join(total.filter(F.col("words") > whole).select("doc_id"), "doc_id", "left_semi")
    packs = long.join(packed(long, ["doc_id"], most), ["doc_id", "pos"]).groupBy("doc_id", F.col("pack").alias("position")).agg(F.sum("words").alias("words"))
    return one.unionByName(packs.select("doc_id", F.lit("pack").alias("granularity"), "position", "words"))


def speaker_turns(lines: DataFrame, group: str = "conv_id", order: str = "ord") -> DataFrame:
    """group, turn, speaker, first, lines and text: neighbouring lines of one speaker as one turn."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1))
    turned = lines.withColumn("turn", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n")
    return turned.groupBy(group, "turn").agg(F.first("speaker").alias("speaker"), F.min(order).alias("first"), F.count(F.lit(1)).alias("lines"), joined.alias("text"))


def split_turns(turns: DataFrame, most: int = 600, target: int = 300) -> DataFrame:
    """group, turn, piece, words: turns over ``most`` words as sentences packed to ``target``, others whole."""
    words = word_count(F.col("text"))
    t = turns.withColumn("words", words)
    short = t.filter(F.col("words") <= most).select("conv_id", "turn", F.lit(0).alias("piece"), "words")
    rows = t.filter(F.col("words") > most).select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "s")).withColumn("words", word_count(F.col("s")))
    packs = rows.join(packed(rows, ["conv_id", "turn"], target), ["conv_id", "turn", "pos"]).groupBy("conv_id", "turn", F.col("pack").alias("piece")).agg(F.sum("words").alias("words"))
    return short.unionByName(packs)


def sentence_clusters(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, cluster, sentences, words of each ``size`` sentences."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    return rows.groupBy("doc_id", F.floor(F.col("pos") / size).alias("cluster")).agg(F.count(F.lit(1)).alias("sentences"), F.sum(word_count(F.col("s"))).alias("words"))


def question_pairs(turns: DataFrame, group: str = "conv_id", order: str = "ord") -> DataFrame:
    """group, pair, question and answer of alternating turns; an odd last one is dropped."""
    w = Window.partitionBy(group).orderBy(order)
    rows = turns.withColumns({"n": F.row_number().over(w) - 1, "answer": F.lead("text").over(w)})
    return rows.filter((F.col("n") % 2 == 0) & F.col("answer").isNotNull()).select(group, F.floor(F.col("n") / 2).alias("pair"), F.col("text").alias("question"), "answer")


def in_window(lines: DataFrame, captures: DataFrame, before: int = 30, after: int = 30) -> DataFrame:
    """Transcript lines (key, line) whose stamp lies around a capture's second (key, capture_id, second).

    Both sides meet on the key and a bucket of the window's length, so no line meets all captures.
    """
    size = before + after
    l = lines.withColumn("at", stamp_seconds(F.col("line"))).filter("at is not null").withColumn("bucket", F.floor(F.col("at") / size))
    low, high = F.greatest(F.lit(0), F.col("second") - before), F.col("second") + after
    c = captures.withColumns({"low": low, "high": high}).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    return c.join(l, ["key", "bucket"]).filter(F.col("at").between(F.col("low"), F.col("high"))).select("key", "capture_id", "at", "line")
