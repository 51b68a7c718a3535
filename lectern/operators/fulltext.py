"""English full-text search: lexemes with positions, boolean and phrase queries, rank and headlines.

A passage's words are numbered from 1, stop words too; the others are stemmed.  Postings say at which
places a passage has a lexeme.  They can be written once, in buckets of lexemes, so that a question reads
only the buckets of its lexemes; or a scan of the passages answers a question without them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import lexeme

#: Words of digits and letters, most positions of a lexeme and the last position that is told apart.
WORD = r"[\p{L}\p{N}]+"
MOST_POSITIONS, LAST_POSITION = 256, 16383
#: Weight of a plain position and the limit of the sum of 1/n^2.
WEIGHT, SUM_OF_SQUARES = 0.1, 1.64493406685
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class TextQuery:
    """Alternatives of required and excluded phrases; a phrase is lexemes with distances from its first."""

    any_of: tuple[tuple[tuple[tuple[tuple[str, int], ...], ...], tuple[tuple[tuple[str, int], ...], ...]], ...]

    @property
    def lexemes(self) -> list[str]:
        """All lexemes of the question, excluded ones too."""
        return sorted({x for wanted, barred in self.any_of for phrase in (*wanted, *barred) for x, _ in phrase})

    @property
    def sought(self) -> list[str]:
        return sorted({x for wanted, _ in self.any_of for phrase in wanted for x, _ in phrase})


def phrase_of(text: str) -> tuple[tuple[str, int], ...]:
    """Lexemes and their distances from the first one; a stop word leaves a gap."""
    found = [(x, i) for i, w in enumerate(_WORD.findall(text.lower())) if (x := lexeme(w)) is not None]
    return tuple((x, i - found[0][1]) for x, i in found)


def web_query(text: str) -> TextQuery:
    """Words are all required, ``or`` starts an alternative, ``-`` excludes, quotes make a phrase."""
    groups: list[tuple[list, list]] = [([], [])]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            groups.append(([], []))
        elif phrase := phrase_of(quoted or word):
            groups[-1][bool(minus)].append(phrase)
    return TextQuery(tuple((tuple(wanted), tuple(barred)) for wanted, barred in groups if wanted or barred))


def phrase_query(text: str) -> TextQuery:
    """The words of ``text`` side by side."""
    phrase = phrase_of(text)
    return TextQuery((((phrase,), ()),) if phrase else ())


def _positions(texts: pd.Series, only: frozenset[str] | None) -> list[tuple[list[dict], int, int]]:
    memory: dict[str, str | None] = {}
    out = []
    for text in texts:
        places: dict[str, list[int]] = {}
        for i, word in enumerate(_WORD.findall((text or "").lower()), 1):
            if word not in memory:
                memory[word] = lexeme(word)
            if (x := memory[word]) is not None:
                mine = places.setdefault(x, [])
                if len(mine) < MOST_POSITIONS and (not mine or mine[-1] < LAST_POSITION):
                    mine.append(min(i, LAST_POSITION))
        kept = [{"lexeme": x, "positions": p} for x, p in places.items() if only is None or x in only]
        out.append((kept, len(places), sum(map(len, places.values()))))
    return out


def found_positions(passages: DataFrame, only: list[str] | None = None, *, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, found (lexeme and positions of all lexemes, or of those in ``only``), lexemes and places (their numbers in the passage)."""
    wanted = None if only is None else frozenset(only)
    kind = dict(passages.dtypes)[id_col]
    item = "array<struct<lexeme:string,positions:array<int>>>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _positions(batch["text"], wanted)
            yield pd.DataFrame([(i, *row) for i, row in zip(batch["id"], rows, strict=True)], columns=["id", "found", "lexemes", "places"])

    slim = passages.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(work, f"id string, found {item}, lexemes long, places long").withColumn("id", F.col("id").cast(kind))


class TextIndex:
    """Postings (lexeme, id, positions, lexemes, places) in a folder, by buckets of lexemes.

    A lexeme's rows are dealt over ``parts`` files of its bucket, so a frequent one fills no single task.
    """

    def __init__(self, rows: DataFrame, buckets: int) -> None:
        self.rows, self.buckets = rows, buckets

    @staticmethod
    def _bucket(column: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    @classmethod
    def write(cls, passages: DataFrame, folder: str, buckets: int = 64, parts: int = 4, **columns: str) -> TextIndex:
        each = found_positions(passages, **columns).select("id", "lexemes", "places", F.explode("found").alias("x")).select("x.lexeme", "id", "x.positions", "lexemes", "places")
        placed = each.withColumn("bucket", cls._bucket(F.col("lexeme"), buckets)).repartition(buckets * parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(parts)))
        placed.sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").parquet(folder)
        return cls.read(passages.sparkSession, folder, buckets)

    @classmethod
    def read(cls, spark, folder: str, buckets: int = 64) -> TextIndex:
        return cls(spark.read.parquet(folder), buckets)

    def found_positions(self, only: list[str]) -> DataFrame:
        """As :func:`found_positions`, of the passages that have one of ``only``; reads the buckets of these."""
        spark = self.rows.sparkSession
        asked = spark.createDataFrame([(x,) for x in only], "lexeme string").select(self._bucket(F.col("lexeme"), self.buckets).alias("b")).distinct()
        hits = self.rows.filter(F.col("bucket").isin([r.b for r in asked.collect()]) & F.col("lexeme").isin(only))
        return hits.groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("found"), F.first("lexemes").alias("lexemes"), F.first("places").alias("places"))


def _places(name: str) -> Column:
    """Positions of a lexeme in ``found``, empty without it."""
    return F.flatten(F.transform(F.filter("found", lambda x: x["lexeme"] == name), lambda x: x["positions"]))


def _holds(phrase: tuple[tuple[str, int], ...], at: dict[str, Column]) -> Column:
    (first, _), rest = phrase[0], phrase[1:]
    if not rest:
        return F.size(at[first]) > 0
    return F.exists(at[first], lambda p: _all([F.array_contains(at[x], (p + gap).cast("int")) for x, gap in rest]))


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def query_matches(query: TextQuery) -> Column:
    """Whether the lexemes and positions ``found`` in a passage meet the question."""
    at = {x: _places(x) for x in query.lexemes}
    out = F.lit(False)
    for wanted, barred in query.any_of:
        out = out | _all([*(_holds(p, at) for p in wanted), *(~_holds(p, at) for p in barred)])
    return out


def nearness(distance: float) -> float:
    """How much two words at this distance count together."""
    return 1e-30 if distance > 100 else 1.0 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))


def rank(query: TextQuery, normalise: int = 0) -> Column:
    """The question's rank in a passage.

    With alternatives, or a single lexeme, each lexeme counts the sum of weight/n^2 over its occurrences,
    in share of the limit of that sum, and the mean over all lexemes is taken.  Otherwise every pair of
    positions of two lexemes counts weight * sqrt(nearness), and these are joined like chances; none at all
    gives 1e-20.  ``normalise`` adds up divisions: 1 by 1 + the logarithm of the length, 2 by the length, 8 by the
    number of lexemes, 16 by 1 + its logarithm, 32 by the rank + 1.
    """
    names = query.lexemes
    at = {x: _places(x) for x in names}
    if len(names) < 2 or len(query.any_of) > 1:
        squares = [0.0]
        for i in range(1, MOST_POSITIONS + 1):
            squares.append(squares[-1] + 1.0 / (i * i))
        table = F.array(*[F.lit(WEIGHT * s / SUM_OF_SQUARES) for s in squares])
        out = sum((F.element_at(table, F.size(at[x]) + 1) for x in names), F.lit(0.0)) / max(1, len(names))
    else:
        near = F.array(*[F.lit(1 - WEIGHT * math.sqrt(nearness(d))) for d in range(1, 102)])
        missed = F.lit(1.0)
        for j, b in enumerate(names):
            for a in names[:j]:
                missed = F.aggregate(F.filter(_apart(at[b], at[a]), lambda d: d > 0), missed, lambda acc, d: acc * F.element_at(near, F.least(d, F.lit(101))))
        seen = sum(((F.size(at[x]) > 0).cast("int") for x in names), F.lit(0)) > 1
        out = F.when(seen, 1 - missed).otherwise(F.lit(1e-20))
    if normalise & 1:
        out = out / (F.log(F.col("places") + 1.0) / math.log(2.0))
    if normalise & 2:
        out = out / F.greatest(F.col("places"), F.lit(1))
    if normalise & 8:
        out = out / F.greatest(F.col("lexemes"), F.lit(1))
    if normalise & 16:
        out = out / (F.log(F.col("lexemes") + 1.0) / math.log(2.0))
    return out / (out + 1) if normalise & 32 else out


def _apart(one: Column, other: Column) -> Column:
    """The distances between all positions of two lexemes."""
    return F.flatten(F.transform(one, lambda p: F.transform(other, lambda q: F.abs(p - q))))


def search_ranked(found: DataFrame, query: TextQuery, limit: int | None = 20, normalise: int = 0) -> DataFrame:
    """id and score of the ``limit`` best passages (all without) by rank, then id, from :func:`found_positions`."""
    hits = found.filter(query_matches(query)).select("id", F.round(rank(query, normalise), 9).alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), "id").limit(limit)


def cover(hits: list[tuple[int, str]]) -> tuple[int, int] | None:
    """First and last place of the shortest window with the most different lexemes, of ties the first; a fold over the hits."""
    inside: dict[str, int] = {}
    best: tuple[int, int, int, int] | None = None
    start = 0
    for end, (place, name) in enumerate(hits):
        inside[name] = inside.get(name, 0) + 1
        while inside[hits[start][1]] > 1:
            inside[hits[start][1]] -= 1
            start += 1
        window = (-len(inside), place - hits[start][0], hits[start][0], place)
        if best is None or window < best:
            best = window
    return None if best is None else best[2:]


def headline(text: str, sought: frozenset[str], least: int = 20, most: int = 60, short: int = 3) -> str:
    """The words around the best cover of a text, ``least`` to ``most`` of them, sought ones between double asterisks.

    It begins with the cover, goes on until ``least`` words, then to the first word of more than ``short``
    letters; where the text ends before, words in front are added.
    """
    words = [(m.start(), m.end(), lexeme(m[0].lower())) for m in _WORD.finditer(text)]
    if not words:
        return ""
    window = cover([(i, x) for i, (_, _, x) in enumerate(words) if x in sought]) or (0, 0)
    first = window[0]
    last = min(max(window[1], first + least - 1), first + most - 1, len(words) - 1)
    while last + 1 < min(first + most, len(words)) and words[last][1] - words[last][0] <= short:
        last += 1
    first = max(0, min(first, last - least + 1))
    out, at = [], words[first][0]
    for start, end, x in words[first : last + 1]:
        out.append(text[at:start] + (f"**{text[start:end]}**" if x in sought else text[start:end]))
        at = end
    return "".join(out)


def with_headlines(hits: DataFrame, query: TextQuery, text_col: str = "text", **options: int) -> DataFrame:
    """``hits`` with ``snippet`` in place of the text."""
    sought = frozenset(query.sought)

    @F.pandas_udf("string")
    def show(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: headline(t or "", sought, **options))

    return hits.withColumn("snippet", show(F.col(text_col))).drop(text_col)


def keyword_search(passages: DataFrame, text: str, limit: int = 20, *, phrase: bool = False, normalise: int = 0, index: TextIndex | None = None) -> DataFrame:
    """chunk_id, score and snippet of the ``limit`` best passages (chunk_id, text) for a question, or an exact phrase.

    Positions come from ``index`` where there is one.  Null texts have no words; a question of stop words
    alone finds nothing; ties go to the smaller id; chunk_id must be unique.  Only the found passages'
    texts are read for headlines.
    """
    query = phrase_query(text) if phrase else web_query(text)
    if not query.any_of:
        return passages.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
    found = index.found_positions(query.lexemes) if index is not None else found_positions(passages, query.lexemes)
    best = search_ranked(found, query, limit, normalise).withColumnRenamed("id", "chunk_id")
    shown = passages.select("chunk_id", "text").join(F.broadcast(best), "chunk_id")
    return with_headlines(shown, query).select("chunk_id", "score", "snippet").orderBy(F.desc("score"), "chunk_id")
