"""Operator 8 (DataFrame functions only): secrets, judged by how widely their owners share them.

Patterns give candidates.  The hash of each candidate's value is counted over the corpus by distinct
repositories and owners: a value copied among many owners is an example, one that a single owner holds,
in however many repositories, and that looks random is taken for live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, its least length, and whether matches always count."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool


_AFTER = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In this order spans with the same start are listed.
KINDS = (
    Kind("assign", r"((?i:password|passwd|secret|token|api_?key))" + _AFTER, 2, 6, True),
    Kind("access", r"(AKIA[A-Z0-9]{16,})", 1, 20, True),
    Kind("hex", r"([0-9a-f]{24,})", 1, 24, True),
    Kind("cred", r"((?i:pwd|credential|private_?key|auth_?key))" + _AFTER, 2, 12, False),
    Kind("vendor", r"(gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 24, False),
)


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Array of (kind, at, gap, width, value) of the pattern's matches; gap is the text since the last one."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.char_length(x))
    whole, value = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, kind.group))
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), x["gap"].cast("long").alias("gap"), F.char_length(x["whole"]).cast("long").alias("width"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,at:int,gap:bigint,width:bigint,value:string>>")
    return F.when(text.rlike(kind.pattern), F.filter(zipped, lambda x: x["value"].isNotNull())).otherwise(none)


def _random_looking(value: Column) -> Column:
    classes = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    return (F.char_length(value) >= 16) & (classes >= 2) & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike("(?i)example|sample|dummy|changeme|xxxx|1234567|placeholder")


def scan(docs: DataFrame, *, max_owners: int = 1, wide_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every row of ``docs`` with its seq, and every span found.

    Spans have seq, kind, start, end (code points), value_hash, owners, repositories and verdict: live,
    example or unclear.  Null owners and repositories count as one each.
    """
    text = text_of(text_col)
    arrays = F.concat(*[_matches(text, i, k) for i, k in enumerate(KINDS)])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"), arrays.alias("found"))
    rows = cut(slim.withColumn("seq", F.monotonically_increasing_id()))
    each = rows.select("seq", "owner", "repository", F.explode("found").alias("x")).select("seq", "owner", "repository", "x.*")
    upto = Window.partitionBy("seq", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(upto)).withColumn("start", F.col("end") - F.col("width"))
    placed = placed.filter(F.char_length("value") >= least).withColumns({"value_hash": F.md5("value"), "random": _random_looking(F.col("value"))})
    placed = cut(placed.select("seq", "owner", "repository", "kind", "start", "end", "value_hash", "random"))
    held = placed.groupBy("value_hash", "owner", "repository").agg(F.max("random").alias("random"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("random").alias("random"))
    spread = by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("random").alias("random"))
    live = F.col("random") & (F.col("owners") <= max_owners)
    spread = spread.withColumn("verdict", F.when(live, "live").when(F.col("owners") >= wide_owners, "example").otherwise("unclear")).drop("random")
    spans = placed.drop("owner", "repository", "random").join(spread, "value_hash")
    return rows.select("seq", "doc_id"), spans


def find(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Matches of the base kinds always count; those of the others are added where the verdict is live.
    spans lists kind:start:end by start, then kind, joined by commas; base_sha256 is the digest of the
    base kinds' list.  Null and empty texts have no spans; repeated rows count each (as one repository);
    an empty table gives an empty result; further columns are not read.  Options as for :func:`scan`.
    """
    rows, spans = scan(docs, **options)
    base = F.element_at(F.array(*[F.lit(k.base) for k in KINDS]), F.col("kind") + 1)
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    shown = spans.withColumns({"base": base, "label": F.concat_ws(":", name, "start", "end")}).filter(F.col("base") | (F.col("verdict") == "live"))
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "label", "base")))
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    verdicts = [F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}") for v in ("live", "example")]
    by_row = shown.groupBy("seq").agg(*counts, *verdicts, listed.alias("listed"))
    joined = rows.join(by_row, "seq", "left")
    labels = F.coalesce("listed", F.array().cast(by_row.schema["listed"].dataType))
    own = F.array_join(F.transform(F.filter(labels, lambda x: x["base"]), lambda x: x["label"]), ",")
    everything = F.array_join(F.transform(labels, lambda x: x["label"]), ",")
    number = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return joined.select("doc_id", *number, F.sha2(own, 256).alias("base_sha256"), everything.alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")])
