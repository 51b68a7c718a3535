"""Structured answers taken apart: blocks of tensions between two reflections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the answer format.
NONE_FOUND, BLOCK = "NO_TENSIONS_FOUND", "TENSION:"
KINDS = ("contradiction", "evolution", "uncertainty", "qualification")


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group, null without a match."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def tensions(answers: DataFrame, reflections: DataFrame) -> DataFrame:
    """answer_id, pos, description, kind, and of either side chunk, evidence and day, from ``answers`` (answer_id, raw).

    ``reflections`` (answer_id, number from 1, chunk_id, date) are what the blocks refer to; blocks that do not
    name two of them are left out, and an answer that says it found none has none.  Of repeated lines
    the last valid one counts; a kind that is not known is an uncertainty.
    """
    blocks = F.slice(F.split("raw", BLOCK), 2, 1_000_000_000)
    each = answers.filter(~F.col("raw").contains(NONE_FOUND)).select("answer_id", F.posexplode(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))).alias("pos", "block"))
    lines = F.regexp_replace(F.col("block"), r"(?m)^[ \t]+", "")
    after = F.regexp_extract(lines, r"(?s)^[^\n]*\n(.*)$", 1)
    kind = F.filter(F.transform(F.regexp_extract_all(after, F.lit(r"(?m)^TYPE:(.*)$"), F.lit(1)), lambda x: F.lower(F.trim(x))), lambda x: x.isin(*KINDS))
    fields = each.select("answer_id", "pos", F.trim(F.regexp_extract(lines, r"^([^\n]*)", 1)).alias("description"), F.coalesce(F.try_element_at(kind, F.lit(-1)), F.lit("uncertainty")).alias("kind"), after.alias("after"))
    for side in ("a", "b"):
        pattern = rf"(?m)^REF_{side.upper()}:[ \t]*([0-9]+)[ \t]*[—-][ \t]*(.*)$"
        fields = fields.withColumns({f"number_{side}": _last(F.col("after"), pattern).try_cast("long"), f"evidence_{side}": F.trim(_last(F.col("after"), pattern, 2))})
        known = reflections.select("answer_id", F.col("number").cast("long").alias(f"number_{side}"), F.col("chunk_id").alias(f"chunk_{side}"), F.coalesce(F.left(F.col("date").cast("string"), F.lit(10)), F.lit("")).alias(f"date_{side}"))
        fields = fields.join(known, ["answer_id", f"number_{side}"])
    return fields.select("answer_id", "pos", "description", "kind", "chunk_a", "chunk_b", "evidence_a", "evidence_b", "date_a", "date_b")
