"""Helpers shared by the operators: lineage cuts, column access, vectorised tokenisation."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line definitions here.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[list(SPACES)] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, for checkpoints and written tables.

    The session's ``spark.checkpoint.dir`` is used when set.  Otherwise a local run gets a temporary
    folder and a cluster the warehouse, which it shares by definition.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.startswith("local["):
            shared = os.path.join(tempfile.gettempdir(), f"checkpoints-{context.applicationId}")
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a checkpoint in the folder all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """``df`` as a compressed table in the folder all executors share, until it is dropped."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.rows = self.spark.read.parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def wide(spark: SparkSession, least: int) -> int:
    """Number of partitions or shards: the session's shuffle partitions, ``least`` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Limit Arrow batches to ``most`` bytes, so that a Python worker holds few texts at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m").lower() in ("64m", "67108864b", "67108864", "-1"):
        spark.conf.set(name, str(most))


def join_by_parts(rows: DataFrame, table: DataFrame, keys: Sequence[str], size: str, parts: int = 1000, nulls: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``table`` on ``keys``; ``size`` says how many rows have a key.

    Fewer than ``parts`` rows of ``table`` can have sizes of more than one ``parts``-th of their sum, however
    many there are, so those are broadcast; no key of the others can fill a task.  ``table`` should be
    cheap to read.  With ``nulls`` a null key is a value.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) > total // parts
    hot, cold = table.filter(often), table.filter(~often)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) if nulls else F.col(f"r.{k}") == F.col(f"t.{k}") for k in keys]
    same = reduce(and_, same)
    shown = ["r.*", *[f"t.{c}" for c in table.columns if c not in keys]]
    found = rows.alias("r").join(F.broadcast(hot.alias("t")), same).select(*shown)
    if cold.isEmpty():
        return found
    left = rows.alias("r").join(F.broadcast(hot.select(*keys).distinct().alias("t")), same, "left_anti")
    return found.unionByName(left.alias("r").join(cold.alias("t"), same).select(*shown))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def pick_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose row of ``judged`` (doc_id, text_sha256, kept; one for each) is kept.

    Rows are found again by id, null being a value, and the digest of their text.  Of rows that agree in
    both, which only further columns could tell apart, one stays; the texts are shuffled for that only
    where there are such rows.
    """
    judged = cut(judged.select("doc_id", "text_sha256", "kept"))
    kept = judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("twins")).filter("kept")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.sha2(text_of("d.text"), 256) == F.col("k.text_sha256"))
    found = docs.alias("d").join(kept.alias("k"), same, "left_semi")
    if kept.filter("twins > 1").isEmpty():
        return found
    sha, number = unused(docs, "_sha"), unused(docs, "_id")
    return found.withColumns({sha: F.sha2(text_of("text"), 256), number: F.col("doc_id").cast("long")}).dropDuplicates([sha, number]).select(*docs.columns)


def id_text(col: str):
    """The id as decimal text: pandas would make floats of long ids beside a null one."""
    return F.col(col).cast("long").cast("string").alias("doc_id")


def id_back(df: DataFrame) -> DataFrame:
    """``df`` with its doc_id of :func:`id_text` as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_of(col: str):
    """The text column, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def chunks_of(sizes, most: int):
    """Consecutive index ranges whose sizes add up to ``most`` or are a single item."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class WordHasher:
    """64-bit hashes of the white-space separated words of many texts in a few vector operations.

    A word's hash comes from differences of a prefix polynomial modulo 2**64, brought to a common
    power by the inverse of its base, and a bijective finaliser.
    """

    BASE = 0x9DDFEA08EB382D69

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            powers = np.full(n + 1, self.BASE, dtype=np.uint64)
            powers[0] = 1
            self.powers = np.cumprod(powers)
            powers[1:] = inverse
            self.inverses = np.cumprod(powers)
        self.size = n

    def words(self, texts: list[bytes]):
        """Hash, text number, start and end (bytes in the joined buffer) of every word, and the buffer."""
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, dtype=np.uint8)
        if len(raw) > self.size:
            self._grow(max(len(raw), 2 * self.size))
        gap = SPACE_TABLE[raw]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=prefix[1:])
            hashes = mix64((prefix[ends] - prefix[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, dtype=np.int64)
        owner = np.searchsorted(begins, starts, side="right") - 1
        return hashes, owner, starts, ends, raw


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words from each position on, where that many are left."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
        return mix64(total + _GOLDEN)
