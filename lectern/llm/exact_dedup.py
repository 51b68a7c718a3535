"""Operator 4: exact deduplication against a minimal perfect hash index of historical digests.

The index is a table of shards.  A shard maps each of its distinct SHA-256 digests to a slot by a
minimal perfect hash (levels of bit arrays, a key sitting at the first level where it is alone), and
a slot holds the full digest and the locator of the row that stays.  A lookup compares all 32 bytes;
members are repeats, nonmembers are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_parts, mix64, pick_rows, text_of, wide

_KEYS_PER_SHARD = 20_000
_LEVELS = 48
_SCHEMA = "shard long, n long, sizes array<long>, bits binary, digests binary, has_id binary, ids binary, seqs binary, counts binary"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(digests.tobytes(), dtype="<u8").reshape(-1, 4)
    with np.errstate(over="ignore"):
        return pair[:, 0] + mix64(pair[:, 2]), pair[:, 1] ^ mix64(pair[:, 3])


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(a + np.uint64(level + 1) * b) % np.uint64(size)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the levels' bits end to end, and each key's slot; keys must be distinct.

    The last size is 0 unless keys are left over after all levels; those come in digest order at the end.
    """
    a, b = _words(digests)
    left, sizes, levels, at, base = np.arange(len(digests)), [], [], np.zeros(len(digests), dtype=np.int64), 0
    while len(left) and len(sizes) < _LEVELS:
        size = max(8, 2 * len(left))
        place = _place(a[left], b[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        hit = alone[place]
        at[left[hit]] = base + place[hit]
        sizes.append(size)
        levels.append(alone)
        base += size
        left = left[~hit]
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    slot = np.cumsum(bits)[at] - 1 if len(bits) else at
    if len(left):  # practically never: 48 collisions in a row
        order = left[np.argsort([digests[i].tobytes() for i in left], kind="stable")]
        slot[order] = int(bits.sum()) + np.arange(len(order))
    return sizes, bits, slot


class Shard:
    """A shard's index, made from its row."""

    def __init__(self, row) -> None:
        self.sizes, self.n = list(row["sizes"]), int(row["n"])
        self.bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8))[: sum(self.sizes)].astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.digests = np.frombuffer(row["digests"], dtype="S1").view(np.uint8).reshape(-1, 32)
        self.has_id, self.ids, self.seqs, self.counts = (np.frombuffer(row[k], dtype=t) for k, t in (("has_id", bool), ("ids", "<i8"), ("seqs", "<i8"), ("counts", "<i8")))

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """Each digest's slot, or -1 where the slot's 32 bytes differ."""
        slot = np.full(len(digests), -1, dtype=np.int64)
        if not len(digests) or not self.n:
            return slot
        a, b = _words(digests)
        left, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            place = base + _place(a[left], b[left], level, size)
            hit = self.bits[place]
            slot[left[hit]] = self.rank[place[hit]]
            left, base = left[~hit], base + size
        tail = {self.digests[i].tobytes(): i for i in range(int(self.bits.sum()), self.n)}
        for i in left if tail else ():
            slot[i] = tail.get(digests[i].tobytes(), -1)
        found = slot >= 0
        same = (self.digests[slot[found]] == digests[found]).all(axis=1)
        slot[np.flatnonzero(found)[~same]] = -1
        return slot


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, 32)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    digests = _bytes(frame["digest"])
    sizes, bits, slot = build_mph(digests)
    order = np.empty(len(slot), dtype=np.int64)
    order[slot] = np.arange(len(slot))
    values = [frame[c].to_numpy()[order] for c in ("has_id", "id", "seq", "n")]
    row = {"shard": frame["shard"].iloc[0], "n": len(frame), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": digests[order].tobytes()}
    return pd.DataFrame([row | {k: v.astype(t).tobytes() for k, v, t in zip(("has_id", "ids", "seqs", "counts"), values, (bool, "<i8", "<i8", "<i8"), strict=True)}])


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with the locator of the row that stays and their count, summed before the shuffle."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "seq"))
    out = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return out.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "best.*", "n")


def digests_of(docs: DataFrame, history: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """seq (a row number of no meaning but to tell repeated rows apart), doc_id, digest and in_history."""
    past = F.lit(False) if history is None else F.coalesce(history, F.lit(False))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), past.alias("in_history"))
    return cut(slim.withColumn("seq", F.monotonically_increasing_id()))


def shards_for(rows: DataFrame) -> int:
    """Shards that keep each at some 20,000 keys, and no fewer than the session has partitions."""
    return max(wide(rows.sparkSession, 256), -(-rows.count() // _KEYS_PER_SHARD))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The index over the distinct digests of ``rows`` (seq, doc_id, digest), a row for each shard."""
    return _grouped(rows, shards).groupBy("shard").applyInPandas(_build, _SCHEMA)


def resolve(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id, keep_seq, group_size over history and arrivals, a row for each distinct digest.

    Arrivals are summed by digest before they meet their shard, so a text that a third of all rows
    holds comes as one row from each task.
    """

    def meet(slots: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(fresh):
            digests, new = _bytes(fresh["digest"]), fresh[["has_id", "id", "seq", "n"]].reset_index(drop=True)
        else:
            digests, new = np.zeros((0, 32), dtype=np.uint8), fresh[["has_id", "id", "seq", "n"]]
        slot = np.full(len(digests), -1, dtype=np.int64)
        if len(slots):
            shard = Shard(slots.iloc[0])
            slot = shard.lookup(digests)
            hit = slot >= 0
            old = pd.DataFrame({"has_id": shard.has_id, "id": shard.ids, "seq": shard.seqs, "n": shard.counts})
            mine, s = new[hit], slot[hit]
            h1, d1, q1 = (old[c].to_numpy()[s] for c in ("has_id", "id", "seq"))
            h2, d2, q2 = (mine[c].to_numpy() for c in ("has_id", "id", "seq"))
            h1, h2 = h1.astype(bool), h2.astype(bool)
            later = (h2 & ~h1) | ((h1 == h2) & ((d2 > d1) | ((d2 == d1) & (q2 > q1))))
            for c in ("has_id", "id", "seq"):
                values = old[c].to_numpy().copy()
                values[s[later]] = mine[c].to_numpy()[later]
                old[c] = values
            counts = old["n"].to_numpy().copy()
            counts[s] += mine["n"].to_numpy()
            old["n"] = counts
            old.insert(0, "digest", [d.tobytes() for d in shard.digests])
            parts.append(old)
        alone = new[slot < 0].copy()
        alone.insert(0, "digest", [d.tobytes() for d in digests[slot < 0]])
        parts.append(alone)
        return pd.concat(parts, ignore_index=True).astype({"has_id": bool})

    groups = index.groupBy("shard").cogroup(_grouped(rows, shards).groupBy("shard")).applyInPandas(meet, "digest binary, has_id boolean, id long, seq long, n long")
    return groups.select("digest", F.when(F.col("has_id"), F.col("id")).alias("keep_id"), F.col("seq").alias("keep_seq"), F.col("n").alias("group_size"))


def mark(docs: DataFrame, history: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows for which ``history`` holds make up the index, the others are looked up in it.  Texts are
    equal when identical, null counting as empty; the row with the largest doc_id stays, null ids being
    smallest, and of repeated rows with that id exactly one.  An empty table gives an empty result;
    further columns are not read.  Rows of a text that makes up over a thousandth of them meet their group by a
    broadcast of these texts, fewer than a thousand, the others by a shuffle.
    """
    rows = digests_of(docs, history, id_col=id_col, text_col=text_col)
    shards = shards_for(rows)
    groups = resolve(build_index(rows.filter("in_history"), shards), rows.filter("not in_history"), shards)
    kept = (F.col("seq") == F.col("keep_seq")).alias("kept")
    met = join_by_parts(rows, cut(groups), ("digest",), "group_size")
    return met.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`mark` keeps; of rows equal in id and text one.

    Null ids are a value, null texts count as empty; empty tables give empty ones.  Needs columns doc_id and
    text; columns of any other names pass through.
    """
    return pick_rows(docs, mark(docs, history))
