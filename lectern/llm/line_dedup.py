"""Operator 7: reversible line deduplication with cuckoo filters over exact reference counts.

:class:`LineStore` holds three tables: postings (document, line key), reference counts by key (how many
documents hold it, and the smallest), and for each shard of keys a cuckoo filter of all keys that the
counts hold.  A batch of documents is summed by key and meets the filters shard by shard: a key that its
filter does not know is new, only the others are looked up in the counts.  Inserting and deleting write
the counts of the keys they touch, and no others, as a new segment.  A key enters its filter when its
count rises from nothing and leaves it when the count falls to nothing, so a deletion takes back all
that the insertion did.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, id_back, id_text, join_by_parts, wide

_SLOTS = 4


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, at one of two places each, with a list for overflow."""

    def __init__(self, capacity: int, table: bytes | None = None, overflow: tuple[int, ...] = ()) -> None:
        need = max(1, int(capacity / (_SLOTS * 0.84)) + 1)
        self.buckets = 1 << (need - 1).bit_length()
        self.table = np.frombuffer(table, dtype="<u2").copy() if table is not None else np.zeros(self.buckets * _SLOTS, dtype="<u2")
        self.buckets = len(self.table) // _SLOTS
        self.overflow = list(overflow)

    def holds(self, keys: int) -> bool:
        """Whether ``keys`` keys fill no more than 84 % of the slots."""
        return keys <= 0.84 * len(self.table)

    @staticmethod
    def _fingerprint(h: int) -> int:
        return (h >> 48) or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & (self.buckets - 1)

    def insert(self, h: int) -> None:
        f = self._fingerprint(h)
        at = h & (self.buckets - 1)
        for bucket in (at, self._other(at, f)):
            for s in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if not self.table[s]:
                    self.table[s] = f
                    return
        bucket = self._other(at, f)
        for kick in range(500):
            s = bucket * _SLOTS + (f + kick) % _SLOTS
            f, self.table[s] = int(self.table[s]), f
            bucket = self._other(bucket, f)
            for s in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if not self.table[s]:
                    self.table[s] = f
                    return
        self.overflow.append(f << 32 | min(bucket, self._other(bucket, f)))

    def delete(self, h: int) -> bool:
        """Take out a key that was inserted; false if nothing of it is there."""
        f = self._fingerprint(h)
        at = h & (self.buckets - 1)
        places = (at, self._other(at, f))
        for bucket in places:
            for s in range(bucket * _SLOTS, bucket * _SLOTS + _SLOTS):
                if self.table[s] == f:
                    self.table[s] = 0
                    return True
        if (mark := f << 32 | min(places)) in self.overflow:
            self.overflow.remove(mark)
            return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.uint64)
        f = np.maximum(h >> np.uint64(48), np.uint64(1))
        mask = np.uint64(self.buckets - 1)
        one = h & mask
        with np.errstate(over="ignore"):
            two = (one ^ (f * np.uint64(0x5BD1E995))) & mask
        rows = self.table.reshape(-1, _SLOTS)
        found = (rows[one.astype(np.int64)] == f[:, None]).any(axis=1) | (rows[two.astype(np.int64)] == f[:, None]).any(axis=1)
        if self.overflow:
            found |= np.isin(f << np.uint64(32) | np.minimum(one, two), np.array(self.overflow, dtype=np.uint64))
        return found


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8")[1::2]


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a lower-cased line's key; None for one of fewer than ``least`` code points."""
    line = line.strip(SPACES)
    if len(line) < least or len(line) < 4 * least and len(line.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def postings(docs: DataFrame, least: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and key of each line that counts, once for each row of ``docs``; null texts are one empty line."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                mine = {k for line in (text or "").encode().lower().split(b"\n") if (k := line_key(line, least))}
                ids += [doc] * len(mine)
                keys += sorted(mine)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "key": pd.Series(keys, dtype=object)})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return slim.mapInPandas(work, "doc_id long, key binary")


def references(rows: DataFrame) -> DataFrame:
    """key, refs (documents) and first_doc that holds it; summed before the shuffle."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"))


_FILTERS = "shard int, keys long, table binary, overflow array<long>"


def _load(state: pd.DataFrame) -> tuple[CuckooFilter | None, int]:
    """The filter of a shard's row and how many keys it holds."""
    if not len(state):
        return None, 0
    row = state.iloc[0]
    return CuckooFilter(0, row["table"], tuple(row["overflow"])), int(row["keys"])


def _saved(shard: int, keys: int, cuckoo: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame([{"shard": shard, "keys": keys, "table": cuckoo.table.tobytes(), "overflow": cuckoo.overflow}])


def strip_lines(docs: DataFrame, lost: DataFrame, least: int = 10, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and (``texts``) kept_text of every row of ``docs``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, gone in zip(batch["doc_id"], batch["text"], batch["lost"], strict=True):
                raw = (text or "").encode()
                lines = raw.split(b"\n")
                kept = raw
                left = len(lines)
                if gone is not None and len(gone):
                    out_of = set(gone)
                    stay = [line for line, low in zip(lines, raw.lower().split(b"\n"), strict=True) if line_key(low, least) not in out_of]
                    kept, left = b"\n".join(stay), len(stay)
                row = (doc, len(lines), len(lines) - left, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode()) if texts else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if texts else [])])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id string, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts
    return id_back(slim.join(lost, "doc_id", "left").select(id_text("doc_id"), "text", "lost").mapInPandas(work, schema))


class LineStore:
    """Incremental line deduplication; see the module for its tables.

    ``insert`` adds documents, those already there being replaced, ``delete`` takes documents out; both
    return by how many keys the repeated ones, those of two documents or more, became more or fewer.  Rows with null ids are no documents and are passed
    over, repeated rows with one id are one document, null texts are one empty line, empty batches
    change nothing, and so do ids that are not there.  Each filter has room for twice the keys it was
    made for; a shard that outgrows it gets a new one from the exact counts, and when shards hold over
    four times ``shard_keys`` keys on average, all filters are dealt anew over more shards.  No table is
    sent to the driver or to every task: filters meet keys by shard, a key being one row there however
    many documents hold it.  Segments and tombstones are merged after ``merge_after`` changes.
    """

    def __init__(self, spark: SparkSession, least: int = 10, shards: int | None = None, shard_keys: int = 20_000, merge_after: int = 8) -> None:
        self.spark, self.least, self.shard_keys, self.merge_after = spark, least, shard_keys, merge_after
        self.shards, self.keys, self.repeated, self.changes = shards, 0, 0, 0
        self.rows = spark.createDataFrame([], "doc_id long, key binary")
        self.segments: list[DataFrame] = []
        self.filters = spark.createDataFrame([], _FILTERS)

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards or 1)).cast("int").alias("shard")

    def counts(self, among: DataFrame | None = None) -> DataFrame:
        """key, refs and first_doc as of now, of all keys or of those ``among`` holds: the newest segment has a key's say."""
        if not self.segments:
            return self.spark.createDataFrame([], "key binary, refs long, first_doc long")
        parts = [segment.withColumn("age", F.lit(-i)) for i, segment in enumerate(self.segments)]
        found = reduce(DataFrame.unionByName, parts)
        if among is not None:
            found = found.join(among, "key", "left_semi")
        newest = found.groupBy("key").agg(F.min_by(F.struct("refs", "first_doc"), "age").alias("x")) if len(parts) > 1 else found.select("key", F.struct("refs", "first_doc").alias("x"))
        return newest.select("key", "x.*").filter("refs > 0")

    def _known(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters may know."""

        def ask(state: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            cuckoo, _ = _load(state)
            hit = np.zeros(len(new), dtype=bool) if cuckoo is None or not len(new) else cuckoo.contains(_hash(new["key"].tolist()))
            return new.loc[hit, ["key"]]

        asked = keys.select("key", self._shard())
        return self.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(ask, "key binary")

    def _turn(self, keys: DataFrame) -> None:
        """Put the ``keys`` with sign 1 into the filters, take those with sign -1 out, and let filters grow."""
        self.keys += keys.agg(F.sum("sign")).first()[0] or 0
        self.changes += 1
        if self.keys > 4 * self.shard_keys * self.shards:
            self.shards = -(-self.keys // self.shard_keys)
            self.filters = cut(self._rebuilt(self.counts().select("key")))
            return

        def change(state: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            if not len(new):
                return state
            cuckoo, held = _load(state)
            sign = new["sign"].to_numpy()
            total, most = held + int(sign.sum()), held + int((sign > 0).sum())
            hashes = _hash(new["key"].tolist()).tolist()
            if cuckoo is None:
                cuckoo = CuckooFilter(max(64, 2 * most))
            if not cuckoo.holds(most):  # outgrown: marked by no table, and made from the counts below
                return pd.DataFrame([{"shard": int(new["shard"].iloc[0]), "keys": total, "table": b"", "overflow": []}])
            for h, s in sorted(zip(hashes, sign.tolist(), strict=True), key=lambda x: x[1]):
                cuckoo.insert(h) if s > 0 else cuckoo.delete(h)
            return _saved(int(new["shard"].iloc[0]), total, cuckoo)

        changed = cut(self.filters.groupBy("shard").cogroup(keys.select("key", "sign", self._shard()).groupBy("shard")).applyInPandas(change, _FILTERS))
        full = changed.filter(F.length("table") == 0).select("shard")
        if not full.isEmpty():
            again = self._rebuilt(self.counts().select("key").withColumn("shard", self._shard()).join(full, "shard", "left_semi").select("key"))
            changed = cut(changed.filter(F.length("table") > 0).unionByName(again))
        self.filters = changed

    def _rebuilt(self, keys: DataFrame) -> DataFrame:
        def build(frame: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter(max(64, 2 * len(frame)))
            for h in _hash(frame["key"].tolist()).tolist():
                cuckoo.insert(h)
            return _saved(int(frame["shard"].iloc[0]), len(frame), cuckoo)

        return keys.select("key", self._shard()).groupBy("shard").applyInPandas(build, _FILTERS)

    def _merge(self) -> None:
        """Make one segment of all, and take deleted postings out for good."""
        self.segments, self.rows, self.changes = [cut(self.counts())], cut(self.rows), 0

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> int:
        before = self.repeated
        new = cut(postings(docs, self.least, id_col=id_col, text_col=text_col).distinct())
        if self.segments:
            self._take_out(docs, id_col)
        batch = cut(references(new))
        if self.shards is None:
            self.shards = max(wide(self.spark, 64), -(-batch.count() // self.shard_keys))
        old = self.counts(self._known(batch)).select("key", F.col("refs").alias("had"), F.col("first_doc").alias("old_first"))
        segment = cut(batch.join(old, "key", "left").select("key", F.coalesce("had", F.lit(0)).alias("had"), (F.col("refs") + F.coalesce("had", F.lit(0))).alias("refs"), F.least("first_doc", "old_first").alias("first_doc")))
        self.rows = self.rows.unionByName(new) if self.segments else new
        self._write(segment)
        return self.repeated - before

    def delete(self, ids: DataFrame, *, id_col: str = "doc_id") -> int:
        before = self.repeated
        if self.segments:
            self._take_out(ids, id_col)
        return before - self.repeated

    def _take_out(self, docs: DataFrame, id_col: str) -> None:
        """Lower the counts of the keys of documents, find new first documents where theirs goes, drop empty keys."""
        ids = cut(docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct())
        gone = cut(self.rows.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("less"), F.min("doc_id").alias("least")))
        if gone.isEmpty():
            return
        self.rows = self.rows.join(ids, "doc_id", "left_anti")
        touched = cut(gone.join(self.counts(gone.select("key")), "key").select("key", F.col("refs").alias("had"), (F.col("refs") - F.col("less")).alias("refs"), "first_doc", (F.col("least") == F.col("first_doc")).alias("headless")))
        headless = touched.filter("headless and refs > 0").select("key")
        # Keys of over a thousandth of the postings, fewer than a thousand, stay out of the shuffle.
        often = F.broadcast(cut(self.counts().filter(F.col("refs") > self.rows.count() // 1000).select("key")))
        rest = self.rows.join(often, "key", "left_anti").join(headless, "key", "left_semi")
        common = self.rows.join(F.broadcast(often.join(headless, "key", "left_semi")), "key", "left_semi")
        heads = rest.unionByName(common).groupBy("key").agg(F.min("doc_id").alias("next"))
        self._write(cut(touched.join(heads, "key", "left").select("key", "had", "refs", F.when(F.col("headless"), F.col("next")).otherwise(F.col("first_doc")).alias("first_doc"))))

    def _write(self, segment: DataFrame) -> None:
        """Take up the new counts of touched keys (key, had, refs, first_doc) and turn the filters by them."""
        self.segments.append(segment.select("key", "refs", "first_doc"))
        self.repeated += segment.agg(F.sum((F.col("refs") > 1).cast("int") - (F.col("had") > 1).cast("int"))).first()[0] or 0
        sign = (F.col("refs") > 0).cast("int") - (F.col("had") > 0).cast("int")
        self._turn(segment.select("key", sign.alias("sign")).filter("sign <> 0"))
        if self.changes >= self.merge_after:
            self._merge()

    def lost(self) -> DataFrame:
        """doc_id and the keys whose lines it loses: those that a document of smaller id holds too."""
        repeated = self.counts().filter("refs > 1").select("key", "refs", "first_doc")
        hits = join_by_parts(self.rows, cut(repeated), ("key",), "refs").filter("doc_id > first_doc")
        return hits.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))


def dedup_lines(docs: DataFrame, least: int = 10, *, later: Column | None = None, again: Column | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and (``texts``) kept_text.

    Lines are split at \\n and compared without white space at their ends and with A-Z in lower case.
    Keys of at least ``least`` code points that two documents hold lose all their lines except in the
    smallest doc_id.  The documents go through a :class:`LineStore`: first those for which ``later`` does
    not hold, then the others together with those for which ``again`` holds, which come a second time
    and replace themselves (a deletion and an insertion); the result does not depend on the two.  Both
    must be the same for rows of one doc_id.  Null and empty texts are one empty line.  Repeated rows
    with one doc_id are one document, each keeping its own lines; rows with null doc_id neither count nor
    lose lines.  Empty tables give empty results; further columns are not read.
    """
    store = LineStore(docs.sparkSession, least)
    second = F.lit(False) if later is None else F.coalesce(later, F.lit(False))
    store.insert(docs.filter(~second), id_col=id_col, text_col=text_col)
    if later is not None:
        store.insert(docs.filter(second if again is None else second | F.coalesce(again, F.lit(False))), id_col=id_col, text_col=text_col)
    return strip_lines(docs, store.lost(), least, id_col=id_col, text_col=text_col, texts=texts)
