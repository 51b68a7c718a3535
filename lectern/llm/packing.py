"""Operator 12: packing token sequences, shortest pack first, over the histogram of lengths.

A document's ids and an end id are cut into pieces of the capacity and a rest.  Only the histogram of the
pieces' lengths, at most ``capacity`` rows, reaches the driver.  There the lengths are placed, longest
first: a length goes into the packs with the most room, and packs with the same content are one pattern
with a count, so the work depends on the number of lengths and not on that of documents.  A pattern's
place for a length stands for consecutive ranks among the pieces of that length, which are found by
counting, and so every piece gets its sequence and offset.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PLAIN_WORDS, ForcedBoundaryBpe, Recent
from .common import cut, id_back, id_text, text_of

_WORDS_AND_GAPS = re.compile(PLAIN_WORDS.pattern + "|\n")
#: Characters that ``PLAIN`` lacks or ``ODD_SPACE`` has.
_NOT_PLAIN = "[^\\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]"


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of the byte-level alphabet: printable Latin-1 stands for itself, the rest follows 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder(ForcedBoundaryBpe):
    """Ids, as little-endian 32-bit numbers, of texts by a tokenizer file whose words never span white space.

    Each chunk between white space is encoded once for a batch of texts, whose ids are then put together
    from those of their chunks.  Words are merged by a byte-pair library that joins what gives the token of
    least id.  With merges in the order of ids that is the same, if every token comes out whole when it is
    merged alone: two tokens side by side that make up a token are then a listed merge, since the merges
    inside a token do not depend on what is around it.  Tokens that do not come out whole are never made
    and are left out.  The end of a word is byte 0xFF, which no UTF-8 text has.  Plain chunks of a batch go to
    the library in one call; there words end in ``END``, which no plain chunk has, and a line feed, with an
    id of its own, ends a chunk.  Other chunks are encoded one by one and remembered, ``size`` in each of
    the memory's two generations.
    """

    END = "\x1f"

    def __init__(self, path: str, size: int = 200_000) -> None:
        import tiktoken

        super().__init__(path, size)
        self.memory = Recent(size)
        ordered = sorted((self.vocab[a + b], i) for (a, b), i in self.ranks.items())
        assert [i for _, i in ordered] == sorted(i for _, i in ordered), "ids must follow the order of merges"
        self.byte_of = byte_alphabet()
        known: dict[bytes, int] = {}
        for token, i in self.vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            symbols = token.removesuffix(self.suffix) if ends else token
            if all(c in self.byte_of for c in symbols) and self._merge(symbols, ends) == [token]:
                known[bytes(map(self.byte_of.__getitem__, symbols)) + b"\xff" * ends] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=known, special_tokens={})._encode_single_piece
        self.end = b"\xff" if self.suffix else b""
        mark = self.END.encode()
        marked = {token.replace(b"\xff", mark): i for token, i in known.items() if mark not in token}
        self.gap = marked[b"\n" + mark * bool(self.suffix)] = max(self.tokens) + 1
        self.pieces = tiktoken.Encoding("marked", pat_str=f"[^{self.END}]+" + self.END * bool(self.suffix), mergeable_ranks=marked, special_tokens={}).encode_ordinary
        self.odd = re.compile("|".join([_NOT_PLAIN, *map(re.escape, self.added)]) if self.plain else "")

    def encode_word(self, word: str) -> list[int]:
        return self.piece(bytes(map(self.byte_of.__getitem__, word)) + self.end)

    def _odd_chunk(self, chunk: str) -> np.ndarray:
        if (known := self.memory.get(chunk)) is None and (known := self.memory.recall(chunk)) is None:
            known = np.array([i for word in self._any_text(chunk) for i in word], dtype="<u4")
            if len(chunk) <= 64:
                self.memory.keep(chunk, known)
        return known

    def _chunks(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in some order, and where those of each chunk start and how many they are; a line feed ends a chunk."""
        odd: dict[int, np.ndarray] = {}
        if self.odd.search(joined):
            chunks = joined.split("\n")
            odd = {i: self._odd_chunk(chunk) for i, chunk in enumerate(chunks[:-1]) if self.odd.search(chunk)}
            for i in odd:
                chunks[i] = ""
            joined = "\n".join(chunks)
        ids = np.array(self.pieces(self.END.join([*_WORDS_AND_GAPS.findall(joined.lower()), ""])), dtype="<u4")
        ends = np.flatnonzero(ids == self.gap)
        starts = np.concatenate(([0], ends[:-1] + 1))
        sizes = ends - starts
        if odd:
            where = list(odd)
            sizes[where] = [len(x) for x in odd.values()]
            starts[where] = len(ids) + np.cumsum(sizes[where]) - sizes[where]
            ids = np.concatenate([ids, *odd.values()])
        return ids, starts, sizes

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after the other's, and how many each text has."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        split = pc.ascii_split_whitespace(texts)
        codes = split.values.dictionary_encode()
        ids, starts, sizes = self._chunks("\n".join([*codes.dictionary.to_numpy(zero_copy_only=False), ""]))
        at = codes.indices.to_numpy()
        until = np.concatenate(([0], np.cumsum(sizes[at])))
        number = np.int32 if max(until[-1], len(ids)) < 1 << 31 else np.int64
        taken = np.repeat((starts[at] - until[:-1]).astype(number), sizes[at])
        taken += np.arange(len(taken), dtype=number)
        return ids[taken], np.diff(until[split.offsets.to_numpy()])

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0].tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every row of ``docs``.

    A document's ids, then ``end``, are cut after each ``capacity`` of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids, totals = encoder.batch(batch.column("text"))
            ids, totals = np.insert(ids, np.cumsum(totals), end), totals + 1
            count = -(-totals // capacity)
            doc = np.repeat(np.arange(len(totals)), count)
            start = (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * capacity
            length = np.minimum(capacity, totals[doc] - start)
            first = (np.cumsum(totals) - totals)[doc] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, totals[doc]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


Pattern = tuple[tuple[int, int], ...]


def pack_histogram(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, Pattern]]:
    """Patterns ((length, times), ...) and how many packs have each, from the number of pieces by length.

    A length for which no pack has room opens as many packs as hold all its pieces that are left.
    """
    room: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    widest: list[int] = []

    def put(free: int, count: int, pattern: Pattern) -> None:
        if not room[free]:
            heapq.heappush(widest, -free)
        room[free].append((count, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = -widest[0] if widest else 0
            if free < length:
                opened = -(-left // (capacity // length))
                put(capacity - length, opened, ((length, 1),))
                left -= opened
                continue
            count, pattern = room[free].pop()
            if not room[free]:
                heapq.heappop(widest)
            taken = min(count, left)
            if count > taken:
                put(free, count - taken, pattern)
            longer = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(free - length, taken, longer)
            left -= taken
    return [x for free in sorted(room) for x in room[free]]


def places(patterns: list[tuple[int, Pattern]]) -> np.ndarray:
    """length, first rank, packs, first sequence and offset of every pattern's place, by length and rank.

    Of ``packs * times`` consecutive ranks of a length, each ``packs`` go to as many sequences in order,
    each next lot by a length further in.
    """
    out, ranks, sequence = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, ranks[length], count, sequence, offset))
            ranks[length] += count * times
            offset += length * times
        sequence += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Add ``rank``, from 0, among the rows with the same ``by``, without gathering these.

    ``rows`` must hold ``part`` (of a bounded number of rows) and ``row``, which orders them.
    """
    sums = rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy(by, "part").orderBy("row")))
    return inside.join(sums, [by, "part"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside")


_PART = 65_536


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence's pieces lie side by side from offset 0 and are ``capacity`` long in all at most.  Null
    and empty texts are the end id alone.  Repeated rows and rows with equal or null ids are documents of
    their own; an empty table gives an empty result; further columns are not read; texts of any length are
    encoded whole.  The tokenizer file must be readable at ``path`` on every executor.  A long text has
    a row for every ``capacity`` ids; pieces are ranked in parts of at most 65,536 rows of a task.
    """
    number = F.monotonically_increasing_id()
    found = cut(pieces(docs, path, capacity, end, id_col=id_col, text_col=text_col).withColumn("row", number).withColumn("part", F.floor(F.col("row") / _PART)))
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    table = found.sparkSession.sparkContext.broadcast(places(pack_histogram(counts, capacity)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, packs, sequence, offset = table.value.T
        keys = (length << 48) + first
        for batch in batches:
            at = np.searchsorted(keys, (batch["length"].to_numpy() << 48) + batch["rank"].to_numpy(), side="right") - 1
            lot, pick = np.divmod(batch["rank"].to_numpy() - first[at], np.maximum(packs[at], 1))
            out = batch.drop(columns="rank")
            out["sequence_id"], out["offset"] = sequence[at] + pick, offset[at] + lot * length[at]
            yield out

    slim = ranked(found, "length").select(id_text("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "rank")
    return id_back(slim.mapInPandas(work, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
