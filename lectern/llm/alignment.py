"""Operator 11: aligning the tokens of two tokenizers, relationally.

Tokens are exploded with their positions, windowed sums of their byte lengths give their ends, an
equi-join on document and end gives the places where both tokenizers cut, and the running number of such
cuts is the group.  A group's tokens of either side are those between two cuts; all pairs across are links.

Both tokenizers surely cut where white space follows a word, as no token of either goes across.  The
fragments between such cuts are aligned by themselves, and the most frequent ones, at most ``KNOWN`` of
them, are aligned once for all documents and sent to the tasks; what is left of a document is its rest,
and the relational steps run on the rests.  Which fragments are known changes no result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, chunks_of, cut, text_of, wide
from .packing import byte_alphabet

#: How many fragments, and how many links, are known to every task.
KNOWN = 1 << 18
#: The fixed word pattern of the byte-level tokenizer's family.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r"\s\s|[^\S \n]")
_FRAGMENT = re.compile(r"\s*\S*(?:[^\S \n]\s*\S*)*")
_LONGEST = 64
#: Characters of texts, and fragments and tokens, that are taken at a time.
_TEXTS, _LINKED = 1 << 19, 1 << 16


def fragment_keys(text: str) -> list[str]:
    """The fragments of a space and ``text``: cut between other than white space and a space or line end.

    A fragment of one space and what follows is named by the latter.
    """
    if not _ODD.search(f" {text}"):
        return text.replace("\n", " \n").split(" ")
    found = _FRAGMENT.findall(f" {text}")[:-1]
    return [f[1:] if f[0] == " " and not f[1:2].isspace() else f for f in found]


def fragment(key: str) -> str:
    return key if key[:1].isspace() else f" {key}"


class Tokenizers:
    """Tokens of fragments by a byte-level BPE file (A) and a sentencepiece model (B)."""

    def __init__(self, bytes_path: str, piece_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(bytes_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {a["content"] for a in spec["added_tokens"]}
        byte_of = byte_alphabet()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.left = tiktoken.Encoding("left", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.right = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        assert not any(re.search("[^▁]▁|\n", p) for p in pieces), "a token goes across white space"
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.encode().replace("▁".encode(), b" ") for i, p in enumerate(pieces)]
        self.lengths = [np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes)]
        self.before = len(self.right.encode("a"))

    def of(self, keys: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of A and B the ids of all ``keys`` in a row and where each key's begin, and whether both sides' bytes are the key's fragment."""
        parts = [fragment(k) for k in keys]
        right = self.right.encode([f"a{p}" for p in parts], num_threads=1)  # a word in front keeps the fragment's own space
        lists = list(map(self.left, parts)), [ids[self.before :] for ids in right]
        raw = [p.encode() for p in parts]
        ids = [np.array(list(chain.from_iterable(x)), dtype=np.int64) for x in lists]
        begins = [np.fromiter(accumulate(map(len, x), initial=0), dtype=np.int64, count=len(keys) + 1) for x in lists]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(keys))
        ends = [np.concatenate(([0], np.cumsum(length[i])))[begin] for length, i, begin in zip(self.lengths, ids, begins, strict=True)]
        whole = np.logical_and(*(np.diff(e) == size for e in ends))
        written = [b"".join(map(table.__getitem__, chain.from_iterable(x))) for table, x in zip((self.a_bytes, self.b_bytes), lists, strict=True)]
        if not whole.all() or any(w != b"".join(raw) for w in written):
            for text, end in zip(written, ends, strict=True):
                whole &= np.array([text[x:y] == r for x, y, r in zip(end[:-1].tolist(), end[1:].tolist(), raw, strict=True)], dtype=bool)
        return ids, begins, whole


@lru_cache(maxsize=2)
def _tokenizers(bytes_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(bytes_path, piece_path)


def common_cuts(rows: DataFrame) -> DataFrame:
    """key and cuts (in order; positions of the A and the B token that end there) from key, a_len and b_len.

    ``rows`` must have unique keys and be partitioned by them; then nothing more is shuffled.
    """
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    by_place = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def ends(side: str) -> DataFrame:
        tokens = rows.select("key", F.posexplode(f"{side}_len").alias("pos", "len"))
        return tokens.select("key", F.sum("len").over(by_place).alias("end"), F.col("pos").alias(side))

    both = ends("a").join(ends("b"), ["key", "end"])
    group = F.row_number().over(Window.partitionBy("key").orderBy("end"))
    return both.select("key", group.alias("group"), "a", "b").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("group", "a", "b"))).alias("cuts"))


class Lists:
    """The values and begins of a batch's list column."""

    def __init__(self, column: pa.ListArray) -> None:
        self.begin = column.offsets.to_numpy()
        low, high = (int(self.begin[0]), int(self.begin[-1])) if len(self.begin) else (0, 0)
        self.values, self.begin = column.values.slice(low, high - low), self.begin.astype(np.int64) - low

    def numbers(self) -> np.ndarray:
        return self.values.to_numpy(zero_copy_only=False).astype(np.int64)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


class Tally:
    """Sums of documents by pair over a task's batches, put out when they are many.

    Spark sums what a task puts out again before the shuffle, so ``most`` only bounds the worker's memory.
    """

    def __init__(self, most: int = 1 << 18) -> None:
        self.most, self.size, self.parts = most, 0, []

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        pair, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names, place = np.unique(pair, return_inverse=True)
        return names, np.bincount(place, weights=docs, minlength=len(names)).astype(np.int64)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            pair, docs = self._summed()
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs)], names=["pair", "docs"])
        self.size, self.parts = 0, []

    def add(self, pair: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((pair, docs))
        self.size += len(pair)
        if self.size > 2 * self.most:
            self.parts = [self._summed()]
            self.size = len(self.parts[0][0])
            if self.size > self.most:
                yield from self.rest()


class Groups:
    """The groups of a batch of token lists that :func:`common_cuts` has cut, in order, and their links."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        a, b, cuts = (Lists(batch.column(name)) for name in ("a_ids", "b_ids", "cuts"))
        self.a, self.b, self.a_begin, self.b_begin = a.numbers(), b.numbers(), a.begin, b.begin
        self.row = cuts.owner()
        field = {name: cuts.values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("a", "b")}
        last_a, last_b = field["a"] + a.begin[self.row], field["b"] + b.begin[self.row]
        self.a_from, self.b_from = (np.concatenate(([0], last[:-1] + 1)) if len(last) else last for last in (last_a, last_b))
        self.a_size, self.b_size = last_a + 1 - self.a_from, last_b + 1 - self.b_from

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and pair (A id * 2**32 + B id) of every link."""
        many = self.a_size * self.b_size
        which = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        a, b = np.divmod(at, self.b_size[which])
        return self.row[which], (self.a[self.a_from[which] + a] << 32) + self.b[self.b_from[which] + b]

    def written(self) -> tuple[list[str], np.ndarray]:
        """All tokens as text in the order of groups, A before B, with what follows each; and how many come before each A token."""
        words, n, m = _decimals(), _IDS, len(self.a) + len(self.b)
        of_a, of_b = (np.repeat(np.arange(len(self.row)), size) for size in (self.a_size, self.b_size))
        place_a = np.arange(len(self.a)) + (np.cumsum(self.b_size) - self.b_size)[of_a]
        place_b = np.arange(len(self.b)) + np.cumsum(self.a_size)[of_b]
        coded = np.zeros(m, dtype=np.int64)
        coded[place_a] = self.a + n * np.where(np.append(of_a[1:], -1) == of_a, 0, 1)
        coded[place_b] = self.b + n * np.where(np.append(of_b[1:], -1) == of_b, 0, 2)
        return list(map(words.__getitem__, coded.tolist())), np.append(place_a, m)


#: Ids are below this.
_IDS = 1 << 17


@lru_cache(maxsize=1)
def _decimals() -> list[str]:
    """Every id in decimal with a comma behind it, then with a bar, then with a semicolon."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(_IDS)]


def frequent_fragments(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """Up to ``most`` keys that are most frequent in a fixed quarter of the texts, with their order from 0."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch["text"]:
                counts.update(fragment_keys(text))
            kept = [(k, n) for k, n in counts.items() if len(k) <= _LONGEST]
            yield pd.DataFrame(kept, columns=["fragment", "n"])

    sample = docs.select(text_of(text_col).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    counts = sample.mapInPandas(work, "fragment string, n long").groupBy("fragment").agg(F.sum("n").alias("n"))
    return counts.filter("n > 1").orderBy(F.desc("n"), "fragment").limit(most).select("fragment")


_TOKENS = "a_ids array<int>, a_len array<smallint>, b_ids array<int>, b_len array<smallint>"
_TYPES = {"a_ids": pa.int32(), "a_len": pa.int16(), "b_ids": pa.int32(), "b_len": pa.int16()}


def _listed(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of ``sizes`` of consecutive values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some thousand fragments and tokens, as links of many at once fill the memory."""
    for batch in batches:
        sizes = sum(np.diff(batch.column(name).offsets.to_numpy()) for name in ("codes", "a_ids", "b_ids"))
        for first, last in chunks_of(sizes.tolist(), _LINKED):
            yield batch.slice(first, last - first)


class Known:
    """The known fragments: their code by key and, by code, sizes, links and written groups.

    It stays on the driver; each step is sent only what it uses, as a worker holds that until its next task.
    """

    def __init__(self, rows: pa.Table) -> None:
        found = rows.combine_chunks().to_batches()
        batch = found[0] if found else pa.RecordBatch.from_pylist([], schema=rows.schema)
        groups, n = Groups(batch), batch.num_rows
        self.code = {key: i for i, key in enumerate(batch.column("fragment").to_pylist())}
        tokens, place = groups.written()
        at = place[groups.a_begin].tolist()
        self.written = ["".join(tokens[x:y]) for x, y in zip(at, at[1:], strict=False)]
        row, self.pair = groups.links()
        self.begin = np.searchsorted(row, np.arange(n + 1))
        self.sizes = np.stack([np.diff(groups.a_begin), np.diff(groups.b_begin), np.bincount(groups.row, minlength=n), np.diff(self.begin)]) if n else np.zeros((4, 0), dtype=np.int64)


def encoded(docs: DataFrame, paths: tuple[str, str], codes_of, *, id_col: str, text_col: str) -> DataFrame:
    """By the known fragments' codes that were sent: doc_id, whole (whether both sides' bytes are the text's), codes (-1 for a fragment of the rest), rest (A tokens of each such), and the rest's tokens."""
    schema = f"doc_id long, whole boolean, codes array<int>, rest array<int>, {_TOKENS}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, code = _tokenizers(*paths), codes_of.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in chunks_of([len(t) for t in texts], _TEXTS):
                names = [fragment_keys(t) if t else [] for t in texts[first:last]]
                sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
                keys = list(chain.from_iterable(names))
                codes = np.fromiter(map(code.get, keys, repeat(-1)), dtype=np.int32, count=len(keys))
                row = np.repeat(np.arange(len(names)), sizes)
                at = np.flatnonzero(codes < 0)
                number: dict[str, int] = {}
                which = np.array([number.setdefault(keys[i], len(number)) for i in at.tolist()], dtype=np.int64)
                ids, begins, good = tokenizers.of(list(number))
                whole = sizes > 0
                whole[row[at[~good[which]]]] = False
                which, rest_row, inside = which[whole[row[at]]], row[at][whole[row[at]]], whole[row]
                columns = []
                for i, begin, length in zip(ids, begins, tokenizers.lengths, strict=True):
                    many = np.diff(begin)[which]
                    flat = i[np.arange(many.sum()) + np.repeat(begin[which] - (np.cumsum(many) - many), many)]
                    per_row = np.bincount(rest_row, weights=many, minlength=len(names))
                    columns += [_listed(flat, per_row, pa.int32()), _listed(length[flat], per_row, pa.int16())]
                rest = _listed(np.diff(begins[0])[which], np.bincount(rest_row, minlength=len(names)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(whole), _listed(codes[inside], np.where(whole, sizes, 0), pa.int32()), rest, *columns], names=["doc_id", "whole", "codes", "rest", *_TYPES])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(work, schema)


def _arrow_frame(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A frame of long columns, made without rows of Python objects and without Python workers."""
    return spark.createDataFrame(pa.table({name: pa.array(x.astype(np.int64)) for name, x in columns.items()}))


def _known_fragments(docs: DataFrame, paths: tuple[str, str], most: int, text_col: str):
    """:class:`Known` of the frequent fragments, which are aligned like the rests of documents."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = _tokenizers(*paths)
        for batch in batches:
            if not len(keys := batch["fragment"].tolist()):
                continue
            ids, begins, whole = tokenizers.of(keys)
            out = {"fragment": keys}
            for side, i, begin, length in zip("ab", ids, begins, tokenizers.lengths, strict=True):
                out[f"{side}_ids"], out[f"{side}_len"] = (np.split(x, begin[1:-1]) for x in (i, length[i]))
            yield pd.DataFrame(out).loc[whole]

    found = frequent_fragments(docs, text_col, most).mapInPandas(work, f"fragment string, {_TOKENS}")
    keyed = cut(found.withColumn("key", F.monotonically_increasing_id())).repartition(wide(docs.sparkSession, 1), "key")
    return Known(keyed.join(common_cuts(keyed.select("key", "a_len", "b_len")), "key").drop("key").toArrow())


_CUTS = "array<struct<group:int,a:int,b:int>>"


def align(docs: DataFrame, bytes_path: str, piece_path: str, *, known: int = KNOWN, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and (``groups``) the groups.

    Groups are written `a1,a2|b1;a3|b2,b3` in order.  A link's count is the number of rows whose groups
    link its two ids; it is a best one if no other link of its A id has a higher count.  Null and empty texts, and
    those whose tokens' bytes are not a space and the text (A's or B's), have no tokens: zeros, empty
    strings.  Repeated rows count each; an empty table gives an empty result; further columns are not
    read; texts of any length are taken whole.  Both files must be readable on every executor.  Up to
    ``known`` fragments and as many links are sent to every task; others are joined.
    """
    spark, paths = docs.sparkSession, (bytes_path, piece_path)
    parts = wide(spark, 1)
    memo = _known_fragments(docs, paths, known, text_col)
    send = spark.sparkContext.broadcast
    codes_of = send(memo.code)
    coded = Written(encoded(docs, paths, codes_of, id_col=id_col, text_col=text_col).withColumn("key", F.monotonically_increasing_id()))
    lengths = coded.rows.filter(F.size("rest") > 0).select("key", "a_len", "b_len").repartition(parts, "key")
    rows = coded.rows.drop("a_len", "b_len").repartition(parts, "key")
    rows = Written(rows.join(common_cuts(lengths), "key", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast(_CUTS))))
    coded.drop()
    codes_of.destroy()
    links_of = send((memo.begin, memo.pair))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizers.cache_clear()  # the worker made them for an earlier step
        (known_begin, known_pair), held_by = links_of.value, Tally()
        for batch in _parts(batches):
            codes = Lists(batch.column("codes"))
            both = (codes.owner() << 32) + codes.numbers()
            row, code = np.divmod(np.unique(both[codes.numbers() >= 0]), 1 << 32)
            many = known_begin[code + 1] - known_begin[code]
            at = np.arange(many.sum()) + np.repeat(known_begin[code] - (np.cumsum(many) - many), many)
            rest_row, rest = Groups(batch).links()
            row, pair = np.concatenate([np.repeat(row, many), rest_row]), np.concatenate([known_pair[at], rest])
            names, place = np.unique(pair, return_inverse=True)
            held = np.unique(row * max(1, len(names)) + place) % max(1, len(names))
            yield from held_by.add(names, np.bincount(held, minlength=len(names)))
        yield from held_by.rest()

    counts = cut(rows.rows.select("codes", "a_ids", "b_ids", "cuts").mapInArrow(pairs, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    links_of.destroy()
    first = F.shiftright("pair", 32).alias("a")
    best = {r.a: r.best for r in counts.groupBy(first).agg(F.max("docs").alias("best")).collect()}  # at most one row for each A id
    table = counts.orderBy(F.desc("docs"), "pair").limit(known).toPandas().sort_values("pair").to_numpy(dtype=np.int64)
    # Sums by known fragment: its links that are known here, the others by a join.
    names = send((table[:, 0].copy(), table[:, 1].copy(), np.array([best.get(i, 0) for i in range(max(best, default=0) + 1)])))
    least = _arrow_frame(spark, pair=np.unique(memo.pair))
    mine = counts.join(least, "pair").toPandas().sort_values("pair").to_numpy(dtype=np.int64)
    own = mine[np.searchsorted(mine[:, 0], memo.pair), 1] if len(mine) else mine[:, 1]
    top = own == names.value[2][memo.pair >> 32] if len(own) else np.zeros(0, dtype=bool)
    sums = np.concatenate([memo.sizes, [np.diff(np.concatenate(([0], np.cumsum(x)))[memo.begin]) for x in (top, own)]]) if len(own) else np.zeros((6, 0), dtype=np.int64)
    by_code, written_of = send(sums.astype(np.int64)), send(memo.written)
    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizers.cache_clear()
        written, (pair, docs_of, best_of), by = written_of.value, names.value, by_code.value
        for batch in _parts(batches):
            n = batch.num_rows
            codes, found = Lists(batch.column("codes")), Groups(batch)
            code, row = codes.numbers(), codes.owner()
            inside = code >= 0
            begin = np.concatenate(([0], np.cumsum(inside)))[codes.begin]
            total = [np.diff(np.concatenate(([0], np.cumsum(x[code[inside]])))[begin]) if x.size else np.zeros(n, dtype=np.int64) for x in by]
            link_row, link = found.links()
            at = np.minimum(np.searchsorted(pair, link), max(0, len(pair) - 1))
            hit = pair[at] == link if len(pair) else np.zeros(len(link), dtype=bool)
            count = np.where(hit, docs_of[at], 0) if len(pair) else np.zeros(len(link), dtype=np.int64)
            edges = np.searchsorted(link_row, np.arange(n + 1))
            total[0] += np.diff(found.a_begin)
            total[1] += np.diff(found.b_begin)
            total[2] += np.bincount(found.row, minlength=n)
            total[3] += np.diff(edges)
            for i, x in ((4, hit & (count == best_of[link >> 32])), (5, count)):
                total[i] += np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
            missing = ~hit
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(missing)))[edges].astype(np.int32)), pa.array(link[missing]))
            # The text: known fragments as they are written, others by their tokens.
            tokens, place = found.written()
            rest = Lists(batch.column("rest"))
            ends = place[np.concatenate(([0], np.cumsum(rest.numbers())))].tolist()
            others = iter(["".join(tokens[x:y]) for x, y in zip(ends, ends[1:], strict=False)])
            parts = [written[c] if c >= 0 else next(others) for c in code.tolist()]
            texts = ["".join(parts[x:y])[:-1] for x, y in zip(codes.begin.tolist(), codes.begin[1:].tolist(), strict=False)]
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            columns = [batch.column("key"), batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in total), pa.array(digests, pa.string()), *([pa.array(texts, pa.string())] if groups else []), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", *out, "groups_sha256", *(["groups"] if groups else []), "other"])

    schema = "key long, doc_id long, " + ", ".join(f"{c} long" for c in out) + ", groups_sha256 string" + ", groups string" * groups + ", other array<long>"
    done = rows.rows.mapInArrow(finish, schema)
    kept = ["doc_id", *out, "groups_sha256", *(["groups"] if groups else [])]
    if len(table) < known:  # every link was known
        return done.select(*kept)
    done = Written(done).rows
    other = done.select("key", F.explode("other").alias("pair")).groupBy("key", "pair").agg(F.count(F.lit(1)).alias("times"))
    tops = _arrow_frame(spark, a=np.array(list(best)), best=np.array(list(best.values())))
    priced = counts.join(F.broadcast(tops), first == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("best")).cast("long").alias("top"))
    more = other.join(priced, "pair").groupBy("key").agg(F.sum(F.col("times") * F.col("top")).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    full = done.join(more, "key", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return full.select(*kept)
