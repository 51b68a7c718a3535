"""Operator 10: near-duplicates by weighted Jaccard similarity of word shingles, with BagMinHash.

A text is the multiset of its five-word shingles.  Its signature holds, for each component, the
earliest point of the Poisson processes that belong to the shingles' weights: the weight axis is
divided at 1, 2, 4, 8, ..., each part of each shingle has a process whose rate is the part's length,
and a point of a part beyond 1 falls to one of its unit steps by fair coins, as going down a binary
tree would do; it counts if the weight reaches that step.  Components of two signatures agree with a
probability equal to the weighted Jaccard similarity.  Bands of signatures give candidates, which are
verified on the multisets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, chunks_of, cut, id_back, id_text, join_by_parts, mix64, pick_rows, text_of, window_hashes
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text tokenised at a time; strays and texts of a bucket that meet in one group.
_CHUNK = 1 << 18
_STRAYS, _MEMBERS = 256, 1024
#: Texts of fewer shingles are signed together.
_TINY = 32


def shingles(hasher: WordHasher, texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of the distinct shingles of each text, sorted by text and hash.

    Words are lower-cased (A-Z) runs of other than white space; a text of fewer than ``size`` words is
    one shingle, one without words none.
    """
    words, owner, *_ = hasher.words([t.lower() for t in texts])
    count = np.bincount(owner, minlength=len(texts))
    windows = window_hashes(words, size)
    whole = owner[: len(windows)] == owner[size - 1 :] if len(windows) else np.zeros(0, dtype=bool)
    of, value = owner[: len(windows)][whole], windows[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))[short]
        with np.errstate(over="ignore"):
            total = np.zeros(len(short), dtype=np.uint64)
            for j in range(size - 1):
                has = count[short] > j
                total[has] = total[has] * np.uint64(0xC2B2AE3D27D4EB4F) + words[first[has] + j]
            of, value = np.concatenate((of, short)), np.concatenate((value, mix64(total + count[short].astype(np.uint64))))
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return of[at], value[at], np.diff(np.concatenate((at, [len(of)])))


def bag_minhash(of: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts x size) of weighted elements, 0 where a text has none."""
    result = np.zeros((texts, size), dtype=np.uint64)
    if not len(of):
        return result
    total = np.bincount(of, weights=weight, minlength=texts)
    # The parts of the weight axis below each element's weight: (0, 1], (1, 2], (2, 4], ...
    parts = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    pick = np.repeat(np.arange(len(of)), parts)
    level = np.arange(len(pick)) - np.repeat(np.cumsum(parts) - parts, parts)
    rate = np.where(level > 0, np.exp2(level - 1.0), 1.0)
    with np.errstate(over="ignore"):
        seed = mix64(value[pick] + _GOLDEN * (level + 1).astype(np.uint64))
    horizon = size * (np.log(size) + 5.0) / np.maximum(total, 1e-9)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        active = np.zeros(texts, dtype=bool)
        active[todo] = True
        mine = np.flatnonzero(active[of[pick]])
        time = np.zeros(len(mine))
        best = np.full(texts * size, np.inf)
        name = np.zeros(texts * size, dtype=np.uint64)
        step = 0
        while len(mine):
            step += 1
            with np.errstate(over="ignore"):
                h = mix64(seed[mine] + np.uint64(step) * np.uint64(0xD1342543DE82EF95))
                g = mix64(h + _GOLDEN)
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[mine]
            soon = time <= horizon[of[pick[mine]]]
            mine, time, h, g = mine[soon], time[soon], h[soon], g[soon]
            lev = level[mine]
            # The unit step of a point is given by fair coins, one for each level of the tree.
            inside = np.ones(len(mine), dtype=bool)
            high = np.flatnonzero(lev > 1)
            if len(high):
                span = np.exp2(lev[high] - 1).astype(np.uint64)
                unit = (g[high] >> np.uint64(32)) % span + span
                inside[high] = unit < weight[pick[mine[high]]].astype(np.uint64)
            key = of[pick[mine]] * size + ((g & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            key, t, h = key[inside], time[inside], h[inside]
            np.minimum.at(best, key, t)
            first = best[key] == t
            name[key[first]] = h[first]
        full = np.isfinite(best.reshape(texts, size)).all(axis=1)
        done = todo[full[todo]]
        result[done] = name.reshape(texts, size)[done]
        todo = todo[~full[todo]]
        horizon[todo] *= 2
    return result


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted (hash, weight) multisets; 1 for two empty ones."""
    both = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][both[1]], b[1][both[2]]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - common
    return common / total if total else 1.0


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(signature), bands), dtype=np.uint64)
        for r in range(rows):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + signature[:, r::rows] + np.arange(bands, dtype=np.uint64)[None, :])
    return out.view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """seq, doc_id, digest (of the text) and bands (none for a text without words) of every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch["text"].tolist()
            found: list = [None] * len(texts)
            tiny: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in chunks_of([len(t) for t in texts], _CHUNK):
                of, value, weight = shingles(hasher, [t.encode() for t in texts[a:b]])
                total = np.bincount(of, weights=weight, minlength=b - a)
                # Short texts take many steps, so those of the whole batch are signed together.
                short = total[of] < _TINY
                tiny.append((of[short] + a, value[short], weight[short]))
                signature = bag_minhash(of[~short], value[~short], weight[~short], b - a, bands * rows)
                for i, x in zip(np.flatnonzero(total >= _TINY), _bands(signature[total >= _TINY], bands, rows), strict=True):
                    found[a + i] = x
            if tiny:
                of, value, weight = (np.concatenate(x) for x in zip(*tiny, strict=True))
                which, of = np.unique(of, return_inverse=True)
                for i, x in zip(which, _bands(bag_minhash(of, value, weight, len(which), bands * rows), bands, rows), strict=True):
                    found[i] = x
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "bands": found})

    slim = docs.select(id_text(id_col), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), text_of(text_col).alias("text"))
    made = id_back(slim.mapInPandas(work, "doc_id string, digest binary, bands array<long>"))
    return cut(made.withColumn("seq", F.monotonically_increasing_id()))


def _texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and text of ``nodes`` (node, doc_id, digest), the text being found by id and digest."""
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("_digest"), text_of(text_col).alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return slim.join(nodes.select("node", "doc_id", "digest").distinct(), on).select("node", "text").dropDuplicates(["node"])


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            keep = []
            left, right = [t.encode() for t in batch["text_a"]], [t.encode() for t in batch["text_b"]]
            for a, b in chunks_of([len(x) + len(y) for x, y in zip(left, right, strict=True)], _CHUNK):
                one, two = _bags(hasher, left[a:b]), _bags(hasher, right[a:b])
                keep += [similarity(x, y) >= threshold for x, y in zip(one, two, strict=True)]
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInPandas(work, "a long, b long")


def _bags(hasher: WordHasher, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    of, value, weight = shingles(hasher, texts)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(value[a:b], weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _block_links(threshold: float):
    """Links between strays (side 0) and texts (side 1) of a bucket that are in other components.

    A stray's weights fill a table over the shingles of the group, so one pass over those of all the
    texts gives its overlap with each.  Links that join nothing new are left out.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        hasher = WordHasher()
        raw = [t.encode() for t in frame["text"]]
        bags: list = []
        for a, b in chunks_of([len(t) for t in raw], _CHUNK):
            bags += _bags(hasher, raw[a:b])
        node, label, side = frame["node"].tolist(), frame["label"].tolist(), frame["side"].to_numpy()
        strays, texts = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(strays) or not len(texts):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sizes = np.array([int(w.sum()) for _, w in bags], dtype=np.int64)
        lengths = np.array([len(bags[i][0]) for i in texts])
        known, code = np.unique(np.concatenate([bags[i][0] for i in texts]), return_inverse=True)
        weight = np.concatenate([bags[i][1] for i in texts])
        row = np.repeat(np.arange(len(texts)), lengths)
        group = {x: x for x in label}

        def root(x):
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        out = []
        for i in strays:
            value, own = bags[i]
            at = np.searchsorted(known, value)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == value[hit]
            table = np.zeros(len(known), dtype=np.int64)
            table[at[hit]] = own[hit]
            common = np.bincount(row, weights=np.minimum(table[code], weight), minlength=len(texts))
            for j in texts[common >= threshold * (sizes[i] + sizes[texts] - common)]:
                if (p := root(label[i])) != (q := root(label[j])):
                    group[p] = q
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return work


def _open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """band, bucket, node, label, stray, members, strays of the buckets whose texts are not all in one component.

    Strays are the texts outside the component of the bucket's first one, which itself is left out.  Of
    buckets with the same texts and strays one stands for all.
    """
    of_head = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
    placed = shared.filter("node <> head and n > 2").join(labels, "node", "left").join(of_head, "head", "left")
    placed = placed.select("band", "bucket", "node", F.coalesce("label", "node").alias("label"), F.coalesce("head_label", "head").alias("head_label"))
    placed = placed.withColumn("stray", F.col("label") != F.col("head_label"))
    mixed = placed.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.count_if("stray").alias("strays"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"))
    once = mixed.filter("low < high and strays > 0").groupBy("members", "strays", "content").agg(F.min(F.struct("band", "bucket")).alias("at")).select("at.*", "members", "strays")
    return placed.join(once, ["band", "bucket"]).select("band", "bucket", "node", "label", "stray", "members", "strays")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the components joined that ``links`` (a, b) connect."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    up = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    above = up.select(F.col("node").alias("label"), F.col("label").alias("above"))
    known = labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return cut(known.unionByName(up.join(labels, "node", "left_anti")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, text_sha256.

    Classes are the connected components of the links between texts with a weighted Jaccard similarity
    of ``threshold`` or more; class_id is their smallest doc_id (null if all are null), whose row is
    kept, exactly one.  Equal texts are one node, so copies cost a row each and no pairs.  A bucket's
    texts are compared with its first one; those that this leaves in other components are compared with
    all the bucket's texts, block by block, so that a bucket loses no link.  A pair at 0.8
    shares one of 24 bands of 4 with probability 1 - 3e-6.  Null texts count as empty; texts without
    words only equal the same text.  Rows with equal id and text are equal texts; empty tables give
    empty results; further columns are not read.
    """
    all_rows = signed(docs, bands, rows, id_col=id_col, text_col=text_col)
    nodes = cut(all_rows.groupBy("digest").agg(F.min("seq").alias("node"), F.count(F.lit(1)).alias("copies")))
    firsts = all_rows.select("seq", "bands").join(nodes.select("node"), F.col("seq") == F.col("node"))
    members = firsts.select("node", F.posexplode("bands").alias("band", "bucket"))
    heads = members.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(members.join(heads, ["band", "bucket"]).select("band", "bucket", "node", "head", "n"))
    pairs = shared.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = all_rows.select(F.col("seq").alias("node"), "doc_id", "digest").join(needed, "node")
    texts = cut(_texts(docs, named, id_col, text_col))
    links = cut(_verify(pairs, texts, threshold))
    labels = components(links)

    # A bucket's strays meet all its texts but the first, in blocks.
    parts = [F.ceil(F.col(c) / size).cast("int") for c, size in (("strays", _STRAYS), ("members", _MEMBERS))]
    blocked = cut(_open_buckets(shared, labels).select("band", "bucket", "node", "label", "stray", parts[0].alias("blocks"), parts[1].alias("chunks")))
    if not blocked.isEmpty():
        every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name) for c, name in (("chunks", "chunk"), ("blocks", "block"))]
        one = blocked.filter("stray").select("band", "bucket", "node", "label", F.lit(0).alias("side"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), every[0])
        two = blocked.select("band", "bucket", "node", "label", F.lit(1).alias("side"), every[1], F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int").alias("chunk"))
        more = one.unionByName(two).join(texts, "node").groupBy("band", "bucket", "block", "chunk").applyInPandas(_block_links(threshold), "a long, b long")
        labels = _merged(labels, cut(more))

    full = nodes.join(labels, "node", "left").select("digest", "copies", F.coalesce("label", "node").alias("label"))
    tagged = cut(join_by_parts(all_rows.select("seq", "doc_id", "digest"), full, ("digest",), "copies").select("seq", "doc_id", "digest", "label"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "seq")).alias("best")
    summary = cut(tagged.groupBy("label").agg(best, F.count(F.lit(1)).alias("class_size")))
    done = join_by_parts(tagged, summary, ("label",), "class_size")
    return done.select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("seq") == F.col("best.seq")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`classes` keeps; of rows equal in id and text one.

    Null ids are a value, null texts count as empty; empty tables give empty ones.  Needs columns doc_id and
    text; columns of any other names pass through.
    """
    return pick_rows(docs, classes(docs, **options))
