"""Nearest vectors by blocks of matrices, an inverted-file index, and joins of vectors at small angles.

Blocks bound what a task holds: rows and questions of a list are dealt over parts of some thousand, and
every part of one meets every part of the other as matrices, of which only the best leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..lineage import cut
from .graph import greedy_clusters
from .search import similar_within

ROWS, QUESTIONS = 8192, 1024
#: Blocks of :func:`alike_counts`: so many at least, and about so many rows in one at most; rows that lay them out, and first rows that meet all others.
BLOCKS, BLOCK_ROWS, LAID, FIRST = 8, 131_072, 16_384, 4096


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.stack(vectors) if len(vectors) else np.zeros((0, 1))
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size == 0, 1, size)[:, None]


def _best(ids: np.ndarray, asked: np.ndarray, own: np.ndarray, rows: np.ndarray, limit: int) -> pd.DataFrame:
    """The ``limit`` rows of the highest cosine to each question, itself left out, of ties those of smaller id."""
    score = np.round(asked @ rows.T, 6)
    score[ids[:, None] == own[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :limit]
    at = np.repeat(np.arange(len(ids)), order.shape[1])
    best = score[at, order.ravel()]
    return pd.DataFrame({"id": ids[at], "chunk_id": own[order.ravel()], "score": best})[np.isfinite(best)]


def _merged(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_id")
    return found.distinct().withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")


def best_in_lists(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """id, chunk_id, score of the ``limit`` nearest ``rows`` (list, chunk_id, embedding) to each of ``asked`` (list, id, embedding) in its lists."""
    sizes = None
    for frame, name, most in ((rows, "rows", ROWS), (asked, "asked", QUESTIONS)):
        part = frame.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
        sizes = part if sizes is None else sizes.join(part, "list")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.join(sizes, "list").select("list", "id", "embedding", F.lit(0).alias("side"), own("id", "asked").alias("i"), every("rows").alias("j"))
    right = rows.join(sizes, "list").select("list", F.col("chunk_id").alias("id"), "embedding", F.lit(1).alias("side"), every("asked").alias("i"), own("chunk_id", "rows").alias("j"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        questions, mine = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(questions) or not len(mine):
            return pd.DataFrame({"id": [], "chunk_id": [], "score": []})
        return _best(questions["id"].to_numpy(), _unit(questions["embedding"].tolist()), mine["id"].to_numpy(), _unit(mine["embedding"].tolist()), limit)

    found = left.unionByName(right).groupBy("list", "i", "j").applyInPandas(work, "id long, chunk_id long, score double")
    return _merged(found, limit)


def nearest(vectors: DataFrame, asked: DataFrame, limit: int, block: int = 4096) -> DataFrame:
    """id, chunk_id and cosine of the ``limit`` nearest vectors to each row of ``asked`` (id, embedding), itself left out.

    Exact: every question meets every vector.  Up to ``block`` questions are sent to the tasks, so that the
    vectors are read once and not moved; more meet them in blocks.
    """
    count = asked.limit(block + 1).count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "id long, chunk_id long, score double")
    if count > block:
        return best_in_lists(vectors.select(F.lit(0).alias("list"), "chunk_id", "embedding"), asked.select(F.lit(0).alias("list"), "id", "embedding"), limit)
    questions = asked.select("id", "embedding").toPandas()
    sent = vectors.sparkSession.sparkContext.broadcast((questions["id"].to_numpy(), _unit(questions["embedding"].tolist())))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _best(*sent.value, batch["chunk_id"].to_numpy(), _unit(batch["embedding"].tolist()), limit)

    return _merged(vectors.select("chunk_id", "embedding").mapInPandas(work, "id long, chunk_id long, score double"), limit)


class VectorIndex:
    """An inverted file: vectors in lists by the nearest of some centres, and questions answered from a few lists.

    The centres are fitted on at most ``sample`` vectors, those of least hash of their id; every vector is
    in the lists of its ``copies`` nearest centres, which finds more where vectors form no clusters.  A folder by lists lets a question read only the lists it probes.
    """

    def __init__(self, rows: DataFrame, centres: np.ndarray) -> None:
        self.rows, self.centres = rows, centres

    @staticmethod
    def fit(vectors: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
        """Centres of unit length: the sample's first vectors, moved ``rounds`` times to the mean of what is nearest to them."""
        taken = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toPandas()["embedding"].tolist()
        x = _unit(taken)
        centres = x[:lists].copy()
        for _ in range(rounds):
            near = (x @ centres.T).argmax(axis=1)
            for i in range(len(centres)):
                if (near == i).any():
                    centres[i] = _unit([x[near == i].mean(axis=0)])[0]
        return centres

    @staticmethod
    def placed(frame: DataFrame, centres: np.ndarray, probes: int, key: str) -> DataFrame:
        """list, ``key``, embedding: each row in the ``probes`` lists of the nearest centres."""
        sent = frame.sparkSession.sparkContext.broadcast(centres)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    order = np.argsort(-(_unit(batch["embedding"].tolist()) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(len(batch)), order.shape[1])
                    yield pd.DataFrame({"list": order.ravel(), key: batch[key].to_numpy()[at], "embedding": batch["embedding"].to_numpy()[at]})

        return frame.select(key, "embedding").mapInPandas(work, f"list int, {key} long, embedding array<double>")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str | None = None, copies: int = 1, **options: int) -> VectorIndex:
        """The index of ``vectors`` (chunk_id, embedding); written to ``folder`` by list where one is given."""
        centres = cls.fit(vectors, **options)
        rows = cls.placed(vectors, centres, copies, "chunk_id")
        if folder is None:
            return cls(rows, centres)
        spark = vectors.sparkSession
        rows.write.partitionBy("list").parquet(f"{folder}/rows")
        spark.createDataFrame(pd.DataFrame({"centre": range(len(centres)), "embedding": centres.tolist()}), "centre int, embedding array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        return cls.read(spark, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> VectorIndex:
        centres = spark.read.parquet(f"{folder}/centres").orderBy("centre").toPandas()["embedding"].tolist()
        return cls(spark.read.parquet(f"{folder}/rows"), np.stack(centres))

    def search(self, asked: DataFrame, limit: int = 10, probes: int = 8) -> DataFrame:
        """id, chunk_id, score of the ``limit`` nearest to each of ``asked`` (id, embedding) in ``probes`` lists, with exact cosines; all lists give the exact answer."""
        questions = self.placed(asked, self.centres, probes, "id")
        wanted = [r.list for r in questions.select("list").distinct().collect()]  # no more than there are centres
        return best_in_lists(self.rows.filter(F.col("list").isin(wanted)), questions, limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: wanted, hit and recall of ``found`` against ``exact`` (both id, chunk_id)."""
    hits = exact.join(found.select("id", "chunk_id", F.lit(1).alias("hit")), ["id", "chunk_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit")).withColumn("recall", F.col("hit") / F.col("wanted"))


def miss_chance(cosine: float, bits: int, bands: int) -> float:
    """Chance that two vectors of this cosine agree on no band of hyperplanes."""
    return (1 - (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits) ** bands


def angular_pairs(items: DataFrame, threshold: float, bits: int = 12, bands: int = 48, seed: int = 7) -> DataFrame:
    """a, b, group, score: pairs a < b of ``items`` (id, embedding, group) of a group with a cosine of ``threshold`` or more.

    On which sides of ``bits`` random hyperplanes a vector lies is a band; vectors that agree on one of
    ``bands`` are compared, in blocks of matrices so that a bucket of many fills no task, and pairs that
    meet more than once are given once.  A pair is missed with the chance :func:`miss_chance` at most.
    """
    kind, of = dict(items.dtypes)["id"], dict(items.dtypes)["group"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"].tolist())
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits * bands)) if planes is None else planes
                sides = (x @ planes > 0).reshape(len(x), bands, bits)
                code = (sides * (1 << np.arange(bits))).sum(axis=2) + (np.arange(bands) << bits)
                yield pd.DataFrame({"id": batch["id"], "embedding": batch["embedding"], "group": batch["group"], "codes": list(code)})

    coded = items.select("id", "embedding", "group").mapInPandas(work, f"id {kind}, embedding array<double>, group {of}, codes array<long>")
    each = coded.select("id", "embedding", "group", F.explode("codes").alias("code")).withColumn("bucket", F.to_json(F.struct("group", "code"))).select("id", "embedding", "bucket")
    each = each.join(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "bucket")
    met = similar_within(each, each, threshold, "bucket").filter("a < b")
    return met.groupBy("a", "b").agg(F.max("score").alias("score")).join(items.select(F.col("id").alias("a"), "group"), "a").select("a", "b", "group", "score")


def _bounds(threshold: float, size: int) -> tuple[np.float32, np.float32]:
    """Where products of unit vectors of ``size`` numbers in single precision leave open on which side of ``threshold`` they are."""
    least, margin = np.float32(threshold - 5e-7), np.float32(6e-8 * (size + 4))
    return least - margin, least + margin


def _hits(left: np.ndarray, right: np.ndarray, own: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors of two sets (in single precision, and in double) are at ``threshold`` or more.

    Products in single precision decide but for those within a margin beyond their error, which are made again in double.
    """
    low, high = _bounds(threshold, left.shape[1])
    score = left @ right.T
    hit, near = score >= high, score >= low
    if (at := np.flatnonzero(hit.ravel() != near.ravel())).size:
        a, b = np.divmod(at, hit.shape[1])
        hit[a, b] = np.round((own[a] * others[b]).sum(axis=1), 6) >= threshold
    return hit


def _alike(own: np.ndarray, others: np.ndarray, ids: np.ndarray, weights: np.ndarray, threshold: float, same: bool, tile: int = 512, width: int = 1024, own_ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector of ``own`` the weight of the ``others`` (of rising ``ids``) at ``threshold`` or more, and the first of their ids (-1: none); ``same`` or by ``own_ids``: itself left out."""
    total, first = np.zeros(len(own), np.int64), np.full(len(own), -1, np.int64)
    left, right = own.astype(np.float32), others.astype(np.float32)
    for y in range(0, len(others), width):
        heavy = np.flatnonzero(weights[y : y + width] > 1)
        more = (weights[y : y + width][heavy] - 1).astype(float)
        for x in range(0, len(own), tile):
            hit = _hits(left[x : x + tile], right[y : y + width], own[x : x + tile], others[y : y + width], threshold)
            if same and (both := np.arange(max(x, y), min(x + hit.shape[0], y + hit.shape[1]))).size:
                hit[both - x, both - y] = False
            if own_ids is not None and own_ids[x : x + tile].min() <= ids[-1]:
                hit &= own_ids[x : x + tile, None] != ids[y : y + width]
            n = np.count_nonzero(hit, axis=1)
            total[x : x + tile] += n + (hit[:, heavy] @ more).astype(np.int64)
            new = np.flatnonzero((n > 0) & (first[x : x + tile] < 0))
            first[x + new] = ids[y + hit[new].argmax(axis=1)]
    return total, first


def _reach(threshold: float) -> float:
    """No two unit vectors at ``threshold`` or more, rounded to six digits, are farther from each other."""
    return math.sqrt(max(0.0, 2 - 2 * (threshold - 1e-6))) + 1e-6


def _reached(x: np.ndarray, centres: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Of each centre and vector of ``x`` (of length 1 at most) whether a vector within ``radius`` of the centre can be within ``reach`` of it; in single precision, its error allowed for."""
    centres, x = centres.astype(np.float32), x.astype(np.float32, copy=False)
    far = centres @ x.T
    far *= -2
    far += (x**2).sum(axis=1)
    return far <= ((radius + reach) ** 2 + 1e-6 * (x.shape[1] + 4) - (centres.astype(float) ** 2).sum(axis=1)).astype(np.float32)[:, None]


def _axis(x: np.ndarray) -> np.ndarray:
    """The direction in which vectors differ most."""
    own = x - x.mean(axis=0)
    return np.linalg.eigh(own.T @ own)[1][:, -1]


def _planes(x: np.ndarray, parts: int, centres: list) -> tuple | int:
    """A tree of planes that deals vectors like ``x`` over at most ``parts`` parts about evenly; the means of ``x`` in them are put into ``centres``."""
    if parts == 1 or len(x) < 2:
        centres.append(x.mean(axis=0))
        return len(centres) - 1
    axis = _axis(x)
    at = x @ axis
    order, k = np.argsort(at, kind="stable"), max(1, len(x) * (parts // 2) // parts)
    bound = at[order[k]]
    return axis, bound, _planes(x[order[:k]], parts // 2, centres), _planes(x[order[k:]], parts - parts // 2, centres)


def _part(x: np.ndarray, planes: tuple | int) -> np.ndarray:
    """The part of each vector."""
    if isinstance(planes, int):
        return np.full(len(x), planes, np.int32)
    axis, bound, low, high = planes
    over = x @ axis >= bound
    out = np.empty(len(x), np.int32)
    out[~over], out[over] = _part(x[~over], low), _part(x[over], high)
    return out


def _order(x: np.ndarray, at: np.ndarray, out: list, most: int) -> None:
    """Puts ``at``, halved where its vectors differ most until halves have at most ``most``, into ``out``: close ones are side by side."""
    if len(at) <= most:
        out.append(at)
        return
    own = x[at]
    k = len(at) // 2
    order = np.argpartition(own @ _axis(own), k)
    _order(x, at[order[:k]], out, most)
    _order(x, at[order[k:]], out, most)


def _met(x: dict[str, np.ndarray], y: dict[str, np.ndarray], threshold: float, same: bool, rows: int = 8192, tile: int = 1024, width: int = 256) -> list[dict[str, np.ndarray]]:
    """id, others, least of two blocks (x, id, n, place, least; least -1: not known yet) or, ``same``, of one block given twice: each pair is compared once, and counts for both.

    Runs of ``width`` close vectors of ``y`` meet the vectors of ``x`` that a ball around the run doesn't rule out.
    Counts of a product are sums of eight bytes at once; what single precision leaves open is decided in the end.
    """
    x = {k: v[np.argsort(x["id"])] for k, v in x.items()}
    run = np.empty(len(y["id"]), np.int64)
    run[np.argsort(y["place"])] = np.arange(len(run)) // width
    y = {k: v[np.lexsort((y["id"], run))] for k, v in y.items()}
    starts = np.arange(0, len(run), width)
    sizes = np.diff(np.append(starts, len(run)))
    centres = np.add.reduceat(y["x"], starts) / sizes[:, None]
    radius = np.sqrt([((y["x"][s : s + width] - c) ** 2).sum(axis=1).max() for s, c in zip(starts, centres, strict=True)])
    left, right = x["x"].astype(np.float32), np.zeros((len(starts), width, y["x"].shape[1]), np.float32)
    right.reshape(-1, right.shape[2])[: len(run)] = y["x"]  # rows of zeros at the end are like none
    ids = np.full(right.shape[:2], np.iinfo(np.int64).max)
    ids.ravel()[: len(run)] = y["id"]
    own_run = (np.argsort(np.argsort(x["place"])) // width) if same else None
    least = [int(side["n"].min()) for side in (x, y)]
    more = [(side["n"] - n).astype(float) for side, n in zip((x, y), least, strict=True)]
    heavy = [np.flatnonzero(more[1][s : s + width]) for s in starts]
    total = [np.zeros(len(side["id"]), np.int64) for side in (x, y)]
    none = np.iinfo(np.int64).max
    first = [np.where(side["least"] < 0, none, side["least"]) for side in (x, y)]
    unknown = [side["least"] < 0 for side in (x, y)]
    low, high = _bounds(threshold, left.shape[1])
    scores, hits, nears = np.empty((tile, width), np.float32), np.empty((tile, width), bool), np.empty((tile, width), bool)
    open_x, open_y, reach = [], [], _reach(threshold)
    for c in range(0, len(left), rows):
        may = _reached(left[c : c + rows], centres, radius, reach)
        if same:
            may &= own_run[None, c : c + rows] >= np.arange(len(starts))[:, None]
        for k in np.flatnonzero(may.any(axis=1)):
            s, size, every = starts[k], sizes[k], c + np.flatnonzero(may[k])
            for t in range(0, len(every), tile):
                at = every[t : t + tile]
                score, hit, near = scores[: len(at)], hits[: len(at)], nears[: len(at)]
                np.matmul(left[at], right[k].T, out=score)
                np.greater_equal(score, high, out=hit)
                np.greater_equal(score, low, out=near)
                if same and (inside := np.flatnonzero(own_run[at] == k)).size:
                    later = x["id"][at[inside]][:, None] > ids[k]
                    hit[inside] &= later
                    near[inside] &= later
                words, others = hit.view(np.uint64), near.view(np.uint64)
                if (unsure := np.flatnonzero((words != others).ravel())).size:
                    of, column = np.nonzero((words.ravel()[unsure] ^ others.ravel()[unsure]).view(np.uint8).reshape(-1, 8))
                    row, word = np.divmod(unsure[of], width // 8)
                    open_x.append(at[row])
                    open_y.append(s + 8 * word + column)
                n = words.sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)
                if not n.any():
                    continue
                m = np.add.reduceat(words, np.arange(0, len(at), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)[:size]
                total[0][at] += least[1] * n
                total[1][s : s + size] += least[0] * m
                if heavy[k].size:
                    total[0][at] += (hit[:, heavy[k]] @ more[1][s + heavy[k]]).astype(np.int64)
                if (big := np.flatnonzero(more[0][at])).size:
                    total[1][s : s + size] += (more[0][at[big]] @ hit[big, :size]).astype(np.int64)
                if (new := np.flatnonzero((n > 0) & unknown[0][at])).size:
                    first[0][at[new]] = np.minimum(first[0][at[new]], ids[k][hit[new].argmax(axis=1)])
                if (new := np.flatnonzero((m > 0) & unknown[1][s : s + size])).size:
                    first[1][s + new] = np.minimum(first[1][s + new], x["id"][at[hit[:, new].argmax(axis=0)]])
    if open_x:
        a, b = np.concatenate(open_x), np.concatenate(open_y)
        for t in range(0, len(a), 1 << 16):
            i, j = a[t : t + (1 << 16)], b[t : t + (1 << 16)]
            full = np.round((x["x"][i] * y["x"][j]).sum(axis=1), 6) >= threshold
            for k, own, other, what in ((0, i[full], j[full], y), (1, j[full], i[full], x)):
                np.add.at(total[k], own, what["n"][other])
                some = unknown[k][own]
                np.minimum.at(first[k], own[some], what["id"][other[some]])
    return [{"id": side["id"][n > 0], "others": n[n > 0], "least": f[n > 0]} for side, n, f in zip((x, y), total, first, strict=True)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def alike_counts(items: DataFrame, threshold: float) -> DataFrame:
    """id, others, least: of each of ``items`` (id, embedding, n; ids from 0) the sum of n of those at a cosine of ``threshold`` (above 0) or more, itself left out, and their least id.

    Exact.  Blocks of vectors that lie close, laid out by planes through some ``LAID`` of them, meet as
    matrices, each pair once; a vector is only sent to blocks, and within them only meets runs, that a ball
    around them doesn't rule out.  The ``FIRST`` items meet all others at once, so that blocks need to look
    for the least id only of what is like none of those.  Two numbers a row leave a task, however many are
    alike.  Time grows with the square of the rows less what the balls rule out, memory is that of two blocks.
    """
    spark, count = items.sparkSession, items.count()
    if not count:
        return spark.createDataFrame([], "id long, others long, least long")
    laid = items.orderBy(F.xxhash64("id"), "id").limit(LAID).select("embedding").toArrow()
    centres: list[np.ndarray] = []
    planes = _planes(_unit(_matrix(laid["embedding"])), max(BLOCKS, math.ceil(count / BLOCK_ROWS)), centres)
    head = items.orderBy("id").limit(FIRST).select("id", "embedding").toArrow()
    sent = spark.sparkContext.broadcast((planes, np.stack(centres), head["id"].to_numpy(), _unit(_matrix(head["embedding"]))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, centres, ids, first = sent.value
        for batch in batches:
            if not len(batch):
                continue
            x, own = _unit(_matrix(batch["embedding"])), batch["id"].to_numpy()
            part = _part(x, planes)
            far = np.sqrt(((x - centres[part]) ** 2).sum(axis=1))
            least, unknown = np.full(len(x), -1, np.int64), np.arange(len(x))
            for s in range(0, len(ids), 256):
                some = ids[s : s + 256]
                found = _alike(x[unknown], first[s : s + 256], some, np.ones(len(some)), threshold, False, own_ids=own[unknown])[1]
                least[unknown] = found
                unknown = unknown[found < 0]
            yield pa.record_batch({"id": own, "n": batch["n"], "embedding": _lists(x), "part": part, "far": far, "least": least})

    def order(table: pa.Table) -> pa.Table:
        x, out = _matrix(table["embedding"]), []
        _order(x, np.arange(len(x)), out, 64)
        at = np.empty(len(x), np.int32)
        at[np.concatenate(out)] = np.arange(len(x), dtype=np.int32)
        return table.append_column("place", pa.array(at))

    row = "id long, n long, embedding array<double>, part int, far double, least long"
    placed = cut(items.select("id", "n", "embedding").mapInArrow(place, row).groupBy("part").applyInArrow(order, f"{row}, place int"))
    radius = np.full(len(centres), -np.inf)
    for r in placed.groupBy("part").agg(F.max("far").alias("far")).collect():  # no more than there are blocks
        radius[r.part] = r.far
    reach = _reach(threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value[1]
        for batch in batches:
            part = batch["part"].to_numpy()
            may = _reached(_matrix(batch["embedding"]), centres, np.maximum(radius, 0), reach) if len(batch) else np.zeros((0, 0), bool)
            for k in range(len(may)):
                at = np.flatnonzero((may[k] & (radius[k] >= 0)) | (part == k))
                if at.size:
                    some = batch.take(pa.array(at))
                    yield pa.record_batch({c: some[c] for c in ("id", "n", "embedding", "part", "least", "place")} | {"i": np.minimum(part[at], np.int32(k)), "j": np.maximum(part[at], np.int32(k))})

    def work(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sides = []
        for k in (i, j):
            own = [(b, np.flatnonzero(b["part"].to_numpy() == k)) for b in table.to_batches()]
            sides.append({"x": np.concatenate([_matrix(b["embedding"])[at] for b, at in own])} | {c: np.concatenate([b[c].to_numpy()[at] for b, at in own]) for c in ("id", "n", "place", "least")})
        out = [pa.table({"id": np.zeros(0, np.int64), "others": np.zeros(0, np.int64), "least": np.zeros(0, np.int64)})]
        if all(len(side["id"]) for side in sides):
            out += [pa.table(found) for found in _met(sides.pop(0), sides.pop(0), threshold, i == j)]  # not held here meanwhile
        return pa.concat_tables(out)

    dealt = placed.mapInArrow(deal, "id long, n long, embedding array<double>, part int, least long, place int, i int, j int")
    found = dealt.groupBy("i", "j").applyInArrow(work, "id long, others long, least long")
    return found.groupBy("id").agg(F.sum("others").alias("others"), F.min("least").alias("least"))


def greedy_similar(ranked: DataFrame, vectors: DataFrame, threshold: float, **options: int) -> DataFrame:
    """item and representative: greedy clusters of ``vectors`` (id, embedding, group) in the order of ``ranked`` (item, rank), ids as text.

    Equal vectors of a group are one node, the first in rank, whose representative all of them have.
    """
    rows = vectors.join(ranked, F.col("id") == F.col("item")).select("item", "rank", "embedding", "group")
    nodes = cut(rows.groupBy("group", "embedding").agg(F.min_by("item", "rank").alias("id"), F.min("rank").alias("rank")))
    pairs = cut(angular_pairs(nodes.select("id", "embedding", "group"), threshold, **options).select("a", "b"))
    both = pairs.union(pairs.select("b", "a"))
    heads = greedy_clusters(nodes.select(F.col("id").alias("item"), "rank"), both, vectors.sparkSession).withColumnRenamed("item", "id")
    named = nodes.join(heads, "id").select("group", "embedding", "representative")
    return rows.select("item", "group", "embedding").join(named, ["group", "embedding"]).select("item", "representative")


@F.pandas_udf(ArrayType(DoubleType()))
def letter_frequencies(text: pd.Series) -> pd.Series:
    """Share of each letter a to z among a text's characters, in either case, as a vector; of zeros for an empty text."""
    count = lambda t: np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=123)[97:123] / max(len(t), 1)
    return text.map(count, na_action="ignore")


def centred(vectors: DataFrame) -> DataFrame:
    """``vectors`` (id, embedding) less the mean of all; they are made once."""
    vectors = cut(vectors)
    means = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"))
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda m: m["mean"]).alias("means"))
    return vectors.crossJoin(F.broadcast(one)).withColumn("embedding", F.zip_with("embedding", "means", lambda x, m: x - m)).drop("means")  # one row
