"""Operator 9: quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics.  For every language and source the minimum
covariance determinant is estimated as deterministic MCD does: from four robust starts (medians and
median absolute deviations, the plain moments, spatial signs, hyperbolic tangents) concentration steps
take location and scatter of the share of texts that lie nearest under the estimate before, until the
determinant falls no further; the start with the least determinant wins.  Texts far off by their
Mahalanobis distance are rejected.  A step is one aggregation over all texts for all groups and starts:
distances fall into bins of fixed borders, whose counts, sums and cross products are summed before any
shuffle, so no group is gathered and every text counts.  Vectors are fixed-point numbers, which makes
the sums exact and reruns equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, id_back, id_text, join_by_parts

#: The transformed statistics: word length, symbols a word, repeated lines and words, letters of words.
VECTOR = ("v_length", "v_symbols", "v_lines", "v_repeats", "v_odd")
_D = len(VECTOR)
#: Least standard deviations of the statistics, so that a group in which one hardly varies rejects no small difference;
#: each is small enough against the statistic's range that it alone can reject.
FLOORS = (0.15, 0.4, 0.2, 0.25, 0.4)
_SCALE = 10_000
_SYMBOLS = re.compile("[#*$%&|<>]+")
_GAPS = " \t\n\x0b\x0c\r"
_ODD = np.ones(256, dtype=bool)
for _c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *SPACES, *range(0x80, 0x100), *b".,;:!?'\"()-"):
    _ODD[_c] = False


def covered_by_repeats(ids: np.ndarray, size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more; ``ids`` number the words by their bytes.

    Windows are numbered exactly, those of twice the length from pairs of shorter ones.
    """
    have, names = 1, ids
    while have < size:
        step = min(have, size - have)
        pairs = names[:-step] * (int(names.max(initial=0)) + 1) + names[step:]
        found, names, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        have += step
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    marks[: len(names)] += count[names] > 1
    marks[size:] -= count[names] > 1
    return int((np.cumsum(marks)[: len(ids)] > 0).sum())


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and odd characters of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    number: dict[bytes, int] = {}
    words = [number.setdefault(w, len(number)) for w in raw.split()]
    repeats = covered_by_repeats(np.array(words, dtype=np.int64)) if len(number) < len(words) else 0
    gaps = sum(map(text.count, _GAPS))
    lines = [x for x in text.split("\n") if x.strip(_GAPS)]
    odd = int(_ODD[np.frombuffer(raw, dtype=np.uint8)].sum())
    return len(words), len(text) - gaps, sum(map(len, _SYMBOLS.findall(text))), len(lines) - len(set(lines)), repeats, odd


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The measures of every row of ``docs`` and its vector, as whole numbers of 1/10000."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([measure(t) for t in batch["text"]], dtype=np.int64).reshape(-1, 6)
            words, chars, symbols, lines, repeats, odd = found.T
            n = np.maximum(words, 1)
            vector = np.stack((np.log(np.maximum(chars, 1) / n), np.log1p(50.0 * symbols / n), np.log1p(10.0 * lines / n), np.log1p(20.0 * repeats / n), np.log1p(50.0 * odd / np.maximum(chars, 1))))
            frame = batch[["doc_id", "lang", "source"]].reset_index(drop=True)
            frame[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]] = found[:, :5]
            frame["base_failed"] = (words < 10) | (100 * repeats > 20 * words)
            frame[list(VECTOR)] = np.rint(vector.T * _SCALE).astype(np.int64)
            yield frame

    slim = docs.select(id_text(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id string, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{v} long" for v in VECTOR)
    return id_back(slim.mapInPandas(work, schema))


_PAIRS = list(combinations_with_replacement(range(_D), 2))


def _sums() -> list[Column]:
    """Count, sums and cross products of the vectors of a group, exact."""
    singles = [F.sum(F.col(v).cast("decimal(38,0)")).alias(f"s{i}") for i, v in enumerate(VECTOR)]
    return [F.count(F.lit(1)).alias("n"), *singles, *[F.sum((F.col(VECTOR[i]) * F.col(VECTOR[j])).cast("decimal(38,0)")).alias(f"c{i}_{j}") for i, j in _PAIRS]]


_GROUP = ("lang", "source")
#: Groups of a text for pooled estimates: level 0 is language and source, 1 the language, 2 all texts.
_LEVELS = ("level", *_GROUP)
_FIT = "group long, start int, size long, n long, mean array<double>, inverse array<double>, logdet double"
#: A start's steps end when the logarithm of the determinant falls by less than this.
_SETTLED = 1e-4


def _moments(r: dict, first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a row of sums."""
    n = int(r["n"])
    mean = np.array([float(r[f"{first}{i}"]) for i in range(_D)]) / n / _SCALE
    cross = np.zeros((_D, _D))
    for i, j in _PAIRS:
        cross[i, j] = cross[j, i] = float(r[f"{second}{i}_{j}"]) / n / _SCALE**2
    return mean, cross - np.outer(mean, mean)


def _fit(mean: np.ndarray, scatter: np.ndarray, floors: tuple[float, ...]) -> tuple:
    """mean, inverse and logarithm of the determinant, the scatter widened by a floor on every axis."""
    wide = scatter + np.diag(np.square(floors))
    return mean.tolist(), np.linalg.inv(wide).ravel().tolist(), float(np.linalg.slogdet(wide)[1])


def starts_of(r: dict, floors: tuple[float, ...]) -> list[tuple]:
    """The four starting estimates of a group from its medians, spreads and sums."""
    middle, spread = np.array(r["middle"], dtype=float), np.array(r["spread"], dtype=float)
    mean, cover = _moments(r, "s", "c")
    _, signs = _moments(r | {f"o{i}": 0 for i in range(_D)}, "o", "u")
    _, bent = _moments(r, "t", "w")
    scale = np.sqrt(np.maximum(np.diag(bent), 1e-12))
    correlation = bent / np.outer(scale, scale)
    np.fill_diagonal(correlation, 1.0)
    axes = np.outer(spread, spread)
    return [_fit(middle, np.diag(spread**2), floors), _fit(mean, cover, floors), _fit(middle, _D * signs * axes, floors), _fit(middle, correlation * axes, floors)]


def _starts(floors: tuple[float, ...]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                for k, (mean, inverse, _) in enumerate(starts_of(r, floors)):
                    rows.append((int(r["group"]), k, int(r["n"]), int(r["n"]), mean, inverse, float("inf")))
            yield pd.DataFrame(rows, columns=["group", "start", "size", "n", "mean", "inverse", "logdet"])

    return work


def _steps(share: float, floors: tuple[float, ...]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                mean, scatter = _moments(r, "s", "c")
                rows.append((int(r["group"]), int(r["start"]), int(r["all"]), int(r["n"]), *_fit(mean, scatter * _consistency(share), floors)))
            yield pd.DataFrame(rows, columns=["group", "start", "size", "n", "mean", "inverse", "logdet"])

    return work


def _chi2_cdf5(x: float) -> float:
    """Distribution of the sum of five squared normals."""
    from math import erf, exp, pi, sqrt

    return erf(sqrt(x / 2)) - sqrt(2 * x / pi) * exp(-x / 2) * (1 + x / 3)


def _quantile5(p: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf5(middle) < p else (low, middle)
    return high


def _consistency(share: float) -> float:
    """Factor that makes the scatter of the nearest ``share`` of a normal cloud that of the whole."""
    from math import exp, pi, sqrt

    q = _quantile5(share)
    seven = _chi2_cdf5(q) - sqrt(2 / pi) * q**2.5 * exp(-q / 2) / 15
    return share / seven if share < 1 else 1.0


def _distance():
    """Squared Mahalanobis distance to ``mean`` under ``inverse``, in plain expressions."""
    off = [F.col(v) / float(_SCALE) - F.element_at("mean", i + 1) for i, v in enumerate(VECTOR)]
    terms = [off[i] * off[j] * F.element_at("inverse", i * _D + j + 1) * (1.0 if i == j else 2.0) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _middles(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """size, medians and spreads of every group, the spreads widened by the floors.

    Values are whole numbers of a bounded range, so exact medians are counts by value.
    """
    middle = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"), *[F.median(v).alias(f"m{i}") for i, v in enumerate(VECTOR)]))
    met = join_by_parts(rows, middle, ("group",), "size")
    centred = met.withColumns({v: F.abs(F.col(v) - F.col(f"m{i}")) for i, v in enumerate(VECTOR)})
    spread = centred.groupBy("group").agg(F.first("size").alias("size"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(_D)], *[F.median(v).alias(v) for v in VECTOR])
    mean = F.array(*[F.col(f"m{i}") / float(_SCALE) for i in range(_D)])
    scale = F.array(*[F.sqrt(F.pow(1.4826 * F.col(v) / float(_SCALE), F.lit(2.0)) + float(floors[i]) ** 2) for i, v in enumerate(VECTOR)])
    return cut(spread.select("group", "size", mean.alias("middle"), scale.alias("spread")))


def _first_fits(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """The starts of every group; signs and tangents are whole numbers of 1/10000, so their sums are exact too."""
    near = join_by_parts(rows, _middles(rows, floors), ("group",), "size")
    z = [(F.col(v) / float(_SCALE) - F.element_at("middle", i + 1)) / F.element_at("spread", i + 1) for i, v in enumerate(VECTOR)]
    near = near.withColumns({f"z{i}": x for i, x in enumerate(z)}).withColumn("long", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_D)), F.lit(0.0))), F.lit(1e-9)))
    near = near.withColumns({f"u{i}": F.round(F.col(f"z{i}") / F.col("long") * _SCALE).cast("long") for i in range(_D)} | {f"y{i}": F.round(F.tanh(f"z{i}") * _SCALE).cast("long") for i in range(_D)})
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    more = [exact(F.col(f"y{i}")).alias(f"t{i}") for i in range(_D)] + [exact(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{name}{i}_{j}") for c, name in (("u", "u"), ("y", "w")) for i, j in _PAIRS]
    sums = near.groupBy("group").agg(*_sums(), *more, F.first("middle").alias("middle"), F.first("spread").alias("spread"))
    return cut(sums.mapInPandas(_starts(floors), _FIT))


def concentrate(rows: DataFrame, *, share: float = 0.75, floors: tuple[float, ...] = FLOORS, by: tuple[str, ...] = _GROUP) -> DataFrame:
    """``by``, start, n, mean, inverse, logdet: the estimate of least determinant for every group of ``rows``.

    Each start's steps go on while the determinant falls; as the floors bound it from below, they end.
    The nearest ``share`` is cut at a bin's border (bins are 1/32 of a power of two wide), so a little more
    than the share is in.  Groups are numbered first, so that steps join and sum by a number.
    """
    names = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("all")).withColumn("group", F.monotonically_increasing_id()))
    rows = cut(join_by_parts(rows, names, by, "all", nulls=True).select("group", *VECTOR))
    fits = _first_fits(rows, floors).withColumn("open", F.lit(True))
    while True:
        near = join_by_parts(rows, fits.filter("open").select("group", "start", "size", "mean", "inverse"), ("group",), "size").withColumn("bin", F.floor(F.log2(_distance() + 1e-3) * 32).cast("int"))
        bins = near.groupBy("group", "start", "bin").agg(*_sums())
        order = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        kept = bins.withColumns({"before": F.coalesce(F.sum("n").over(order), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("group", "start"))}).filter(F.col("before") < F.lit(share) * F.col("all"))
        sums = kept.groupBy("group", "start").agg(F.first("all").alias("all"), *[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(_D)], *[f"c{i}_{j}" for i, j in _PAIRS])])
        tried = sums.mapInPandas(_steps(share, floors), _FIT)
        falls = F.col("t.logdet").isNotNull() & (F.col("t.logdet") < F.col("f.logdet") - _SETTLED)
        both = fits.alias("f").join(tried.alias("t"), ["group", "start"], "left")
        fits = cut(both.select("group", "start", *[F.when(falls, F.col(f"t.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("size", "n", "mean", "inverse", "logdet")], falls.alias("open")))
        if fits.filter("open").isEmpty():
            break
    best = F.min_by(F.struct("start", "n", "mean", "inverse", "logdet"), F.struct("logdet", "start"))
    return fits.groupBy("group").agg(best.alias("best")).join(names, "group").select(*by, "best.*")


def _pooled(rows: DataFrame, sound: DataFrame, least: int, **options) -> DataFrame:
    """lang, source, rows (how many), mean and inverse for every group of ``rows``.

    The estimate is the group's own from ``least`` sound texts on, else its language's from as many on,
    else that of all sound texts, however few.  Only the estimates that some group needs are made.
    """
    groups = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("base_failed")).alias("n"))
    groups = groups.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang")))
    groups = cut(groups.withColumn("own", F.when(F.col("n") >= least, 0).when(F.col("of_lang") >= least, 1).otherwise(2)))
    placed = join_by_parts(sound, groups, _GROUP, "rows", nulls=True)
    levels = [placed.filter("own = 0").withColumn("level", F.lit(0))]
    if not groups.filter("own = 1").isEmpty():
        small = cut(groups.filter("own = 1").groupBy("lang").agg(F.max("of_lang").alias("held")))
        levels.append(join_by_parts(sound, small, ("lang",), "held", nulls=True).withColumns({"level": F.lit(1), "source": F.lit(None).cast("string")}))
    if not groups.filter("own = 2").isEmpty():
        levels.append(sound.withColumns({"level": F.lit(2), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    columns = [*_LEVELS, *VECTOR]
    fits = concentrate(reduce(DataFrame.unionByName, [x.select(*columns) for x in levels]), by=_LEVELS, **options)
    wanted = groups.withColumns({"at_lang": F.when(F.col("own") < 2, F.col("lang")), "at_source": F.when(F.col("own") < 1, F.col("source"))})
    same = (F.col("g.own") == F.col("f.level")) & F.col("g.at_lang").eqNullSafe(F.col("f.lang")) & F.col("g.at_source").eqNullSafe(F.col("f.source"))
    return cut(wanted.alias("g").join(fits.alias("f"), same, "left").select("g.lang", "g.source", "g.rows", "f.mean", "f.inverse"))


def judge(docs: DataFrame, *, cut_off: float = 1e-4, share: float = 0.75, floors: tuple[float, ...] = FLOORS, least: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    base_failed: fewer than 10 words, or over a fifth of them in repeated five-word windows.  Of the
    others those are kept whose squared distance is at most the chi-square quantile at 1 - ``cut_off``.
    Null and empty texts have no words and fail.  Null languages and sources make groups of their own;
    groups of fewer than ``least`` sound texts are judged by the estimate of their language, or of all
    texts where the language has fewer too.  Repeated rows count each; an empty table gives an empty
    result; further columns are not read.  ``floors`` are least standard deviations of the statistics.
    """
    rows = cut(statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col))
    fit = _pooled(rows, rows.filter("not base_failed").drop("doc_id"), least, share=share, floors=floors)
    joined = join_by_parts(rows, fit, _GROUP, "rows", nulls=True).withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= _quantile5(1 - cut_off))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")
