"""Operator 1: language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed subwords (letter n-grams of its words, with word
ends marked).  Embeddings and softmax are trained together by stochastic gradient descent in numpy on
a bounded sample.  One class more than there are languages stands for none of them: it learns from
letters that are drawn anew, from those of the sample and from other alphabets.  A temperature fitted
on a calibration part makes scores probabilities, and the rejection threshold is a quantile of the
scores that the calibration part's own languages get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks_of, id_back, id_text, mix64

GRAMS = (2, 3, 4)


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` bounds the labelled rows used for the fit, shared evenly among the languages."""

    sample_docs: int = 2400
    buckets: int = 1 << 17
    width: int = 16
    epochs: int = 4
    rate: float = 0.6
    decay: float = 1e-3
    calibration: float = 0.2
    reject_share: float = 0.002
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``table`` holds each bucket's share in the logits, embeddings times softmax weights; the last column is of no language."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def subwords(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every subword of ``texts``, in order of text within each n."""
    lowered = [t.lower() for t in texts]
    text = "\n".join(["", *lowered, ""])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    lengths = np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(texts))
    owner = np.concatenate((np.zeros(1, dtype=np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), lengths)))
    keep = letter.copy()  # of a run of other characters, the first stays as a word end
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, owner, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), owner[keep], letter[keep]
    owners, found = [], []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        whole = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            whole &= letter[j : j + m]
        whole &= letter[:m] | letter[n - 1 : n - 1 + m]
        if n == 2:
            whole &= letter[:m] & letter[1 : 1 + m]
        at = np.flatnonzero(whole)
        value = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            value = value * np.uint64(0x1FFFFF) + codes[at + j]
        found.append((mix64(value) % np.uint64(buckets)).astype(np.int32))
        owners.append(owner[at + 1 if n > 2 else at])
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate(owners), np.concatenate(found)


#: First letters and numbers of alphabets that noise is drawn from.
_ALPHABETS = ((0x61, 26), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 28), (0x905, 50), (0xE01, 46), (0x3041, 83), (0x4E00, 2000), (0xAC00, 2000))


def noise(text: str, seed: int, most: int = 400) -> str:
    """A made-up text of no language, ``most`` characters at most, with word lengths as ``text`` begins.

    Letters are those of ``text`` shuffled, drawn evenly from a to z, or drawn from another alphabet.
    """
    rng = np.random.default_rng(seed)
    codes = np.frombuffer(text[:most].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    at = np.flatnonzero(_letters()[codes])
    kind = rng.random()
    first, size = _ALPHABETS[0 if kind < 0.65 else rng.integers(len(_ALPHABETS))]
    codes[at] = rng.permutation(codes[at]) if kind < 0.4 else first + rng.integers(0, size, len(at))
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _features(settings: Settings):
    def counted(text: str) -> tuple[bytes, bytes]:
        _, found = subwords([text], settings.buckets)
        index, count = np.unique(found, return_counts=True)
        return index.astype("<i4").tobytes(), count.astype("<f4").tobytes()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, order, text in zip(batch["lang"], batch["order"], batch["text"], strict=True):
                rows.append((lang, order, *counted(text), *counted(noise(text, order & 0x7FFFFFFF))))
            yield pd.DataFrame(rows, columns=["lang", "order", "index", "weight", "noise_index", "noise_weight"])

    return work


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _excerpt(index: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A few of a text's subwords, as a short text has them."""
    index, count = np.unique(rng.choice(index, rng.integers(8, 65), p=count / count.sum(dtype=np.float64)), return_counts=True)
    return index, count.astype(np.float32)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least loss, by golden section; 1 if the loss falls on to an end of the range."""

    def loss(log_t: float) -> float:
        return float(-np.log(_softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth] + 1e-300).mean())

    low, high = np.log(1e-3), np.log(1e3)
    ends = loss(low), loss(high)
    ratio = (np.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    best = (low + high) / 2
    return float(np.exp(best)) if loss(best) < min(ends) and np.log(1e-3) + 0.01 < best < np.log(1e3) - 0.01 else 1.0


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], settings: Settings, noises: list[tuple[np.ndarray, np.ndarray]] = ()) -> Model | None:
    """Fit on (language, buckets, counts) rows and (buckets, counts) of no language; None without any. The order matters."""
    rows = [r for r in rows if len(r[1])]
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return None
    label = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(settings.seed)
    data = [(label[lang], i, c) for lang, i, c in rows] + [(len(languages), i, c) for i, c in noises if len(i)]
    held = np.concatenate([np.arange(n) % max(2, round(1 / settings.calibration)) == 1 for n in (len(rows), len(data) - len(rows))])
    learn, check = [r for r, h in zip(data, held, strict=True) if not h], [r for r, h in zip(data, held, strict=True) if h]
    seen = np.zeros(settings.buckets, dtype=bool)
    for _, index, _ in learn:
        seen[index] = True
    embedding = rng.normal(0, 1 / settings.width, (settings.buckets, settings.width)).astype(np.float32)
    embedding[~seen] = 0  # what was never met says nothing
    weight = np.zeros((settings.width, len(languages) + 1), dtype=np.float32)
    bias = np.zeros(len(languages) + 1, dtype=np.float32)
    steps, done = settings.epochs * max(1, len(learn)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(learn)):
            truth, index, count = learn[i]
            if rng.random() < 0.5:
                index, count = _excerpt(index, count, rng)
            share = count / count.sum()
            own = embedding[index]
            mean = share @ own
            slope = _softmax(mean @ weight + bias)
            slope[truth] -= 1
            rate = settings.rate * (1 - done / steps)
            back = weight @ slope
            weight -= rate * (np.outer(mean, slope) + settings.decay * weight)
            bias -= rate * slope
            embedding[index] = own * (1 - rate * settings.decay) - (rate * len(index) * share)[:, None].clip(max=4.0) * back
            done += 1
    table = (embedding @ weight).astype(np.float32)
    check = check or learn
    # Excerpts too, as many as it takes for ten scores below the quantile.
    times = max(1, -(-10 // (settings.reject_share * len(check)))) if settings.reject_share > 0 else 1
    check = check + [(truth, *_excerpt(i, c, rng)) for truth, i, c in check for _ in range(int(times))]
    logits = np.stack([(c / c.sum()) @ table[i] + bias for _, i, c in check])
    truth = np.array([r[0] for r in check])
    temperature = _temperature(logits, truth)
    real = _softmax(logits / temperature)[truth < len(languages), : len(languages)].max(axis=1)
    threshold = float(np.quantile(real, settings.reject_share, method="lower"))
    return Model(languages, table, bias, temperature, threshold)


def fit(docs: DataFrame, training: Column, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on a sample of the rows of ``docs`` for which ``training`` holds.

    At most ``sample_docs`` rows are taken and sent, by the order of a hash of id and text; a row reaches the
    driver as at most ``buckets`` counts in binary form, whatever its text's length.  Rows without language,
    text or id are not used; rows that agree in all three are one.  Hash thresholds leave some more than are
    needed, of which each language's first are named before any text moves, so no language is gathered in
    one task.  Each row gives one of no language too.  Of more than ``sample_docs`` languages the most
    frequent are learned.
    """
    slim = docs.filter(training & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("order"))
    slim = slim.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.sample_docs).collect())
    if not counts:
        return None
    each = max(1, settings.sample_docs // len(counts))
    unit = F.pmod(F.col("order"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * each / n + 20 / n))])
    near = slim.filter(unit < share[F.col("lang")])
    ranked = Window.partitionBy("lang").orderBy(F.pmod(F.col("order"), F.lit(1 << 30)), "order")
    taken = near.select("lang", "order").distinct().withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= each).drop("rank")
    sample = near.join(F.broadcast(taken), ["lang", "order"]).dropDuplicates(["lang", "order"]).mapInPandas(_features(settings), "lang string, order long, index binary, weight binary, noise_index binary, noise_weight binary")
    rows, noises = [], []
    for r in sorted(sample.collect(), key=lambda r: (r.order % (1 << 30), r.order, r.lang, r["index"])):
        rows.append((r.lang, np.frombuffer(r["index"], dtype="<i4"), np.frombuffer(r["weight"], dtype="<f4")))
        noises.append((np.frombuffer(r["noise_index"], dtype="<i4"), np.frombuffer(r["noise_weight"], dtype="<f4")))
    return train(rows, settings, noises)


def predict_texts(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language, score and rejection of each text; ``und``, 0 and rejected where nothing can be said."""
    if model is None:
        return [("und", 0.0, True)] * len(texts)
    if not texts:
        return []
    whole = [t or "" for t in texts]
    k = len(model.languages)
    total = np.zeros((len(texts), k + 1))
    count = np.zeros(len(texts))
    for a, b in chunks_of([len(t) for t in whole], 1 << 18):
        owner, found = subwords(whole[a:b], len(model.table))
        for j in range(k + 1):
            total[a:b, j] = np.bincount(owner, weights=model.table[:, j][found], minlength=b - a)
        count[a:b] = np.bincount(owner, minlength=b - a)
    score = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best = score[:, :k].argmax(axis=1)
    out = []
    for i, t in enumerate(whole):
        if not count[i] and not any(c.isalpha() for c in t):
            out.append(("und", 0.0, True))
        else:
            top = float(score[i, best[i]])
            out.append((model.languages[best[i]], top, top < model.threshold))
    return out


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected, from the whole text alone.

    Null texts and texts without a letter get ``und`` with score 0 and are rejected, and so are those
    whose calibrated score is below the model's threshold (they keep their best language).  Repeated
    rows give repeated rows, empty tables empty ones; other columns are not read.  Narrow, without a
    shuffle; the model is broadcast, its size being ``buckets`` times the languages and one, in floats.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(predict_texts(sent.value, batch["text"].tolist()), columns=["lang_pred", "score", "rejected"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), out], axis=1)

    slim = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return id_back(slim.mapInPandas(work, "doc_id string, lang_pred string, score double, rejected boolean"))


def keep_identified(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`identify` does not reject.

    Each row is judged alone, so repeated rows stay or go together; nulls in other columns and further
    columns of any name pass through; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([not rejected for _, _, rejected in predict_texts(sent.value, texts)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
