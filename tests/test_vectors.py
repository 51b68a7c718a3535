"""Vectors: blocks and the index against brute force, angular joins on planted neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors as X
from lectern.plans import PLANS
from lectern.tables import vectors

SMALL = "/root/testdata/sf0.01"


def cosines(x, y):
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1)) == 0, 1, n)[:, None]
    return np.round(unit(x) @ unit(y).T, 6)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x, strict=True)], "chunk_id long, embedding array<double>")


def test_nearest_in_blocks_as_by_broadcast(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((60, 6)), np.zeros((1, 6)), np.tile(r.standard_normal((1, 6)), (5, 1))])
    rows = frame(spark, x)
    asked = rows.select(F.col("chunk_id").alias("id"), "embedding")
    monkeypatch.setattr(X, "ROWS", 13)
    monkeypatch.setattr(X, "QUESTIONS", 7)
    score = cosines(x, x)
    want = {(i, int(j), float(score[i, j])) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-score[i, j], j))[:4]}
    for block in (10, 1000):
        assert {tuple(r) for r in X.nearest(rows, asked, 4, block).collect()} == want
    assert X.nearest(rows, asked.limit(0), 4).count() == 0


def test_index_finds_nine_of_ten(spark):
    v = vectors(spark, SMALL).select("chunk_id", "embedding")
    asked = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("id"), "embedding")
    exact = X.nearest(v, asked, 10)
    got = X.recall(PLANS["nearest_indexed"](spark, SMALL), exact).first()
    assert got.wanted == 250 and got.recall >= 0.9


def test_index_on_disk(spark, tmp_path):
    v = vectors(spark, SMALL).select("chunk_id", "embedding")
    asked = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("id"), "embedding")
    index = X.VectorIndex.build(v, str(tmp_path / "index"), lists=16, sample=300)
    assert index.rows.count() == v.count() and index.rows.select("chunk_id").distinct().count() == v.count()
    assert sorted(map(tuple, index.search(asked, 5, probes=16).collect())) == sorted(map(tuple, X.nearest(v, asked, 5).collect()))
    few = index.search(asked, 5, probes=8)
    assert X.recall(few, X.nearest(v, asked, 5)).first().recall >= 0.7
    assert X.recall(X.VectorIndex.read(spark, str(tmp_path / "index")).search(asked, 5, 8), few).first().recall == 1


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(5)
    heads = r.standard_normal((40, 24))
    x = [heads]
    for noise in (0.0, 0.15, 0.45, 0.55):
        x.append(heads + noise * r.standard_normal(heads.shape))
    return np.concatenate(x)


def test_angular_pairs_find_what_is_planted(spark, planted):
    score = cosines(planted, planted)
    group = np.arange(len(planted)) % 2
    want = {(int(a), int(b)) for a, b in np.argwhere(score >= 0.85) if a < b and group[a] == group[b]}
    rows = frame(spark, planted).select(F.col("chunk_id").alias("id"), "embedding", (F.col("chunk_id") % 2).alias("group"))
    got = {(r.a, r.b): r.score for r in X.angular_pairs(rows, 0.85).collect()}
    assert len(want) > 100 and set(got) <= want and len(got) >= 0.98 * len(want) and X.miss_chance(0.85, 12, 48) < 0.01
    assert all(s == score[a, b] for (a, b), s in got.items())


def test_greedy_clusters_of_similar_vectors_merge(spark, planted):
    score, group = cosines(planted, planted), np.arange(len(planted)) % 2
    order = sorted(range(len(planted)), key=lambda i: (-(i * 7 % 5), str(i)))
    rep = {}
    for i in order:
        if i not in rep:
            for j in order:
                if j not in rep and group[i] == group[j] and (i == j or score[i, j] >= 0.85):
                    rep[j] = i
    rows = frame(spark, planted).select(F.col("chunk_id").cast("string").alias("id"), "embedding", (F.col("chunk_id") % 2).alias("group"))
    ranked = rows.select(F.col("id").alias("item"), F.struct((-(F.col("id").cast("int") * 7 % 5)).alias("degree"), F.col("id").alias("item")).alias("rank"))
    got = {int(r.item): int(r.representative) for r in X.greedy_similar(ranked, rows, 0.85).collect()}
    assert got == rep and len(set(rep.values())) < len(rep) / 2


def test_concepts_by_angle_as_by_blocks(spark):
    assert sorted(map(tuple, PLANS["concepts_by_angle"](spark, SMALL).collect())) == sorted(map(tuple, PLANS["theme_dedup"](spark, SMALL).select("item", "representative").collect()))


def test_alike_counts_as_by_brute_force(spark, planted, monkeypatch):
    x = np.concatenate([planted, np.zeros((1, 24)), planted[:1] * 3])
    ids, n = np.random.default_rng(2).permutation(500)[: len(x)], 1 + np.arange(len(x)) % 3
    rows = frame(spark, x, ids).join(spark.createDataFrame([(int(i), int(k)) for i, k in zip(ids, n, strict=True)], "chunk_id long, n long"), "chunk_id").withColumnRenamed("chunk_id", "id")
    near = cosines(x, x) >= 0.85
    np.fill_diagonal(near, False)
    want = {(int(ids[i]), int(n[m].sum()), int(ids[m].min())) for i, m in enumerate(near) if m.any()}
    for most in (1000, 17):
        monkeypatch.setattr(X, "BLOCK_ROWS", most)
        assert {tuple(r) for r in X.alike_counts(rows, 0.85).collect()} == want and len(want) > 100
    shown = X._alike(_unit := x / np.where((k := np.linalg.norm(x, axis=1)) == 0, 1, k)[:, None], _unit, np.arange(len(x)), n, 0.85, True, tile=7, width=11)
    assert [int(v) for v in shown[0]] == [int(n[m].sum()) for m in near]


def test_cosines_at_the_threshold_are_decided_in_double():
    angles = np.arccos(0.97 - 5e-7 + np.linspace(-3e-8, 3e-8, 601))
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    total, first = X._alike(x, np.array([[1.0, 0.0]]), np.array([9]), np.array([4]), 0.97, False)
    want = np.round(x[:, 0], 6) >= 0.97
    assert 0 < want.sum() < len(x) and (total == 4 * want).all() and (first == np.where(want, 9, -1)).all()


def test_letters_of_texts_alike(spark, tmp_path):
    texts = ["Abba \u212a", "abbak ", "", None, "zz", "ZZ", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    v = {r.text: r.v for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("text", X.letter_frequencies("text").alias("v")).collect()}
    assert v[None] is None and v[""] == [0.0] * 26 and v["zz"] == v["ZZ"] and v["Abba \u212a"][:2] == [2 / 6] * 2 and v["Abba \u212a"][10] == 1 / 6
    got = {r.doc_id: (r.n_alike, r.first_alike) for r in PLANS["alike_by_letters"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1), 1: (1, 0), 2: (0, None), 3: (0, None), 4: (1, 5), 5: (1, 4), 6: (0, None)}


def _side(x, ids, n, least=None):
    order = []
    X._order(x, np.arange(len(x)), order, 16)
    return {"x": x, "id": ids, "n": n, "place": np.argsort(np.concatenate(order)), "least": np.full(len(x), -1) if least is None else least}


def _sums(found):
    got = {}
    for part in found:
        for i, others, least in zip(*(part[c].tolist() for c in ("id", "others", "least")), strict=True):
            total, first = got.get(i, (0, least))
            got[i] = (total + others, min(first, least))
    return got


def test_blocks_meet_once_and_what_is_far_not_at_all(monkeypatch):
    r = np.random.default_rng(3)
    x = X._unit(X._unit(r.standard_normal((12, 8)))[r.integers(12, size=1500)] + 0.08 * r.standard_normal((1500, 8)))
    x[7] = 0
    ids, n = r.permutation(5000)[:1500], r.integers(3, 6, 1500)
    near = np.round(x @ x.T, 6) >= 0.97
    np.fill_diagonal(near, False)
    product, done = np.matmul, []
    monkeypatch.setattr(X.np, "matmul", lambda a, b, out: (done.append(len(a) * b.shape[1]), product(a, b, out=out)))
    want = {int(ids[i]): (int(n[m].sum()), int(ids[m].min())) for i, m in enumerate(near) if m.any()}
    whole = _side(x, ids, n)
    for sizes in ({"rows": 100, "tile": 30, "width": 16}, {"width": 64}):
        done.clear()
        assert _sums(X._met(whole, whole, 0.97, True, **sizes)) == want and len(want) > 1000
        assert sum(done) < 0.25 * len(x) ** 2
    known = _side(x, ids, n, np.array([want.get(i, (0, -1))[1] for i in ids.tolist()]))
    assert _sums(X._met(known, known, 0.97, True)) == want
    met = near.copy()
    met[:600, :600] = met[600:, 600:] = False
    want = {int(ids[i]): (int(n[m].sum()), int(ids[m].min())) for i, m in enumerate(met) if m.any()}
    assert _sums(X._met(_side(x[:600], ids[:600], n[:600]), _side(x[600:], ids[600:], n[600:]), 0.97, False, tile=100, width=32)) == want


def test_pairs_of_blocks_at_the_threshold_are_decided_in_double():
    angles = np.arccos(0.97 - 5e-7 + np.linspace(-3e-8, 3e-8, 601))
    x, one = np.stack([np.cos(angles), np.sin(angles)], axis=1), np.array([[1.0, 0.0]])
    alike = np.flatnonzero(np.round(x[:, 0], 6) >= 0.97)
    left, right = _side(x, np.arange(601), np.full(601, 2)), _side(one, np.array([900]), np.array([4]))
    for sides in ((left, right), (right, left)):
        assert _sums(X._met(*sides, 0.97, False)) == {int(i): (4, 900) for i in alike} | {900: (2 * len(alike), int(alike[0]))}


def test_alike_counts_of_none_and_few(spark):
    rows = [(5, [1.0, 0.0], 2), (7, [0.0, 0.0], 1), (9, [2.0, 0.01], 3)]
    for most, want in ((0, set()), (1, set()), (3, {(5, 3, 9), (9, 2, 5)})):
        frame = spark.createDataFrame(rows[:most], "id long, embedding array<double>, n long")
        assert {tuple(r) for r in X.alike_counts(frame, 0.97).collect()} == want
