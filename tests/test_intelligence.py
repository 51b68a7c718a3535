"""Terminology, themes and voices against loops."""

import collections
import math
import random
import re

import pytest

from lectern.operators import intelligence as N
from lectern.plans import PLANS
from lectern.plans.intelligence import words
from lectern.tables import chunks

SMALL = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_variants_as_brute_force(spark):
    r = random.Random(2)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(150)}
    got = {tuple(x) for x in N.variant_pairs(spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(a, b) for a in terms for b in terms if a != b and distance(a, b) <= 1}


def test_terms_stand_for_the_frequent_spelling(spark):
    rows = [("colour", 100), ("color", 400), ("colou", 25), ("colur", 3), ("honor", 5), ("honour", 19), ("alone", 1)]
    got = {x.term: x.canonical for x in N.normalised_terms(spark.createDataFrame(rows, "term string, n long")).collect()}
    assert got == {"colour": "color", "color": "color", "colou": "color", "colur": "color", "honor": "honor", "honour": "honour", "alone": "alone"}
    assert N.normalised_terms(spark.createDataFrame([], "term string, n long")).count() == 0


def themes_by_hand(rows, least=3, share=0.1, most=12, rounds=10):
    n = collections.Counter(rows)
    df = collections.Counter(t for _, t in n)
    total = len({c for c, _ in rows})
    weight = collections.defaultdict(dict)
    for (c, t), k in n.items():
        if least <= df[t] <= share * total:
            weight[c][t] = round(k * math.log(total / df[t]), 6)
    top = {c: dict(sorted(w.items(), key=lambda x: (-x[1], x[0]))[:most]) for c, w in weight.items()}
    w = collections.Counter((a, b) for mine in top.values() for a in mine for b in mine if a != b)
    near = collections.defaultdict(dict)
    for (a, b), k in w.items():
        if k >= 2:
            near[a][b] = k
    label, own = {a: a for a in near}, {a: max(v.values()) for a, v in near.items()}
    for _ in range(rounds):
        new = {}
        for a in near:
            votes = collections.Counter({label[a]: own[a]})
            for b, k in near[a].items():
                votes[label[b]] += k
            new[a] = min(votes, key=lambda x: (-votes[x], x))
        if new == label:
            break
        label = new
    size = collections.Counter(label.values())
    out = {}
    for c, mine in top.items():
        score = collections.Counter()
        for t, x in mine.items():
            if t in label and size[label[t]] > 1:
                score[label[t]] += x
        if score:
            best = min(score, key=lambda x: (-round(score[x], 4), x))
            out[c] = (best, round(score[best], 4))
    return out, {x: k for x, k in size.items() if k > 1}


def test_themes_as_brute_force(spark):
    docs = chunks(spark, SMALL).select("chunk_id", "text").collect()
    rows = [(d.chunk_id, t) for d in docs for t in re.findall("[a-z]{5,}", (d.text or "").lower())]
    want, sizes = themes_by_hand(rows)
    got = PLANS["thematic_index"](spark, SMALL).collect()
    assert {x.chunk_id: x.theme for x in got} == {c: t for c, (t, _) in want.items()} and {x.theme: x.terms for x in got}.items() <= sizes.items()
    assert all(x.score == pytest.approx(want[x.chunk_id][1], abs=2e-4) and x.name for x in got) and len(got) > 20


def test_planted_themes_are_found(spark):
    r = random.Random(1)
    topics = [[f"sea{i}" for i in range(8)], [f"war{i}" for i in range(8)], [f"art{i}" for i in range(8)]]
    rows = [(c, t) for c in range(90) for t in [*r.sample(topics[c % 3], 5), f"noise{c}"]]
    themes, found = N.thematic_index(spark.createDataFrame(rows, "chunk_id long, term string"), share=0.5)
    assert themes.count() == 3 and all(x.theme[:3] == ("sea", "war", "art")[x.chunk_id % 3] for x in found.collect())


def test_voices_of_few_words(spark):
    rows = [(g, t) for g, text in (("a", "the of the and"), ("b", "the of the and"), ("c", "and and and of"), (None, "the")) for t in text.split()]
    frame = spark.createDataFrame(rows, "group string, term string")
    z, _ = N.voice_vectors(frame, 2)
    assert {x.term for x in z.collect()} == {"the", "and"} and abs(sum(x.z for x in z.collect())) < 1e-9
    near = {x.group: (x.other, x.score) for x in N.nearest_voices(frame, 1).collect()}
    assert near["a"] == ("b", 1.0) and near["b"] == ("a", 1.0)
    assert words(frame.limit(0).withColumn("text", frame.term)).count() == 0
