"""Stems, questions, ranks, headlines and the index against plain Python."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions.stems import lexeme, stem
from lectern.operators import fulltext as T

STEMS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor hopping hop hoping hope falling fall filing file happy happi
relational relat conditional condit consistently consist knightly knight consigned consign generously generous communism communism adjustable adjust controlling control gas gas
gaps gap kiwis kiwi say say by by cry cri bed bed luxuriated luxuri beautiful beauti argument argument running run national nation hopefulness hope skies sky succeeding succeed
yellow yellow boyish boyish rational ration apology apolog basically basic dying die news news inning inning exceed exceed""".split()
TEXTS = [
    "The runner was running and runs on; he ran.", "Imagination is the living power. The living imagine it, living on.", "a power of imagination", "nothing here", "", None,
    "power " * 300 + "imagination", "Powers, imagined. " + "filler words go on and on " * 30 + "the power to imagine at last", "living powers imagine power",
]


def test_stems():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert lexeme("the") is None and stem("") == ""


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")


def places(text):
    out = {}
    for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
        if (x := lexeme(w)) is not None and len(out.setdefault(x, [])) < 256:
            out[x].append(i)
    return out


def score(query, at, normalise=0):
    names = query.lexemes

    def holds(phrase):
        return any(all(p + gap in at.get(x, ()) for x, gap in phrase) for p in at.get(phrase[0][0], ()))

    if not any(all(map(holds, wanted)) and not any(map(holds, barred)) for wanted, barred in query.any_of):
        return None
    if len(names) < 2 or len(query.any_of) > 1:
        res = sum(0.1 * sum(1 / (i * i) for i in range(1, len(at.get(x, ())) + 1)) / 1.64493406685 for x in names) / len(names)
    else:
        res = -1.0
        for a, b in itertools.combinations(names, 2):
            for p in at.get(a, ()):
                for q in at.get(b, ()):
                    d = abs(p - q)
                    w = 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
                    res = w if res < 0 else 1 - (1 - res) * (1 - w)
        res = 1e-20 if res < 0 else res
    total, kinds = sum(map(len, at.values())), len(at)
    for flag, by in ((1, math.log2(total + 1)), (2, total), (8, kinds), (16, math.log2(kinds + 1))):
        res = res / by if normalise & flag else res
    return res / (res + 1) if normalise & 32 else res


QUESTIONS = ["imagination power", "imagine -living", "running or powers", '"living power"', '"power of imagination" or runs', "the of", "power", '-"living powers" imagine power', "imagining powers living"]


@pytest.mark.parametrize("normalise", [0, 1, 2, 8, 16, 33])
def test_ranks_as_brute_force(passages, normalise):
    for text in QUESTIONS:
        query = T.web_query(text)
        want = {i: s for i, t in enumerate(TEXTS) if query.any_of and (s := score(query, places(t), normalise)) is not None}
        got = {r.id: r.score for r in T.search_ranked(T.found_positions(passages, query.lexemes), query, None, normalise).collect()} if query.any_of else {}
        assert got == pytest.approx(want, abs=2e-9), text


def test_questions():
    assert T.web_query('the cats or "dog of war" -running').any_of == (((((("cat", 0),)),), ()), (((("dog", 0), ("war", 2)),), ((("run", 0),),)))
    assert T.web_query("the").any_of == () and T.phrase_query("of the").any_of == ()


def test_index_answers_like_the_scan(spark, passages, tmp_path):
    index = T.TextIndex.write(passages, str(tmp_path / "index"), 8, 2)
    again = T.TextIndex.read(spark, str(tmp_path / "index"), 8)
    for text in QUESTIONS:
        scan = T.keyword_search(passages, text).collect()
        assert scan == T.keyword_search(passages, text, index=index).collect() == T.keyword_search(passages, text, index=again).collect()
    read = again.rows.filter("bucket = 3 and lexeme = 'power'")
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()


def test_snippets_are_in_the_result(passages):
    rows = T.keyword_search(passages, "imagining powers", 3).collect()
    assert all("**" in r.snippet for r in rows) and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert T.keyword_search(passages, "power of imagination", phrase=True).collect()[0].snippet.count("**") == 4


def cover_by_hand(hits):
    best = None
    for i, j in itertools.combinations_with_replacement(range(len(hits)), 2):
        window = (-len({x for _, x in hits[i : j + 1]}), hits[j][0] - hits[i][0], hits[i][0], hits[j][0])
        best = window if best is None else min(best, window)
    return best and best[2:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcx"), max_size=25))
def test_covers_are_the_shortest(words):
    hits = [(i, w) for i, w in enumerate(words) if w != "x"]
    assert T.cover(hits) == cover_by_hand(hits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["running", "on", "filler", "power", "x"]), max_size=90), st.integers(1, 20), st.integers(20, 60))
def test_headlines_have_their_size(words, least, most):
    text = " ".join(words)
    out = T.headline(text, frozenset({"run", "power"}), least, most)
    shown = re.findall(r"[^\W_]+", out)
    assert min(least, len(words)) <= len(shown) <= most and " ".join(shown) in text
    hits = [(i, lexeme(w)) for i, w in enumerate(words) if lexeme(w) in ("run", "power")]
    if hits:
        first, last = T.cover(hits)
        if last - first < most:
            assert {"run", "power"} & {lexeme(w) for w in words[first : last + 1]} <= {lexeme(w) for w in shown}
    assert out.count("**") == 2 * sum(lexeme(w) in ("run", "power") for w in shown)


def test_question_picks_its_branches(spark):
    from lectern.operators import ask

    texts = ["the living power of old", "power and more power", "a living thing", "nothing", "power living", "the last one here"]
    passages = spark.createDataFrame([(i, "w", t, "micro" if i % 2 else "macro") for i, t in enumerate(texts)], "chunk_id long, work_id string, text string, granularity string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "chunk_id long, embedding array<double>")
    links = spark.createDataFrame([(3, 0, "high"), (5, 2, "low"), (2, 5, "medium"), (1, 3, "high")], "src long, dst long, confidence string")
    works = spark.createDataFrame([("w", "Title", None)], "work_id string, title string, publication_year int")
    query = vectors.filter("chunk_id = 0").select(F.col("embedding").alias("query_vector"))
    quote = {r.chunk_id: (r.section, r.n) for r in ask.retrieved(passages, vectors, links, 'find the quote "living power"', query).collect()}
    # The phrase stands in 0; vectors of micro passages are 1, 3, 5 in order; links lead from these to 2 alone.
    assert quote == {0: (0, 1), 1: (0, 2), 3: (0, 3), 5: (0, 4), 2: (1, 1)}
    thematic = ask.retrieved(passages, vectors, links, "living power", query)
    rows = {r.chunk_id: (r.section, r.n) for r in thematic.collect()}
    assert {i for i, (s, _) in rows.items() if s == 0} == {0, 1, 2, 4} and {i for i, (s, _) in rows.items() if s == 1} == {3, 5}
    small = ask.answered(thematic, passages, works, 12).collect()
    assert sum(max(1, len(texts[r.chunk_id]) // 4) for r in small) <= 12 and {r.year for r in small} == {"undated"}
