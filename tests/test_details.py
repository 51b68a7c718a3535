"""Trees, letter numbers and links against loops."""

import gzip
import itertools
import random
from collections import Counter
from hashlib import md5

import pytest

from lectern.operators import graph, letters, synthesis, trees
from lectern.plans import PLANS
from lectern.sources import files

from .conftest import SMALL


@pytest.fixture(scope="module")
def paths(spark):
    rows = [
        ("t", 1, None, 0, "document", None, None), ("t", 2, 1, 0, "chapter", "One", None), ("t", 3, 2, 0, "paragraph", "first", None), ("t", 4, 2, 1, "paragraph", "", None), ("t", 5, 4, 0, "footnote", "note a", "a"),
        ("t", 6, 1, 1, "chapter", "Two", None), ("t", 7, 6, 1, "endnote", "end a", "a"), ("t", 8, 6, 0, "footnote", "plain", None), ("t", 9, 8, 0, "paragraph", "more", None), ("u", 1, None, 0, "document", "alone", None), ("u", 4, 99, 0, "paragraph", "lost", None),
    ]
    return trees.with_paths(spark.createDataFrame(rows, "tree string, node long, parent long, ord long, kind string, text string, ref string")).cache()


def test_subtrees_and_intervals(paths):
    text = {(r.tree, r.node): r.text for r in trees.subtree_texts(paths).collect()}
    assert text["t", 1] == "One\nfirst\nnote a\nTwo\nplain\nmore\nend a" and text["t", 4] == "note a" and text["u", 1] == "alone" and len(text) == 10
    at = {(r.tree, r.node): (r.first, r.last, r.depth) for r in trees.intervals(paths).collect()}
    assert at["t", 1] == (1, 9, 0) and at["t", 2] == (2, 5, 1) and at["t", 6] == (6, 9, 1) and at["t", 8] == (7, 8, 2) and at["u", 1] == (1, 1, 0)


def test_line_subtrees_as_by_rows_of_nodes_and_moving_no_text(spark):
    texts = ["", None, "  \n \n", "Title\nOne two three four. Five!  Six?\n\nA b c\n. . . . \nno stop in this line", "one line of words", "...", "x y  z\t w\n ! ? . !", "é à ü ö. ß.\r\nA\r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "tree long, text string")
    paths = trees.with_paths(trees.line_trees(docs)).cache()
    below = Counter((r.tree, r.above) for r in trees.found_below(paths, "sentence").collect())
    text = {(r.tree, r.node): r.text for r in trees.subtree_texts(paths).collect()}
    want = [(r.tree, r.kind, r.first, r.last, below[r.tree, r.node], md5(text[r.tree, r.node].encode()).hexdigest()) for r in trees.intervals(paths).filter("kind <> 'sentence'").collect()]
    got = trees.line_subtrees(docs)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 19
    plan = PLANS["document_trees"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(moved) <= 1 and not any("text#" in line for line in moved)


def test_found_nodes_and_notes(paths):
    below = {(r.above, r.node) for r in trees.found_below(paths, "paragraph").collect() if r.tree == "t"}
    assert below == {(1, 3), (1, 4), (1, 9), (2, 3), (2, 4), (3, 3), (4, 4), (6, 9), (8, 9), (9, 9)}
    mine = {(r.above, r.ref): r.text for r in trees.notes(paths).collect()}
    assert mine[1, "a"] == "end a" and mine[2, "a"] == "note a" and mine[6, "8"] == "plain\nmore" and (3, "a") not in mine


def longest_by_hand(options):
    best = 0
    for pick in itertools.product(*[[*o, None] for o in options]):
        taken = [x for x in pick if x is not None]
        if all(a < b for a, b in zip(taken, taken[1:])):
            best = max(best, len(taken))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_rising_sequences_are_longest(seed):
    r = random.Random(seed)
    options = [sorted({r.randrange(12) for _ in range(r.randint(1, 3))}, reverse=True) for _ in range(r.randint(0, 7))]
    got = letters.rising(options)
    taken = [x for x in got if x is not None]
    assert len(taken) == longest_by_hand(options) and all(a < b for a, b in zip(taken, taken[1:])) and all(x is None or x in o for x, o in zip(got, options, strict=True))


def test_planted_errors_are_repaired(spark):
    r = random.Random(7)
    rows, truth = [], {}
    for book in range(3):
        for i in range(120):
            n, raw = i + 5, str(i + 5)
            if r.random() < 0.12:
                raw = r.choice([raw + str(r.randrange(10)), str(r.randrange(1, 10)) + raw, str(r.randrange(1000))])
            rows.append((f"b{book}", i, raw))
            truth[f"b{book}", i] = n
    rows.append(("b0", 500, "x1"))
    got = letters.repaired_numbers(spark.createDataFrame(rows, "book string, pos long, raw string")).collect()
    right = sum(x.number == truth[x.book, x.pos] for x in got)
    assert len(got) == 360 and right >= 0.98 * len(got) and {x.how for x in got} >= {"read", "repaired", "between"}


def test_links_within_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "b"), ("f", "f")], "src string, dst string")
    got = {(r.seed, r.node): r.hop for r in graph.within_hops(e, 3).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("b", "e"): 3, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2, ("c", "e"): 2, ("d", "e"): 1}


def test_tension_blocks(spark):
    raw = """Thinking aloud.
TENSION: Grace against effort
  TYPE: Contradiction
  REF_A: 2 — all is given
  REF_B: 1 - work it out
TENSION: No such reflection
TYPE: evolution
REF_A: 1 — x
REF_B: 9 — y
TENSION: Odd kind
TYPE: quarrel
REF_A: 1 — only this
REF_A: 2 — then this
REF_B: 1 — that"""
    answers = spark.createDataFrame([(1, raw), (2, "NO_TENSIONS_FOUND"), (3, ""), (4, None)], "answer_id int, raw string")
    notes = spark.createDataFrame([(1, 1, "c1", "2024-05-06T10:00"), (1, 2, "c2", None), (2, 1, "c1", None)], "answer_id int, number int, chunk_id string, date string")
    got = [tuple(r)[2:] for r in synthesis.tensions(answers, notes).orderBy("answer_id", "pos").collect()]
    assert got == [("Grace against effort", "contradiction", "c2", "c1", "all is given", "work it out", "", "2024-05-06"), ("Odd kind", "uncertainty", "c2", "c1", "then this", "that", "", "2024-05-06")]


@pytest.mark.parametrize("packed", [False, True])
def test_dumped_relations(spark, tmp_path, packed):
    chunk = lambda i, work="smith--a": f'"Chunk", {{chunk_id: "{i:032x}", text: "over\nlines", work_id: "{work}"}}'
    records = [
        "from, type, to", chunk(1) + ', "EXPLORES_THEME", {score: 1}, "Theme", {canonical_name: "hope", name: "Hope"}', '"Work", {work_id: "smith--a"}, "AUTHORED", {}, "Person", {canonical_name: "x"}',
        chunk(2) + ', "MAKES_ARGUMENT", {}, "Argument", {claim: "a claim\nover lines", canonical_name: "arg"}', chunk(3) + ', "PART_OF", {}, "Work", {canonical_name: "w"}', chunk(4, "other--b") + ', "EXPLORES_THEME", {}, "Theme", {canonical_name: "joy"}',
        chunk(5) + ', "REFERENCES_PERSON", {}, "Person", {name: "Nobody"}', chunk(6) + ', "CONCEPT_USED_IN", {}, "Theme", {canonical_name: "wrong label"}', chunk(7) + ', "CONCEPT_USED_IN", {}, "Concept", {canonical_name: "sign", name: "Sign"}',
    ]
    name = tmp_path / ("dump.rels.gz" if packed else "dump.rels")
    (gzip.open if packed else open)(name, "wt").write("\n".join(records) + "\n")
    got = sorted(map(tuple, files.dump_edges(spark, str(name), "smith--").collect()))
    key = lambda i: f"{i:032x}"
    assert got == [(key(1), "EXPLORES_THEME", "Theme", "hope", "Hope", None), (key(2), "MAKES_ARGUMENT", "Argument", "arg", None, "a claim\nover lines"), (key(7), "CONCEPT_USED_IN", "Concept", "sign", "Sign", None)]
    assert files.dump_edges(spark, str(name)).count() == 4
