import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vector as V
from lectern.operators import chunking, fusion, graph, ingest, overlaps, search, sessions, vectors
from lectern.operators import surfacing as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_session_boundaries(spark):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m, seconds=s)
    rows = [
        (1, 1, at(0), "a", ["x", "y"]), (1, 2, at(60), "a", ["z"]), (1, 3, at(120, 1), "a", ["z"]), (1, 4, at(150, 1), "b", ["q"]),
        (1, 5, at(181), "c", ["z", "q"]), (1, 6, at(220), "d", ["k", "l"]), (1, 7, at(255), "e", []),
    ]
    got = sessions.decided(spark.createDataFrame(rows, "user_id long, capture_id long, ts timestamp_ntz, work_id string, themes array<string>")).orderBy("capture_id").collect()
    # An hour exactly goes on, a second more does not; 30 minutes exactly go on; half in common is no change; empty themes never are one.
    assert [r.reason for r in got] == ["first", "same_source", "timeout", "recent", "within_timeout", "theme_change", "within_timeout"]
    assert [r.session for r in got] == [1, 1, 2, 2, 2, 3, 3]


def test_fusion_sums_and_checks_weights(spark):
    a = spark.createDataFrame([("x", "v", 0.9, 1), ("y", "v", 0.8, 2)], "chunk_id string, source string, score double, rank int")
    b = spark.createDataFrame([("x", "t", 0.1, 1)], a.schema)
    got = {r.chunk_id: r for r in fusion.fuse([a, b]).collect()}
    assert got["x"].fused == pytest.approx(2 / 61) and got["x"].best_source == "v" and got["y"].fused == pytest.approx(1 / 62)
    with pytest.raises(ValueError):
        fusion.fuse([a], [1.0, 2.0])
    with pytest.raises(ValueError):
        fusion.fuse([])


def test_keep_first_registers_only_kept_rows(spark):
    rows = spark.createDataFrame([(0, 1, 1, "x"), (0, 2, 2, "x"), (0, 3, 2, "z")], "q long, arrival long, id long, text_key string")
    got = fusion.keep_first_by_id_and_text(rows, "q").orderBy("arrival").collect()
    assert [(r.id, r.text_key) for r in got] == [(1, "x"), (2, "z")]


def test_blend_reserves_personal(spark):
    rows = [(0, i, 1 - i / 10, "primary") for i in range(6)] + [(0, 9, 0.01, "personal")]
    got = fusion.blended(spark.createDataFrame(rows, "q long, id long, score double, source_class string"), 4, 2, "q").collect()
    assert {r.id for r in got} == {0, 1, 2, 9}


def test_zero_vector_and_hash_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert value(spark, V.cosine(arr(1, 1), arr(2, 2))) == pytest.approx(1.0)
    v = V.hash_vector("a")
    assert sum(x * x for x in v) == pytest.approx(1.0) and V.hash_vector("a") == v
    assert value(spark, V.embed(F.lit("a"))) == v


def test_greedy_clusters_take_free_neighbours(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)], "item string, rank int")
    near = [("a", "b"), ("b", "c"), ("c", "d")]
    similar = spark.createDataFrame(near + [(y, x) for x, y in near], "a string, b string")
    got = {r.item: r.representative for r in graph.greedy_clusters(ranked, similar, spark).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_paths_keep_first_edge_and_multiplicity(spark):
    e = spark.createDataFrame([("a", "b", "q", "high"), ("a", "c", "r", "low"), ("b", "d", "s", "low"), ("c", "d", "t", "low"), ("d", "a", "u", "low")], "src string, dst string, link_type string, confidence string")
    got = graph.paths(e, spark.createDataFrame([("a",)], "node string"), 4).collect()
    assert sorted((r.node, r.hops, r.link_type) for r in got if r.node == "d") == [("d", 2, "q"), ("d", 2, "r")]
    assert max(r.hops for r in got) == 4


def test_upsert_replaces_and_adds(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, graph.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert graph.insert_absent(old, new, ["k"]).count() == 3


def test_web_query():
    q = search.parse_query('sea "far shore" or land -ice')
    assert q.any_of == [["sea", "far shore"], ["land"]] and q.none_of == ["ice"]


def test_keyword_search_counts_neighbours(spark):
    p = spark.createDataFrame([(1, "the the sea"), (2, "The land, the ice"), (3, "theme")], "chunk_id long, text string")
    got = {r.chunk_id: (r.score, r.snippet) for r in search.keyword_search(p, "the -ice").collect()}
    assert got == {1: (pytest.approx(200 / 3, abs=1e-4), "**the** **the** sea")}


def test_text_functions(spark):
    assert value(spark, T.slugify(T.fold_marks(F.lit("Çà & là, Émile")))) == "ca-la-emile"
    assert value(spark, T.sanitize(F.lit("é\x92\x00"))) == "é’"
    assert value(spark, T.author_name(F.lit("Lewis, Clive Staples, 1898-1963"))) == "Clive Staples Lewis"
    assert value(spark, T.stamp_seconds(F.lit("[1:02:03] x"))) == 3723 and value(spark, T.stamp(F.lit(3723))) == "[1:02:03]"
    assert value(spark, T.language_code(F.lit("pt-BR"))) == "pt" and value(spark, T.language_code(F.lit("ger"))) == "de"
    assert value(spark, T.section_type(F.lit("Table of Contents"))) == "toc" and value(spark, T.section_type(F.lit("The Sea"))) is None
    assert value(spark, T.json_in_prose(F.lit("no json"))) is None
    assert T.salvage_array('[{"a": 1}, {"b":') == ['{"a": 1}'] and T.salvage_array("none") == []


def test_strategy_of_tags(spark):
    tags = lambda *x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    assert value(spark, chunking.strategy_of(tags("unknown", "Youtube-Captions", "poetry"))) == "transcript"
    assert value(spark, chunking.strategy_of(tags("transcript"))) == "sermon"  # named by two strategies: the later one's
    assert value(spark, chunking.strategy_of(tags("q_and_a"))) == "interview" and value(spark, chunking.strategy_of(tags("poems"))) == "poetry"
    assert value(spark, chunking.strategy_of(tags("unknown"))) == "scholarly" and value(spark, chunking.strategy_of(tags())) is None


def test_tiers(spark):
    cases = [("passage_link", 0.81, "high"), ("passage_link", 0.8, "medium"), ("passage_link", 0.5, "low"), ("theme", 0.76, "medium"), ("theme", 0.6, "low"), ("vector", 0.81, "high"), ("vector", 0.51, "medium"), ("vector", 0.5, "low"),
             ("reflection", 0.71, "high"), ("reflection", 0.41, "medium"), ("reflection", 0.4, "low"), ("entity_overlap", 0.9, "high"), ("entity_overlap", 0.7, "medium"), ("entity_overlap", 0.5, "low"), ("temporal", 0.9, "high"), ("temporal", 0.1, "low")]
    assert [value(spark, S.tier(F.lit(k), F.lit(s))) for k, s, _ in cases] == [t for *_, t in cases]
    assert value(spark, S.tier(F.lit("passage_link"), F.lit(0.1), F.lit("high"))) == "high" and value(spark, S.tier(F.lit("passage_link"), F.lit(0.1), F.lit("medium"))) == "medium"
    assert value(spark, S.tier(F.lit("reflection"), F.lit(0.1), direct=F.lit(True))) == "high"


def test_sections_and_chapters(spark):
    kinds = {"Contents": "toc", "Works Cited": "bibliography", "Index of First Lines": "index", "Dedication": "front_matter", "Preface: On Hope": "preface", "Appendix B": "back_matter", "Indexing": None, "The Preface": None}
    for heading, kind in kinds.items():
        assert value(spark, T.section_type(F.lit(heading))) == kind
    chapters = {"Chapter IV: The Sea": True, "part two": True, "Prologue": True, "Afterword": True, "Appendix b": True, "Prologue to it": False, "A chapter": False}
    for line, is_one in chapters.items():
        assert value(spark, T.is_chapter_heading(F.lit(line))) == is_one
    index = "\n".join(["Hope, 3, 17-19", "Sea 4", "Grace of God, 5", "other line", "Love, 7"])
    titles = "Smith, A Book (1990)\nJones, Another 1991.\nplain"
    assert value(spark, T.section_type_by_content(F.lit(index))) == "index" and value(spark, T.section_type_by_content(F.lit(titles))) == "bibliography"
    assert value(spark, T.section_type_by_content(F.lit("a\nb"))) is None


def test_citation_forms(spark):
    cases = {"footnote": ("as said. See Smith, pp. 12-14.", ["Smith"]), "parenthetical": ("so (Mary Jones, 1987, pp. 3) it is", ["Mary Jones"]), "attribution": ("a quote — John Donne, Holy Sonnets", ["John Donne"]), "inline": ("According to Smith's \"The Sea\" and in Jones's first book", ["Smith", "Jones"])}
    for form, pattern in T.CITATIONS:
        text, names = cases[form]
        assert value(spark, F.regexp_extract_all(F.lit(text), F.lit(pattern), F.lit(1))) == names, form


def test_scripture_in_order(spark):
    assert value(spark, T.scripture_refs(F.lit("as John 3:16 says, 1 John 4:7-9 and again John 3:16."))) == ["John 3:16", "1 John 4:7-9"]


def test_phrases_of_any_length(spark):
    texts = spark.createDataFrame([(1, "The old sea, and the old man"), (2, "an old sea"), (3, None), (4, "man")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "old sea"), (2, "the old sea and the old man"), (3, "man"), (4, ""), (5, "sea and the new")], "phrase_id long, phrase string")
    for most in (100, 1):  # with the hashes broadcast, and joined
        got = {tuple(r) for r in search.phrase_search(texts, asked, most=most).collect()}
        assert got == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 4)}


def test_nearest_as_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(0, 1, (60, 4))
    x[7] = 0
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "chunk_id long, embedding array<double>").repartition(3)
    asked = v.filter("chunk_id % 10 = 0").selectExpr("chunk_id as id", "embedding")
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    want = {(i, j) for i in range(0, 60, 10) for j in sorted((k for k in range(60) if k != i), key=lambda k: (-round(float(unit[i] @ unit[k]), 6), k))[:5]}
    for block in (4096, 2):
        assert {(a.id, a.chunk_id) for a in vectors.nearest(v, asked, 5, block).collect()} == want
    assert vectors.nearest(v, asked.limit(0), 5).count() == 0


def test_numbered_by_ranges(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(100)], "g string, o long")
    got = {(x.g, x.o): x.number for x in fusion.numbered(rows, "g", "o").collect()}
    for g in ("a", None):
        mine = sorted(o for h, o in got if h == g)
        assert [got[(g, o)] for o in mine] == list(range(len(mine)))


def test_keep_first_as_brute_force(spark):
    import random

    r = random.Random(2)
    rows = [(q, i, r.randrange(12), f"t{r.randrange(12)}") for q in range(3) for i in range(40)]
    want, ids, texts = [], {}, {}
    for q, i, a, t in rows:
        if a not in ids.setdefault(q, set()) and t not in texts.setdefault(q, set()):
            ids[q].add(a)
            texts[q].add(t)
            want.append((q, i))
    frame = spark.createDataFrame(rows, "q long, arrival long, id long, text_key string").repartition(4)
    assert sorted((x.q, x.arrival) for x in fusion.keep_first_by_id_and_text(frame, "q").collect()) == want


def test_themes_of_other_works(spark):
    """A seed's themes give other works' first passages, made up for where its own would have come first."""
    import collections

    edges = [(str(i), f"t{i % 3}") for i in range(60)] + [("1", "t0"), ("1", "t2")]
    owner = {str(i): "w0" if i < 30 else f"w{i % 4}" for i in range(60)}
    e = spark.createDataFrame(edges, "src string, dst string")
    w = spark.createDataFrame(list(owner.items()), "src string, owner string")
    got = collections.defaultdict(set)
    for r in S.by_themes(e.selectExpr("src as id").distinct(), e, w, 2, 4).collect():
        got[r.id].add(r.other)
    for i in owner:
        want = set()
        for t in sorted({d for s, d in edges if s == i})[:2]:
            want |= set(sorted((s for s, d in set(edges) if d == t and owner[s] != owner[i]), key=int)[:4])
        assert got[i] == want


@pytest.mark.parametrize("seed", [8, 9])
def test_top_shared_as_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    edges = {(f"s{i}", "K", f"t{min(int(r.expovariate(0.3)), 30)}") for i in range(150) for _ in range(6)} | {(f"s{i}", "K", "hot") for i in range(150)}
    edges |= {(f"s{i}", "K", t) for i in range(150, 190) for t in ("copied 1", "copied 2", "hot", *([f"t{seed}"] if i % 2 else []))}
    owner = {f"s{i}": f"w{i % 3 if i % 2 else 0}" for i in range(190)}
    sets = {s: {d for x, _, d in edges if x == s} for s in owner}
    pairs = sorted((-len(sets[a] & sets[b]), a, b) for a in owner for b in owner if a < b and owner[a] != owner[b] and len(sets[a] & sets[b]) >= 2)
    e, w = spark.createDataFrame([*edges, ("s1", "K", None), ("nobody", "K", "hot")], "src string, type string, dst string"), spark.createDataFrame(list(owner.items()), "src string, owner string")
    for k, rare in ((40, 64), (7, 3), (1000, 0)):
        got = overlaps.top_shared(e, w, k, rare=rare).collect()
        assert [(-x.shared, x.a, x.b) for x in got] == pairs[:k] and all(set(x.targets) == sets[x.a] & sets[x.b] for x in got)
    assert overlaps.top_shared(e.limit(0), w, 5).count() == 0


def test_similar_within_as_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 1, (80, 3)), 3)
    x[5] = 0
    rows = [(f"i{i}", [float(c) for c in v], f"g{i % 2}") for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>, group string")
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    want = {(f"i{i}", f"i{j}") for i in range(80) for j in range(80) if i != j and i % 2 == j % 2 and round(float(unit[i] @ unit[j]), 6) >= 0.7}
    for block in (1024, 9):
        got = search.similar_within(frame, frame, 0.7, block=block).collect()
        assert {(g.a, g.b) for g in got} == want and len(got) == len(want)
    assert search.similar_within(frame.limit(0), frame, 0.7).count() == 0


def test_greedy_clusters_as_brute_force(spark):
    import random

    r = random.Random(4)
    links = {(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(60)) if a != b}
    links |= {(b, a) for a, b in links}
    rank = {i: r.randrange(10_000) * 100 + i for i in range(40)}
    want = {}
    for i in sorted(rank, key=rank.get):
        if i not in want:
            want[i] = i
            want |= {j: i for j in range(40) if (i, j) in links and j not in want}
    ranked = spark.createDataFrame([(str(i), k) for i, k in rank.items()], "item string, rank long")
    near = spark.createDataFrame([(str(a), str(b)) for a, b in links], "a string, b string")
    assert {int(x.item): int(x.representative) for x in graph.greedy_clusters(ranked, near, spark).collect()} == want


def test_staged_connections(spark):
    rows = [("1", "2", "theme", 0.6, "low"), ("1", "3", "vector", 0.3, "low"), ("1", "4", "vector", 0.9, "high"), ("1", "5", "theme", 0.6, "low"), ("1", "6", "entity_overlap", 0.75, "medium"), ("1", "7", "passage_link", 0.95, "high")]
    found = spark.createDataFrame(rows, "id string, other string, kind string, score double, confidence string")
    works = spark.createDataFrame([(str(i), "own" if i in (1, 5) else f"w{i}") for i in range(1, 8)], "src string, owner string")
    links = spark.createDataFrame([("4", "1")], "src string, dst string")
    got = {r.other: r for r in S.staged(found, works, links).collect()}
    assert set(got) == {"2", "6", "7"}  # 3 is low, 4 linked, 5 of the own work
    assert got["7"].label == "This directly engages with" and got["7"].why.endswith("explicit citation.") and got["2"].target_work == "w2"
    assert {r.other for r in S.staged(found, works, links, most=1).collect()} == {"7"}


def test_candidate_terms(spark):
    texts = ["Grace Of God and Grace Of God. The Old Sea", "he said 'living water' and \"living water\" too; Only Once", "The Old Sea again", None, ""]
    got = {r.term: r.n for r in ingest.candidate_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {"Grace Of God": 2, "living water": 2}


def test_titles_of_images_and_entries(spark):
    alts = {"Book title, The Sea, subtitle, and Other Tales, author, A B": "The Sea and Other Tales", "title, Hope, Love, subtitle, A Life, imprint, X": "Hope, Love: A Life", "author, A B, title, One": "One", "a picture, of the sea": None, "subtitle, only": None}
    for alt, title in alts.items():
        assert value(spark, ingest.title_of_alt(F.lit(alt))) == title
    kinds = {"3 Desires": "chapter_intro", "Copyright 1990": "skip", "Dedication": "skip", "Foreword": "essay", "A Morning Offering": "poem"}
    for title, kind in kinds.items():
        assert value(spark, ingest.entry_kind(F.lit(title), F.lit("short\nlines"))) == kind
    assert value(spark, ingest.entry_kind(F.lit("On Hope"), F.lit("a long line of prose that goes on and on " * 100))) == "essay"
    caps = {"F OR  L IGHT": "For Light", "M ATINS": "Matins", "A Morning Offering": "A Morning Offering", "I N  T HE  E ND": "In The End"}
    for raw, clean in caps.items():
        assert value(spark, ingest.clean_capitals(F.lit(raw))) == clean


def test_restored_graph(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = make([("1", "T", "bad"), ("1", "K", "x")], "src string, type string, dst string")
    got = ingest.restored(edges, "T", make([("hope",)], "key string"), make([("1", "hope"), ("1", "hope"), ("9", "hope"), ("1", "lost")], "src string, dst string"), make([("1",), ("2",)], "key string"))
    assert sorted(map(tuple, got.collect())) == [("1", "K", "x"), ("1", "T", "hope")]


def test_json_set(spark):
    cases = [('{"a": 1, "b": "x, y"}', "b", "z", {"a": 1, "b": "z"}), ('{"b": "x"}', "b", "z", {"b": "z"}), ("{}", "b", 'q"uo', {"b": 'q"uo'}), ('{"b": 2, "a": [1]}', "b", "z", {"a": [1], "b": "z"}), ('{"a": null}', "b", "", {"a": None, "b": ""})]
    for doc, key, new, want in cases:
        assert json.loads(value(spark, ingest.json_set(F.lit(doc), key, F.lit(new)))) == want


def test_context_text(spark):
    assert value(spark, ingest.passage_text(F.lit("words"), F.lit("a--b"), F.lit("primary"))) == "[PRIMARY] [a--b]\nwords"
    assert value(spark, ingest.passage_text(F.lit("words"), F.lit("a--b"), F.lit("primary"), F.lit("graph"))) == "[PRIMARY] [a--b] (via graph)\nwords"
    seen = F.array(*[F.struct(F.lit(f"w{i}").alias("work_id"), F.lit(f"s{i}").alias("summary")) for i in range(4)])
    more = F.array(*[F.lit(f"t{i}") for i in range(7)])
    assert value(spark, ingest.theme_summary(F.lit("hope"), F.lit("for"), seen, more)) == "Theme: hope\n  Author's stance: for\n  In w0: s0\n  In w1: s1\n  In w2: s2\n  Related themes: t0, t1, t2, t3, t4"
    assert value(spark, ingest.theme_summary(F.lit("hope"), F.lit("for"), F.slice(seen, 1, 1), F.slice(more, 1, 0))) == "Theme: hope\n  Author's stance: for\n  In w0: s0"


def test_ingestion_report(spark):
    text = "Index\n\n" + "\n\n".join("word " * n for n in (300, 250, 29, 30)) + "\n\nChapter 2\n\nlast words here"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Preface")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "macro", 0)], "doc_id long, granularity string, position long")
    got = {r.doc_id: r for r in ingest.ingested(docs, known).collect()}
    assert (got[1].macro, got[1].meso, got[1].micro, got[1].words, got[1].to_embed, got[1].status) == (1, 2, 3, 612, 5, "embed")
    assert got[2].status == got[3].status == "empty"
    kinds = {(r.granularity, r.position): r.section_type for r in ingest.passages_of(docs).collect()}
    assert kinds[("micro", 1)] == "index" and kinds[("macro", 0)] == "index"


def test_links_on_demand_scans_and_directions(spark):
    links = spark.createDataFrame([("explicit", "1", "2", 0.9), ("explicit", "2", "3", 0.9), ("thematic", "1", "2", 0.4), ("implicit", "1", "3", 0.7)], "scan string, src string, dst string, score double")
    works = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "src string, owner string")
    found = lambda *a: {tuple(r)[:4] for r in ingest.links_on_demand(links, works, *a).select("work_id", "scan", "direction", "links").collect()}
    assert found(("explicit", "thematic"), 0.5) == {("a", "explicit", "forward", 1), ("b", "explicit", "retroactive", 1)}
    assert found(("implicit", "thematic"), 0.3, False) == {("a", "implicit", "forward", 1), ("a", "thematic", "forward", 1)}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert chunking.scholarly(empty).count() == 0
    assert search.keyword_search(empty.withColumnRenamed("doc_id", "chunk_id"), "a").count() == 0
