"""The pipeline's rows against a brute-force version of its stages."""

import collections
import hashlib
import random
import re

import corpus_pipeline
from lectern.llm import language_id, mixing
from lectern.llm.queries import queries, training_fold

from .conftest import with_clashes
from .test_corpus import groups_by_hand, language_by_hand, sha

SMALL = "/root/testdata/sf0.001"


def mix_by_hand(rows):
    """How often each row (doc_id, text, source) comes in the mix: streams in hash order, targets by resharing."""
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(w for w, r in zip(words, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(words), set(sources)
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}:
        target |= {s: 2 * size[s] for s in over}
        open_ -= over
        left -= sum(2 * size[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    times = collections.Counter()
    for s in sources:
        stream = sorted((hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0], w, i) for i, (w, r) in enumerate(zip(words, rows, strict=True)) if r[2] == s)
        at, goal = 0, int(target[s])
        for _ in range(2):
            for _, _, w, i in stream:
                times[i] += w > 0 and at < goal
                at += w
    return times


def test_run_as_brute_force(spark, docs):
    """Every stage by hand; each row's digest is that of a whole text of its input."""
    from tokenizers import Tokenizer

    from lectern.llm.queries import tokenizer_path

    model = language_id.fit(docs, training_fold())
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = [r for r in rows if not language_by_hand(model, r[1])[2]]
    last = {}
    for r in rows:
        last[r[1]] = max(last.get(r[1], r), r, key=lambda x: x[0])
    rows = list(last.values())
    rows = [rows[min(g, key=lambda i: rows[i][0])] for g in groups_by_hand(rows)]
    library = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for i, n in mix_by_hand(rows).items():
        if n:
            ids = library.encode(rows[i][1], add_special_tokens=False).ids
            want[(rows[i][0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += n
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want


def near_odd(spark):
    """Near copies that share an id or have none, beside other texts under the same id."""
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    one, two = text(80), text(80)
    near = lambda words: " ".join([*words[:40], f"x{r.randrange(10_000)}", *words[41:]])
    rows = [(1, " ".join(one)), (None, near(one)), (None, near(one)), (None, " ".join(text(30))), (5, " ".join(two)), (5, near(two)), (5, " ".join(text(30))), (7, None), (8, ""), (9, "few"), (9, "few"), (None, "few")]
    return spark.createDataFrame([(*x, "en", "s", 0) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_as_brute_force_on_odd_rows(spark, odd):
    """Rows that the first four stages keep, with null and repeated ids, null texts and clashing columns."""
    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0] is None, r[0] or 0)
    for frame in (odd, odd.unionByName(odd), near_odd(spark), near_odd(spark).limit(0)):
        rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
        of = lambda name: collections.Counter((r.doc_id, r.text, r.source) for r in stage[name](spark, frame, SMALL).collect())  # noqa: B023, E731
        model = language_id.fit(frame, training_fold())
        short = [r for r in rows if len(r[1] or "") < 10_000]
        assert collections.Counter({k: n for k, n in of("language_id").items() if len(k[1] or "") < 10_000}) == collections.Counter(r for r in short if model is not None and not language_by_hand(model, r[1])[2])
        kept = {}
        for r in rows:
            kept[r[1] or ""] = max(kept.get(r[1] or "", r), r, key=lambda x: -1 if x[0] is None else x[0])
        exact = of("exact_dedup")
        assert sorted(map(repr, ((k[0], k[1] or "") for k in exact.elements()))) == sorted(repr((r[0], r[1] or "")) for r in kept.values())
        near = of("near_dedup")
        groups = groups_by_hand([r[:2] for r in rows])
        assert sum(near.values()) == len(groups)
        for g in groups:
            mine = [k for k in near if any(rows[i] == k for i in g)]
            assert len(mine) == 1 and key(mine[0]) == min(key(rows[i]) for i in g)
        mixed = of("mixing")
        words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        assert set(mixed) <= set(rows) and all(words(k) and n <= 2 * rows.count(k) for k, n in mixed.items())


def test_run_encodes_whole_texts(spark, docs):
    from tokenizers import Tokenizer

    from lectern.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    digest = {i: sha(" ".join(map(str, library.encode(text[i], add_special_tokens=False).ids))) for i in {r.doc_id for r in got}}
    assert got and all(r.ids_sha256 == digest[r.doc_id] for r in got)


def test_mix_takes_documents_whole(spark):
    """Every row of the mix is a row of its input, and a source misses its target by less than a document."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(7 + 13 * (i % 5))), f"s{i % 4}") for i in range(60)]
    rows = [(i, t, s, len(t)) for i, t, s in rows] + [(60, " \n" + "long " * 3000, "s4", 15_002), (61, "", "s4", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.materialise(frame).collect()
    assert {tuple(r) for r in got} <= set(rows)
    plan = mixing.mix(frame).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += len(r.text.split())
    part = [p for p in plan if p.size and p.taken % p.size]
    assert part and {p.doc_id for p in plan if p.taken} == {r.doc_id for r in got}
    most = {s: max(p.size for p in plan if p.source == s) for s in taken}
    assert all(int(p.target) <= taken[p.source] < p.target + most[p.source] for p in plan)


def test_stages_keep_the_columns(spark, odd, none):
    for frame in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == frame.columns, name
            assert out.count() <= 2 * frame.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SMALL).count() == odd.count()


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert {*queries(), "pipeline"} <= set(entry.queries()) and len(queries()) == 13
    assert with_clashes(spark.range(1)).columns
