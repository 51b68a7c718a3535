"""Operators over the corpus: language, duplicates, mixing, lines, quality."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, quality
from lectern.llm.common import WordHasher, join_by_parts
from lectern.llm.components import components
from lectern.llm.oracle import EXACT, LINES, MIXING
from lectern.llm.queries import op1_language_id, op4_exact_dedup, op5_mixing, op7_line_dedup, op9_quality, training_fold

from ..compare import connect, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- language ID

def test_language_held_out(spark, rows):
    got = {r.doc_id: r for r in op1_language_id(spark, SMALL).collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in held}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(r.rejected for r in got.values()) <= 2


def test_language_odd_rows(odd, none, docs):
    model = language_id.fit(docs, training_fold())
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und" and r.score == 0 and r.rejected) == (r.doc_id in (3, 4, 5, 7) or r.doc_id is None and r.lang_pred == "und") for r in got)
    assert language_id.identify(none, model).count() == 0 and language_id.fit(none, training_fold()) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    kept = language_id.keep_identified(odd, model)
    want = collections.Counter(r.doc_id for r in got if not r.rejected)
    assert kept.columns == odd.columns and collections.Counter(r.doc_id for r in kept.collect()) == want and want[9] == want[10] == 1


FOREIGN = (
    "La volpe veloce salta sopra il cane pigro mentre il sole tramonta dietro le colline", "A gyors barna róka átugorja a lusta kutyát, miközben a nap lenyugszik",
    "すばやい茶色の狐がのろまな犬を飛び越える", "Быстрая коричневая лиса прыгает через ленивую собаку", "Szybki brązowy lis przeskakuje nad leniwym psem, a słońce zachodzi",
    "xqzt vvrk plmn", "bcdf ghjk lmnp qrst vwxz " * 20,
)


def test_language_rejects_what_it_has_not_learned(spark):
    """Unlearned languages and random letters are rejected; of the documents no more than the share asked for, about."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, training_fold())
    assert all(rejected for _, _, rejected in language_id.predict_texts(model, list(FOREIGN)))
    r = random.Random(3)
    letters = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(40)) for _ in range(100)]
    assert np.mean([x[2] for x in language_id.predict_texts(model, letters)]) >= 0.98
    rows = [x for x in docs.collect() if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    got = language_id.predict_texts(model, [x.text for x in rows])
    assert np.mean([x[2] for x in got]) <= 3 * language_id.Settings().reject_share and np.mean([g[0] == x.lang for g, x in zip(got, rows, strict=True)]) >= 0.97


def test_language_temperature_is_no_end_of_a_range():
    r = np.random.default_rng(1)
    truth = r.integers(0, 3, 4000)
    logits = r.normal(0, 1, (4000, 3))
    draw = np.array([r.choice(3, p=language_id._softmax(x / 0.4)) for x in logits])
    assert language_id._temperature(logits, draw) == pytest.approx(0.4, rel=0.1)
    assert language_id._temperature(np.eye(3)[truth] * 9, truth) == 1.0  # separated without error: no least loss


@functools.lru_cache(None)
def bucket_by_hand(gram):
    value = len(gram)
    for c in gram:
        value = (value * 0x1FFFFF + ord(c)) % (1 << 64)
    return int(language_id.mix64(np.array([value], dtype=np.uint64))[0])


def language_by_hand(model, text):
    """Language, score and rejection of a text, by loops over its words."""
    grams, words = collections.Counter(), "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for word in words:
        padded = f"\0{word}\0"
        for n in language_id.GRAMS:
            for j in range(len(padded) - n + 1):
                gram = padded[j : j + n]
                if "\0" not in gram or n > 2 and not (gram[0] == gram[-1] == "\0"):
                    grams[bucket_by_hand(gram) % len(model.table)] += 1
    if not words:
        return "und", 0.0, True
    logits = (sum(model.table[b].astype(float) * c for b, c in grams.items()) / max(1, sum(grams.values())) + model.bias) / model.temperature
    chance = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    best = int(chance[:-1].argmax())
    return model.languages[best], float(chance[best]), bool(chance[best] < model.threshold)


def test_language_as_brute_force(docs, odd, rows):
    model = language_id.fit(docs, training_fold())
    texts = [r.text for r in rows[:80] if len(r.text or "") < 3000] + [r.text for r in odd.collect() if len(r.text or "") < 3000] + list(FOREIGN)
    for one, other in zip(language_id.predict_texts(model, texts), (language_by_hand(model, t) for t in texts), strict=True):
        assert one[0] == other[0] and one[1] == pytest.approx(other[1], abs=1e-6) and one[2] == other[2]


def test_language_fit_of_odd_rows(spark, odd):
    """Repeated rows, ties, nulls and a single language; keeping passes clashing columns through."""
    one = spark.createDataFrame([(i % 3, "some words of one language here", "en") for i in range(30)] + [(None, "x y z", "fr"), (5, None, "fr"), (6, "more words", None)], "doc_id long, text string, lang string")
    model = language_id.fit(one, F.lit(True))
    assert model.languages == ("en",) and language_id.predict_texts(model, ["some words of one language here"])[0][0] == "en"
    again = language_id.fit(one.repartition(5), F.lit(True))
    assert np.array_equal(model.table, again.table) and model.threshold == again.threshold
    kept = language_id.keep_identified(odd.unionByName(odd), language_id.fit(odd, F.lit(True)))
    assert kept.columns == odd.columns and all(n % 2 == 0 for n in collections.Counter(map(repr, kept.collect())).values())


def test_language_learns_not_from_held_out_rows(spark, docs):
    swapped = docs.withColumn("lang", F.when(training_fold(), F.col("lang")).otherwise("xx")).withColumn("source", F.lit("z"))
    one, two = (language_id.fit(d, training_fold()) for d in (docs, swapped))
    assert one.languages == two.languages and np.array_equal(one.table, two.table)


# ---- exact dedup

def test_exact_as_sql(spark):
    assert spark_rows(op4_exact_dedup(spark, SMALL)) == duck_rows(connect(SMALL), EXACT)


@pytest.mark.parametrize("history", [None, F.lit, "half"])
def test_exact_odd_rows(odd, none, history):
    past = None if history is None else (F.col("doc_id") % 2 == 0 if history == "half" else F.lit(True))
    got = exact_dedup.mark(odd, past).collect()
    assert len(got) == odd.count()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in groups.values())
    assert {r.keep_id for r in groups[sha("")]} == {4} and {r.keep_id for r in groups[sha("The same text of ten words is here for all to see")]} == {2}
    assert exact_dedup.mark(none, past).count() == 0


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        digests = r.integers(0, 256, (n, 32), dtype=np.uint8)
        sizes, bits, slot = exact_dedup.build_mph(digests)
        assert sorted(slot.tolist()) == list(range(n))
        order = np.empty(n, dtype=np.int64)
        order[slot] = np.arange(n)
        zero = np.zeros(n, dtype="<i8").tobytes()
        shard = exact_dedup.Shard({"n": n, "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": digests[order].tobytes(), "has_id": np.ones(n, dtype=bool).tobytes(), "ids": zero, "seqs": zero, "counts": zero})
        assert np.array_equal(shard.lookup(digests), slot)
        assert (shard.lookup(r.integers(0, 256, (50, 32), dtype=np.uint8)) == -1).all()


# ---- mixing

def test_mixing_as_sql(spark):
    assert spark_rows(op5_mixing(spark, SMALL)) == duck_rows(connect(SMALL), MIXING)


def test_mixing_targets_and_order(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken <= 2 * r.size
        by[r.source].append(r)
    total = sum(r.size for r in got)
    for g in by.values():
        assert 0 <= g[0].target - sum(r.taken for r in g) < 1 and g[0].target <= 2 * g[0].source_size
    assert sum(g[0].target for g in by.values()) == pytest.approx(1.5 * total)
    places = [r.position for r in got]
    seen = [p for p in places if p is not None]
    assert seen == sorted(seen) and places[len(seen) :] == [None] * (len(places) - len(seen)) and all(0 <= p <= 1 for p in seen)
    assert mixing.mix(none).count() == 0


def test_targets_by_resharing(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 5000, "e": 0, None: 50}
    got = {r.source: r.target for r in mixing.target_shares(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2).collect()}
    weight = dict(zip(("a", "b", "c", "d", "e", None), (3, 1, 2, 3, 1, 2), strict=True))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}:
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
        left -= sum(2 * sizes[s] for s in over)
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert got == pytest.approx(want)


def test_schedule_integral_is_inverted(spark):
    knots = ((0.0, 2.0), (0.3, 0.5), (0.3001, 0.1), (1.0, 3.0))
    parts = spark.range(101).select((F.col("id") / 100).alias("done"))
    got = [r.p for r in parts.select(mixing.position(F.col("done"), F.lit(0), (knots,)).alias("p"), "done").orderBy("done").collect()]
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, *zip(*knots, strict=True))
    asked = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
    assert np.allclose(got, np.interp(np.arange(101) / 100 * asked[-1], asked, t), atol=1e-3)


def test_materialised_mix_has_the_taken_words(odd, none):
    plan = mixing.mix(odd).collect()
    got = mixing.materialise(odd)
    assert got.columns == odd.columns
    words = collections.Counter()
    for r in got.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    for s in {r.source for r in plan}:
        mine = [r for r in plan if r.source == s]
        more = words[s] - sum(r.taken for r in mine)  # the document on which the target falls comes whole
        assert -2 <= more <= max(r.size for r in mine) + 2
    assert mixing.materialise(none).count() == 0


# ---- hot keys

@pytest.mark.parametrize("nulls", [False, True])
def test_join_by_parts_is_a_join(spark, nulls):
    """A key with a third of all rows, many rare ones, absent ones and nulls, with and without a part for the rare."""
    keys = ["hot"] * 700 + [f"k{i % 400}" for i in range(1300)] + [None] * 50 + ["absent"] * 9
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, row long")
    counts = collections.Counter(k for k in keys if k != "absent")
    table = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()], "key string, n long, v string")
    want = collections.Counter(k for k in keys if k != "absent" and (nulls or k is not None))
    for parts in (3, 1000, 10**9):
        got = join_by_parts(rows, table, ("key",), "n", parts, nulls).collect()
        assert collections.Counter(r.key for r in got) == want and all(r.v == f"v{r.key}" and r.n == counts[r.key] for r in got)
    assert join_by_parts(rows, table.limit(0), ("key",), "n", nulls=nulls).count() == 0


# ---- lines

def lines_by_hand(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first, held = {}, collections.defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    held[key(line)].add(doc)
    first = {k: min(d) for k, d in held.items() if len(d) > 1}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (doc is not None and len(key(x)) >= 10 and first.get(key(x), doc) < doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(map(repr, out))


def test_lines_as_sql(spark):
    assert spark_rows(op7_line_dedup(spark, SMALL)) == duck_rows(connect(SMALL), LINES)


@pytest.mark.parametrize("batches", ["one", "two", "again"])
def test_lines_odd_rows(odd, none, batches):
    later = None if batches == "one" else F.col("doc_id") % 2 == 0
    again = F.col("doc_id") % 3 == 1 if batches == "again" else None
    want = lines_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    got = line_dedup.dedup_lines(odd, later=later, again=again).collect()
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in got) == want
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got) and line_dedup.dedup_lines(none, later=later, again=again).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    r = random.Random(2)
    keys = [r.getrandbits(64) for _ in range(3000)]
    f = line_dedup.CuckooFilter(2000)
    for k in keys[:2000]:
        f.insert(k)
    assert f.contains(np.array(keys[:2000], dtype=np.uint64)).all() and f.contains(np.array(keys[2000:], dtype=np.uint64)).mean() < 0.02
    assert all(f.delete(k) for k in keys[:1000])
    assert f.contains(np.array(keys[1000:2000], dtype=np.uint64)).all() and f.contains(np.array(keys[:1000], dtype=np.uint64)).mean() < 0.02
    small = line_dedup.CuckooFilter(1)
    for k in [keys[0]] * 30:  # more equal keys than two buckets hold
        small.insert(k)
    assert small.overflow and all(small.delete(keys[0]) for _ in range(30)) and not small.contains(np.array(keys[:1], dtype=np.uint64)).any()


def test_line_store_is_reversible(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=4)
    store.insert(make((1, "a line of words\nalone here now"), (2, "a line of words")))
    state = lambda: sorted((r.doc_id, len(r.lost)) for r in store.lost().collect())
    held = lambda: {r["shard"]: r["keys"] for r in store.filters.collect() if r["keys"]}
    before, filters = state(), held()
    assert before == [(2, 1)]
    assert store.insert(make((3, "a line of words\nalone here now"))) == 1
    assert state() == [(2, 1), (3, 2)]
    assert store.delete(make((3, ""))) == 1 and state() == before and held() == filters
    store.delete(make((1, "")))
    assert state() == []


def store_by_hand(docs, least=10):
    """Counts, first documents and lost keys of the documents (id to text) a store holds, by brute force."""
    held = collections.defaultdict(set)
    for doc, text in docs.items():
        for line in (text or "").encode().lower().split(b"\n"):
            if key := line_dedup.line_key(line, least):
                held[key].add(doc)
    lost = collections.defaultdict(set)
    for key, ids in held.items():
        for doc in ids - {min(ids)}:
            lost[doc].add(key)
    return {k: (len(d), min(d)) for k, d in held.items()}, dict(lost)


def check_store(store, docs):
    counts, lost = store_by_hand(docs)
    assert {bytes(r.key): (r.refs, r.first_doc) for r in store.counts().collect()} == counts
    assert {r.doc_id: {bytes(k) for k in r.lost} for r in store.lost().collect()} == lost
    filters = {r.shard: r for r in store.filters.collect()}
    assert sum(r["keys"] for r in filters.values()) == store.keys == len(counts) and store.repeated == sum(n > 1 for n, _ in counts.values())
    slots = 0
    for r in filters.values():
        cuckoo = line_dedup.CuckooFilter(0, r.table, tuple(r.overflow))
        slots += int((cuckoo.table > 0).sum()) + len(cuckoo.overflow)
    assert slots == len(counts)  # one fingerprint for each key, none left behind
    known = {bytes(r.key) for r in store._known(store.counts()).collect()}
    assert known == set(counts)


def test_line_store_as_brute_force(spark):
    """Random insertions, replacements and deletions against sets in memory; filters outgrow their first size."""
    r = random.Random(12)
    line = lambda: f"a line of number {r.choice([r.randrange(20), r.randrange(4000)])}"
    store, docs = line_dedup.LineStore(spark, shards=3, shard_keys=30, merge_after=4), {}
    sizes = set()
    for step in range(5):
        batch = {r.randrange(60 * (step + 1)): r.choice(["", None, *["\n".join(line() for _ in range(r.randrange(40))) for _ in range(4)]]) for _ in range(40)}
        store.insert(spark.createDataFrame([*batch.items(), (None, "a line without a document"), *list(batch.items())[:2]], "doc_id long, text string"))
        docs |= batch
        check_store(store, docs)
        sizes |= {len(x.table) for x in store.filters.collect()}
        gone = r.sample(sorted(docs), len(docs) // 4) + [10_000]
        store.delete(spark.createDataFrame([(i,) for i in [*gone, None, gone[0]]], "doc_id long"))
        docs = {i: t for i, t in docs.items() if i not in gone}
        check_store(store, docs)
    assert store.shards > 3 and len(sizes) > 1
    store.delete(spark.createDataFrame([(i,) for i in docs], "doc_id long"))
    check_store(store, {})


def test_line_store_takes_deletions_back(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=4)
    store.insert(make(*[(i, f"shared by all of us\nonly in {i} and so" + "\nshared by two of us" * (i < 12)) for i in range(10, 40)]))
    tables = lambda: (sorted(map(tuple, store.counts().collect())), {r.shard: (r["keys"], sorted(np.frombuffer(r.table, dtype="<u2"))) for r in store.filters.collect()}, sorted((r.doc_id, len(r.lost)) for r in store.lost().collect()))
    before = tables()
    batch = make(*[(i, f"shared by all of us\nalone with {i} for now\nonly in {i + 8} and so") for i in range(2, 6)])
    assert store.insert(batch) == 4 and tables() != before
    store.delete(batch)
    assert tables() == before
    empty = make().limit(0)
    assert store.insert(empty) == 0 and store.delete(empty) == 0 and tables() == before


# ---- quality

def quality_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen_at = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen_at[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_measures(docs, odd, none):
    for frame in (docs, odd):
        want = sorted((r.doc_id or -1, *quality_by_hand(r.text)) for r in frame.collect())
        got = quality.judge(frame).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(none).count() == 0


def test_quality_rejects_outliers_of_a_group(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(r.randint(20, 200))), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(word() + "***$$$" for _ in range(60)), "en", "s") for i in range(8)] + [(2000, " ".join(word() + "***" for _ in range(60)), "xx", "rare")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(8)) and not got[2000]  # its group of one is judged by all texts


def test_quality_rejects_by_lines_or_repeats_alone(spark):
    """Short lines that come again in another order, and a passage that comes twice: all else is as in the group."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(200)]
    menu = [f"{word()} {word()} {word()}" for _ in range(150)]
    listed = [x for _ in range(4) for x in r.sample(menu, 150)]
    passage = [word() for _ in range(9)]
    twice = [*passage, *(word() for _ in range(41)), *passage, *(word() for _ in range(41))]
    rows += [(1000, "\n".join(listed)), (1001, " ".join(twice))]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")).collect()}
    assert got[1000].n_dup_lines == 450 and got[1001].n_repeat_words == 18 and not got[1000].base_failed and not got[1001].base_failed
    assert not got[1000].kept and not got[1001].kept and sum(got[i].kept for i in range(200)) >= 199


def test_quality_query_judges_small_groups(spark, tmp_path):
    """Groups under the least size are judged by their language, or by all texts where that is small too."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(100))
    junk = lambda: " ".join(word() + "***" for _ in range(60))
    rows = [(i, prose(), "en", f"s{i % 20}") for i in range(200)] + [(300 + i, prose(), None if i % 2 else "xx", None) for i in range(6)]
    rows += [(1000, junk(), "en", "s1"), (1001, junk(), "xx", "rare"), (1002, junk(), None, None), (2000, "few words", "yy", "rare")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op9_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(x.distance2 is not None for x in got.values())
    assert not any(got[i].kept for i in (1000, 1001, 1002)) and got[2000].base_failed
    assert sum(got[i].kept for i in range(200)) >= 199 and all(got[300 + i].kept for i in range(6))


def test_concentration_finds_the_bulk(spark):
    r = np.random.default_rng(5)
    x = np.concatenate((r.normal(0, 0.5, (600, 5)), r.normal(6, 0.2, (120, 5))))
    rows = [("en", "s", *[int(v) for v in np.rint(v5 * 10_000)]) for v5 in x]
    fit = quality.concentrate(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{v} long" for v in quality.VECTOR)), floors=(0.01,) * 5).collect()[0]
    assert np.abs(fit["mean"]).max() < 0.15 and fit["n"] >= 0.75 * 720
    spread = np.linalg.inv(np.array(fit["inverse"]).reshape(5, 5))
    assert np.allclose(np.diag(spread), 0.25, rtol=0.5)


def quality_kept_by_hand(frame, cut_off=1e-4, share=0.75, least=30, floors=quality.FLOORS):
    """doc_id and verdict of every row, with all vectors of a group in memory."""
    rows = quality.statistics(frame).collect()
    vector = np.array([[r[v] for v in quality.VECTOR] for r in rows], dtype=float).reshape(-1, 5) / 10_000
    sound = np.array([not r.base_failed for r in rows], dtype=bool)
    own, lang = [(r.lang, r.source) for r in rows], [r.lang for r in rows]

    def estimate(mine):
        x = vector[mine & sound]
        middle = np.median(x, axis=0)
        spread = np.sqrt((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2 + np.square(floors))
        z = (x - middle) / spread
        unit, bent = np.rint(z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None] * 1e4) / 1e4, np.rint(np.tanh(z) * 1e4) / 1e4
        cover = lambda a: a.T @ a / len(a) - np.outer(a.mean(axis=0), a.mean(axis=0))
        scale = np.sqrt(np.maximum(np.diag(cover(bent)), 1e-12))
        like = cover(bent) / np.outer(scale, scale)
        np.fill_diagonal(like, 1)
        wide = np.diag(np.square(floors))
        best = (np.inf, None)
        for mean, scatter in ((middle, np.diag(spread**2)), (x.mean(axis=0), cover(x)), (middle, 5 * unit.T @ unit / len(x) * np.outer(spread, spread)), (middle, like * np.outer(spread, spread))):
            inverse, at = np.linalg.inv(scatter + wide), np.inf
            while True:
                bins = np.floor(np.log2(np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean) + 1e-3) * 32)
                before = np.array([(bins < b).sum() for b in bins])
                near = x[before < share * len(x)]
                scatter = cover(near) * quality._consistency(share) + wide
                if not np.linalg.slogdet(scatter)[1] < at - 1e-4:
                    break
                at, mean, inverse = np.linalg.slogdet(scatter)[1], near.mean(axis=0), np.linalg.inv(scatter)
            if at < best[0]:
                best = (at, (mean, inverse))
        return best[1]

    known, out = {}, []
    for i, r in enumerate(rows):
        same = np.array([o == own[i] for o in own])
        if (same & sound).sum() < least:
            same = np.array([x == lang[i] for x in lang])
            if (same & sound).sum() < least:
                same = np.ones(len(rows), dtype=bool)
        if (name := same.tobytes()) not in known:
            known[name] = estimate(same)
        mean, inverse = known[name]
        out.append((r.doc_id or -1, bool(sound[i] and (vector[i] - mean) @ inverse @ (vector[i] - mean) <= quality._quantile5(1 - cut_off))))
    return sorted(out)


def test_quality_kept_as_brute_force(spark, docs, odd):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    made = [(i, " ".join(word() + r.choice(["", "", ".", "##"]) * (i % 9 == 0) for _ in range(r.randint(8, 90))), r.choice(["en", "en", "xx", None]), r.choice(["a", "a", "a", "b", None])) for i in range(300)]
    for frame in (docs, odd, spark.createDataFrame(made, "doc_id long, text string, lang string, source string")):
        want = quality_kept_by_hand(frame)
        assert sorted((x.doc_id or -1, x.kept) for x in quality.judge(frame).collect()) == want
        assert len({k for _, k in want}) == 2


def test_least_determinant_of_several_starts(spark):
    """A far, tight cloud that holds most texts of one axis' median: starts differ, the least determinant wins."""
    r = np.random.default_rng(6)
    x = np.concatenate((r.normal(0, 1, (560, 5)) * (1, 1, 1, 1, 0.2), r.normal((0, 0, 0, 0, 9), 0.3, (190, 5))))
    rows = [("en", "s", *[int(v) for v in np.rint(v5 * 10_000)]) for v5 in x]
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{v} long" for v in quality.VECTOR))
    fit = quality.concentrate(frame, share=0.7, floors=(0.01,) * 5).collect()[0]
    assert np.abs(fit["mean"]).max() < 0.3 and np.sqrt(np.linalg.inv(np.array(fit["inverse"]).reshape(5, 5))[4, 4]) < 0.4


# ---- near dedup

def bag(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def groups_by_hand(rows, threshold=0.8):
    """Indices of the rows of each class."""
    ids, bags = [r[0] for r in rows], [bag(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or a and b and (c := sum((a & b).values())) >= threshold * (sum(a.values()) + sum(b.values()) - c):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return list(groups.values())


def classes_by_hand(rows, threshold=0.8):
    groups = [[rows[i][0] for i in g] for g in groups_by_hand(rows, threshold)]
    least = lambda g: min((x for x in g if x is not None), default=None)
    return sorted((str(i), str(least(g)), len(g)) for g in groups for i in g)


def test_near_as_brute_force(docs, odd, none, rows):
    for frame in (docs, odd):
        got = near_dedup.classes(frame).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == classes_by_hand([(r.doc_id, r.text) for r in frame.collect()])
        kept = collections.Counter(r.class_id for r in got if r.kept)
        assert set(kept.values()) == {1} or None in kept
    assert near_dedup.classes(none).count() == 0


def test_near_finds_links_among_strays(spark):
    """A bucket whose first text is close to some only: the others' links are found by the second pass."""
    r = random.Random(7)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randint(0, 7)):
            words[r.randrange(len(words))] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classes(frame).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.class_size) for x in got) == classes_by_hand(rows)


def test_bag_minhash_is_unbiased_for_weights():
    a, b = np.array([1, 3, 9, 2, 40, 1]), np.array([1, 5, 4, 0, 33, 7])
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for rep in range(60):
        value = np.array([hash((rep, i)) & (2**64 - 1) for i in range(6)], dtype=np.uint64)
        of, w, v = np.array([0] * 6 + [1] * 6), np.concatenate((a, b)), np.concatenate((value, value))
        s = near_dedup.bag_minhash(of[w > 0], v[w > 0], w[w > 0], 2, 128)
        assert (s != 0).all()
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - truth) < 4 * np.std(found) / 60**0.5 + 1e-3


def test_shingles_of_short_and_odd_texts():
    of, value, weight = near_dedup.shingles(WordHasher(), [b"", b"a b", b"A  B", b"b a", b"x y z u v x y z u v x y z u v"])
    bags = [(value[of == i], weight[of == i]) for i in range(5)]
    assert not len(bags[0][0]) and bags[1][0][0] == bags[2][0][0] != bags[3][0][0] and bags[4][1].sum() == 11 and bags[4][1].max() == 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
