"""Alignment of two tokenizers against loops over the libraries' own tokens of whole texts."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import alignment
from lectern.llm.packing import byte_alphabet
from lectern.llm.queries import op11_alignment, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(PATHS[0])
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def sides(text, libraries):
    left, right = libraries
    byte_of = byte_alphabet()
    a = left.encode(" " + text, add_special_tokens=False).ids if text else []
    b = right.encode(text) if text else []
    raw = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
    other = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [right.id_to_piece(i)]]
    if not text or not b"".join(raw) == b"".join(other) == (" " + text).encode():
        return [], [], [], []
    return a, raw, b, other


def groups_by_hand(text, libraries):
    a, raw, b, other = sides(text or "", libraries)
    out, i, j, x, y, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(raw[i])
            left.append(a[i])
            i += 1
        else:
            y += len(other[j])
            right.append(b[j])
            j += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out


def by_hand(rows, libraries):
    groups = [groups_by_hand(r.text, libraries) for r in rows]
    links = [collections.Counter((p, q) for a, b in g for p in a for q in b) for g in groups]
    docs = collections.Counter(pair for mine in links for pair in mine)
    best = collections.defaultdict(int)
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    out = []
    for r, g, mine in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((r.doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(mine.values()), sum(n for p, n in mine.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in mine.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def test_op11_as_brute_force(spark, rows, libraries):
    assert sorted(map(tuple, op11_alignment(spark, SMALL).collect()), key=repr) == by_hand(rows, libraries)


@pytest.mark.parametrize("known", [0, 3, 500])
def test_alignment_of_odd_rows(spark, odd, none, libraries, known):
    more = spark.createDataFrame([(31, "a ▁ b"), (32, "  two  spaces \n\n and\tmore "), (33, " "), (34, "\n"), (35, "<s> </s> <unk> <0x41> <|endoftext|>"), (36, "x" * 300 + "é漢" * 50), (37, "don't 12345 'll ñandú")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").filter("length(text) < 1000 or text is null").union(more)
    got = alignment.align(docs, *PATHS, known=known)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == by_hand(docs.collect(), libraries)
    assert alignment.align(none, *PATHS, known=known).count() == 0
    r = next(r for r in got.collect() if r.doc_id == 37)
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '1.,é漢▁<>s|\n\t\r\x1c\x85\xa0　\x00"), max_size=25))
def test_fragments_are_tokenised_like_the_text(libraries, text):
    tokenizers = alignment._tokenizers(*PATHS)
    keys = alignment.fragment_keys(text) if text else []
    assert "".join(map(alignment.fragment, keys)) == (f" {text}" if text else "")
    ids, begins, good = tokenizers.of(keys)
    a, _, b, _ = sides(text, libraries)
    assert (bool(keys) and bool(good.all())) == bool(a)
    if a:
        assert ids[0].tolist() == a and ids[1].tolist() == b and begins[0][-1] == len(a)


def test_sums_of_pairs_are_exact_in_little_memory():
    rng, seen, got = np.random.default_rng(1), collections.Counter(), collections.Counter()
    tracemalloc.start()
    held, peak = alignment.Tally(), 0
    for at in range(48):
        pair = np.unique(np.concatenate((np.arange(100), rng.integers(1 << 40, size=60_000))))
        docs = rng.integers(1, 9, size=len(pair))
        tracemalloc.reset_peak()
        found = [*held.add(pair, docs), *(held.rest() if at == 47 else ())]
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        for counts, x in [(seen, (pair, docs)), *((got, (b.column("pair").to_numpy(), b.column("docs").to_numpy())) for b in found)]:
            counts["docs"] += int(x[1].sum())
            counts["weighed"] += int((x[0] % 1009 * x[1]).sum())
            for i in range(100):
                counts[i] += int(x[1][x[0] == i].sum())
    tracemalloc.stop()
    assert got == seen
    assert peak < 64 << 20


def test_steps_are_sent_only_what_they_use(spark, docs, monkeypatch):
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda _, value: sent.append(value) or broadcast(value))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)  # rows made by Python would start further workers
    alignment.align(docs, *PATHS, known=500).write.format("noop").mode("overwrite").save()
    assert not any(isinstance(x, alignment.Known) for x in sent)
    assert [type(x) for x in sent if isinstance(x, dict | list)] == [dict, list]  # keys, then written groups
