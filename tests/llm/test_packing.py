"""Packing: every id in exactly one piece, sequences without gaps, little padding; ids against the library."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing
from lectern.llm.queries import op12_packing, tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def holds(rows, texts, library, capacity=2048):
    """Whether ``rows`` are a packing of ``texts`` by doc_id (texts are a list each)."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want, got = collections.Counter(), collections.Counter()
    for doc, mine in texts.items():
        for text in mine:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            want.update((doc, a, min(capacity, len(ids) - a), zlib.crc32(np.array(ids[a : a + capacity], dtype="<u4").tobytes()), len(ids)) for a in range(0, len(ids), capacity))
    got.update((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == want
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    used = [sum(r.length for r in mine) for mine in by_sequence.values()]
    return sum(capacity - u for u in used if u & (u - 1)) / sum(used) if used else 0.0


def test_op12_as_the_library(spark, library, rows):
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert holds(op12_packing(spark, SMALL).collect(), texts, library) < 0.02


def test_packing_odd_rows(odd, none, library):
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    holds(packing.pack(odd, tokenizer_path()).collect(), texts, library)
    holds(packing.pack(odd, tokenizer_path(), 64).collect(), texts, library, 64)
    assert packing.pack(none, tokenizer_path()).count() == 0


_CHARS = st.text(st.sampled_from("aBé ü'sS\n\t\x1c\x85\xa0 　漢Σς1,.<|endoftext|>́\x00"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(_CHARS)
def test_chunks_as_the_whole_text(library, text):
    got = np.frombuffer(packing._encoder(tokenizer_path()).ids(text), dtype="<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_distinct_chunks_of_a_batch_in_one_call(library, monkeypatch):
    encoder, calls = packing.ChunkEncoder(tokenizer_path(), 50), []
    pieces, odd = encoder.pieces, encoder._odd_chunk
    monkeypatch.setattr(encoder, "pieces", lambda words: calls.append(words) or pieces(words))
    monkeypatch.setattr(encoder, "_odd_chunk", lambda chunk: calls.append(chunk) or odd(chunk))
    r = random.Random(3)
    names = ["".join(r.choices("abcdefgé,.'S1", k=r.randint(1, 90))) for _ in range(3000)]
    strange = ["漢字ΣΑΣ", "a\x1fb", "<|endoftext|>x", "e\u0301"]
    texts = [" ".join(r.choices(names, k=400) + strange) + "\n" for _ in range(50)] + ["", " ", "\x00"]
    ids, counts = encoder.batch(pa.array(texts))
    assert [x for text in texts for x in library.encode(text, add_special_tokens=False).ids] == ids.tolist()
    assert counts.tolist() == [len(library.encode(text, add_special_tokens=False).ids) for text in texts]
    distinct = {chunk for text in texts for chunk in re.split("[ \n]+", text)}
    assert sorted(calls[:-1]) == sorted(strange) and calls[-1].count("\n") == len(distinct)
    assert [len(x) for x in encoder.batch(pa.array([], pa.string()))] == [0, 0]
    part = encoder.batch(pa.array(texts, pa.large_string())[10:20])
    assert part[1].tolist() == counts[10:20].tolist() and part[0].tolist() == ids[counts[:10].sum() : counts[:20].sum()].tolist()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_patterns_hold_all_pieces(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed = collections.Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(n * times for n, times in pattern) <= 64
        for n, times in pattern:
            placed[n] += count * times
    assert placed == counts
    table = packing.places(patterns)
    seen = set()
    for n, first, packs, sequence, offset in table.tolist():
        assert first == 0 or any(x[0] == n for x in table.tolist())
        seen.add((n, first))
    assert len(seen) == len(table)


def test_patterns_are_full_where_lengths_allow():
    r = random.Random(5)
    counts = collections.Counter(r.randint(1, 2048) for _ in range(5000))
    patterns = packing.pack_histogram(counts)
    packs, total = sum(n for n, _ in patterns), sum(n * c for n, c in counts.items())
    assert packs * 2048 < 1.02 * total
    assert packing.pack_histogram({100: 1000}) == [(50, ((100, 20),))]
