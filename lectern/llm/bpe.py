"""Operator 2: BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a cut between
its bytes is certain.  Words are cut at all such pairs, the fragments are encoded independently (and
remembered, as they repeat far more than whole words do), and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text

#: Code points whose normal form, lower case and class are beyond doubt: ASCII and the letters of Latin-1.
PLAIN = re.compile("[\\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: White space that str.split() takes for a gap; only the ASCII part surely is one for a tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ASCII_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
#: The file's own word pattern over plain text, used when the file has it.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d\x1c-\x20a-z\xdf-\xf6\xf8-\xff0-9]+")


class Recent(dict):
    """A memory of two generations: what was used since the last full one survives the next."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def recall(self, key):
        if (known := self.old.get(key)) is not None:
            self[key] = known
        return known

    def keep(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encodes as the tokenizer file at ``path`` says, without special tokens being added.

    The file's own normaliser and pre-tokeniser turn each white-space separated chunk into words;
    merging is done here.  ``cache_size`` bounds the words that each generation of a worker's memory holds.
    """

    def __init__(self, path: str, cache_size: int = 200_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.pre_tokenise = library.pre_tokenizer.pre_tokenize_str
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        added = [(a["content"], a["id"]) for a in spec["added_tokens"]]
        self.added = dict(added)
        self.split_added = re.compile("(" + "|".join(re.escape(a) for a, _ in sorted(added, key=lambda x: -len(x[0]))) + ")") if added else None
        self.tokens = {i: t for t, i in [*self.vocab.items(), *added]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.first_ranks = {a + b: i for (a, b), i in self.ranks.items() if len(a) == len(b) == 1}
        self.inside, self.inside_end = self._inner_pairs()
        # Plain text needs no call of the library, if the file lower-cases and splits as expected.
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and splits == [_WORDS, None]
        self.to_bytes = {c: self.pre_tokenise(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]} | {c: w[0][0] for c in range(0x80) if (w := self.pre_tokenise(chr(c)))}
        self.words = Recent(cache_size)
        self.fragments = Recent(cache_size // 5)
        self.decimal = {i: str(i) for i in self.tokens}

    def _inner_pairs(self) -> tuple[set[str], set[str]]:
        """Adjacent symbols within some token, as text: those inside a word, and those whose second ends it."""
        found: set[str] = set()
        ending: set[str] = set()
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            symbols = token.removesuffix(self.suffix) if ends else token
            pairs = list(map(add, symbols, symbols[1:]))
            if ends and pairs:
                ending.add(pairs.pop())
            found.update(pairs)
        return found, ending if self.suffix else found

    def cut(self, word: str) -> list[tuple[str, bool]]:
        """The fragments between forced boundaries; true for the one that ends the word."""
        n = len(word)
        joined = list(map(self.inside.__contains__, map(add, word, word[1:-1])))
        if n > 1:
            joined.append(word[-2:] in self.inside_end)
        if False not in joined:
            return [(word, True)]
        cuts = [i for i, together in enumerate(joined, 1) if not together]
        return [*((word[a:b], False) for a, b in zip([0, *cuts], cuts, strict=False)), (word[cuts[-1] :], True)]

    def _merge(self, text: str, last: bool) -> list[str]:
        """Merge by lowest rank, leftmost first; long fragments over a linked list and a heap."""
        symbols = list(text)
        if last and self.suffix:
            symbols[-1] += self.suffix
        if len(symbols) <= 32:
            rank_of, none = self.ranks.get, 1 << 60
            ranked = list(map(self.first_ranks.get, map(add, text, text[1:]), repeat(none)))
            if last and self.suffix and ranked:
                ranked[-1] = rank_of((symbols[-2], symbols[-1]), none)
            while ranked and (best := min(ranked)) < none:
                i = ranked.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del ranked[i]
                if i < len(ranked):
                    ranked[i] = rank_of((symbols[i], symbols[i + 1]), none)
                if i:
                    ranked[i - 1] = rank_of((symbols[i - 1], symbols[i]), none)
            return symbols
        n, ranks = len(symbols), self.ranks
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        current: list[str | None] = list(symbols)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i] if current[i] == a else n
            if j >= n or current[j] != b:
                continue
            current[i], current[j] = a + b, None
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            for k in (before[i], i):
                if k >= 0 and following[k] < n and (p := (current[k], current[following[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, *p))
        return [s for s in current if s is not None]

    def encode_fragment(self, fragment: tuple[str, bool]) -> list[int]:
        memory = self.fragments
        if (known := memory.get(fragment) or memory.recall(fragment)) is None:
            known = [self.vocab[s] for s in self._merge(*fragment) if s in self.vocab]
            if len(fragment[0]) <= 64:
                memory.keep(fragment, known)
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word in the alphabet of bytes."""
        fragments = self.cut(word)
        return self.encode_fragment(fragments[0]) if len(fragments) == 1 else [i for fragment in fragments for i in self.encode_fragment(fragment)]

    def _plain_text(self, text: str) -> list[list[int]]:
        memory, words = self.words, PLAIN_WORDS.findall(text.lower())
        found = list(map(memory.get, words))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    word = words[i]
                    if (known := memory.get(word) or memory.recall(word)) is None:
                        known = self.encode_word(word.translate(self.to_bytes))
                        if len(word) <= 64:
                            memory.keep(word, known)
                    found[i] = known
        return found

    def _any_text(self, text: str) -> list[list[int]]:
        out: list[list[int]] = []
        for chunk in ASCII_SPACE.split(text) if ODD_SPACE.search(text) else text.split():
            for piece in self.split_added.split(chunk) if self.split_added else [chunk]:
                if piece in self.added:
                    out.append([self.added[piece]])
                elif piece and self.plain and PLAIN.fullmatch(piece) and not ODD_SPACE.search(piece):
                    out += self._plain_text(piece)
                elif piece:
                    out += [self.encode_word(word) for word, _ in self.pre_tokenise(self.normalise(piece)) if word]
        return out

    def encode_text(self, text: str | None) -> tuple[str, list[int]]:
        """The ids of a text, in decimal joined by spaces and as numbers."""
        text = text or ""
        simple = self.plain and PLAIN.fullmatch(text) and not ODD_SPACE.search(text) and not (self.split_added and self.split_added.search(text))
        ids = list(chain.from_iterable(self._plain_text(text) if simple else self._any_text(text)))
        return " ".join(map(self.decimal.__getitem__, ids)), ids

    def encode(self, text: str | None) -> list[int]:
        return self.encode_text(text)[1]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (array), decoded, and the digests of both.

    Null texts count as empty: no tokens, an empty decoded text.  Repeated rows give repeated rows, an
    empty table an empty one; further columns are not read.  The tokenizer file must be readable at
    ``path`` on every executor.  ``texts=False`` leaves out ids and decoded.  A narrow operation:
    no shuffle, and memory bounded by an Arrow batch, its output and two caches of fixed size.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                written, ids = bpe.encode_text(text)
                decoded = bpe.decode(ids)
                digests = hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                rows.append((len(ids), *digests, *((ids, decoded) if texts else ())))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])]
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    slim = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return id_back(slim.mapInPandas(work, schema))
