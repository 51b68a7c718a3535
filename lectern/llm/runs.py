"""Operator 13: maximal runs of consecutive repetition over words, by the linear tandem-repeat method.

A text's words become numbers.  The blocks of the Lempel-Ziv factorisation give squares among which is,
for every square, one that begins at or left of its first occurrence and reaches it by rotation; they
are marked in the suffix tree from below; walks over suffix links rotate the marked squares until the
vocabulary of all squares is marked.  The leaves under a marked place are where its square occurs, and
consecutive occurrences of a primitive square's period are a run.

Only stretches that may hold a run of the wanted kind get a suffix tree: in a run of at least six words
and four periods each window of four words comes again within the period, so a window whose nearest
equal window lies further off than a quarter of its stretch is in none.  Windows are compared by hashes
(equal hashes of different windows only leave a stretch in), the words of a stretch as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, chunks_of, id_back, id_text, text_of, window_hashes

LEAST, TIMES = 6, 4
_CHUNK = 1 << 18
_WINDOW = 4


class Factors:
    """Ranks of all substrings of lengths that are powers of two, for extensions of any two places at once."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = n = len(codes)
        self.levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while self.levels[-1].max(initial=0) + 1 < n and width < n:
            last = self.levels[-1]
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = last[width:] + 1
            self.levels.append(np.unique(last * (n + 1) + after, return_inverse=True)[1])
            width *= 2
        self.order = np.argsort(self.levels[-1], kind="stable")

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right from ``a`` and ``b``, a < b <= n, each."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            width, rank = 1 << level, self.levels[level]
            for _ in range(1 if level < len(self.levels) - 1 else self.n // width + 1):
                go = np.flatnonzero(np.maximum(a, b) + width <= self.n)
                go = go[rank[a[go]] == rank[b[go]]]
                if not len(go):
                    break
                a[go] += width
                b[go] += width
                length[go] += width
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the left that ends before ``a`` and ``b``."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            width, rank = 1 << level, self.levels[level]
            for _ in range(1 if level < len(self.levels) - 1 else self.n // width + 1):
                go = np.flatnonzero(np.minimum(a, b) >= width)
                go = go[rank[a[go] - width] == rank[b[go] - width]]
                if not len(go):
                    break
                a[go] -= width
                b[go] -= width
                length[go] += width
        return length


class SuffixTree:
    """The suffix tree of ``codes`` and an end mark, from the sorted suffixes and their common prefixes.

    Node 0 is the root; leaves are nodes like others, their depth counts the end mark.  ``low`` and
    ``high`` bound a node's leaves in ``order``, ``first`` is its leftmost leaf.
    """

    def __init__(self, codes: np.ndarray, factors: Factors) -> None:
        self.n = n = len(codes)
        self.codes = [*codes.tolist(), -1]
        self.order = order = [n, *factors.order.tolist()]
        common = [0, 0, *factors.ahead(factors.order[:-1], factors.order[1:]).tolist()]
        parent, depth, low, high = [0], [0], [0], [n]
        stack = [0]
        for i, start in enumerate(order):
            shared, last = common[i], -1
            while depth[stack[-1]] > shared:
                last = stack.pop()
                high[last] = i - 1
                if depth[stack[-1]] < shared:  # an edge ends here: a node between
                    parent.append(stack[-1])
                    depth.append(shared)
                    low.append(low[last])
                    high.append(0)
                    parent[last] = len(parent) - 1
                    stack.append(len(parent) - 1)
                    break
            parent.append(stack[-1])
            depth.append(n - start + 1)
            low.append(i)
            high.append(i)
            stack.append(len(parent) - 1)
        while len(stack) > 1:
            high[stack.pop()] = n
        self.parent, self.depth, self.low, self.high = parent, depth, low, high
        self.child = {(parent[v], self.codes[order[low[v]] + depth[parent[v]]]): v for v in range(1, len(parent))}
        self.downwards = np.argsort(np.array(depth), kind="stable").tolist()
        self.first = [order[x] for x in low]
        for v in reversed(self.downwards):
            if v and self.first[v] < self.first[parent[v]]:
                self.first[parent[v]] = self.first[v]
        self.link = [0] * len(parent)
        for v in self.downwards[1:]:
            if low[v] < high[v]:
                self.link[v] = self.descend(self.link[parent[v]], order[low[v]] + 1, depth[v] - 1)

    def descend(self, node: int, start: int, length: int) -> int:
        """The first node at depth ``length`` or more on the way from ``node`` down the suffix at ``start``."""
        depth, child, codes = self.depth, self.child, self.codes
        while depth[node] < length:
            node = child[node, codes[start + depth[node]]]
        return node


def blocks(tree: SuffixTree) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end: each the longest that begins further left too, or a new word."""
    out, i = [], 0
    while i < tree.n:
        out.append(i)
        node = 0
        while (below := tree.child[node, tree.codes[i + tree.depth[node]]]) and tree.first[below] < i:
            node = below
        i += max(1, tree.depth[node])
    return [*out, tree.n]


def covering_squares(starts: list[int], factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover from the left the first occurrences of all."""
    first, middle, last = (np.array(x, dtype=np.int64) for x in (starts[:-1], starts[1:], [*starts[2:], starts[-1]]))
    length = middle - first

    def each(sizes):
        which = np.repeat(np.arange(len(sizes)), sizes)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1

    # The centre lies in the block: periods up to its length against the place where the next block begins.
    which, k = each(length)
    one, two = middle[which] - k, middle[which]
    right, left = factors.ahead(one, two), factors.behind(one, two)
    ok = (right + left >= k) & (right > 0)
    start = np.maximum(one - left, one - k + 1)[ok]
    period = k[ok]
    # The centre lies behind the block's begin: periods up to its and the next one's length.
    which, k = each(last - first)
    one, two = first[which], first[which] + k
    inside = two < factors.n
    which, k, one, two = which[inside], k[inside], one[inside], two[inside]
    right, left = factors.ahead(one, two), factors.behind(one, two)
    begin = np.maximum(one - left, one - k + 1)
    ok = (right + left >= k) & (right > 0) & (left > 0) & (begin + k <= middle[which])
    return np.concatenate([start, begin[ok]]), np.concatenate([period, k[ok]])


def vocabulary(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> tuple[list[int], list[int]]:
    """Node (at whose edge or end the square ends) and length of every different square."""
    waiting: list[list[int]] = [[] for _ in range(tree.n + 1)]
    for i, k in sorted(set(zip(starts.tolist(), periods.tolist(), strict=True))):
        waiting[i].append(2 * k)
    marked: list[tuple[int, int]] = []
    for v in reversed(tree.downwards[1:]):  # from below; a node has the list of its leftmost leaf
        mine, above = waiting[tree.first[v]], tree.depth[tree.parent[v]]
        while mine and mine[-1] > above:
            marked.append((v, mine.pop()))
    seen = set(marked)
    for v, length in marked:
        while True:
            begin = tree.order[tree.low[v]]
            if length < tree.depth[v]:
                if tree.codes[begin + length] != tree.codes[begin]:
                    break
            else:
                below = tree.child.get((v, tree.codes[begin]))
                if below is None:
                    break
                begin = tree.order[tree.low[below]]
            v = tree.descend(tree.link[tree.parent[v]], begin + 1, length)
            if (v, length) in seen:
                break
            seen.add((v, length))
    return [v for v, _ in seen], [length for _, length in seen]


def _primitive(factors: Factors, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the first half of the square at ``start`` is no repetition itself."""
    ok, rest = np.ones(len(start), dtype=bool), period.copy()
    least = np.arange(period.max(initial=1) + 1)  # smallest prime factors
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, len(least), p)] = p
    while len(more := np.flatnonzero(rest > 1)):
        prime = least[rest[more]]
        step = period[more] // prime
        ok[more] &= factors.ahead(start[more], start[more] + step) < period[more] - step
        while len(again := np.flatnonzero(rest[more] % prime == 0)):
            rest[more[again]] //= prime[again]
            more, prime = more[again], prime[again]
    return ok


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Start, length and period of the runs of ``codes`` of at least ``least`` items and ``times`` periods (two or more)."""
    if len(codes) < max(least, times):
        return np.zeros((0, 3), dtype=np.int64)
    factors = Factors(codes)
    tree = SuffixTree(factors.levels[0], factors)
    node, length = (np.array(x, dtype=np.int64) for x in vocabulary(tree, *covering_squares(blocks(tree), factors)))
    order, low, high = (np.array(x, dtype=np.int64) for x in (tree.order, tree.low, tree.high))
    primitive = _primitive(factors, order[low[node]], length // 2)
    node, period = node[primitive], length[primitive] // 2
    many = high[node] - low[node] + 1
    at = np.repeat(low[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    start, period = order[at], np.repeat(period, many)
    ranked = np.lexsort((start, period))
    start, period = start[ranked], period[ranked]
    begins = np.ones(len(start), dtype=bool)
    begins[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(begins)
    ends = np.append(begin[1:], len(start)) - 1
    found = np.stack([start[begin], start[ends] + 2 * period[ends] - start[begin], period[begin]], axis=1) if len(start) else np.zeros((0, 3), dtype=np.int64)
    return found[found[:, 1] >= np.maximum(least, times * found[:, 2])]


def stretches(hashes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, each of one text, outside of which no run of six words and four periods can lie."""
    windows = window_hashes(hashes, _WINDOW)
    n = len(windows)
    if not n:
        return []
    ranked = np.lexsort((np.arange(n), windows, owner[:n]))
    same = (windows[ranked[1:]] == windows[ranked[:-1]]) & (owner[ranked[1:]] == owner[ranked[:-1]])
    far = len(hashes) + 1
    gap = np.where(same, ranked[1:] - ranked[:-1], far)
    nearest = np.full(n, far)
    nearest[ranked[1:]] = gap
    nearest[ranked[:-1]] = np.minimum(nearest[ranked[:-1]], gap)
    left = np.flatnonzero((nearest < far) & (owner[:n] == owner[_WINDOW - 1 :]))
    while len(left):
        # Windows that overlap or touch are a stretch; one longer than a quarter of it from its like leaves it.
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(left) > _WINDOW) | (owner[left[1:]] != owner[left[:-1]]))))
        lasts = np.append(begins[1:], len(left)) - 1
        size = left[lasts] + _WINDOW - left[begins]
        stay = nearest[left] * TIMES <= np.repeat(size, lasts - begins + 1)
        if stay.all():
            return [(a, b) for a, b in zip(left[begins].tolist(), (left[lasts] + _WINDOW).tolist(), strict=True) if b - a >= LEAST]
        left = left[stay]
    return []


def looped(words: list[bytes], h: int) -> list[bytes]:
    """``words`` with the end replaced by repetitions of a part of it, as the number ``h`` says."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def summary(words: list[bytes], found: np.ndarray) -> tuple:
    """The columns of :func:`periodic_runs` for the words of a text and its runs."""
    found = found[np.lexsort((found[:, 2], found[:, 0]))].tolist()
    best, gone = None, []
    for start, length, period in found:
        gone.append((start + period, start + length))
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    kept, at = [], 0
    for a, b in sorted(gone):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    kept += words[at:]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), b" ".join(kept), listed


def periodic_runs(docs: DataFrame, *, loop: Column | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, and (``texts``) runs and collapsed.

    Words are parted by white space and numbered from 0.  A run is a stretch of at least six words and
    four times its smallest period that no neighbouring word goes on with; start, length, period and
    exponent (in thousandths, rounded down) are those of the run of the greatest length over period,
    of ties the one of smallest start, then period; null without a run.  collapsed has the words that no
    run contains after its first period.  ``loop`` is a number for each row by which the end of its text
    is made to repeat (:func:`looped`), null for none.  Null and empty texts have no words, hence no run;
    texts of any length are taken whole; repeated rows give repeated rows, an empty table an empty one;
    further columns are not read.  No shuffle; memory goes with the longest text.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            split = [text.encode().split() for text in batch["text"]]
            split = [looped(words, int(h)) if h % 10 == 0 else words for words, h in zip(split, batch["loop"], strict=True)]
            plain = [b" ".join(words) for words in split]
            rows = []
            for a, b in chunks_of([len(x) for x in plain], _CHUNK):
                hashes, owner, *_ = hasher.words(plain[a:b])
                begins = np.searchsorted(owner, np.arange(b - a))
                found: dict[int, list[np.ndarray]] = {}
                for one, two in stretches(hashes, owner):
                    i = int(owner[one])
                    number: dict[bytes, int] = {}
                    offset = one - int(begins[i])
                    codes = np.array([number.setdefault(w, len(number)) for w in split[a + i][offset : offset + two - one]])
                    runs = runs_of(codes)
                    runs[:, 0] += offset
                    found.setdefault(i, []).append(runs)
                for i in range(a, b):
                    mine = np.concatenate(found[i - a]) if i - a in found else np.zeros((0, 3), dtype=np.int64)
                    if len(mine):
                        *columns, kept, listed = summary(split[i], mine)
                    else:
                        columns, kept, listed = [0, None, None, None, None, _EMPTY], plain[i], ""
                    rows.append((*columns, hashlib.sha256(kept).hexdigest(), *((listed, kept.decode()) if texts else ())))
            names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if texts else [])]
            out = pd.DataFrame(rows, columns=names).astype({x: "Int64" for x in ("n_runs", "start", "length", "period", "exponent_milli")})
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), out], axis=1)

    number = F.lit(1) if loop is None else F.coalesce(loop, F.lit(1))
    slim = docs.select(id_text(id_col), text_of(text_col).alias("text"), number.cast("long").alias("loop"))
    schema = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + ", runs string, collapsed string" * texts
    return id_back(slim.mapInPandas(work, schema))


_EMPTY = hashlib.sha256(b"").hexdigest()
