"""Numbers of scanned letters repaired by the longest rising sequence of their readings."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def readings(raw: str) -> list[int]:
    """What a scanned number may be: itself, and itself without its first or last digit (a mark taken for one)."""
    forms = {raw, raw[1:], raw[:-1]} if len(raw) > 1 else {raw}
    return sorted({int(x) for x in forms if x}, reverse=True)


def rising(options: list[list[int]]) -> list[int | None]:
    """Of each place one of its options or none, so that those taken rise and are most; of ties the least ends.

    A dynamic program over the least number that a rising sequence of each length can end with; a place's
    options are tried from the largest down, so that it gives one at most.
    """
    ends: list[int] = []
    last: list[int] = []
    nodes: list[tuple[int, int, int]] = []  # place, number, node before
    for place, mine in enumerate(options):
        for number in mine:
            n = bisect_left(ends, number)
            nodes.append((place, number, last[n - 1] if n else -1))
            if n == len(ends):
                ends.append(number)
                last.append(len(nodes) - 1)
            else:
                ends[n], last[n] = number, len(nodes) - 1
    out: list[int | None] = [None] * len(options)
    at = last[-1] if last else -1
    while at >= 0:
        place, number, at = nodes[at]
        out[place] = number
    return out


def repaired(raws: list[str]) -> list[tuple[int | None, str]]:
    """Number and how it came about of each reading: read (as it stands), repaired (another form), between or unknown.

    A place off the rising sequence is known where its neighbours on it leave just as many numbers as places.
    """
    numbers = rising([readings(r) for r in raws])
    out: list[tuple[int | None, str]] = [(n, "read" if n == int(r) else "repaired") if n is not None else (None, "unknown") for n, r in zip(numbers, raws, strict=True)]
    known = [i for i, n in enumerate(numbers) if n is not None]
    for a, b in zip(known, known[1:], strict=False):
        if numbers[b] - numbers[a] == b - a:
            for i in range(a + 1, b):
                out[i] = (numbers[a] + i - a, "between")
    return out


def repaired_numbers(rows: DataFrame) -> DataFrame:
    """book, pos, raw, number, how of ``rows`` (book, pos, raw as digits), each book's readings in the order of pos."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pos", "raw"]).reset_index(drop=True)
        found = pd.DataFrame(repaired(frame["raw"].tolist()), columns=["number", "how"])
        return pd.concat([frame, found.astype({"number": "Int64"})], axis=1)

    kept = rows.filter(F.col("raw").rlike("^[0-9]{1,18}$")).select("book", "pos", "raw").dropna()
    return kept.groupBy("book").applyInPandas(work, f"book {dict(rows.dtypes)['book']}, pos long, raw string, number long, how string")
