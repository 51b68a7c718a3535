"""Operator 6: personal data by weak supervision.

Four kinds are found by fixed patterns and always count.  Further candidates come from loose patterns of
numbers, dates, addresses and names, and six labelers vote on each: the format, a gazetteer, cue words,
counter-cues, neighbours of the base kinds, and how the span stands among words and numbers.  The votes
are summed by pattern over the whole corpus; expectation-maximisation estimates for each kind how reliable
each labeler is, and a logistic classifier of votes, kind, shape and surroundings is trained on the
probabilities that follow.  Candidates that it is sure of are added.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

#: Spans with the same start are listed in this order.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("ssn", "iban", "telephone", "account", "birth", "address", "person")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four fixed patterns, leftmost and not overlapping within a kind, in linear time."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for run in _DOTTED.finditer(text):
        if "." in run[0]:
            numbers = list(_NUMBER.finditer(text, run.start(), run.end()))
            for i in range(0, len(numbers) - 3, 4):
                four = numbers[i : i + 4]
                if all(len(m[0].lstrip("0")) <= 3 and int(m[0].lstrip("0") or 0) <= 255 for m in four):
                    out.append(("ip", four[0].start(), four[3].end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


#: A gazetteer of common given names; the operator takes any other.
GIVEN = frozenset((
    "Adam Adrian Agnes Albert Alejandro Alexander Alice Amanda Amelia Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antoine Antonio Barbara "
    "Beatriz Benjamin Bernard Birgit Brian Camille Carl Carlos Carmen Caroline Catherine Cecilia Charles Charlotte Chloé Christian Christine Christopher Claire "
    "Clara Claudia Daniel David Deborah Diana Diego Dieter Dominique Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Erika Eva Felix "
    "Fernando Florian Francisco François Frank Franz Friedrich Gabriel George Georg Gerhard Giovanni Günter Hannah Hans Heinrich Helen Helga Henri Henry "
    "Ignacio Ines Ingrid Isabel Isabelle Jack Jacques James Jan Javier Jean Jennifer Jessica Joachim Johann John Jonas José Joseph Juan Julia Julian "
    "Jürgen Karen Karl Katharina Kevin Klaus Laura Lena Linda Lisa Louis Louise Lucas Lucía Luis Manuel Marc Margaret María Maria Marie Mario Mark "
    "Martin Mary Matthew Matthias Michael Michel Miguel Monika Nancy Natalie Nicolas Nicole Olivia Otto Pablo Patricia Paul Pedro Peter Petra Philippe Pierre "
    "Rafael Ralph Raúl Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Sebastian Sergio Simon Sofia Sophie Stefan Stephen Susan Susanne Sylvie Teresa "
    "Thomas Ursula Valentina Victor Werner William Wolfgang Yves"
).split())
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}"
_CANDIDATES = {
    "ssn": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "telephone": re.compile(r"(?<![\w+(.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![\w-])", re.A),
    "account": re.compile(r"(?<![\w.,/-])[0-9](?:[\x20-]?[0-9]){7,18}(?![\w-])", re.A),
    "birth": re.compile(r"(?<![\w.,/-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![\w-])", re.A),
    "address": re.compile(
        rf"(?<!\w)(?:[0-9]{{1,5}}[a-z]?\x20(?:{_NAME}\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way)"
        rf"|[A-ZÀ-Þ][a-zß-ÿ]{{2,20}}(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}[a-z]?"
        rf"|[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place|chemin)\x20(?:(?:de|du|des|la|le)\x20){{0,2}}{_NAME}"
        rf"|(?:Calle|Avenida|Plaza|Paseo)\x20(?:(?:de|del|la|los)\x20){{0,2}}{_NAME},?\x20[0-9]{{1,4}})(?!\w)"
    ),
    "person": re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Madame|Monsieur)\.?\x20)?{_NAME}\x20{_NAME}(?!\w)"),
}
_TITLE = re.compile(r"(?:Mrs?|Ms|Dr|Herr|Frau|Señora?|Madame|Monsieur)\.?\x20")
_CUES = {
    "ssn": re.compile(r"ssn|social security|taxpayer", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta", re.I),
    "telephone": re.compile(r"phone|tel\b|tel\.|call|fax|mobile|contact|telefon|téléphone|teléfono", re.I),
    "account": re.compile(r"card|account|credit|visa|member|customer|passport|insurance|licence no|id\b|konto|karte|carte|compte|tarjeta|cuenta", re.I),
    "birth": re.compile(r"born|birth|dob\b|geboren|geburt|née?\b|naissance|naci", re.I),
    "address": re.compile(r"address|lives? (?:at|in)|resid|adresse|wohn|habite|dirección|ship to|deliver", re.I),
    "person": re.compile(r"name|dear|contact|signed|born|sincerely|regards|author|by\x20\Z", re.I),
}
_AGAINST = re.compile(r"isbn|issn|version|invoice|order|part|serial|page|vol\.|figure|table|example|chapter|section|no\.|nr\.|art\.", re.I)
_POSTAL = re.compile(r",?\x20*(?:[0-9]{4,5}\b|[A-ZÀ-Þ][a-zß-ÿ]+)")
_LETTERS_BEFORE, _LETTERS_AFTER = re.compile(r"[^\W\d_][,;:]?\x20\Z"), re.compile(r"[.,;:!?]{0,2}(?:\x20[^\W\d_]|\n|\Z)")
_WORDS = re.compile(r"\w+")


def _iban_ok(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _date_ok(text: str) -> bool:
    a, b, c = (int(x) for x in _NUMBER.findall(text))
    year, month, day = (a, b, c) if a > 1000 else (c, b, a)
    try:
        return 1900 <= datetime.date(year, month, day).year <= 2015
    except ValueError:
        return False


def _format_vote(kind: str, span: str) -> int:
    digits = _digits(span)
    if kind == "ssn":
        return 1 if digits[:3] not in ("000", "666") and digits[0] < "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    if kind == "iban":
        return 1 if _iban_ok(span) else -1
    if kind == "telephone":
        if not 7 <= len(digits) <= 13:
            return -1
        return 1 if len(digits) == 10 and digits[0] >= "2" and digits[3] >= "2" or digits[0] == "0" else 0
    if kind == "account":
        if len(set(digits)) <= 2 or digits in "01234567890123456789":
            return -1
        return 1 if len(digits) in (15, 16) else 0
    if kind == "birth":
        return 1 if _date_ok(span) else -1
    if kind == "address":
        return 1
    return 1 if _TITLE.match(span) else 0


def _gazetteer_vote(kind: str, span: str, before: str, after: str, names: frozenset[str]) -> int:
    if kind == "address":
        return 1 if _POSTAL.match(after) else 0
    return 1 if any(w in names for w in _WORDS.findall(span if kind == "person" else before)) else 0


def votes(text: str, kind: str, start: int, end: int, base: list[tuple[str, int, int]], names: frozenset[str] = GIVEN) -> tuple[int, ...]:
    """For (1), against (-1) or no vote (0) of each labeler; ``base`` is in order of start."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 30]
    context = 1 if _CUES[kind].search(before) else 0
    against = -1 if _AGAINST.search(before) or after[:1] in ("%", "€", "$", "£") else 0
    i = bisect_left(base, start, key=lambda s: s[1])
    near = 1 if any(abs(s - end) <= 80 or abs(start - e) <= 80 for _, s, e in base[max(0, i - 4) : i + 4]) else 0
    others = len(_NUMBER.findall(before)) + len(_NUMBER.findall(after))
    alone = others == 0 and bool(_LETTERS_BEFORE.search(before) and _LETTERS_AFTER.match(after))
    return _format_vote(kind, span), _gazetteer_vote(kind, span, before, after, names), context, against, near, -1 if others >= 3 else int(alone)


def shape(text: str, start: int, end: int) -> str:
    """What the classifier sees of a span besides votes: digits, separators, and the sign before it."""
    span = text[start:end]
    digits = len(_digits(span))
    apart = {" ": "s", "-": "h", ".": "d"}
    marks = {apart.get(c, "o") for c in span if not c.isalnum()}
    ahead = text[start - 1 : start] if start else ""
    led = "b" if ahead in ("", "\n") else "c" if text[max(0, start - 3) : start].strip()[-1:] in (":", "=") else "t"
    return f"{min(digits, 20) // 4}{'n' if not marks else min(marks) if len(marks) == 1 else 'm'}{led}"


def candidates(text: str, base: list[tuple[str, int, int]], names: frozenset[str] = GIVEN) -> list[tuple[str, int, int, str]]:
    """kind, start, end and pattern (kind:votes:shape) of the loose matches that overlap no base span."""
    out: list[tuple[str, int, int, str]] = []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    numbers = _NUMBER.search(text) is not None
    for kind, pattern in _CANDIDATES.items():
        if kind != "person" and not numbers:
            continue
        for m in pattern.finditer(text):
            i = bisect_left(starts, m.end())
            if i and ends[i - 1] > m.start():
                continue
            vote = votes(text, kind, m.start(), m.end(), base, names)
            out.append((kind, m.start(), m.end(), f"{kind}:{''.join('-0+'[v + 1] for v in vote)}:{shape(text, m.start(), m.end())}"))
    return sorted(out, key=lambda c: (c[1], EXTRA.index(c[0])))


#: How many candidates the prior of a labeler's votes is worth.
PSEUDO = 200.0


def reliabilities(counts: dict[str, int], rounds: int = 2000, prior: float = 0.3) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over the vote patterns (kind:votes) of one kind.

    Returns P(vote | real) and P(vote | not real), each labelers x 3, and every pattern's probability.
    Starts from what a labeler means by its votes.  That also is a prior worth ``PSEUDO`` candidates,
    however many there are, which tells the two classes apart where few occur and leaves the estimates of
    many to the data.  Ends when no probability moves by 1e-9, or after ``rounds``.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], dtype=float)
    vote = np.array([["-0+".index(c) for c in p.split(":")[1]] for p in patterns], dtype=int)
    labelers = vote.shape[1]
    each = np.arange(labelers)
    sure = PSEUDO
    yes, no, real = np.tile([0.05, 0.45, 0.5], (labelers, 1)), np.tile([0.3, 0.62, 0.08], (labelers, 1)), prior
    start_yes, start_no = yes * sure, no * sure
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        before = posterior
        log_yes = np.log(real) + np.log(yes[each, vote]).sum(axis=1)
        log_no = np.log(1 - real) + np.log(no[each, vote]).sum(axis=1)
        posterior = 1 / (1 + np.exp(np.clip(log_no - log_yes, -500, 500)))
        a, b = posterior * weight, (1 - posterior) * weight
        yes = np.stack([start_yes[:, v] + (a[:, None] * (vote == v)).sum(axis=0) for v in range(3)], axis=1)
        no = np.stack([start_no[:, v] + (b[:, None] * (vote == v)).sum(axis=0) for v in range(3)], axis=1)
        yes /= yes.sum(axis=1, keepdims=True)
        no /= no.sum(axis=1, keepdims=True)
        real = (a.sum() + sure * prior) / (weight.sum() + sure)
        if np.abs(posterior - before).max(initial=0) < 1e-9:
            break
    return yes, no, dict(zip(patterns, posterior.tolist(), strict=True))


#: Values of the characters of a shape, for indicator features.
_SHAPES = ("012345", "nshdom", "bct")


def _features(pattern: str) -> np.ndarray:
    kind, vote, form = pattern.split(":")
    own = [kind == k for k in EXTRA]
    cast = [c == sign for c in vote for sign in "+-"]
    return np.array([1.0, *own, *cast, *(f and c for f in own for c in cast), *(c == x for c, known in zip(form, _SHAPES, strict=True) for x in known)], dtype=float)


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights of votes, kind, votes by kind, shape and surroundings."""

    weights: np.ndarray

    def chance(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(_features(pattern) @ self.weights, -500, 500))))


def train(counts: dict[str, int]) -> SpanClassifier | None:
    """The final classifier, from counts by pattern (kind:votes:shape), on the probabilities of EM; None without any."""
    if not counts:
        return None
    posterior: dict[str, float] = {}
    for kind in EXTRA:
        mine: dict[str, int] = {}
        for p, n in counts.items():
            if p.startswith(f"{kind}:"):
                mine[p.rpartition(":")[0]] = mine.get(p.rpartition(":")[0], 0) + n
        if mine:
            posterior |= reliabilities(mine)[2]
    patterns = sorted(counts)
    x = np.stack([_features(p) for p in patterns])
    y = np.array([posterior[p.rpartition(":")[0]] for p in patterns])
    w = np.sqrt([float(counts[p]) for p in patterns])
    beta = np.zeros(x.shape[1])
    while True:  # Newton's steps of a strictly convex loss
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - y)) + 1e-2 * beta
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta = beta - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            return SpanClassifier(beta)


def accepted(found: list[tuple[str, int, int, str]], chances: dict[str, float], threshold: float) -> list[tuple[str, int, int]]:
    """Of the candidates at ``threshold`` or more those that overlap none of a higher chance (then earlier, then of an earlier kind)."""
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []
    for kind, start, end, _ in sorted((c for c in found if chances[c[3]] >= threshold), key=lambda c: (-chances[c[3]], c[1], EXTRA.index(c[0]))):
        i = bisect_left(starts, end)
        if not i or out[i - 1][2] <= start:
            at = bisect_left(starts, start)
            starts.insert(at, start)
            out.insert(at, (kind, start, end))
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, threshold: float = 0.9, names: frozenset[str] = GIVEN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added.

    spans lists kind:start:end (code points) by start, then kind; base_sha256 is the digest of the base
    kinds' list.  Null and empty texts have no spans, long ones are read whole.  Repeated rows count
    each; an empty table gives an empty result; further columns are not read.  Texts are read once;
    what reaches the driver are counts by pattern, whose number is bounded by kinds, votes and shapes and
    does not grow with the table.  Added spans overlap neither base spans nor each other.
    """
    item = "struct<kind:string,start:bigint,end:bigint"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = base_spans(text or "")
                more = candidates(text or "", base, names)
                rows.append((doc, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base], [dict(zip(("kind", "start", "end", "votes"), c, strict=True)) for c in more]))
            yield pd.DataFrame(rows, columns=["doc_id", "base", "more"])

    slim = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    found = cut(slim.mapInPandas(work, f"doc_id string, base array<{item}>>, more array<{item},votes:string>>"))
    counts = {r["votes"]: r["count"] for r in found.select(F.explode("more.votes").alias("votes")).groupBy("votes").count().collect()}
    classifier = train(counts)
    chances = {p: classifier.chance(p) for p in counts}
    order = (*BASE, *EXTRA)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, base, more in zip(batch["doc_id"], batch["base"], batch["more"], strict=True):
                own = [(s["kind"], s["start"], s["end"]) for s in base]
                added = accepted([(c["kind"], c["start"], c["end"], c["votes"]) for c in more], chances, threshold)
                kinds = [s[0] for s in own]
                everything = sorted(own + added, key=lambda s: (s[1], order.index(s[0])))
                rows.append((doc, *(kinds.count(k) for k in BASE), hashlib.sha256(_listed(own).encode()).hexdigest(), _listed(everything), len(everything), len(added)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", "n_added"])

    return id_back(found.mapInPandas(finish, "doc_id string, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long, n_added long"))
