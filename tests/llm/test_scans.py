"""Operators that look at one text at a time: BPE, licences, personal data, secrets."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, licenses, pii, secrets
from lectern.llm.queries import tokenizer_path

from ..compare import connect, duck_rows, spark_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.ForcedBoundaryBpe(tokenizer_path(), cache_size=50)


def test_bpe_as_the_library(spark, docs, odd, none, library):
    for frame in (docs, odd):
        texts = {(r.doc_id, r.text) for r in frame.collect()}
        want = sorted((i or -1, len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) for i, t in texts for e in [library.encode(t or "", add_special_tokens=False)])
        got = {(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(frame, tokenizer_path()).collect()}
        assert sorted(got) == sorted(set(want))
    assert bpe.encode(odd, tokenizer_path()).count() == odd.count() and bpe.encode(none, tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcz'’éÉß İſ\x1c\x85　<|>5²½ªﬁ́"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_bpe_any_text(library, own, text):
    e = library.encode(text, add_special_tokens=False)
    assert own.encode(text) == e.ids and own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_forced_boundaries_and_long_fragments(library, own):
    assert len(own.cut("zqxjzz")) > 1 and "".join(w for w, _ in own.cut("zqxjzz")) == "zqxjzz"
    for text in ("a" * 3000, "ab" * 1000 + " " + "!" * 999):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def base_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_base_part(docs, odd, none):
    for frame in (docs, odd):
        want = sorted(map(repr, (base_licenses(r.text) for r in frame.collect())))
        assert sorted(repr((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.scan(frame).collect()) == want
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("released under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2", "gpl-2"),
    ("under the GNU General Public Licence, version 3", ""), ("Licensed under the MIT License.", "mit"), ("under the Apache License, version 3", ""),
    ("licensed under a very nice and new CC BY-NC 4.0", "cc-by-nc"), ("licensed under one two three four five six seven CC-BY-NC", "cc-by-nc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("Permission to use, copy, modify, and distribute this software for any purpose with a fee is hereby granted", ""), (None, ""), ("", ""),
])
def test_license_templates(text, labels):
    found = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).scan(text)
    assert found[5] == labels and 0 <= found[6] <= 1 and bool(found[6]) == bool(labels)


def test_automaton_marks():
    a = licenses.TokenAutomaton([("x", "a <<beginOptional>>b <<endOptional>>c<<var;2>> d")])
    accepted = [bool(a.at(t.split(), 0)[0]) for t in ("a c d", "a b c d", "a b c x y d", "a b c x y z d", "a b d", "a b b c d")]
    assert accepted == [True, True, True, False, False, False]


def template_parts(template):
    """The template as nested lists of words, ("optional", parts) and ("any", most)."""
    stack = [[]]
    for i, part in enumerate(re.split(r"<<(beginOptional|endOptional|var;\d+)>>", template)):
        if i % 2 == 0:
            stack[-1] += licenses.words_of(part)
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            stack[-2].append(("optional", stack.pop()))
        else:
            stack[-1].append(("any", int(part[4:])))
    return stack[0]


def ends_by_hand(parts, words, starts):
    """Places where a match of ``parts`` that starts at one of ``starts`` can end."""
    for part in parts:
        if isinstance(part, str):
            starts = {i + 1 for i in starts if i < len(words) and words[i] == part}
        elif part[0] == "optional":
            starts = starts | ends_by_hand(part[1], words, starts)
        else:
            starts = {j for i in starts for j in range(i, min(i + part[1], len(words)) + 1)}
    return starts


def labels_by_hand(text, known):
    words = licenses.words_of(text)
    base = {x for p, x in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
    covered = set()
    for phrase in licenses.PHRASES:
        for i in range(len(words)):
            if words[i : i + len(phrase.split())] == phrase.split():
                covered |= set(range(i, i + len(phrase.split())))
    for label, parts in known:
        for i in range(len(words)):
            if ends := ends_by_hand(parts, words, {i}):
                base.add(label)
                covered |= set(range(i, max(ends)))
    return ",".join(sorted(base)), len(covered) / len(words) if words else 0.0


def filled(parts, r):
    """A text of the template: optional parts there or not, replaceable places with some words."""
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
        elif part[0] == "optional":
            out += filled(part[1], r) if r.random() < 0.5 else []
        else:
            out += [r.choice(["some", "holder", "inc", "the", "software"]) for _ in range(r.randint(0, part[1]))]
    return out


def test_license_labels_as_brute_force():
    r = random.Random(5)
    known = [(label, template_parts(t)) for label, t in licenses.TEMPLATES]
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    for label, parts in known * 4:
        words = filled(parts, r)
        whole = scanner.scan(" ".join(["before", *words, "after"]))
        assert label in whole[5].split(",")
        changed = list(words)
        i = len(words) - 1 - r.randrange(min(len(words), 40))
        if r.random() < 0.5:
            changed[i] = "otherwise"
        else:
            del changed[i]
        text = " ".join(["under", *changed, "the", *words[: r.randrange(len(words))], *r.choice(known)[1][:1]] if r.random() < 0.5 else changed) if all(isinstance(x, str) for x in changed) else ""
        got = scanner.scan(text)
        want = labels_by_hand(text, known)
        assert got[5] == want[0] and got[6] == pytest.approx(want[1])


@pytest.mark.parametrize("label", ["mit", "isc", "bsd-2", "bsd-3", "bsd-4", "zlib", "bsl-1", "unlicense", "mpl-2", "json", "x11", "0bsd"])
def test_license_texts_need_all_mandatory_wording(label):
    r = random.Random(6)
    scanner = licenses.Scanner({}, licenses.TEMPLATES)
    parts = template_parts(next(t for x, t in licenses.TEMPLATES if x == label))
    fixed = [i for i, p in enumerate(parts) if isinstance(p, str)]
    assert scanner.scan(" ".join(filled(parts, r)))[5] == label
    for i in fixed[1::7] + fixed[-1:]:
        for put in ([], ["unlike"], [parts[i], "unlike"]):
            other = filled([*parts[:i], *put, *parts[i + 1 :]], r)
            if len(put) < 2 or i < fixed[-1] and isinstance(parts[i + 1], str):
                assert label not in scanner.scan(" ".join(other))[5].split(","), (i, put)


def base_pii(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii_base_part(docs, odd, none):
    for frame in (docs, odd):
        want = sorted(sha(",".join(f"{k}:{s}:{e}" for k, s, e in base_pii(r.text or ""))) for r in frame.collect())
        assert sorted(r.base_sha256 for r in pii.find(frame).collect()) == want
    assert pii.find(none).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.2@+-() 5%é", max_size=60))
def test_pii_patterns_on_any_text(text):
    assert pii.base_spans(text) == base_pii(text)


def test_pii_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 50_000, "+1" + "(" * 100_000):
        pii.base_spans(text)


def test_pii_adds_by_votes(spark):
    rows = [(i, f"call phone: ({200 + i % 700}) 555-{1000 + i} for Maria, mail a{i}@b.example") for i in range(40)] + [(100 + i, f"part isbn 312-555-{1000 + i}") for i in range(40)]
    rows += [(200, "SSN: 123-45-6789 of Anna"), (201, "page 000-12-0000 here")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_added == 1 and "telephone:" in got[i].spans for i in range(40)) and got[200].spans.startswith("ssn:")
    assert not any(got[i].n_added for i in (*range(100, 140), 201))


def test_reliabilities_follow_agreement():
    counts = {"ssn:+++0+": 50, "ssn:-00-0": 50, "ssn:+00-0": 5}
    yes, no, posterior = pii.reliabilities(counts)
    assert posterior["ssn:+++0+"] > 0.9 > 0.1 > posterior["ssn:-00-0"] and yes[1, 2] > no[1, 2]


def em_by_hand(counts, rounds=3000):
    """The same maximum a posteriori estimate by loops over patterns, labelers and votes."""
    total = sum(counts.values())
    sure = 200
    start = {True: {"-": 0.05, "0": 0.45, "+": 0.5}, False: {"-": 0.3, "0": 0.62, "+": 0.08}}
    labelers = range(len(next(iter(counts)).split(":")[1]))
    table = {c: [dict(start[c]) for _ in labelers] for c in (True, False)}
    real, chance = 0.3, {}
    for _ in range(rounds):
        for p in counts:
            like = {True: real, False: 1 - real}
            for c in like:
                for j in labelers:
                    like[c] *= table[c][j][p.split(":")[1][j]]
            chance[p] = like[True] / (like[True] + like[False])
        mass = {c: {p: (chance[p] if c else 1 - chance[p]) * n for p, n in counts.items()} for c in (True, False)}
        for c in (True, False):
            for j in labelers:
                table[c][j] = {v: (start[c][v] * sure + sum(m for p, m in mass[c].items() if p.split(":")[1][j] == v)) / (sure + sum(mass[c].values())) for v in "-0+"}
        real = (sum(mass[True].values()) + 0.3 * sure) / (total + sure)
    return chance


def test_reliabilities_as_brute_force():
    r = random.Random(3)
    for n in (1, 4, 30):
        counts = {"ssn:" + "".join(r.choice("-00+") for _ in range(6)): r.randrange(1, 400) for _ in range(n)}
        want = em_by_hand(counts, 2000)
        assert pii.reliabilities(counts)[2] == pytest.approx(want, abs=1e-4)


def test_reliabilities_recover_planted_ones():
    """Of many candidates, the estimates are the labelers' true habits, also where these are against their meaning."""
    r = np.random.default_rng(4)
    yes = np.array([[0.02, 0.08, 0.9], [0.05, 0.35, 0.6], [0.1, 0.2, 0.7], [0.3, 0.6, 0.1], [0.0, 0.5, 0.5], [0.1, 0.6, 0.3]])
    no = np.array([[0.7, 0.25, 0.05], [0.5, 0.45, 0.05], [0.4, 0.55, 0.05], [0.05, 0.05, 0.9], [0.4, 0.6, 0.0], [0.3, 0.65, 0.05]])
    real = r.random(400_000) < 0.25
    counts = collections.Counter()
    votes = np.stack([np.where(real, r.choice(3, len(real), p=y), r.choice(3, len(real), p=n)) for y, n in zip(yes, no, strict=True)])
    for code, n in zip(*np.unique(3 ** np.arange(6) @ votes, return_counts=True), strict=True):
        counts["ssn:" + "".join("-0+"[code // 3**j % 3] for j in range(6))] = int(n)
    got_yes, got_no, posterior = pii.reliabilities(counts)
    assert np.abs(got_yes - yes).max() < 0.02 and np.abs(got_no - no).max() < 0.02
    assert sum(posterior[p] * n for p, n in counts.items()) / len(real) == pytest.approx(0.25, abs=0.01)


def planted(n, seed):
    """Texts of invented prose with spans that are personal data, and others that only look so."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(r.randint(8, 30)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    true = [lambda: f"his ssn 123-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: f"call phone ({r.randint(200, 999)}) {r.randint(200, 999)}-{digits(4)}", lambda: f"born {r.randint(1, 28):02}.{r.randint(1, 12):02}.19{r.randint(20, 99)}",
            lambda: f"the address 12 {r.choice(['Maple', 'Castle', 'Station'])} Street, Lyon", lambda: f"dear Mrs {r.choice(['Anna', 'Maria', 'Julia'])} {word().title()}", lambda: f"card account 1234 {digits(4)} {digits(4)} {digits(3)}1"]
    false = [lambda: f"isbn 000-{digits(2)}-0000", lambda: f"page 12 of table {digits(2)} 33 {digits(8)} 44 55", lambda: f"version {digits(9)} of part 7", lambda: f"{word().title()} {word().title()}"]
    rows, want = [], {}
    for i in range(n):
        parts = [prose()]
        if (kind := r.random()) < 0.6:
            parts += [r.choice(true if kind < 0.3 else false)(), prose()]
        rows.append((i, " ".join(parts)))
        want[i] = kind < 0.3
    return rows, want


def test_pii_spans_as_brute_force(spark, docs, odd):
    made, _ = planted(400, 1)
    for frame in (docs, odd, spark.createDataFrame(made, "doc_id long, text string")):
        rows = [(r.doc_id, r.text or "") for r in frame.collect()]
        counts = {}
        for _, text in rows:
            for c in pii.candidates(text, base_pii(text)):
                counts[c[3]] = counts.get(c[3], 0) + 1
        classifier = pii.train(counts)
        want = []
        for doc, text in rows:
            base, added = base_pii(text), []
            for kind, start, end, pattern in sorted(pii.candidates(text, base), key=lambda c: (-classifier.chance(c[3]), c[1], pii.EXTRA.index(c[0]))):
                if classifier.chance(pattern) >= 0.9 and not any(s < end and start < e for _, s, e in added):
                    added.append((kind, start, end))
            assert not any(s < e1 and s1 < e for _, s, e in base for _, s1, e1 in added)
            spans = sorted(base + added, key=lambda x: (x[1], (*pii.BASE, *pii.EXTRA).index(x[0])))
            want.append(repr((doc, ",".join(f"{k}:{s}:{e}" for k, s, e in spans), len(added))))
        assert sorted(repr((r.doc_id, r.spans, r.n_added)) for r in pii.find(frame).collect()) == sorted(want)


def test_pii_finds_what_was_planted(spark):
    rows, want = planted(3000, 2)
    got = {r.doc_id: r.n_added > 0 for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[i] for i in want if want[i]) / sum(want.values())
    wrong = sum(got[i] for i in want if not want[i]) / sum(not x for x in want.values())
    assert caught >= 0.8 and wrong <= 0.02, (caught, wrong)


def test_pii_adds_to_the_documents():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    found = [pii.candidates(t, pii.base_spans(t)) for t in texts]
    counts = {}
    for c in (c for f in found for c in f):
        counts[c[3]] = counts.get(c[3], 0) + 1
    classifier = pii.train(counts)
    chances = {p: classifier.chance(p) for p in counts}
    assert sum(len(pii.accepted(f, chances, 0.9)) for f in found) > 100


def test_pii_candidates_take_linear_time():
    for text in ("Aa " * 60_000, "1 " * 100_000, "12-" * 60_000, "Aa Bb 1 Cc " * 20_000, "DE00 " + "A1B2 " * 40_000):
        pii.candidates(text, [])


def base_secrets(text):
    out = []
    after = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for i, (kind, pattern) in enumerate((("assign", r"((?ia:password|passwd|secret|token|api_?key))" + after), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(pattern.replace("(?ia:", "(?i:"), text, re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_secrets_base_part(docs, odd, none, spark):
    tricky = spark.createDataFrame([(1, "password: token: abcdefgh token=secret=abcdefgh TOKEN:'x y"), (2, "é漢🎉 api_key == 'abc.def' AKIA" + "A" * 16 + "AKIA1 " + "0a" * 12 + " " + "0a" * 11), (3, "secretsecret=abcdef apikey='")], "doc_id long, text string").selectExpr("*", "'s' as source")
    for frame in (docs, odd, tricky):
        want = sorted(sha(base_secrets(r.text or "")) for r in frame.collect())
        assert sorted(r.base_sha256 for r in secrets.find(frame).collect()) == want
    assert secrets.find(none).count() == 0


def test_secrets_as_sql(spark, docs):
    from lectern.llm.oracle import SECRETS

    assert spark_rows(secrets.find(docs)) == duck_rows(connect("/root/testdata/sf0.001"), SECRETS)


def test_ownership_separates_examples_from_live(spark):
    live, shared = "ghp_" + "aB3" * 12, "ghp_" + "xY9k" * 9
    live = "ghp_a8Kq2LmZx91Pw0RtYv5Nc7Bd3Fg6Hj4S"
    shared = "ghp_Zz8Kq2LmTx91Pw0RtYv5Nc7Bd3Fg6Hj4"
    rows = [(1, f"key {live}", "a")] + [(i, f"as in {shared}", f"s{i}") for i in range(2, 8)] + [(9, "pwd = 'example-key-123456'", "a")]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].spans == "vendor:4:40" and got[1].n_live == 1
    assert all(got[i].spans == "" for i in (2, 7, 9))


def test_copies_of_one_owner_stay_live(spark):
    rows = [(i, "key ghp_a8Kq2LmZx91Pw0RtYv5Nc7Bd3Fg6Hj4S" + " again" * (i % 2), "a") for i in range(12)]
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 12 and all(r.spans == "vendor:4:40" and r.n_live == 1 for r in got)


def secrets_by_hand(rows):
    """doc_id, base counts, spans, n_live and n_example by loops over all matches."""
    found = []
    for seq, (_, text, owner) in enumerate(rows):
        for i, kind in enumerate(secrets.KINDS):
            for m in re.finditer(kind.pattern.replace("(?i:", "(?ia:"), text or "", 0):
                if len(m[kind.group]) >= kind.least:
                    found.append((seq, m.start(), m.end(), i, m[kind.group], owner or ""))
    owners, looks = {}, {}
    for *_, value, owner in found:
        owners.setdefault(value, set()).add(owner)
        classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        looks[value] = len(value) >= 16 and classes >= 2 and len(set(value)) >= 8 and not re.search("(?i)example|sample|dummy|changeme|xxxx|1234567|placeholder", value)
    verdict = {v: "live" if looks[v] and len(o) == 1 else "example" if len(o) >= 3 else "unclear" for v, o in owners.items()}
    out = []
    for seq, (doc, _, _) in enumerate(rows):
        mine = sorted((s, i, e, v) for q, s, e, i, v, _ in found if q == seq and (secrets.KINDS[i].base or verdict[v] == "live"))
        label = ",".join(f"{secrets.KINDS[i].name}:{s}:{e}" for s, i, e, _ in mine)
        out.append((doc, *(sum(i == k for _, i, _, _ in mine) for k in range(3)), label, *(sum(verdict[v] == x for *_, v in mine) for x in ("live", "example"))))
    return sorted(map(repr, out))


def test_ownership_as_brute_force(spark, odd):
    """Values copied over one, two and many sources, in every kind; nulls, repeated rows and a hot value."""
    r = random.Random(11)
    token = lambda n, letters="abcdefghijkmnpqrstuvwxyzABCDEFGHKLMN23456789": "".join(r.choice(letters) for _ in range(n))
    values = [token(30) for _ in range(12)] + ["changeme-example-1234567", "aaaaaaaaaaaaaaaaaaaa", *(token(24, "0123456789abcdef") for _ in range(6))]
    forms = ["password = {}", "pwd: '{}'", "ghp_{}AbCd3fGh1jKl", "auth_key={}", "plain {}", "AKIA" + token(16, "ABCDEFGH23456789") + " {}", "private-key {}"]
    rows = [(i if r.random() < 0.95 else None, " and ".join(r.choice(forms).format(values[min(int(r.expovariate(0.2)), len(values) - 1)]) for _ in range(r.randint(0, 3))), r.choice(["s1"] * 6 + ["s2", "s3", "s4", None])) for i in range(300)]
    rows += [(1000 + i, f"token = {values[0]}", f"wide{i % 40}") for i in range(200)] + [(2000 + i, "key ghp_a8Kq2LmZx91Pw0RtYv5Nc7Bd3Fg6Hj4S", "one") for i in range(50)] + rows[:5]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for given in (frame, odd):
        got = secrets.find(given).collect()
        want = secrets_by_hand([(x.doc_id, x.text, x.source) for x in given.collect()])
        assert sorted(repr((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.spans, x.n_live, x.n_example)) for x in got) == want
    verdicts = {x.n_live > 0 for x in secrets.find(frame).collect()}
    assert verdicts == {True, False} and any("example" in repr(x) or ", 1)" in x for x in secrets_by_hand(rows))


def test_random_texts_split_alike():
    r = random.Random(1)
    words = [r.choice(["the", "under", "mit", "license", "apache", "version", "2", "cc", "by", "nc"]) for _ in range(5000)]
    text = " ".join(words)
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).scan(text)
    assert s[:5] == base_licenses(text)
