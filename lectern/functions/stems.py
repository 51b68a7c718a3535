"""English stems by the public Porter2 (Snowball) rules, and the search stop list."""

from __future__ import annotations

import re

#: The stop list of English full-text search.
SEARCH_STOP_WORDS = frozenset((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split())
#: Fixed values of the rules: words with stems of their own, and those that a step leaves as they are.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what they become, longest first where one ends another.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
FIRST_REGION = re.compile("gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy]")


def _short_syllable(text: str) -> bool:
    if len(text) == 2:
        return bool(re.fullmatch("[aeiouy][^aeiouy]", text))
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", text))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word; other letters than a to z are consonants."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word.removeprefix("'")))
    first = m.end() if (m := FIRST_REGION.match(w)) else len(w)
    second = m.end() if (m := REGION.match(w, first)) else len(w)
    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    if m := re.search("(eedly|eed)$|(ingly|edly|ing|ed)$", w):
        if m[1]:
            w = w[: m.start()] + "ee" if m.start() >= first else w
        elif re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif first >= len(w) and _short_syllable(w):
                w += "e"
    if re.search("[^aeiouy][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= first and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (second if end == "ative" else first):
                w = w[:at] + new
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= second and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= second or at >= first and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(word: str) -> str | None:
    """What a lower-case word is searched by: nothing for a stop word."""
    return None if word in SEARCH_STOP_WORDS else stem(word)
