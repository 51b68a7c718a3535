"""Scalar functions on text, as Column expressions; Arrow UDFs only for Unicode normal forms."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..schema import LANGUAGES, STOP_WORDS

#: What Windows-1252 has at the code points of the C1 controls.
_CP1252 = {c: bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(StringType())
def fold_marks(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def strip_controls(text: Column) -> Column:
    """C1 code points as Windows-1252 meant them; other controls but tab, newline and return go."""
    mapped = F.translate(text, "".join(map(chr, _CP1252)), "".join(_CP1252.values()))
    return F.regexp_replace(mapped, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]", "")


def sanitize(text: Column) -> Column:
    """Normal form C of :func:`strip_controls`."""
    return strip_controls(nfc(text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def slugify(text: Column, most: int = 128) -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens, of ASCII-folded text; a digest if nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    slug = F.left(F.replace(plain, F.lit(" "), F.lit("-")), F.lit(most))
    return F.when(slug == "", F.concat(F.lit("author-"), F.left(F.sha2(text, 256), F.lit(12)))).otherwise(slug)


def author_name(name: Column) -> Column:
    """"Last, First, dates" as "First Last"; parts that hold a digit are dates."""
    parts = F.filter(F.transform(F.split(name, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("[0-9]"))
    turned = F.concat_ws(" ", F.slice(parts, 2, 9), F.element_at(parts, 1))
    return F.when(F.size(parts) >= 2, turned).when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(F.trim(name))


def year_of(date: Column) -> Column:
    return F.left(date, F.lit(4)).try_cast("int")


def clean_publisher(name: Column) -> Column:
    return F.when(~name.rlike("(?i)adobe|acrobat|distiller|ghostscript|calibre|pdf|word|latex|quartz"), F.trim(name))


def canonical_key(name: Column, most: int | None = 80) -> Column:
    key = F.replace(F.lower(name), F.lit(" "), F.lit("-"))
    return key if most is None else F.left(key, F.lit(most))


def plain_id(uuid: Column) -> Column:
    """A UUID as 32 hex digits; anything else as it is."""
    return F.when(uuid.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(F.replace(uuid, F.lit("-"), F.lit("")))).otherwise(uuid)


def dashed_id(hexa: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(hexa.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *[F.substring(hexa, a, n) for a, n in cuts])).otherwise(hexa)


def valid_work_id(work_id: Column) -> Column:
    return work_id.rlike("^[a-z0-9]+(-[a-z0-9]+)*--[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(work_id) <= 128)


def language_code(tag: Column) -> Column:
    """ISO 639-1 of a BCP 47 tag or ISO 639-2 code."""
    first = F.split_part(F.replace(F.lower(tag), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[first], first)


def context_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def embedding_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(text) * 1.5)).cast("long")


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space and a capital or quote."""
    return F.split(text, r'(?<=[.!?])\s+(?=[A-Z"“])')


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def terms(text: Column) -> Column:
    """Distinct lower-case words of four letters at least that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z][a-z-]*[a-z])\b"), F.lit(1))
    return F.array_except(F.filter(F.array_distinct(found), lambda x: F.length(x) >= 4), F.array(*[F.lit(w) for w in STOP_WORDS]))


def scripture_refs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:[123] )?[A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}(?:-[0-9]{1,3})?)\b"), F.lit(1)))


def stamp_seconds(line: Column) -> Column:
    """Seconds of a leading [m:ss] or [h:mm:ss]; null without one."""
    part = [F.regexp_extract(line, r"^\[(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})\]", i) for i in (1, 2, 3)]
    hours = F.when(part[0] == "", 0).otherwise(part[0].try_cast("int"))
    return F.when(part[2] != "", hours * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("int"))


def stamp(seconds: Column) -> Column:
    """[m:ss], or [h:mm:ss] from an hour on."""
    h, m, s = (seconds / 3600).cast("int"), ((seconds % 3600) / 60).cast("int"), (seconds % 60).cast("int")
    return F.when(h > 0, F.format_string("[%d:%02d:%02d]", h, m, s)).otherwise(F.format_string("[%d:%02d]", m, s))


def speaker_of(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^([A-Z][A-Za-z .'-]{0,40}):\s", 1), F.lit(""))


def video_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?:youtu\.be/|/embed/|/shorts/|[?&]v=)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)


def source_key(url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("video--"), video_id(url)), F.concat(F.lit("media--"), F.left(F.sha2(url, 256), F.lit(12))))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def title_of_work(work_id: Column) -> Column:
    return F.initcap(F.replace(F.split_part(work_id, F.lit("--"), F.lit(-1)), F.lit("-"), F.lit(" ")))


def clean_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(tag, "^#", ""), "^parlour/", ""))


def alnum_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.length(text)).otherwise(0.0)


#: Section types and the headings that tell them, in order.
SECTION_HEADINGS = (
    ("toc", r"(table\s+of\s+)?contents"),
    ("bibliography", r"bibliography|works?\s+cited|references|further\s+reading|select\s+bibliography|selected\s+bibliography|notes\s+on\s+sources|sources|endnotes\s+and\s+bibliography"),
    ("index", r"index|general\s+index|subject\s+index|name\s+index|index\s+of\s+names|index\s+of\s+subjects|index\s+of\s+first\s+lines|index\s+of\s+authors|combined\s+index|scripture\s+index|biblical?\s+index"),
    ("front_matter", r"copyright(\s+page)?|first\s+published|all\s+rights\s+reserved|dedication|acknowledgements?|epigraph|about\s+the\s+author|about\s+the\s+editor|also\s+by|other\s+books?\s+by|title\s+page|half\s+title"),
    ("preface", r"(preface|foreword|introduction|author'?s?\s+note|editor'?s?\s+note|prologue)(:\s+.*)?"),
    ("back_matter", r"(appendix(\s+[a-z0-9]+)?|endnotes|notes|glossary|abbreviations|list\s+of\s+(illustrations|figures|tables)|epilogue|afterword|postscript)(:\s+.*)?"),
)
#: Lines of an index and of a bibliography.
INDEX_LINE = r"^[A-Z][a-z]+(?:\s[A-Za-z]+)*\s*,?\s*[0-9]+(?:[,\-–]\s*[0-9]+)*$"
BIBLIOGRAPHY_LINE = r"^[A-Z][a-z]+,\s+[A-Z].*\([0-9]{4}\)|^[A-Z][a-z]+,\s+[A-Z].*[0-9]{4}\."
#: Lines that start a chapter of a plain text.
CHAPTER_LINES = (
    r"chapter\s+([0-9]+|[ivxlcdm]+).*", r"part\s+([0-9]+|[ivxlcdm]+|one|two|three|four|five).*",
    r"(prologue|epilogue|introduction|conclusion|afterword|foreword|preface)", r"(appendix)\s*[a-z]?",
)


def section_type(heading: Column) -> Column:
    """Type of the first rule that the whole heading meets; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTION_HEADINGS):
        out = F.when(F.trim(heading).rlike(rf"(?i)^({pattern})$"), F.lit(name)).otherwise(out)
    return out


def section_type_by_content(text: Column) -> Column:
    """index if over 0.4 of five lines or more are index entries, bibliography if over 0.3 of three or more are titles; else null.

    Repeated groups are possessive, as the JVM matches others by recursion, which a line of some thousand
    words overflows; what follows a group begins with nothing that the group takes, so the matches are the same.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    part = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))) / n
    return F.when((n >= 5) & (part(INDEX_LINE.replace(")*", ")*+")) > 0.4), "index").when((n >= 3) & (part(BIBLIOGRAPHY_LINE) > 0.3), "bibliography")


def is_chapter_heading(line: Column) -> Column:
    text = F.trim(line)
    return text.rlike("(?i)^(" + "|".join(CHAPTER_LINES) + ")$")


def is_section_heading(line: Column) -> Column:
    """A roman number alone, or a short line in capitals."""
    text = F.trim(line)
    return text.rlike(r"^[IVXLCDM]+\.?$") | text.rlike(r"^[A-Z][A-Z\s0-9:.,!?\-—–]{2,80}$")


def repair_number(text: Column) -> Column:
    """Digits that a scan read as letters: l, I and | as 1, O and o as 0, S as 5."""
    return F.translate(text, "lI|OoS", "111005").try_cast("int")


def preceding_quote(before: Column, most: int = 200) -> Column:
    """The last block before a citation: after a blank line, else a quoted line, else an indent, else the last characters."""

    def after(mark: str) -> Column:
        return F.substring_index(before, mark, -1)

    return F.trim(F.when(before.contains("\n\n"), after("\n\n")).when(before.contains("\n>"), after("\n>")).when(before.contains("\n  "), after("\n  ")).otherwise(F.right(before, F.lit(most))))


#: The four forms of a citation; group 1 is the author's name.
CITATIONS = (
    ("footnote", r"(?:See|Cf\.|cf\.|see)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:,\s*(?:(?:pp?\.\s*[0-9]+(?:-[0-9]+)?)|(?:ch(?:apter)?\.?\s*[0-9]+)))?"),
    ("parenthetical", r"\(([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:,?\s*([0-9]{4}))?(?:,\s*(?:pp?\.\s*)?([0-9]+(?:-[0-9]+)?))?\)"),
    ("attribution", r"(?:—|--|–)\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:,\s*[\"']?([^\"'\n]+)[\"']?)?"),
    ("inline", r"(?:In\s+|in\s+|According to\s+|as\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)'s\s+(?:[\"']([^\"']+)[\"']|(\w+(?:\s+\w+)*))"),
)


def parse_json_text(text: str) -> str | None:
    """JSON from prose: the text itself, a fenced block, or the first balanced braces; trailing commas go."""
    import json

    def load(x: str) -> str | None:
        for y in (x, re.sub(r",\s*([}\]])", r"\1", x)):
            try:
                return json.dumps(json.loads(y), sort_keys=True)
            except ValueError:
                pass
        return None

    if not text:
        return None
    tries = [text.strip(), *(m.strip() for m in re.findall(r"```(?:json)?\s*(.*?)```", text, re.S))]
    for open_, close in ("{}", "[]"):
        start, depth = text.find(open_), 0
        for i in range(start, len(text)) if start >= 0 else ():
            depth += (text[i] == open_) - (text[i] == close)
            if not depth:
                tries.append(text[start : i + 1])
                break
    return next((found for t in tries if (found := load(t)) is not None), None)


@pandas_udf(StringType())
def json_in_prose(text: pd.Series) -> pd.Series:
    return text.map(parse_json_text, na_action="ignore")


def salvage_array(text: str) -> list[str]:
    """The whole objects at the start of a JSON array that was cut off."""
    import json

    out, decoder = [], json.JSONDecoder()
    at = text.find("[") + 1
    while at:
        m = re.compile(r"[\s,]*").match(text, at)
        try:
            value, at = decoder.raw_decode(text, m.end())
        except ValueError:
            break
        out.append(json.dumps(value, sort_keys=True) if not isinstance(value, str) else json.dumps({"name": value}))
    return out


@pandas_udf(ArrayType(StringType()))
def salvaged(text: pd.Series) -> pd.Series:
    return text.map(lambda t: salvage_array(t or ""))
