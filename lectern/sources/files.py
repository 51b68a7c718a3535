"""Sources of documents: folders of EPUB, DOCX, HTML and text files, PDF spans, transcripts, dumps.

Files are read by Spark's ``binaryFile`` source and parsed by ``mapInArrow`` into a row of nodes a file or
the flat node table of :data:`lectern.schema.DOC_NODES`, so a corpus of any size is parsed where its bytes are.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BIBLIOGRAPHY_LINE, CHAPTER_LINES, INDEX_LINE, SECTION_HEADINGS, is_chapter_heading, is_section_heading
from ..schema import DOC_NODES

EXTENSIONS = ("epub", "docx", "html", "htm", "txt")

Node = tuple[int, int, str, str | None, str]  # parent, depth, type, section type, text


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def listing(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = (*EXTENSIONS, "pdf", "md")) -> DataFrame:
    """path, size_kb and extension of a folder's files of the known kinds; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return files.select("path", F.round(F.col("length") / 1024, 1).alias("size_kb"), extension(F.col("path")).alias("extension")).filter(F.col("extension").isin(*extensions))


# ---- parsers: bytes to nodes

_DROP = {"nav", "header", "footer", "aside", "script", "style", "form", "iframe", "noscript", "template"}
_BLOCKS = {"h1": "chapter", "h2": "section", "h3": "section", "h4": "section", "p": "paragraph", "li": "list_item", "blockquote": "quote", "pre": "code", "td": "cell"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search"}
_CLASSES = ("sidebar", "navbar", "menu", "footer", "advert", "cookie")


class _Html(HTMLParser):
    """Blocks of the main content; unwanted elements, roles and classes are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []  # open elements, and of each whether it is left out and the main content
        self.flags: list[tuple[bool, bool]] = []
        self.gone = self.main = 0  # of those open
        self.meta: dict[str, str] = {}
        self.blocks: list[tuple[str, str, bool]] = []
        self.kind, self.buffer = "paragraph", []

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.blocks.append((self.kind, text, self.main > 0))
        self.buffer, self.kind = [], "paragraph"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag in _VOID:
            if tag == "br":
                self.buffer.append("\n")
            return
        gone = tag in _DROP or a.get("role") in _ROLES or (bool(a.get("class")) and any(c in a["class"].lower() for c in _CLASSES))
        main = tag in ("main", "article") or a.get("role") == "main"
        if tag in _BLOCKS:
            self._flush()
            self.kind = _BLOCKS[tag]
        self.tags.append(tag)
        self.flags.append((gone, main))
        self.gone += gone
        self.main += main

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.tags:
            return
        if tag in _BLOCKS or tag in ("div", "main", "article", "body"):
            self._flush()
        last = None
        while last != tag:
            last, (gone, main) = self.tags.pop(), self.flags.pop()
            self.gone -= gone
            self.main -= main

    def handle_data(self, data: str) -> None:
        if self.tags and self.tags[-1] == "title":
            self.meta.setdefault("title", " ".join(data.split()))
        elif not self.gone:
            self.buffer.append(data)


def decoded(raw: bytes) -> str:
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def heading_type(heading: str) -> str | None:
    """Section type of the first rule that a whole heading meets."""
    return next((name for name, pattern in SECTION_HEADINGS if re.fullmatch(pattern, heading.strip(), re.I | re.A)), None)


def content_type(text: str) -> str | None:
    """Section type by lines that look like those of an index or a bibliography."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    share = lambda pattern: sum(bool(re.match(pattern, x)) for x in lines) / len(lines)
    if len(lines) >= 5 and share(INDEX_LINE) > 0.4:
        return "index"
    return "bibliography" if len(lines) >= 3 and share(BIBLIOGRAPHY_LINE) > 0.3 else None


def typed(nodes: list[Node], first: str | None = None) -> list[Node]:
    """Nodes with section types: a heading's own or its parent's, else by the text under it, else ``first``."""
    below: dict[int, list[str]] = {}
    for parent, _, kind, _, text in nodes:
        if kind not in ("document", "chapter", "section"):
            below.setdefault(parent, []).append(text)
    out: list[Node] = []
    for i, (parent, depth, kind, _, text) in enumerate(nodes):
        over = out[parent][3] if parent >= 0 else None
        if kind in ("document", "chapter", "section"):
            over = (heading_type(text) if kind != "document" else None) or over or content_type("\n".join(below.get(i, []))) or (first if kind == "document" else None)
        out.append((parent, depth, kind, over, text))
    return out


def parse_html(raw: bytes) -> list[Node]:
    parser = _Html()
    parser.feed(decoded(raw))
    parser.close()
    parser._flush()
    main = [b for b in parser.blocks if b[2]] or parser.blocks
    nodes: list[Node] = [(-1, 0, "document", None, parser.meta.get("title", ""))]
    heads = {0: 0}
    for kind, text, _ in main:
        depth = {"chapter": 1, "section": 2}.get(kind, 3)
        parent = heads[max(d for d in heads if d < depth)]
        nodes.append((parent, depth, kind, None, text))
        if depth < 3:
            heads = {d: n for d, n in heads.items() if d < depth} | {depth: len(nodes) - 1}
    return typed(nodes)


def parse_epub(raw: bytes) -> list[Node]:
    """The spine's parts in order, each parsed as HTML under one document node; of five or more an untyped first is front matter."""
    nodes: list[Node] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        base = opf.rpartition("/")[0]
        title = next((e.text or "" for e in package.iter() if e.tag.endswith("}title")), "")
        nodes.append((-1, 0, "document", None, title))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
        spine = [e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref")]
        for number, ref in enumerate(spine):
            name = f"{base}/{items[ref]}" if base else items[ref]
            part = parse_html(z.read(name))
            if number == 0 and len(spine) >= 5 and not any(n[3] for n in part):
                part = [(p, d, k, "front_matter", t) for p, d, k, _, t in part]
            shift = len(nodes) - 1
            nodes += [(p + shift if p > 0 else 0, d, k, s, t) for p, d, k, s, t in part[1:]]
    return nodes


def parse_docx(raw: bytes) -> list[Node]:
    """Heading 1 opens a chapter, further headings sections; table rows are joined by bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        notes = ElementTree.fromstring(z.read("word/footnotes.xml")) if "word/footnotes.xml" in z.namelist() else []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    nodes: list[Node] = [(-1, 0, "document", None, "")]
    chapter = section = 0
    for e in body:
        if e.tag == f"{w}p" and text(e):
            style = e.find(f"{w}pPr/{w}pStyle")
            name = style.attrib.get(f"{w}val", "") if style is not None else ""
            if m := re.fullmatch(r"Heading ?([0-9])", name):
                if m[1] == "1":
                    nodes.append((0, 1, "chapter", None, text(e)))
                    chapter = section = len(nodes) - 1
                else:
                    nodes.append((chapter, 2, "section", None, text(e)))
                    section = len(nodes) - 1
            else:
                nodes.append((section or chapter, 3, "paragraph", None, text(e)))
        elif e.tag == f"{w}tbl":
            nodes += [(section or chapter, 3, "table_row", None, " | ".join(text(c) for c in r.iter(f"{w}tc"))) for r in e.iter(f"{w}tr")]
    return typed(nodes) + [(0, 1, "footnote", None, text(n)) for n in notes if text(n)]


def parse_txt(raw: bytes) -> list[Node]:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    nodes: list[Node] = [(-1, 0, "document", None, "")]
    chapter = section = 0
    for block in (b.strip() for b in re.split(r"\n\s*\n", text)):
        if not block:
            continue
        if re.fullmatch("|".join(CHAPTER_LINES), block, re.I | re.A):
            nodes.append((0, 1, "chapter", None, block))
            chapter = section = len(nodes) - 1
        elif re.fullmatch(r"[IVXLCDM]+\.?|[A-Z][A-Z\s0-9:.,!?\-—–]{2,80}", block, re.A):
            nodes.append((chapter, 2, "section", None, block))
            section = len(nodes) - 1
        else:
            nodes.append((section or chapter, 3, "paragraph", None, block))
    return typed(nodes)


PARSERS: dict[str, Callable[[bytes], list[Node]]] = {"epub": parse_epub, "docx": parse_docx, "html": parse_html, "htm": parse_html, "txt": parse_txt}


_NODE = pa.struct([*[(n, pa.int32()) for n in ("node_id", "parent_id", "ord", "depth")], *[(n, pa.string()) for n in ("node_type", "section_type", "text")]])


def parsed(files: DataFrame, most: int = 256) -> DataFrame:
    """doc_id and nodes of files (path, content) by extension, a row a file; an unknown one is an error, an unreadable file an error node.

    ``most`` files at a time leave a task.
    """

    def nodes_of(path: str, content: bytes) -> list[Node]:
        parser = PARSERS.get(path.rpartition(".")[2].lower())
        if parser is None:
            raise ValueError(f"no parser for {path}")
        try:
            return parser(content)
        except Exception as e:  # noqa: BLE001 - a file of any defect is a row, not the end of the job
            return [(-1, 0, "error", None, repr(e))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                paths, found, ends = part["path"].to_pylist(), [], [0]
                for path, content in zip(paths, part["content"], strict=True):
                    found += [(i, p, i, d, k, s, t) for i, (p, d, k, s, t) in enumerate(nodes_of(path, content.as_py()))]
                    ends.append(len(found))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _NODE, strict=True)]
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_NODE)))
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), nodes], ["doc_id", "nodes"])

    fields = DOC_NODES.partition(", ")[2].replace(" ", ":").replace(",:", ",")
    return files.select("path", "content").mapInArrow(work, f"doc_id string, nodes array<struct<{fields}>>")


def parse(files: DataFrame) -> DataFrame:
    """Node rows of files (path, content): those of :func:`parsed`."""
    return parsed(files).select("doc_id", F.inline("nodes"))


def read_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return parse(files)


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, block, kind of plain texts, in expressions alone."""
    rows = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "block"))
    kind = F.when(is_chapter_heading(F.col("block")), "chapter").when(is_section_heading(F.col("block")), "section").otherwise("paragraph")
    return rows.withColumn("kind", kind)


def classified_spans(spans: DataFrame) -> DataFrame:
    """Add kind to PDF text spans (doc_id, size, bold, y, text): y from 0 at a page's top to 1.

    Sizes are against the document's median: chapters 1.4 times or by keyword, headings above 1.2 or
    bold at the median, footnotes under 0.85 in the lowest fifth.
    """
    median = spans.groupBy("doc_id").agg(F.median("size").alias("median"))
    r = F.col("size") / F.col("median")
    kind = F.when((r >= 1.4) | is_chapter_heading(F.col("text")), "chapter").when((r > 1.2) | (F.col("bold") & (r >= 1)), "heading").when((r < 0.85) & (F.col("y") >= 0.8), "footnote").otherwise("text")
    return spans.join(median, "doc_id").withColumn("kind", kind).drop("median")


def transcript_lines(captions: DataFrame) -> DataFrame:
    """video, pos and "[m:ss] text" lines of caption JSON ({"events": [{"tStartMs": .., "segs": [{"utf8": ..}]}]})."""
    schema = "events array<struct<tStartMs:bigint,segs:array<struct<utf8:string>>>>"
    rows = captions.select("video", F.posexplode(F.from_json("body", schema)["events"]).alias("pos", "e")).filter("e.segs is not null")
    said = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: s["utf8"]), ""), r"\s+", " "))
    s = F.floor(F.col("e.tStartMs") / 1000).cast("int")
    return rows.select("video", "pos", F.format_string("[%d:%02d] %s", (s / 60).cast("int"), s % 60, said).alias("line"), said.alias("said")).filter("said <> ''").drop("said")


def graph_dump(spark: SparkSession, path: str) -> DataFrame:
    """label, key and name of node records in a dump ("(:Label {key: "..", name: ".."})"), over lines or not."""
    text = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(r'(?s)\(:(\w+)\s*\{\s*key:\s*"([^"]*)",\s*name:\s*"([^"]*)"\s*\}\)'), F.lit(0))
    rows = text.select(F.explode(found).alias("r"))
    part = lambda i: F.regexp_extract("r", r'(?s)\(:(\w+)\s*\{\s*key:\s*"([^"]*)",\s*name:\s*"([^"]*)"', i)
    return rows.select(part(1).alias("label"), part(2).alias("key"), part(3).alias("name"))


#: The relations that are restored from a dump and what they lead to.
DUMPED = {"EXPLORES_THEME": "Theme", "CONCEPT_USED_IN": "Concept", "REFERENCES_PERSON": "Person", "MAKES_ARGUMENT": "Argument"}


def dump_edges(spark: SparkSession, path: str, work_prefix: str = "") -> DataFrame:
    """src, type, label, dst, name, claim of the relations of passages in a dump of relations, packed or not.

    A record (`"Chunk", {..}, "RELATION", {..}, "Label", {..}`) may go over several lines, so the reader
    parts the file where a passage's record begins and records are read one by one; other records behind
    are cut off.  Kept are the relations of :data:`DUMPED`, of passages whose work begins with
    ``work_prefix``, that lead to a node with a canonical name.
    """
    rows = spark.read.option("lineSep", '\n"Chunk", {').text(path)
    record = F.element_at(F.split("value", r'(?m)^(?="[A-Za-z]+", \{)'), 1)
    parts = rows.select(record.alias("record")).withColumn("type", F.regexp_extract("record", r'\}, "([A-Z_]+)", \{', 1)).filter(F.col("type").isin(*DUMPED))
    target = r'(?s)\}, "[A-Z_]+", \{[^}]*\}, "([A-Za-z]+)", (\{.*)$'
    named = parts.select("record", "type", F.regexp_extract("record", target, 1).alias("label"), F.regexp_extract("record", target, 2).alias("blob"))
    value = lambda column, pattern: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    out = named.select(
        value("record", r'chunk_id: "([0-9a-fA-F-]{32,36})"').alias("src"), "type", "label", value("blob", r'canonical_name: "([^"]*)"').alias("dst"), value("blob", r'(?:[{ ])name: "([^"]*)"').alias("name"), value("blob", r'claim: "([^"]*)"').alias("claim"),
        value("record", r'work_id: "([^"]*)"').alias("work"),
    )
    wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DUMPED.items() for x in pair]), F.col("type")) == F.col("label"), F.lit(False))
    return out.filter(wanted & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.coalesce("work", F.lit("")).startswith(work_prefix)).drop("work")


def letters(docs: DataFrame) -> DataFrame:
    """doc_id, letter, number, recipient, date of scanned letters: each begins with "LETTER n. To NAME" and a date line."""
    parts = F.split("text", r"(?m)^(?=LETTER [0-9lIO]+\.)")
    rows = docs.select("doc_id", F.posexplode(F.filter(parts, lambda x: x.startswith("LETTER"))).alias("letter", "body"))
    raw = F.regexp_extract("body", r"^LETTER ([0-9lIO]+)\.", 1)
    return rows.select("doc_id", "letter", F.translate(raw, "lIO", "110").try_cast("int").alias("number"), F.regexp_extract("body", r"^LETTER [0-9lIO]+\. To ([^\n]+)", 1).alias("recipient"), F.regexp_extract("body", r"(?m)^[^\n]*?([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})", 1).alias("date"))


def external_metadata(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """Book metadata from a relational store over JDBC: title, authors joined, the longer ISBN first."""
    table = {n: spark.read.jdbc(url, n, properties=properties) for n in ("book", "author", "book_author")}
    names = table["book_author"].join(table["author"], "author_id").groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("authors"))
    return table["book"].join(names, "book_id", "left").select("book_id", "title", "authors", F.coalesce("isbn13", "isbn10").alias("isbn"))
