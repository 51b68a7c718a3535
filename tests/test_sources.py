import io
import re
import zipfile
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import PLANS, ingest
from lectern.sources import files, sinks

from .conftest import SMALL


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<p:package xmlns:p="x" xmlns:d="http://purl.org/dc/elements/1.1/"><p:metadata><d:title>Book</d:title></p:metadata><p:manifest><p:item id="a" href="a.html"/><p:item id="b" href="b.html"/></p:manifest><p:spine><p:itemref idref="b"/><p:itemref idref="a"/></p:spine></p:package>')
        z.writestr("o/a.html", "<body><h1>Two</h1><p>x</p></body>")
        z.writestr("o/b.html", "<body><h1>One</h1><h2>S</h2><p>y &amp; z</p></body>")
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{p("C", "Heading1")}{p("S", "Heading2")}{p("text")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_folder_of_all_kinds(spark, tmp_path):
    for name, raw in {"a.epub": epub(), "b.docx": docx(), "c.txt": b"Chapter 1\n\nSome text\nhere.\n\nTHE END\n\nmore", "d.html": b"<title>T</title><nav>no</nav><main><h1>H</h1><p>yes<script>no</script></p></main><p>outside</p>", "e.bad": b"", "f.epub": b"broken"}.items():
        (tmp_path / name).write_bytes(raw)
    rows = files.read_folder(spark, str(tmp_path)).orderBy("doc_id", "node_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id.rpartition("/")[2], []).append((r.node_type, r.parent_id, r.text))
    assert by["a.epub"] == [("document", -1, "Book"), ("chapter", 0, "One"), ("section", 1, "S"), ("paragraph", 2, "y & z"), ("chapter", 0, "Two"), ("paragraph", 4, "x")]
    assert by["b.docx"][1:] == [("chapter", 0, "C"), ("section", 1, "S"), ("paragraph", 2, "text"), ("table_row", 2, "a | b")]
    assert [n[0] for n in by["c.txt"]] == ["document", "chapter", "paragraph", "section", "paragraph"]
    assert by["d.html"] == [("document", -1, "T"), ("chapter", 0, "H"), ("paragraph", 1, "yes")]
    assert by["f.epub"][0][0] == "error" and "e.bad" not in by
    assert files.listing(spark, str(tmp_path)).count() == 5


def test_unknown_extension_is_an_error(spark):
    frame = spark.createDataFrame([("x.bad", bytearray(b""))], "path string, content binary")
    with pytest.raises(Exception, match="no parser"):
        files.parse(frame).collect()


def test_text_blocks_spans_captions_letters_dump(spark, tmp_path):
    blocks = files.text_blocks(spark.createDataFrame([(1, "Chapter IV\n\nBody text.\n\nTHE SEA")], "doc_id long, text string")).orderBy("pos").collect()
    assert [b.kind for b in blocks] == ["chapter", "paragraph", "section"]
    spans = spark.createDataFrame([(1, 10.0, False, 0.5, "a"), (1, 10.0, True, 0.5, "b"), (1, 14.0, False, 0.1, "c"), (1, 8.0, False, 0.9, "d"), (1, 10.0, False, 0.9, "e")], "doc_id long, size double, bold boolean, y double, text string")
    assert {r.text: r.kind for r in files.classified_spans(spans).collect()} == {"a": "text", "b": "heading", "c": "chapter", "d": "footnote", "e": "text"}
    body = '{"events": [{"tStartMs": 61000, "segs": [{"utf8": "hi "}, {"utf8": "there"}]}, {"tStartMs": 1}]}'
    assert [r.line for r in files.transcript_lines(spark.createDataFrame([("v", body)], "video string, body string")).collect()] == ["[1:01] hi there"]
    text = "front\nLETTER l2. To A Friend\n3 May 1920\nDear\nLETTER 13. To B\nno date"
    got = files.letters(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("letter").collect()
    assert [(r.number, r.recipient, r.date) for r in got] == [(12, "A Friend", "3 May 1920"), (13, "B", "")]
    (tmp_path / "d.cypher").write_text('CREATE (:Theme {key: "a",\n name: "A b"})\n(:Work {key: "w", name: "W"})')
    assert sorted(map(tuple, files.graph_dump(spark, str(tmp_path)).collect())) == [("Theme", "a", "A b"), ("Work", "w", "W")]


def test_table_writes(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path / "t"), "k int, v string", ["k"])
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    assert t.read().count() == 0
    t.append(make((1, "a"), (2, "b")))
    t.upsert(make((2, "c"), (3, "d")))
    t.insert_absent(make((3, "x"), (4, "e")))
    t.update(F.col("k") == 1, {"v": F.lit("z")})
    assert t.delete(F.col("k") == 4) == 1
    assert sorted(map(tuple, t.read().collect())) == [(1, "z"), (2, "c"), (3, "d")]


def test_table_writes_touch_their_buckets_only(spark, tmp_path):
    """Random writes against a dictionary; buckets without a written key keep their files; a dead writer changes nothing."""
    import random

    r, folder = random.Random(5), tmp_path / "t"
    t, held = sinks.Table(spark, str(folder), "k int, v string", ["k"], buckets=8), {}
    make = lambda rows: spark.createDataFrame(list(rows), "k int, v string")
    t.append(make([(i, "first") for i in range(40)]))
    held = {i: "first" for i in range(40)}
    for step in range(4):
        rows = {r.randrange(60): f"v{step}" for _ in range(3)}
        before = t._files()
        t.upsert(make(rows.items()))
        held |= rows
        changed = {k for k, some in t._files().items() if before.get(k) != some}
        assert changed == {x[0] for x in make(rows.items()).select(t._bucket()).distinct().collect()} and len(changed) <= 3
        assert {x.k: x.v for x in t.read().collect()} == held
    gone = {k for k, v in held.items() if v == "v1"}
    assert t.delete(F.col("v") == "v1") == len(gone)
    held = {k: v for k, v in held.items() if k not in gone}
    (folder / "gen-999999990" / "_bucket=0").mkdir(parents=True)  # no marker: its writer died
    assert {x.k: x.v for x in t.read().collect()} == held
    t.vacuum()
    assert {x.k: x.v for x in t.read().collect()} == held and not (folder / "gen-999999990").exists()
    t.update(F.col("k") < 5, {"v": F.lit("low")})
    t.replace(t.read().filter("k < 3"))
    assert {x.k: x.v for x in t.read().collect()} == {k: "low" for k in held if k < 3}
    assert sinks.Table(spark, str(tmp_path / "none"), "k int, v string", ["k"]).read().count() == 0


def test_captures_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source_url": "https://x", "mode": "quick"}\n{"source_url": "ftp://x", "mode": "quick"}\nbroken\n{"source_url": "https://y", "mode": "odd"}\n')
    good, bad = sinks.captures_of(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 3
    sinks.write_reports(spark.createDataFrame([("a\nb",)], "report string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a\\nb"]


def test_section_types_by_content_of_very_long_lines(spark):
    line, entries = "Word" + " words" * 200_000, "Word words 1" + ", 12" * 200_000
    texts = ["\n".join([x] * 5) for x in (line, line + ", 7", entries, entries + " x", "Word, 1-2,3", "Word A\t, 12,", "Word 12x")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = dict(map(tuple, rows.select("id", T.section_type_by_content(F.col("text"))).collect()))
    want = ["index" if re.match(T.INDEX_LINE, x.split("\n")[0]) else None for x in texts]
    assert [got[i] for i in range(len(texts))] == want == [None, "index", "index", None, "index", None, None]


def test_section_types_of_parsed_files():
    index = "\n\n".join(f"Hope of{'x' * i}, {i}, {i + 3}-{i + 9}" for i in range(1, 7))
    nodes = files.parse_txt(f"Preface: On It\n\nfirst words\n\nChapter 1\n\n{index}\n\nEPILOGUE\n\nlast".encode())
    assert [(k, s) for _, _, k, s, _ in nodes if k != "paragraph"] == [("document", None), ("paragraph", None)][:1] + [("chapter", "index"), ("chapter", "back_matter")]
    page = files.parse_html(b"<body><h1>Works Cited</h1><p>Smith, A Book (1990)</p><h2>Notes</h2><p>x</p></body>")
    assert [s for *_, s, _ in page] == [None, "bibliography", "bibliography", "back_matter", "back_matter"]


def test_every_stored_page_is_parsed(spark):
    import html
    import re

    from lectern.plans import PLANS

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    nodes = {}
    for r in files.parse(spark.createDataFrame([(f"{x.page_id}.html", bytearray(x.html.encode())) for x in rows], "path string, content binary")).collect():
        nodes.setdefault(int(r.doc_id.split(".")[0]), []).append(r)
    assert len(PLANS["parse_html_files"](spark, "/root/testdata/sf0.001").collect()) == len(rows) == len(nodes)
    for x in rows:
        title = html.unescape(re.search("(?is)<title>(.*?)</title>", x.html)[1])
        assert nodes[x.page_id][0].text == " ".join(title.split())
        bare = " ".join(html.unescape(re.sub("(?s)<[^>]*>", " ", re.sub("(?is)<(script|style)\\b.*?</\\1>", " ", x.html))).split())
        squeezed = re.sub(r"\s+", "", bare)
        assert all(re.sub(r"\s+", "", n.text) in squeezed for n in nodes[x.page_id] if n.node_type == "paragraph")


def test_a_defect_of_any_kind_is_an_error_row(spark):
    import io
    import zipfile

    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'/>")
    rows = spark.createDataFrame([("a.docx", bytearray(empty.getvalue())), ("b.epub", bytearray(b"PK\x03\x04broken")), ("c.txt", bytearray(b"\xff\xfe ok"))], "path string, content binary")
    got = {r.doc_id: r.node_type for r in files.parse(rows).filter("node_id = 0").collect()}
    assert got == {"a.docx": "error", "b.epub": "error", "c.txt": "document"}


def test_files_are_parsed_to_rows_of_nodes_and_summed_without_a_shuffle(spark):
    rows = [("1.epub", epub()), ("2.docx", docx()), ("3.epub", b"no zip"), ("4.txt", b""), ("5.html", b"<title>t</title><p>a</p>"), ("6.txt", "CHAPTER 1\n\nII.\n\nx|\u00e9".encode())]
    frame = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").coalesce(1)
    nodes = {}
    for r in files.parse(frame).collect():
        assert r.node_id == r.ord == len(nodes.setdefault(r.doc_id, []))
        nodes[r.doc_id].append((r.parent_id, r.depth, r.node_type, r.section_type, r.text))
    want = {p: files.PARSERS[p.split(".")[1]](c) if p[0] != "3" else [(-1, 0, "error", None, nodes[p][0][4])] for p, c in rows}
    assert nodes == want
    for most in (1, 4, 256):
        books = files.parsed(frame, most)
        assert {r.doc_id: [tuple(n)[1:2] + tuple(n)[3:] for n in r.nodes] for r in books.collect()} == want
    found = ingest.summed(books)
    kinds = lambda p, k: sum(n[2] == k for n in want[p])
    assert {tuple(r) for r in found.collect()} == {(int(p[0]), *(kinds(p, k) for k in ("chapter", "section", "paragraph")), md5("|".join(n[4] for n in want[p]).encode()).hexdigest()) for p in want}
    for name in ("parse_epub_files", "parse_docx_files", "parse_text_files"):
        assert "Exchange" not in PLANS[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
