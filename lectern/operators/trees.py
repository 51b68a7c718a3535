"""Trees of document nodes as rows: paths, intervals, texts of subtrees, nodes by kind and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def with_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, parent, ord, kind, text, ref) and path: (ord, node) of every step from the root.

    A level at a time joins the one before, so there are as many rounds as levels; rows whose parent is
    not there are left out.
    """
    level = cut(nodes.filter("parent is null").withColumn("path", F.array(F.struct("ord", "node"))))
    levels, rest = [level], nodes.filter("parent is not null")
    while True:
        above = level.select("tree", F.col("node").alias("parent"), F.col("path").alias("above"))
        level = cut(rest.join(above, ["tree", "parent"]).withColumn("path", F.concat("above", F.array(F.struct("ord", "node")))).select(*levels[0].columns))
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def intervals(paths: DataFrame) -> DataFrame:
    """tree, node, kind, depth (0 for roots), first and last: a node's place in document order, and that of its last descendant."""
    order = Window.partitionBy("tree").orderBy("path")
    placed = paths.select("tree", "node", "kind", (F.size("path") - 1).alias("depth"), F.row_number().over(order).cast("long").alias("first"))
    sizes = paths.select("tree", F.explode("path.node").alias("node")).groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, ["tree", "node"]).withColumn("last", F.col("first") + F.col("n") - 1).drop("n")


def _under(paths: DataFrame) -> DataFrame:
    """Every node with each of its ancestors and itself as ``above``."""
    return paths.select("tree", F.explode("path.node").alias("above"), "node", "kind", "text", "ref", "path")


def subtree_texts(paths: DataFrame) -> DataFrame:
    """tree, node, text: the texts of a node and all below in document order, a line each, empty ones left out."""
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    rows = F.array_sort(F.collect_list(F.when(has, F.struct("path", "text"))))
    return _under(paths).groupBy("tree", F.col("above").alias("node")).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def found_below(paths: DataFrame, *kinds: str) -> DataFrame:
    """tree, above, node: the nodes of ``kinds`` at or below each node."""
    return _under(paths).filter(F.col("kind").isin(*kinds)).select("tree", "above", "node")


def notes(paths: DataFrame) -> DataFrame:
    """tree, above, ref, text: the notes at or below each node by their reference, or their node without one.

    A reference that comes again has the text of its last note, endnotes coming after footnotes.
    """
    texts = subtree_texts(paths).select("tree", "node", F.col("text").alias("whole"))
    mine = _under(paths).filter(F.col("kind").isin("footnote", "endnote")).join(texts, ["tree", "node"])
    keyed = mine.select("tree", "above", F.coalesce("ref", F.col("node").cast("string")).alias("ref"), F.struct((F.col("kind") == "endnote").alias("end"), "path").alias("at"), "whole")
    return keyed.groupBy("tree", "above", "ref").agg(F.max_by("whole", "at").alias("text"))


def line_trees(docs: DataFrame, short: int = 3) -> DataFrame:
    """Nodes of texts (tree, text): the document, its lines (headings of up to ``short`` words hold their text), and the sentences of the others."""
    line = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = docs.select("tree", F.posexplode(line).alias("at", "line")).withColumn("heading", F.size(F.split("line", r"\s+")) <= short)
    number = (F.col("at").cast("long") + 1) * 100_000_000  # lines of a document and sentences of a line are fewer
    none = F.lit(None).cast("string")
    root = docs.select("tree", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit("document").alias("kind"), none.alias("text"), none.alias("ref"))
    second = lines.select("tree", number.alias("node"), F.lit(0).cast("long").alias("parent"), F.col("at").cast("long").alias("ord"), F.when(F.col("heading"), "heading").otherwise("paragraph").alias("kind"), F.when(F.col("heading"), F.col("line")).alias("text"), none.alias("ref"))
    pieces = lines.filter("not heading").select("tree", "at", F.posexplode(F.transform(F.regexp_extract_all("line", F.lit("([^.!?]+[.!?]*)"), F.lit(1)), lambda x: F.trim(x))).alias("ord", "text"))
    third = pieces.select("tree", (number + F.col("ord") + 1).alias("node"), number.alias("parent"), F.col("ord").cast("long").alias("ord"), F.lit("sentence").alias("kind"), "text", none.alias("ref"))
    return root.unionByName(second).unionByName(third)


def line_subtrees(docs: DataFrame, short: int = 3) -> DataFrame:
    """tree, kind, first, last, sentences, text_key: :func:`intervals`, sentences below and digests of :func:`subtree_texts` of the inner nodes of :func:`line_trees`.

    A text's nodes are in one row from the start, so lines and the document are digested where the text is
    read, and only numbers and digests are moved to number the nodes.
    """
    line = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pieces = lambda x: F.transform(F.regexp_extract_all(x, F.lit("([^.!?]+[.!?]*)"), F.lit(1)), lambda y: F.trim(y))
    split = F.transform(line, lambda x: F.when(F.size(F.split(x, r"\s+")) <= short, F.struct(F.lit("heading").alias("kind"), F.array(x).alias("texts"))).otherwise(F.struct(F.lit("paragraph").alias("kind"), pieces(x).alias("texts"))))
    below = lambda x: F.when(x["kind"] == "paragraph", F.size(x["texts"]).cast("long")).otherwise(F.lit(0).cast("long"))
    text = lambda x: F.array_join(F.filter(x["texts"], lambda y: y != ""), "\n")
    lines = docs.select("tree", F.transform(split, lambda x: F.struct(x["kind"].alias("kind"), below(x).alias("sentences"), text(x).alias("text"))).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["sentences"])
    whole = F.array_join(F.filter(F.transform("lines", lambda x: x["text"]), lambda x: x != ""), "\n")
    node = lambda kind, step, span, sentences, text: F.struct(kind.alias("kind"), step.alias("step"), span.alias("span"), sentences.alias("sentences"), F.md5(text).alias("text_key"))
    root = node(F.lit("document"), F.lit(1).cast("long"), total + F.size("lines") + 1, total, whole)
    nodes = F.concat(F.array(root), F.transform("lines", lambda x: node(x["kind"], x["sentences"] + 1, x["sentences"] + 1, x["sentences"], x["text"])))
    rows = lines.select("tree", F.posexplode(nodes).alias("at", "n")).select("tree", "at", "n.*")
    before = F.sum("step").over(Window.partitionBy("tree").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("step")
    return rows.withColumn("first", before + 1).select("tree", "kind", "first", (F.col("first") + F.col("span") - 1).alias("last"), "sentences", "text_key")
