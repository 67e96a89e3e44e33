"""The link graph of segments: nodes with labels and anchors, edges by internal links, and its exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .render import first_titles


def nodes(segments: DataFrame, assigned: DataFrame) -> DataFrame:
    """doc_id, seg_idx, label, anchors (sorted): anchors are HTML ones and the ids of the segment's heading blocks."""
    text = F.col("raw").cast("string")
    heads = assigned.where("kind = 'heading'").groupBy("doc_id", "seg_idx").agg(F.collect_set(T.heading_id(F.coalesce("title", "text"))).alias("ids"))
    joined = segments.select("doc_id", "seg_idx", "heading_path", "raw").join(first_titles(assigned), ["doc_id", "seg_idx"], "left").join(heads, ["doc_id", "seg_idx"], "left")
    first_line = F.try_element_at(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^\s*$")), F.lit(1))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), first_line, F.lit(""))
    anchors = F.array_sort(F.array_union(T.html_anchors(text), F.coalesce("ids", F.array().cast("array<string>"))))
    return joined.select("doc_id", "seg_idx", T.label(title, F.col("heading_path")).alias("label"), anchors.alias("anchors"))


def edges(segments: DataFrame, node_table: DataFrame) -> DataFrame:
    """doc_id, from_seg, to_seg, type: one for each internal link to another segment; the last owner of an anchor wins."""
    owners = node_table.select("doc_id", "seg_idx", F.explode("anchors").alias("anchor")).groupBy("doc_id", "anchor").agg(F.max("seg_idx").alias("to_seg"))
    refs = segments.select("doc_id", F.col("seg_idx").alias("from_seg"), F.posexplode(T.internal_links(F.col("raw").cast("string"))).alias("nth", "anchor"))
    return refs.join(owners, ["doc_id", "anchor"]).where("from_seg <> to_seg").select("doc_id", "from_seg", "to_seg", F.lit("link").alias("type"), "nth")


def _lines(rows: DataFrame, line: str, *order: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), "").alias("text"))


def index_markdown(named: DataFrame, edge_table: DataFrame) -> DataFrame:
    """doc_id, index_md from named nodes (doc_id, seg_idx, filename, label): a table of segments and a Mermaid graph."""
    n = F.col("seg_idx") + 1
    table = _lines(named.select("doc_id", "seg_idx", F.format_string("| %d | [%s](%s) | %s |\n", n, "filename", "filename", "label").alias("line")), "line", "seg_idx")
    boxes = _lines(named.select("doc_id", "seg_idx", F.format_string('  %d["%d. %s"]\n', "seg_idx", n, T.short_label(F.col("label"))).alias("line")), "line", "seg_idx")
    order = Window.partitionBy("doc_id").orderBy("seg_idx")
    steps = named.select("doc_id", "seg_idx", F.lead("seg_idx").over(order).alias("next")).where("next is not null")
    steps = _lines(steps.select("doc_id", "seg_idx", F.format_string("  %d --> %d\n", "seg_idx", "next").alias("line")), "line", "seg_idx")
    refs = _lines(edge_table.select("doc_id", "from_seg", "nth", F.format_string("  %d -.->|%s| %d\n", "from_seg", "type", "to_seg").alias("line")), "line", "from_seg", "nth")
    joined = table.withColumnRenamed("text", "t").join(boxes.withColumnRenamed("text", "b"), "doc_id").join(steps.withColumnRenamed("text", "s"), "doc_id", "left").join(refs.withColumnRenamed("text", "r"), "doc_id", "left")
    body = F.concat(F.lit("# Index\n\n| # | File | Section |\n|---|------|--------|\n"), F.col("t"), F.lit("\n## Graph\n\n```mermaid\ngraph LR\n"), F.col("b"), F.coalesce("s", F.lit("")), F.coalesce("r", F.lit("")), F.lit("```\n"))
    return joined.select("doc_id", body.alias("index_md"))


def dot(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """doc_id, dot: the graph in DOT."""
    quoted = F.replace("label", F.lit('"'), F.lit('\\"'))
    boxes = _lines(node_table.select("doc_id", "seg_idx", F.format_string('  %d [label="%s"];\n', "seg_idx", quoted).alias("line")), "line", "seg_idx")
    refs = _lines(edge_table.select("doc_id", "from_seg", "nth", F.format_string('  %d -> %d [label="%s"];\n', "from_seg", "to_seg", "type").alias("line")), "line", "from_seg", "nth")
    joined = boxes.join(refs.withColumnRenamed("text", "r"), "doc_id", "left")
    return joined.select("doc_id", F.concat(F.lit("digraph segments {\n  rankdir=LR;\n"), F.col("text"), F.coalesce("r", F.lit("")), F.lit("}\n")).alias("dot"))


def graph_json(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """doc_id, graph: nodes and edges as JSON; empty anchors are left out, edges are never null."""
    n = node_table.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seg_idx").alias("id"), "label", F.when(F.size("anchors") > 0, F.col("anchors")).alias("anchors")))).alias("nodes"))
    e = edge_table.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("from_seg").alias("from"), "nth", F.col("to_seg").alias("to"), "type"))).alias("e"))
    shown = F.transform(F.coalesce("e", F.array().cast("array<struct<from: int, nth: int, to: int, type: string>>")), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["type"].alias("type")))
    return n.join(e, "doc_id", "left").select("doc_id", F.to_json(F.struct("nodes", shown.alias("edges"))).alias("graph"))
