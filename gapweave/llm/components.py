"""Connected components of a table of links by contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """New labels (node, label) after links (a, b) between labels: the smallest label of all that hang together.

    Each round, every label takes its smallest neighbour's name, and links between labels of one name leave. All of a
    component's labels end as its smallest. Nodes keep their label where no link reaches. Rounds grow with the
    logarithm of the longest chain; counts are of links, never of pairs. ``labels`` itself comes back where there is no
    link, and its files stay in any case.
    """
    given, edges = labels, materialise(links.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hooks")
        renamed = materialise(labels.join(hook, labels.label == hook.a, "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        first = edges.join(hook, "a").select("b", F.col("to").alias("x"))
        second = first.join(hook.withColumnsRenamed({"a": "b", "to": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        left = materialise(second.where("a <> b").distinct(), "edges")
        discard(edges, hook, *([labels] if labels is not given else []))
        labels, edges = renamed, left
    discard(edges)
    return labels
