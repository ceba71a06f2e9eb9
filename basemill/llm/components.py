"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, own: Scratch) -> DataFrame:
    """``links`` (a, b: long) to (node, component): each node that has a link, and the smallest node it reaches.

    In each round every node takes the label of its smallest neighbour, and of that one's, and the links are contracted
    to links between labels, without loops and repeats. The larger end of a link always gets another label, so links
    shrink in every round until none is left. Labels are minima, which are aggregated before they are shuffled; both
    sides of the joins are tables, so the adaptive planner splits the rows of a node with very many links. The result
    is a table of ``own``.
    """
    edges = own.table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = own.table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("x")).select("x.*")
        first = own.table(ends.groupBy("node").agg(F.min("near").alias("up")), "labels")
        up = own.table(first.join(first.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), "labels")
        of = lambda c, up=up: up.select(F.col("node").alias(c), F.col("top").alias(f"{c}_up"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("a_up <> b_up")
        next_edges = own.table(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        labelled = own.table(found.join(of("component"), "component", "left").select("node", F.coalesce("component_up", "component").alias("component")), "labels")
        own.drop(edges, first, up, found)
        edges, found = next_edges, labelled
    own.drop(edges)
    return found
