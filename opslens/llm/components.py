"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslens.llm.staging import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Over links (a, b) with a > b: every neighbour above a node links to the smallest node around it. Links may come twice."""
    upwards = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = links.unionByName(upwards).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return upwards.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Over links (a, b) with a > b: every neighbour below a node, and the node, link to the smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    both = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return links.join(least, "a").select(both.alias("x")).select("x.a", "x.b").where("a <> b").distinct()


def _print(links: DataFrame) -> tuple:
    """Number and sum of hashes of distinct links, which stand for the set of them."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that links lead to.

    Rounds are written to the shared folder, so lineage stays short; there are about as many as the logarithm of the longest
    path. A node with a third of all links is a sum and a join that may split, never a group in one task.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = staged(both, "links"), (0, None)  # no links need no round
    while (print_of_now := _print(now)) != before:
        # each star by itself: the driver keeps and renews a plan for every step, and one of both would hold the first three times
        now, before = staged(_small_star(staged(_large_star(now), "large-stars")), "stars"), print_of_now
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that ``known`` (node, component) comes from and of more ``links`` (a, b). Only links between
    different components take part in the rounds."""
    def named(c: str) -> DataFrame:
        return known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))

    met = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    met = met.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    more = staged(components(met), "merged")
    moved = known.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(more.join(known, "node", "left_anti"))
