"""Connected components of links, in rounds of joins that end when no label changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relspark.scratch import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Every round takes the smallest label among a node's neighbours and then that label's own label, so
    the rounds grow with the logarithm of a chain's length. Labels are written to the shared folder each
    round; the driver sees one number.
    """
    ways = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    edges = materialise(links.where(F.col(a) != F.col(b)).select(ways.alias("way")).select("way.u", "way.v").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "labels")
    while True:
        told = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("told"))
        nearer = labels.join(told, "node").select("node", "component", F.least("component", "told").alias("new"))
        of_label = labels.select(F.col("node").alias("new"), F.col("component").alias("beyond"))
        step = materialise(nearer.join(of_label, "new", "left").select("node", F.col("component").alias("before"), F.least("new", F.coalesce("beyond", "new")).alias("component")), "labels")
        changed = step.where("before <> component").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels


def merge(labels: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) after more links: only components that they join are looked at again."""
    of = lambda node, name: labels.select(F.col("node").alias(node), F.col("component").alias(name))
    mapped = links.join(of(a, "of_a"), a, "left").join(of(b, "of_b"), b, "left").select(F.coalesce("of_a", a).alias("u"), F.coalesce("of_b", b).alias("v"))
    joins = materialise(mapped.where("u <> v").distinct(), "merges")
    if not joins.limit(1).count():
        return labels
    top = components(joins, "u", "v")
    known = labels.join(top.select(F.col("node").alias("component"), F.col("component").alias("beyond")), "component", "left").select("node", F.coalesce("beyond", "component").alias("component"))
    return materialise(known.union(top.join(labels.select("node"), "node", "left_anti")), "labels")
