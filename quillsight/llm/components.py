"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a, b); a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours, then twice the label of that label (pointer
    jumping), until nothing changes. Labels stay in tables; only whether any changed reaches the driver. Minima are pre-aggregated before they
    are shuffled, so a hub costs no task its whole neighbourhood.
    """
    both = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        for _ in range(2):
            lower = lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component"))
        moved = materialize(lower, "labels")
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links: only the graph of components is worked on."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    merged = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = merged.select(F.col("component").alias("node"), F.col("to").alias("component")).join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionAll(new), "labels")
