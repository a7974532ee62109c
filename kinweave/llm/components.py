"""Connected components of a table of links, by label passing and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Each round, a node takes the smallest label among its own and its neighbours' labels, and then
    that label's own label, so chains shorten by half. Every round is written to the shared folder;
    rounds end when no label changes. Only the number of changes, counted while a round is written, reaches
    the driver.
    """
    both = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("node", "old", F.coalesce("further", "component").alias("component"))
        new, seen = scratch.save_with(step, moved=(F.col("old") != F.col("component")).cast("int"))
        scratch.drop(now)
        now = new
        if not seen["moved"]:
            scratch.drop(both)
            return now.select("node", "component")


def joined(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`label`, a table (node, component) as `components` gives it (None: no nodes yet), after further links
    (a, b): only the components that these links join are gone through, each as one node."""
    if label is None:
        return components(links, scratch)
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch)
    moved = over.select(F.col("node").alias("component"), F.col("component").alias("new"))
    old = label.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return scratch.save(old.union(over.join(label, "node", "left_anti").select("node", "component")))
