"""Connected components of a link table by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of links (a, b). Every round is a written table.

    A round gives each node the smallest label among its neighbours and then that label's own label, so
    that paths halve; it ends when no label changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = materialize(near, "near")
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = materialize(step, "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = materialize(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"), "labels")
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels
