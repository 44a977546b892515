"""Connected components of a link table, by joins and small aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklane.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(u, v)``; the component is its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths shorten by
    half or more. Labels are written to the shared folder after each round; the driver sees one count a round.
    """
    edges = written(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("j"))
        new = written(step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("j", "c")).alias("component")), "labels")
        labels = new.select("node", "component")
        if not new.filter("old <> component").limit(1).count():
            return labels
