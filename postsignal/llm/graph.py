"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (a, b)``; ``label`` is the least node reachable.

    Each round gives a node the least label among its neighbours' and then that label's own label,
    until no link joins two labels. Nothing is gathered: a node with very many links only takes a
    minimum. Every round's labels are a written table.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    )
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(
            least.join(of, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        )
        open_links = (
            both.join(labels.withColumnsRenamed({"node": "a", "label": "x"}), "a")
            .join(labels.withColumnsRenamed({"node": "b", "label": "y"}), "b")
            .filter("x <> y")
        )
        if open_links.isEmpty():
            return labels
