"""Connected components of a link table, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs, undirected); root is the component's smallest node.

    Each round every node takes the smallest label around it and then that
    label's own label (pointer jumping), until nothing changes. Labels are a
    written table after every round; a node's links are reduced by partial
    aggregation, and joins have an exchange on both sides, so a node or label
    with very many rows is split by AQE.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        around = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near")))
        taken = stage(labels.join(around, F.col("node") == F.col("a"))
                      .select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")), "labels")
        above = taken.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = stage(taken.join(above, F.col("root") == F.col("up"))
                       .select("node", F.least("root", "top").alias("root"),
                               (F.col("moved") | (F.col("top") < F.col("root"))).alias("moved")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return labels
