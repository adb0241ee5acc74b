"""Connected components of a link table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its smallest node.

    Each round finds, over a node's links, the smallest label of a label, and offers it to the node and to the node that
    its label names; a node also takes the label of its label. So whole trees hook onto smaller ones while they grow
    flat, and long chains settle in some log(n) rounds. It ends when no label moves; every round is written to shared
    storage and the one before deleted.
    """
    both = settle(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
    labels = settle(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        before = labels
        above = before.select(F.col("node").alias("label"), F.col("label").alias("top"))
        now = before.select("node", "label").join(above, "label").select("node", "label", "top")
        least = both.join(now.select(F.col("node").alias("v"), "top"), "v").groupBy("u").agg(F.min("top").alias("least"))
        seen = now.join(least, now["node"] == least["u"]).select("node", "label", F.least("top", "least").alias("own"), "least")
        offers = F.array(F.struct("node", F.col("own").alias("label"), F.col("label").alias("old")), F.struct(F.col("label").alias("node"), F.col("least").alias("label"), F.lit(None).cast("long").alias("old")))
        offered = seen.select(F.explode(offers).alias("x")).select("x.*").groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        labels = settle(offered.select("node", F.least("label", "old").alias("label"), (F.least("label", "old") < F.col("old")).alias("moved")), "labels")
        release(before)
    release(both)
    out = labels.select("node", F.col("label").alias("component"))
    out._scratch = labels._scratch
    return out
