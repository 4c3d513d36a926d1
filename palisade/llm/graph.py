"""Connected components of links between nodes, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links of a node beyond which they are dealt to SALTS tasks.
HUB = 5000
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links lead to) for each node of links (a, b).

    Each round the labels' labels around a node are taken by the node and by its own label (which hooks whole trees
    onto smaller ones), then every label gives way to its own. So rounds grow with the logarithm of a chain's
    length: 7 or 8 for 100 nodes, 18 or 19 for 100,000. Labels only get smaller; rounds go on until none does.
    A hub's labels are combined before they are shuffled, and its links are dealt to several tasks."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = stored(both.withColumn("salt", F.pmod(F.hash("a"), F.lit(SALTS))))
    # at most one node for each HUB links
    hubs = stored(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(F.col("b").alias("node")))
    dealt = hubs.limit(1).count() > 0
    if dealt:
        hub = hubs.select(F.col("node").alias("b"), F.lit(True).alias("hub"))
        both = stored(both.join(hub, "b", "left").withColumn("salt", F.when(F.col("hub"), F.col("salt")).otherwise(0)).drop("hub"))

    def told(labels: DataFrame) -> DataFrame:
        """Links with the label's label of their b."""
        if not dealt:
            return both.join(labels, both["b"] == labels["node"])
        every = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        own = labels.join(hubs.withColumn("hub", F.lit(True)), "node", "left").withColumn("part", F.explode(every))
        return both.join(own, (both["b"] == own["node"]) & (both["salt"] == own["part"]))

    least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = stored(least.withColumn("above", F.col("label")))
    while True:
        near = told(labels).groupBy("a").agg(F.min("above").alias("near"))
        met = labels.join(near, labels["node"] == near["a"])
        own = F.struct("node", F.least("label", "above", "near").alias("c"), F.col("label").alias("was"))
        hooked = F.struct(F.col("label").alias("node"), F.col("near").alias("c"), F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        step = met.select(F.explode(F.array(own, hooked)).alias("x")).groupBy("x.node").agg(F.min("x.c").alias("c"), F.max("x.was").alias("was"))
        step = stored(step)
        if step.where("c < was").limit(1).count() == 0:
            return step.select("node", F.col("c").alias("component"))
        up = step.select(F.col("node").alias("up"), F.col("c").alias("above"))
        labels = stored(step.join(up, step["c"] == up["up"]).select("node", F.col("c").alias("label"), "above"))
