"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutymark.llm.common import saved


def _edges(a, b, df: DataFrame) -> DataFrame:
    """Distinct edges of df, smaller node first, without loops."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


def star(df: DataFrame, node: str, hubs: str) -> DataFrame:
    """Edges (a, b) that connect each node with all of its hubs: one to the least hub, and distinct ones from there to the others."""
    least = df.groupBy(node).agg(F.min(hubs).alias("low"), F.collect_set(hubs).alias("all"))
    ends = F.explode(F.concat(F.array(node), "all"))
    return _edges(F.col("low"), F.col("end"), least.select("low", ends.alias("end")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, label), label the smallest node of its component; nodes without an edge to another are left out.

    Each round gives every node the least neighbour, then that one's least neighbour, as its parent, and replaces
    the edges by distinct ones between parents: they get fewer with each round until none is left. Then the parents of all
    rounds are followed from the last to the first. Rounds are written to the shared folder; only whether edges are left comes to
    the driver.
    """
    live = saved(_edges(F.col("a"), F.col("b"), edges), "edges")
    ups: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent"))
        above = near.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        ups.append(saved(near.join(above, "parent").select("node", F.col("top").alias("parent")), "parents"))
        of = lambda side: ups[-1].select(F.col("node").alias(side), F.col("parent").alias(f"{side}_up"))
        live = saved(_edges(F.col("a_up"), F.col("b_up"), live.join(of("a"), "a").join(of("b"), "b")), "edges")
    if not ups:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    label = ups[-1].withColumnRenamed("parent", "label")
    for up in reversed(ups[:-1]):
        label = up.join(label.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("label", "parent").alias("label"))
    return label
