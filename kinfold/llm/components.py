"""Connected components of an edge table by repeated contraction, entirely as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import hot_join, stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) edges -> (node, component), component being the smallest node that can be reached.

    Each round hooks every node to the smallest of its neighbours and itself, follows those pointers,
    and replaces each edge by the edge between the pointers of its ends; edges inside one tree vanish.
    Every node that is not a local minimum is contracted, so the number of rounds is logarithmic in
    practice. Each round is a written table, so a lost executor costs one round at most. The centre of a
    star is a key of many rows: such keys are joined without moving their rows. Nodes without an edge do
    not appear. Null ends and self-loops are dropped.
    """
    e = stage(edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = stage(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")), name)
        for _ in range(2):
            far = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = stage(hot_join(hook, far, ["up"]).select("node", F.col("top").alias("up")), name)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        half = stage(hot_join(e, to("u"), ["u"]).select("v", "u_up"), name)
        met = hot_join(half, to("v"), ["v"]).where("u_up <> v_up")
        e = stage(met.select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v")).distinct(), name)
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            labels = stage(hot_join(labels, step, ["component"], how="left").select("node", F.coalesce("up", "component").alias("component")), name)
    if labels is None:
        return edges.sparkSession.createDataFrame([], f"node {e.schema['u'].dataType.simpleString()}, component {e.schema['u'].dataType.simpleString()}")
    return labels
