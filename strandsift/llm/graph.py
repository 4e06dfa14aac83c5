"""Connected components on DataFrames by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: node, component (the least node reachable) for every node that occurs.

    Each round hooks every root to its least neighbouring root, flattens these chains by pointer
    jumping and contracts the links; rounds end when no link joins two roots. Nulls are ignored and
    repeated links count once.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    links = C.materialize(links, "links")
    labels = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        up = C.materialize(up, "hook")
        while True:
            far = up.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            jumped = up.join(far, F.col("up") == F.col("n2")).select("node", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved"))
            jumped = C.materialize(jumped, "jump")
            moved = jumped.where("moved").limit(1).count()
            up = jumped.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = up.withColumnRenamed("up", "component")
        else:
            r = up.select(F.col("node").alias("root"), "up")
            labels = C.materialize(labels.join(r, F.col("component") == F.col("root"), "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        left = up.select(F.col("node").alias("na"), F.col("up").alias("ra"))
        right = up.select(F.col("node").alias("nb"), F.col("up").alias("rb"))
        links = links.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb")).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = C.materialize(links, "links")
        if not links.limit(1).count():
            return labels
