"""Connected components of an edge list, by label propagation with pointer jumping; nothing but a checksum reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_ROWS, cut, skew_join


def components(edges: DataFrame, most_rounds: int = 60, hot_rows: int = HOT_ROWS, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component. Repeated edges and loops do no harm.

    The edges are evaluated once: each must come both ways, even if another evaluation would give other edges of the same components.
    Each round a node takes the least label around it, then its label's label. Minima are taken before the shuffle, and nodes join their hub or root
    by skew_join, so that neither a hub nor the root of a giant component gathers its nodes in one task.
    """
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut(edges.select(F.explode(F.array(there, back)).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    last, spread = None, {"by_key_rows": labels.count(), "hot_rows": hot_rows, "most_broadcast": most_broadcast}
    for _ in range(most_rounds):
        seen = skew_join(both, labels.withColumnRenamed("node", "a"), "a", **spread).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(seen, "node").select("node", F.least("root", "near").alias("root"))
        if spread["by_key_rows"] > most_broadcast:  # it is read three times, or twice and cheaply
            moved = cut(moved)
        up = moved.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = cut(skew_join(moved, up, "root", **spread).select("node", F.least("root", "above").alias("root")))
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")), F.count(F.lit(1))).first()
        if now == last:
            return labels
        last = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
