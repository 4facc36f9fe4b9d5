"""Connected components of an edge table, by contraction towards smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id that can be reached.

    Each round every node points at its smallest neighbour (or itself), pointers are followed
    twice over, and edges are contracted to the nodes pointed at.  Rounds end when no edge is
    left; a chain shrinks at least fourfold a round, a star in one.  Each round's state is a
    written table.  Nulls and loops are no edges; an empty table gives no rows.
    """
    pairs = edges.toDF("a", "b").where("a != b")
    left = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not left.isEmpty():
        both = left.unionAll(left.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        up = materialise(up, "pointers")
        for _ in range(2):
            hop = up.select(F.col("id").alias("to"), F.col("to").alias("next"))
            up = up.join(hop, "to").select("id", F.col("next").alias("to"))
        up = materialise(up, "pointers")
        if label is None:
            label = up.select("id", F.col("to").alias("component"))
        else:
            moved = label.join(up.select(F.col("id").alias("component"), "to"), "component", "left")
            label = materialise(moved.select("id", F.coalesce("to", "component").alias("component")), "labels")
        a, b = (up.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        contracted = left.join(a, "a").join(b, "b").where("to_a != to_b")
        left = materialise(contracted.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if label is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label
