"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch.llm.common import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of the component of every node in ``edges`` (a, b).

    Each round every node moves to the neighbour of least hash (or stays, if it
    is that itself), and the edges move along; edges inside one node vanish.
    The hashed order lets a constant share of the nodes merge in a round,
    chains too. Rounds are written tables; nothing is collected but "any left?".
    """
    # The order of the moves: a hash, then the node itself.
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, f"{name}-edges")
    where = None  # node -> where it has moved to
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        moves = moves.select(F.col("a").alias("node"), F.least(F.col("least"), rank("a"))["node"].alias("to"))
        moves = written(moves, f"{name}-moves")
        if where is None:
            where = moves
        else:
            next_ = moves.select(F.col("node").alias("to"), F.col("to").alias("further"))
            where = where.join(next_, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
            where = written(where, f"{name}-where")
        for side in ("a", "b"):
            edges = edges.join(moves.select(F.col("node").alias(side), F.col("to").alias("_to")), side).withColumn(side, F.col("_to")).drop("_to")
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = written(edges, f"{name}-edges")
    if where is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = where.groupBy("to").agg(F.min("node").alias("root"))
    return written(where.join(least, "to").select("node", "root"), name)
