"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.session import FIT_ROWS, stable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    # Turned round in place: a union would take an edge list of one partition apart.
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.inline(turned))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
    return linked.where("a > b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge and is not itself a root; ``root`` is the smallest node reached.

    ``edges`` has bigint columns ``a`` and ``b``.  A round contracts every tree to near half its height, so chains need
    a logarithmic number of rounds.  Rounds are cut by checkpoints; only a count and a hash of them reach the driver.
    Minima are combined before the exchange, and the joins that follow have one row per node on one side, so a hub
    with many neighbours is split like any skewed join.  Edges that fit one partition (``FIT_ROWS``) stay in it, so
    short lists need no exchange.
    """
    edges = stable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = edges.coalesce(-(-state[0] // FIT_ROWS))
        edges = stable(_small_star(_large_star(edges)).distinct())
        state, before = _state(edges), state
        if state == before:
            break
    edges = edges.coalesce(max(1, -(-state[0] // FIT_ROWS)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
