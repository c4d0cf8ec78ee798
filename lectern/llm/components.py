"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lectern.session import reliable_checkpoint

EDGES_PER_PARTITION = 200_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Connect every node's larger (or smaller) neighbours with the smallest of them all."""
    # Both directions of a row stay in its partition: one partition needs no exchange after it.
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    pairs = edges.select(F.inline(both))
    if large:
        smallest = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = pairs.filter(F.col("v") > F.col("u")).join(smallest, "u")
        return moved.select(F.col("m").alias("u"), "v").distinct()
    down = pairs.filter(F.col("v") < F.col("u"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(smallest, "u").select(F.col("m").alias("u"), "v")
    own = smallest.select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).unionByName(own).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and a sum over them, taken while writing.

    A task that is run again would be counted twice, which costs one more round at most: the
    sums of two rounds then differ.
    """
    seen = Observation()
    marks = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    stored = reliable_checkpoint(edges.observe(seen, *marks))
    return stored, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes with an edge; the component is its smallest node.

    ``edges`` has integer columns ``u`` and ``v``. Rounds grow with the logarithm of the
    longest path. Neighbours are never collected: a node's smallest neighbour is an
    aggregate, joined back to its edges.
    """
    current, state = _stored(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    while state[0]:
        # Edges only become fewer; a small graph is read in few partitions.
        parts = 1 + state[0] // EDGES_PER_PARTITION
        stars = _stars(_stars(current.coalesce(parts), large=True), large=False)
        current, new = _stored(stars)
        if new == state:
            break
        state = new
    return current.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
