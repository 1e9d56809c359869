"""Connected components by alternating large-star and small-star rounds; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import cut_lineage

#: Rows of one key that one task handles, at about; and the least number of slices of a key.
SLICE_ROWS = 100_000
LEAST_SLICES = 32


def slices(rows: int) -> int:
    return max(LEAST_SLICES, -(-rows // SLICE_ROWS))


def with_least(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Adds m, the least value of the row's key. A key's rows are dealt in n slices by their value: no task has a hub's."""
    sliced = df.withColumn("slice", F.pmod(F.xxhash64(value, F.lit(9)), F.lit(n)))
    part = sliced.groupBy(key, "slice").agg(F.min(value).alias("m"))
    whole = part.groupBy(key).agg(F.min("m").alias("m"))
    spread = part.select(key, "slice").join(whole, key)  # at most n rows a key
    return sliced.join(spread, [key, "slice"]).drop("slice")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    A node's neighbours are never gathered: each round takes their minimum in slices, and joins it back to the
    slices. Rounds are checkpointed; their number grows with the logarithm of the size. Loops and null ends are
    left out.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = _state(e)
    for _ in range(most_rounds):
        n = slices(state[0])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", n).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a > b").distinct()
        moved = with_least(large, "a", "b", n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        e = cut_lineage(moved.where("a > b").distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not converge")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
