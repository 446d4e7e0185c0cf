"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.storage import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; one row reaches the driver."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("src", "dst").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(row)


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge; label is the least node of its
    component. edges: (src, dst), without loops, in any direction. Rounds
    grow with the logarithm of the longest path; each is written to the
    shared folder."""
    now = cut(edges.select("src", "dst"))
    state = _state(now)
    while state[0]:
        now = cut(_small(_large(now)))
        new = _state(now)
        if new == state:
            break
        state = new
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(roots)
