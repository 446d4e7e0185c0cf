"""Digests of whole tables, compared as trees.

Every row has a digest of all its columns, and a bucket by its key. The digest
of a set of rows is its count and sums of row digests, which neither the order
nor the place of rows changes; leaves are buckets, and a node of the level
above adds sixteen of them. Two tables are compared from the root down, one
level after the other: below equal nodes nothing is looked at. Rows are read
again in buckets that differ only, and there rows of both sides cancel out
against each other; no side is joined with the other.

Written packages are sorted by bucket, so that a filter on buckets skips what
it does not need, and bear their tree beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.storage import cut

#: Bits of a bucket, and by how many each level above has fewer.
DEPTH, FAN = 12, 4
SUMS = ("n", "a", "b")


def row_digests(df: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(key, bucket, a, b): a and b are 128 bits of all columns, in the order
    of their names. Nulls differ from empty texts."""
    told = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.select(F.col(key), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << depth)).cast("int").alias("bucket"), F.xxhash64(told).alias("a"), F.xxhash64(told, F.lit(1)).alias("b"))


def tree(digests: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, n, a, b): level 0 is the root, the last one has a node a
    bucket. Sums are of 64-bit numbers, exactly."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("a", "b")]]
    leaves = digests.groupBy("bucket").agg(*sums)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("bucket", depth - bits).alias("node")) for k, bits in enumerate(_levels(depth))])
    return leaves.select(F.explode(levels).alias("x"), *SUMS).groupBy("x.level", "x.node").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])


def _levels(depth: int) -> list[int]:
    return [*range(0, depth, FAN), depth]


def differing(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> list[int]:
    """Buckets in which two trees differ, found level by level. Each level
    sends the nodes that differ to the driver, 2 ** depth at most."""
    levels, open_ = _levels(depth), [0]
    for k, bits in enumerate(levels):
        a, b = (t.filter((F.col("level") == k) & F.col("node").isin(open_)).select("node", F.struct(*SUMS).alias(name)) for t, name in ((left, "x"), (right, "y")))
        differ = sorted(r["node"] for r in a.join(b, "node", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect())
        if k == len(levels) - 1 or not differ:
            return differ
        more = levels[k + 1] - bits
        open_ = [n << more | j for n in differ for j in range(1 << more)]
    return []


def drift(left: DataFrame, right: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(key, change): missing (in left only), extra (in right only) or changed.
    Rows count as often as they occur; a null key is a key."""
    a, b = row_digests(left, key, depth), row_digests(right, key, depth)
    return _drift(a, b, cut(tree(a, depth)), cut(tree(b, depth)), key, depth)


def _drift(a: DataFrame, b: DataFrame, of_a: DataFrame, of_b: DataFrame, key: str, depth: int) -> DataFrame:
    buckets = differing(of_a, of_b, depth)
    inside = lambda rows, sign: rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).withColumn("sign", F.lit(sign))
    rest = inside(a, 1).unionByName(inside(b, -1)).groupBy(key, "a", "b").agg(F.sum("sign").alias("n")).filter("n <> 0")
    sides = rest.groupBy(key).agg(F.max(F.col("n") > 0).alias("left"), F.max(F.col("n") < 0).alias("right"))
    return sides.select(key, F.when(F.col("left") & F.col("right"), "changed").when(F.col("left"), "missing").otherwise("extra").alias("change"))


def write_package(df: DataFrame, path: str, key: str, depth: int = DEPTH) -> None:
    """The rows of df, sorted by bucket, their digests and their tree."""
    digests = row_digests(df, key, depth).withColumnRenamed(key, "__key")
    told = df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << depth)).cast("int"))
    by = lambda rows, c: rows.repartitionByRange(F.col(c)).sortWithinPartitions(c)
    by(told, "__bucket").write.parquet(f"{path}/rows")
    by(digests.withColumnRenamed("__key", key), "bucket").write.parquet(f"{path}/digests")
    tree(digests, depth).write.parquet(f"{path}/tree")


def package_drift(spark: SparkSession, left: str, right: str, key: str, depth: int = DEPTH) -> DataFrame:
    """drift() of two written packages, from their trees and those parts of
    their digests that differ."""
    read = lambda path, name: spark.read.parquet(f"{path}/{name}")
    return _drift(read(left, "digests"), read(right, "digests"), read(left, "tree"), read(right, "tree"), key, depth)
