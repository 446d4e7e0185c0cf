"""Exact dedup with a representative and a conflict flag.

What a row's class holds before it is a prefix: the labelled row that stood
there, and how many came. Prefixes are found by a segmented scan. Rows are
sorted by (digest, order) into ranges of like size, so that a digest with half
of all rows is dealt to many parts; each part sums up its digests; of a digest
that runs on into other parts, what the parts before hold is carried over.
There are two such digests a part at most, which bounds what is broadcast.
Classes are then added up, partly before the shuffle, and the sources of a
class are rows and never one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import cut


def prefix_scan(df: DataFrame, sha: str = "sha256", order: str = "ord", labels: str = "labels") -> DataFrame:
    """df with nth (place in its class, from 1) and annotation_conflict:
    whether a row with labels differs, as a set, from the row with most label
    lines, the first of equal ones, that came before it. Rows without a digest
    are a class; orders are without ties."""
    own = F.array_sort(F.array_distinct(labels))
    rank = F.struct(F.size(labels).alias("n"), (-F.col(order)).alias("at"), own.alias("own"))
    rows = df.withColumns({"__key": F.coalesce(F.col(sha).cast("string"), F.lit("")), "__rank": rank})
    rows = cut(rows.repartitionByRange(F.col("__key"), F.col(order)).sortWithinPartitions("__key", order).withColumn("__part", F.spark_partition_id()))
    parts = cut(rows.groupBy("__key", "__part").agg(F.max("__rank").alias("best"), F.count(F.lit(1)).alias("n")))
    on = parts.groupBy("__key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("__key")
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.join(on, "__key").select("__key", "__part", F.max("best").over(earlier).alias("__best"), F.sum("n").over(earlier).alias("__n"))
    within = Window.partitionBy("__part", "__key").orderBy(order)
    rows = rows.join(F.broadcast(carry), ["__key", "__part"], "left")
    before = F.greatest(F.col("__best"), F.max("__rank").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumns({"nth": F.coalesce("__n", F.lit(0)) + F.row_number().over(within), "__before": before})
    clash = (F.size(labels) > 0) & (F.col("__before.n") > 0) & (F.col("__rank.own") != F.col("__before.own"))
    return rows.withColumn("annotation_conflict", F.coalesce(clash, F.lit(False))).drop("__key", "__part", "__rank", "__best", "__n", "__before")


def exact_dedup(df: DataFrame, sha: str = "sha256", order: str = "ord", labels: str = "labels") -> DataFrame:
    """One row a sha: the row with most label lines, the first of equal ones,
    with copies and annotation_conflict: whether a row with labels differed
    from the labelled representative that stood when it came."""
    grouped = prefix_scan(df, sha, order, labels).groupBy(sha).agg(
        F.max_by(F.struct(*[c for c in df.columns if c != sha]), F.struct(F.size(labels), -F.col(order))).alias("__best"),
        F.count(F.lit(1)).alias("copies"),
        F.max("annotation_conflict").alias("annotation_conflict"),
    )
    return grouped.select(sha, "__best.*", "copies", "annotation_conflict")


def class_sources(df: DataFrame, sha: str = "sha256", order: str = "ord", labels: str = "labels", source: str = "source") -> DataFrame:
    """(sha, nth, source): the sources of each class, in order."""
    return prefix_scan(df, sha, order, labels).select(sha, "nth", source)


def class_conflicts(df: DataFrame, sha: str = "sha256", class_column: str = "class_name") -> DataFrame:
    """Shas that stand under more than one class."""
    return df.groupBy(sha).agg(F.count_distinct(class_column).alias("classes")).filter("classes > 1")
