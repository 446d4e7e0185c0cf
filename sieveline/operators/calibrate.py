"""Centroids, scores, folds and thresholds under a precision constraint.

Vectors are arrays; sums over them go by element (posexplode, then a grouped
sum), which pre-aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import cosine, vector_norm
from sieveline.storage import cut


def normalised(v: Column) -> Column:
    # an array of one element names the norm, so that it is computed once a vector
    return F.get(F.transform(F.array(vector_norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def vector_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, total array<double>, n: element-wise sums of the vectors."""
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of the normalised vectors of each key, normalised again."""
    unit = df.select(*keys, normalised(F.col(vector)).alias("u"))
    return vector_sums(unit, keys, "u").select(*keys, normalised(F.transform("total", lambda x: x / F.col("n"))).alias("centroid"), "n")


def places(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """df with __at, the number of rows of its keys that come earlier in the
    order of a text, such as a digest. Counts by the first three characters
    come first, so that no key is ranked in one task."""
    rows = df.withColumn("__o", order.cast("string")).withColumn("__b", F.substring("__o", 1, 3))
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate([*keys, "__b"])], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    same = F.lit(True)
    for n, k in enumerate([*keys, "__b"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    within = Window.partitionBy(*keys, "__b").orderBy("__o")
    return rows.join(starts, same).withColumn("__at", F.col("__s") + F.row_number().over(within) - 1).select(*df.columns, "__at")


def folds(df: DataFrame, label: str, key: Column, k: int) -> DataFrame:
    """Stratified folds: rows of each label in the order of a seeded hash,
    written as text."""
    return places(df, [label], key).withColumn("fold", F.col("__at") % k).drop("__at")


def precision_threshold(df: DataFrame, keys: list[str], score: str, positive: str, target: float, least: int) -> DataFrame:
    """keys, threshold, precision, recall, coverage, accepted: the lowest
    score from which on at least ``least`` rows are taken at ``target``
    precision; if there is none, just above the highest score. Scores are
    first summed by value and sorted by a range shuffle; running sums go from
    part to part of it, so that no class has to fit in one task."""
    values = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("tp"))
    values = cut(values.repartitionByRange(*[F.col(k) for k in keys], F.desc(score)).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.groupBy(*keys, "__part").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    starts = parts.select(*keys, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ("n", "tp")])
    above = Window.partitionBy(*keys, "__part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    running = values.join(starts, [*keys, "__part"]).select(*keys, score, *[(F.col(f"__{c}") + F.sum(c).over(above)).alias(c) for c in ("n", "tp")])
    good = (F.col("n") >= least) & (F.col("tp") / F.col("n") >= target)
    best = running.groupBy(*keys).agg(F.max(F.when(good, F.struct("n", "tp", F.col(score).alias("s")))).alias("b"), F.max(score).alias("top"), F.max("n").alias("rows"), F.max("tp").alias("positives"))
    found = F.col("b").isNotNull()
    return best.select(
        *keys,
        F.when(found, F.col("b.s")).otherwise(F.col("top") + 1e-6).alias("threshold"),
        F.when(found, F.col("b.tp") / F.col("b.n")).otherwise(1.0).alias("precision"),
        F.when(found & (F.col("positives") > 0), F.col("b.tp") / F.col("positives")).otherwise(0.0).alias("recall"),
        F.when(found, F.col("b.n") / F.col("rows")).otherwise(0.0).alias("coverage"),
        F.when(found, F.col("b.n")).otherwise(0).cast("long").alias("accepted"),
    )


def require_usable(df: DataFrame, vector: str) -> None:
    """Raise if a vector has no length or a value that is no number."""
    bad = F.coalesce(vector_norm(F.col(vector)), F.lit(0.0)) == 0
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    row = df.agg(F.count_if(F.coalesce(odd, F.lit(True))).alias("odd"), F.count_if(bad & ~F.coalesce(odd, F.lit(True))).alias("zero")).first()
    if row["odd"]:
        raise ValueError(f"{row['odd']} vectors hold values that are not finite")
    if row["zero"]:
        raise ValueError(f"{row['zero']} vectors have length zero")


def centroid_score(vector: Column, positive: Column, negative: Column) -> Column:
    return cosine(vector, positive) - cosine(vector, negative)


def calibrate(df: DataFrame, vector: str, class_column: str, accepted: str, order: Column, target: float, k: int, least: int) -> DataFrame:
    """One row a class: threshold (the larger of the out-of-fold and the full
    one, at 8 digits) with the out-of-fold figures. Centroids of a fold are
    the total less the fold's own sum. Classes need two rows of each kind."""
    if not 0.5 <= target <= 1:
        raise ValueError("target precision lies between 0.5 and 1")
    rows = df.select(F.col(class_column).alias("class_name"), F.col(accepted).cast("boolean").alias("pos"), F.col(vector).alias("v"), order.alias("o"))
    sizes = rows.groupBy("class_name").agg(F.count_if("pos").alias("np"), F.count_if(~F.col("pos")).alias("nn")).filter("np >= 2 and nn >= 2")
    sizes = sizes.withColumn("k", F.least(F.lit(k), "np", "nn"))
    # vectors are dealt and written once, as they came; four steps read them
    dealt = cut(places(rows.join(sizes, "class_name"), ["class_name", "pos"], F.col("o")).select("class_name", "pos", (F.col("__at") % F.col("k")).alias("fold"), "v"))
    dealt = dealt.select("class_name", "pos", "fold", normalised(F.col("v")).alias("u"))
    per_fold = vector_sums(dealt, ["class_name", "pos", "fold"], "u")
    total = vector_sums(dealt, ["class_name", "pos"], "u")
    less = per_fold.withColumnRenamed("total", "part").withColumnRenamed("n", "part_n").join(total, ["class_name", "pos"])
    out_of = less.select("class_name", "pos", "fold", F.zip_with("total", "part", lambda a, b: a - b).alias("c"))
    wide = lambda df, keys: df.groupBy(*keys).agg(F.max_by("c", F.col("pos").cast("int")).alias("p"), F.min_by("c", F.col("pos").cast("int")).alias("q"))
    oof = dealt.join(wide(out_of, ["class_name", "fold"]), ["class_name", "fold"]).withColumn("s", centroid_score(F.col("u"), F.col("p"), F.col("q")))
    full = dealt.join(wide(total.withColumnRenamed("total", "c"), ["class_name"]), "class_name").withColumn("s", centroid_score(F.col("u"), F.col("p"), F.col("q")))
    first = precision_threshold(oof, ["class_name"], "s", "pos", target, least)
    second = precision_threshold(full, ["class_name"], "s", "pos", target, least).select("class_name", F.col("threshold").alias("full_threshold"))
    return first.join(second, "class_name").select("class_name", F.round(F.greatest("threshold", "full_threshold"), 8).alias("threshold"), "precision", "recall", "coverage", "accepted")
