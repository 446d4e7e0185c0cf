"""Detector evaluation: matching by overlap, precision, recall, F1, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import iou
from sieveline.storage import cut

BOX = ("x1", "y1", "x2", "y2")


def overlaps(truth: DataFrame, predictions: DataFrame, least: float, keys: tuple[str, ...] = ("image", "class_id")) -> DataFrame:
    """keys, p, g, conf, iou of pairs within an image and class that overlap
    at least so much."""
    t = truth.select(*keys, F.col("ord").alias("g"), F.struct(*BOX).alias("tb"))
    p = predictions.select(*keys, F.col("ord").alias("p"), "conf", F.struct(*BOX).alias("pb"))
    box = lambda c: {k: F.col(f"{c}.{k}") for k in BOX}
    return p.join(t, [*keys]).withColumn("iou", iou(box("pb"), box("tb"))).filter(F.col("iou") >= least).drop("tb", "pb")


def greedy_matches(pairs: DataFrame, keys: tuple[str, ...] = ("image", "class_id")) -> DataFrame:
    """keys, matches array<(p, g)>: predictions by falling confidence (then
    order) take the free truth with the largest overlap, the first of equal
    ones. A fold over the few pairs of one image and class."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), F.col("p"), (-F.col("iou")).alias("o"), F.col("g"))))
    none = F.array().cast("array<struct<p:long,g:long>>")
    take = lambda acc, x: F.when(F.exists(acc, lambda m: (m["p"] == x["p"]) | (m["g"] == x["g"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["p"].cast("long").alias("p"), x["g"].cast("long").alias("g")))))
    return pairs.groupBy(*keys).agg(ranked.alias("r")).select(*keys, F.aggregate("r", none, take).alias("matches"))


def suppress(predictions: DataFrame, overlap: float, keys: tuple[str, ...] = ("image", "class_id")) -> DataFrame:
    """Predictions without those that overlap a kept one of their image and
    class by more than ``overlap``, taken by falling confidence, then order."""
    columns = [*BOX, "conf", "ord"]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), F.col("ord").alias("o"), F.struct(*columns).alias("x"))))
    box = lambda b: {k: b[k] for k in BOX}
    grouped = predictions.groupBy(*keys).agg(F.transform(ranked, lambda r: r["x"]).alias("r"))
    kept = F.aggregate("r", F.filter("r", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: iou(box(x), box(y)) > overlap), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.*")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1; 0 where a denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def sweep(truth: DataFrame, predictions: DataFrame, grid: list[float], least: float) -> DataFrame:
    """threshold, class_id, tp, fp, fn, present for every point of the grid.

    Predictions are taken in order of confidence, so the greedy matching of a
    higher threshold is the beginning of that of a lower one: one matching
    serves the whole grid, and a point only counts what lies above it."""
    keys = ("image", "class_id")
    matched = greedy_matches(overlaps(truth, predictions, least)).select(*keys, F.explode("matches").alias("m")).select(*keys, F.col("m.p").alias("ord"), F.lit(1).alias("hit"))
    judged = predictions.select(*keys, F.col("ord").cast("long").alias("ord"), "conf").join(matched, [*keys, "ord"], "left").select("class_id", "conf", F.coalesce("hit", F.lit(0)).alias("hit"))
    points = F.array(*[F.lit(float(g)) for g in grid])
    counted = judged.groupBy("class_id", F.size(F.filter(points, lambda g: g <= F.col("conf"))).alias("level")).agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("n"))
    numbered = [(k, float(g)) for k, g in enumerate(sorted(grid))]
    spark = truth.sparkSession
    points_df = F.broadcast(spark.createDataFrame(numbered, "k int, threshold double"))
    sums = counted.join(points_df, F.col("level") > F.col("k")).groupBy("threshold", "class_id").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    total = truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("gt"))
    classes = total.select("class_id").unionByName(predictions.select("class_id")).distinct()
    out = classes.crossJoin(points_df.select("threshold")).join(sums, ["threshold", "class_id"], "left").join(total, "class_id", "left")
    zero = F.lit(0).cast("long")
    tp, n, gt = (F.coalesce(c, zero) for c in ("tp", "n", "gt"))
    return out.select("threshold", "class_id", tp.alias("tp"), (n - tp).alias("fp"), (gt - tp).alias("fn"), (gt > 0).alias("present"))


def sweep_summary(points: DataFrame) -> DataFrame:
    """threshold, macro_f1 (classes present in the truth), micro figures."""
    rows = points.select("threshold", "present", "tp", "fp", "fn", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    sums = rows.groupBy("threshold").agg(F.coalesce(F.avg(F.when(F.col("present"), F.col("f1"))), F.lit(0.0)).alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("threshold", "macro_f1", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"))


def sweep_grid(truth: DataFrame, predictions: DataFrame, grid: list[float], overlaps_: list[float], least: float) -> DataFrame:
    """nms_iou and the summary of a sweep over predictions suppressed at it,
    for each of a few overlaps. Boxes and what each suppression keeps are read
    several times, so both are written once."""
    truth, predictions, out = cut(truth), cut(predictions), None
    for overlap in overlaps_:
        own = sweep_summary(sweep(truth, cut(suppress(predictions, overlap)), grid, least)).withColumn("nms_iou", F.lit(float(overlap)))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no overlap to try")
    return out


def best_of_grid(summary: DataFrame) -> DataFrame:
    """The point with the largest macro F1 of a grid; of equal ones that of the
    smallest overlap, then of the smallest threshold."""
    return summary.agg(F.max_by(F.struct(*summary.columns), F.struct("macro_f1", -F.col("nms_iou"), -F.col("threshold"))).alias("b")).select("b.*")


def best_point(summary: DataFrame, reference_ties: bool = False) -> DataFrame:
    """The point with the largest macro F1, the first of equal ones. With
    ``reference_ties``, an unrounded candidate meets an incumbent that was
    rounded to five digits, in the order of thresholds (a grid is short)."""
    if not reference_ties:
        return summary.agg(F.max_by(F.struct(*summary.columns), F.struct("macro_f1", -F.col("threshold"))).alias("b")).select("b.*")
    ordered = summary.agg(F.array_sort(F.collect_list(F.struct("threshold", *[c for c in summary.columns if c != "threshold"]))).alias("a"))
    start = F.get("a", F.lit(0))
    pick = F.aggregate(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), start, lambda acc, x: F.when(x["macro_f1"] > F.round(acc["macro_f1"], 5), x).otherwise(acc))
    return ordered.select(pick.alias("b")).select("b.*")
