"""Overlaps, greedy matching, precision and recall, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import box_text, box_to_centre, centre_to_box
from sieveline.operators import detect_eval
from sieveline.plans.catalog import query
from sieveline.storage import table

#: Confidences and overlaps of suppression that a calibration tries.
GRID = [round(0.05 + k * 0.01, 4) for k in range(91)]
NMS = [0.5, 0.6, 0.7]
_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

BOXES_SQL = f"""b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey // 8, l_suppkey % 3 ORDER BY {', '.join(_COLUMNS)}) AS ord, l_orderkey // 8 AS image, l_suppkey % 3 AS class_id,
 l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 20 + l_tax * 100 AS x2, l_discount * 100 + 15 AS y2, (l_discount + l_tax / 10) * 9 AS conf FROM lineitem),
t AS (SELECT image, class_id, ord, x1, y1, x2, y2 FROM b WHERE l_returnflag = 'N'), p AS (SELECT image, class_id, ord, x1, y1, x2, y2, conf FROM b WHERE l_returnflag <> 'N'),
o AS (SELECT p.image, p.class_id, p.ord AS p, t.ord AS g, conf, greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS i,
 (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM p JOIN t USING (image, class_id)),
u AS (SELECT image, class_id, p, g, conf, i / (s - i) AS iou FROM o WHERE i / (s - i) >= 0.5)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(truth, predictions) made of all line items: eight orders are an image,
    so that images stay small at any size. Items have no key; rows are numbered
    over all columns within an image and class."""
    image, kind = F.floor(F.col("l_orderkey") / 8), F.col("l_suppkey") % 3
    rows = table(spark, sf_dir, "lineitem").withColumn("image", image).withColumn("class_id", kind)
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("image", "class_id").orderBy(*_COLUMNS)))
    left, top = F.col("l_quantity"), F.col("l_discount") * 100
    rows = rows.select("image", "class_id", "ord", "l_returnflag", "l_linenumber", left.alias("x1"), top.alias("y1"), (left + 20 + F.col("l_tax") * 100).alias("x2"), (top + 15).alias("y2"), ((F.col("l_discount") + F.col("l_tax") / 10) * 9).alias("conf"))
    return rows.filter("l_returnflag = 'N'"), rows.filter("l_returnflag <> 'N'")


@query(f"WITH {BOXES_SQL} SELECT class_id, count(*) AS pairs, round(sum(iou), 2) AS iou_sum, round(max(iou), 6) AS iou_max FROM u GROUP BY class_id")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_eval.overlaps(*boxes(spark, sf_dir), 0.5)
    return found.groupBy("class_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("iou"), 2).alias("iou_sum"), F.round(F.max("iou"), 6).alias("iou_max"))


MATCH_SQL = f"""{BOXES_SQL}, r AS (SELECT image, class_id, list({{'c': -conf, 'p': p, 'o': -iou, 'g': g}} ORDER BY -conf, p, -iou, g) AS r FROM u GROUP BY image, class_id),
f AS (SELECT image, class_id, list_reduce(list_prepend([{{'p': -1::BIGINT, 'g': -1::BIGINT}}], list_transform(r, lambda x: [{{'p': x.p, 'g': x.g}}])),
 lambda a, x: CASE WHEN len(list_filter(a, lambda m: m.p = x[1].p OR m.g = x[1].g)) > 0 THEN a ELSE list_concat(a, x) END) AS m FROM r),
m AS (SELECT image, class_id, unnest(m[2:]) AS m FROM f)"""


@query(f"WITH {MATCH_SQL} SELECT image, class_id, count(*) AS tp, sum(m.p * 1000 + m.g)::BIGINT AS digest FROM m GROUP BY image, class_id")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_eval.greedy_matches(detect_eval.overlaps(*boxes(spark, sf_dir), 0.5))
    rows = found.select("image", "class_id", F.explode("matches").alias("m"))
    return rows.groupBy("image", "class_id").agg(F.count(F.lit(1)).alias("tp"), F.sum(F.col("m.p") * 1000 + F.col("m.g")).alias("digest"))


SWEEP_SQL = f"""{MATCH_SQL}, grid AS (SELECT unnest({GRID}) AS threshold), j AS (SELECT p.class_id, p.conf, (m.image IS NOT NULL)::INT AS hit FROM p LEFT JOIN m ON m.image = p.image AND m.class_id = p.class_id AND m.m.p = p.ord),
k AS (SELECT DISTINCT class_id FROM (SELECT class_id FROM p UNION ALL SELECT class_id FROM t)), gt AS (SELECT class_id, count(*) AS gt FROM t GROUP BY class_id),
s AS (SELECT threshold, k.class_id, coalesce(sum(hit), 0)::BIGINT AS tp, (count(hit) - coalesce(sum(hit), 0))::BIGINT AS fp, (coalesce(any_value(gt), 0) - coalesce(sum(hit), 0))::BIGINT AS fn, coalesce(any_value(gt), 0) > 0 AS present
 FROM grid CROSS JOIN k LEFT JOIN j ON j.class_id = k.class_id AND j.conf >= threshold LEFT JOIN gt ON gt.class_id = k.class_id GROUP BY ALL)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_eval.sweep(*boxes(spark, sf_dir), GRID, 0.5)


@query(f"WITH {SWEEP_SQL} SELECT * FROM s")
def sweep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


SUMMARY_SQL = f"""{SWEEP_SQL}, c AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM s),
w AS (SELECT threshold, coalesce(avg(f1) FILTER (present), 0) AS macro_f1, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM c GROUP BY threshold)"""


@query(f"""WITH {SUMMARY_SQL} SELECT threshold, round(macro_f1, 4) AS macro_f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS micro_precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS micro_recall,
 round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS micro_f1 FROM w""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_eval.sweep_summary(_sweep(spark, sf_dir))
    return out.select("threshold", *[F.round(c, 4).alias(c) for c in ("macro_f1", "micro_precision", "micro_recall", "micro_f1")])


@query(f"WITH {SUMMARY_SQL} SELECT threshold, round(macro_f1, 4) AS macro_f1 FROM w ORDER BY w.macro_f1 DESC, threshold LIMIT 1")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = detect_eval.best_point(detect_eval.sweep_summary(_sweep(spark, sf_dir)))
    return best.select("threshold", F.round("macro_f1", 4).alias("macro_f1"))


@query("""SELECT p_partkey AS id, printf('%d %.8f %.8f %.8f %.8f', p_partkey % 6, (p_size + p_size + 40) / 2.0 / 500, (p_size + p_size + 25) / 2.0 / 375, 40 / 500.0, 25 / 375.0) AS line,
 round(((p_size + p_size + 40) / 2.0 / 500 - 40 / 500.0 / 2) * 500, 4)::DOUBLE AS x1 FROM part""")
def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("p_size").cast("double")
    cx, cy, w, h = box_to_centre(lo, lo, lo + 40, lo + 25, F.lit(500.0), F.lit(375.0))
    back = centre_to_box(cx, cy, w, h, F.lit(500.0), F.lit(375.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), box_text((F.col("p_partkey") % 6).cast("int"), cx, cy, w, h).alias("line"), F.round(back[0], 4).alias("x1"))


@query()
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 over confidences and overlaps of suppression."""
    truth, predictions = boxes(spark, sf_dir)
    return detect_eval.sweep_grid(truth, predictions, GRID, NMS, 0.5).select("nms_iou", "threshold", *[F.round(c, 4).alias(c) for c in ("macro_f1", "micro_precision", "micro_recall", "micro_f1")])
