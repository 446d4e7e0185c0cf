"""Lookups, validation, routing, flags, dedup and set reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.scalar import confidence_tier, normalise_key, percent
from sieveline.operators import advisory, dedup, report, rules
from sieveline.plans.catalog import query
from sieveline.storage import table

#: A knowledge base of five of the six part types, so that the fallback is met.
KB = [
    ("standard", "Standard", 640.0, 14.0, ["peanuts", "fish"], "Everyday."),
    ("economy", "Economy", 300.5, None, [], ""),
    ("medium", "Medium Size", 741.5, 22.0, ["soy"], "Middling."),
    ("promo", "Promo", None, None, ["egg"], None),
    ("large", "Large", 582.0, 32.5, [], "Big."),
]
KB_SQL = "kb(class_key, display_name, calories_kcal, protein_g, allergens, health_notes) AS (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else c}::DOUBLE, {'NULL' if d is None else d}::DOUBLE, {e}::VARCHAR[], {'NULL' if f is None else repr(f)})" for a, b, c, d, e, f in KB) + ")"


def knowledge_base(spark: SparkSession) -> DataFrame:
    base = spark.createDataFrame(KB, "class_name string, display_name string, calories_kcal double, protein_g double, allergens array<string>, health_notes string")
    return base.withColumn("carbs_g", F.lit(None).cast("double")).withColumn("fat_g", F.lit(None).cast("double"))


@query(
    f"""WITH {KB_SQL}, d AS (SELECT replace(lower(trim(p_type)), ' ', '_') AS k, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT d.k AS class_key, coalesce(kb.display_name, upper(d.k[1]) || d.k[2:]) AS display_name, kb.class_key IS NOT NULL AS found_in_kb, count(*) AS detections,
       sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, count(*) FILTER (l_extendedprice > 30000) AS large FROM d LEFT JOIN kb ON d.k = kb.class_key GROUP BY ALL"""
)
def class_coverage_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections are counted by class first; only the counts meet the base."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    found = lines.join(parts, lines.l_partkey == parts.p_partkey).select(normalise_key(F.col("p_type")).alias("class_name"), "l_quantity", "l_extendedprice")
    sums = found.groupBy("class_name").agg(F.count(F.lit(1)).alias("detections"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count_if(F.col("l_extendedprice") > 30000).alias("large"))
    return advisory.lookup(sums, knowledge_base(spark)).select("class_key", "display_name", "found_in_kb", "detections", "quantity", "large")


@query(
    f"""WITH {KB_SQL}, d AS (SELECT p_brand, lower(p_type) AS k, p_partkey, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS n FROM part)
SELECT p_brand AS request, d.k AS class_key, p_partkey AS first_at, coalesce(display_name, upper(d.k[1]) || d.k[2:]) AS display_name, kb.class_key IS NOT NULL AS found_in_kb
FROM d LEFT JOIN kb ON d.k = kb.class_key WHERE n = 1"""
)
def lookup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("request"), F.col("p_type").alias("class_name"), F.col("p_partkey").alias("first_at"))
    return advisory.lookup_many(rows, knowledge_base(spark), "request", "first_at").select("request", "class_key", "first_at", "display_name", "found_in_kb")


@query(
    f"""WITH {KB_SQL}, d AS (SELECT p_brand, lower(p_type) AS k, min(p_partkey) AS o FROM part GROUP BY ALL),
l AS (SELECT p_brand, o, CASE WHEN kb.class_key IS NULL THEN '- ' || upper(d.k[1]) || d.k[2:] || ': No verified data available.' ELSE
  '- ' || display_name || ': ' || CASE WHEN calories_kcal IS NULL AND protein_g IS NULL THEN 'macros unavailable' ELSE concat_ws(', ', round_even(calories_kcal, 0)::BIGINT || ' kcal', round_even(protein_g, 0)::BIGINT || 'g protein') END || '.'
  || CASE WHEN len(allergens) > 0 THEN ' Allergens: ' || array_to_string(allergens, ', ') || '.' ELSE '' END || CASE WHEN coalesce(health_notes, '') <> '' THEN chr(10) || '  ' || health_notes ELSE '' END END AS line
  FROM d LEFT JOIN kb ON d.k = kb.class_key)
SELECT p_brand AS request, 'Summary based on our verified nutrition database:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY o) AS advisory FROM l GROUP BY p_brand
UNION ALL SELECT 'Brand#none', '{advisory.NO_DETECTION}'"""
)
def advisory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("request"), F.col("p_type").alias("class_name"), F.col("p_partkey").alias("o"))
    entries = advisory.lookup_many(rows, knowledge_base(spark), "request", "o")
    requests = rows.select("request").distinct().union(spark.createDataFrame([("Brand#none",)], "request string"))
    return advisory.advisories(requests, entries, "request", "o")


RECORDS = ["o_orderkey AS id", "cast(o_totalprice / 20 as bigint) AS file_bytes", "cast(200 + o_custkey % 900 as int) AS width", "cast(200 + o_orderkey % 700 as int) AS height", "cast(o_orderkey % 97 as double) AS blur_variance", "CASE WHEN o_orderkey % 50 = 0 THEN 'OSError' END AS decode_error"]
RECORDS_SQL = "SELECT o_orderkey AS id, floor(o_totalprice / 20)::BIGINT AS file_bytes, (200 + o_custkey % 900)::INT AS width, (200 + o_orderkey % 700)::INT AS height, (o_orderkey % 97)::DOUBLE AS blur, CASE WHEN o_orderkey % 50 = 0 THEN 'OSError' END AS err FROM orders"


@query(
    f"""WITH r AS ({RECORDS_SQL}), v AS (SELECT *, list_filter([CASE WHEN file_bytes < 2048 THEN 'file_too_small' END, CASE WHEN width < 256 THEN 'width_below_minimum' END, CASE WHEN height < 256 THEN 'height_below_minimum' END,
 CASE WHEN width * height > 40000000 THEN 'pixel_count_above_maximum' END, CASE WHEN greatest(width / greatest(height, 1), height / greatest(width, 1)) > 4 THEN 'extreme_aspect_ratio' END, CASE WHEN blur < 20 THEN 'likely_blurry' END, 'decode_error:' || err], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(list_filter(reasons, lambda x: x <> 'likely_blurry')) > 0 THEN 'rejected' ELSE 'pending' END AS status FROM v"""
)
def validation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.validate(table(spark, sf_dir, "orders").selectExpr(*RECORDS))
    return out.select("id", F.array_join("reasons", ",").alias("reasons"), "status")


SCORES = "array(named_struct('name', 'a', 'score', (o_orderkey % 41) / 100D), named_struct('name', 'b', 'score', (o_custkey % 37) / 100D), named_struct('name', 'c', 'score', (o_orderkey % 13) / 50D))"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    candidate = F.element_at(F.array(*map(F.lit, ["a", "b", "c", "z"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    blurry = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("likely_blurry"))).otherwise(F.array().cast("array<string>"))
    scores = F.when(F.col("o_orderkey") % 11 != 0, F.expr(SCORES))
    return rules.route_by_scores(orders.select(F.col("o_orderkey").alias("id"), candidate.alias("candidate_class"), blurry.alias("reasons"), scores.alias("scores")))


ROUTED_SQL = """r AS (SELECT o_orderkey AS id, (['a', 'b', 'c', 'z'])[o_orderkey % 4 + 1] AS cc, o_orderkey % 7 = 0 AS blurry, o_orderkey % 11 = 0 AS none,
  (o_orderkey % 41) / 100.0::DOUBLE AS a, (o_custkey % 37) / 100.0::DOUBLE AS b, (o_orderkey % 13) / 50.0::DOUBLE AS c FROM orders),
s AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS top, greatest(a, b, c) AS best, CASE cc WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c END AS own,
  CASE cc WHEN 'a' THEN greatest(b, c) WHEN 'b' THEN greatest(a, c) WHEN 'c' THEN greatest(a, b) END AS other FROM r),
t AS (SELECT *, CASE WHEN none THEN 'semantic_score_missing' WHEN own IS NULL THEN 'candidate_class_not_configured' WHEN own >= 0.22 AND own - other >= 0.02 AND blurry THEN 'manual_quality_review_required'
  WHEN own >= 0.22 AND own - other >= 0.02 THEN NULL WHEN best < 0.16 THEN 'semantic_score_too_low' WHEN top <> cc AND -(own - other) >= 0.04 THEN 'semantic_class_mismatch:' || top ELSE 'semantic_score_borderline' END AS why FROM s)"""


@query(
    f"""WITH {ROUTED_SQL} SELECT id, concat_ws(',', CASE WHEN blurry THEN 'likely_blurry' END, why) AS reasons,
 CASE WHEN why IS NULL THEN 'accepted' WHEN why LIKE 'semantic_score_too_low%' OR why LIKE 'semantic_class_mismatch%' THEN 'rejected' ELSE 'review' END AS status,
 CASE WHEN NOT none AND own IS NOT NULL THEN top END AS predicted_class, CASE WHEN NOT none THEN round(own, 4) END AS intended_score, CASE WHEN NOT none THEN round(own - other, 4) END AS score_margin FROM t"""
)
def semantic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _routed(spark, sf_dir)
    return out.select("id", F.array_join("reasons", ",").alias("reasons"), "status", "predicted_class", F.round("intended_score", 4).alias("intended_score"), F.round("score_margin", 4).alias("score_margin"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS k, md5(o_orderkey::VARCHAR) AS sha, (o_orderkey % 89) / 100.0::DOUBLE AS s, o_orderkey % 7 = 0 AS blurry FROM orders),
m(k, t) AS (VALUES ('1-URGENT', 0.5), ('2-HIGH', 0.3), ('3-MEDIUM', 0.88)),
d AS (SELECT o_orderpriority AS k, md5(o_orderkey::VARCHAR) AS sha, CASE WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS label FROM orders WHERE o_orderkey % 10 = 3)
SELECT id, m.t::DOUBLE AS calibration_threshold, coalesce(label, CASE WHEN m.t IS NOT NULL AND NOT blurry AND s >= m.t THEN 'accepted' ELSE 'manual_review' END) AS status,
 concat_ws(',', CASE WHEN blurry THEN 'likely_blurry' END, 'manual_decision_override:' || label) AS reasons FROM r LEFT JOIN m USING (k) LEFT JOIN d USING (k, sha)"""
)
def calibrated_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("candidate_class"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("sha256"))
    rows = orders.withColumn("calibration_score", (F.col("id") % 89) / F.lit(100.0)).withColumn("reasons", F.when(F.col("id") % 7 == 0, F.array(F.lit("likely_blurry"))).otherwise(F.array().cast("array<string>")))
    models = spark.createDataFrame([("1-URGENT", 0.5), ("2-HIGH", 0.3), ("3-MEDIUM", 0.88)], "class_name string, threshold double")
    decisions = orders.filter("id % 10 = 3").withColumn("label", F.when(F.col("id") % 2 == 0, "accepted").otherwise("rejected"))
    out = rules.override(rules.route_by_threshold(rows, models), decisions)
    return out.select("id", "calibration_threshold", "status", F.array_join("reasons", ",").alias("reasons"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'manual_review' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'semantic_filter_skipped' ELSE '' END AS reasons FROM orders"""
)
def unscored_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus")).alias("status"), F.array().cast("array<string>").alias("reasons"))
    return rules.route_unscored(rows, True).select("id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH b AS (SELECT o_orderkey AS id, o_orderpriority AS source, CASE WHEN l_orderkey IS NULL THEN NULL ELSE p_type END AS k, l_discount * 10 AS conf FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
s AS (SELECT id, (['STANDARD', 'ECONOMY', 'PROMO'])[id % 3 + 1] AS source, count(k) AS n, list(DISTINCT k) FILTER (k IS NOT NULL) AS ks, min(round(conf, 6)) AS low FROM b GROUP BY id),
f AS (SELECT id, concat_ws(',', CASE WHEN n = 0 THEN 'no_prediction' END, CASE WHEN n > 0 AND NOT list_contains(ks, source) THEN 'source_class_mismatch' END, CASE WHEN source = 'PROMO' THEN 'priority_class' END,
 CASE WHEN low < 0.4 THEN 'low_confidence_box' END, CASE WHEN len(ks) > 1 THEN 'multi_class_prediction' END) AS review_reasons FROM s)
SELECT id, review_reasons, CASE WHEN review_reasons <> '' THEN 'high' ELSE 'normal' END AS review_priority FROM f"""
)
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    boxes = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("p_type").alias("class_name"), (F.col("l_discount") * 10).alias("confidence"))).alias("boxes"))
    none = F.array().cast("array<struct<class_name:string,confidence:double>>")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(boxes, "id", "left").withColumn("boxes", F.coalesce("boxes", none))
    rows = rows.withColumn("source_class", F.element_at(F.array(*map(F.lit, ["STANDARD", "ECONOMY", "PROMO"])), (F.col("id") % 3 + 1).cast("int")))
    return rules.review_flags(rows, ["PROMO"]).select("id", F.array_join("review_reasons", ",").alias("review_reasons"), "review_priority")


@query(
    """WITH u AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'f' || event_id || (['.jpg', '.png', '.txt', ''])[event_id % 4 + 1] END AS name, (['image/jpeg', 'text/html', NULL])[event_id % 3 + 1] AS kind, floor(value * 100)::BIGINT AS size FROM events)
SELECT id, CASE WHEN name IS NULL THEN 'missing_filename' WHEN lower(regexp_extract(name, '(\\.[^./]*)$', 1)) NOT IN ('.jpg', '.png') THEN 'unsupported_extension' WHEN kind IS NOT NULL AND kind NOT IN ('image/jpeg', 'image/png') THEN 'unsupported_type'
 WHEN size > 5000 THEN 'too_large' WHEN size = 0 THEN 'empty' END AS complaint, CASE WHEN size / 10000.0 >= 0.75 THEN 'high' WHEN size / 10000.0 >= 0.5 THEN 'medium' ELSE 'low' END AS tier, floor(size / 10000.0 * 100 + 0.5)::BIGINT AS percent FROM u"""
)
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))
    name = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("f"), F.col("event_id").cast("string"), pick([".jpg", ".png", ".txt", ""], 4)))
    size = F.floor(F.col("value") * 100).cast("long")
    share = size / F.lit(10000.0)
    gate = rules.upload_gate(name, pick(["image/jpeg", "text/html", None], 3), size, [".jpg", ".png"], ["image/jpeg", "image/png"], 5000)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), gate.alias("complaint"), confidence_tier(share).alias("tier"), percent(share).alias("percent"))


@query("""SELECT CASE WHEN grouping(k) = 1 THEN NULL ELSE k END AS candidate_class, status, count(*) AS n FROM (SELECT event_type AS status, (user_id % 3)::VARCHAR AS k FROM events) GROUP BY GROUPING SETS ((status), (k, status))""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), (F.col("user_id") % 3).cast("string").alias("candidate_class")))


COPIES_SQL = "d AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN quality IS NULL THEN [] ELSE ['q' || quality, 't' || toxic] END AS l FROM documents LEFT JOIN labels USING (doc_id))"


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the digest of their text, with label lines; null texts are a class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic")).alias("labels"))
    return docs.join(labels, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("source", F.col("doc_id").cast("string"))


@query(
    f"""WITH {COPIES_SQL},
e AS (SELECT *, max({{'n': len(l), 'at': -doc_id, 'own': list_sort(l)}}) OVER (PARTITION BY sha ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d),
f AS (SELECT *, len(l) > 0 AND b.n > 0 AND list_sort(l) <> b.own AS clash FROM e)
SELECT sha AS sha256, arg_max(doc_id, {{'n': len(l), 'at': -doc_id}}) AS doc_id, count(*) AS copies, coalesce(bool_or(clash), false) AS annotation_conflict FROM f GROUP BY sha"""
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(copies(spark, sf_dir), order="doc_id").select("sha256", "doc_id", "copies", "annotation_conflict")


@query(f"WITH {COPIES_SQL} SELECT sha AS sha256, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS nth, doc_id::VARCHAR AS source FROM d")
def exact_dedup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.class_sources(copies(spark, sf_dir), order="doc_id")


@query("""SELECT sha256(text) AS sha256, count(DISTINCT source) AS classes FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def class_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("source").alias("class_name"))
    return dedup.class_conflicts(docs)


@query(
    """SELECT 'labels_missing' AS "check", count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'labels_extra', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'customers_missing', count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'members', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""
)
def set_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        count("labels_missing", docs.join(labels, "doc_id", "left_anti")),
        count("labels_extra", labels.join(docs, "doc_id", "left_anti")),
        count("customers_missing", customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select("c_custkey").distinct()),
        count("members", docs.join(labels, "doc_id", "left_semi")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
