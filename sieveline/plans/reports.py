"""Coverage, revisions, merges, audits, web pages, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import web
from sieveline.operators import advisory, audit, merge, package, report, sample
from sieveline.plans.catalog import query
from sieveline.plans.splits import records
from sieveline.storage import table


@query(
    """WITH m AS (SELECT o_orderpriority AS k, (['annotated', 'missing', 'rejected', 'annotated'])[o_orderkey % 4 + 1] AS s, o_orderkey % 3 AS b, 1 + o_custkey % 2 AS n FROM orders),
d(class_id, class_name) AS (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'), (5, '6-EMPTY'))
SELECT class_id, class_name, count(k) AS images, count(*) FILTER (s = 'annotated') AS annotated, coalesce(sum(b) FILTER (s = 'annotated'), 0)::BIGINT AS boxes, count(*) FILTER (s = 'missing') AS missing,
 coalesce(sum(n), 0)::BIGINT AS source_occurrences, coalesce(sum(n), 0)::BIGINT - count(k) AS exact_duplicates_collapsed FROM d LEFT JOIN m ON k = class_name AND s <> 'rejected' GROUP BY ALL"""
)
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["annotated", "missing", "rejected", "annotated"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class_name"), status.alias("annotation_status"), (F.col("o_orderkey") % 3).alias("bbox_count"), (F.col("o_custkey") % 2 + 1).alias("n_sources"))
    dim = spark.createDataFrame([*enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-EMPTY"])], "class_id int, class_name string")
    return report.coverage(rows, dim)


@query("""SELECT user_id AS run, arg_max(event_id, {'m': value, 'e': -event_id}) AS best_map, arg_max(event_id, {'m': value % 7, 'e': -event_id}) AS best_map50, max(event_id) AS last_epoch FROM events GROUP BY user_id""")
def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("map"), (F.col("value") % 7).alias("map50"))
    return report.best_epochs(runs)


@query("""WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n > 1) AS multi_groups, sum(n) FILTER (n > 1)::BIGINT AS multi_images FROM s""")
def leakage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.leakage_stats(records(spark, sf_dir))


@query(
    """WITH k AS (SELECT l_orderkey, list(DISTINCT p_type) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
t AS (SELECT o_orderstatus AS from_class, CASE WHEN c IS NULL THEN '' WHEN len(c) = 1 THEN c[1] ELSE '*' END AS to_class FROM orders LEFT JOIN k ON l_orderkey = o_orderkey) SELECT from_class, to_class, count(*) AS n FROM t GROUP BY ALL"""
)
def class_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = lines.groupBy("l_orderkey").agg(F.collect_set("p_type").alias("classes"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("old_class"))
    rows = orders.join(kinds, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
    return report.transitions(rows)


@query("""SELECT coalesce(max(CASE WHEN regexp_matches(p_name, '^[0-9]+$') THEN p_name::BIGINT END), 0) + 1 AS next_index FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS p_name FROM part)""")
def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name"))
    return report.next_index(table(spark, sf_dir, "part").select(stem.alias("stem")))


@query(
    """WITH d AS (SELECT source AS split, CASE WHEN n_chars < 600 THEN 'imported' ELSE 'duplicate_near' END AS status, n_chars FROM documents) SELECT split, status, count(*) AS n, sum(n_chars)::BIGINT AS boxes FROM d GROUP BY ALL"""
)
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("n_chars") < 600, "imported").otherwise("duplicate_near")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("split"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("boxes"))


_ROWS = "[o_orderkey % 5 || ' .5', o_custkey % 4 || ' .2']"
REVISION_SQL = f"""o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN [] ELSE {_ROWS} END AS r0, o_orderpriority AS c0, CASE WHEN o_orderkey % 6 = 0 THEN 'rejected' ELSE 'annotated' END AS s0 FROM orders),
n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN [] WHEN o_orderkey % 5 = 0 THEN list_reverse({_ROWS}) WHEN o_orderkey % 7 = 0 THEN {_ROWS}[1:1] ELSE {_ROWS} END AS r1, CASE WHEN o_orderkey % 11 = 0 THEN '9-NEW' ELSE o_orderpriority END AS c1 FROM orders),
x AS (SELECT id, CASE WHEN s0 = 'rejected' AND len(r1) > 0 THEN 'restored' WHEN s0 <> 'rejected' AND len(r0) > 0 AND len(r1) = 0 THEN 'rejected' END AS a, CASE WHEN len(r0) > 0 AND len(r1) > 0 AND c0 <> c1 THEN 'class_changed' END AS b,
 CASE WHEN list_sort(r0) <> list_sort(r1) THEN 'boxes_changed' END AS c, list_sort(r0) = list_sort(r1) AND r0 <> r1 AS order_only, c0, c1, len(r0) AS n0, len(r1) AS n1 FROM o JOIN n USING (id))"""


def _revision(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    rows = F.array(F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit(" .5")), F.concat((F.col("o_custkey") % 4).cast("string"), F.lit(" .2")))
    none, key = F.array().cast("array<string>"), F.col("o_orderkey")
    old = orders.select(key.alias("sha256"), F.when(key % 6 == 0, none).otherwise(rows).alias("rows"), F.col("o_orderpriority").alias("class_name"), F.when(key % 6 == 0, "rejected").otherwise("annotated").alias("status"))
    new = orders.select(key.alias("sha256"), F.when(key % 13 == 0, none).when(key % 5 == 0, F.reverse(rows)).when(key % 7 == 0, F.slice(rows, 1, 1)).otherwise(rows).alias("rows"), F.when(key % 11 == 0, "9-NEW").otherwise(F.col("o_orderpriority")).alias("class_name"))
    return old, new


@query(f"WITH {REVISION_SQL} SELECT id, concat_ws(',', a, b, c) AS change_types, order_only, c0 AS old_class, c1 AS new_class, n0::INT AS old_boxes, n1::INT AS new_boxes, CASE WHEN n1 = 0 THEN 'rejected' ELSE 'annotated' END AS status FROM x")
def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.revision_changes(*_revision(spark, sf_dir))
    return out.withColumnRenamed("sha256", "id").withColumn("change_types", F.array_join("change_types", ","))


@query(
    f"""WITH {REVISION_SQL}, y AS (SELECT *, concat_ws(',', a, b, c) AS kinds FROM x) SELECT CASE WHEN kinds <> '' THEN c1 ELSE c0 END AS class_name, CASE WHEN kinds = '' THEN CASE WHEN n0 = 0 THEN 'rejected' ELSE 'annotated' END WHEN n1 = 0 THEN 'rejected' ELSE 'annotated' END AS annotation_status,
 count(*) AS n, sum(CASE WHEN kinds <> '' THEN n1 ELSE n0 END)::BIGINT AS boxes, count(*) FILTER (kinds <> '') AS revised FROM y GROUP BY ALL"""
)
def revision_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _revision(spark, sf_dir)
    manifest = old.select("sha256", "class_name", F.col("status").alias("annotation_status"), F.size("rows").alias("bbox_count"), F.lit(None).cast("array<struct<revision:string,change_types:array<string>,old_class:string,new_class:string,old_boxes:int,new_boxes:int>>").alias("annotation_revisions"))
    out = merge.apply_revision(manifest, merge.revision_changes(old, new), "rev-1")
    return out.groupBy("class_name", "annotation_status").agg(F.count(F.lit(1)).alias("n"), F.sum("bbox_count").alias("boxes"), F.count_if(F.size(F.coalesce("annotation_revisions", F.array())) > 0).alias("revised"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, list_distinct(list(l_linenumber % 5)) AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS id, o_orderpriority[1]::INT - 1 AS c, o_orderkey % 5 AS wish, o_orderkey % 8 = 1 AS open FROM orders),
j AS (SELECT o.id, c, coalesce(k, []) AS k, coalesce(n, 0) AS n, CASE WHEN o.id % 3 = 0 THEN wish END AS wish, open FROM o LEFT JOIN l USING (id)),
p AS (SELECT *, CASE WHEN len(k) = 1 THEN k[1] WHEN list_contains(k, c) THEN c WHEN list_contains(k, wish) THEN wish END AS new FROM j)
SELECT id, CASE WHEN open THEN 'missing' WHEN n = 0 THEN 'rejected' ELSE 'annotated' END AS annotation_status, CASE WHEN open THEN 0 ELSE n END::INT AS bbox_count, CASE WHEN NOT open AND n > 0 AND new <> c THEN new ELSE c END::INT AS class_id,
 CASE WHEN NOT open AND n > 0 AND new <> c THEN c END AS original_class_id, NOT open AND n > 0 AND new IS NULL AS needs_override FROM p"""
)
def first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sha256")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("rows"), F.collect_set(F.col("l_linenumber") % 5).alias("classes"))
    orders = table(spark, sf_dir, "orders")
    manifest = orders.select(F.col("o_orderkey").alias("sha256"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("class_id"), F.lit("missing").alias("annotation_status"), F.lit(0).alias("bbox_count"))
    reviewed = manifest.filter("sha256 % 8 <> 1").select("sha256").join(lines, "sha256", "left").select("sha256", F.coalesce("rows", F.array().cast("array<string>")).alias("rows"), F.coalesce("classes", F.array().cast("array<int>")).alias("classes"))
    wishes = manifest.filter("sha256 % 3 = 0").select("sha256", (F.col("sha256") % 5).cast("int").alias("class_id"))
    out = merge.first_merge(manifest, reviewed, wishes)
    return out.select(F.col("sha256").alias("id"), "annotation_status", "bbox_count", "class_id", "original_class_id", F.coalesce("needs_override", F.lit(False)).alias("needs_override"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(sha256(text), '') AS sha256, row_number() OVER (PARTITION BY doc_id % 2 = 0, coalesce(sha256(text), '') ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, sha256, NULL::VARCHAR AS ingest_id FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, sha256, 'i1' FROM d WHERE doc_id % 2 <> 0 AND n = 1 AND sha256 NOT IN (SELECT sha256 FROM d WHERE doc_id % 2 = 0)"""
)
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the documents joins the other; copies come within both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha256"))
    return merge.append_new(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0").withColumn("ingest_id", F.lit("i1")), "doc_id")


AUDIT_SQL = """s AS (SELECT CASE WHEN o_orderkey % 100 = 7 THEN o_orderkey - 7 ELSE o_orderkey END::VARCHAR AS id, 'g' || o_custkey AS g, CASE WHEN o_orderkey % 331 = 0 THEN 'holdout' WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
 o_orderpriority[1]::INT - 1 AS class_id, CASE WHEN o_orderkey % 477 = 0 THEN 'wrong' ELSE o_orderpriority END AS class_name FROM orders),
d(class_id, class_name) AS (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'), (5, '6-EXTRA'))"""


@query(
    f"""WITH {AUDIT_SQL}, v AS (SELECT 'repeated_sha256' AS "check", id AS key, count(*)::VARCHAR AS detail FROM s GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'invalid_split', id, split FROM s WHERE split NOT IN ('train', 'val', 'test') UNION ALL SELECT 'group_crosses_splits', g, count(DISTINCT split)::VARCHAR FROM s GROUP BY g HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'class_name_and_id', id, s.class_name FROM s LEFT JOIN d USING (class_id) WHERE s.class_name IS DISTINCT FROM d.class_name
UNION ALL SELECT 'class_not_covered', p || '/' || d.class_name, NULL FROM d, (VALUES ('val'), ('test')) AS q(p) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.class_name = d.class_name AND s.split = p)) SELECT * FROM v"""
)
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    parted = F.when(key % 331 == 0, "holdout").when(F.col("o_custkey") % 10 < 7, "train").when(F.col("o_custkey") % 10 < 9, "val").otherwise("test")
    rows = table(spark, sf_dir, "orders").select(F.when(key % 100 == 7, key - 7).otherwise(key).cast("string").alias("sha256"), F.concat(F.lit("g"), "o_custkey").alias("leakage_group"), parted.alias("split"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("class_id"), F.when(key % 477 == 0, "wrong").otherwise(F.col("o_orderpriority")).alias("class_name"))
    dim = spark.createDataFrame([*enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-EXTRA"])], "class_id int, class_name string")
    return audit.split_audit(rows, dim)


HOLDOUT_SQL = """t AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE 'l' || o_custkey END AS l, CASE WHEN o_orderkey % 90 = 0 THEN 'other' ELSE o_orderpriority END AS c, 'g' || CASE WHEN o_orderkey % 57 = 0 THEN 0 ELSE o_custkey END AS g, 'i/' || o_orderkey AS i, o_orderkey % 4 AS b FROM orders),
m AS (SELECT o_orderkey::VARCHAR AS id, 'l' || o_custkey AS l, 'g' || o_custkey AS g, CASE WHEN o_orderkey % 70 = 0 THEN 'missing' ELSE 'annotated' END AS s, CASE WHEN o_orderkey % 43 = 0 THEN 9 ELSE o_orderkey % 4 END AS b, CASE WHEN o_orderkey % 33 <> 0 THEN 'p' END AS p, CASE WHEN o_orderkey % 61 = 0 THEN 'z' ELSE o_orderkey::VARCHAR END AS h FROM orders WHERE o_orderkey % 110 <> 0),
q AS (SELECT CASE WHEN o_orderkey % 99 = 0 THEN -o_orderkey ELSE o_orderkey END::VARCHAR AS id, o_orderpriority AS c, 'g' || o_custkey AS g, CASE WHEN o_orderkey % 77 = 0 THEN 'j/' ELSE 'i/' END || o_orderkey AS i, CASE WHEN o_orderkey % 30 = 0 THEN 'done' ELSE 'pending' END AS s FROM orders WHERE o_orderkey % 20 <> 0),
j AS (SELECT t.*, m.id IS NOT NULL AS known, q.id IS NOT NULL AS queued, m.l AS ml, m.g AS mg, m.s AS ms, m.b AS mb, m.p AS mp, m.h AS mh, q.c AS qc, q.g AS qg, q.i AS qi FROM t LEFT JOIN m USING (id) LEFT JOIN q USING (id)),
w AS (SELECT id, unnest([CASE WHEN NOT known THEN 'missing_from_manifest' END, CASE WHEN known AND ms <> 'annotated' THEN 'not_annotated' END, CASE WHEN known AND g <> mg THEN 'group_drifted' END, CASE WHEN queued AND g <> qg THEN 'queue_group_differs' END,
 CASE WHEN queued AND c <> qc THEN 'queue_class_differs' END, CASE WHEN queued AND i <> qi THEN 'queue_destination_differs' END, CASE WHEN known AND id <> mh THEN 'image_drifted' END, CASE WHEN known AND mp IS NULL THEN 'label_missing' END,
 CASE WHEN known AND l <> ml THEN 'label_drifted' END, CASE WHEN known AND b <> mb THEN 'box_count_drifted' END]) AS d FROM j)"""


@query(
    f"""WITH {HOLDOUT_SQL} SELECT 'holdout' AS "check", id AS key, d AS detail FROM w WHERE d IS NOT NULL
UNION ALL SELECT 'queue_missing', id, NULL FROM t WHERE id NOT IN (SELECT id FROM q) UNION ALL SELECT 'queue_extra', id, NULL FROM q WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT 'queue_not_pending', id, s FROM q WHERE s <> 'pending'
UNION ALL SELECT 'test_group_elsewhere', 'g' || o_custkey, 'val' FROM orders WHERE 'g' || o_custkey IN (SELECT g FROM t) GROUP BY o_custkey HAVING max(o_orderkey) % 7 = 0"""
)
def holdout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are the test; queue and manifest drift from it."""
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    orders = table(spark, sf_dir, "orders")
    group = lambda k: F.concat(F.lit("g"), k.cast("string"))
    own, label, place = group(F.col("o_custkey")), F.concat(F.lit("l"), "o_custkey"), F.concat(F.lit("i/"), text)
    boxes = (key % 4).cast("int")
    test = orders.select(text.alias("sha256"), F.when(key % 41 == 0, "x").otherwise(label).alias("label_sha256"), F.when(key % 90 == 0, "other").otherwise(F.col("o_orderpriority")).alias("class_name"), group(F.when(key % 57 == 0, 0).otherwise(F.col("o_custkey"))).alias("leakage_group"), place.alias("destination_image"), boxes.alias("bbox_count"))
    manifest = orders.filter(key % 110 != 0).select(text.alias("sha256"), label.alias("label_sha256"), own.alias("leakage_group"), F.when(key % 70 == 0, "missing").otherwise("annotated").alias("annotation_status"), F.when(key % 43 == 0, 9).otherwise(boxes).alias("bbox_count"), F.when(key % 33 != 0, "p").alias("destination_label"), F.when(key % 61 == 0, "z").otherwise(text).alias("image_sha256"))
    queue = orders.filter(key % 20 != 0).select(F.when(key % 99 == 0, -key).otherwise(key).cast("string").alias("sha256"), F.col("o_orderpriority").alias("class_name"), own.alias("leakage_group"), F.concat(F.when(key % 77 == 0, "j/").otherwise("i/"), text).alias("destination_image"), F.when(key % 30 == 0, "done").otherwise("pending").alias("review_status"))
    parted = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).select(own.alias("leakage_group"), F.when(F.col("k") % 7 == 0, "val").otherwise("test").alias("split"))
    return audit.holdout_audit(test, queue, manifest, splits=parted)


#: Addresses that reach every branch, made of the pages' own.
_ENDS = ["", ".svg", "/a.PNG", "/logo.webp", "/b.jpeg?w=1", "/favicon.ico", ".gif#x", "/c.SVG"]
_HOSTS = ["", "https://encrypted-tbn0.gstatic.com/", "https://t1.gstatic.com/", "ftp://"]
_KINDS = ["image/jpeg", "image/webp; q=1", None, "IMAGE/PNG", "text/html"]
PAGES_SQL = f"""p AS (SELECT page_id, html, url AS own, ({[h for h in _HOSTS]})[page_id % 4 + 1] || CASE WHEN page_id % 4 = 0 THEN url ELSE page_id::VARCHAR END || ({_ENDS})[page_id % 8 + 1] AS url, (['image/jpeg', 'image/webp; q=1', NULL, 'IMAGE/PNG', 'text/html'])[page_id % 5 + 1] AS kind FROM pages),
a AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM p), s AS (SELECT *, lower(regexp_extract(path, '[^/](\\.(jpg|jpeg|png|webp|bmp|gif))$', 1, 'i')) AS suffix FROM a)"""


@query(
    rf"""WITH {PAGES_SQL}, h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)
SELECT page_id, lower(regexp_extract(own, '^[a-z]+://([^/?#]*)', 1)) AS domain, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND starts_with(x, 'http')), '|') AS links,
 contains(lower(html), 'update your browser') OR contains(lower(html), 'before you continue') OR contains(lower(html), 'unusual traffic') OR contains(lower(html), '/sorry/') OR contains(lower(html), 'enablejs') AS blocked,
 NOT starts_with(lower(url), 'http') OR contains(lower(url), 'gstatic.com/images/branding') OR contains(lower(url), 'google.com/images') OR contains(lower(url), 'favicon') OR contains(lower(url), 'logo') OR path LIKE '%.svg' AS skipped,
 CASE WHEN suffix <> '' THEN suffix WHEN kind LIKE '%jpeg' THEN '.jpg' WHEN kind = 'IMAGE/PNG' THEN '.png' WHEN kind LIKE '%webp%' THEN '.webp' ELSE '.jpg' END AS suffix,
 CASE WHEN contains(url, 'encrypted-tbn0.gstatic.com') THEN 2 WHEN contains(url, 'gstatic.com') THEN 1 ELSE 0 END AS priority FROM s JOIN h USING (page_id)"""
)
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = F.col("page_id"), F.col("html")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").withColumn("kind", pick(_KINDS, 5)).withColumn("own", F.col("url")).withColumn("url", F.concat(pick(_HOSTS, 4), F.when(k % 4 == 0, F.col("url")).otherwise(k.cast("string")), pick(_ENDS, 8)))
    u = F.col("url")
    links = web.found_urls(h, [(r'href="([^"]+)"', 1)])
    return rows.select("page_id", web.domain(F.col("own")).alias("domain"), F.array_join(links, "|").alias("links"), web.is_blocked(h).alias("blocked"), web.is_skipped(u).alias("skipped"), web.suffix_guess(u, F.col("kind")).alias("suffix"), web.url_priority(u).alias("priority"))


@query(
    r"""WITH q AS (SELECT doc_id, trim(regexp_replace(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS q FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS n FROM q) SELECT sha256(q) AS query_sha256, length(q) AS n_chars, doc_id AS first_at FROM f WHERE n = 1"""
)
def queries_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_ = web.normalised_query(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(F.sha2(query_, 256).alias("query_sha256"), F.length(query_).cast("long").alias("n_chars"), F.col("doc_id").alias("first_at"))
    return sample.distinct_in_order(rows, ["query_sha256"], "first_at")


@query("""SELECT event_id AS id, (CASE WHEN event_id % 3 = 0 THEN true ELSE contains((['image/png', 'text/html', 'IMAGE/JPEG'])[event_id % 3 + 1], 'image') OR event_id % 3 = 2 END) AND floor(value * 100) >= 1024 AS accepted FROM events""")
def download_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, ["image/png", "text/html", "IMAGE/JPEG"])), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), web.accepted_download(kind, F.floor(F.col("value") * 100)).alias("accepted"))


@query(
    """WITH d AS (SELECT user_id, event_id, event_type, round(value / 1000, 3) AS c FROM events) SELECT user_id AS request, '{"detections":[' || string_agg('{"class_name":"' || event_type || '","confidence":' || CASE WHEN c = 0 THEN '0.0' WHEN c < 0.001 THEN c::VARCHAR ELSE c::VARCHAR END || '}', ',' ORDER BY event_id) || ']}' AS payload FROM d GROUP BY 1"""
)
def prompt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), "event_id", F.col("event_type").alias("class_name"), (F.col("value") / 1000).alias("confidence"))
    return advisory.prompt_payload(rows, "request", "event_id")


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5003 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM a WHERE o_orderkey % 4999 <> 5
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice, o_orderpriority FROM a WHERE o_orderkey % 5009 = 3)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice"""
)
def package_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a changed copy, by the trees of their digests."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    price = F.when(F.col("o_orderkey") % 5003 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    right = left.filter("o_orderkey % 4999 <> 5").withColumn("o_totalprice", price).unionByName(left.filter("o_orderkey % 5009 = 3").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))
    return package.drift(left, right, "o_orderkey")
