"""Group vectors, apportionment, splits, samples, retention, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import balance, sample, split
from sieveline.plans.catalog import query
from sieveline.storage import cut, table

SEED = 42
RATIOS = ["0.7", "0.2", "0.1"]

RECORDS_SQL = "r AS (SELECT o_orderkey AS id, 'g' || o_custkey AS leakage_group, o_orderpriority[1]::INT - 1 AS class_id, 1 + o_orderkey % 3 AS boxes FROM orders)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images: the customer is the group, the priority the class."""
    kind = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("g"), "o_custkey").alias("leakage_group"), kind.alias("class_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("bbox_count"))
    return rows.withColumn("object_class_counts", F.create_map(F.col("class_id").cast("string"), F.col("bbox_count")))


VECTORS_SQL = f"""{RECORDS_SQL}, v AS (SELECT leakage_group, count(*) AS images, sum(boxes)::BIGINT AS boxes, {', '.join(f"count(*) FILTER (class_id = {k}) AS p{k}, coalesce(sum(boxes) FILTER (class_id = {k}), 0)::BIGINT AS o{k}" for k in range(5))} FROM r GROUP BY leakage_group)"""


@query(f"WITH {VECTORS_SQL} SELECT leakage_group, images, boxes, concat_ws(',', p0, p1, p2, p3, p4) AS primary_counts, concat_ws(',', o0, o1, o2, o3, o4) AS object_counts FROM v")
def group_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return split.group_vectors(records(spark, sf_dir), 5).select("leakage_group", "images", "boxes", told("primary").alias("primary_counts"), told("objects").alias("object_counts"))


@query(
    f"""WITH {VECTORS_SQL}, t AS (SELECT {', '.join(f'sum(p{k}) AS tp{k}, sum(o{k}) AS to{k}' for k in range(5))} FROM v)
SELECT leakage_group, round(({' + '.join(f'p{k} / tp{k} + 2 * o{k} / to{k}' for k in range(5))}) / images, 6) AS rarity, sha256('{SEED}:' || leakage_group) AS tie FROM v, t"""
)
def rarity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = split.rarity(split.group_vectors(records(spark, sf_dir), 5))
    return out.select("leakage_group", F.round("rarity", 6).alias("rarity"), split.order_key(F.col("leakage_group"), SEED).alias("tie"))


@query(
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT o_custkey, n, k, s, n * r AS e, floor(n * r) AS low FROM n, (VALUES (0, 'train', 0.7), (1, 'val', 0.2), (2, 'test', 0.1)) AS q(k, s, r)),
y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY e - low DESC, k) AS place, n - sum(low) OVER (PARTITION BY o_custkey) AS rest FROM x)
SELECT o_custkey, s AS split, (low + (place <= rest)::INT)::BIGINT AS target FROM y"""
)
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return split.apportion(counts, "n", ["o_custkey"], RATIOS)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    groups = split.group_vectors(rows, 5)
    total = rows.count()
    return rows.join(split.assign(groups, split.integer_targets(total, RATIOS), SEED), "leakage_group")


#: The line of each class, cut at integer targets (largest remainders, first for train, then for val of what is left).
ASSIGN_SQL = f"""{VECTORS_SQL}, q AS (SELECT leakage_group AS g, images, sha256('{SEED}:' || leakage_group) AS h, list_position([p0, p1, p2, p3, p4], greatest(p0, p1, p2, p3, p4)) AS c FROM v),
n AS (SELECT sum(images)::BIGINT AS n FROM q), e AS (SELECT k, n * w // 10 AS low, n * w % 10 AS rest, n FROM n, (VALUES (0, 7), (1, 2), (2, 1)) AS x(k, w)),
t AS (SELECT k, low + (row_number() OVER (ORDER BY rest DESC, k) <= n - sum(low) OVER ())::INT AS t FROM e),
a AS (SELECT (SELECT t FROM t WHERE k = 0)::BIGINT AS t0, (SELECT t FROM t WHERE k = 1)::BIGINT AS t1, (SELECT t FROM t WHERE k = 2)::BIGINT AS t2),
c AS (SELECT c, sum(images)::BIGINT AS n FROM q GROUP BY c),
d AS (SELECT c, n, n * t0 // (t0 + t1 + t2) + (row_number() OVER (ORDER BY n * t0 % (t0 + t1 + t2) DESC, c) <= t0 - sum(n * t0 // (t0 + t1 + t2)) OVER ())::INT AS c0 FROM c, a),
f AS (SELECT c, c0, (n - c0) * t1 // (t1 + t2) + (row_number() OVER (ORDER BY (n - c0) * t1 % (t1 + t2) DESC, c) <= t1 - sum((n - c0) * t1 // (t1 + t2)) OVER ())::INT AS c1 FROM d, a),
l AS (SELECT g, c, coalesce(sum(images) OVER (PARTITION BY c ORDER BY images DESC, h, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM q),
z AS (SELECT r.id, r.leakage_group, r.boxes, CASE WHEN place < c0 THEN 'train' WHEN place < c0 + c1 THEN 'val' ELSE 'test' END AS split FROM l JOIN f USING (c) JOIN r ON r.leakage_group = l.g)"""


@query(f"WITH {ASSIGN_SQL} SELECT id, leakage_group, split FROM z")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("id", "leakage_group", "split")


@query(f"WITH {ASSIGN_SQL} SELECT split, count(*) AS images, count(DISTINCT leakage_group) AS groups, sum(boxes)::BIGINT AS boxes FROM z GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(_assigned(spark, sf_dir)).select("split", "images", "groups", "boxes")


@query(f"WITH {ASSIGN_SQL} SELECT count(*) AS crossing FROM (SELECT leakage_group FROM z GROUP BY leakage_group HAVING count(DISTINCT split) > 1)")
def split_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.crossing_groups(_assigned(spark, sf_dir)).agg(F.count(F.lit(1)).alias("crossing"))


#: Weighted squared relative errors of each split against its share of the totals.
_ERROR = "{0} * pow(({1} - {2}) / greatest({2}, 1.0), 2)"
OBJECTIVE_SQL = f"""WITH {ASSIGN_SQL}, m AS (SELECT leakage_group, min(split) AS split FROM z GROUP BY leakage_group),
w AS (SELECT sum(images) AS images, sum(boxes) AS boxes, {", ".join(f"sum(p{k}) AS p{k}, sum(o{k}) AS o{k}" for k in range(5))} FROM v),
s AS (SELECT m.split, sum(images)::DOUBLE AS images, sum(boxes)::DOUBLE AS boxes, {", ".join(f"sum(p{k})::DOUBLE AS p{k}, sum(o{k})::DOUBLE AS o{k}" for k in range(5))} FROM v JOIN m USING (leakage_group) GROUP BY m.split),
g(split, r, k) AS (VALUES ('train', 0.7::DOUBLE, 0), ('val', 0.2::DOUBLE, 1), ('test', 0.1::DOUBLE, 2))
SELECT s.split, s.images::BIGINT AS images, s.boxes::BIGINT AS boxes, round({_ERROR.format(8, "s.images", "t.t")}, 6) AS image_error, round({_ERROR.format(0.5, "s.boxes", "(w.boxes * g.r)")}, 6) AS box_error,
    round({" + ".join(_ERROR.format(2, f"s.p{k}", f"(w.p{k} * g.r)") for k in range(5))}, 6) AS primary_error, round({" + ".join(_ERROR.format(3, f"s.o{k}", f"(w.o{k} * g.r)") for k in range(5))}, 6) AS object_error
FROM s JOIN g USING (split) JOIN t USING (k), w"""


@query(OBJECTIVE_SQL)
def split_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    groups, targets = split.group_vectors(rows, 5), split.integer_targets(rows.count(), RATIOS)
    out = balance.objective(groups, split.assign(groups, targets, SEED), [float(r) for r in RATIOS], targets)
    return out.select("split", "images", "boxes", *[F.round(c, 6).alias(c) for c in ("image_error", "box_error", "primary_error", "object_error")])


def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups of an image: the priority is the class, lines are
    objects of the class of their supplier."""
    kind = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("c")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.count_if(F.col("l_suppkey") % 5 == k).alias(f"n{k}") for k in range(5)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind).join(lines, "o_orderkey", "left")
    held = F.array(*[F.coalesce(f"n{k}", F.lit(0)) for k in range(5)])
    rows = rows.select(F.concat(F.lit("o"), "o_orderkey").alias("leakage_group"), F.lit(1).cast("long").alias("images"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (k == F.col("c")).cast("long")).alias("primary"), held.alias("objects"))
    return rows.withColumn("boxes", F.aggregate("objects", F.lit(0).cast("long"), lambda a, x: a + x))


@query()
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups dealt by class, size and objects, then exchanged until no exchange improves."""
    groups = cut(order_groups(spark, sf_dir))
    dealt = cut(balance.deal(groups, split.integer_targets(groups.count(), RATIOS), SEED))
    return balance.refine(groups, dealt, [float(r) for r in RATIOS])


CLASSES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]


def _quota_sql() -> str:
    ctes = [f"b AS (SELECT p_type, p_brand, p_partkey, sha256('{SEED}:' || sha256(p_partkey::VARCHAR)) AS k, sha256(p_partkey::VARCHAR) AS s FROM part WHERE p_brand <> 'Brand#1')"]
    for n, c in enumerate(CLASSES):
        taken = "".join(f" AND p_brand NOT IN (SELECT p_brand FROM q{m})" for m in range(n))
        ctes.append(f"h{n} AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k, s) AS x FROM b WHERE p_type = '{c}'{taken}), q{n} AS (SELECT * FROM h{n} WHERE x = 1 ORDER BY k, s LIMIT 3)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT p_type, p_brand, p_partkey FROM q{n}" for n in range(len(CLASSES)))


@query(_quota_sql())
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_partkey", F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    reserved = spark.createDataFrame([("Brand#1",)], "p_brand string")
    out = sample.quota_sample(rows, {c: 3 for c in CLASSES}, SEED, "p_type", "p_brand", "sha256", reserved)
    return out.select("p_type", "p_brand", "p_partkey")


@query(
    """WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_id, ts, event_type <> 'error' AS image, epoch_us(now) - epoch_us(ts) > 240::BIGINT * 3600 * 1000000 AS old FROM events, n),
k AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS x FROM e WHERE image AND NOT old)
SELECT e.event_id, CASE WHEN NOT image THEN NULL WHEN old THEN 'age' WHEN x > 2000 THEN 'count' END AS removed FROM e LEFT JOIN k USING (event_id)"""
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    name = F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), F.when(F.col("event_type") == "error", ".txt").otherwise(".jpg"))
    rows = events.select("event_id", F.col("ts").alias("mtime"), name.alias("name"))
    return sample.retention(rows, F.lit(now), 240, 2000).select("event_id", "removed")


TURN_SQL = "role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''"


@query(f"SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 AND {TURN_SQL}")
def recent_turns_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.recent_turns(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


@query(f"SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE {TURN_SQL}) WHERE n <= 4")
def recent_turns_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.recent_turns(table(spark, sf_dir, "conversations"), 4, cut_first=False).select("conv_id", "turn", "role")


@query("SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n <= 5")
def first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.first_per_class(table(spark, sf_dir, "part"), 5, "p_type", "p_partkey").select("p_type", "p_partkey")


@query(
    """WITH h AS (SELECT o_orderkey, ('0x' || sha256(o_orderkey::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE AS x FROM orders)
SELECT o_orderkey, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7 + 0.2 THEN 'val' ELSE 'test' END AS split FROM h"""
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample.hash_split(table(spark, sf_dir, "orders"), F.col("o_orderkey"), {"train": 0.7, "val": 0.2, "test": 0.1})
    return out.select("o_orderkey", "split")


@query(
    """WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey::VARCHAR) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN place < n * 7 // 10 THEN 'train' WHEN place < n * 7 // 10 + n * 2 // 10 THEN 'val' ELSE 'test' END AS split FROM h"""
)
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.exact_split(table(spark, sf_dir, "orders"), F.col("o_orderkey"), {"train": 0.7, "val": 0.2, "test": 0.1}).select("o_orderkey", "split")
