"""Hashes, similarity joins, leaders, leakage groups, centroids, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.scalar import cosine, gradient_hash, long_to_hex
from sieveline.operators import calibrate, score, similarity
from sieveline.plans.catalog import query
from sieveline.storage import table

HASH_SQL = "h AS (SELECT vec_id AS id, md5(vec_id::VARCHAR) AS sha256, label, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda i: (embedding[i + 1] > embedding[i])::BIGINT)), lambda a, b: a * 2 + b) AS hash FROM embeddings)"


#: Hashes with a near copy of every third one, one to six bits away.
NEAR_SQL = HASH_SQL.replace("h AS (", "h0 AS (", 1) + ", h AS (SELECT id, sha256, label, hash FROM h0 UNION ALL SELECT id + 1000000000, md5('n' || id), label, xor(xor(hash, 1::BIGINT << (id % 61)::INT), CASE WHEN id % 2 = 0 THEN 0::BIGINT ELSE (31::BIGINT << (id % 57)::INT) END) FROM h0 WHERE id % 3 = 0)"


def hashed_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    flips = F.expr("shiftleft(1L, cast(id % 61 as int))").bitwiseXOR(F.when(F.col("id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(31L, cast(id % 57 as int))")))
    copies = rows.filter("id % 3 = 0").select((F.col("id") + 1000000000).alias("id"), F.md5(F.concat(F.lit("n"), F.col("id").cast("string")).cast("binary")).alias("sha256"), "label", F.col("hash").bitwiseXOR(flips).alias("hash"))
    return rows.unionByName(copies)


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.md5(F.col("vec_id").cast("string").cast("binary")).alias("sha256"), "label", gradient_hash(F.col("embedding")).alias("hash"))


@query(f"WITH {HASH_SQL} SELECT id, hash, printf('%016x', hash) AS hex, bit_count(hash)::INT AS bits FROM h")
def gradient_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("id", "hash", long_to_hex(F.col("hash")).alias("hex"), F.bit_count("hash").alias("bits"))


def _pairs_sql(d: int, rows: str = HASH_SQL) -> str:
    return f"WITH {rows} SELECT DISTINCT x.hash AS a, y.hash AS b, bit_count(xor(x.hash, y.hash))::INT AS distance FROM h x, h y WHERE x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= {d}"


def _at(sql: str, distance: int, rows: str) -> str:
    return sql.replace("%ROWS%", rows).replace("%D%", str(distance))


def _pairs(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    rows = hashed(spark, sf_dir)
    return similarity.hamming_pairs(rows, rows, d, bits=63).filter("a < b")


@query(_pairs_sql(6, NEAR_SQL))
def hamming_pairs_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed_near(spark, sf_dir)
    return similarity.hamming_pairs(rows, rows, 6, bits=63).filter("a < b")


@query(_pairs_sql(14, NEAR_SQL))
def hamming_pairs_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed_near(spark, sf_dir)
    return similarity.hamming_pairs(rows, rows, 14, bits=63).filter("a < b")


@query(_pairs_sql(18))
def hamming_pairs_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 18)


LEADER_DEDUP_SQL = """WITH RECURSIVE %ROWS%, o AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM h),
r(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, hash BIGINT)[] UNION ALL
 SELECT o.n, CASE WHEN len(list_filter(r.kept, lambda k: bit_count(xor(k.hash, o.hash)) <= %D%)) = 0 THEN list_append(r.kept, {'id': o.id, 'hash': o.hash}) ELSE r.kept END FROM r JOIN o ON o.n = r.n + 1),
k AS (SELECT unnest(kept, recursive := true) FROM r WHERE n = (SELECT max(n) FROM o)),
m AS (SELECT h.id, min({'d': bit_count(xor(k.hash, h.hash))::INT, 'w': k.id}) AS b FROM h JOIN k ON bit_count(xor(k.hash, h.hash)) <= %D% AND k.id <= h.id GROUP BY h.id)
SELECT m.id, CASE WHEN k.id IS NULL THEN 'near' ELSE 'kept' END AS status, CASE WHEN k.id IS NULL THEN b.w END AS duplicate_of, CASE WHEN k.id IS NULL THEN b.d END AS distance FROM m LEFT JOIN k USING (id)"""


@query(_at(LEADER_DEDUP_SQL, 18, HASH_SQL))
def leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leader_dedup(hashed(spark, sf_dir), 18)


@query(_at(LEADER_DEDUP_SQL, 6, NEAR_SQL))
def leader_dedup_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leader_dedup(hashed_near(spark, sf_dir), 6)


def _leader_dedup(rows: DataFrame, distance: int) -> DataFrame:
    return similarity.leaders(rows.withColumn("ord", F.col("id")), distance)


LEAKAGE_GROUPS_SQL = """WITH RECURSIVE %ROWS%, e AS (SELECT x.id AS a, y.id AS b FROM h x, h y WHERE bit_count(xor(x.hash, y.hash)) <= %D%),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
g AS (SELECT c.a AS id, min(h.sha256) AS s, count(*) AS n FROM c JOIN h ON h.id = c.b GROUP BY c.a)
SELECT h.sha256, 'dhash-' || g.s[1:16] AS leakage_group, g.n AS group_size FROM g JOIN h USING (id)"""


@query(_at(LEAKAGE_GROUPS_SQL, 18, HASH_SQL))
def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leakage_groups(hashed(spark, sf_dir), 18)


@query(_at(LEAKAGE_GROUPS_SQL, 6, NEAR_SQL))
def leakage_groups_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leakage_groups(hashed_near(spark, sf_dir), 6)


def _leakage_groups(rows: DataFrame, distance: int) -> DataFrame:
    return similarity.leakage_groups(rows, distance)


BASELINE_MATCH_SQL = """WITH %ROWS%, b AS (SELECT * FROM h WHERE id % 3 = 0), n AS (SELECT * FROM h WHERE id % 3 <> 0),
m AS (SELECT n.id, min({'d': bit_count(xor(n.hash, b.hash))::INT, 'w': b.id}) AS x FROM n JOIN b ON bit_count(xor(n.hash, b.hash)) <= %D% GROUP BY n.id)
SELECT n.id, x.w AS duplicate_of, x.d AS distance FROM n LEFT JOIN m USING (id)"""


@query(_at(BASELINE_MATCH_SQL, 18, HASH_SQL))
def baseline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline_match(hashed(spark, sf_dir), 18)


@query(_at(BASELINE_MATCH_SQL, 6, NEAR_SQL))
def baseline_match_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline_match(hashed_near(spark, sf_dir), 6)


def _baseline_match(rows: DataFrame, distance: int) -> DataFrame:
    return similarity.match_baseline(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), distance)


ATTACH_GROUPS_SQL = """WITH RECURSIVE %ROWS%, x AS (SELECT id, sha256, hash, 'g' || id AS g FROM h WHERE id % 2 = 0), o AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM h WHERE id % 2 = 1),
r(n, all_) AS (SELECT 0::BIGINT, (SELECT list({'s': sha256, 'h': hash, 'g': g}) FROM x) UNION ALL
 SELECT o.n, list_append(r.all_, {'s': o.sha256, 'h': o.hash, 'g': coalesce((list_sort(list_transform(list_filter(r.all_, lambda k: bit_count(xor(k.h, o.hash)) <= %D%), lambda k: {'s': k.s, 'g': k.g})))[1].g, 'dhash-' || o.sha256[1:16])}) FROM r JOIN o ON o.n = r.n + 1),
f AS (SELECT unnest(all_) AS k FROM r WHERE n = (SELECT max(n) FROM o))
SELECT o.sha256, f.k.g AS leakage_group FROM f JOIN o ON o.sha256 = f.k.s"""


@query(_at(ATTACH_GROUPS_SQL, 18, HASH_SQL))
def attach_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attach_groups(hashed(spark, sf_dir), 18)


@query(_at(ATTACH_GROUPS_SQL, 6, NEAR_SQL))
def attach_groups_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attach_groups(hashed_near(spark, sf_dir), 6)


def _attach_groups(rows: DataFrame, distance: int) -> DataFrame:
    rows = rows.withColumn("ord", F.col("id"))
    old = rows.filter("id % 2 = 0").withColumn("leakage_group", F.concat(F.lit("g"), F.col("id").cast("string")))
    return similarity.attach(rows.filter("id % 2 = 1"), old, distance)


UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM u)"


@query(
    f"""WITH {UNIT_SQL}, c AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label)
SELECT x.vec_id AS id, x.label, round(sum(x.x * c.x) / any_value(n.n), 4) AS own_cosine FROM x JOIN c USING (label, i) JOIN n USING (label) GROUP BY x.vec_id, x.label"""
)
def centroid_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    means = calibrate.centroids(rows, ["label"], "embedding").select("label", "centroid")
    return rows.join(means, "label").select(F.col("vec_id").alias("id"), "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 4).alias("own_cosine"))


@query(
    f"""WITH {UNIT_SQL}, c AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label),
s AS (SELECT x.vec_id, c.label, sum(x.x * c.x) / any_value(n.n) AS s FROM x JOIN c USING (i) JOIN n ON n.label = c.label GROUP BY x.vec_id, c.label)
SELECT vec_id AS id, arg_max(label, s) AS best, round(max(s), 4) AS best_score FROM s GROUP BY vec_id"""
)
def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class whose centroid a scorer in Python finds nearest."""
    rows = table(spark, sf_dir, "embeddings")
    means = calibrate.centroids(rows, ["label"], "embedding").select("label", "centroid")
    return score.nearest(rows, means, "embedding").select(F.col("vec_id").alias("id"), "best", F.round("best_score", 4).alias("best_score"))


@query(
    """WITH s AS (SELECT event_type AS class_name, value AS s, user_id % 3 = 0 AS pos FROM events), v AS (SELECT class_name, s, count(*) AS n, count(*) FILTER (pos) AS tp FROM s GROUP BY ALL),
w AS (SELECT class_name, s, sum(n) OVER o AS n, sum(tp) OVER o AS tp FROM v WINDOW o AS (PARTITION BY class_name ORDER BY s DESC)),
g AS (SELECT class_name, max({'n': n, 'tp': tp, 's': s}) FILTER (n >= 20 AND tp / n >= 0.35) AS b, max(s) AS top, max(n) AS rows, max(tp) AS positives FROM w GROUP BY class_name)
SELECT class_name, round(coalesce(b.s, top + 1e-6), 4) AS threshold, round(coalesce(b.tp / b.n, 1), 4) AS "precision", round(coalesce(b.tp / positives, 0), 4) AS recall, round(coalesce(b.n / rows, 0), 4) AS coverage, coalesce(b.n, 0)::BIGINT AS accepted FROM g"""
)
def precision_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("class_name"), "value", (F.col("user_id") % 3 == 0).alias("pos"))
    out = calibrate.precision_threshold(rows, ["class_name"], "value", "pos", 0.35, 20)
    return out.select("class_name", *[F.round(c, 4).alias(c) for c in ("threshold", "precision", "recall", "coverage")], "accepted")


@query("""SELECT vec_id AS id, ((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR)) - 1) % 5)::INT AS fold FROM embeddings""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibrate.folds(table(spark, sf_dir, "embeddings"), "label", F.md5(F.col("vec_id").cast("string").cast("binary")), 5)
    return rows.select(F.col("vec_id").alias("id"), F.col("fold").cast("int").alias("fold"))


@query()
def centroid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class against the rest for each label."""
    rows = table(spark, sf_dir, "embeddings").withColumn("class_name", F.explode(F.sequence(F.lit(0), F.lit(9))))
    rows = rows.withColumn("accepted", F.col("label") == F.col("class_name"))
    return calibrate.calibrate(rows, "embedding", "class_name", "accepted", F.md5(F.col("vec_id").cast("string").cast("binary")), 0.5, 5, 5)
