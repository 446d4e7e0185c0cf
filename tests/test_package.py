"""Digests of tables, staged outputs, scorers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import audit, merge, package, score
from sieveline.sources import sinks


def tables(spark, seed=0):
    rng = random.Random(seed)
    left = [(k, rng.choice(["a", "b", None, ""]), rng.random()) for k in range(500)] + [(7, "twice", 1.0)] * 2 + [(None, "none", 0.5)]
    right = [r for k, r in enumerate(left) if k % 101 != 3]
    right = [(r[0], "changed", r[2]) if k % 97 == 5 else r for k, r in enumerate(right)] + [(1000, "new", 0.0), (1001, None, None)]
    right.remove((7, "twice", 1.0))
    schema = "id long, name string, value double"
    return left, right, spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).select("value", "name", "id").repartition(5)


def changes(left, right):
    out = {}
    for key in {r[0] for r in left + right}:
        a, b = (sorted(map(str, (r for r in side if r[0] == key))) for side in (left, right))
        only = [x for x in a if a.count(x) > b.count(x)], [x for x in b if b.count(x) > a.count(x)]
        if only[0] or only[1]:
            out[key] = "changed" if only[0] and only[1] else "missing" if only[0] else "extra"
    return out


@pytest.mark.parametrize("depth", [0, 3, 8, 12])
def test_drift_equals_brute_force(spark, depth):
    left, right, a, b = tables(spark)
    assert {r["id"]: r["change"] for r in package.drift(a, b, "id", depth).collect()} == changes(left, right)
    assert package.drift(a, a.repartition(3), "id", depth).count() == 0
    assert {r["change"] for r in package.drift(a, a.limit(0), "id", depth).collect()} == {"missing"} and package.drift(a.limit(0), a.limit(0), "id", depth).count() == 0


def test_only_differing_buckets_are_looked_at(spark):
    left = spark.range(20000).select("id", (F.col("id") * 3).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") % 4999 == 1, -1).otherwise(F.col("v")))
    trees = [package.tree(package.row_digests(t, "id")) for t in (left, right)]
    buckets = package.differing(*trees)
    assert 0 < len(buckets) <= 5
    assert package.row_digests(left, "id").filter(F.col("bucket").isin(buckets)).count() < 2000
    root = trees[0].filter("level = 0").first()
    assert root["n"] == 20000 and trees[0].groupBy("level").agg(F.sum("n").alias("n")).select("n").distinct().count() == 1


def test_written_packages(spark, tmp_path):
    left, right, a, b = tables(spark, 1)
    for name, df in (("a", a), ("b", b)):
        package.write_package(df, f"{tmp_path}/{name}", "id")
    out = package.package_drift(spark, f"{tmp_path}/a", f"{tmp_path}/b", "id")
    assert {r["id"]: r["change"] for r in out.collect()} == changes(left, right)
    assert sorted(spark.read.parquet(f"{tmp_path}/a/rows").drop("__bucket").collect(), key=str) == sorted(a.collect(), key=str)


def test_commit_appears_whole_or_not_at_all(spark, tmp_path):
    good = spark.createDataFrame([("x", "train"), ("y", "val")], "sha256 string, split string")
    bad = good.union(good.limit(1))
    unique = lambda df: audit.repeated(df, "sha256")
    path = f"{tmp_path}/out"
    told = sinks.commit(good, path, [unique], figures={"vals": F.count_if(F.col("split") == "val")}, expected={"rows": 2, "vals": 1})
    assert (told["rows"], told["vals"]) == (2, 1) and spark.read.parquet(path).count() == 2
    with pytest.raises(FileExistsError):
        sinks.commit(bad, path)
    with pytest.raises(sinks.AuditError, match="x"):
        sinks.commit(bad, path, [unique], replace=True)
    with pytest.raises(sinks.AuditError, match="rows is 3, not 2"):
        sinks.commit(bad, f"{tmp_path}/other", expected={"rows": 2})
    with pytest.raises(Exception, match="(?i)divide|zero"):
        sinks.commit(good.select(F.expr("raise_error('divide')").alias("v")), f"{tmp_path}/other")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and spark.read.parquet(path).count() == 2
    sinks.commit(good.limit(1), path, [unique], replace=True, partition_by=["split"])
    assert spark.read.parquet(path).count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_runs_are_kept(spark, tmp_path):
    one = spark.createDataFrame([("x",)], "sha256 string")
    for k in range(4):
        sinks.commit_run(one, str(tmp_path), f"r{k}", keep=2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["run_id=r2", "run_id=r3"]
    with pytest.raises(FileExistsError):
        sinks.commit_run(one, str(tmp_path), "r3", keep=1)
    assert spark.read.parquet(str(tmp_path)).count() == 2


def names_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    digest = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    rows = [(digest(k), "missing", k % 6, None) for k in range(300)] + [(None, "none", 1, None), ("00" + "1" * 62, "digits", 0, None)]
    manifest = spark.createDataFrame(rows, "sha256 string, annotation_status string, class_id int, bbox_count int")
    path = tmp_path / "manifest"
    sinks.write_bucketed(manifest, str(path))
    before = names_of(path)
    labels = spark.createDataFrame([(digest(3), ["1 0 0 1 1"], [1]), (digest(200), [], [])], "sha256 string, rows array<string>, classes array<int>")
    wishes = spark.createDataFrame([], "sha256 string, class_id int")
    touched = sinks.upsert(spark, str(path), labels, lambda old: merge.first_merge(old, labels, wishes).select(*manifest.columns))
    want = merge.first_merge(manifest, labels, wishes).select(*manifest.columns)
    key = lambda df: sorted(map(str, df.select(*manifest.columns).collect()))
    assert touched == sorted({digest(3)[:2], digest(200)[:2]}) and key(sinks.read_bucketed(spark, str(path))) == key(want)
    kept = {n for n in before if n.split("/")[0][7:] not in touched}
    assert kept <= names_of(path) and not (before - kept) & names_of(path)
    # new keys, keys without a digest, and a bucket that is left empty
    new = spark.createDataFrame([(digest(1000), "new", 2, 1), (None, "another", 1, 1)], manifest.schema)
    sinks.upsert(spark, str(path), new, lambda old: old.unionByName(new))
    assert key(sinks.read_bucketed(spark, str(path))) == key(want.unionByName(new))
    gone = spark.createDataFrame([("00" + "1" * 62,), (None,)], "sha256 string")
    sinks.upsert(spark, str(path), gone, lambda old: old.filter("not sha256 like '00%' and sha256 is not null"))
    left = sinks.read_bucketed(spark, str(path))
    assert key(left) == key(want.unionByName(new).filter("not coalesce(sha256, '00') like '00%'")) and sinks.upsert(spark, str(path), gone.limit(0), lambda old: old) == []
    with pytest.raises(ValueError, match="no change touches"):
        sinks.upsert(spark, str(path), labels, lambda old: old.withColumn("sha256", F.lit("zz")))


def test_scorer_gets_bounded_batches(spark):
    class Lengths:
        def __init__(self, factor):
            self.factor = factor

        def score(self, values):
            assert sum(map(len, values)) <= 40 or len(values) == 1
            return np.array([[len(v) * self.factor, len(values)] for v in values])

    texts = ["a" * (k % 30) for k in range(100)] + [None, "b" * 300]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    shared = spark.sparkContext.broadcast(2.0)
    got = {r["id"]: r["s"] for r in df.select("id", score.score_column(F.col("text"), shared, Lengths, 2, most=40).alias("s")).collect()}
    assert all((got[k] is None) == (t is None) and (t is None or got[k][0] == 2 * len(t)) for k, t in enumerate(texts)) and got[101][1] == 1
    assert df.limit(0).select(score.score_column(F.col("text"), shared, Lengths, 2)).count() == 0


@pytest.mark.parametrize("wrong", [lambda v: np.zeros((len(v) + 1, 2)), lambda v: np.zeros((len(v), 3)), lambda v: np.zeros(len(v))])
def test_a_wrong_number_of_scores_is_an_error(spark, wrong):
    class Wrong:
        def __init__(self, _):
            pass

        def score(self, values):
            return wrong(values)

    df = spark.createDataFrame([("a",), ("b",)], "text string")
    with pytest.raises(Exception, match="the scorer gave"):
        df.select(score.score_column(F.col("text"), spark.sparkContext.broadcast(None), Wrong, 2)).collect()


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 3.0]), (3, [0.0, 0.0]), (4, None)], "id long, v array<double>")
    centres = spark.createDataFrame([(5, [2.0, 0.0]), (3, [0.0, 1.0])], "label int, centroid array<double>")
    got = {r["id"]: (r["best"], r["best_score"] and round(r["best_score"], 3)) for r in score.nearest(df, centres, "v").collect()}
    assert got == {1: (5, 0.995), 2: (3, 0.999), 3: (3, 0.0), 4: (None, None)}
