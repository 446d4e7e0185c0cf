import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import calibrate, dedup, detect_eval, similarity, split
from sieveline.operators.graph import min_labels


def hashes(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(5)]
    out = []
    for k in range(n):
        h = r.choice(centres)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(64)
        out.append((k, f"{r.getrandbits(60):016x}" if r.random() < 0.9 or not out else r.choice(out)[1], h - (1 << 64) if h >> 63 else h))
    return out


def near(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


@pytest.mark.parametrize("distance", [0, 3, 6, 9])
def test_pairs_equal_brute_force(spark, distance):
    rows = hashes(60, distance)
    df = spark.createDataFrame(rows, "id long, sha256 string, hash long")
    got = similarity.hamming_pairs(df, df, distance).collect()
    want = {(a[2], b[2], near(a[2], b[2])) for a in rows for b in rows if near(a[2], b[2]) <= distance}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_leaders_equal_the_loop(spark):
    rows = hashes(50, 5)
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "id long, sha256 string, hash long, ord long")
    kept, want, seen = [], {}, {}
    for k, sha, h in rows:
        if sha in seen:
            want[k] = ("exact", seen[sha], None)
            continue
        seen[sha] = k
        close = [(near(h, g), j) for j, g in kept if near(h, g) <= 6]
        if close:
            want[k] = ("near", min(close)[1], min(close)[0])
        else:
            kept.append((k, h))
            want[k] = ("kept", None, None)
    got = {r["id"]: (r["status"], r["duplicate_of"], r["distance"]) for r in similarity.leaders(df, 6).collect()}
    assert got == want


def test_leader_is_not_a_component(spark):
    df = spark.createDataFrame([(1, "a", 0, 1), (2, "b", 7, 2), (3, "c", 63, 3)], "id long, sha256 string, hash long, ord long")
    assert {r["id"]: r["status"] for r in similarity.leaders(df, 3).collect()} == {1: "kept", 2: "near", 3: "kept"}
    assert {r["group_size"] for r in similarity.leakage_groups(df, 3).collect()} == {3}
    assert {r["status"] for r in similarity.leaders(df, -1).collect()} == {"kept"}


def test_attach_takes_the_smallest_sha(spark):
    old = spark.createDataFrame([("bb", 1, "G2"), ("aa", 3, "G1")], "sha256 string, hash long, leakage_group string")
    new = spark.createDataFrame([("cc", 0, 1), ("dd", 255 << 40, 2), ("bb", 5, 3)], "sha256 string, hash long, ord long")
    got = {r["sha256"]: r["leakage_group"] for r in similarity.attach(new, old, 2).collect()}
    assert got == {"cc": "G1", "dd": "dhash-dd"}
    match = similarity.match_baseline(new.filter("sha256 = 'cc'").withColumnRenamed("ord", "id"), old.withColumn("id", F.when(F.col("sha256") == "bb", 10).otherwise(20).cast("long")), 2).first()
    assert (match["duplicate_of"], match["distance"]) == (10, 1)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30)] + [(50, 60)], "src long, dst long")
    labels = {r["node"]: r["label"] for r in min_labels(edges).collect()}
    assert labels == {**{k: 0 for k in range(31)}, 50: 50, 60: 50}
    assert min_labels(edges.limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = [("s", 1, ["x"], "A"), ("s", 2, ["x", "y"], "B"), ("s", 3, ["p", "q"], "C"), ("t", 4, [], "A")]
    df = spark.createDataFrame(rows, "sha256 string, ord long, labels array<string>, source string")
    got = {r["sha256"]: r for r in dedup.exact_dedup(df).collect()}
    assert (got["s"]["source"], got["s"]["copies"], got["s"]["annotation_conflict"]) == ("B", 3, True)
    assert not got["t"]["annotation_conflict"]
    assert sorted(map(tuple, dedup.class_sources(df).collect())) == [("s", 1, "A"), ("s", 2, "B"), ("s", 3, "C"), ("t", 1, "A")]


def test_a_digest_with_half_of_all_rows_is_scanned_in_parts(spark):
    rng = random.Random(4)
    rows = []
    for k in range(800):
        sha = rng.choice(["hot", "hot", f"s{k % 40}", f"u{k}", None] if k % 7 else ["hot"])
        rows.append((sha, k * 3 % 2401, rng.sample(["x", "y", "z"], rng.choice([0, 0, 0, 1, 1, 2])) if k > 40 else [], f"f{k}", "clash"))
    df = spark.createDataFrame(rows, "sha256 string, ord long, labels array<string>, source string, nth string")
    best, count, flag, places = {}, {}, {}, []
    for sha, order, labels, source, _ in sorted(rows, key=lambda r: r[1]):
        held = best.get(sha)
        if labels and held and held[0] and set(labels) != set(held[1]):
            flag[sha] = True
        count[sha] = count.get(sha, 0) + 1
        places.append((str(sha), count[sha], source))
        if not held or len(labels) > held[0]:
            best[sha] = (len(labels), labels, source)
    frame = df.drop("nth")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        got = {r["sha256"]: (r["source"], r["copies"], r["annotation_conflict"]) for r in dedup.exact_dedup(frame).collect()}
        scanned = dedup.prefix_scan(frame)
        spread = frame.withColumn("k", F.coalesce("sha256", F.lit(""))).repartitionByRange(F.col("k"), F.col("ord")).filter("k = 'hot'").select(F.spark_partition_id()).distinct().count()
        nths = sorted((str(r["sha256"]), r["nth"], r["source"]) for r in scanned.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {sha: (best[sha][2], n, flag.get(sha, False)) for sha, n in count.items()}
    assert nths == sorted(places) and spread >= 4


def test_threshold(spark):
    df = spark.createDataFrame([("c", 0.9, 1), ("c", 0.8, 1), ("c", 0.7, 0), ("c", 0.6, 1)], "k string, s double, y int")
    r = calibrate.precision_threshold(df, ["k"], "s", "y", 0.75, 1).first()
    assert (r["threshold"], r["precision"], r["recall"], r["coverage"], r["accepted"]) == (0.6, 0.75, 1.0, 1.0, 4)
    none = spark.createDataFrame([("c", 0.9, 0), ("c", 0.8, 0)], "k string, s double, y int")
    r = calibrate.precision_threshold(none, ["k"], "s", "y", 0.98, 1).first()
    assert (round(r["threshold"], 9), r["precision"], r["recall"], r["coverage"], r["accepted"]) == (0.900001, 1.0, 0.0, 0.0, 0)


def test_calibration(spark):
    rows = [("laksa", k < 6, [0.95, 0.05] if k < 6 else [0.05, 0.95], k) for k in range(12)]
    df = spark.createDataFrame(rows, "c string, ok boolean, v array<double>, k int")
    r = calibrate.calibrate(df, "v", "c", "ok", F.col("k"), 1.0, 3, 2).first()
    assert r["precision"] == 1.0 and r["recall"] > 0 and r["threshold"] < 1.0


def test_greedy_match(spark):
    pairs = spark.createDataFrame([("i", 0, 1, 0, 0.9, 0.6), ("i", 0, 1, 1, 0.9, 0.7), ("i", 0, 2, 1, 0.8, 0.95)], "image string, class_id int, p long, g long, conf double, iou double")
    assert detect_eval.greedy_matches(pairs).first()["matches"] == [(1, 1)]


def test_best_point_ties(spark):
    rows = spark.createDataFrame([(0.1, 0.5), (0.2, 0.6), (0.3, 0.6)], "threshold double, macro_f1 double")
    assert detect_eval.best_point(rows).first()["threshold"] == 0.2
    down = spark.createDataFrame([(0.1, 0.6000049), (0.2, 0.6000049)], "threshold double, macro_f1 double")
    assert detect_eval.best_point(down, reference_ties=True).first()["threshold"] == 0.2


def test_integer_targets():
    r = ["0.7", "0.2", "0.1"]
    assert [split.integer_targets(n, r) for n in (10, 11, 5)] == [[7, 2, 1], [8, 2, 1], [4, 1, 0]]
    assert split.half_up(9, "0.5") == 5
    with pytest.raises(ValueError):
        split.check_ratios(["0.7", "0.2", "0.2"])


def manifest(spark, extra=0):
    rows = []
    for c in range(6):
        for k in range(10 + extra):
            group = "paired" if c == 5 and k in (8, 9) else f"group-{c}-{k}"
            rows.append((f"{c}-{k}", group, c, 1, {str(c): 1}))
    return spark.createDataFrame(rows, "sha256 string, leakage_group string, class_id int, bbox_count int, object_class_counts map<string,int>")


def test_fresh_split(spark):
    df = manifest(spark)
    groups = split.group_vectors(df, 6)
    out = df.join(split.assign(groups, split.integer_targets(60, ["0.7", "0.2", "0.1"]), 42), "leakage_group")
    assert {r["split"]: r["images"] for r in split.split_counts(out).collect()} == {"train": 42, "val": 12, "test": 6}
    assert split.crossing_groups(out).count() == 0
    assert out.select("class_id", "split").distinct().count() == 18


def test_incremental_split(spark):
    df = manifest(spark)
    first = split.assign(split.group_vectors(df, 6), [42, 12, 6], 42)
    more = manifest(spark, 2)
    locked = first
    total, test = more.count(), 6
    train = split.half_up(total - test, "0.8")
    out = more.join(split.assign(split.group_vectors(more, 6), [train, total - test - train, test], 42, locked=locked), "leakage_group")
    assert {r["split"]: r["images"] for r in split.split_counts(out).collect()} == {"train": 53, "val": 13, "test": 6}
    kept = out.join(locked.withColumnRenamed("split", "was"), "leakage_group").filter("split <> was").count()
    assert kept == 0


@pytest.mark.parametrize("distance", [9, 10, 14, 18])
def test_probes_equal_brute_force(spark, monkeypatch, distance):
    """Changed bits of a band find all pairs, each of them once."""
    monkeypatch.setattr(similarity, "COMPARE", 1e9)
    monkeypatch.setattr(similarity, "PROBES", 3000)
    rng = np.random.default_rng(distance)
    a = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    near = a.copy()
    for k in range(len(near)):
        for bit in rng.choice(64, rng.integers(0, distance + 3), replace=False):
            near[k] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    left = spark.createDataFrame([(int(x),) for x in a] + [(None,), (int(a[0]),)], "hash long")
    right = spark.createDataFrame([(int(x),) for x in [*near, *a[:7]]], "hash long")
    for x, y in ((left, right), (right, left)):
        plan = similarity.probe_plan(60, 67, distance)
        assert plan and sum(r + 1 for _, _, r in plan) == distance + 1
        want = sorted({(i, j, bin((i ^ j) & ((1 << 64) - 1)).count("1")) for i in {r[0] for r in x.collect() if r[0] is not None} for j in {r[0] for r in y.collect() if r[0] is not None}})
        got = sorted(map(tuple, similarity.hamming_pairs(x, y, distance).collect()))
        assert got == [w for w in want if w[2] <= distance] and len(got) > 30


def test_probes_are_taken_where_they_cost_less():
    assert similarity.probe_plan(5000, 5000, 14) is None and similarity.probe_plan(10**6, 10**6, 18) is None
    for distance in (10, 14):
        plan = similarity.probe_plan(10**7, 10**7, distance)
        share = sum(similarity._choices(mask.bit_length(), r) / (mask + 1) for _, mask, r in plan)
        assert share < 1 / 20
    assert sum(similarity._choices(m.bit_length(), r) / (m + 1) for _, m, r in similarity.probe_plan(10**8, 10**8, 14)) < 1 / 50
    # distances that bands prune take more bands to agree as hashes become more
    assert [similarity._agree(10**k, 6, 64) for k in (3, 5, 7, 8)] == sorted(similarity._agree(10**k, 6, 64) for k in (3, 5, 7, 8)) and similarity._agree(10**8, 6, 64) > 3


def test_keys_of_pairs_are_never_broadcast(spark):
    """keys are many times the hashes, so that a broadcast
    chosen by the size of the hashes would be built of them by the driver."""
    r = random.Random(4)
    own = [r.getrandbits(63) for _ in range(400)]
    rows = spark.createDataFrame([(h,) for h in own + [h ^ 5 for h in own[:50]]], "hash long")
    for distance, options in ((6, {}), (6, {"agree": 3})):
        found = similarity.hamming_pairs(rows, rows, distance, **options).filter("a < b")
        assert found.count() >= 50
        found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_attach_with_many_copies_of_a_hash(spark):
    """the rows of a hash that can lead are few, in any order of shas."""
    r = random.Random(6)
    made = [(k, f"{r.getrandbits(60):016x}", r.choice([0, 1, 255]), "g" if k % 40 == 0 else None) for k in range(400)]
    rows = spark.createDataFrame(made, "ord long, sha256 string, hash long, leakage_group string")
    out = {x["sha256"]: x["leakage_group"] for x in similarity.attach(rows.filter("leakage_group is null"), rows.filter("leakage_group is not null"), 3).collect()}
    known = [(sha, h, g) for _, sha, h, g in made if g]
    for _, sha, h, g in made:
        if not g:
            met = min(((s, x) for s, b, x in known if near(h, b) <= 3), default=(sha, f"dhash-{sha[:16]}"))
            known.append((sha, h, met[1]))
            assert out[sha] == met[1]


def test_calibration_deals_vectors_once(spark, monkeypatch):
    """vectors are dealt and written once, and read from there."""
    rows = spark.createDataFrame([("a", k % 2 == 0, [1.0 * (k % 2), 1.0, k / 10]) for k in range(20)], "class_name string, accepted boolean, e array<double>").withColumn("o", F.md5(F.col("e").cast("string")))
    seen, cut = [], calibrate.cut
    monkeypatch.setattr(calibrate, "cut", lambda df: seen.append(df.columns) or cut(df))
    assert calibrate.calibrate(rows, "e", "class_name", "accepted", F.col("o"), 0.5, 5, 2).count() == 1
    assert seen.count(["class_name", "pos", "fold", "v"]) == 1


def test_grid_writes_its_boxes_once(spark, monkeypatch):
    """boxes are written once, and what each suppression keeps."""
    box = [(1, 0, k, 10.0 * k, 0.0, 10.0 * k + 9, 9.0, 0.5) for k in range(4)]
    p = spark.createDataFrame(box, "image int, class_id int, ord int, x1 double, y1 double, x2 double, y2 double, conf double")
    seen, cut = [], detect_eval.cut
    monkeypatch.setattr(detect_eval, "cut", lambda df: seen.append(df.columns) or cut(df))
    assert {r["macro_f1"] for r in detect_eval.sweep_grid(p.drop("conf"), p, [0.1, 0.4], [0.5, 0.7], 0.5).collect()} == {1.0}
    assert len(seen) == 4
