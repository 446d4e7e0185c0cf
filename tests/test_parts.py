"""Sources, sinks, streams, audits and samples that no query over the tables reaches."""

import json
import os
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import web
from sieveline.operators import advisory, audit, calibrate, detect_eval, merge, report, sample, similarity
from sieveline.sources import files, sinks
from sieveline.streaming import ingest


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_images_in_folders(spark, tmp_path):
    for name, data in (("pizza/a.jpg", b"one"), ("pizza/b.PNG", b"no"), ("pizza/b.png", b"two"), ("taco/c.webp", b"one"), ("taco/readme.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan_images(spark, str(tmp_path))
    assert {(os.path.basename(r["path"]), r["class_name"], r["file_bytes"]) for r in found.collect()} >= {("a.jpg", "pizza", 3), ("b.png", "pizza", 3), ("c.webp", "taco", 3)}
    assert found.groupBy("sha256").count().filter("count = 2").count() == 1
    assert {os.path.basename(r["path"]) for r in files.scan_images(spark, str(tmp_path), first_per_class=1).filter("class_name = 'taco'").collect()} == {"c.webp"}


def test_pairs_by_stem(spark):
    images = spark.createDataFrame([("a", "a.jpg"), ("a", "a.png"), ("b", "b.jpg"), ("c", "c.jpg")], "stem string, path string")
    labels = spark.createDataFrame([("b", "0 1"), ("d", "0 2")], "stem string, line string")
    pairs, twice = files.pair_by_stem(images, labels)
    assert rows_of(pairs, "stem", "path", "line") == [("b", "b.jpg", "0 1")] and rows_of(twice, "stem", "n") == [("a", 2)]
    assert {r["stem"] for r in files.pair_by_stem(images, labels, optional=True)[0].collect()} == {"b", "c"}


def test_selections_of_others(spark, tmp_path):
    for name, group in (("one", "g1"), ("two", "g2"), ("own", "g3")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "selection.jsonl").write_text(json.dumps({"leakage_group": group}) + "\n")
    got = files.read_selections(spark, f"{tmp_path}/*/selection.jsonl", "own", "leakage_group string")
    assert rows_of(got, "leakage_group") == [("g1",), ("g2",)]


def test_decisions_from_folders(spark):
    paths = spark.createDataFrame([("x/accepted/pizza/1.jpg",), ("x/rejected/pizza/1.jpg",), ("x/accepted/pizza/2.jpg",), ("x/maybe/pizza/3.jpg",), ("x/accepted/pizza/9.jpg",)], "path string")
    manifest = spark.createDataFrame([("pizza", str(k), f"s{k}", "pending") for k in (1, 2, 3, 4)] + [("pizza", "5", "s5", "duplicate")], "candidate_class string, image_id string, sha256 string, status string")
    decisions, wrong = files.decisions_from_folders(paths, manifest)
    assert ("pizza", "s2", "accepted") in rows_of(decisions, "candidate_class", "sha256", "label")
    assert rows_of(wrong, "check", "key") == [("conflicting_labels", "pizza/1"), ("missing_decision", "pizza/4"), ("unknown_image", "pizza/9"), ("unresolved_label", "pizza/3")]


def test_scrape_records(spark):
    after = spark.createDataFrame([("p0", "a_b"), ("p1", "a_b"), ("p2", "a_b"), ("p3", "a_b")], "path string, class_name string")
    before = after.filter("path = 'p0'")
    log = spark.createDataFrame([("p1", "from log", "http://x")], "path string, query string, url string")
    fallback = spark.createDataFrame([("p2", "from fallback", "other")], "path string, query string, engine string")
    got = files.scrape_records(after, before, log, fallback, "main", 3)
    assert rows_of(got, "path", "query", "engine") == [("p1", "from log", "main"), ("p2", "from fallback", "other")]


def test_candidates_of_several_datasets(spark):
    a, b = spark.createDataFrame([(1,)], "ord int"), spark.createDataFrame([(1, "x")], "ord int, note string")
    got = files.union_candidates([("first", a), ("second", b)])
    assert [(r["dataset"], r["source_ord"], r["note"]) for r in got.orderBy("source_ord").collect()] == [("first", 0, None), ("second", 1, "x")]
    with pytest.raises(ValueError):
        files.union_candidates([])


def test_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"classes": {"pizza": {"prompts": ["a pizza"]}}, "deduplication": {"dhash_distance": 6}}))
    classes, settings = files.read_config(spark, str(path))
    assert classes.first()["prompts"] == ["a pizza"] and settings["deduplication"] == {"dhash_distance": 6.0} and settings["semantic"] == {}
    for wrong in ({"classes": {}}, {"classes": {"pizza": {"prompts": []}}}, {}):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            files.read_config(spark, str(path))


def test_damaged_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.yaml", "names: [a]")
        z.writestr("train.txt", "images/1.jpg\n")
        z.writestr("labels/1.txt", "0 0.5 0.5 1 1\n")
    assert rows_of(files.read_label_archives(spark, str(tmp_path)), "member", "line", "listed") == [("labels/1.txt", "0 0.5 0.5 1 1", True)]
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(b"0 0.5 0.5")
    raw[at] ^= 1
    (tmp_path / "a.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        files.read_label_archives(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "accepted", "pizza", "train"), ("s2", "rejected", "taco", "test")], "sha256 string, status string, candidate_class string, split string")
    sinks.write_by_status(df, f"{tmp_path}/status")
    sinks.write_split(df, f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/status/status=accepted/candidate_class=pizza").count() == 1
    assert {p.name for p in (tmp_path / "split").glob("split=*")} == {"split=train", "split=test"}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_split(df, f"{tmp_path}/split")
    for run in ("r1", "r2"):
        sinks.write_run(df, f"{tmp_path}/runs", run)
    assert rows_of(spark.read.parquet(f"{tmp_path}/runs").groupBy("run_id").count(), "run_id", "count") == [("r1", 2), ("r2", 2)]
    boxes = spark.createDataFrame([("a", 1, 0, 0.5, 0.5, 0.25, 0.25), ("a", 0, 2, 0.1, 0.2, 0.3, 0.4)], "stem string, ord int, class_id int, cx double, cy double, w double, h double")
    assert sinks.label_files(boxes).first()["text"] == "2 0.10000000 0.20000000 0.30000000 0.40000000\n0 0.50000000 0.50000000 0.25000000 0.25000000"
    assert json.loads(sinks.summary_json(df, F.count(F.lit(1)).alias("n")).first()["summary"]) == {"n": 2}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-09 00:00:00", "b", 4.0), ("2024-01-20 00:00:00", "c", 0.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(1).write.parquet(f"{tmp_path}/events")
    stream = ingest.replay(spark, f"{tmp_path}/events", events.schema)
    query = ingest.live_counts(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["event_type"], r["n"], r["value"]) for r in spark.table("live").collect()} >= {("a", 2, 3.0), ("b", 1, 4.0)}
    uploads = spark.createDataFrame([("x.jpg", "2024-01-01 00:00:00"), ("x.jpg", "2024-01-01 01:00:00"), ("y.jpg", "2024-01-01 02:00:00")], "name string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    uploads.repartition(1).write.parquet(f"{tmp_path}/uploads")
    query = ingest.unexpired(ingest.replay(spark, f"{tmp_path}/uploads", uploads.schema), 24).writeStream.format("memory").queryName("uploads").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows_of(spark.table("uploads"), "name") == [("x.jpg",), ("y.jpg",)]


def test_locked_and_incremental_splits(spark):
    records = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g3"), ("e", "g4")], "sha256 string, leakage_group string")
    base = spark.createDataFrame([("g1", "test"), ("g2", "train"), ("g3", "test"), ("g2", "train")], "leakage_group string, split string")
    accepted = spark.createDataFrame([("a", "g1"), ("z", "g1")], "sha256 string, leakage_group string")
    plan = audit.locked_plan(records, base, accepted)
    assert rows_of(plan, "leakage_group", "split", "assignment_source") == [("g1", "test", "locked_reviewed_holdout"), ("g2", "train", "preserved_base_split")]
    assert rows_of(audit.locked_plan_audit(records, base, accepted), "check", "key") == [("accepted_missing", "z"), ("base_test_not_accepted", "g3"), ("unreviewed_member", "b")]
    split = spark.createDataFrame(
        [("a", "g1", "test", "locked_reviewed_holdout"), ("b", "g5", "val", "locked_reviewed_holdout"), ("c", "g2", "test", "preserved_base_split"), ("d", "g3", "train", "new_incremental_group"), ("e", "g4", "val", None)],
        "sha256 string, leakage_group string, split string, assignment_source string",
    )
    told = spark.createDataFrame([("test", 2), ("val", 2)], "split string, locked_groups int")
    got = rows_of(audit.incremental_audit(split, told), "key", "detail")
    assert got == [("b", "holdout_escaped"), ("c", "entered_test"), ("c", "preserved_elsewhere"), ("e", "invalid_source")]
    counted = audit.incremental_audit(split, told.filter("split = 'test'"))
    assert ("locked_groups_drifted", "val") in rows_of(counted, "check", "key")


def test_holdout_audit_in_parts_equals_brute_force(spark, monkeypatch):
    """Keys on one side, repeated and null keys; parts follow from the rows, not from the session."""
    rng = np.random.default_rng(14)
    some = lambda n: [None if k == 0 else f"k{k}" for k in rng.integers(0, 120, n).tolist()]
    keys = {"test": some(200), "queue": some(150), "manifest": some(170)}
    test = spark.createDataFrame([(k, f"g{n % 9}", "l", "c", "d", 1) for n, k in enumerate(keys["test"])], "sha256 string, leakage_group string, label_sha256 string, class_name string, destination_image string, bbox_count int")
    queue = spark.createDataFrame([(k, "pending", "g", "c", "d") for k in keys["queue"]], "sha256 string, review_status string, leakage_group string, class_name string, destination_image string")
    manifest = spark.createDataFrame([(k, "g", "l", 1, "annotated", "p", k) for k in keys["manifest"]], "sha256 string, leakage_group string, label_sha256 string, bbox_count int, annotation_status string, destination_label string, image_sha256 string")
    splits = spark.createDataFrame([("g1", "val"), ("g1", "train"), ("g2", "test"), ("h", "val")], "leakage_group string, split string")
    want = {("test_group_elsewhere", "g1", "train,val")}
    for a, b, check in (("test", "queue", "queue_missing"), ("queue", "test", "queue_extra")):
        want |= {(check, k, None) for k in keys[a] if k is None or k not in keys[b]}
    want |= {(f"repeated_sha256_{name}", k, str(ks.count(k))) for name, ks in keys.items() for k in ks if ks.count(k) > 1}
    joined = [(k, d) for k, d in ((k, "missing_from_manifest") for k in keys["test"] if k is None or k not in keys["manifest"])]
    for part in (1 << 18, 20):
        monkeypatch.setattr(audit, "PART", part)
        out = audit.holdout_audit(test, queue, manifest, splits=splits)
        got = [tuple(r) for r in out.collect()]
        assert {x for x in got if x[0] != "holdout"} == want and len([x for x in got if x[0] != "holdout"]) == len(want)
        missing = [x[1:] for x in got if x[2] == "missing_from_manifest"]
        times = {k: max(1, keys["queue"].count(k)) if k else 1 for k, _ in joined}
        assert sorted(map(str, missing)) == sorted(str(x) for x in joined for _ in range(times[x[0]]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = set(re.findall(r"hashpartitioning\((?:sha256|leakage_group)#\d+, (\d+)\)", plan))
    assert parts == {"10"}  # 200 rows in parts of 20; the session's own number is 4


def test_pilot_and_summary(spark):
    selection = spark.createDataFrame([("a", "i/a"), ("b", "i/b"), ("c", "i/c"), ("d", "i/d")], "sha256 string, destination_image string")
    manifest = spark.createDataFrame([("a", "i/a", "missing"), ("b", "i/b", "annotated"), ("c", "j/c", "missing")], "sha256 string, destination_image string, annotation_status string")
    assert rows_of(audit.pilot_audit(selection, manifest), "key", "detail") == [("b", "not_open"), ("c", "destination_moved"), ("d", "missing_from_manifest")]
    now = spark.createDataFrame([("train", 3, 4), ("val", 1, 1)], "split string, images int, boxes int")
    told = spark.createDataFrame([("train", 3, 5), ("test", 1, 1)], "split string, images int, boxes int")
    assert rows_of(audit.count_drift(now, told, ["split"]), "key") == [("test/boxes",), ("test/images",), ("train/boxes",), ("val/boxes",), ("val/images",)]
    assert audit.count_drift(now, now, ["split"]).count() == 0


def test_new_records_come_once(spark):
    manifest = spark.createDataFrame([("a", 1)], "sha256 string, ord int")
    records = spark.createDataFrame([("b", 9), ("a", 2), ("b", 3), ("c", 4), ("c", 4)], "sha256 string, ord int")
    assert rows_of(merge.append_new(manifest, records, "ord"), "sha256", "ord") == [("a", 1), ("b", 3), ("c", 4)]


def test_quotas():
    classes, default = ["a", "b", "c"], {"a": 1}
    assert sample.parse_quotas(None, classes, default) == default
    assert sample.parse_quotas(["c=2", "a= 3"], classes, default) == {"a": 3, "b": 0, "c": 2}
    for wrong in (["a"], ["a=x"], ["d=1"], ["a=-1"], ["a=0", "b=0"]):
        with pytest.raises(ValueError):
            sample.parse_quotas(wrong, classes, default)


def test_take_until(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 0, 2), ("a", 0, 1), ("b", 1, 1)], "k string, priority int, at int")
    needed = spark.createDataFrame([("a", 2), ("b", 5)], "k string, needed int")
    assert rows_of(sample.take_until(df, needed, ["k"], ["priority", "at"]), "k", "priority", "at") == [("a", 0, 1), ("a", 0, 2), ("b", 1, 1)]


def test_usable_vectors(spark):
    good = spark.createDataFrame([([1.0, 0.0],)], "v array<double>")
    calibrate.require_usable(good, "v")
    for wrong, said in (([0.0, 0.0], "zero"), ([float("nan"), 1.0], "finite"), ([float("inf"), 1.0], "finite"), (None, "finite")):
        with pytest.raises(ValueError, match=said):
            calibrate.require_usable(good.union(spark.createDataFrame([(wrong,)], "v array<double>")), "v")


def test_addresses_in_result_pages(spark):
    page = 'x <script>a("http://a.com/1.jpg?w=2") "ou":"https://b.com/2\\u0026x"</script> <a href="/imgurl=https%3A//c.com/3.png&q">"ow":1,"oh":2,"ou":"https://d.com/4"'
    got = spark.range(1).select(web.found_urls(F.lit(page)).alias("u")).first()["u"]
    assert got[:2] == ["http://a.com/1.jpg?w=2", "https://b.com/2&x"] and "https://d.com/4" in got and "https://c.com/3.png" in got
    assert len(got) == len(set(got)) and all(u.startswith("http") for u in got)


def test_blocked_pages_and_results(spark):
    rows = spark.createDataFrame([("please VERIFY you're not a robot", "http://x"), ("fine", "http://google.com/sorry/i"), ("fine", "http://x")], "page string, url string")
    assert [r[0] for r in rows.select(web.is_blocked_browser(F.col("page"), F.col("url"))).collect()] == [True, True, False]
    counts = spark.createDataFrame([(3, 0), (0, 3), (2, 2)], "a int, b int")
    assert [r[0] for r in counts.select(web.is_result_page(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    assert spark.range(1).select(web.search_url("http://s/x", F.lit("a b&c"), F.lit(20))).first()[0] == "http://s/x?q=a+b%26c&start=20"


def test_suppression_and_grid_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    def box():
        x, y = rng.integers(0, 12, 2)
        return float(x), float(y), float(x + rng.integers(3, 9)), float(y + rng.integers(3, 9))
    truth = [(i, 0, k, *box()) for i in range(6) for k in range(4)]
    found = [(i, 0, k, *box(), float(rng.integers(1, 20)) / 20) for i in range(6) for k in range(12)]
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(w, 0) * max(h, 0)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)
    def kept(rows, overlap):
        out = []
        for r in sorted(rows, key=lambda r: (-r[7], r[2])):
            if all(r[0] != o[0] or iou(r[3:7], o[3:7]) <= overlap for o in out):
                out.append(r)
        return out
    def f1(rows, least):
        tp, taken = 0, set()
        rows = [r for r in rows if r[7] >= least]
        for r in sorted(rows, key=lambda r: (r[0], -r[7], r[2])):
            best = max(((iou(r[3:7], t[3:7]), -t[2], t) for t in truth if t[0] == r[0] and (t[0], t[2]) not in taken), default=None)
            if best and best[0] >= 0.5:
                taken.add((r[0], best[2][2]))
                tp += 1
        return 2 * tp / (len(rows) + len(truth)) if tp else 0.0
    t = spark.createDataFrame(truth, "image int, class_id int, ord int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(found, "image int, class_id int, ord int, x1 double, y1 double, x2 double, y2 double, conf double")
    for overlap in (0.1, 0.5):
        assert rows_of(detect_eval.suppress(p, overlap), "image", "ord") == sorted((r[0], r[2]) for r in kept(found, overlap))
    grid = detect_eval.sweep_grid(t, p, [0.1, 0.4, 0.7], [0.1, 0.5], 0.5)
    assert {(r["nms_iou"], r["threshold"]): round(r["macro_f1"], 9) for r in grid.collect()} == {(o, c): round(f1(kept(found, o), c), 9) for o in (0.1, 0.5) for c in (0.1, 0.4, 0.7)}
    best = detect_eval.best_of_grid(grid).first()
    assert best["macro_f1"] == max(r["macro_f1"] for r in grid.collect())


@pytest.mark.parametrize("distance", [0, 3, 6, 8, 12])
def test_pairs_within_a_distance_equal_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    values = sorted({b ^ sum(1 << int(k) for k in set(rng.integers(0, 63, n))) for b in base for n in range(0, 14, 2)})
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] + [(values[0],)], "hash long")
    got = rows_of(similarity.hamming_pairs(df, df.filter("hash % 2 = 0"), distance), "a", "b", "distance")
    assert got == sorted((a, b, (a ^ b).bit_count()) for a in values for b in values if b % 2 == 0 and (a ^ b).bit_count() <= distance)


def test_report_parts(spark):
    assert struct.calcsize("q") == 8
    rows = spark.createDataFrame([("r", "x", 0.5, 1), ("r", "y", 0.25, 2)], "request string, class_name string, confidence double, event_id int")
    assert json.loads(advisory.prompt_payload(rows, "request", "event_id").first()["payload"])["detections"][0]["class_name"] == "x"
    epochs = spark.createDataFrame([("a", 1, 0.2, 0.9), ("a", 2, 0.4, 0.1)], "run string, epoch int, map double, map50 double")
    assert report.best_epochs(epochs).count() == 1


def test_selection_and_prompts(spark):
    from sieveline.functions.scalar import relative_path

    none = "array<struct<c:string>>"
    rows = spark.createDataFrame([("g", "high", [("x",)]), ("g", "normal", []), ("h", "high", [])], f"leakage_group string, review_priority string, boxes {none}")
    assert tuple(report.selection_summary(rows).first()) == (3, 2, 2, 1)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(relative_path(F.lit("/data/x/y.jpg"), "/data/")) == "x/y.jpg" and one(relative_path(F.lit("/other/y"), "/data")) == "/other/y"
    assert one(advisory.chat_prompt(F.lit("kb"), F.lit(None).cast("string"), F.lit("q"))).split("\n\n")[1].startswith("No photo") and one(advisory.chat_prompt(F.lit("kb"), F.lit("s"), F.lit("q"))) == "kb\n\ns\n\nq"


def test_calibration_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [("c", bool(k % 3 == 0), (rng.standard_normal(4) + (1.0 if k % 3 == 0 else 0.0)).tolist(), f"{k:03}") for k in range(60)]
    rows += [("d", bool(k % 2), rng.standard_normal(4).tolist(), f"{k:03}") for k in range(20)]
    df = spark.createDataFrame(rows, "c string, ok boolean, v array<double>, o string")
    got = {r["class_name"]: r for r in calibrate.calibrate(df, "v", "c", "ok", F.col("o"), 0.6, 5, 5).collect()}

    def best(scores, positive):
        top = None
        for s in sorted(set(scores)):
            taken = [p for x, p in zip(scores, positive) if x >= s]
            if len(taken) >= 5 and sum(taken) / len(taken) >= 0.6:
                return s, sum(taken) / len(taken), sum(taken) / sum(positive), len(taken)
        return max(scores) + 1e-6, 1.0, 0.0, 0

    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for name in "cd":
        own = [r for r in rows if r[0] == name]
        u = np.array([np.array(r[2]) / np.linalg.norm(r[2]) for r in own])
        pos = np.array([r[1] for r in own])
        k, fold = min(5, pos.sum(), (~pos).sum()), np.zeros(len(own), int)
        for kind in (True, False):
            fold[pos == kind] = np.arange((pos == kind).sum()) % k
        oof = [cos(u[i], u[pos & (fold != fold[i])].sum(0)) - cos(u[i], u[~pos & (fold != fold[i])].sum(0)) for i in range(len(own))]
        full = [cos(x, u[pos].sum(0)) - cos(x, u[~pos].sum(0)) for x in u]
        a, b = best(oof, pos.tolist()), best(full, pos.tolist())
        assert got[name]["threshold"] == pytest.approx(max(a[0], b[0]), abs=1e-7)
        assert (got[name]["precision"], got[name]["recall"], got[name]["accepted"]) == (pytest.approx(a[1]), pytest.approx(a[2]), a[3])


def test_places_in_order(spark):
    rng = np.random.default_rng(9)
    rows = [(str(rng.integers(0, 3)) if rng.random() < 0.9 else None, f"{rng.integers(0, 1 << 32):08x}") for _ in range(200)]
    got = calibrate.places(spark.createDataFrame(rows, "k string, o string"), ["k"], F.col("o")).collect()
    want = {(k, o): sorted(x for j, x in rows if j == k).index(o) for k, o in rows}
    assert {(r["k"], r["o"]): r["__at"] for r in got} == want
