import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline import schemas
from sieveline.operators import advisory, audit, merge, report, sample
from sieveline.sources import files, sinks
from sieveline.streaming import ingest


def test_quota(spark):
    rows = [(c, f"group-{k}-{i}", f"{k}{i}".ljust(64, "a")) for k, c in enumerate(schemas.CLASSES) for i in range(4)]
    df = spark.createDataFrame(rows, "class_name string, leakage_group string, sha256 string")
    reserved = spark.createDataFrame([("group-0-0",), ("group-1-0",)], "leakage_group string")
    got = sample.quota_sample(df, {c: 2 for c in schemas.CLASSES}, 43, excluded=reserved).collect()
    assert len(got) == 12 and len({r["leakage_group"] for r in got}) == 12
    assert not {r["leakage_group"] for r in got} & {"group-0-0", "group-1-0"}
    again = sample.quota_sample(df, {c: 2 for c in schemas.CLASSES}, 43, excluded=reserved).collect()
    assert sorted(got) == sorted(again)
    assert sample.quota_sample(df, {"laksa": 0}, 1).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_quotas_equal_one_class_after_another(spark, seed):
    rng = random.Random(seed)
    names = [f"c{k:02}" for k in range(12)]
    rows = [(rng.choice(names), rng.choice([f"g{k}" for k in range(30)] + [None] * 3), f"s{k}", k) for k in range(300)]
    quotas = {n: rng.choice([0, 1, 2, 3, 9]) for n in rng.sample(names, 12)}
    df = spark.createDataFrame(rows, "class_name string, leakage_group string, sha256 string, at int")
    place = lambda r: (hashlib.sha256(f"5:{r[2]}".encode()).hexdigest(), r[2])
    want, used = [], set()
    for name, quota in quotas.items():
        heads = {}
        for r in sorted((r for r in rows if r[0] == name and r[1] not in used), key=place):
            heads.setdefault(r[1], r)
        own = sorted(heads.values(), key=place)[:quota]
        want += own
        used |= {r[1] for r in own if r[1]}
    got = sample.quota_sample(df, quotas, 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == df.columns


def test_many_classes_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sample, "cut", lambda df, old=sample.cut: written.append(1) or old(df))
    df = spark.range(3000).selectExpr("concat('c', id % 150) as class_name", "concat('g', id % 700) as leakage_group", "cast(id as string) as sha256")
    got = sample.quota_sample(df, {f"c{k}": 3 for k in range(150)}, 1).collect()
    assert len({r["leakage_group"] for r in got}) == len(got) and len(got) > 400 and len(written) < 40


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_exact_split_counts(spark, monkeypatch, few):
    monkeypatch.setattr(sample, "FEW", few)
    monkeypatch.setattr(sample, "DIGITS", 1)
    for n in (0, 1, 3, 10, 501):
        rows = [r["id"] for r in spark.range(n).collect()]
        got = {r["id"]: r["split"] for r in sample.exact_split(spark.range(n), F.col("id"), {"a": 0.29, "b": 0.57, "c": 0.14}).collect()}
        order = sorted(rows, key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
        a, b = n * 29 // 100, n * 57 // 100
        assert got == {k: "a" if j < a else "b" if j < a + b else "c" for j, k in enumerate(order)}
    assert {r["split"] for r in sample.exact_split(spark.range(4), F.col("id"), {"a": 1.0, "b": 0.0}).collect()} == {"a"}


def test_retention(spark):
    rows = spark.createDataFrame([("old.jpg", 100000), ("mid.jpg", 10), ("new.jpg", 1), ("readme.txt", 100000)], "name string, age int")
    rows = rows.withColumn("mtime", F.expr("timestamp'2024-01-02 12:00:00' - make_dt_interval(0, 0, 0, age)"))
    got = {r["name"]: r["removed"] for r in sample.retention(rows, F.expr("timestamp'2024-01-02 12:00:00'"), 1, 1).collect()}
    assert got == {"old.jpg": "age", "mid.jpg": "count", "new.jpg": None, "readme.txt": None}


def test_retention_with_names_that_repeat(spark):
    rows = [("a.jpg", 1), ("a.jpg", 1), ("a.jpg", 50), ("b.jpg", 2), ("c.jpg", 3), ("d.png", None), ("a.jpg", 900000)]
    df = spark.createDataFrame(rows, "name string, age int").withColumn("mtime", F.expr("timestamp'2024-01-02 12:00:00' - make_dt_interval(0, 0, 0, age)"))
    now = F.expr("timestamp'2024-01-02 12:00:00'")
    told = lambda newest: sorted(((r["name"], r["age"] or 0, r["removed"] or "-") for r in sample.retention(df, now, 24, newest).collect()))
    assert told(3) == [("a.jpg", 1, "-"), ("a.jpg", 1, "-"), ("a.jpg", 50, "count"), ("a.jpg", 900000, "age"), ("b.jpg", 2, "-"), ("c.jpg", 3, "count"), ("d.png", 0, "count")]
    assert [x[2] for x in told(1)].count("-") == 2 and len(told(6)) == 7 and told(6)[2][2] == "-"


def test_history_orders_differ(spark):
    rows = [(1, k, "system" if k in (5, 9) else "user", "x") for k in range(14)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sample.recent_turns(df).count() == 10
    assert sample.recent_turns(df, cut_first=False).count() == 12


def test_revision(spark):
    schema = "sha256 string, rows array<string>, class_name string, status string"
    old = spark.createDataFrame([("a", ["2 .5"], "char_kuey_teow", "annotated"), ("b", [], "laksa", "rejected"), ("c", ["r1", "r2"], "roti_canai", "annotated")], schema)
    new = spark.createDataFrame([("a", ["5 .5"], "mee_goreng", None), ("b", ["4 .5"], "laksa", None), ("c", ["r2", "r1"], "roti_canai", None)], schema)
    changes = merge.revision_changes(old, new)
    got = {r["sha256"]: (r["change_types"], r["order_only"]) for r in changes.collect()}
    assert got == {"a": (["class_changed", "boxes_changed"], False), "b": (["restored", "boxes_changed"], False), "c": ([], True)}
    manifest = old.select("sha256", "class_name", F.col("status").alias("annotation_status"), F.size("rows").alias("bbox_count"))
    out = {r["sha256"]: r for r in merge.apply_revision(manifest, changes, "r").collect()}
    assert out["a"]["class_name"] == "mee_goreng" and out["b"]["annotation_status"] == "annotated" and not out["c"]["annotation_revisions"]
    assert len(out["a"]["annotation_revisions"]) == 1


def test_audits(spark):
    dim = schemas.class_dim(spark)
    rows = spark.createDataFrame([("a" * 64, "train", "g", 0, "nasi_lemak"), ("b" * 64, "val", "g", 1, "laksa")], "sha256 string, split string, leakage_group string, class_id int, class_name string")
    checks = {r["check"] for r in audit.split_audit(rows, dim).collect()}
    assert {"group_crosses_splits", "class_name_and_id", "class_not_covered"} <= checks
    assert audit.malformed_sha(rows).count() == 0
    with pytest.raises(ValueError, match="group_crosses_splits"):
        audit.require_clean(audit.crossing(rows, "leakage_group"))
    ids = spark.createDataFrame([("batch_1",), ("../outside",)], "batch_id string")
    assert [r["key"] for r in audit.invalid_batch(ids).collect()] == ["../outside"]
    drift = rows.withColumn("label_sha256", F.sha2(F.lit("old"), 256))
    assert audit.digest_drift(drift, "label_sha256", F.sha2(F.lit("new"), 256), "sha256").count() == 2


def test_lookup(spark):
    kb = spark.createDataFrame([("nasi_lemak", "Nasi Lemak", 640.0)], "class_name string, display_name string, calories_kcal double")
    rows = spark.createDataFrame([(1, 1, "Nasi Lemak"), (1, 2, "nasi-lemak"), (1, 3, "rendang_tok")], "req int, pos int, class_name string")
    got = sorted((r["pos"], r["class_name"], r["display_name"], r["found_in_kb"]) for r in advisory.lookup_many(rows, kb, "req", "pos").collect())
    assert got == [(1, "Nasi Lemak", "Nasi Lemak", True), (3, "rendang_tok", "Rendang Tok", False)]


def test_coverage_table(spark):
    dim = schemas.class_dim(spark)
    rows = [(c, s, 1, 1) for k, c in enumerate(schemas.CLASSES) for s in ["annotated"] * (k + 1) + ["missing"] * 2]
    df = spark.createDataFrame(rows, "class_name string, annotation_status string, bbox_count int, n_sources int")
    text = report.coverage_table(report.coverage(df, dim))
    assert "| nasi_lemak | 3 | 1 | 1 | 2 |" in text and "| Total | 33 | 21 | 21 | 12 |" in text
    assert report.replace_block("a<s>x</s>b", "<s>", "</s>", "y") == "a<s>\ny\n</s>b"


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"sha256": "a", "class_id": 1}\n\n{"sha256": "b", "class_id": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "m.jsonl"), schemas.MANIFEST).count() == 2
    (tmp_path / "b.csv").write_text("﻿filename,width,height,class,xmin,ymin,xmax,ymax\nx.jpg,100,50,laksa,1,2,30,40\ny.jpg,100,50,laksa,1,2,300,40\n")
    boxes = files.read_csv_boxes(spark, [str(tmp_path / "b.csv")])
    assert [r["filename"] for r in files.csv_box_complaints(boxes, F.lit(100), F.lit(50)).collect()] == ["y.jpg"]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/i1.txt").write_text("0 .5 .5 .5 .5\n7 .5 .5 .5 .5\n")
    got = {r["line"]: (r["stem"], r["complaint"]) for r in files.read_label_lines(spark, str(tmp_path / "labels"), [0, 1]).collect()}
    assert got["0 .5 .5 .5 .5"] == ("i1", None) and got["7 .5 .5 .5 .5"][1] == "class_unknown"
    (tmp_path / "v.xml").write_text("<annotation><filename>f.jpg</filename><size><width>10</width><height>20</height></size><object><name>Nasi Lemak</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>other</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    voc = files.read_voc(spark, str(tmp_path / "v.xml"), schemas.class_dim(spark)).collect()
    assert [(r["class_name"], r["class_id"], r["xmax"], r["img_height"]) for r in voc] == [("nasi_lemak", 0, 3.0, 20)]
    (tmp_path / "kb.json").write_text(json.dumps({"dishes": {"Nasi Lemak": {"display_name": "Nasi Lemak", "calories_kcal": 640}}}))
    assert files.read_knowledge_base(spark, str(tmp_path / "kb.json")).first()["class_name"] == "nasi_lemak"
    (tmp_path / "results.csv").write_text(" epoch, metrics/mAP50-95(B)\n1, 0.5\n2, 0.7\n")
    assert [r["mAP50_95"] for r in files.read_run_metrics(spark, str(tmp_path / "results.csv")).collect()] == [0.5, 0.7]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("labels/train/i1.txt", "0 .5 .5 .5 .5\n")
        z.writestr("train.txt", "data/images/train/i1.jpg\n")
        z.writestr("data.yaml", "names: [a]")
    assert [(r["line"], r["listed"]) for r in files.read_label_archives(spark, str(tmp_path)).collect()] == [("0 .5 .5 .5 .5", True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 0, 0.5, 0.5, 0.25, 0.5), ("s", 1, 3, 0.1, 0.2, 0.3, 0.4)], "stem string, ord int, class_id int, cx double, cy double, w double, h double")
    assert sinks.label_files(df).first()["text"].split("\n")[0] == "0 0.50000000 0.50000000 0.25000000 0.50000000"
    sinks.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_new(df, str(tmp_path / "out"))
    sinks.append_jsonl(df, str(tmp_path / "log"))
    sinks.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_streaming_ingest(spark, tmp_path):
    manifest = str(tmp_path / "manifest")
    spark.createDataFrame([("aa", 0, "G1")], "sha256 string, hash long, leakage_group string").write.parquet(manifest)
    schema = "sha256 string, hash long, ord long"
    for k, rows in enumerate([[("bb", 1, 1), ("aa", 0, 2)], [("cc", 3, 3), ("dd", 255 << 50, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest.start_ingest(ingest.replay(spark, str(tmp_path / "in"), schema), manifest, str(tmp_path / "cp"), 2)
    query.awaitTermination(120)
    got = {r["sha256"]: r["leakage_group"] for r in spark.read.parquet(manifest).collect()}
    assert got == {"aa": "G1", "bb": "G1", "cc": "G1", "dd": "dhash-dd"}
