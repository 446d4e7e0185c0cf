import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sieveline.llm.common import held_out  # noqa: E402


def test_stages_keep_clean_documents(spark, tmp_path):
    """Planted copies, benchmark passages, shared passages and toxic texts go."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.limit(60).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = max((r for r in rows if r["lang"] == "en"), key=lambda r: 1000 < len(r["text"]) < 4000)
    new = [{**base, "doc_id": 5000, "text": base["text"]}, {**base, "doc_id": 5001, "text": "Some words here. " + item + " And some more there."}]
    frame = spark.createDataFrame(rows + new, docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, frame, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        ids = {r["doc_id"] for r in out.collect()}
        if name == "benchmark_decontamination":
            assert 5001 not in ids and 5000 in ids
        elif name == "simhash_near_dedup":
            assert 5000 not in ids and base["doc_id"] in ids
        else:
            assert base["doc_id"] in ids


def test_near_duplicates_keep_null_and_repeated_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {c: " ".join(f"{c}{k * k}" for k in range(60)) for c in "abcdef"}
    rows = [(None, "a"), (None, "a"), (None, "b"), (7, "c"), (7, "d"), (3, "d"), (7, "e"), (None, "f"), (9, "f"), (9, "f"), (None, None), (None, None)]
    frame = spark.createDataFrame([(i, text.get(c), "en", "web", 1) for i, c in rows], docs.schema)
    out = corpus_pipeline.drop_near_duplicates(spark, frame, "/root/testdata/sf0.001")
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    assert got == sorted([(None, text["a"]), (None, text["b"]), (7, text["c"]), (3, text["d"]), (7, text["e"]), (9, text["f"]), (None, None)], key=key)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() <= 200 and out.select("doc_id").distinct().count() == out.count()


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_held_out(spark):
    from zlib import crc32

    rows = spark.range(200).withColumn("h", held_out("id", 3)).collect()
    assert all(r["h"] == (crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
