import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline.sources import archives, files


def written(folder, name, members):
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for member, text in members.items():
            z.writestr(member, text)


def sample(folder):
    labels = {f"labels/train/i{k}.txt": f"{k % 3} 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.{k + 1}" for k in range(12)}
    written(folder, "a.zip", labels | {"data.yaml": "names: [x, y]", "train.txt": "images/train/i1.jpg\nimages/train/i2.jpg\n", "labels/train/none.txt": ""})
    written(folder, "b.zip", {"labels/one.txt": "0 0.1 0.1 0.1 0.1\n", "readme.md": "hi"})


def test_members_of_an_archive_are_read_in_several_tasks(spark, tmp_path):
    sample(tmp_path)
    rows = archives.read_members(spark, str(tmp_path), partition_bytes=100)
    got = {(r["archive"].rsplit("/", 1)[-1], r["member"]): bytes(r["content"]) for r in rows.collect()}
    assert len(got) == 17 and got["b.zip", "readme.md"] == b"hi" and got["a.zip", "labels/train/none.txt"] == b""
    assert rows.filter(F.col("archive").endswith("a.zip")).select(F.spark_partition_id()).distinct().count() > 5
    assert archives.read_members(spark, str(tmp_path / "b.zip")).count() == 2


def test_lines_equal_the_whole_archive_reader(spark, tmp_path):
    sample(tmp_path)
    key = lambda df: sorted((r["archive"].rsplit("/", 1)[-1], r["member"], r["line"], r["names"], r["listed"]) for r in df.collect())
    got = key(archives.label_lines(archives.read_members(spark, str(tmp_path), 100)))
    assert got == key(files.read_label_archives(spark, str(tmp_path))) and sum(r[4] for r in got) == 4


def test_filters_reach_the_list_of_members(spark, tmp_path):
    sample(tmp_path)
    reader = archives.FilteringReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([archives.StringEndsWith(("member",), ".md"), archives.EqualTo(("bytes",), 2)]))
    assert left == [archives.EqualTo(("bytes",), 2)] and [p.names for p in reader.partitions()] == [["readme.md"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = archives.read_members(spark, str(tmp_path), 1).filter(F.col("member").startswith("labels/one"))
        assert [r["member"] for r in rows.collect()] == ["labels/one.txt"] and rows.rdd.getNumPartitions() == 1
        assert archives.read_members(spark, str(tmp_path)).filter("member = 'nothing'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_damaged_member_is_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("good.txt", "fine")
        z.writestr("labels/broken.txt", "unique words here")
    raw = (tmp_path / "bad.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(raw.replace(b"unique words here", b"unique w0rds here"))
    with pytest.raises(Exception, match=r"bad\.zip: labels/broken\.txt is damaged"):
        archives.read_members(spark, str(tmp_path)).collect()
