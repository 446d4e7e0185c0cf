"""Members of ZIP archives as a data source.

The driver reads the list of members at the end of each archive; members are
then dealt into partitions of about ``partitionBytes``, so that one archive is
read by many tasks, and each task reads its members only. Where the session
has spark.sql.python.filterPushdown.enabled, filters on the names of archives
and members are pushed down to the list. A member that fails its
checksum fails the read, naming the archive and the member.

    spark.dataSource.register(Archives)
    spark.read.format("archives").option("pathGlobFilter", "*.zip").load(folder)

Archives are opened by pyarrow's file systems (local, HDFS, S3, GCS), which
seek; an archive is never read whole.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "archive string, member string, bytes long, content binary"
PARTITION_BYTES, MOST_MEMBERS = 16 << 20, 10_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Members(InputPartition):
    archive: str
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*.zip")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def _wanted(self, column: str, name: str) -> bool:
        for test in self.tests:
            if test.attribute != (column,):
                continue
            value = test.value
            met = name in value if isinstance(test, In) else name == value if isinstance(test, EqualTo) else name.startswith(value) if isinstance(test, StringStartsWith) else name.endswith(value) if isinstance(test, StringEndsWith) else value in name
            if not met:
                return False
        return True

    def partitions(self) -> list[Members]:
        files, root = _opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for file in sorted(found, key=lambda f: f.path):
            if file.type != fs.FileType.File or not fnmatch.fnmatch(file.base_name, self.pattern) or not self._wanted("archive", file.path):
                continue
            with files.open_input_file(file.path) as raw, zipfile.ZipFile(raw) as z:
                held, size = [], 0
                for member in z.infolist():
                    if member.is_dir() or not self._wanted("member", member.filename):
                        continue
                    if held and (size + member.file_size > self.most or len(held) >= MOST_MEMBERS):
                        out.append(Members(file.path, held))
                        held, size = [], 0
                    held.append(member.filename)
                    size += member.file_size
                if held:
                    out.append(Members(file.path, held))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z:
            for name in partition.names:
                try:
                    content = z.read(name)
                except Exception as error:
                    raise ValueError(f"{partition.archive}: {name} is damaged ({error})") from error
                columns = [pa.array([partition.archive]), pa.array([name]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["archive", "member", "bytes", "content"])


class FilteringReader(ArchiveReader):
    """For sessions that let Python sources take filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what is said about names; the rest is left to Spark."""
        for test in filters:
            if isinstance(test, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and test.attribute in (("archive",), ("member",)):
                self.tests.append(test)
            else:
                yield test


class Archives(DataSource):
    """(archive, member, bytes, content) of the ZIP archives under a path."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("filters") == "true" else ArchiveReader)(options)


def read_members(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(Archives)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("archives").option("partitionBytes", partition_bytes).option("filters", filters).load(path)


def label_lines(members: DataFrame) -> DataFrame:
    """(archive, member, line, names, listed): the lines of label members, the
    class names of the archive's data.yaml, and whether its train.txt lists the
    image; both are one member an archive and are joined to its labels."""
    text = members.withColumn("text", F.decode("content", "UTF-8")).drop("content", "bytes")
    labels = text.filter(F.col("member").contains("labels/") & F.col("member").endswith(".txt"))
    names = text.filter(F.col("member").endswith("data.yaml")).groupBy("archive").agg(F.min_by("text", "member").alias("names"))
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)
    listed = text.filter(F.col("member").endswith("train.txt")).select("archive", F.explode(F.split("text", "\n")).alias("x")).select("archive", stem(F.btrim("x")).alias("stem")).filter("stem <> ''").distinct().withColumn("listed", F.lit(True))
    rows = labels.select("archive", "member", stem(F.col("member")).alias("stem"), F.explode(F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")).alias("line"))
    out = rows.join(names, "archive", "left").join(listed, ["archive", "stem"], "left")
    return out.select("archive", "member", "line", F.coalesce("names", F.lit("")).alias("names"), F.coalesce("listed", F.lit(False)).alias("listed"))
