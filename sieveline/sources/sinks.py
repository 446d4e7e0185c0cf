"""Writers: manifests, label lines, tables by status, run versions, and outputs
that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sieveline.functions.scalar import box_text
from sieveline.storage import cut


def _sorted(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def append_jsonl(df: DataFrame, path: str) -> None:
    _sorted(df).write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in the order of the alphabet; what was there is replaced."""
    _sorted(df).write.mode("overwrite").json(path)


def write_new(df: DataFrame, path: str) -> None:
    """An output that is never written over."""
    df.write.mode("errorifexists").parquet(path)


def write_run(df: DataFrame, path: str, run: str) -> None:
    """A version of a table beside the earlier ones."""
    df.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(path)


def write_by_status(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("status", "candidate_class").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def label_files(boxes: DataFrame, digits: int = 8) -> DataFrame:
    """(stem, text): the label file of each image, boxes in their order."""
    line = box_text(F.col("class_id"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), digits)
    return boxes.select("stem", "ord", line.alias("line")).groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


def summary_json(df: DataFrame, *columns: Column) -> DataFrame:
    """One row of figures as a JSON document."""
    return df.agg(*columns).select(F.to_json(F.struct("*")).alias("summary"))


class AuditError(ValueError):
    """An output that its audits refuse."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commit(df: DataFrame, path: str, audits: Iterable[Callable[[DataFrame], DataFrame]] = (), figures: dict[str, Column] | None = None, expected: dict[str, int] | None = None, replace: bool = False, partition_by: Iterable[str] = ()) -> dict[str, object]:
    """Write df so that path holds all of it, audited, or what it held before.

    Rows go to a staging folder beside path, in one pass that also takes the
    figures: ``rows``, and those asked for. They have to equal ``expected``
    where that names them. Audits are given what was written and return
    violations; the first ones are told if there are any. Then the folder takes
    its name by a rename. An existing output stays unless ``replace``; it is
    then set aside, and put back if the rename fails. Returns the figures.

    Where renames are not atomic, as in object stores, readers may see the
    output a moment before it is whole."""
    spark = df.sparkSession
    staged, aside = (f"{path.rstrip('/')}.{word}-{uuid.uuid4().hex}" for word in ("staged", "aside"))
    files, final = _files(spark, path)
    if files.exists(final) and not replace:
        raise FileExistsError(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (figures or {}).items()]).write.partitionBy(*partition_by).parquet(staged)
        told = seen.get
        wrong = [f"{k} is {told.get(k)}, not {v}" for k, v in (expected or {}).items() if told.get(k) != v]
        written = spark.read.schema(df.schema).parquet(staged)
        for audit in audits:
            wrong += [str(r.asDict()) for r in audit(written).limit(5).collect()]
        if wrong:
            raise AuditError("; ".join(wrong))
        if files.exists(final):
            if not replace:
                raise FileExistsError(path)
            if not files.rename(final, at(aside)):
                raise OSError(f"{path} cannot be set aside")
        if not files.rename(at(staged), final):
            if files.exists(at(aside)):
                files.rename(at(aside), final)
            raise OSError(f"{staged} cannot be renamed")
        files.delete(at(aside), True)
        return told
    finally:
        files.delete(at(staged), True)


def commit_run(df: DataFrame, path: str, run: str, keep: int | None = None, **checks) -> dict[str, object]:
    """commit() of a version beside the earlier ones; with ``keep``, the oldest
    ones beyond so many go once the new one stands."""
    told = commit(df, f"{path}/run_id={run}", **checks)
    files, home = _files(df.sparkSession, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(home) if s.getPath().getName().startswith("run_id=") and "." not in s.getPath().getName())
    for name in names[: -keep] if keep else []:
        if name != f"run_id={run}":
            files.delete(_files(df.sparkSession, f"{path}/{name}")[1], True)
    return told


#: Hex digits of a digest that name its bucket.
BUCKET_DIGITS = 2


def _bucketed(df: DataFrame, key: str, digits: int) -> DataFrame:
    return df.withColumn("bucket", F.lower(F.substring(F.coalesce(F.col(key).cast("string"), F.lit("")), 1, digits)))


def write_bucketed(df: DataFrame, path: str, key: str = "sha256", digits: int = BUCKET_DIGITS) -> None:
    """A manifest in a folder for each bucket of its digests."""
    _bucketed(df, key, digits).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return _by_folder(spark, path).drop("bucket")


def upsert(spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame], DataFrame], key: str = "sha256", digits: int = BUCKET_DIGITS) -> list[str]:
    """Apply a merge to a bucketed manifest, rewriting only the buckets that
    hold keys of ``changes``; returns them. merge takes the manifest's rows of
    those buckets and returns what they become: it must not look at others, nor
    give rows of other buckets. What it gives is written aside before a folder
    is replaced; a bucket that is left without rows goes."""
    touched = sorted(r["bucket"] for r in _bucketed(changes.select(key), key, digits).select("bucket").distinct().collect())  # 16 ** digits at most
    if not touched:
        return []
    known = F.col("bucket").isin(touched)
    old = _by_folder(spark, path)
    new = cut(_bucketed(merge(old.filter(known).drop("bucket")), key, digits))
    if new.filter(~known).limit(1).count():
        raise ValueError("a merge gave rows of buckets that no change touches")
    full = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for name in touched:
        if name not in full:
            files, at = _files(spark, f"{path}/bucket={name or '__HIVE_DEFAULT_PARTITION__'}")
            files.delete(at, True)
    return touched


def _by_folder(spark: SparkSession, path: str) -> DataFrame:
    """Bucket names are texts, though all of them may be digits."""
    files = spark.read.parquet(path)
    schema = StructType([f for f in files.schema.fields if f.name != "bucket"] + [StructField("bucket", StringType())])
    return spark.read.schema(schema).parquet(path).withColumn("bucket", F.coalesce("bucket", F.lit("")))
