"""Readers of manifests, labels, annotations, archives and images.

All return DataFrames with explicit schemas; wrong lines become rows of
violations where the caller asks for them, and fail the read otherwise.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.rules import box_complaint
from sieveline.schemas import CSV_BOX

IMAGES = "*.{jpg,jpeg,png,webp,bmp}"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A manifest; blank lines are skipped and malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(prompts by class, settings) of a JSON document with classes (name ->
    prompts) and the sections validation, deduplication and semantic. A class
    without a prompt fails the read."""
    section = "MAP<STRING, DOUBLE>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"STRUCT<classes: MAP<STRING, STRUCT<prompts: ARRAY<STRING>>>, validation: {section}, deduplication: {section}, semantic: {section}>").alias("c"))
    classes = raw.select(F.explode_outer("c.classes").alias("class_name", "v")).select("class_name", F.col("v.prompts").alias("prompts"))
    if classes.filter(F.col("class_name").isNull() | ~F.coalesce(F.size("prompts") > 0, F.lit(False))).limit(1).count():
        raise ValueError("every class needs a prompt")
    row = raw.select("c.validation", "c.deduplication", "c.semantic").first().asDict()
    return classes, {k: v or {} for k, v in row.items()}


def read_csv_boxes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Boxes of several CSV files; Spark's reader drops a byte-order mark."""
    return spark.read.csv(paths, header=True, schema=CSV_BOX, mode="FAILFAST")


def csv_box_complaints(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes whose stated size is not the image's, or that leave the image."""
    inside = (F.col("xmin") >= 0) & (F.col("xmin") < F.col("xmax")) & (F.col("xmax") <= width) & (F.col("ymin") >= 0) & (F.col("ymin") < F.col("ymax")) & (F.col("ymax") <= height)
    complaint = F.when((F.col("width") != width) | (F.col("height") != height), "size_differs").when(~F.coalesce(inside, F.lit(False)), "box_outside")
    return df.withColumn("complaint", complaint).filter("complaint is not null")


def read_run_metrics(spark: SparkSession, path: str | list[str], run: Column | None = None) -> DataFrame:
    """Epochs of training runs: stripped names, numeric values; an empty file
    fails the read."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not raw.limit(1).count():
        raise ValueError(f"no epochs in {path}")
    plain = lambda c: c.strip().replace("metrics/", "").replace("(B)", "").replace("/", "_").replace("-", "_")
    columns = [F.col(f"`{c}`").cast("double").alias(plain(c)) for c in raw.columns]
    return raw.select(*columns, *([run.alias("run")] if run is not None else []))


def read_label_lines(spark: SparkSession, path: str | list[str], known: list[int]) -> DataFrame:
    """(stem, line, class_id, cx, cy, w, h, complaint) of label files."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("stem"), F.btrim("value").alias("line")).filter("line <> ''")
    fields = F.split("line", r"\s+")
    number = lambda k: F.get(fields, F.lit(k)).try_cast("double")
    return lines.select("stem", "line", F.get(fields, F.lit(0)).try_cast("int").alias("class_id"), *[number(k + 1).alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))], box_complaint(fields, known).alias("complaint"))


def read_voc(spark: SparkSession, path: str, dim: DataFrame) -> DataFrame:
    """A row per annotated object of a known class, names lower-cased with
    underscores."""
    box = "bndbox STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
    schema = T.StructType.fromDDL(f"filename STRING, size STRUCT<width: INT, height: INT>, object ARRAY<STRUCT<name: STRING, {box}>>")
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).select("filename", "size", F.explode("object").alias("o"))
    name = F.regexp_replace(F.lower(F.btrim("o.name")), r"\s+", "_")
    return rows.select("filename", name.alias("class_name"), *[F.col(f"o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("size.width").alias("img_width"), F.col("size.height").alias("img_height")).join(dim, "class_name")


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """The base as rows: one JSON document, a map of classes under dishes."""
    entry = "STRUCT<display_name: STRING, calories_kcal: DOUBLE, protein_g: DOUBLE, carbs_g: DOUBLE, fat_g: DOUBLE, sodium_mg: DOUBLE, allergens: ARRAY<STRING>, dietary_tags: ARRAY<STRING>, health_notes: STRING>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"STRUCT<dishes: MAP<STRING, {entry}>>").alias("a"), F.from_json("value", f"MAP<STRING, {entry}>").alias("b"))
    from sieveline.functions.scalar import normalise_key

    return raw.select(F.explode(F.coalesce("a.dishes", "b")).alias("k", "v")).select(normalise_key(F.col("k")).alias("class_name"), "v.*")


def scan_images(spark: SparkSession, path: str, first_per_class: int | None = None) -> DataFrame:
    """(path, class_name, sha256, file_bytes) of images in class folders."""
    from sieveline.operators.sample import first_per_class as first

    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).load(path)
    rows = files.select("path", F.element_at(F.split("path", "/"), -2).alias("class_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_bytes"))
    return first(rows, first_per_class, "class_name", "path") if first_per_class else rows


def pair_by_stem(images: DataFrame, labels: DataFrame, optional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, stems with more than one image): images and labels by stem."""
    counts = images.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    pairs = counts.filter("n = 1").drop("n").join(labels, "stem", "left" if optional else "inner")
    return pairs, counts.filter("n <> 1").select("stem", "n")


def read_label_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line, names, listed): label lines of ZIP exports with
    the class names of data.yaml and whether train.txt lists the image; a
    member that fails its checksum fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    if bad := z.testzip():
                        raise ValueError(f"{name}: {bad} is damaged")
                    members = z.namelist()
                    listed = {x.strip().rsplit("/", 1)[-1].rsplit(".", 1)[0] for m in members if m.endswith("train.txt") for x in z.read(m).decode().splitlines() if x.strip()}
                    names = next((z.read(m).decode() for m in members if m.endswith("data.yaml")), "")
                    for m in members:
                        if "labels/" in m and m.endswith(".txt"):
                            for line in z.read(m).decode().splitlines() or [""]:
                                rows.append((name, m, line, names, m.rsplit("/", 1)[-1][:-4] in listed))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["archive", "member", "line", "names", "listed"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line string, names string, listed boolean")


def read_selections(spark: SparkSession, pattern: str, own: str, schema: str) -> DataFrame:
    """Distinct groups of all selections but those of the folder ``own``."""
    rows = spark.read.schema(schema).json(pattern).withColumn("__file", F.col("_metadata.file_path"))
    return rows.filter(~F.contains("__file", F.lit(f"/{own}/"))).select("leakage_group").distinct()


def decisions_from_folders(paths: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, violations): label/class/image paths against a manifest
    (candidate_class, image_id, sha256, status): unknown images, images with
    two labels, unknown labels, and records without a decision."""
    parts = F.split("path", "/")
    rows = paths.select(F.element_at(parts, -3).alias("label"), F.element_at(parts, -2).alias("candidate_class"), F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]*$", 1).alias("image_id"))
    keys = ["candidate_class", "image_id"]
    known = rows.join(manifest.select(*keys, "sha256"), keys)
    named = lambda check, df: df.select(F.lit(check).alias("check"), F.concat_ws("/", *keys).alias("key"))
    labels = known.groupBy(*keys).agg(F.count_distinct("label").alias("n"))
    wrong = (
        named("unknown_image", rows.join(manifest, keys, "left_anti"))
        .unionByName(named("conflicting_labels", labels.filter("n > 1")))
        .unionByName(named("unresolved_label", rows.filter(~F.col("label").isin("accepted", "rejected"))))
        .unionByName(named("missing_decision", manifest.filter("status <> 'duplicate'").join(rows, keys, "left_anti")))
    )
    return known.join(labels.filter("n = 1").select(*keys), keys).select("candidate_class", "sha256", "image_id", "label").distinct(), wrong


def scrape_records(after: DataFrame, before: DataFrame, log: DataFrame, fallback: DataFrame, engine: str, cap: int) -> DataFrame:
    """New files of a scrape with query and engine: fallback log, then the
    browser's log, then the class keyword; no more than ``cap`` of a class,
    with those that it had."""
    from pyspark.sql import Window

    new = after.join(before.select("path"), "path", "left_anti")
    had = before.groupBy("class_name").agg(F.count(F.lit(1)).alias("had"))
    f = fallback.select("path", F.col("query").alias("fq"), F.col("engine").alias("fe"))
    rows = new.join(f, "path", "left").join(log.select("path", F.col("query").alias("lq"), F.col("url").alias("source_url")), "path", "left").join(had, "class_name", "left")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("class_name").orderBy("path")) + F.coalesce("had", F.lit(0))).filter(F.col("n") <= cap)
    return rows.select("path", "class_name", F.coalesce("fq", "lq", F.replace(F.col("class_name"), F.lit("_"), F.lit(" "))).alias("query"), F.coalesce("fe", F.lit(engine)).alias("engine"), "source_url")


def union_candidates(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Candidates of several datasets; the place of the dataset in the list
    comes before the order within it."""
    out = None
    for k, (name, df) in enumerate(sources):
        own = df.withColumn("source_ord", F.lit(k)).withColumn("dataset", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out
