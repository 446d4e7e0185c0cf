"""First merges and revisions of annotations, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def primary_class(classes: Column, original: Column, override: Column) -> Column:
    """The only class of the boxes, else the original one if it is among
    them, else an override that is; null where none of these holds."""
    kinds = F.array_distinct(classes)
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(F.array_contains(kinds, original), original).when(F.array_contains(kinds, override), override)


def first_merge(manifest: DataFrame, labels: DataFrame, overrides: DataFrame, sha: str = "sha256") -> DataFrame:
    """Reviewed labels (sha256, rows array<string>, classes array<int>) into
    the manifest: no rows reject the record; else the primary class holds,
    and a change keeps the original class. needs_override marks records whose
    class cannot be told."""
    joined = manifest.join(labels, sha, "left").join(overrides.select(sha, F.col("class_id").alias("__wish")), sha, "left")
    reviewed = F.col("rows").isNotNull()
    empty = F.size("rows") == 0
    new = primary_class(F.col("classes"), F.col("class_id"), F.col("__wish"))
    changed = reviewed & ~empty & (new != F.col("class_id"))
    return (
        joined.withColumn("needs_override", reviewed & ~empty & new.isNull())
        .withColumn("original_class_id", F.when(changed, F.col("class_id")))
        .withColumn("annotation_status", F.when(reviewed & empty, "rejected").when(reviewed, "annotated").otherwise(F.col("annotation_status")))
        .withColumn("rejection_reason", F.when(reviewed & empty, "no_boxes_after_review"))
        .withColumn("bbox_count", F.when(reviewed, F.size("rows")).otherwise(F.col("bbox_count")))
        .withColumn("class_id", F.when(changed, new).otherwise(F.col("class_id")))
        .drop("__wish", "rows", "classes")
    )


def revision_changes(old: DataFrame, new: DataFrame, sha: str = "sha256") -> DataFrame:
    """(sha, change_types, order_only, old and new class, box counts, status)
    for records in the revision: rows array<string> and class_name on both
    sides. Rows count as multisets; another order alone is no change."""
    a = old.select(sha, F.col("rows").alias("r0"), F.col("class_name").alias("old_class"), F.col("status").alias("old_status"))
    b = new.select(sha, F.col("rows").alias("r1"), F.col("class_name").alias("new_class"))
    none = F.array().cast("array<string>")
    both = a.join(b, sha, "full_outer").withColumn("r0", F.coalesce("r0", none)).withColumn("r1", F.coalesce("r1", none))
    n0, n1 = F.size("r0"), F.size("r1")
    kinds = F.array_compact(
        F.array(
            F.when((F.col("old_status") == "rejected") & (n1 > 0), "restored").when((F.coalesce("old_status", F.lit("")) != "rejected") & (n0 > 0) & (n1 == 0), "rejected"),
            F.when((n0 > 0) & (n1 > 0) & (F.col("old_class") != F.col("new_class")), "class_changed"),
            F.when(F.array_sort("r0") != F.array_sort("r1"), "boxes_changed"),
        )
    )
    return both.select(sha, kinds.alias("change_types"), ((F.array_sort("r0") == F.array_sort("r1")) & (F.col("r0") != F.col("r1"))).alias("order_only"), "old_class", "new_class", n0.alias("old_boxes"), n1.alias("new_boxes"), F.when(n1 == 0, "rejected").otherwise("annotated").alias("status"))


def apply_revision(manifest: DataFrame, changes: DataFrame, revision: str, sha: str = "sha256") -> DataFrame:
    """The manifest with changed records updated and a struct appended to
    annotation_revisions; a plan, written by the caller or not at all."""
    entry = F.struct(F.lit(revision).alias("revision"), "change_types", "old_class", "new_class", "old_boxes", "new_boxes")
    real = changes.filter(F.size("change_types") > 0).select(sha, entry.alias("__e"), F.col("new_class").alias("__class"), F.col("new_boxes").alias("__n"), F.col("status").alias("__status"))
    joined = manifest.join(real, sha, "left")
    hit = F.col("__e").isNotNull()
    history = F.col("annotation_revisions") if "annotation_revisions" in manifest.columns else F.array().cast("array<struct<revision:string,change_types:array<string>,old_class:string,new_class:string,old_boxes:int,new_boxes:int>>")
    out = joined.withColumn("annotation_revisions", F.when(hit, F.concat(F.coalesce(history, F.array().cast("array<struct<revision:string,change_types:array<string>,old_class:string,new_class:string,old_boxes:int,new_boxes:int>>")), F.array("__e"))).otherwise(history))
    for name, new in (("class_name", "__class"), ("bbox_count", "__n"), ("annotation_status", "__status")):
        out = out.withColumn(name, F.when(hit, F.coalesce(new, name)).otherwise(F.col(name)))
    return out.drop("__e", "__class", "__n", "__status")


def append_new(manifest: DataFrame, records: DataFrame, order: str, sha: str = "sha256") -> DataFrame:
    """Records that are not in the manifest yet, appended to it; of those that
    come more than once, the first in ``order``."""
    first = records.groupBy(sha).agg(F.min_by(F.struct(*records.columns), order).alias("r")).select("r.*")
    return manifest.unionByName(first.join(manifest.select(sha), sha, "left_anti"), allowMissingColumns=True)
