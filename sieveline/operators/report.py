"""Coverage, counts, best epochs, leakage figures, tables for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(manifest: DataFrame, dim: DataFrame, floor: bool = False) -> DataFrame:
    """Per class, without rejected records: images, annotated, boxes, missing,
    source_occurrences, exact_duplicates_collapsed; classes without a record
    are there too. ``floor`` keeps the last figure from falling below 0."""
    live = manifest.filter("annotation_status <> 'rejected'")
    done = F.col("annotation_status") == "annotated"
    sums = live.groupBy("class_name").agg(F.count(F.lit(1)).alias("images"), F.count_if(done).alias("annotated"), F.sum(F.when(done, F.col("bbox_count")).otherwise(0)).alias("boxes"), F.count_if(F.col("annotation_status") == "missing").alias("missing"), F.sum("n_sources").alias("source_occurrences"))
    out = dim.join(sums, "class_name", "left").fillna(0, ["images", "annotated", "boxes", "missing", "source_occurrences"])
    lost = F.col("source_occurrences") - F.col("images")
    return out.withColumn("exact_duplicates_collapsed", F.greatest(lost, F.lit(0)) if floor else lost)


def coverage_table(rows: DataFrame, total: str = "Total") -> str:
    """Markdown of coverage(): as many lines as classes, which is bounded."""
    names = ["images", "annotated", "boxes", "missing"]
    got = rows.orderBy("class_id").select("class_name", *names).collect()
    lines = [f"| {r['class_name']} | " + " | ".join(str(r[n]) for n in names) + " |" for r in got]
    lines.append(f"| {total} | " + " | ".join(str(sum(r[n] for r in got)) for n in names) + " |")
    return "\n".join(["| class | " + " | ".join(names) + " |", "| --- |" + " --: |" * len(names), *lines])


def replace_block(text: str, start: str, end: str, block: str) -> str:
    """The document with what stands between two markers replaced."""
    a, b = text.index(start) + len(start), text.index(end)
    return f"{text[:a]}\n{block}\n{text[b:]}"


def status_counts(df: DataFrame) -> DataFrame:
    """Counts by status, and by class and status."""
    return df.groupingSets([["status"], ["candidate_class", "status"]], "status", "candidate_class").agg(F.count(F.lit(1)).alias("n")).select("candidate_class", "status", "n")


def best_epochs(runs: DataFrame, run: str = "run", epoch: str = "epoch", metrics: tuple[str, ...] = ("map", "map50")) -> DataFrame:
    """run, best_<metric> (the first epoch with the maximum) and last epoch."""
    return runs.groupBy(run).agg(*[F.max_by(epoch, F.struct(F.col(m), -F.col(epoch))).alias(f"best_{m}") for m in metrics], F.max(epoch).alias("last_epoch"))


def leakage_stats(df: DataFrame, group: str = "leakage_group") -> DataFrame:
    """groups, multi_groups, multi_images in one row, by counts of sizes."""
    sizes = df.groupBy(group).count().groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("count") > 1
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("multi_groups"), F.coalesce(F.sum(F.when(many, F.col("n") * F.col("count"))), F.lit(0)).alias("multi_images"))


def transitions(df: DataFrame, before: str = "old_class", after: str = "classes") -> DataFrame:
    """(from, to, n) for records with one class after; more classes are
    counted under *, none under the empty name."""
    kinds = F.array_distinct(after)
    to = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(F.size(kinds) == 0, "").otherwise("*")
    return df.groupBy(F.col(before).alias("from_class"), to.alias("to_class")).agg(F.count(F.lit(1)).alias("n"))


def selection_summary(df: DataFrame) -> DataFrame:
    """One row: images, distinct groups, high priority, with a prediction."""
    return df.agg(F.count(F.lit(1)).alias("images"), F.count_distinct("leakage_group").alias("groups"), F.count_if(F.col("review_priority") == "high").alias("high_priority"), F.count_if(F.size("boxes") > 0).alias("with_prediction"))


def next_index(df: DataFrame, stem: str = "stem") -> DataFrame:
    """One more than the largest numeric stem."""
    return df.agg((F.coalesce(F.max(F.when(F.col(stem).rlike("^[0-9]+$"), F.col(stem).try_cast("long"))), F.lit(0)) + 1).alias("next_index"))
