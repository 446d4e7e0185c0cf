"""Integrity audits: each check is a query over violations(check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: About as many rows of a table go to a task where tables are dealt by key.
PART = 1 << 18


def violations(check: str, df: DataFrame, key: Column | str, detail: Column | None = None) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def parts_of(tables: list[DataFrame]) -> int:
    """Into how many parts to deal these tables, by the largest of them."""
    rows = union([df.select(F.lit(k).alias("k")) for k, df in enumerate(tables)]).groupBy("k").count()
    return max(1, -(-(rows.agg(F.max("count")).first()[0] or 0) // PART))


def repeated(df: DataFrame, key: str) -> DataFrame:
    found = df.groupBy(key).count().filter("count > 1")
    return violations(f"repeated_{key}", found, key, F.col("count"))


def outside(df: DataFrame, column: str, allowed: list[str], key: str) -> DataFrame:
    return violations(f"invalid_{column}", df.filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False))), key, F.col(column))


def crossing(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    found = df.groupBy(group).agg(F.count_distinct(split).alias("n")).filter("n > 1")
    return violations("group_crosses_splits", found, group, F.col("n"))


def set_difference(name: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, both ways."""
    return violations(f"{name}_missing", left.select(key).join(right.select(key), key, "left_anti").distinct(), key).unionByName(violations(f"{name}_extra", right.select(key).join(left.select(key), key, "left_anti").distinct(), key))


def malformed_sha(df: DataFrame, column: str = "sha256") -> DataFrame:
    return violations("malformed_sha256", df.filter(~F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False))), column)


def class_mismatch(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    joined = df.join(dim.select("class_id", F.col("class_name").alias("__name")), "class_id", "left")
    return violations("class_name_and_id", joined.filter(~F.col("class_name").eqNullSafe(F.col("__name"))), key, F.col("class_name"))


def digest_drift(df: DataFrame, stored: str, actual: Column, key: str, name: str = "label_digest") -> DataFrame:
    return violations(f"{name}_mismatch", df.filter(~F.col(stored).eqNullSafe(actual)), key, F.col(stored))


def missing_coverage(df: DataFrame, dim: DataFrame, splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Classes without a row in one of these splits."""
    wanted = dim.select("class_name", F.explode(F.array(*map(F.lit, splits))).alias("split"))
    return violations("class_not_covered", wanted.join(df.select("class_name", "split").distinct(), ["class_name", "split"], "left_anti"), F.concat_ws("/", "split", "class_name"))


def unsafe_path(df: DataFrame, column: str) -> DataFrame:
    return violations("unsafe_path", df.filter(F.col(column).rlike(r"^/|(^|/)\.\.(/|$)")), column)


def invalid_batch(df: DataFrame, column: str = "batch_id") -> DataFrame:
    return violations("invalid_batch_id", df.filter(~F.coalesce(F.col(column).rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$"), F.lit(False))), column)


def split_audit(df: DataFrame, dim: DataFrame, locked: DataFrame | None = None, key: str = "sha256", group: str = "leakage_group") -> DataFrame:
    """All checks of a split table; with ``locked`` (test rows that were
    accepted) also that test and locked rows are the same."""
    parts = [repeated(df, key), outside(df, "split", ["train", "val", "test"], key), crossing(df, group), class_mismatch(df, dim, key), missing_coverage(df, dim)]
    if locked is not None:
        parts.append(set_difference("locked_test", locked, df.filter("split = 'test'"), key))
    return union(parts)


def complaints(check: str, df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """A violation for each rule that a row meets."""
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return violations(check, df.select(key, F.explode(named).alias("__c")), key, F.col("__c"))


def holdout_audit(test: DataFrame, queue: DataFrame, manifest: DataFrame, key: str = "sha256", splits: DataFrame | None = None) -> DataFrame:
    """Drift between a test split, its review queue and the manifest.

    test: leakage_group, label_sha256, class_name, destination_image,
    bbox_count; queue: review_status and the first, third and fourth of these;
    manifest: all of them as they are now, annotation_status, destination_label
    and the digest of the image file as image_sha256. With ``splits``
    (leakage_group, split) the test's groups must not be in another split.

    Rows are counted first and dealt by key into parts of about PART of them,
    so that no task sorts or counts more as the tables grow. Which keys are on
    one side only, or repeated, follows from one count of the keys."""
    tables = {"test": test, "queue": queue, "manifest": manifest}
    parts_ = parts_of([*tables.values()] + ([splits] if splits is not None else []))
    dealt = lambda df, by=key: df.repartition(parts_, by) if parts_ > 1 else df
    now = manifest.select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"m_{c}") for c in ("annotation_status", "leakage_group", "label_sha256", "bbox_count", "destination_label", "image_sha256")])
    asked = queue.select(key, F.lit(True).alias("__queued"), *[F.col(c).alias(f"q_{c}") for c in ("leakage_group", "class_name", "destination_image")])
    rows = dealt(test).join(dealt(now), key, "left").join(dealt(asked), key, "left")
    known, queued = F.col("__known").isNotNull(), F.col("__queued").isNotNull()
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules = [
        ("missing_from_manifest", ~known),
        ("not_annotated", known & ~F.col("m_annotation_status").eqNullSafe("annotated")),
        ("group_drifted", known & differs("leakage_group", "m_leakage_group")),
        ("queue_group_differs", queued & differs("leakage_group", "q_leakage_group")),
        ("queue_class_differs", queued & differs("class_name", "q_class_name")),
        ("queue_destination_differs", queued & differs("destination_image", "q_destination_image")),
        ("image_drifted", known & differs(key, "m_image_sha256")),
        ("label_missing", known & F.col("m_destination_label").isNull()),
        ("label_drifted", known & differs("label_sha256", "m_label_sha256")),
        ("box_count_drifted", known & differs("bbox_count", "m_bbox_count")),
    ]
    met = dealt(union([df.select(key, F.lit(name).alias("__in")) for name, df in tables.items()])).groupBy(key).agg(*[F.count_if(F.col("__in") == name).alias(f"__{name}") for name in tables])
    only = lambda a, b: (F.col(f"__{a}") > 0) & ((F.col(f"__{b}") == 0) | F.col(key).isNull())  # noqa: E731  a null equals none
    found = [("queue_missing", only("test", "queue"), F.lit(None)), ("queue_extra", only("queue", "test"), F.lit(None)), *[(f"repeated_{key}_{name}", F.col(f"__{name}") > 1, F.col(f"__{name}")) for name in tables]]
    told = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail"))) for name, rule, detail in found]))
    counted = met.select(F.col(key).cast("string").alias("key"), F.explode(told).alias("x")).select("x.check", "key", "x.detail")
    parts = [complaints("holdout", rows, key, rules), counted, violations("queue_not_pending", queue.filter(~F.col("review_status").eqNullSafe("pending")), key, F.col("review_status"))]
    if splits is not None:
        own = dealt(test.select("leakage_group"), "leakage_group").distinct()
        beyond = dealt(splits.filter("split <> 'test'"), "leakage_group").join(own, "leakage_group", "left_semi")
        parts.append(violations("test_group_elsewhere", beyond.groupBy("leakage_group").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("d")), "leakage_group", F.col("d")))
    return union(parts)


def pilot_audit(selection: DataFrame, manifest: DataFrame, key: str = "sha256") -> DataFrame:
    """Selected images that the manifest lacks, that have a label by now, or
    that have moved."""
    now = manifest.select(key, F.col("annotation_status").alias("m_status"), F.col("destination_image").alias("m_image"), F.lit(True).alias("__known"))
    rows, known = selection.join(now, key, "left"), F.col("__known").isNotNull()
    return complaints("pilot", rows, key, [("missing_from_manifest", ~known), ("not_open", known & ~F.col("m_status").eqNullSafe("missing")), ("destination_moved", known & ~F.col("destination_image").eqNullSafe(F.col("m_image")))])


def locked_plan(groups: DataFrame, base: DataFrame, accepted: DataFrame, group: str = "leakage_group") -> DataFrame:
    """group, split, assignment_source of groups that an incremental split
    must not move: those of the accepted holdout stay in test, the others keep
    train or val of the base (group, split)."""
    held = accepted.select(group).distinct().withColumn("__held", F.lit(True))
    rows = groups.select(group).distinct().join(held, group, "left").join(base.select(group, F.col("split").alias("__base")).distinct(), group, "left")
    keeps = F.col("__base").isin("train", "val")
    split = F.when(F.col("__held"), "test").when(keeps, F.col("__base"))
    source = F.when(F.col("__held"), "locked_reviewed_holdout").when(keeps, "preserved_base_split")
    return rows.select(group, split.alias("split"), source.alias("assignment_source")).filter("split is not null")


def locked_plan_audit(records: DataFrame, base: DataFrame, accepted: DataFrame, key: str = "sha256", group: str = "leakage_group") -> DataFrame:
    """Why such a plan cannot be made: groups of the base's test that the
    holdout does not cover, groups that cross splits of the base, images that
    an accepted group has gained without review, accepted ones that are gone."""
    held = accepted.select(group).distinct()
    uncovered = base.filter("split = 'test'").select(group).distinct().join(records.select(group), group, "left_semi").join(held, group, "left_anti")
    gained = records.join(held, group, "left_semi").join(accepted.select(key), key, "left_anti")
    return union([violations("base_test_not_accepted", uncovered, group), crossing(base, group), violations("unreviewed_member", gained, key, F.col(group)), violations("accepted_missing", accepted.join(records.select(key), key, "left_anti"), key)])


def incremental_audit(split: DataFrame, provenance: DataFrame, key: str = "sha256", group: str = "leakage_group") -> DataFrame:
    """Checks of an incremental split with assignment_source; provenance:
    (split, locked_groups) as they were counted when it was made."""
    source, place = F.col("assignment_source"), F.col("split")
    held = source.eqNullSafe("locked_reviewed_holdout")
    rules = [
        ("invalid_source", ~F.coalesce(source.isin("locked_reviewed_holdout", "preserved_base_split", "new_incremental_group"), F.lit(False))),
        ("holdout_escaped", held & (place != "test")),
        ("entered_test", ~held & (place == "test")),
        ("preserved_elsewhere", source.eqNullSafe("preserved_base_split") & ~place.isin("train", "val")),
    ]
    counted = split.filter(~source.eqNullSafe("new_incremental_group")).groupBy("split").agg(F.count_distinct(group).alias("n"))
    both = counted.join(provenance.select("split", F.col("locked_groups").cast("long").alias("m")), "split", "full_outer")
    drift = both.filter(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0)))
    return complaints("incremental", split, key, rules).unionByName(violations("locked_groups_drifted", drift, "split", F.col("n")))


def count_drift(counts: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Figures that differ from those of a summary with the same columns, or
    that one side lacks."""
    figures = [c for c in counts.columns if c not in keys]
    wide = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("string").alias(name)) for c in figures])).alias("x")).select(*keys, "x.*")
    both = wide(counts, "now").join(wide(summary, "told"), [*keys, "figure"], "full_outer").filter(~F.col("now").eqNullSafe(F.col("told")))
    return violations("summary_drifted", both, F.concat_ws("/", *keys, "figure"), F.concat_ws(" is not ", "now", "told"))


def require_clean(found: DataFrame) -> None:
    """Raise on the first violation."""
    row = found.limit(1).collect()
    if row:
        raise ValueError(f"{row[0]['check']}: {row[0]['key']} {row[0]['detail'] or ''}".strip())
