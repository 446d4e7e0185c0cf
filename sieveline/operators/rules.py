"""Decision lists: validation, routing, review flags, upload gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import aspect_ratio

#: Defaults of validation and routing.
LIMITS = {"min_file_bytes": 2048, "min_width": 256, "min_height": 256, "max_pixels": 40_000_000, "max_aspect": 4.0, "min_blur": 20.0}
ROUTING = {"accept_score": 0.22, "accept_margin": 0.02, "reject_score": 0.16, "wrong_margin": 0.04}


def reasons_of(rules: list[tuple[Column | str, Column]]) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name) if isinstance(name, str) else name) for name, rule in rules]))


def first_of(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(""))
    for name, rule in rules:
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def validate(df: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """file_bytes, width, height, blur_variance, decode_error -> reasons and
    status; blur alone leaves a record pending."""
    blur = F.round("blur_variance", 3)
    reasons = reasons_of(
        [
            ("file_too_small", F.col("file_bytes") < limits["min_file_bytes"]),
            ("width_below_minimum", F.col("width") < limits["min_width"]),
            ("height_below_minimum", F.col("height") < limits["min_height"]),
            ("pixel_count_above_maximum", F.col("width").cast("long") * F.col("height") > limits["max_pixels"]),
            ("extreme_aspect_ratio", aspect_ratio(F.col("width"), F.col("height")) > limits["max_aspect"]),
            ("likely_blurry", blur < limits["min_blur"]),
            (F.concat(F.lit("decode_error:"), "decode_error"), F.col("decode_error").isNotNull()),
        ]
    )
    return df.withColumn("blur_variance", blur).withColumn("reasons", reasons).withColumn("status", F.when(F.exists("reasons", lambda r: r != "likely_blurry"), "rejected").otherwise("pending"))


def route_by_scores(df: DataFrame, thresholds: dict = ROUTING) -> DataFrame:
    """scores array<(name, score)> in class order, candidate_class, reasons ->
    status, reason added, predicted_class, intended_score, score_margin.
    Unrounded values are compared, rounded ones returned; of equal scores the
    first class in order is the top one."""
    top = F.array_max(F.transform("scores", lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("at"), s["name"].alias("name"))))
    others = F.array_max(F.transform(F.filter("scores", lambda s: s["name"] != F.col("candidate_class")), lambda s: s["score"]))
    own = F.get(F.transform(F.filter("scores", lambda s: s["name"] == F.col("candidate_class")), lambda s: s["score"]), F.lit(0))
    df = df.withColumn("__top", top).withColumn("__own", own).withColumn("__margin", F.col("__own") - F.coalesce(others, F.lit(-1.0)))
    good = (F.col("__own") >= thresholds["accept_score"]) & (F.col("__margin") >= thresholds["accept_margin"])
    blurry = F.array_contains("reasons", "likely_blurry")
    missing = F.coalesce(F.size("scores"), F.lit(0)) <= 0
    reason = (
        F.when(missing, "semantic_score_missing")
        .when(F.col("__own").isNull(), "candidate_class_not_configured")
        .when(good & blurry, "manual_quality_review_required")
        .when(good, F.lit(None))
        .when(F.col("__top.score") < thresholds["reject_score"], "semantic_score_too_low")
        .when((F.col("__top.name") != F.col("candidate_class")) & (-F.col("__margin") >= thresholds["wrong_margin"]), F.concat(F.lit("semantic_class_mismatch:"), "__top.name"))
        .otherwise("semantic_score_borderline")
    )
    df = df.withColumn("__reason", reason)
    status = F.when(F.col("__reason").isNull(), "accepted").when(F.startswith("__reason", F.lit("semantic_score_too_low")) | F.startswith("__reason", F.lit("semantic_class_mismatch")), "rejected").otherwise("review")
    scored = ~missing & F.col("__own").isNotNull()
    return (
        df.withColumn("status", status)
        .withColumn("reasons", F.array_compact(F.concat("reasons", F.array("__reason"))))
        .withColumn("predicted_class", F.when(scored, F.col("__top.name")))
        .withColumn("intended_score", F.when(scored, F.round("__own", 6)))
        .withColumn("score_margin", F.when(scored, F.round("__margin", 6)))
        .drop("__top", "__own", "__margin", "__reason")
    )


def route_by_threshold(df: DataFrame, models: DataFrame) -> DataFrame:
    """calibration_score against the class's threshold; one model a class, so
    the models are as few as the classes and join by broadcast when small."""
    joined = df.join(models.select(F.col("class_name").alias("candidate_class"), F.col("threshold").alias("calibration_threshold")), "candidate_class", "left")
    accepted = F.col("calibration_threshold").isNotNull() & ~F.array_contains("reasons", "likely_blurry") & (F.col("calibration_score") >= F.col("calibration_threshold"))
    return joined.withColumn("status", F.when(accepted, "accepted").otherwise("manual_review"))


def route_unscored(df: DataFrame, calibrated: bool) -> DataFrame:
    """Pending records go to review when nothing scores them."""
    pending = F.col("status") == "pending"
    return df.withColumn("reasons", F.when(pending, F.concat("reasons", F.array(F.lit("semantic_filter_skipped")))).otherwise(F.col("reasons"))).withColumn("status", F.when(pending, "manual_review" if calibrated else "review").otherwise(F.col("status")))


def override(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manual decisions by (candidate_class, sha256) set the status, of
    duplicates too."""
    joined = df.join(decisions.select("candidate_class", "sha256", F.col("label").alias("__label")), ["candidate_class", "sha256"], "left")
    decided = F.col("__label").isNotNull()
    reason = F.array(F.concat(F.lit("manual_decision_override:"), "__label"))
    return joined.withColumn("reasons", F.when(decided, F.concat("reasons", reason)).otherwise(F.col("reasons"))).withColumn("status", F.coalesce("__label", "status")).drop("__label")


def review_flags(df: DataFrame, priority_classes: list[str], low: float = 0.4) -> DataFrame:
    """boxes array<(class_name, confidence)>, source_class -> review_reasons, review_priority."""
    named = F.array_distinct(F.transform("boxes", lambda b: b["class_name"]))
    empty = F.size("boxes") == 0
    reasons = reasons_of(
        [
            ("no_prediction", empty),
            ("source_class_mismatch", ~empty & ~F.array_contains(named, F.col("source_class"))),
            ("priority_class", F.col("source_class").isin(priority_classes)),
            ("low_confidence_box", F.exists("boxes", lambda b: F.round(b["confidence"], 6) < low)),
            ("multi_class_prediction", F.size(named) > 1),
        ]
    )
    return df.withColumn("review_reasons", reasons).withColumn("review_priority", F.when(F.size("review_reasons") > 0, "high").otherwise("normal"))


def upload_gate(name: Column, content_type: Column, size: Column, suffixes: list[str], types: list[str], most: int) -> Column:
    """The first complaint about an upload, or null."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return first_of([("missing_filename", name.isNull() | (name == "")), ("unsupported_extension", ~suffix.isin(suffixes)), ("unsupported_type", content_type.isNotNull() & ~content_type.isin(types)), ("too_large", size > most), ("empty", size == 0)])


def box_complaint(fields: Column, known: list[int]) -> Column:
    """What is wrong with a label line that was split into fields, or null."""
    class_id = F.get(fields, F.lit(0)).try_cast("int")
    value = lambda k: F.get(fields, F.lit(k)).try_cast("double")
    numbers = [value(k) for k in range(1, 5)]
    bad = F.lit(False)
    for v in numbers:
        bad = bad | v.isNull() | F.isnan(v) | ~v.between(0, 1)
    return first_of([("fields", F.size(fields) != 5), ("class_not_digits", ~F.get(fields, F.lit(0)).rlike("^[0-9]+$")), ("class_unknown", class_id.isNull() | ~class_id.isin(known)), ("out_of_range", bad), ("empty_box", (numbers[2] <= 0) | (numbers[3] <= 0))])
