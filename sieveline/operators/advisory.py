"""Dimension lookups with a fallback row, and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import display_name, normalise_key
from sieveline.operators.sample import distinct_in_order

#: Texts of the advisory.
NO_DETECTION = "No Malaysian dishes were detected in your image. Try uploading a clearer, well-lit photo of the food."
LEAD = "Summary based on our verified nutrition database:\n"


def lookup(df: DataFrame, kb: DataFrame, name: str = "class_name") -> DataFrame:
    """df with the knowledge base's columns: a row that is not there gets a
    title-cased name and found_in_kb false. The base has a row a class; Spark
    broadcasts it when its size allows."""
    keyed = df.withColumn("__key", normalise_key(F.col(name)))
    base = kb.select(F.col("class_name").alias("__key"), *[c for c in kb.columns if c != "class_name"], F.lit(True).alias("__found"))
    out = keyed.join(base, "__key", "left")
    return out.withColumn("found_in_kb", F.coalesce("__found", F.lit(False))).withColumn("display_name", F.coalesce("display_name", display_name(F.col("__key")))).drop("__found").withColumnRenamed("__key", "class_key")


def lookup_many(df: DataFrame, kb: DataFrame, request: str, order: str, name: str = "class_name") -> DataFrame:
    """The same for the first mention of each class in a request."""
    keyed = df.withColumn("__k", normalise_key(F.col(name)))
    return lookup(distinct_in_order(keyed, [request, "__k"], order).drop("__k"), kb, name)


def whole(c: Column, unit: str) -> Column:
    """A number without digits, halves to even, with its unit; null stays."""
    return F.concat(F.bround(c, 0).cast("long").cast("string"), F.lit(unit))


def advisory_line() -> Column:
    macros = F.concat_ws(", ", whole(F.col("calories_kcal"), " kcal"), whole(F.col("protein_g"), "g protein"), whole(F.col("carbs_g"), "g carbs"), whole(F.col("fat_g"), "g fat"))
    macros = F.when(macros == "", "macros unavailable").otherwise(macros)
    allergens = F.when(F.size("allergens") > 0, F.concat(F.lit(" Allergens: "), F.array_join("allergens", ", "), F.lit("."))).otherwise("")
    found = F.concat(F.lit("- "), "display_name", F.lit(": "), macros, F.lit("."), allergens, F.when(F.coalesce("health_notes", F.lit("")) != "", F.concat(F.lit("\n  "), "health_notes")).otherwise(""))
    return F.when(F.col("found_in_kb"), found).otherwise(F.concat(F.lit("- "), "display_name", F.lit(": No verified data available.")))


def advisories(requests: DataFrame, entries: DataFrame, request: str, order: str) -> DataFrame:
    """(request, advisory): a line an entry in order; requests without
    entries get the text for no detection."""
    lines = entries.select(request, F.col(order).alias("o"), advisory_line().alias("line")).groupBy(request).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("lines"))
    return requests.select(request).distinct().join(lines, request, "left").select(request, F.when(F.size("lines") > 0, F.concat(F.lit(LEAD), F.lit("\n"), F.array_join("lines", "\n"))).otherwise(NO_DETECTION).alias("advisory"))


def prompt_payload(detections: DataFrame, request: str, order: str) -> DataFrame:
    """(request, payload): detections as JSON, confidences at three digits."""
    item = F.struct(F.col(order).alias("o"), F.struct("class_name", F.round("confidence", 3).alias("confidence")).alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["d"])
    return detections.groupBy(request).agg(F.to_json(F.struct(listed.alias("detections"))).alias("payload"))


def chat_prompt(kb_text: Column, scan_text: Column, question: Column) -> Column:
    """Blocks with a blank line between them; a missing scan has its text."""
    return F.concat_ws("\n\n", kb_text, F.coalesce(scan_text, F.lit("No photo has been scanned in this session.")), question)
