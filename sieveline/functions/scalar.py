"""Scalar functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_key(c: Column) -> Column:
    """Strip, lower-case, and one underscore for a run of spaces or hyphens."""
    stripped = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.regexp_replace(F.lower(stripped), r"(?U)[\s\-]+", "_")


def display_name(c: Column) -> Column:
    """Title-cased words of a key of ASCII letters and underscores."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def hex_to_long(c: Column) -> Column:
    """A 64-bit pattern in hex as a signed long."""
    return F.conv(c, 16, -10).cast("long")


def long_to_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def gradient_hash(values: Column) -> Column:
    """A bit for each of up to 63 neighbours (the right one is larger), the
    first one highest: the difference hash of an array."""
    rises = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda x, y: (y > x).cast("long"))
    return F.aggregate(rises, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def box_to_centre(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size as shares of the image."""
    return [((xmin + xmax) / 2 / width).alias("cx"), ((ymin + ymax) / 2 / height).alias("cy"), ((xmax - xmin) / width).alias("w"), ((ymax - ymin) / height).alias("h")]


def centre_to_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2")]


def box_text(class_id: Column, cx: Column, cy: Column, w: Column, h: Column, digits: int = 8) -> Column:
    """A label line: class and four numbers with fixed digits."""
    return F.format_string(f"%d %.{digits}f %.{digits}f %.{digits}f %.{digits}f", class_id, cx, cy, w, h)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(hi - lo, zero)
    inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    area = lambda r: side(r["x1"], r["x2"]) * side(r["y1"], r["y2"])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.greatest(w / F.greatest(h, F.lit(1)), h / F.greatest(w, F.lit(1)))


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.5, "medium").otherwise("low")


def percent(c: Column) -> Column:
    """Half up, as browsers round."""
    return F.floor(c * 100 + 0.5).cast("long")


def group_id(sha: Column) -> Column:
    return F.concat(F.lit("dhash-"), F.substring(sha, 1, 16))


def relative_path(path: Column, root: str) -> Column:
    lead = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(lead)), F.substring(path, len(lead) + 1, 1 << 20)).otherwise(path)


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = vector_norm(a) * vector_norm(b)
    return F.when(n > 0, dot(a, b) / n)
