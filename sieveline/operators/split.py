"""Leakage-safe splits: no group of near copies crosses a split.

Groups become vectors by one aggregation. For every primary class its groups
stand in a line, larger ones first, then by a seeded hash; the line is cut at
integer targets, and a group falls where it begins. Places in the line come
from counts per (class, size, hash bucket), whose number is bounded, and a
rank within each bucket: no class is gathered in one task, and no row or
group passes through the driver.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
BUCKET_DIGITS = 3  # hex digits of the hash: 4,096 buckets


def integer_targets(total: int, ratios: list[str | Fraction]) -> list[int]:
    """Largest remainder in exact fractions; the first of equal remainders."""
    shares = [Fraction(r) * total for r in ratios]
    out = [int(s) for s in shares]
    order = sorted(range(len(ratios)), key=lambda k: (out[k] - shares[k], k))
    for k in order[: total - sum(out)]:
        out[k] += 1
    return out


def apportion(df: DataFrame, total: str, keys: list[str], ratios: list[str]) -> DataFrame:
    """keys, split, target: the same in SQL, one row a key and split, by
    decimals that hold 18 fractional digits."""
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(SPLITS[k]).alias("split"), F.lit(r).cast("decimal(19,18)").alias("r")) for k, r in enumerate(ratios)])
    rows = df.select(*keys, F.col(total).cast("decimal(19,0)").alias("n"), F.explode(parts).alias("x")).select(*keys, "n", "x.*")
    rows = rows.withColumn("exact", F.col("n") * F.col("r")).withColumn("low", F.floor("exact"))
    by_rest = Window.partitionBy(*keys).orderBy(F.desc(F.col("exact") - F.col("low")), "k")
    rows = rows.withColumn("place", F.row_number().over(by_rest)).withColumn("left", F.col("n") - F.sum("low").over(Window.partitionBy(*keys)))
    return rows.select(*keys, "split", (F.col("low") + (F.col("place") <= F.col("left")).cast("int")).cast("long").alias("target"))


def check_ratios(ratios: list[str]) -> None:
    values = [Fraction(r) for r in ratios]
    if any(v <= 0 for v in values) or abs(sum(values) - 1) > Fraction(1, 10**9):
        raise ValueError("ratios are positive and sum to 1")


def half_up(total: int, fraction: str) -> int:
    return int(Fraction(fraction) * total + Fraction(1, 2))


def group_vectors(df: DataFrame, classes: int, group: str = "leakage_group", class_id: str = "class_id", objects: str = "object_class_counts") -> DataFrame:
    """group, images, boxes, primary array<long>, objects array<long>:
    counts by class of each group."""
    primary = [F.count_if(F.col(class_id) == k) for k in range(classes)]
    held = [F.sum(F.coalesce(F.try_element_at(F.col(objects), F.lit(str(k))), F.lit(0)).cast("long")) for k in range(classes)]
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("images"), F.array(*primary).alias("primary"), F.array(*held).alias("objects"))
    return out.withColumn("boxes", F.aggregate("objects", F.lit(0).cast("long"), lambda a, x: a + x))


def rarity(groups: DataFrame, group: str = "leakage_group") -> DataFrame:
    """groups with rarity: sum of n_c / T_c + 2 o_c / O_c, over images. Totals
    are one row, which is broadcast."""
    size = groups.agg(F.max(F.size("primary"))).first()[0] or 0
    totals = groups.agg(*[F.sum(F.get("primary", F.lit(k))).alias(f"p{k}") for k in range(size)], *[F.sum(F.get("objects", F.lit(k))).alias(f"o{k}") for k in range(size)])
    out = groups.crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for k in range(size):
        for name, letter, weight in (("primary", "p", 1), ("objects", "o", 2)):
            score = score + F.when(F.col(f"{letter}{k}") > 0, weight * F.get(name, F.lit(k)) / F.col(f"{letter}{k}")).otherwise(0.0)
    return out.withColumn("rarity", score / F.col("images")).select(*groups.columns, "rarity")


def order_key(group: Column, seed: int) -> Column:
    """Hex digest whose order is the seeded order of groups."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), group), 256)


def class_cuts(totals: dict[int, int], targets: list[int]) -> dict[int, list[int]]:
    """Integer targets of each class that add up to the targets of all;
    totals are as few as the classes. Split after split, the classes with the
    largest remainders round up."""
    out: dict[int, list[int]] = {c: [] for c in totals}
    rest, left = dict(totals), list(targets)
    for k in range(len(targets) - 1):
        whole = sum(rest.values())
        shares = {c: Fraction(n * left[k], sum(left[k:])) if whole else Fraction(0) for c, n in rest.items()}
        got = {c: int(s) for c, s in shares.items()}
        short = left[k] - sum(got.values())
        for c in sorted(rest, key=lambda c: (got[c] - shares[c], c)):
            if short > 0 and got[c] < rest[c]:
                got[c] += 1
                short -= 1
        for c in rest:
            out[c].append(got[c])
            rest[c] -= got[c]
    for c in rest:
        out[c].append(rest[c])
    return out


def assign(groups: DataFrame, targets: list[int], seed: int, group: str = "leakage_group", locked: DataFrame | None = None) -> DataFrame:
    """(group, split): targets are images per split in the order of SPLITS.
    Groups of ``locked`` (group, split) keep their split and count."""
    rows = groups.select(F.col(group).alias("g"), "images", F.array_position("primary", F.array_max("primary")).cast("int").alias("c"), order_key(F.col(group), seed).alias("h"))
    fixed = None
    if locked is not None:
        fixed = rows.join(locked.select(F.col(group).alias("g"), "split"), "g")
        spent = {r["split"]: r["n"] for r in fixed.groupBy("split").agg(F.sum("images").alias("n")).collect()}
        targets = [max(0, t - spent.get(s, 0)) for s, t in zip(SPLITS, targets)]
        rows = rows.join(locked.select(F.col(group).alias("g")), "g", "left_anti")
    totals = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.sum("images").alias("n")).collect()}
    spare = sum(totals.values()) - sum(targets)
    targets = [targets[0] + spare, *targets[1:]] if spare else targets
    cuts = class_cuts(totals, targets)
    rows = rows.withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    counts = rows.groupBy("c", "images", "b").agg(F.sum("images").alias("n"))
    line = Window.partitionBy("c").orderBy(F.desc("images"), "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("c", "images", "b", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("start"))
    within = Window.partitionBy("c", "images", "b").orderBy("h", "g")
    placed = rows.join(starts, ["c", "images", "b"]).withColumn("at", F.col("start") + F.col("images") * (F.row_number().over(within) - 1))
    split = F.lit(SPLITS[-1])
    for c, own in cuts.items():
        split = F.when((F.col("c") == c) & (F.col("at") < own[0]), SPLITS[0]).when((F.col("c") == c) & (F.col("at") < own[0] + own[1]), SPLITS[1]).otherwise(split)
    out = placed.select(F.col("g").alias(group), split.alias("split"))
    return out if fixed is None else out.unionByName(fixed.select(F.col("g").alias(group), "split"))


def split_counts(df: DataFrame, group: str = "leakage_group", objects: str = "object_class_counts") -> DataFrame:
    """split, images, groups, boxes, objects map<string,long>."""
    base = df.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count_distinct(group).alias("groups"), F.sum("bbox_count").alias("boxes"))
    held = df.select("split", F.explode(objects).alias("k", "v")).groupBy("split", "k").agg(F.sum("v").alias("v"))
    maps = held.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("objects"))
    return base.join(maps, "split", "left")


def crossing_groups(df: DataFrame, group: str = "leakage_group") -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")
