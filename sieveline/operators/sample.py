"""Quotas, retention, top rows, histories, hash splits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.storage import cut

#: Hex digits by which a selection counts, and rows that are few enough to look at.
DIGITS, FEW = 3, 4096

def quota_sample(df: DataFrame, quotas: dict[str, int], seed: int, class_column: str = "class_name", group: str = "leakage_group", id_column: str = "sha256", excluded: DataFrame | None = None) -> DataFrame:
    """At most the quota of each class, at most one row a group, groups
    shared among classes in the order of ``quotas``. Rows stand in the order
    of a seeded hash. A quota of 0 skips the class; rows without a group share
    none with another class.

    All classes propose at once: each the first groups of its line that it has
    not proposed before, as many as it is short of. A group stays with the
    earliest class that proposed it, and classes that lost some propose again.
    What stands in the end is what one class after another would take; df is
    read once, and rounds are few whatever the number of classes."""
    names = [name for name, quota in quotas.items() if quota]
    if not names:
        return df.limit(0)
    spark = df.sparkSession
    if excluded is not None:
        df = df.join(excluded.select(group).distinct(), group, "left_anti")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column)), 256)
    id_type = df.schema[id_column].dataType.simpleString()
    rows = df.filter(F.col(class_column).isin(names)).select(F.col(class_column).alias("c"), F.col(group).alias("g"), F.struct(key.alias("k"), F.col(id_column).alias("id")).alias("at"), F.struct(*df.columns).alias("r"))
    heads = cut(rows.groupBy("c", "g").agg(F.min_by("r", "at").alias("r"), F.min("at").alias("at")))
    held, last, taken = dict.fromkeys(names, 0), dict.fromkeys(names), None
    open_ = set(names)
    while open_ := {name for name in open_ if held[name] < quotas[name]}:
        state = spark.createDataFrame([(n, names.index(n), quotas[n] - held[n], *(last[n] or (None, None))) for n in open_], f"c string, place int, short int, k string, id {id_type}")
        ahead = F.col("k").isNull() | (F.col("at.k") > F.col("k")) | (F.col("at.k") == F.col("k")) & (F.col("at.id") > F.col("id"))
        line = heads.join(F.broadcast(state), "c").filter(ahead).withColumn("b", F.substring("at.k", 1, 2))
        # the first of each part of a line, then of those the first of the line
        for parts in (["c", "b"], ["c"]):
            line = line.withColumn("n", F.row_number().over(Window.partitionBy(*parts).orderBy("at"))).filter("n <= short")
        proposed = cut(line.select("c", "place", "g", "at", "r"))
        ends = {r["c"]: (r["at"]["k"], r["at"]["id"]) for r in proposed.groupBy("c").agg(F.max("at").alias("at")).collect()}  # a row a class
        open_ = set(names) if ends else set()
        last |= ends
        if not ends:
            break
        both = proposed if taken is None else taken.unionByName(proposed)
        first = Window.partitionBy("g", F.when(F.col("g").isNull(), F.col("c"))).orderBy("place")
        taken = cut(both.withColumn("n", F.row_number().over(first)).filter("n = 1 or g is null").drop("n"))
        held |= dict.fromkeys(names, 0) | {r["c"]: r["count"] for r in taken.groupBy("c").count().collect()}
    return taken.select("r.*") if taken is not None else df.limit(0)


def parse_quotas(values: list[str] | None, classes: list[str], default: dict[str, int]) -> dict[str, int]:
    """Quotas from name=number texts, in the order of the classes; classes
    that are not named get none, and without any text the default holds."""
    if not values:
        return dict(default)
    out = dict.fromkeys(classes, 0)
    for value in values:
        name, sign, number = value.partition("=")
        if not sign or not number.strip().lstrip("+-").isdigit():
            raise ValueError(f"{value!r} is not name=number")
        if name not in out:
            raise ValueError(f"{name!r} is no class")
        if int(number) < 0:
            raise ValueError(f"{value!r} is negative")
        out[name] = int(number)
    if not any(out.values()):
        raise ValueError("every quota is 0")
    return out


def take_until(df: DataFrame, needed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first rows of each key, as many as ``needed`` (keys, needed) asks for."""
    ranked = df.join(needed.select(*keys, "needed"), keys).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__n") <= F.col("needed")).select(*df.columns)


def shortfall(sample: DataFrame, quotas: DataFrame, class_column: str = "class_name") -> DataFrame:
    """class, quota, got of classes that missed their quota."""
    got = sample.groupBy(class_column).count()
    return quotas.join(got, class_column, "left").select(class_column, "quota", F.coalesce("count", F.lit(0)).alias("got")).filter("got < quota")


def retention(df: DataFrame, now: Column, hours: float, newest: int, time: str = "mtime", name: str = "name", suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """df with removed: age for images older than so many hours, count for
    all but the newest so many of the rest, null for what stays; 0 turns a
    rule off, and other files are left alone. Rows of one time and name stay
    or go together, so that more than the newest so many stay if the last of
    them are alike. Those that stay are found by a limit on counts, not by
    ranking all rows in one task."""
    image = F.lower(F.col(name)).rlike(r"\.(" + "|".join(suffixes) + ")$")
    old = F.lit(False) if not hours else F.col(time) + F.make_dt_interval(hours=F.lit(int(hours)), secs=F.lit(float(hours % 1 * 3600))) < now
    df = df.withColumn("__image", image).withColumn("__old", old)
    if newest:
        alike = df.filter(F.col("__image") & ~F.coalesce("__old", F.lit(False))).groupBy(F.col(time).alias("__t"), F.col(name).alias("__s")).count()
        # each has a row at least, so the first so many are enough
        first = alike.orderBy(F.desc("__t"), "__s").limit(newest)
        before = F.coalesce(F.sum("count").over(Window.orderBy(F.desc("__t"), "__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = first.withColumn("__before", before).filter(F.col("__before") < newest).select("__t", "__s", F.lit(True).alias("__new"))
        df = df.join(kept, df[time].eqNullSafe(kept["__t"]) & df[name].eqNullSafe(kept["__s"]), "left").drop("__t", "__s")
    else:
        df = df.withColumn("__new", F.lit(True))
    removed = F.when(~F.col("__image"), None).when(F.col("__old"), "age").when(F.col("__new").isNull(), "count")
    return df.withColumn("removed", removed).drop("__image", "__old", "__new")


def first_per_class(df: DataFrame, n: int, class_column: str, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(class_column).orderBy(order))).filter(F.col("__n") <= n).drop("__n")


def recent_turns(df: DataFrame, last: int = 12, roles: tuple[str, ...] = ("user", "assistant"), cut_first: bool = True) -> DataFrame:
    """The last turns of each conversation with a role of these and some
    text; turns are counted before the filter (server) or after it (client)."""
    fit = F.col("role").isin(*roles) & (F.btrim(F.coalesce("text", F.lit(""))) != "")
    recent = lambda d: d.withColumn("__n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("__n") <= last).drop("__n")
    return recent(df).filter(fit) if cut_first else recent(df.filter(fit))


def hash_split(df: DataFrame, key: Column, ratios: dict[str, float]) -> DataFrame:
    """df with split by a hash in [0, 1): no order of rows is needed."""
    at = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, edge = F.lit(list(ratios)[-1]), 1.0
    for name, share in reversed([*ratios.items()][:-1]):
        edge = sum(v for k, v in ratios.items() if list(ratios).index(k) <= list(ratios).index(name))
        out = F.when(at < edge, name).otherwise(out)
    return df.withColumn("split", out)


def exact_split(df: DataFrame, key: Column, ratios: dict[str, float]) -> DataFrame:
    """df with split: floor(n * ratio) rows for each name but the last, which
    gets the rest, along the order of a hash of the key and then of the key.

    Where a cut falls is found by selection: rows are counted by the first
    digits of the hash, and only the part that holds the cut is counted by the
    next digits, until so few rows are left that the cut is one of them. Rows
    are never sorted. Keys are unique; rows of one key stay together."""
    n = df.count()
    rows = df.withColumn("__key", F.coalesce(key.cast("string"), F.lit(""))).withColumn("__h", F.sha2("__key", 256))
    places, at = [], 0
    for share in [*ratios.values()][:-1]:
        at += int(Fraction(str(share)) * n)
        places.append(at)
    slim, split = cut(rows.select("__h", "__key")), F.lit([*ratios][-1])
    for name, place in reversed([*zip(ratios, places)]):
        least = _nth(slim, place)
        if least:
            before = (F.col("__h") < least[0]) | (F.col("__h") == least[0]) & (F.col("__key") < least[1])
            split = F.when(before, name).otherwise(split)
        elif place >= n:
            split = F.lit(name)
    return rows.withColumn("split", split).drop("__key", "__h")


def _nth(rows: DataFrame, place: int) -> tuple[str, str] | None:
    """(hash, key) of the row with so many rows before it."""
    begin, digits = "", 0
    while True:
        counts = rows.filter(F.col("__h").startswith(begin)).groupBy(F.substring("__h", digits + 1, DIGITS).alias("d")).count().orderBy("d").collect()  # 16 ** DIGITS at most
        for r in counts:
            if place < r["count"]:
                begin += r["d"]
                break
            place -= r["count"]
        else:
            return None
        digits += DIGITS
        if r["count"] <= FEW or digits >= 64:
            got = rows.filter(F.col("__h").startswith(begin)).orderBy("__h", "__key").limit(place + 1).collect()
            return got[place]["__h"], got[place]["__key"]


def distinct_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")
