"""Hamming similarity: join, leaders, leakage groups, incremental groups.

Hashes are signed 64-bit patterns. Distinct hashes are compared, and their
rows come back by an equi-join, so that many copies cost no pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import hamming
from sieveline.operators.graph import min_labels
from sieveline.storage import cut


def bands(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, mask) of n bands that cover the bits."""
    edges = [bits * k // n for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


#: The largest distance for which bands have to agree; keys a hash at most; hashes of a block that are compared at once.
BANDED, KEYS, BLOCK = 8, 1000, 4096
#: Nanoseconds, as measured, of a comparison in a block, of a row that is tried, of a candidate that the join returns; rows a hash tries at most.
COMPARE, PROBE, CANDIDATE, PROBES = 2, 200, 30, 100_000


def _agree(n: int, distance: int, bits: int) -> int:
    """Bands that have to agree so that a hash meets fewer candidates under
    its keys than it has keys."""
    agree = 1
    while n >= 2 ** (bits * agree // (distance + agree)) and comb(distance + agree + 1, agree + 1) <= KEYS:
        agree += 1
    return agree


def _choices(width: int, most: int) -> int:
    """Ways to change up to ``most`` of so many bits."""
    return sum(comb(width, k) for k in range(most + 1))


def probe_plan(n: int, m: int, distance: int, bits: int = 64) -> list[tuple[int, int, int]] | None:
    """(shift, mask, changes) of the bands of a multi-index search of n hashes
    for m, or None where comparing all of them in blocks costs less.

    If bands allow r1, r2, ... changes with (r1 + 1) + (r2 + 1) + ... beyond
    the distance, hashes within it are within r of each other in some band.
    Fewer bands make longer keys, hence fewer candidates, and more changes
    that a hash has to try."""
    best, found = n * m * COMPARE, None
    for k in range(2, distance + 1):
        cuts, left = bands(k, bits), distance + 1
        radii = [left // k + (x < left % k) - 1 for x in range(k)]
        # the longest bands take the most changes
        order = sorted(range(k), key=lambda x: -cuts[x][1].bit_length())
        plan = [(*cuts[x], r) for x, r in zip(order, radii)]
        tries = [_choices(mask.bit_length(), r) for _, mask, r in plan]
        if sum(tries) > PROBES:
            continue
        cost = min(n, m) * sum(tries) * PROBE + n * m * sum(t / (mask + 1) for t, (_, mask, _) in zip(tries, plan)) * CANDIDATE
        if cost < best:
            best, found = cost, plan
    return found


def _near(distance: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["own"].to_numpy(bool)
        a, b = (np.sort(frame["hash"].to_numpy(np.int64)[k]) for k in (own, ~own))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for at in range(0, len(a), 256):
            differ = np.bitwise_count(a[at : at + 256, None].view(np.uint64) ^ b[None, :].view(np.uint64))
            i, j = np.nonzero(differ <= distance)
            found.append((a[at + i], b[j], differ[i, j].astype(np.int32)))
        return pd.DataFrame({k: np.concatenate([f[n] for f in found]) for n, k in enumerate(("a", "b", "distance"))})

    return run


def _by_blocks(left: DataFrame, right: DataFrame, distance: int, hash_column: str) -> DataFrame:
    a, b = (cut(df.filter(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias("hash")).distinct()) for df in (left, right))
    m, n = (max(1, -(-df.count() // BLOCK)) for df in (a, b))
    place = lambda k: F.pmod(F.xxhash64("hash"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = a.select("hash", F.lit(True).alias("own"), place(m).alias("i"), every(n).alias("j")).unionByName(b.select("hash", F.lit(False).alias("own"), every(m).alias("i"), place(n).alias("j")))
    return dealt.groupBy("i", "j").applyInPandas(_near(distance), "a long, b long, distance int")


def _whole(shift: int, mask: int) -> int:
    """The mask at its place, as a signed 64-bit number."""
    value = (mask << shift) & ((1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def _by_probes(left: DataFrame, right: DataFrame, distance: int, hash_column: str, plan: list[tuple[int, int, int]], swapped: bool) -> DataFrame:
    """Multi-index search: each hash of one side stands under its value of
    every band, each hash of the other tries all changes that the band
    allows. A pair is taken in the first band that is near enough."""
    spark = left.sparkSession
    flips = [(k, _whole(shift, sum(1 << x for x in way))) for k, (shift, mask, r) in enumerate(plan) for n in range(r + 1) for way in combinations(range(mask.bit_length()), n)]
    changes = F.broadcast(spark.createDataFrame(pd.DataFrame(flips, columns=["band", "flip"]), "band int, flip long"))  # a fixed number

    def keyed(df: DataFrame, name: str) -> DataFrame:
        values = F.array(*[F.struct(F.lit(k).alias("band"), F.col(name).bitwiseAND(F.lit(_whole(shift, mask))).alias("value")) for k, (shift, mask, _) in enumerate(plan)])
        distinct = df.filter(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias(name)).distinct()
        return distinct.select(name, F.explode(values).alias("x")).select(name, "x.band", "x.value")

    tried = lambda rows, name: rows.join(changes, "band").select(name, "band", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    a, b = keyed(left, "a"), keyed(right, "b")
    met = (tried(a, "a") if swapped else a).join((b if swapped else tried(b, "b")).hint("merge"), ["band", "value"])
    met = met.withColumn("distance", hamming(F.col("a"), F.col("b"))).filter(F.col("distance") <= distance)
    differ, first = F.col("a").bitwiseXOR(F.col("b")), F.lit(True)
    for k, (shift, mask, r) in enumerate(plan):
        first = first & ((F.col("band") <= k) | (F.bit_count(differ.bitwiseAND(F.lit(_whole(shift, mask)))) > r))
    return met.filter(first).select("a", "b", F.col("distance").cast("int").alias("distance"))


def hamming_pairs(left: DataFrame, right: DataFrame, distance: int, hash_column: str = "hash", bits: int = 64, agree: int | None = None) -> DataFrame:
    """(a, b, distance) of distinct hashes of both sides within ``distance``,
    equal ones included; the theta form would compare all pairs.

    Of distance + agree bands, hashes within ``distance`` agree in ``agree``
    or more, so an equi-join on each choice of so many bands finds them. More
    bands to agree make longer keys, hence fewer candidates, and more keys a
    hash: as many are taken as the number of hashes asks for. A pair is taken
    in the choice of its first bands that agree, so no distinct is needed.
    Keys are many times the distinct hashes, by whose size Spark would choose a
    broadcast that the driver builds, so both joins ask for a sort-merge join.

    Beyond a distance of ``BANDED``, bands that have to agree are so short that
    nearly all pairs meet in one, often in several. Longer bands are then
    tried with changed bits (``probe_plan``). Where that costs more, as with
    few hashes or at large distances, hashes are compared block by block, and a
    pair of blocks is a task that returns what is near."""
    if agree is None:
        n, m = (df.select(F.approx_count_distinct(hash_column)).first()[0] for df in (left, right))
        if distance > BANDED:
            plan = probe_plan(n, m, distance, bits)
            return _by_probes(left, right, distance, hash_column, plan, n < m) if plan else _by_blocks(left, right, distance, hash_column)
        agree = _agree(max(n, m), distance, bits)
    cuts = bands(distance + agree, bits)
    ways = [*combinations(range(len(cuts)), agree)]

    masks = [sum(cuts[x][1] << cuts[x][0] for x in way) for way in ways]
    # bands below a way's last one that are not in it, as bits
    skipped = F.array(*[F.lit(sum(1 << x for x in range(way[-1]) if x not in way)) for way in ways])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.filter(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias(name)).distinct()
        by_way = distinct.select(name, F.posexplode(F.array(*[F.lit(_whole(0, m)) for m in masks])).alias("way", "mask"))
        return by_way.select(name, "way", F.col(name).bitwiseAND(F.col("mask")).alias("value"))

    met = keyed(left, "a").join(keyed(right, "b").hint("merge"), ["way", "value"]).withColumn("distance", hamming(F.col("a"), F.col("b"))).filter(F.col("distance") <= distance)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agreed = sum((F.when(differ.bitwiseAND(F.lit(_whole(*cut_))) == 0, 1 << x).otherwise(0) for x, cut_ in enumerate(cuts)), F.lit(0))
    first = agreed.bitwiseAND(F.element_at(skipped, F.col("way") + 1)) == 0
    return met.filter(first).select("a", "b", F.col("distance").cast("int").alias("distance"))


def leaders(df: DataFrame, distance: int, id_column: str = "id", order: str = "ord", sha: str = "sha256", hash_column: str = "hash", eligible: str | None = None) -> DataFrame:
    """Greedy dedup in the order of ``order`` (without ties): id, status
    (kept, exact, near or skipped), duplicate_of, distance.

    A later copy of a sha is an exact duplicate of the first row with it. Of
    the other eligible rows a row is kept unless an earlier kept one is within
    ``distance``; it is then a duplicate of the nearest such one, of the
    smallest id among the nearest. The kept rows are the lexicographically first
    maximal independent set of the similarity graph: round by round, rows all
    of whose earlier neighbours are dropped are kept, and rows with a kept
    earlier neighbour are dropped. A negative distance turns this off."""
    by_sha = Window.partitionBy(sha).orderBy(order)
    rows = df.select(F.col(id_column).alias("id"), F.col(order).alias("ord"), F.col(hash_column).alias("hash"), F.first(F.col(id_column)).over(by_sha).alias("first"), F.row_number().over(by_sha).alias("nth"), (F.expr(eligible) if eligible else F.lit(True)).alias("fit"))
    rows = cut(rows)
    exact = rows.filter("nth > 1").select("id", F.lit("exact").alias("status"), F.col("first").alias("duplicate_of"), F.lit(None).cast("int").alias("distance"))
    unfit = rows.filter("nth = 1 and not (fit and hash is not null)").select("id", F.lit("skipped").alias("status"), F.lit(None).cast(df.schema[id_column].dataType).alias("duplicate_of"), F.lit(None).cast("int").alias("distance"))
    nodes = rows.filter("nth = 1 and fit and hash is not null").select("id", "ord", "hash")
    none = F.lit(None).cast(df.schema[id_column].dataType)
    if distance < 0:
        return exact.unionByName(unfit).unionByName(nodes.select("id", F.lit("kept").alias("status"), none.alias("duplicate_of"), F.lit(None).cast("int").alias("distance")))
    # rows of one hash: only the earliest can be kept, the others follow it
    heads = nodes.withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("ord")))
    first = cut(heads.filter("k = 1").drop("k"))
    pairs = hamming_pairs(first, first, distance).filter("a <> b")
    x, y = first.select(F.col("hash").alias("a"), F.col("ord").alias("oa")), first.select(F.col("hash").alias("b"), F.col("ord").alias("ob"))
    edges = cut(pairs.join(x, "a").join(y, "b").filter("oa < ob").select("a", "b"))
    state = cut(first.select("hash", F.lit("open").alias("state")).join(edges.select(F.col("b").alias("hash")).distinct().withColumn("later", F.lit(True)), "hash", "left").select("hash", F.when(F.col("later").isNull(), "kept").otherwise("open").alias("state")))
    while state.filter("state = 'open'").limit(1).count():
        by = edges.join(state.select(F.col("hash").alias("a"), F.col("state").alias("sa")), "a").groupBy("b").agg(F.max((F.col("sa") == "kept").cast("int")).alias("hit"), F.max((F.col("sa") == "open").cast("int")).alias("wait"))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("hit") == 1, "dropped").when(F.col("wait") == 0, "kept").otherwise("open")
        state = cut(state.join(by.withColumnRenamed("b", "hash"), "hash", "left").select("hash", new.alias("state")))
    kept = cut(first.join(state.filter("state = 'kept'"), "hash").select("hash", "id", "ord"))
    led = kept.select(F.col("hash").alias("b"), F.col("id").alias("leader"), F.col("ord").alias("leader_ord"))
    near = nodes.withColumnRenamed("hash", "a").join(hamming_pairs(nodes, kept, distance), "a").join(led, "b").filter("leader_ord < ord").groupBy("id").agg(F.min(F.struct("distance", "leader")).alias("best"))
    out = nodes.join(kept.select("id", F.lit(True).alias("own")), "id", "left").join(near, "id", "left")
    is_kept = F.col("own").isNotNull()
    out = out.select("id", F.when(is_kept, "kept").otherwise("near").alias("status"), F.when(~is_kept, F.col("best.leader")).alias("duplicate_of"), F.when(~is_kept, F.col("best.distance")).alias("distance"))
    return exact.unionByName(unfit).unionByName(out)


def match_baseline(df: DataFrame, baseline: DataFrame, distance: int, id_column: str = "id", sha: str = "sha256", hash_column: str = "hash") -> DataFrame:
    """(id, duplicate_of, distance): an exact match by sha, else the nearest
    row of the baseline, of equal ones the smallest id; null without one.
    Every row of the baseline is a leader."""
    base = baseline.select(F.col(id_column).alias("__id"), F.col(sha).alias("__sha"), F.col(hash_column).alias("hash"))
    exact = base.groupBy("__sha").agg(F.min("__id").alias("__exact"))
    by_hash = base.filter("hash is not null").groupBy(F.col("hash").alias("b")).agg(F.min("__id").alias("who"))
    near = hamming_pairs(df.select(F.col(hash_column).alias("hash")), base, distance).join(by_hash, "b").groupBy("a").agg(F.min(F.struct("distance", "who")).alias("best"))
    out = df.select(F.col(id_column).alias("id"), F.col(sha).alias("__sha"), F.col(hash_column).alias("a")).join(exact, "__sha", "left").join(near, "a", "left")
    return out.select("id", F.coalesce("__exact", "best.who").alias("duplicate_of"), F.when(F.col("__exact").isNotNull(), 0).otherwise(F.col("best.distance")).alias("distance"))


def leakage_groups(df: DataFrame, distance: int, sha: str = "sha256", hash_column: str = "hash") -> DataFrame:
    """(sha256, leakage_group, group_size): connected components of hashes
    within ``distance``; the id bears the smallest sha of the group."""
    rows = df.select(F.col(sha).alias("sha256"), F.col(hash_column).alias("hash"))
    nodes = rows.groupBy("hash").agg(F.min("sha256").alias("least"), F.count(F.lit(1)).alias("n"))
    edges = hamming_pairs(nodes, nodes, distance).filter("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = min_labels(edges)
    nodes = nodes.join(labels.withColumnRenamed("node", "hash"), "hash", "left").withColumn("label", F.coalesce("label", "hash"))
    groups = nodes.groupBy("label").agg(F.min("least").alias("least"), F.sum("n").alias("group_size"))
    return rows.join(nodes.select("hash", "label"), "hash").join(groups, "label").select("sha256", F.concat(F.lit("dhash-"), F.substring("least", 1, 16)).alias("leakage_group"), "group_size")


def attach(new: DataFrame, existing: DataFrame, distance: int, order: str = "ord", sha: str = "sha256", hash_column: str = "hash", group: str = "leakage_group", blocked: DataFrame | None = None) -> DataFrame:
    """(sha256, leakage_group) of the rows of ``new`` that are not exact
    copies. In order, a row joins the group of the smallest sha among the
    existing and the earlier new rows within ``distance``, else it founds a
    group of its own; groups never merge. Shas of ``blocked`` count as copies
    only. Each new row points at one other row, so groups are found by
    pointer jumping on a forest."""
    seen = existing.select(sha) if blocked is None else existing.select(sha).unionByName(blocked.select(sha))
    rows = new.join(seen.distinct(), sha, "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(sha).orderBy(order))).filter("__n = 1")
    rows = cut(rows.select(F.col(sha).alias("sha256"), F.col(hash_column).alias("hash"), F.col(order).alias("ord")))
    old = existing.select(F.col(sha).alias("sha256"), F.col(hash_column).alias("hash"), F.lit(None).cast(new.schema[order].dataType).alias("ord"))
    all_ = cut(rows.unionByName(old))
    pairs = hamming_pairs(rows, all_, distance)
    # of copies of a hash only those count whose sha is below those of all earlier ones
    earlier = Window.partitionBy("hash").orderBy(F.col("ord").asc_nulls_first(), "sha256").rowsBetween(Window.unboundedPreceding, -1)
    least = all_.filter("hash is not null").withColumn("__least", F.min("sha256").over(earlier)).filter("__least is null or sha256 < __least")
    right = least.select(F.col("hash").alias("b"), F.col("sha256").alias("other"), F.col("ord").alias("other_ord"))
    left = rows.select(F.col("hash").alias("a"), "sha256", "ord")
    points = left.join(pairs, "a").join(right, "b").filter("other_ord is null or other_ord < ord").groupBy("sha256").agg(F.min("other").alias("parent"))
    tree = rows.select("sha256").join(points, "sha256", "left").withColumn("parent", F.coalesce("parent", "sha256"))
    return follow(tree, existing.select(F.col(sha).alias("parent"), F.col(group).alias("known")))


def follow(tree: DataFrame, known: DataFrame) -> DataFrame:
    """(sha256, leakage_group) by pointer jumping. tree: (sha256, parent), a
    row that points at itself or at a row that is not in the tree is a root;
    known: (parent, known) groups of roots, others found their own."""
    tree = cut(tree)
    while True:
        step = tree.select(F.col("sha256").alias("parent"), F.col("parent").alias("grand"))
        new_tree = cut(tree.join(step, "parent", "left").select("sha256", F.coalesce("grand", "parent").alias("parent")))
        moved = new_tree.alias("n").join(tree.alias("t"), "sha256").filter("n.parent <> t.parent").limit(1).count()
        tree = new_tree
        if not moved:
            break
    return tree.join(known, "parent", "left").select("sha256", F.coalesce("known", F.concat(F.lit("dhash-"), F.substring("parent", 1, 16))).alias("leakage_group"))
