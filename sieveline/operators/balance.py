"""Balance of a split: objects and boxes beside images and classes.

The objective adds, over splits, squared relative errors: 8 for images, 0.5
for boxes, 2 for each primary class and 3 for the objects of each class,
against shares of the totals (integer targets for images).

``deal`` places groups. Strata are (class, images); how many groups of a
stratum go to each split is settled from large to small, with what is still
missing from the class's integer targets, so that small groups make good what
large ones leave. Within a stratum groups stand in order of their objects and
are dealt out evenly, so that any run of alike groups is shared by the ratios.

``refine`` then exchanges groups of equal images and primary classes, which
changes boxes and objects only, until no exchange improves. Alike groups are a
cell with a count for each split, so the work grows with the kinds of groups
and not with their number; up to ``BLOCK`` groups are a cell each. In each round the pairs of cells of a bucket are
held against each other, blocks of cells at a time, and return their best
exchanges; the driver, which knows the totals of the splits, accepts the best
ones that still improve after those before. With few cells one exchange is
accepted a round, which is the best-improvement loop itself; of equal ones
that of the smallest groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.split import BUCKET_DIGITS, SPLITS, class_cuts, order_key
from sieveline.storage import cut

IMAGE, BOX, PRIMARY, OBJECT = 8.0, 0.5, 2.0, 3.0
LEAST = -1e-12
#: Cells of a block; cells (and groups of a cell) for which one more exchange is accepted in a round; exchanges that reach the driver.
BLOCK, SHARE, PROPOSED = 1024, 64, 512
#: Kinds of groups that are told apart in the order of a stratum: boxes up to so many.
BOXES = 15


def objective(groups: DataFrame, splits: DataFrame, ratios: list[float], targets: list[int], group: str = "leakage_group") -> DataFrame:
    """(split, images, boxes, image_error, box_error, primary_error,
    object_error, objective): weighted squared relative errors of each split.
    groups: as group_vectors() returns them; splits: (group, split)."""
    width = groups.agg(F.max(F.size("objects"))).first()[0] or 0
    at = lambda c, k: F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)).cast("double")
    sums = [F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"), F.array(*[at("primary", k) for k in range(width)]).alias("p"), F.array(*[at("objects", k) for k in range(width)]).alias("o")]
    named = groups.sparkSession.createDataFrame([(s, float(r), t) for s, r, t in zip(SPLITS, ratios, targets)], "split string, ratio double, target long")
    held = groups.join(splits.select(group, "split"), group).groupBy("split").agg(*sums)
    whole = groups.agg(*sums).select(F.col("boxes").alias("all_boxes"), F.col("p").alias("all_p"), F.col("o").alias("all_o"))
    none = F.array(*[F.lit(0.0)] * width) if width else F.array().cast("array<double>")
    rows = F.broadcast(named).join(held, "split", "left").crossJoin(F.broadcast(whole)).withColumns({"images": F.coalesce("images", F.lit(0)), "boxes": F.coalesce("boxes", F.lit(0)), "p": F.coalesce("p", none), "o": F.coalesce("o", none)})
    error = lambda value, target: F.pow((value - target) / F.greatest(target, F.lit(1.0)), F.lit(2))
    sum_of = lambda own, all_: F.aggregate(F.zip_with(own, all_, lambda a, b: error(a, b * F.col("ratio"))), F.lit(0.0), lambda x, y: x + y)
    out = rows.select("split", "images", "boxes", (IMAGE * error(F.col("images"), F.col("target").cast("double"))).alias("image_error"), (BOX * error(F.col("boxes"), F.col("all_boxes") * F.col("ratio"))).alias("box_error"), (PRIMARY * sum_of(F.col("p"), F.col("all_p"))).alias("primary_error"), (OBJECT * sum_of(F.col("o"), F.col("all_o"))).alias("object_error"))
    return out.withColumn("objective", F.col("image_error") + F.col("box_error") + F.col("primary_error") + F.col("object_error"))


def strata_cuts(strata: dict[tuple[int, int], int], targets: dict[int, list[int]]) -> dict[tuple[int, int], list[int]]:
    """Groups of each (class, images) for each split, from large to small;
    targets: images of each class and split."""
    missing = {c: [float(t) for t in own] for c, own in targets.items()}
    out = {}
    for (c, size), n in sorted(strata.items(), key=lambda x: (x[0][0], -x[0][1])):
        left = n
        own = [0] * len(missing[c])
        want = sum(max(x, 0.0) for x in missing[c])
        shares = [max(x, 0.0) / want * n if want else n * (k == 0) for k, x in enumerate(missing[c])]
        own = [int(s) for s in shares]
        left = n - sum(own)
        for k in sorted(range(len(own)), key=lambda k: (own[k] - shares[k], k))[:left]:
            own[k] += 1
        for k, x in enumerate(own):
            missing[c][k] -= x * size
        out[c, size] = own
    return out


def deal(groups: DataFrame, targets: list[int], seed: int, group: str = "leakage_group", locked: DataFrame | None = None) -> DataFrame:
    """(group, split); targets: images of each split. Groups of ``locked``
    (group, split) keep their split and count. Strata, which are as few as
    classes and sizes, are all that reaches the driver."""
    kind = F.concat_ws(".", F.array_position("objects", F.array_max("objects")), F.lpad(F.least("boxes", F.lit(BOXES)).cast("string"), 2, "0"))
    rows = groups.select(F.col(group).alias("g"), "images", F.array_position("primary", F.array_max("primary")).cast("int").alias("c"), kind.alias("kind"), order_key(F.col(group), seed).alias("h"))
    fixed, spent = None, {}
    if locked is not None:
        fixed = rows.join(locked.select(F.col(group).alias("g"), "split"), "g")
        for r in fixed.groupBy("c", "split").agg(F.sum("images").alias("n")).collect():
            spent[r["c"], r["split"]] = r["n"]
        rows = rows.join(locked.select(F.col(group).alias("g")), "g", "left_anti")
    rows = cut(rows.withColumn("b", F.substring("h", 1, BUCKET_DIGITS)))
    strata = {(r["c"], r["images"]): r["n"] for r in rows.groupBy("c", "images").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = {c: sum(n * size for (x, size), n in strata.items() if x == c) for c, _ in strata}
    totals = {c: free[c] + sum(n for (x, _), n in spent.items() if x == c) for c in free}
    cuts = class_cuts(totals, [max(0, t - sum(n for (c, s), n in spent.items() if s == k and c not in totals)) for k, t in zip(SPLITS, targets)])
    wanted = {c: [max(0, own[k] - spent.get((c, s), 0)) for k, s in enumerate(SPLITS)] for c, own in cuts.items()}
    shares = strata_cuts(strata, wanted)
    if not shares:
        out = rows.select(F.col("g").alias(group), F.lit(SPLITS[0]).alias("split"))
        return out if fixed is None else out.unionByName(fixed.select(F.col("g").alias(group), "split"))
    counts = rows.groupBy("c", "images", "kind", "b").count()
    line = Window.partitionBy("c", "images").orderBy("kind", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("c", "images", "kind", "b", F.coalesce(F.sum("count").over(line), F.lit(0)).alias("start"))
    within = Window.partitionBy("c", "images", "kind", "b").orderBy("h", "g")
    placed = rows.join(starts, ["c", "images", "kind", "b"]).withColumn("at", F.col("start") + F.row_number().over(within) - 1)
    known = groups.sparkSession.createDataFrame([(c, size, sum(own), own[2], own[1]) for (c, size), own in shares.items()], "c int, images long, n long, test long, val long")
    placed = placed.join(F.broadcast(known), ["c", "images"])
    # every so many-th place is a test place, and of the others every so many-th a val place
    before = lambda i, part, n: F.floor(i * part / F.greatest(n, F.lit(1)))
    i, j = F.col("at"), F.col("at") - before(F.col("at"), F.col("test"), F.col("n"))
    test = before(i + 1, F.col("test"), F.col("n")) > before(i, F.col("test"), F.col("n"))
    rest = F.col("n") - F.col("test")
    val = before(j + 1, F.col("val"), rest) > before(j, F.col("val"), rest)
    out = placed.select(F.col("g").alias(group), F.when(test, SPLITS[2]).when(val, SPLITS[1]).otherwise(SPLITS[0]).alias("split"))
    return out if fixed is None else out.unionByName(fixed.select(F.col("g").alias(group), "split"))


def _errors(now: np.ndarray, targets: np.ndarray) -> float:
    """Weighted error of (split, boxes and objects)."""
    weights = np.array([BOX, *[OBJECT] * (now.shape[1] - 1)])
    return float((weights * ((now - targets) / np.maximum(targets, 1.0)) ** 2).sum())


def _changes(now: np.ndarray, targets: np.ndarray, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear and quadratic factors of what split s gains and t loses."""
    weights = np.array([BOX, *[OBJECT] * (now.shape[1] - 1)])
    q = np.maximum(targets, 1.0) ** 2
    return 2 * weights * ((now[s] - targets[s]) / q[s] - (now[t] - targets[t]) / q[t]), weights * (1 / q[s] + 1 / q[t])


def _proposals(now: np.ndarray, targets: np.ndarray, most: int):
    """The best exchanges between the cells of a pair of blocks."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side, split = frame["side"].to_numpy(), frame["split"].to_numpy()
        values = np.array(frame["vector"].tolist(), float).reshape(len(frame), -1)
        cells, out = frame["cell"].to_numpy(), []
        same = frame["i"].iloc[0] == frame["j"].iloc[0]
        for s in range(len(SPLITS)):
            for t in range(len(SPLITS)):
                if s == t or same and s > t:
                    continue
                a, b = np.nonzero((side == 0) & (split == s))[0], np.nonzero((side == (0 if same else 1)) & (split == t))[0]
                if not len(a) or not len(b):
                    continue
                linear, square = _changes(now, targets, s, t)
                x, y = values[a], values[b]
                delta = (y @ linear + (y * y) @ square)[None, :] - (x @ linear)[:, None] + ((x * x) @ square)[:, None] - 2 * (x * square) @ y.T
                flat = delta.reshape(-1)
                best = np.argpartition(flat, min(most, len(flat)) - 1)[:most]
                if most == 1:
                    best = np.nonzero(flat <= flat[best].min() - LEAST)[0]
                for k in best[flat[best] < LEAST]:
                    left, right = sorted([(cells[a[k // len(b)]], s), (cells[b[k % len(b)]], t)])
                    out.append((round(float(flat[k]), 12), *left, *right))
        return pd.DataFrame(sorted(out)[:most], columns=["delta", "left", "s", "right", "t"])

    return run


def refine(groups: DataFrame, splits: DataFrame, ratios: list[float], group: str = "leakage_group", locked: DataFrame | None = None, share: int = SHARE) -> DataFrame:
    """(group, split) after all exchanges that improve boxes and objects;
    groups of ``locked`` (group) stay. No split changes its images or primary
    classes."""
    spark = groups.sparkSession
    joined = groups.join(splits.select(group, "split"), group).select(F.col(group).alias("g"), F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")).cast("int").alias("split"), F.concat_ws(",", "images", F.array_join(F.transform("primary", lambda x: x.cast("string")), ",")).alias("bucket"), F.concat(F.array("boxes"), F.col("objects")).alias("vector"))
    joined = joined.withColumn("split", F.col("split") - 1).withColumn("cell", F.sha2(F.concat_ws(":", "bucket", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")), 256))
    rows = cut(joined)
    if few := rows.count() <= BLOCK:
        rows = rows.withColumn("cell", F.col("g").cast("string"))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return splits.select(group, "split")
    now = np.zeros((len(SPLITS), width))
    for r in rows.groupBy("split").agg(F.array(*[F.sum(F.get("vector", F.lit(k))) for k in range(width)]).alias("v")).collect():
        now[r["split"]] = r["v"]
    targets = now.sum(0) * np.array([float(r) for r in ratios])[:, None]
    free = rows if locked is None else cut(rows.join(locked.select(F.col(group).alias("g")), "g", "left_anti"))
    held = cut(free.groupBy("bucket", "cell", "split").agg(F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")))
    blocks = held.select("bucket", "cell").distinct().groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"), F.count(F.lit(1)).alias("cells"))
    held = cut(held.join(blocks, "bucket").withColumn("i", F.pmod(F.xxhash64("cell"), F.col("m")).cast("int")))
    cells = held.select("cell").distinct().count()
    most = 1 if few else min(PROPOSED, max(1, cells // share))
    told = "bucket", "cell", "vector", "m", "i"
    while True:
        live = held.filter("n > 0")
        first = live.select("bucket", "cell", "split", "vector", "i", F.explode(F.expr("sequence(i, m - 1)")).alias("j")).withColumn("side", F.lit(0))
        second = live.filter("i > 0").select("bucket", "cell", "split", "vector", F.explode(F.expr("sequence(0, i - 1)")).alias("j0"), F.col("i").alias("j")).select("bucket", "cell", "split", "vector", F.col("j0").alias("i"), "j", F.lit(1).alias("side"))
        found = first.unionByName(second).groupBy("bucket", "i", "j").applyInPandas(_proposals(now, targets, most), "delta double, left string, s int, right string, t int")
        best = found.orderBy("delta", "left", "right").limit(most).collect()
        if not best:
            break
        named = {x for r in best for x in (r["left"], r["right"])}
        known = {(r["cell"], r["split"]): (r["n"], np.array(r["vector"], float)) for r in held.filter(F.col("cell").isin(*named)).collect()}
        moves: dict[tuple[str, int], int] = {}
        for r in best:
            left, right = (r["left"], r["s"]), (r["right"], r["t"])
            n = min(known[x][0] + moves.get(x, 0) for x in (left, right))
            if n <= 0:
                continue
            step = known[right][1] - known[left][1]
            linear, square = _changes(now, targets, r["s"], r["t"])
            slope, bend = float(step @ linear), float(step * step @ square)
            if slope + bend >= LEAST:
                continue
            k = max(1, min(int(-slope / (2 * bend)), n // share)) if bend else 1
            now[r["s"]] += k * step
            now[r["t"]] -= k * step
            for cell, split, sign in ((r["left"], r["s"], -k), (r["right"], r["t"], -k), (r["left"], r["t"], k), (r["right"], r["s"], k)):
                moves[cell, split] = moves.get((cell, split), 0) + sign
        if not moves:
            break
        changed = F.broadcast(spark.createDataFrame([(c, s, n) for (c, s), n in moves.items() if n], "cell string, split int, d long"))
        old = held.select(*told, "split", "n")
        here = F.broadcast(spark.createDataFrame([(c,) for c in {c for c, _ in moves}], "cell string"))
        new = old.join(here, "cell", "left_semi").select(*told).distinct().join(changed, "cell").select(*told, "split", F.col("d").alias("n"))
        held = cut(old.unionByName(new).groupBy(*told, "split").agg(F.sum("n").alias("n")).select("bucket", "cell", "split", "n", "vector", "m", "i"))
    return _moved(free, held, group, None if locked is None else splits.join(locked.select(group), group, "left_semi").select(group, "split"))


def _moved(free: DataFrame, held: DataFrame, group: str, fixed: DataFrame | None) -> DataFrame:
    """Groups with the splits that the counts of their cells ask for: as many
    as can stay do, and the others of a cell go where it has too few. Places
    come from counts by hash bucket, so that no cell is gathered in a task."""
    now = free.groupBy("cell", "split").agg(F.count(F.lit(1)).alias("old"))
    both = held.groupBy("cell", "split").agg(F.sum("n").alias("new")).join(now, ["cell", "split"], "full").select("cell", "split", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("old", F.lit(0)).alias("old"))
    change = cut(both.filter("new <> old"))
    ups = change.filter("new > old").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("split", (F.col("new") - F.col("old")).alias("n")))).alias("ups"))  # a row a split
    go = change.filter("old > new").select("cell", "split", (F.col("old") - F.col("new")).alias("go"), F.coalesce(F.sum(F.col("old") - F.col("new")).over(Window.partitionBy("cell").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = free.join(go, ["cell", "split"], "left").withColumn("h", F.sha2("g", 256)).withColumn("b", F.when(F.col("go").isNotNull(), F.substring("h", 1, BUCKET_DIGITS)))
    stay = rows.filter("go is null").select("g", "split")
    leaving = rows.filter("go is not null")
    counts = leaving.groupBy("cell", "split", "b").count()
    starts = counts.select("cell", "split", "b", F.coalesce(F.sum("count").over(Window.partitionBy("cell", "split").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = leaving.join(starts, ["cell", "split", "b"]).withColumn("at", F.col("start") + F.row_number().over(Window.partitionBy("cell", "split", "b").orderBy("h", "g")) - 1)
    placed = placed.join(ups, "cell")
    to = F.aggregate("ups", F.struct(F.lit(None).cast("int").alias("to"), (F.col("base") + F.col("at")).alias("rest")), lambda acc, x: F.when(acc["to"].isNotNull(), acc).when(acc["rest"] < x["n"], F.struct(x["split"].alias("to"), acc["rest"].alias("rest"))).otherwise(F.struct(F.lit(None).cast("int").alias("to"), (acc["rest"] - x["n"]).alias("rest"))), lambda acc: acc["to"])
    moved = placed.select("g", F.when(F.col("at") < F.col("go"), to).otherwise(F.col("split")).alias("split"))
    out = stay.unionByName(moved).select(F.col("g").alias(group), F.element_at(F.array(*map(F.lit, SPLITS)), F.col("split") + 1).alias("split"))
    return out if fixed is None else out.unionByName(fixed)
