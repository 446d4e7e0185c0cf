"""Splits whose objects and boxes are balanced, against loops over all groups."""

import random
from itertools import combinations

import numpy as np
import pytest

from sieveline.operators import balance, split

RATIOS = [0.7, 0.2, 0.1]
SCHEMA = "leakage_group string, images long, boxes long, primary array<long>, objects array<long>"


def vectors(rng, n, classes=3, sizes=(1, 1, 1, 2)):
    out = []
    for k in range(n):
        size = rng.choice(sizes)
        primary = [0] * classes
        for _ in range(size):
            primary[rng.randrange(classes)] += 1
        objects = [p + rng.choice([0, 0, 1, 3]) for p in primary]
        out.append((f"g{k:03d}", size, sum(objects), primary, objects))
    return out


def moving_error(groups, splits):
    """The part of the objective that exchanges change."""
    x = np.array([[g[2], *g[4]] for g in groups], float)
    targets = x.sum(0) * np.array(RATIOS)[:, None]
    now = np.array([x[[k for k, g in enumerate(groups) if splits[g[0]] == s]].sum(0) for s in split.SPLITS])
    weights = np.array([0.5, *[3.0] * (x.shape[1] - 1)])
    return float((weights * ((now - targets) / np.maximum(targets, 1)) ** 2).sum())


def by_loop(groups, splits, locked=()):
    """Exchanges the best pair of like groups again and again."""
    splits = dict(splits)
    free = sorted(g for g in groups if g[0] not in locked)
    while True:
        now = moving_error(groups, splits)
        best = None
        for a, b in combinations(free, 2):
            if (a[1], a[3]) == (b[1], b[3]) and splits[a[0]] != splits[b[0]]:
                changed = splits | {a[0]: splits[b[0]], b[0]: splits[a[0]]}
                d = moving_error(groups, changed) - now
                if d < -1e-12 and (best is None or d < best[0] - 1e-12):
                    best = (d, changed)
        if not best:
            return splits
        splits = best[1]


def as_map(df):
    rows = df.collect()
    out = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_refine_equals_the_loop_on_small_tables(spark, seed):
    rng = random.Random(seed)
    groups = vectors(rng, 40)
    splits = {g[0]: rng.choices(split.SPLITS, [7, 2, 1])[0] for g in groups}
    locked = [g[0] for g in groups[:5]] if seed == 2 else []
    frame = spark.createDataFrame(groups, SCHEMA)
    given = spark.createDataFrame([*splits.items()], "leakage_group string, split string")
    fixed = spark.createDataFrame([(g,) for g in locked], "leakage_group string") if locked else None
    got = as_map(balance.refine(frame, given, RATIOS, locked=fixed))
    assert set(got) == set(splits) and all(got[g] == splits[g] for g in locked)
    assert moving_error(groups, got) == pytest.approx(moving_error(groups, by_loop(groups, splits, locked)), abs=1e-9)
    assert moving_error(groups, got) < moving_error(groups, splits)
    for s in split.SPLITS:  # images and primary classes stay as they were
        own = lambda m: sorted((g[1], tuple(g[3])) for g in groups if m[g[0]] == s)
        assert own(got) == own(splits)


def test_refine_takes_many_at_once(spark, monkeypatch):
    """Many groups of few kinds, over several blocks of cells."""
    rng = random.Random(5)
    groups = vectors(rng, 3000, classes=2, sizes=(1,))
    splits = {g[0]: "train" if g[4][0] + g[4][1] > 2 else "val" if k % 3 else "test" for k, g in enumerate(groups)}
    monkeypatch.setattr(balance, "BLOCK", 2)
    got = as_map(balance.refine(spark.createDataFrame(groups, SCHEMA), spark.createDataFrame([*splits.items()], "leakage_group string, split string"), RATIOS, share=4))
    assert set(got) == set(splits)
    # no exchange that is left improves
    x = {g[0]: (g[1], tuple(g[3])) for g in groups}
    seen, before = {}, moving_error(groups, got)
    for g in groups:
        seen.setdefault((x[g[0]], got[g[0]], g[2], tuple(g[4])), g[0])
    assert before < moving_error(groups, splits)
    for a, b in combinations(seen.items(), 2):
        if a[0][0] == b[0][0] and a[0][1] != b[0][1]:
            assert moving_error(groups, got | {a[1]: got[b[1]], b[1]: got[a[1]]}) > before - 1e-9


def greedy(groups, targets, locked):
    """One group after another to the split whose squared errors grow least."""
    x = np.array([[g[1], g[2], *g[3], *g[4]] for g in groups], float)
    want = x.sum(0) * np.array(RATIOS)[:, None]
    want[:, 0] = targets
    n = len(groups[0][3])
    weights = np.array([8, 0.5, *[2] * n, *[3] * n])
    now, out = np.zeros_like(want), dict(locked)
    for k, g in enumerate(groups):
        if g[0] in locked:
            now[split.SPLITS.index(locked[g[0]])] += x[k]
    for k in sorted(range(len(groups)), key=lambda k: (-groups[k][1], groups[k][0])):
        if groups[k][0] in locked:
            continue
        fits = [s for s in range(3) if now[s, 0] + x[k, 0] <= targets[s]] or [0, 1, 2]
        cost = lambda s: (weights * (((now[s] + x[k] - want[s]) / np.maximum(want[s], 1)) ** 2 - ((now[s] - want[s]) / np.maximum(want[s], 1)) ** 2)).sum()
        s = min(fits, key=cost)
        out[groups[k][0]] = split.SPLITS[s]
        now[s] += x[k]
    return out


def six_classes():
    """Six classes of ten groups; two images of the last class are one group."""
    rows = []
    for c in range(6):
        one = [int(k == c) for k in range(6)]
        rows += [(f"c{c}-{k}", 1, 1, one, one) for k in range(8 if c == 5 else 10)]
    two = [0] * 5 + [2]
    return rows + [("pair", 2, 2, two, two)]


def test_deal_meets_targets(spark):
    groups = six_classes()
    got = as_map(balance.deal(spark.createDataFrame(groups, SCHEMA), [42, 12, 6], 42))
    images = {s: sum(g[1] for g in groups if got[g[0]] == s) for s in split.SPLITS}
    assert images == {"train": 42, "val": 12, "test": 6}
    assert all({g[3].index(max(g[3])) for g in groups if got[g[0]] == s} == set(range(6)) for s in split.SPLITS)
    assert moving_error(groups, got) <= moving_error(groups, greedy(groups, [42, 12, 6], {})) + 1e-9
    # twelve more groups, with the old ones locked
    more = groups + [(f"new{c}-{k}", 1, 1, [int(j == c) for j in range(6)], [int(j == c) for j in range(6)]) for c in range(6) for k in range(2)]
    locked = spark.createDataFrame([*got.items()], "leakage_group string, split string")
    later = as_map(balance.deal(spark.createDataFrame(more, SCHEMA), [53, 13, 6], 42, locked=locked))
    assert all(later[g] == s for g, s in got.items()) and set(later) == {g[0] for g in more}
    assert {s: sum(g[1] for g in more if later[g[0]] == s) for s in split.SPLITS} == {"train": 53, "val": 13, "test": 6}


@pytest.mark.parametrize("seed", [3, 4])
def test_deal_balances_objects(spark, seed):
    rng = random.Random(seed)
    groups = vectors(rng, 400, sizes=(1, 1, 2, 5))
    total = sum(g[1] for g in groups)
    targets = split.integer_targets(total, ["0.7", "0.2", "0.1"])
    frame = spark.createDataFrame(groups, SCHEMA)
    dealt = balance.deal(frame, targets, 7)
    got = as_map(dealt)
    images = [sum(g[1] for g in groups if got[g[0]] == s) for s in split.SPLITS]
    assert all(abs(a - b) <= 5 for a, b in zip(images, targets)) and set(got) == {g[0] for g in groups}
    best = as_map(balance.refine(frame, dealt, RATIOS, share=8))
    assert moving_error(groups, best) <= min(moving_error(groups, got), moving_error(groups, greedy(groups, targets, {}))) + 1e-9
    told = {r["split"]: r for r in balance.objective(frame, dealt, RATIOS, targets).collect()}
    assert sum(r["box_error"] + r["object_error"] for r in told.values()) == pytest.approx(moving_error(groups, got))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    dealt = balance.deal(none, [0, 0, 0], 1)
    assert dealt.count() == 0 and balance.refine(none, dealt, RATIOS).count() == 0
    assert {r["objective"] for r in balance.objective(none, dealt, RATIOS, [0, 0, 0]).collect()} == {0.0}


def test_everything_locked(spark):
    groups = six_classes()[:6]
    frame = spark.createDataFrame(groups, SCHEMA)
    locked = frame.selectExpr("leakage_group", "'val' as split")
    assert set(as_map(balance.deal(frame, [4, 1, 1], 1, locked=locked)).values()) == {"val"}
    assert set(as_map(balance.refine(frame, locked, RATIOS, locked=locked)).values()) == {"val"}
