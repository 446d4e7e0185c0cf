import random

import pytest

from sieveline.operators.similarity import attach
from sieveline.streaming import ingest, links

SCHEMA = "sha256 string, hash long, ord long, existing boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def rows(rng, n, start):
    out = []
    for k in range(n):
        h = rng.choice([0, (1 << 64) - 1, 0x0F0F0F0F0F0F0F0F])
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(64)
        out.append((f"{rng.getrandbits(40):010x}", h - (1 << 64) if h >> 63 else h, start + k))
    return out


def test_links_give_the_groups_of_attach(spark, rocks, tmp_path):
    rng = random.Random(1)
    old = [(s, h, f"G{k % 4}") for k, (s, h, _) in enumerate(rows(rng, 12, 0))]
    batches = [rows(rng, 15, 100 * b) for b in (1, 2, 3)]
    batches[1] += [batches[0][3], (old[0][0], old[0][1], 290), ("ffnone", None, 291), ("ffnone", None, 292)]
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: links.start_links(ingest.replay(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/links", f"{tmp_path}/state", 3).awaitTermination(240)
    put([(s, h, None, True) for s, h, _ in old])
    put([(*r, False) for r in batches[0]])
    assert run()
    for part in batches[1:]:
        put([(*r, False) for r in part])
    assert run()  # goes on from the state of the first run
    existing = spark.createDataFrame(old, "sha256 string, hash long, leakage_group string")
    new = spark.createDataFrame([r for part in batches for r in part], "sha256 string, hash long, ord long")
    want = {r["sha256"]: r["leakage_group"] for r in attach(new, existing, 3).collect()}
    got = links.resolve(spark.read.parquet(f"{tmp_path}/links"), existing).collect()
    assert {r["sha256"]: r["leakage_group"] for r in got} == want and len(got) == len(want) and len(set(want.values())) < len(want)
    assert want["ffnone"] == "dhash-ffnone"
