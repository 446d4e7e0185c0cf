"""Incremental groups as keyed state.

A stream of (sha256, hash, ord, existing) becomes a stream of links. The state
of a key, which is a value of a band of the hash, is the rows that stood under
it; a new row is compared with those of its own keys only, so the work of a
micro-batch follows from its rows and not from the manifest. State may expire.

Links do not name groups, as a row's group may be founded in the same batch:
each row has a link to itself, and one to the smallest near sha of each key.
``resolve`` follows them when groups are wanted, and gives what ``attach``
gives for the same rows in the same order.

Rows that exist already are remembered and get no link; a sha that was met
before is a copy and gets none either. Rows without a hash have no neighbours.
Batches are met in their order, rows of a batch by ``ord``.

State needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sieveline.operators.similarity import bands, follow

#: The band of rows without a hash.
NONE = -1


class Neighbours(StatefulProcessor):
    """Keyed by (band, value): what new rows are near to."""

    def __init__(self, distance: int, expire_ms: int | None = None) -> None:
        self.distance, self.expire_ms = distance, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "sha256 string, hash long", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(self.seen.get()) if self.seen.exists() else []
        shas, hashes = [r[0] for r in held], [r[1] or 0 for r in held]
        known, new = set(shas), []
        for row in sorted(rows, key=lambda r: (not r["existing"], r["ord"] if r["ord"] is not None else 0)):
            sha, value = row["sha256"], row["hash"]
            if sha in known:
                continue
            if not row["existing"]:
                if key[0] <= 0:  # the first band, or none: a row meets it once
                    yield Row(sha256=sha, parent=sha)
                if key[0] != NONE and shas:
                    differ = np.bitwise_count(np.array(hashes, np.int64).view(np.uint64) ^ np.int64(value).view(np.uint64))
                    near = [shas[k] for k in np.flatnonzero(differ <= self.distance)]
                    if near:
                        yield Row(sha256=sha, parent=min(near))
            known.add(sha)
            shas.append(sha)
            hashes.append(value or 0)
            new.append((sha, value))
        if new:
            self.seen.appendList(new)

    def close(self) -> None:
        pass


def links(stream: DataFrame, distance: int, expire_ms: int | None = None) -> DataFrame:
    """(sha256, parent) of a stream of (sha256, hash, ord, existing)."""
    # hashes within the distance agree in one of so many bands
    values = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit(mask)).alias("value")) for k, (shift, mask) in enumerate(bands(distance + 1))]
    alone = F.array(F.struct(F.lit(NONE).alias("band"), F.xxhash64("sha256").alias("value")))
    keyed = stream.select("sha256", "hash", "ord", "existing", F.explode(F.when(F.col("hash").isNull(), alone).otherwise(F.array(*values))).alias("x")).select("*", "x.band", "x.value").drop("x")
    return keyed.groupBy("band", "value").transformWithState(Neighbours(distance, expire_ms), "sha256 string, parent string", "Append", "processingTime" if expire_ms else "none")


def start_links(stream: DataFrame, path: str, checkpoint: str, distance: int = 6, expire_ms: int | None = None) -> StreamingQuery:
    """Writes the links of what is there, batch by batch, each of them once."""
    return links(stream, distance, expire_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def resolve(found: DataFrame, existing: DataFrame, sha: str = "sha256", group: str = "leakage_group") -> DataFrame:
    """(sha256, leakage_group) of the rows that have links; existing: the
    groups of the rows that were there before."""
    least = F.min(F.when(F.col("parent") != F.col("sha256"), F.col("parent")))
    tree = found.groupBy("sha256").agg(F.coalesce(least, F.col("sha256")).alias("parent"))
    return follow(tree, existing.select(F.col(sha).alias("parent"), F.col(group).alias("known")))
