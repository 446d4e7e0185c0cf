"""Audit of how filters interact, as a product of incidence matrices.

Each document fails some of five filters, which is a mask of five bits. A part
of the corpus is then three rows of 32 counts: its documents by mask, those of
good quality, those that are toxic. An order of the filters and a step in it
say for each mask whether a document is still there after the step, goes
there, would have failed but went earlier, or fails that filter alone: four
integer matrices of 32 masks by 600 (120 orders of five steps). Rows times
matrices are the counts, exact in 64-bit integers.

The filters: A fewer than ``MIN_WORDS`` words; B under ``MIN_DISTINCT`` %
distinct words; C over ``MAX_CAPITALS`` % capitals; D any mark of ``MARKS``;
E the text of a document with a smaller id.

How it runs: masks of A to D are SQL functions within a row. Rows of a digest,
part, mask and label are added up with their least id before digests meet, so
that a text with any number of copies is a few rows; those rows and the least
id of the digest are joined. Counts by part are then multiplied in numpy, a
bounded number of parts at a time.

Edge cases: a null text is the empty text; a null source is the part '';
labels that repeat an id mark it if any of them does; rows that repeat an id
and text are both first; a null id is neither smaller nor larger than any, so
its row never fails E, and has no label; an empty table has no parts and no
rows; only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE, cut, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 50, 65, 5, "#$%&*|"
#: Parts that are multiplied at once.
PARTS = 64
#: Parts into which rows without an id are dealt.
SALTS = 256
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def matrices(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of each column, and a matrix of masks by columns for
    each outcome: kept, removed, redundant, unique, and shapley, which adds
    removed over all columns of the step's filter."""
    columns = [("".join(order), step) for order in permutations(filters) for step in range(1, len(filters) + 1)]
    mask = np.arange(1 << len(filters))[:, None]
    own = np.array([1 << filters.index(order[step - 1]) for order, step in columns])
    before = np.array([sum(1 << filters.index(f) for f in order[: step - 1]) for order, step in columns])
    fails, gone = mask & own > 0, mask & before > 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == own}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["shapley"] = out["removed"] @ (own[:, None] == own).astype(np.int64)
    return columns, out


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    n = F.size(words)
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS * F.length(text), text.rlike(f"[{MARKS}]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just those filters."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(t.cast("binary"), 256).alias("digest"), text_mask(t).alias("mask"))
    # rows without an id have no label; they are dealt by their digest
    slim = slim.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("salt")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    known = slim.join(marks, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["digest", "part", "mask", "good", "toxic"]
    # rows of an id are together already; then copies become a row for each part, mask and label
    rows = known.groupBy("id", "salt", *keys).agg(F.count("*").alias("n"))
    held = cut(rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_without")))
    first = held.groupBy("digest").agg(F.min("least").alias("first"))
    passing = F.coalesce(F.when(F.col("least") == F.col("first"), F.col("n_least")), F.lit(0)) + F.col("n_without")
    both = held.join(first, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("x"))
    return both.groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def outcomes(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step) with the seven counts; counted: as masks() returns it."""
    stacks = ("docs", "good", "toxic")
    rows = zip(stacks, (F.lit(True), F.col("good"), F.col("toxic")))
    sums = [F.array(*(F.sum(F.when(when & (F.col("mask") == m), F.col("n")).otherwise(0)) for m in range(1 << len(FILTERS)))).alias(k) for k, when in rows]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, by = matrices()
        order, step = pa.array([c[0] for c in columns]), pa.array([c[1] for c in columns], pa.int32())
        factors = [("docs", "kept"), ("docs", "removed"), ("docs", "redundant"), ("docs", "unique"), ("good", "removed"), ("toxic", "removed"), ("docs", "shapley")]
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                stacked = {k: np.array(some.column(some.schema.get_field_index(k)).to_pylist(), np.int64) for k in stacks}
                products = [pa.array((stacked[a] @ by[b]).reshape(-1)) for a, b in factors]
                names = np.repeat(np.arange(some.num_rows), len(columns))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(names)), pa.concat_arrays([order] * some.num_rows), pa.concat_arrays([step] * some.num_rows), *products], ["part", "filter_order", "step", *OUTCOMES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES)
    return counted.groupBy("part").agg(*sums).mapInArrow(multiplied, schema)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH mark AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
mask AS (SELECT part, (CASE WHEN len(w) < 50 THEN ['A'] ELSE [] END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN ['B'] ELSE [] END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN ['C'] ELSE [] END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN ['E'] ELSE [] END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM doc LEFT JOIN mark USING (doc_id)),
hist AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM mask GROUP BY ALL),
f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS own, string_split(filter_order[:(s - 1)], '') AS before FROM orders, range(1, 6) r(s)),
told AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, before)) AS kept,
    sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS removed, sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, before)) AS redundant, sum(n) FILTER (fails = [own]) AS unique_fails,
    sum(g) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS good_lost, sum(x) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS toxic_lost FROM hist, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
    coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM told
"""
