"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and underscores in lower case. A document
and a benchmark item are a pair if they share seeds (``MIN_TILE`` tokens in a
row) enough to reach the threshold. Within a pair, running Karp-Rabin hashes
find all shared runs, and the longest run whose tokens are not marked yet is
marked in both, again and again, down to ``MIN_TILE`` tokens; a passage whose
parts were put in another order is covered by several tiles. The coverage is
the share of the item's tokens in tiles.

How it runs: the seeds of the benchmark set bits of a filter of fixed size,
which is broadcast; one map over the documents keeps those with a seed in the
filter, with their tokens. Their seeds meet the benchmark's seeds in a join;
pairs are counted, pruned by what their seeds can cover, and only then tiled,
one pair at a time. The benchmark's seeds are broadcast only below
``SMALL_SEEDS`` rows; beyond that their join shuffles, salted. Whether its
texts are is left to Spark, which knows their size.

Edge cases: a null or empty text on either side pairs with nothing, nor does
an item with fewer than ``MIN_TILE`` tokens; repeated documents or items each
give their rows; a null id is carried through. Long and repetitive texts take
time in proportion to their length (see ``tile``). Only the two named columns
of either side are read, whatever others are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table

MIN_TILE, COVERAGE = 5, 0.8
FILTER_BITS = 24
#: Rows of benchmark seeds that may be broadcast (16 bytes each).
SMALL_SEEDS = 500_000
SALTS = 16
TOKEN, GAP = re.compile(r"\w+"), re.compile(r"\W+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Characters of a long text whose tokens are taken at once.
LONG = 1 << 18
#: Rows that a task works on at once.
SLICE = 256


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def token_pieces(text: str | None, keep: int = MIN_TILE - 1) -> Iterator[tuple[list[str], int]]:
    """(tokens, how many of them were met before) of a text, a long one in
    several pieces, each of which begins with the ``keep`` tokens before it."""
    low, at, held = (text or "").lower(), 0, []
    while len(low) - at > 2 * LONG and (found := GAP.search(low, at + LONG)):
        tokens = held + TOKEN.findall(low, at, found.start())
        yield tokens, len(held)
        at, held = found.end(), tokens[-keep:]
    yield held + TOKEN.findall(low, at), len(held)


def seeds(tokens: list[str], width: int = MIN_TILE) -> np.ndarray:
    """Karp-Rabin hash of each run of ``width`` tokens, unsigned."""
    if len(tokens) < width:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(crc32, "\n".join(tokens).encode().split(b"\n")), np.uint64, len(tokens))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * BASE + h[k : k + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Windows:
    """Running Karp-Rabin hashes of a sequence of token numbers. Places that
    are marked lie in no window."""

    def __init__(self, tokens: np.ndarray, free: np.ndarray | None = None) -> None:
        n = len(tokens)
        self.tokens, self.free = tokens, np.ones(n, bool) if free is None else free
        mixed = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        one = np.ones(1, np.uint64)
        self.back = np.concatenate([one, np.cumprod(np.full(n, INVERSE))])
        self.sums = np.concatenate([one - one, np.cumsum(mixed * np.concatenate([one, np.cumprod(np.full(n, BASE))])[:n])])

    def hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a mark, and their hashes."""
        marks = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marks[width:] == marks[:-width])
        return at, (self.sums[at + width] - self.sums[at]) * self.back[at]


def _matched(a: Windows, b: Windows, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a and of b with a hash that both have: starts and hashes."""
    i, x = a.hashes(width)
    j, y = b.hashes(width)
    p, q = np.isin(x, y), np.isin(y, x)
    return i[p], x[p], j[q], y[q]


def tile(item: list[str], doc: list[str], width: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first; of equal
    ones the earliest in the item, then in the document.

    The length of the longest free match is found by bisection over hashed
    windows, and all tiles of that length are marked in one pass. The lengths
    that occur are few (their sum is below the item's length) and a pass takes
    time in proportion to both texts, however often tokens repeat."""
    number: dict[str, int] = {}
    x, y = (np.fromiter((number.setdefault(t, len(number)) for t in part), np.int64, len(part)) for part in (item, doc))
    if len(x) < width or len(y) < width:
        return []
    a = Windows(x)
    # of the document, only windows count that the item has too, with one token between stretches of them
    inside = np.zeros(len(y) + 1, np.int64)
    start = _matched(a, Windows(y), width)[2]
    inside[start] += 1
    inside[start + width] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    kept = np.flatnonzero(inside | np.append(False, inside[:-1]))
    b = Windows(y[kept], inside[kept])
    tiles: list[tuple[int, int, int]] = []
    high = min(len(x), len(kept))
    while high >= width:
        found, n, low = _matched(a, b, width), width, width + 1
        if not len(found[0]):
            break
        while low <= high:
            middle = (low + high) // 2
            if len((longer := _matched(a, b, middle))[0]):
                found, n, low = longer, middle, middle + 1
            else:
                high = middle - 1
        i, hx, j, hy = found
        order = np.argsort(hy, kind="stable")
        keys, first, counts = np.unique(hy[order], return_index=True, return_counts=True)
        places, at, ends = j[order].tolist(), first.tolist(), (first + counts).tolist()
        # marks of this pass are n long, so that a window is free if its first and last place are
        free = lambda w, k: w.free[k] and w.free[k + n - 1]  # noqa: B023, E731
        for p, g in zip(i.tolist(), np.searchsorted(keys, hx).tolist()):
            if not free(a, p):
                continue
            while at[g] < ends[g] and not free(b, places[at[g]]):
                at[g] += 1
            for q in places[at[g] : ends[g]] if at[g] < ends[g] else ():
                if free(b, q) and np.array_equal(a.tokens[p : p + n], b.tokens[q : q + n]):
                    a.free[p : p + n] = b.free[q : q + n] = False
                    tiles.append((p, int(kept[q]), n))
                    break
        high = n - 1
    return tiles


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _seed_table(items: DataFrame, text: str, id_column: str) -> DataFrame:
    """(item, h, places, tokens of the item): distinct seeds of each row and
    the number of their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, places, sizes = [], [], [], []
            for key, value in zip(batch.column(0), batch.column(1)):
                tokens = tokens_of(value.as_py())
                own, times = np.unique(seeds(tokens), return_counts=True)
                ids += [key.as_py()] * len(own)
                hashes += own.view(np.int64).tolist()
                places += times.tolist()
                sizes += [len(tokens)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], ["item", "h", "places", "size"])

    kind = items.schema[id_column].dataType.simpleString()
    return items.select(F.col(id_column), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"item {kind}, h long, places int, size int")


def _filter(hashes: DataFrame) -> np.ndarray:
    """Bits of all seeds, OR-ed by 64-bit word on the executors: at most
    2^(FILTER_BITS - 6) rows leave them for each of the two hashes."""
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    high = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = hashes.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), low.alias("v")), F.struct(F.lit(1).alias("k"), high.alias("v")))).alias("x")).select("x.k", F.shiftright("x.v", 6).alias("word"), F.expr("shiftleft(1L, cast(x.v & 63 as int))").alias("bit"))
    bits = np.zeros((2, 1 << (FILTER_BITS - 6)), np.uint64)
    for r in words.groupBy("k", "word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["k"], r["word"]] = np.uint64(r["bits"] & ((1 << 64) - 1))
    return bits


def _candidates(docs: DataFrame, bits: np.ndarray, text: str, id_column: str) -> DataFrame:
    """(doc, tokens, hs): documents with seeds that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, one = shared.value, np.uint64(1)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, texts, hashes = [], [], []
            for key, value in zip(batch.column(0), batch.column(1)):
                text, found, said = value.as_py(), [], []
                for tokens, met in token_pieces(text):
                    h = seeds(tokens)
                    x, y = _places(h)
                    hit = (words[0][x >> 6] >> (x & 63).astype(np.uint64)) & (words[1][y >> 6] >> (y & 63).astype(np.uint64)) & one
                    found.append(np.unique(h[hit.astype(bool)]))
                    said.append(" ".join(tokens[met:] if met else tokens))
                if any(map(len, found)):
                    ids.append(key.as_py())
                    texts.append(" ".join(x for x in said if x))
                    hashes.append(np.unique(np.concatenate(found)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(texts, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], ["doc", "tokens", "hs"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"doc {kind}, tokens string, hs array<long>")


def _tiled(pairs: DataFrame) -> DataFrame:
    """pairs: (doc, item, tokens, text) -> with the tiles' figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows = []
            for a, b in zip(batch.column(2), batch.column(3)):
                doc, item = a.as_py().split(" "), tokens_of(b.as_py())
                tiles = tile(item, doc)
                rows.append((len(item), sum(t[2] for t in tiles), len(tiles), max((t[2] for t in tiles), default=0)))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc", "item", "item_words", "covered_words", "n_tiles", "longest_tile"])

    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc", "item")]
    return pairs.select("doc", "item", "tokens", "text").mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}, item_words long, covered_words long, n_tiles long, longest_tile long")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """(doc, item, item_words, covered_words, n_tiles, longest_tile, coverage)
    for each pair with at least that coverage."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).withColumn("row", F.xxhash64("item", "text"))
    seed = cut(_seed_table(items.select("row", "text").distinct(), "text", "row").withColumnRenamed("item", "row"))
    n = seed.count()
    found = cut(_candidates(docs, _filter(seed), text, id_column).withColumn("rid", F.monotonically_increasing_id()))
    own = found.select("rid", F.explode("hs").alias("h"))
    if n <= SMALL_SEEDS:
        met = own.join(F.broadcast(seed), "h")
    else:  # a seed may stand in a third of all documents
        met = own.withColumn("salt", (F.col("rid") % SALTS).cast("int")).join(seed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"])
    # a token of a tile lies in a seed that both share, and each place of one holds MIN_TILE
    enough = F.col("n") * MIN_TILE >= coverage * F.col("size")
    pairs = met.groupBy("rid", "row", "size").agg(F.sum("places").alias("n")).filter(enough).select("rid", "row")
    joined = pairs.join(items, "row").join(found.select("rid", "doc", "tokens"), "rid")
    tiled = _tiled(joined).withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return tiled.filter(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents without those that cover an item. Rows are told apart by
    id and text, so that a row with a null or shared id is judged alone."""
    own = F.coalesce(F.col("text"), F.lit(""))
    # 128 bits of the text beside the id: rows of one key are the same document
    key = F.concat_ws("/", F.coalesce(F.col(id_column).cast("string"), F.lit("none")), F.xxhash64(own).cast("string"), F.xxhash64(own, F.lit(1)).cast("string"))
    keyed = docs.select(key.alias("__key"), "text")
    bad = contamination(keyed, benchmark, id_column="__key").select(F.col("doc").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(bad, "__key", "left_anti").drop("__key")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "item_words", "covered_words", "n_tiles", "longest_tile", "coverage")
