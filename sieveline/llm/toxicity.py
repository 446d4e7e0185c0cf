"""Toxicity scores by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its prefixes of three
to five characters. Filters of widths one to three slide over the words; the
largest response of each filter over the whole text (max pooling), less a
learnt threshold, feeds a logistic layer. Only the text enters a score.

A filter of width w is a sum of w linear maps of word embeddings, so scoring
looks up, for each distinct word, what it adds at each place of each filter.

Thresholds are calibrated by language on labelled documents that were not
learnt from: the score with the best F1 (counts of scores in a fixed number of
bins leave the tasks, no rows do).

Training takes at most ``TRAIN_ROWS`` labelled documents with at most
``TRAIN_CHARS`` characters, whole texts in the order of a hash of the id.
Everything else covers all rows.

Edge cases: a null or empty text gets the score of no response at all (the
logistic of the bias); labels that are null are not learnt from; with no
label of one kind every score is 0; rows that repeat give a row each; an id
with both labels is toxic; a text beyond ``TRAIN_CHARS`` is scored but not
learnt from. A long text is scored in pieces that overlap by what the widest
filter needs, so that memory stays bounded. Only the named columns are read,
whatever others are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, held_out, table, word_pieces

#: Labelled documents that are learnt from, at most.
TRAIN_ROWS = 6000
#: Characters of learnt texts that reach the driver at most; further ones of the hash order are left out whole.
TRAIN_CHARS = 24_000_000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 8, 6, (1, 2, 3)
PARTS = 4  # the word and three prefixes
EPOCHS, RATE = 8, 0.08
#: The threshold that a language has without enough toxic documents; one labelled document in so many calibrates.
LIMIT, APART = 0.7, 4
STRIP = re.compile(rb"[^\w\x80-\xff]+")


def word_parts(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its prefixes, without ASCII punctuation."""
    plain = STRIP.sub(b"", word) or word
    letters = plain.decode("utf-8", "replace")
    return tuple(crc32(b"%d:" % k + (plain if not k else letters[: k + 2].encode())) % BUCKETS for k in range(PARTS))


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x SIZE
    filters: list[np.ndarray]  # per width: width x SIZE x FILTERS
    out: np.ndarray  # widths * FILTERS
    bias: float
    shift: np.ndarray  # widths * FILTERS, taken off before pooling


class Words(dict):
    """Numbers words in the order in which they are met; new holds the parts
    of those since the last call of taken()."""

    def __init__(self) -> None:
        self.new: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word_parts(word))
        self[word] = len(self)
        return len(self) - 1

    def ids(self, text: str | None) -> np.ndarray:
        parts = []
        for words, met in word_pieces((text or "").lower().encode("utf-8", "replace"), 0):
            parts.append(np.fromiter(map(self.__getitem__, words[met:] if met else words), np.int32, len(words) - met))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def taken(self) -> np.ndarray:
        out, self.new = np.array(self.new, np.int64).reshape(-1, PARTS), []
        return out


def _responses(model: Model, parts: np.ndarray) -> list[list[np.ndarray]]:
    """What each word adds to the filters, by width and place."""
    vectors = model.embedding[parts[:, 0]]
    for k in range(1, PARTS):
        vectors = vectors + model.embedding[parts[:, k]]
    return [[vectors @ f[place] for place in range(len(f))] for f in model.filters]


def _pooled(tables: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Largest response of each filter per document; zero where a text has
    fewer words than the filter."""
    out = np.zeros((len(starts), sum(t[0].shape[1] for t in tables)), np.float32)
    column = 0
    for t in tables:
        width, n = len(t), t[0].shape[1]
        full = np.nonzero(ends - starts >= width)[0]
        if len(full) and len(ids) >= width:
            sums = t[0][ids[: len(ids) - width + 1]]
            for place in range(1, width):
                sums += t[place][ids[place : len(ids) - width + 1 + place]]
            edges = np.empty(2 * len(full), np.int64)
            edges[0::2], edges[1::2] = starts[full], ends[full] - width + 1
            sums = np.concatenate([sums, sums[-1:]])
            out[full, column : column + n] = np.maximum.reduceat(sums, edges, axis=0)[0::2]
        column += n
    return np.maximum(out, 0)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent (AdaGrad) over documents; the gradient of a
    pooled response goes to the words at which it is reached."""
    words = Words()
    docs = [words.ids(t) for t in texts]
    parts = words.taken()
    rng = np.random.default_rng(seed)
    model = Model((rng.standard_normal((BUCKETS, SIZE)) * 0.05).astype(np.float32), [(rng.standard_normal((w, SIZE, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS], (np.abs(rng.standard_normal(len(WIDTHS) * FILTERS)) * 0.3).astype(np.float32), -1.0, np.full(len(WIDTHS) * FILTERS, 0.3, np.float32))
    model.out[::3] *= -1
    sums = {"e": np.full(model.embedding.shape, 1e-3, np.float32), "f": [np.full(f.shape, 1e-3, np.float32) for f in model.filters], "o": np.full(model.out.shape, 1e-3, np.float32), "b": 1e-3, "s": np.full(model.out.shape, 1e-3, np.float32)}
    positive = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * max(1, len(labels) - positive)))
    batch = 16
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        rate = RATE / (1 + 0.15 * epoch)
        for at in range(0, len(order), batch):
            own = [k for k in order[at : at + batch] if len(docs[k])]
            if not own:
                continue
            ids = np.concatenate([docs[k] for k in own])
            ends = np.cumsum([len(docs[k]) for k in own])
            starts = np.concatenate([[0], ends[:-1]])
            p = parts[ids]
            vectors = model.embedding[p].sum(axis=1)
            pooled, where = [], []
            for w, f in zip(WIDTHS, model.filters):
                n = len(ids) - w + 1
                conv = sum(vectors[k : k + n] @ f[k] for k in range(w)) if n > 0 else np.zeros((0, FILTERS), np.float32)
                best, place = np.zeros((len(own), FILTERS), np.float32), np.zeros((len(own), FILTERS), np.int64) - 1
                for d, (a, b) in enumerate(zip(starts, ends)):
                    if b - a >= w:
                        place[d] = conv[a : b - w + 1].argmax(axis=0) + a
                        best[d] = conv[place[d], np.arange(FILTERS)]
                pooled.append(best)
                where.append(place)
            hidden = np.concatenate(pooled, axis=1) - model.shift
            active = hidden > 0
            hidden = hidden * active
            score = _logistic(hidden @ model.out + model.bias)
            delta = ((score - labels[own]) * weight[own] / len(own)).astype(np.float32)
            g_out, g_bias = hidden.T @ delta + 1e-4 * model.out, float(delta.sum())
            g_hidden = np.outer(delta, model.out) * active
            g_shift = -g_hidden.sum(axis=0)
            touched, grads = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                g, place = g_hidden[:, k * FILTERS : (k + 1) * FILTERS], where[k]
                g_f = np.zeros_like(f)
                d, c = np.nonzero((g != 0) & (place >= 0))
                if len(d):
                    spot, value = place[d, c], g[d, c]
                    for offset in range(w):
                        at_word = spot + offset
                        np.add.at(g_f[offset].T, c, value[:, None] * vectors[at_word])
                        touched.append(p[at_word].ravel())
                        grads.append(np.repeat(value[:, None] * f[offset].T[c], PARTS, axis=0))
                sums["f"][k] += g_f**2
                f -= rate * g_f / np.sqrt(sums["f"][k])
            if touched:
                rows_, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                g_e = np.zeros((len(rows_), SIZE), np.float32)
                np.add.at(g_e, inverse, np.concatenate(grads))
                sums["e"][rows_] += g_e**2
                model.embedding[rows_] -= rate * g_e / np.sqrt(sums["e"][rows_])
            sums["o"] += g_out**2
            model.out -= rate * g_out / np.sqrt(sums["o"])
            sums["s"] += g_shift**2
            model.shift -= rate * g_shift / np.sqrt(sums["s"])
            sums["b"] += g_bias**2
            model.bias -= rate * g_bias / np.sqrt(sums["b"])
    return model


class Scorer:
    """Scores batches of texts; remembers what words add to the filters, and
    starts afresh beyond ``words`` of them."""

    def __init__(self, model: Model, words: int = 150_000, piece: int = 1 << 17) -> None:
        self.model, self.limit, self.piece = model, words, piece
        self._clear()

    def _clear(self) -> None:
        self.words = Words()
        self.tables = [[np.zeros((1024, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]

    def _learn(self) -> None:
        first, new = len(self.words) - len(self.words.new), self.words.taken()
        if not len(new):
            return
        for own, more in zip(self.tables, _responses(self.model, new)):
            for place, values in enumerate(more):
                if first + len(new) > len(own[place]):
                    own[place] = np.concatenate([own[place][:first], np.zeros((first + 2 * len(new), FILTERS), np.float32)])
                own[place][first : first + len(new)] = values

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > self.limit:
            self._clear()
        docs = [self.words.ids(t) for t in texts]
        self._learn()
        if not docs:
            return np.zeros(0)
        parts, own = [], []  # long texts in pieces, each with its document
        for k, d in enumerate(docs):
            for at in range(0, max(1, len(d)), self.piece):
                parts.append(d[at : at + self.piece + max(WIDTHS) - 1])
                own.append(k)
        pooled = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.float32)
        lot, size = 0, 0
        for k, d in enumerate(parts):
            size += len(d)
            if size >= self.piece or k == len(parts) - 1:
                sizes = np.array([len(x) for x in parts[lot : k + 1]], np.int64)
                ends = np.cumsum(sizes)
                np.maximum.at(pooled, own[lot : k + 1], _pooled(self.tables, np.concatenate(parts[lot : k + 1]), ends - sizes, ends))
                lot, size = k + 1, 0
        hidden = np.maximum(pooled - self.model.shift, 0)
        return _logistic(hidden @ self.model.out + self.model.bias)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", id_column: str = "doc_id", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """Train on at most ``rows`` labelled documents, half of each label where
    there are as many, in the order of a hash of the id. Ids are chosen from
    the labels alone; a text that would exceed ``chars`` is left out, the ones
    after it are still taken if they fit, and only taken texts reach the driver."""
    chosen: dict = {}
    for value in (1, 0):
        order = F.xxhash64(F.col(id_column).cast("string"), F.lit(value))
        own = labels.filter(F.col(label) == value).select(id_column, order.alias("h")).distinct()
        for rank, row in enumerate(own.orderBy("h", id_column).limit(rows // 2).collect()):
            chosen.setdefault(row[0], (rank, value))
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k, *v) for k, v in chosen.items()], f"`{id_column}` {labels.schema[id_column].dataType.simpleString()}, rank long, label int")
    got = cut(docs.join(F.broadcast(ids), id_column).select("rank", "label", F.col(text).alias("t")).filter("t is not null").withColumn("rid", F.monotonically_increasing_id()))
    sizes = got.select("rid", "rank", "label", F.length("t").alias("n"), F.xxhash64("t").alias("h")).orderBy("rank", "label", "h", "rid").collect()
    used, taken = 0, []
    for r in sizes:
        if used + r["n"] <= chars:
            used += r["n"]
            taken.append((r["rid"],))
    texts = got.join(F.broadcast(spark.createDataFrame(taken, "rid long")), "rid").orderBy("rank", "label", "t").collect()
    if len({r["label"] for r in texts}) < 2:
        return None
    return train([r["t"] for r in texts], np.array([r["label"] for r in texts]))


def toxicity(df: DataFrame, model: Model | None, text: str = "text", id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score), a map over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [id_column, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.as_py() for t in part.column(len(kept))]
                scores = scorer(texts) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), pa.array(scores.astype(np.float64), pa.float64())], [*kept, "score"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", score double"
    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def language_thresholds(scored: DataFrame, language: str = "lang", label: str = "toxic", least: int = 10, bins: int = 100) -> DataFrame:
    """(language, threshold): the bin edge with the best F1 over labelled
    documents, the middle of the best edges where several tie; ``LIMIT`` for a
    language with fewer than ``least`` toxic ones."""
    binned = scored.filter(F.col(label).isNotNull()).groupBy(language, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.sum(F.col(label).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    sums = binned.groupBy(language).agg(F.sum("bad").alias("total"), F.collect_list(F.struct("bin", "bad", "n")).alias("b"))
    edges = sums.withColumn("edge", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
    above = F.filter("b", lambda x: x["bin"] >= F.col("edge"))
    add = lambda name: F.aggregate(above, F.lit(0).cast("long"), lambda acc, x: acc + x[name])
    marked = F.col("total") + add("n")
    f1 = edges.select(language, "edge", "total", F.when(marked > 0, F.round(2 * add("bad") / marked, 9)).otherwise(0.0).alias("f1"))
    best = f1.groupBy(language).agg(F.max("f1").alias("best"))
    chosen = f1.join(best.withColumnRenamed(language, "__l"), F.col(language).eqNullSafe(F.col("__l")) & (F.col("f1") == F.col("best")))
    return chosen.groupBy(language).agg(F.when(F.max("total") >= least, (F.min("edge") + F.max("edge")) / (2 * bins)).otherwise(LIMIT).alias("threshold"))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str, apart: int | None = None) -> Model | None:
    """The model for the documents of a folder, learnt from its labels; rows
    whose crc32(id) mod 3 is 1 are not learnt from, and with ``apart`` every
    apart-th row by another hash is left for calibration too."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic is not null and doc_id is not null").filter(~held_out("doc_id", 3))
    if apart:
        labels = labels.filter(~calibrates("doc_id", apart))
    return fit(docs, labels)


def calibrates(column: str, apart: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(apart)) == 0


def calibrated(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, kept columns, score, threshold, flagged): the model learns
    from a part of the labelled documents, another part sets the thresholds. An
    id with both labels is toxic."""
    scored = cut(toxicity(docs, fitted(spark, docs, sf_dir, apart=APART), keep=("lang", *keep)))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("toxic is not null").filter(~held_out("doc_id", 3) & calibrates("doc_id", APART)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # a row a language, of those with enough toxic documents; without a broadcast all texts would meet by language
    limits = language_thresholds(scored.select("doc_id", "lang", "score").join(labels, "doc_id")).filter(F.col("threshold") != LIMIT).withColumnRenamed("lang", "__lang")
    out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(LIMIT))).withColumn("flagged", F.col("score") >= F.col("threshold"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = calibrated(spark, table(spark, sf_dir, "documents"), sf_dir)
    return scored.select("doc_id", held_out("doc_id", 3).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "threshold", "flagged")
