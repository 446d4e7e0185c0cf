"""Spelling variants by full neighbourhood generation.

Words of a vocabulary are near if one code point is inserted, deleted or
replaced between them. Every word emits all its distinct deletions,
replacements and insertions over the letters that the vocabulary holds; an
equi-join with the vocabulary gives the near words, and no distance is ever
computed. A word's form is its most frequent near word, if that is at least
twice as frequent; forms are followed to the last by pointer jumping.

A word of 8 letters has some 800 neighbours, hardly any of them words. So
neighbours are first made as hashes (from those of the word's beginning and
end, in numpy), and only those whose two bits are set in a bitmap of the
vocabulary are spelt out and joined. The bitmap has ``BITS_PER_WORD`` bits a
word and ``MAX_BITS`` bits at most, which bounds what is broadcast; a denser
bitmap lets more neighbours through to the join, and never loses one.

Counting adds up within a task before the shuffle; a word has a bounded number
of near words, so no key is hot in the join. Long words are taken in ranges of
positions, long texts in pieces that end between words.

Edge cases: a null text has no words; a null id is written as the empty text
where ids are; repeated rows count again; ties between forms go to the first
in code-point order; without words the result is empty; only the named columns
are read, whatever others are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table

RUN, BETWEEN = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words have so many code points and occurrences; one of so many (document, run) pairs loses a code point.
MIN_LETTERS, MIN_COUNT, LOSS = 5, 3, 97
#: Words that a task adds up before it passes them on; characters of a long text that are taken at once.
HELD, PIECE = 400_000, 1 << 22
#: The bitmap: bits a word, its smallest and largest size, the size of a segment (powers of two).
BITS_PER_WORD, MIN_BITS, MAX_BITS, SEGMENT = 48, 16, 28, 16
#: Hashes that are made at once; the multipliers of the hash and of its two bits.
BLOCK = 1 << 20
#: Neighbours that are spelt out before they are passed on.
PASSED = 50_000
BASE, MIXERS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
ROUNDS = 6  # counts at least double from form to form, so 63 steps suffice


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * PIECE and (m := BETWEEN.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def runs(text: str, ident: str, loss: int = LOSS) -> Counter[str]:
    """How often each word occurs in a text; of some runs one code point goes."""
    out: Counter[str] = Counter()
    for piece in _pieces(text):
        for run, n in Counter(RUN.findall(piece)).items():
            if len(run) < MIN_LETTERS:
                continue
            word = run.lower() if run.isascii() else run.translate(LOWER)
            h = crc32(f"{ident}:{word}".encode())
            if h % loss == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
                if len(word) < MIN_LETTERS:
                    continue
            out[word] += n
    return out


def vocabulary(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(word, n) of the words of all texts with ``MIN_COUNT`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for ident, t in zip(batch.column(0), batch.column(1)):
                for word, n in runs(t.as_py(), ident.as_py()).items():
                    held[word] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    slim = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((id_column, "i"), (text, "t"))))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, code points as rows of a matrix) of the words of a length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(lengths):
        places = np.nonzero(lengths == size)[0]
        step = max(1, BLOCK // int(size))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), size).astype(np.uint64)


def _ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all beginnings and ends of words of a length, and the powers
    of the base: a hash is the sum of code point times base ** (places after)."""
    n, size = codes.shape
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size + 1, BASE)]))
    head, tail = np.zeros((n, size + 1), np.uint64), np.zeros((n, size + 1), np.uint64)
    for k in range(size):
        head[:, k + 1] = head[:, k] * BASE + codes[:, k]
        tail[:, size - 1 - k] = tail[:, size - k] + codes[:, size - 1 - k] * powers[k]
    return head, tail, powers


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((hashes ^ (hashes >> np.uint64(29))) * m) >> np.uint64(64 - bits) for m in MIXERS]


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(kind, first place, hashes[word, place, letter], whether it counts) of all distinct neighbours of words of a length."""
    n, size = codes.shape
    head, tail, powers = _ends(codes)
    step = max(1, BLOCK // (n * len(alphabet)))
    for at in range(0, size + 1, step):
        i = np.arange(at, min(at + step, size + 1))
        after = powers[size - i]
        # an insertion before an equal letter is the insertion after it
        last = np.concatenate([codes, np.zeros((n, 1), np.uint64)], 1)[:, i, None]
        yield "insert", at, (head[:, i] * (powers[size - i] * BASE) + tail[:, i])[:, :, None] + after[None, :, None] * alphabet[None, None, :], last != alphabet[None, None, :]
        if (i := i[i < size]).size:
            after = powers[size - 1 - i]
            yield "replace", at, (head[:, i] * (after * BASE) + tail[:, i + 1])[:, :, None] + after[None, :, None] * alphabet[None, None, :], codes[:, i, None] != alphabet[None, None, :]
            # of a run of equal letters the last is deleted
            following = np.concatenate([codes, np.zeros((n, 1), np.uint64)], 1)[:, i + 1, None]
            yield "delete", at, (head[:, i] * after + tail[:, i + 1])[:, :, None], following != codes[:, i, None]


def _spelt(word: str, kind: str, i: int, letter: str) -> str:
    return word[:i] + (letter if kind != "delete" else "") + word[i + (kind != "insert") :]


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """The bits that the words set, as bytes: made in segments of a bounded
    number of bits; as many segments reach the driver as the bitmap has."""
    segment = min(bits, SEGMENT)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for _, codes in _by_length(words):
                at = np.unique(np.concatenate(_bits(_ends(codes)[0][:, -1], bits)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(segment)).astype(np.int32)), pa.array((at & np.uint64((1 << segment) - 1)).astype(np.int32))], ["segment", "at"])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << segment, np.uint8)
        flags[frame["at"].to_numpy()] = 1
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros((1 << bits - segment, 1 << segment >> 3), np.uint8)
    for r in words.select("word").mapInArrow(places, "segment int, at int").distinct().groupBy("segment").applyInPandas(packed, "segment int, bits binary").collect():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs of near words, both ways; words: (word, n), read more than once."""
    spark = words.sparkSession
    n, = words.agg(F.count("*")).first()
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint64)  # at most 90
    bits = min(max((BITS_PER_WORD * n).bit_length(), MIN_BITS), MAX_BITS)
    shared = spark.sparkContext.broadcast(_bitmap(words, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, letters = shared.value, [chr(c) for c in alphabet.tolist()]
        own: list[str] = []
        near: list[str] = []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(near, pa.string())], ["word", "near"])
            own.clear()
            near.clear()
            return out

        for batch in batches:
            words = batch.column(0).to_pylist()
            for places, codes in _by_length(words):
                most = max(1, BLOCK // (codes.shape[1] * len(letters)))
                for first in range(0, len(places), most):
                    for kind, at, hashes, counts in neighbours(codes[first : first + most], alphabet):
                        flat = np.nonzero(counts.reshape(-1))[0] if counts.shape == hashes.shape else np.arange(hashes.size)
                        found = hashes.reshape(-1)[flat]
                        for k in range(len(MIXERS)):
                            b = _bits(found, bits)[k]
                            hit = bitmap[b >> np.uint64(3)] >> (np.uint64(7) - (b & np.uint64(7))).astype(np.uint8) & 1 > 0
                            flat, found = flat[hit], found[hit]
                        for w, i, c in zip(*(x.tolist() for x in np.unravel_index(flat, hashes.shape))):
                            word = words[places[first + w]]
                            own.append(word)
                            near.append(_spelt(word, kind, at + i, letters[c]))
                        if len(own) > PASSED:
                            yield told()
        if own:
            yield told()

    if not len(alphabet):
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = words.select("word").repartition(width, "word").mapInArrow(run, "word string, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def group_variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word; words: (word, n)."""
    words = cut(words)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    told = words.join(near, "word", "left")
    good = -F.col("best.order") >= 2 * F.col("n")
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.order")).alias("form_n")))
    links = told.filter("form is not null").select("word", F.col("form").alias("up"))
    for _ in range(ROUNDS):
        links = cut(links.join(links.select(F.col("word").alias("up"), F.col("up").alias("further")), "up", "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if not links.filter("moved").limit(1).count():
            break
        links = links.drop("moved")
    return told.join(links.select("word", "up"), "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH RECURSIVE bits(i, v, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
pair AS (SELECT d, w, count(*) AS n FROM run WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM pair, crc),
word AS (SELECT v AS word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN w[:(h % length(w))] || w[(h % length(w) + 2):] ELSE w END AS v FROM hashed) WHERE length(v) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
gap AS (SELECT word, n, i, word[:(i - 1)] || word[(i + 1):] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gap a JOIN word b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM gap a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY 1),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM word LEFT JOIN best USING (word)),
climb(word, root) AS (SELECT word, word FROM told UNION ALL SELECT c.word, t.form FROM climb c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT word, form, c.root, n, n_near, form_n FROM told JOIN (SELECT c.word, c.root FROM climb c JOIN told t ON t.word = c.root WHERE t.form IS NULL) c USING (word)
"""
