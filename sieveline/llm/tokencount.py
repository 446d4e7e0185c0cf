"""Token counts from distinct pre-tokens, without ids.

A tokenizer first cuts a text into pre-tokens; how many pieces each becomes
depends on it alone. So the pieces of every distinct pre-token are counted
once, joined to the pre-token frequencies of the documents, and summed.

How it runs: a map cuts texts and puts documents of about ``CHUNK`` characters
together. A chunk numbers its distinct pre-tokens (the frequent ones first);
each document of it is a sparse vector of (number, frequency), packed into
bytes. Both are written to the shared folder. The pre-tokens of all chunks are
dealt by their spelling and sorted, so that equal ones follow each other and
are counted once; numbers and pieces go back to the chunk, packed again, where
vectors meet them in a cogroup. A pre-token crosses the network once a chunk
instead of once a document, no key has more rows than there are chunks, and a
cogroup is bounded by the chunk.

Equality with the library: a word of Latin letters between spaces is one
pre-token with the space before it, and the marks after it are another; all
else is cut by the library itself, and pieces are counted by its model.
Strings of special tokens are one token each, as the library's default has it.
Texts of more than ``PIECE`` characters are cut between a word and white
space, which no pre-token and no special token crosses, and their parts are
summed.

Edge cases: a null or empty text has no bytes and no tokens; repeated rows give
a row each; an empty table has no rows; only the two named columns are read,
whatever others are called.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import byte_letters
from sieveline.llm.common import cut, table

#: Characters of a chunk and of a piece of a text; words whose pre-tokens a worker remembers, and the longest of them.
CHUNK, PIECE, REMEMBERED, LONGEST = 1 << 25, 1 << 22, 100_000, 64
#: Counted pre-tokens that a task holds before it passes them on.
HELD = 1 << 20
LIMIT = 1024
#: Latin letters of any kind, then marks that are neither letters, numbers nor white space.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
WHITE = re.compile(r"(?<=\S)\s")

_made: dict[str, "PreTokens"] = {}


class PreTokens:
    """Cuts texts by the tokenizer of a file, and counts pieces."""

    def __init__(self, raw: str) -> None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(raw)
        self.cut, self.model = own.pre_tokenizer.pre_tokenize_str, own.model
        added = json.loads(raw)["added_tokens"]
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        self.known: dict[str, list[str]] = {}
        self.letters = byte_letters()

    def _word(self, word: str) -> list[str]:
        found = self.known.get(word)
        if found is None:
            found = [word[a:b] for _, (a, b) in self.cut(word)]
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def frequencies(self, text: str) -> tuple[Counter[str], int]:
        """Frequencies of the pre-tokens of a text, and its special tokens."""
        out: Counter[str] = Counter()
        parts = self.special.split(text) if self.special else [text]
        for part in parts[::2]:
            first, *words = part.split(" ")
            known = [(SIMPLE.fullmatch(w), w, n) for w, n in Counter(words).items()]
            odd = [(w, n) for m, w, n in known if not m]
            # a word between spaces is cut by itself, unless white space touches the spaces
            if first[-1:].isspace() or not all(w and not w[0].isspace() and not w[-1].isspace() for w, _ in odd):
                out.update(part[a:b] for _, (a, b) in self.cut(part))
                continue
            out.update(self._word(first) if first else ())
            for m, _, n in known:
                if m:
                    word, marks = m.groups()
                    out[" " + word] += n
                    if marks:
                        out[marks] += n
            for word, n in odd:
                for x in self._word(" " + word):
                    out[x] += n
        return out, len(parts) // 2

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))


def _tokens(raw: str) -> PreTokens:
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = PreTokens(raw)
    return _made[key]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * PIECE and (m := WHITE.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """A sparse vector: steps between sorted numbers and times, as planes of bytes."""
    order = np.argsort(numbers)
    both = np.concatenate([np.diff(numbers[order], prepend=0), times[order]]).astype("<u4")
    return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
    steps, times = np.split(both, 2)
    return np.cumsum(steps), times


class _Chunk:
    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.names: dict[str, int] = {}
        self.rows: list[tuple] = []

    def add(self, row: int, ident: object, n_bytes: int, special: int, times: Counter[str], size: int) -> None:
        names = self.names
        own = np.fromiter((names.setdefault(x, len(names)) for x in times), np.int32, len(times))
        self.rows.append((row, ident, n_bytes, special, own, np.fromiter(times.values(), np.int32, len(times))))
        self.size += size

    def batches(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one with all pre-tokens."""
        held = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r[4] for r in self.rows)]), minlength=len(self.names))
        order = np.argsort(-held, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        columns = [pa.array([r[0] for r in self.rows], pa.int64()), pa.array([r[1] for r in self.rows], kind), *(pa.array([r[k] for r in self.rows], pa.int64()) for k in (2, 3)), pa.array([packed(number[r[4]], r[5]) for r in self.rows], pa.binary())]
        names, n = ["chunk", "row", "id", "n_bytes", "special", "vector", "pre_tokens"], len(self.rows)
        yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), *columns, pa.nulls(n, pa.list_(pa.string()))], names)
        spelt = list(self.names)
        nothing = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *nothing, pa.array([[spelt[k] for k in order]], pa.list_(pa.string()))], names)


def _by_chunk(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    chunk, number, pieces = map(np.concatenate, zip(*held))
    order = np.argsort(chunk, kind="stable")
    own, starts = np.unique(chunk[order], return_index=True)
    rows = [packed(number[k], pieces[k]) for k in np.split(order, starts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.binary())], ["chunk", "counted"])


def token_counts(df: DataFrame, vocabulary_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of df."""
    with open(vocabulary_path, encoding="utf-8") as file:
        raw = file.read()  # a vocabulary has a fixed size
    shared = df.sparkSession.sparkContext.broadcast(raw)
    kind = df.schema[id_column].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = _tokens(shared.value), TaskContext.get().partitionId() << 32
        row, chunk, id_type = base, _Chunk(base), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for ident, t in zip(batch.column(0), batch.column(1)):
                for part in _parts(t.as_py() or ""):
                    times, special = tokens.frequencies(part)
                    chunk.add(row, ident.as_py(), len(part.encode()), special, times, len(part))
                    if chunk.size >= CHUNK:
                        yield from chunk.batches(id_type)
                        chunk = _Chunk(chunk.number + 1)
                row += 1
        if chunk.rows:
            yield from chunk.batches(id_type)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last, n, held, size = _tokens(shared.value), None, 0, [], 0
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                if x != last:
                    last, n = x, tokens.pieces(x)
                out.append(n)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(out, np.int64)))
            size += len(out)
            if size >= HELD:
                yield _by_chunk(held)
                held, size = [], 0
        if held:
            yield _by_chunk(held)

    def summed(docs: pa.Table, pieces: pa.Table) -> pa.Table:
        back = [unpacked(raw) for raw in pieces.column("counted").to_pylist()]
        by = np.zeros(sum(len(a) for a, _ in back), np.int64)
        for numbers, n in back:
            by[numbers] = n
        totals = [special + int(by[at] @ times) for special, (at, times) in zip(docs.column("special").to_pylist(), map(unpacked, docs.column("vector").to_pylist()))]
        return pa.table({"row": docs.column("row"), "id": docs.column("id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64())})

    written = cut(df.select(F.col(id_column), F.col(text).cast("string")).mapInArrow(chunks, f"chunk long, row long, id {kind}, n_bytes long, special long, vector binary, pre_tokens array<string>"))
    spelt = written.filter("pre_tokens is not null").select("chunk", F.posexplode("pre_tokens").alias("number", "pre_token"))
    pieces = spelt.repartition("pre_token").sortWithinPartitions("pre_token").mapInArrow(counted, "chunk long, counted binary")
    docs = written.filter("vector is not null").drop("pre_tokens")
    sums = docs.groupBy("chunk").cogroup(pieces.groupBy("chunk")).applyInArrow(summed, f"row long, id {kind}, n_bytes long, n_tokens long")
    return sums.groupBy("row").agg(F.first("id").alias(id_column), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("row")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
