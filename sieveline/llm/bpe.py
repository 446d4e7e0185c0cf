"""BPE encoding and decoding by dynamic programming over prefixes.

For a sequence of symbols, byte-pair merging gives every prefix one encoding,
hence one *last token*. That token is the only vocabulary entry that ends at
the prefix, may stand alone or follows a compatible last token of the shorter
prefix. A suffix automaton over the vocabulary yields the entries ending at
each position; back-pointers from the end emit the ids.

The vocabulary file is read once on the driver (its size is fixed) and reaches
the tasks in the closure; a task builds the automaton once per Python worker.

Edge cases: a null text is the empty text; an empty text has no ids and the
empty decoded text. Every row gives one row, repeated ones included, and no
two rows depend on each other. What a worker remembers of words and pairs is
bounded; a text takes memory in proportion to its own length, a long word too.
Only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import struct
import sys
import threading
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import table

#: Fixed values of the format: Unicode white space, and the word pattern.
WHITE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
END = "</w>"
#: Words in one of the two generations that a worker remembers, and bytes of the longest one; pairs of tokens whose compatibility is remembered.
REMEMBERED, LONGEST, PAIRS = 400_000, 64, 2_000_000
FAR = 1 << 60
#: Bytes of text whose words are met together.
TOGETHER = 1 << 21
#: Seconds after which a worker that encodes nothing gives up its encoder.
IDLE = 3


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself for visible
    Latin-1 characters, else the next code points from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class SuffixAutomaton:
    """Of many words: a state per class of substrings with the same ends.
    ending[state] has the words that end there, as (length, id)."""

    def __init__(self, words: list[tuple[tuple[int, ...], int]]) -> None:
        self.link, self.size, self.next = [-1], [0], [{}]
        ends: list[tuple[int, int, int]] = []
        for symbols, ident in words:
            state = 0
            for s in symbols:
                state = self._grow(state, s)
            ends.append((state, len(symbols), ident))
        whole: dict[int, dict[int, int]] = {}
        for _, length, ident in ends:
            state, symbols = 0, words[ident][0]
            for s in symbols:
                state = self.next[state][s]
            whole.setdefault(state, {})[length] = ident
        # for each state, the words that end there, longest first
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            own = tuple(sorted(whole.get(v, {}).items(), reverse=True))
            self.ending[v] = own + self.ending[self.link[v]] if own else self.ending[self.link[v]]

    def _grow(self, last: int, s: int) -> int:
        nexts, link, size = self.next, self.link, self.size
        q = nexts[last].get(s)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, s, q)
        new = len(link)
        link.append(0)
        size.append(size[last] + 1)
        nexts.append({})
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, s, q)
        return new

    def _clone(self, p: int, s: int, q: int) -> int:
        copy = len(self.link)
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(s) == q:
            self.next[p][s] = copy
            p = self.link[p]
        return copy


class Remembered(dict):
    """What f gives for each key; two generations, so that memory is bounded
    and frequent keys stay."""

    def __init__(self, f: Callable[[str], bytes]) -> None:
        self.f, self.old = f, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.f(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key) or self.f(key)
        self[key] = value
        return value


class PrefixEncoder:
    """Encodes texts; vocabulary: the parsed file of a word-end BPE."""

    def __init__(self, vocabulary: dict) -> None:
        model = vocabulary["model"]
        ids: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        self.names = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece, self.white = regex.compile(PIECE), regex.compile(f"[{WHITE}]+")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # tokens are numbered by age: symbols first, then merges as they were learnt
        base = [s + e for e in ("", END) for s in self.letters if s + e in ids]
        self.symbol = {s: k for k, s in enumerate(base)}
        self.inner, self.final = ([self.symbol[x + e] for x in self.letters] for e in ("", END))
        age = dict(self.symbol)
        self.parts: list[tuple[int, int] | None] = [None] * len(base)
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            age.setdefault(a + b, len(self.parts))
            self.pair[age[a], age[b]] = len(self.parts)
            self.parts.append((age[a], age[b]))
        self.ident = [0] * len(self.parts)
        for t, k in age.items():
            self.ident[k] = ids[t]
        self.spelt: list[tuple[int, ...]] = [(k,) for k in range(len(base))]
        for a, b in self.parts[len(base) :]:
            self.spelt.append(self.spelt[a] + self.spelt[b])
        self.right, self.left = self._edges(1), self._edges(0)
        self.compatible: dict[int, bool] = {}
        self.alone = [p is None or self._apart(*p, k) for k, p in enumerate(self.parts)]
        self.automaton = SuffixAutomaton([(s, k) for k, s in enumerate(self.spelt)])
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to str.split() only
        self.known = Remembered(self.ids)
        self.trail: tuple[list[int], list[int], list[int], list[int]] = ([], [-1], [0], [0])

    def _edges(self, side: int) -> list[tuple[int, ...]]:
        """For each token, what stands at its edge as the merges go by."""
        out: list[tuple[int, ...]] = []
        for k, p in enumerate(self.parts):
            out.append((*out[p[side]], k) if p else (k,))
        return out

    def _apart(self, a: int, b: int, but: int = -1) -> bool:
        """Whether no merge ever crosses the border of adjacent a and b,
        apart from the merge ``but`` once both are whole. At any time the
        border lies between an edge of a and an edge of b; a merge across it
        happens if it is older than what either edge does next. Equal merges
        go from left to right."""
        ends, heads = self.right[a], self.left[b]
        i = j = 0
        while True:
            r = ends[i + 1] if i + 1 < len(ends) else FAR
            l = heads[j + 1] if j + 1 < len(heads) else FAR
            c = self.pair.get((ends[i], heads[j]), FAR)
            if c < r and c <= l and not (c == but and r == l == FAR):
                return False
            if r == l == FAR:
                return True
            if r <= l:
                i += 1
            else:
                j += 1

    def tokens(self, symbols: list[int]) -> list[int]:
        """Token ages of a sequence of symbols. Prefixes that the sequence
        shares with the one before have their last tokens already."""
        nexts, links, size, ending = self.automaton.next, self.automaton.link, self.automaton.size, self.automaton.ending
        compatible, spelt = self.compatible, self.spelt
        if len(compatible) > PAIRS:
            compatible.clear()
        before, last, states, lengths = self.trail
        shared = 0
        for a, b in zip(before, symbols):
            if a != b:
                break
            shared += 1
        del last[shared + 1 :], states[shared + 1 :], lengths[shared + 1 :]
        state, length = states[-1], lengths[-1]
        for i in range(shared + 1, len(symbols) + 1):
            s = symbols[i - 1]
            step = nexts[state].get(s)
            while step is None:
                state = links[state]
                length = size[state]
                step = nexts[state].get(s)
            state = step
            length += 1
            for n, t in ending[state]:
                if n < i:
                    if n > length:
                        continue
                    key = last[i - n] << 20 | t
                    ok = compatible.get(key)
                    if ok is None:
                        ok = compatible[key] = self.alone[t] and self._apart(last[i - n], t)
                    if ok:
                        break
                elif n == i == length and self.alone[t]:
                    break
            last.append(t)
            states.append(state)
            lengths.append(length)
        self.trail = (symbols, last, states, lengths) if len(symbols) <= LONGEST else ([], [-1], [0], [0])
        out, i = [], len(symbols)
        while i:
            out.append(last[i])
            i -= len(spelt[last[i]])
        return out[::-1]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece as little-endian words."""
        raw = piece.encode()
        symbols = [*map(self.inner.__getitem__, raw)]
        symbols[-1] = self.final[raw[-1]]
        ids = [*map(self.ident.__getitem__, self.tokens(symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, word: str) -> bytes:
        """The same for a lower-case word between white space, of one piece or more."""
        return b"".join(map(self.piece_ids, self.piece.findall(word)))

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [w for w in self.white.split(text) if w] if self.odd.search(text) else text.split()

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text, ids as little-endian unsigned 32-bit words and the
        decoded text. New words are met in order, so that they share prefixes."""
        cut = [self.cut.split(t or "") if self.cut else [t or ""] for t in texts]
        words = [[self._words(p) for p in parts[::2]] for parts in cut]
        known, rows = self.known, []
        for word in sorted({w for parts in words for p in parts for w in p if w not in known}):
            known[word]
        for parts, plain in zip(cut, words):
            out = [known[w] for w in plain[0]]
            for special, more in zip(parts[1::2], plain[1:]):
                out.append(struct.pack("<I", self.special[special]))
                out += [known[w] for w in more]
            raw = b"".join(out)
            rows.append((raw, self.decode(np.frombuffer(raw, "<u4").tolist())))
        return rows

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_made: dict[str, PrefixEncoder] = {}
_rest: list[threading.Timer] = []


def _encoder(raw: str) -> PrefixEncoder:
    """The encoder of a vocabulary, which tasks of a worker share."""
    while _rest:
        _rest.pop().cancel()
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = PrefixEncoder(json.loads(raw))
    return _made[key]


def _forget() -> None:
    _made.clear()
    gc.collect()  # an encoder and its words refer to each other
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)  # what is free goes back to the system


def _done(encoder: PrefixEncoder) -> None:
    """After a task: words are forgotten, and the encoder too if no other task
    follows soon, as the worker may go on to other work."""
    encoder.known.forget()
    _rest.append(threading.Timer(IDLE, _forget))
    _rest[-1].daemon = True
    _rest[-1].start()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``TOGETHER`` bytes of text, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + TOGETHER, "right")))
        yield batch.slice(at, to - at)
        at = to


def bpe_encode(df: DataFrame, vocabulary_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of df: the id, ids array<int>, decoded string.

    Runs as a map over Arrow batches: no shuffle, and each batch is bounded."""
    return _run(df, vocabulary_path, text, id_column, False)


def bpe_digests(df: DataFrame, vocabulary_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of df: the id, n_tokens, ids_sha256, decoded_sha256."""
    return _run(df, vocabulary_path, text, id_column, True)


def _run(df: DataFrame, vocabulary_path: str, text: str, id_column: str, digests: bool) -> DataFrame:
    with open(vocabulary_path, encoding="utf-8") as file:
        raw = file.read()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(raw)
    field = df.schema[id_column]
    kind = field.dataType.simpleString()
    schema = f"`{id_column}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _slices(batch):
                rows = encoder.encode_all(part.column(1).to_pylist())
                if digests:
                    columns = [
                        pa.array([len(b) // 4 for b, _ in rows], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b, _ in rows], pa.string()),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows], pa.string()),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [pa.array([list(struct.unpack(f"<{len(b) // 4}I", b)) for b, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_column, *names])
        _done(encoder)

    return df.select(F.col(id_column), F.col(text).cast("string").alias("__text")).mapInArrow(encode, schema)


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
