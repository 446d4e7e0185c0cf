"""Secret scans with a battery of randomness tests, in SQL functions only.

Plain rules find assignments, access keys and long hexadecimal runs. Beside
them, every run of 20 or more characters of a base-64 kind that holds a letter
is a candidate: its encoding is inferred (hex, base 32, upper-case, base 64)
and three tests ask whether it could be random over that alphabet: chi-squared
uniformity, runs above and below the middle, and serial correlation. Their
p-values are combined (Fisher); the result is the candidate's score.

False discoveries are controlled over the table, in two steps. Two fixed models
say how often a class (encoding, length, number of separate runs of digits) is
met with at least some score: keys, random over an alphabet, and text, which is
words and now and then numbers, joined. A class reports at all from the least
score at which text is at most ``FDR`` of what is reported, were one candidate
in ``1 / PRIOR`` a key; ``LIMITS`` holds those scores, and ``limits()`` derives
them. Then each candidate has a p-value: how often a string that is text is as
much like a key (``AS_SURE``, by ``tails()``), and one if its class does not report its score.
Within each class of lengths the p-values of all candidates of the table pass
the step-up rule of Benjamini and Hochberg at ``FDR``. So the rarer keys are
among the candidates, the surer they must be. Adding a key that is reported
never removes a span; adding candidates that are not reported may.

All offsets count code points, ends exclusive. A scan writes the spans and
candidates of each document; how many candidates each cell (class and bin of
scores; at most ``CELLS``) has is all that is shuffled and reaches the driver;
a second step reads what was written.

Edge cases: a null text is the empty text and has no spans; repeated rows
give a row each; a run without letters is a number and no candidate; spans
that start together come in the order of the kinds; only the two named columns
are read, whatever others are called. A candidate is tested whole, however
long it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from operator import add
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: (what it may hold, its alphabet in order).
ENCODINGS = [
    ("^[0-9a-fA-F]+$", DIGITS + "abcdef"),
    ("^[A-Z2-7=]+$", UPPER + "234567"),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[a-z]+$", LOWER),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("", UPPER + LOWER + DIGITS + "+/"),
]
LENGTHS, SHORTEST, RUNS = (24, 32, 48, 80), 20, 4  # where classes of lengths end; classes of runs of digits
#: The share of text among what is reported, the share of keys among candidates, and the scores from which a class may report.
FDR, PRIOR, SCORES = 0.05, 0.1, (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
NEVER = 2
#: Per mille of letters in Latin-letter text of European languages, a to z, and of words by length from 1 on.
LETTERS = (82, 14, 30, 42, 145, 13, 17, 33, 75, 3, 7, 42, 25, 72, 62, 22, 6, 66, 67, 69, 36, 13, 12, 3, 11, 3)
WORD_LENGTHS = (20, 150, 170, 160, 130, 100, 80, 60, 50, 40, 20, 20)
#: Fixed values, as limits() returns them (2: never): for each encoding, by class of length, then by runs of digits (none, one, two, more).
LIMITS: list[list[list[float]]] = [
    [[2, 2, 0.001, 0.001], [2, 2, 0.001, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001]],
    [[2, 2, 0.001, 0.001], [2, 2, 0.001, 0.001], [2, 2, 0.001, 0.001], [2, 2, 0.5, 0.001], [2, 2, 2, 0.001]],
    [[2, 2, 0.7, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001]],
    [[2, 2, 2, 2], [2, 2, 2, 2], [2, 2, 2, 2], [0.7, 2, 2, 2], [0.005, 2, 2, 2]],
    [[2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001]],
    [[2, 2, 2, 2], [2, 2, 2, 2], [0.7, 2, 2, 2], [0.05, 2, 2, 2], [0.001, 2, 2, 2]],
    [[2, 2, 0.5, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001], [2, 2, 2, 0.001]],
    [[2, 0.9, 0.001, 0.001], [0.9, 0.5, 0.001, 0.001], [0.3, 0.05, 0.001, 0.001], [2, 0.001, 0.001, 0.001], [2, 2, 2, 0.001]],
]
BINS = len(SCORES) + 1
CELLS = len(ENCODINGS) * (len(LENGTHS) + 1) * RUNS * BINS
#: Fixed values, as tails() returns them: of TEXTS strings of text of a length, how many are as much like a key, by (encoding,
#: class of length, runs of digits) for each bin of scores from the limit on.
TEXTS = 200_000
AS_SURE: dict[tuple[int, int, int], list[int]] = {(e, l, 3): [0] * len(SCORES) for e in (0, 1, 2, 4, 6, 7) for l in range(len(LENGTHS) + 1)} | {
    (0, 0, 2): [31] * 12,
    (0, 1, 2): [101] * 12,
    (1, 0, 2): [31, 30, 30, 27, 26, 23, 14, 12, 8, 6, 3, 3],
    (1, 1, 2): [90, 87, 84, 80, 78, 65, 61, 42, 40, 35, 20, 16],
    (1, 2, 2): [160, 158, 156, 154, 151, 140, 137, 30, 28, 7, 7, 7],
    (1, 3, 2): [524, 524, 524],
    (2, 0, 2): [329, 312],
    (3, 3, 0): [1224, 298],
    (3, 4, 0): [1068, 809, 589, 337, 194, 111, 78, 23, 7, 2],
    (5, 2, 0): [507, 129],
    (5, 3, 0): [856, 524, 195, 85, 18, 5, 2],
    (5, 4, 0): [51, 36, 12, 4, 2, 1, 0, 0, 0, 0, 0, 0],
    (6, 0, 2): [302, 244, 163],
    (7, 0, 1): [92],
    (7, 0, 2): [83, 74, 58, 52, 47, 37, 21, 1, 1, 0, 0, 0],
    (7, 1, 0): [101],
    (7, 1, 1): [101, 72, 48],
    (7, 1, 2): [68, 52, 46, 27, 12, 6, 2, 1, 1, 0, 0, 0],
    (7, 2, 0): [144, 28, 28, 28],
    (7, 2, 1): [517, 511, 143, 31, 18, 7, 7],
    (7, 2, 2): [17, 12, 7, 2, 1, 1, 1, 0, 0, 0, 0, 0],
    (7, 3, 1): [195] * 12,
    (7, 3, 2): [86, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18, 18],
}
SPAN = "array<struct<start:int,end:int,found:string>>"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as (start, end, found), in order. The text between
    matches and the matches themselves add up to the offsets."""
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("n")))
    add = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("found")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    all_ = F.aggregate(F.filter(found, lambda x: x["m"].isNotNull()), start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(SPAN))


def _p(z: Column) -> Column:
    """Two-sided normal tail, by a logistic fit good to 2e-4."""
    a = F.abs(z)
    return F.greatest(2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a)), F.lit(1e-12))


def randomness(found: Column) -> Column:
    """The combined p-value of the three tests for a candidate string."""
    s = F.regexp_replace(found, "[=_-]+", "")
    alphabet = F.lit(ENCODINGS[-1][1])
    for rule, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(s.rlike(rule), F.lit(letters)).otherwise(alphabet)
    size = F.length(alphabet).cast("double")
    plain = F.when(size == 16, F.lower(s)).otherwise(s)
    one = F.array(F.struct(plain.alias("s"), alphabet.alias("a"), size.alias("k"), F.length(plain).cast("double").alias("n"), F.split(plain, "").alias("c")))
    # arrays of one element name an expression, so that it is computed once
    two = F.transform(one, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["n"].alias("n"), F.array_distinct(x["c"]).alias("kinds"), F.transform(x["c"], lambda c: F.instr(x["a"], c).cast("double") - 1).alias("v")))
    three = F.transform(
        two,
        lambda x: F.struct(
            x["k"].alias("k"),
            x["n"].alias("n"),
            x["v"].alias("v"),
            F.aggregate(x["kinds"], F.lit(0.0), lambda acc, c: acc + F.pow(x["n"] - F.length(F.replace(x["s"], c, F.lit(""))), F.lit(2))).alias("squares"),
            (F.aggregate(x["v"], F.lit(0.0), lambda acc, v: acc + v) / x["n"]).alias("mean"),
            F.transform(x["v"], lambda v: (v >= x["k"] / 2).cast("int")).alias("high"),
        ),
    )
    pairs = lambda a, f: F.aggregate(F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), f), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    four = F.transform(
        three,
        lambda x: F.struct(
            x["k"].alias("k"),
            x["n"].alias("n"),
            (x["k"] / x["n"] * x["squares"] - x["n"]).alias("chi"),
            (pairs(x["high"], lambda a, b: (a != b).cast("double")) + 1).alias("runs"),
            F.aggregate(x["high"], F.lit(0.0), lambda acc, v: acc + v).alias("ups"),
            pairs(x["v"], lambda a, b: (a - x["mean"]) * (b - x["mean"])).alias("along"),
            F.aggregate(x["v"], F.lit(0.0), lambda acc, v: acc + (v - x["mean"]) * (v - x["mean"])).alias("own"),
        ),
    )

    def combined(x: Column) -> Column:
        k, n = x["k"], x["n"]
        p1 = _p(F.greatest((x["chi"] - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)), F.lit(0.0)))
        expected = 2 * x["ups"] * (n - x["ups"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        p2 = F.when(spread > 0, _p((x["runs"] - expected) / F.sqrt(spread))).otherwise(1e-12)
        p3 = F.when(x["own"] > 0, _p(x["along"] / x["own"] * F.sqrt(n))).otherwise(1e-12)
        half = -(F.log(p1) + F.log(p2) + F.log(p3))
        return F.when(n < 8, F.lit(0.0)).otherwise(F.exp(-half) * (1 + half + half * half / 2))

    return F.element_at(F.transform(four, combined), 1)


def _class(length: Column) -> Column:
    out = F.lit(0)
    for n in LENGTHS:
        out = out + (length >= n).cast("int")
    return out


def _classes(found: Column) -> list[Column]:
    """Encoding, class of length and runs of digits of a candidate, from 0 on."""
    s = F.regexp_replace(found, "[=_-]+", "")
    encoding = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(s.rlike(ENCODINGS[k][0]), F.lit(k)).otherwise(encoding)
    return [encoding, _class(F.length(found)), F.least(F.regexp_count(s, F.lit("[0-9]+")), F.lit(RUNS - 1))]


def _cell(found: Column) -> Column:
    """Encoding, class of length, runs of digits and bin of scores of a
    candidate, as one number."""
    e, l, d = _classes(found)
    bin_ = F.element_at(F.transform(F.array(randomness(found)), lambda p: reduce(add, ((p >= x).cast("int") for x in SCORES))), 1)
    return ((e * (len(LENGTHS) + 1) + l) * RUNS + d) * BINS + bin_


def _parts(cell: int) -> tuple[int, int, int, int]:
    rest, b = divmod(cell, BINS)
    rest, d = divmod(rest, RUNS)
    return *divmod(rest, len(LENGTHS) + 1), d, b


def p_value(cell: int) -> float:
    """How often text is as much like a key as a candidate of this cell; one if
    its class does not report its score."""
    *class_, b = _parts(cell)
    sure = AS_SURE.get(tuple(class_), [])
    return (sure[b - BINS] + 1) / (TEXTS + 1) if BINS - b <= len(sure) else 1.0


def reported(counts: Mapping[int, int]) -> list[int]:
    """The cells that are reported where these have so many candidates: the
    step-up rule within each class of lengths. Candidates of a cell are ties."""
    out = []
    for l in range(len(LENGTHS) + 1):
        own = sorted((p_value(cell), n, cell) for cell, n in counts.items() if _parts(cell)[1] == l)
        total, met, limit = sum(n for _, n, _ in own), 0, 0.0
        for p, n, _ in own:
            met += n
            if p * total <= FDR * met:
                limit = p
        out += [cell for p, _, cell in own if p <= limit]
    return sorted(out)


def text_strings(length: int, n: int, seed: int) -> Iterator[str]:
    """Strings that text may give: words in one of four ways of writing, joined
    by one mark or none, and in one of four a number or two between them."""
    rng = Random(f"{seed} {length}")
    letters, lengths = [chr(97 + k) for k in range(26)], range(1, len(WORD_LENGTHS) + 1)
    for _ in range(n):
        write = rng.choices([str, str.title, str.upper, lambda w: w if rng.random() < 0.8 else w.title()], [50, 25, 10, 15])[0]
        mark = rng.choices(["", "_", "-", "/", "+"], [50, 15, 20, 13, 2])[0]
        numbers = {rng.randrange(8) for _ in range(rng.choices([0, 1, 2], [75, 19, 6])[0])}
        parts: list[str] = []
        while sum(map(len, parts)) + len(mark) * len(parts) < length:
            if len(parts) in numbers:
                parts.append(str(rng.randrange(10 ** rng.randrange(1, 5))))
            parts.append(write("".join(rng.choices(letters, LETTERS, k=rng.choices(lengths, WORD_LENGTHS)[0]))))
        yield mark.join(parts)[:length]


def limits(spark: SparkSession, n: int = 100_000, seed: int = 0) -> list[list[list[float]]]:
    """LIMITS, from n strings of text and n / 10 keys of each encoding at the
    shortest length of each class."""
    rows = []
    for length in (SHORTEST, *LENGTHS):
        rng = Random(f"{seed} keys {length}")
        rows += [(s, -1) for s in text_strings(length, n, seed)]
        rows += [("".join(rng.choices(alphabet, k=length)), k) for k, (_, alphabet) in enumerate(ENCODINGS) for _ in range(n // 10)]
    bins = sum((F.col("p") >= x).cast("int") for x in SCORES)
    tested = spark.createDataFrame(rows, "s string, made int").filter(F.col("s").rlike("[A-Za-z]")).select("made", *(c.alias(a) for c, a in zip(_classes(F.col("s")), "eld")), randomness(F.col("s")).alias("p"))
    counts = {tuple(r)[:5]: r["n"] for r in tested.groupBy("made", "e", "l", "d", bins.alias("b")).agg(F.count("*").alias("n")).collect()}

    def least(e: int, l: int, d: int) -> float:
        for k, score in enumerate(SCORES):
            share = lambda made, total: sum(counts.get((made, e, l, d, b), 0) for b in range(k + 1, len(SCORES) + 1)) / total
            keys, text = share(e, n // 10), share(-1, n) + 1 / n  # one more than was met
            if keys and (1 - PRIOR) * text <= FDR * ((1 - PRIOR) * text + PRIOR * keys):
                return score
        return NEVER

    return [[[least(e, l, d) for d in range(RUNS)] for l in range(len(LENGTHS) + 1)] for e in range(len(ENCODINGS))]


def tails(spark: SparkSession, n: int = TEXTS, seed: int = 1) -> dict[tuple[int, int, int], list[int]]:
    """AS_SURE, from n strings of text at the shortest length of each class and
    n / 100 keys of each encoding. What is more like a key has more keys to its
    text; a higher score in a class never has fewer."""
    lots, lengths = 100, (SHORTEST, *LENGTHS)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in (k for batch in batches for k in batch["id"]):
            for length in lengths:
                rng = Random(f"{seed} keys {length} {lot}")
                rows = [(x, False) for x in text_strings(length, n // lots, (seed << 32) + lot)]
                yield pd.DataFrame(rows + [("".join(rng.choices(alphabet, k=length)), True) for _, alphabet in ENCODINGS for _ in range(n // lots // 100)], columns=["s", "key"])

    strings = spark.range(lots, numPartitions=lots).mapInPandas(made, "s string, key boolean").filter(F.col("s").rlike("[A-Za-z]"))
    counts = {(r["key"], r["cell"]): r["count"] for r in strings.groupBy("key", _cell(F.col("s")).alias("cell")).count().collect()}
    out: dict[tuple[int, int, int], list[int]] = {}
    for l in range(len(lengths)):
        ranked = []
        for e, d in ((e, d) for e in range(len(ENCODINGS)) for d in range(RUNS) if LIMITS[e][l][d] != NEVER):
            least, first = float("inf"), SCORES.index(LIMITS[e][l][d]) + 1
            cells = [((e * len(lengths) + l) * RUNS + d) * BINS + b for b in range(BINS)]
            for b in range(first, BINS):
                text, keys = (sum(counts.get((key, c), 0) for c in cells[b:]) for key in (False, True))
                least = min(least, (text + 1) / keys if keys else least)
                ranked.append((least, e, d, b, counts.get((False, cells[b]), 0)))
        for least, e, d, _, _ in sorted(ranked, key=lambda x: x[1:4]):
            out.setdefault((e, l, d), []).append(sum(x[4] for x in ranked if x[0] <= least))
    return out


def scan_secrets(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, base, spans): base array<(start, end, kind)> by the plain rules,
    spans with those that the battery adds under control of false discoveries
    over df, both by start, then kind."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = lambda a, k: F.transform(a, lambda x: F.struct(x["start"], F.lit(k).alias("rank"), x["end"]))
    assigned = F.filter(located(F.col("__t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 1)) >= 6)
    base = F.array_sort(F.concat(named(assigned, 0), named(located(F.col("__t"), ACCESS), 1), named(located(F.col("__t"), HEX), 2)))
    apart = F.filter(located(F.col("__t"), CANDIDATE), lambda c: c["found"].rlike("[A-Za-z]") & ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    scored = F.transform(apart, lambda c: F.struct(c["start"], c["end"], _cell(c["found"]).alias("cell")))
    found = cut(df.select(F.col(id_column), t.alias("__t")).withColumn("__base", base).select(id_column, "__base", scored.alias("__tested")))
    counts = found.select(F.explode("__tested.cell").alias("cell")).groupBy("cell").count().collect()  # CELLS at most
    sure = F.array(*map(F.lit, reported({r["cell"]: r["count"] for r in counts}))).cast("array<int>")
    new = F.filter("__tested", lambda c: F.array_contains(sure, c["cell"]))
    spans = F.array_sort(F.concat("__base", F.transform(new, lambda c: F.struct(c["start"], F.lit(3).alias("rank"), c["end"]))))
    told = lambda a: F.transform(a, lambda x: F.struct(x["start"], x["end"], F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1).alias("kind")))
    return found.select(id_column, told(F.col("__base")).alias("base"), told(spans).alias("spans"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
