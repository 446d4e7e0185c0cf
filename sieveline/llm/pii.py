"""Personal data, with offset-preserving deobfuscation.

Plain identifiers are found in the source text. Then a chain of transducers
(invisible characters dropped, look-alike letters and foreign digits folded to
ASCII, at/dot disguises undone, runs of spelled digits turned into digits)
writes a normalised text together with the source span of each of its
characters; the same detectors run over it, and what they find is mapped back
to source characters. A span is added only where something was rewritten, or
where a plain candidate was dropped, and unless a plain span of its kind
covers it (a disguised letter can leave a plain span within the full one).

All offsets count code points, ends exclusive.

Edge cases: a null text is the empty text and has no spans; rows that repeat
give a row each; columns beside the id and the text are not read. Of added
spans of a kind that overlap, the one that starts first stays, of those the
shortest. The work is in proportion to the length of a text: every search is
bounded or meets each character a fixed number of times (an address spelled
out with more than ten parts on a side is not looked for).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A phone number that ends where its groups do, tried where the greedy one is too long.
GROUPED_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])")


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end, "ip"
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.start(), m.end(), "phone"


def _joined(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def base_spans(text: str) -> list[Span]:
    return _joined([*emails(text), *ips(text), *cards(text), *phones(text)])


# --- transducers -----------------------------------------------------------

#: Letters that look like an ASCII letter (Cyrillic, then Greek).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "ս": "u", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "З": "3",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ſ": "s", "。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
#: Spaces other than U+0020, and characters that do not show.
LOOKALIKES |= dict.fromkeys(map(chr, (0xA0, 0x2007, 0x2009, 0x202F, 0x3000)), " ")
INVISIBLE = frozenset(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
#: Spelled digits of the corpus's languages.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
AT, DOT, DASH, PLUS = r"(?:at|arroba|ät|chez)", r"(?:dot|punto|punkt|point)", r"(?:dash|minus|hyphen)", "plus"
#: An item of a run of spelled digits: a digit, dot, dash, plus or plain digits; what may stand between two items.
ITEM = re.compile(rf"(?<!\w)(?:({DIGIT})|({DOT})|({DASH})|({PLUS})|([0-9]+))(?!\w)", re.I)
GAP = re.compile(r"[\x20,-]+")
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
BRACKETED = re.compile(rf"{OPEN}\s*+(?:({AT}|@)|({DOT}|\.))\s*+{SHUT}", re.I)
#: Spaced words: a local part, at, labels joined by dot, each of at most ten parts, which bounds the search at each place.
SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:\.|\s++{DOT}\s++)[A-Za-z0-9_%+-]++){{0,9}}(\s++{AT}\s++|\s*+@\s*+)[A-Za-z0-9-]++(?:(?:\.|\s++{DOT}\s++)[A-Za-z0-9-]++){{0,8}}\s++{DOT}\s++[A-Za-z]{{2,4}}(?![A-Za-z0-9-])", re.I)
#: Four numbers joined by dot words, and no more than four.
WORDED_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:\s++{DOT}\s++[0-9]{{1,3}}){{3}}(?!\w|\.[0-9]|\s++{DOT}\s++[0-9])", re.I)
SPACED_PART = re.compile(rf"\s+{AT}\s+|\s*@\s*|\s+{DOT}\s+", re.I)
WORDED_DOT, FIFTH = re.compile(rf"\s+{DOT}\s+", re.I), re.compile(rf"[0-9]\s+{DOT}\s+\Z", re.I)
DISGUISED = ("dot", "punto", "punkt", "point", "arroba")
FOREIGN = re.compile(r"[^\x00-\xac\xae-\xff]|[\xa0\xb7]")


class Normalised:
    """A text and, for each piece of it, the source span it came from."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.pieces = text, [0], [(0, 0, len(text), len(text), False)]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: disjoint (start, end, replacement) of the present text, in order."""
        if not edits:
            return
        pieces: list[tuple[int, int, int, int, bool]] = []  # start, source start, source end, length, rewritten
        out: list[str] = []
        here = at = 0

        def keep(upto: int) -> None:
            nonlocal here, at
            k = max(0, bisect_right(self.starts, at) - 1)
            while at < upto:
                s, a, b, n, new = self.pieces[k]
                end = min(upto, s + n)
                if end > at:
                    span = (a, b) if new else (a + at - s, a + end - s)
                    pieces.append((here, *span, end - at, new))
                    out.append(self.text[at:end])
                    here, at = here + end - at, end
                k += 1

        for start, end, value in edits:
            keep(start)
            a, b = self.source(start, end)
            pieces.append((here, a, b, len(value), True))
            out.append(value)
            here, at = here + len(value), end
        keep(len(self.text))
        self.text, self.pieces = "".join(out), pieces
        self.starts = [p[0] for p in pieces]

    def _pieces(self, start: int, end: int) -> list[tuple[int, int, int, int, bool]]:
        k = max(0, bisect_right(self.starts, start) - 1)
        while k and self.pieces[k - 1][0] == start:
            k -= 1
        out = []
        while k < len(self.pieces) and self.pieces[k][0] < end:
            if self.pieces[k][0] + self.pieces[k][3] > start:
                out.append(self.pieces[k])
            k += 1
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a non-empty stretch."""
        own = self._pieces(start, end)
        s, a, b, n, new = own[0]
        first = a if new else a + start - s
        s, a, b, n, new = own[-1]
        return first, b if new else a + end - s

    def rewritten(self, start: int, end: int) -> bool:
        return any(p[4] for p in self._pieces(start, end))


def _folded(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in FOREIGN.finditer(text):
        c = m[0]
        if c in INVISIBLE:
            edits.append((m.start(), m.end(), ""))
        elif c in LOOKALIKES:
            edits.append((m.start(), m.end(), LOOKALIKES[c]))
        elif "！" <= c <= "～":  # full-width forms stand 0xFEE0 above ASCII
            edits.append((m.start(), m.end(), chr(ord(c) - 0xFEE0)))
        elif c.isdecimal():
            edits.append((m.start(), m.end(), str(int(c))))
    return edits


def _undisguised(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for m in BRACKETED.finditer(text):  # white space around goes too
        start, end = m.span()
        while start and text[start - 1].isspace() and (not edits or start > edits[-1][1]):
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        edits.append((start, end, "@" if m[1] else "."))
    for m in WORDED_IP.finditer(text):
        # a number before would make it five; brackets and white space end a run
        if all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])) and not FIFTH.search(text, max(0, m.start() - 40), m.start()):
            edits += [(d.start(), d.end(), ".") for d in WORDED_DOT.finditer(text, m.start(), m.end())]
    edits.sort()
    taken, n = [e[0] for e in edits], len(edits)
    for m in SPACED.finditer(text):
        for part in SPACED_PART.finditer(text, m.start(), m.end()):
            k = bisect_right(taken, part.start())
            if (not k or edits[k - 1][1] <= part.start()) and (k == n or taken[k] >= part.end()):
                edits.append((part.start(), part.end(), "@" if "@" in part[0] or re.fullmatch(AT, part[0].strip(), re.I) else "."))
    return sorted(edits)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of at least three spelled digits, not all the same one, with dots
    and dashes between them, a leading plus and plain digits."""
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        while run and (run[-1][2] or run[-1][3] or run[-1][4]):
            run.pop()
        said = [m[1].lower() for m in run if m[1]]
        if len(said) >= 3 and len(set(said)) >= 2:
            value = [SPELLED[m[1].lower()] if m[1] else "." if m[2] else "-" if m[3] else "+" if m[4] else m[5] for m in run]
            edits.append((run[0].start(), run[-1].end(), "".join(value)))
        run.clear()

    for m in ITEM.finditer(text):
        if run and not ((gap := GAP.match(text, run[-1].end())) and gap.end() == m.start()):
            close()
        joint = bool(m[2] or m[3])
        if m[4] or joint and run and not (run[-1][1] or run[-1][5]):
            close()
        if run or not joint:  # dots and dashes only join
            run.append(m)
    close()
    return edits


#: Digits without a plus that were spelled out and are as many as in a phone number.
BARE = re.compile(r"(?<![0-9.+-])[0-9]{9,15}(?![0-9.-])")


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the transducers bring to light beside the plain spans."""
    low = text.lower()
    foreign = not text.isascii() and FOREIGN.search(text)
    worded = any(w in low for w in DISGUISED) or any(c in text for c in "[({<") and BRACKETED.search(text)
    spelled = len(SPELLED.keys() & set(low.replace(",", " ").replace("-", " ").replace(".", " ").split())) >= 2
    out: list[Span] = []
    if foreign or worded or spelled:
        view = Normalised(text)
        if foreign:
            view.rewrite(_folded(view.text))
        if foreign or worded:
            view.rewrite(_undisguised(view.text))
        if foreign or spelled:
            view.rewrite(_spelled(view.text))
        found = base_spans(view.text)
        found += [(m.start(), m.end(), "phone") for m in BARE.finditer(view.text) if len(set(m[0])) >= 4 and (len(m[0]) < 12 or not luhn(m[0]))]
        for start, end, kind in found:
            if view.rewritten(start, end):
                out.append((*view.source(start, end), kind))
    for m in PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) > 15 and (n := GROUPED_PHONE.match(text, m.start())) and 9 <= sum(c.isdigit() for c in n[0]) <= 15:
            out.append((n.start(), n.end(), "phone"))
    free: list[Span] = []
    reach = {kind: ([], []) for kind in KINDS}  # starts of plain spans, how far they and the earlier ones reach
    for a, b, kind in base:
        starts, ends = reach[kind]
        starts.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    last = dict.fromkeys(KINDS, 0)
    for start, end, kind in sorted(set(out)):
        k = bisect_right(reach[kind][0], start)
        if not (k and reach[kind][1][k - 1] >= end) and start >= last[kind]:
            free.append((start, end, kind))
            last[kind] = end
    return free


def _text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, base, spans): arrays of (start, end, kind), a map over Arrow batches."""
    kind = df.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                own = base_spans(t)
                base.append(own)
                spans.append(_joined(own + added_spans(t, own)))
            columns = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in row] for row in rows], span) for rows in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_column, "base", "spans"])

    struct = "array<struct<start:long,end:long,kind:string>>"
    return df.select(F.col(id_column), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{id_column}` {kind}, base {struct}, spans {struct}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
