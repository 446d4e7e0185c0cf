"""Main text of web pages, with nearest-URL page differencing.

A page is read into blocks of text. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are furniture by
their elements, roles and class names. If the page marks its article (article,
main or role main), the blocks inside are the text, else all but furniture.

Every page is compared with the nearest pages of its host in the order of URL
paths, furniture included: the blocks of both are aligned by their longest
common subsequence. What is shared tells furniture that no element names, and
is deleted:

* link lists (most of the characters in links), anywhere;
* where no article is marked, other shared blocks that stand before the first
  or after the last block that is the page's own, if they are short and no
  headings, or if all neighbours share them;
* between those, short blocks that two neighbours share.

Shared paragraphs amid a page's own stay: copies of an article, and passages
that articles quote, are text. A neighbour that holds the very same blocks is
a copy of the page and tells nothing; the next one that differs is taken
instead, however many copies lie between. Nor does one that shares most of the
page's long paragraphs tell anything, being another state of the same article.

How it runs: one map reads the pages into blocks, which are written to the
shared folder. Line hashes are sorted by (host, path) with a range shuffle,
consecutive pages of a host with equal lines become one run, and runs are
ranked. Neighbours meet in buckets of ``BUCKET`` consecutive ranks with one
run of overlap at both ends, and what is deleted from a run is deleted from
all its pages: no host is gathered in one task. Only pages from which
something is deleted are joined with what goes.

Edge cases: null html or an empty page gives an empty text; a null url is a
host of its own; rows that repeat give a row each; pages with equal URLs are
neighbours in the order of their rows; broken markup is read as browsers do
(unclosed elements end with their parent, a cut-off tag is dropped). A long
page is read in time in proportion to its length, however deep it nests. Only
the three named columns are read, whatever others are called.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table

BUCKET = 64
#: What is known of a block; words of a short one.
MAIN, FURNITURE, HEADING, LINKS = 1, 2, 4, 8
SHORT = 12
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Bits of a table of an alignment that are held at once.
TABLE = 1 << 26
#: Fixed values of HTML: elements without an end tag, with raw text, that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no text of an article.
DROPPED = frozenset("head nav footer aside form button select datalist menu dialog svg math canvas audio video object applet map".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class names and ids that mark page furniture.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond share sharing social related recommended recommendations widget login search pagination pager toolbar skip".split()
)
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
#: What an opening tag ends, and the elements that this does not look beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>|(/?[a-zA-Z][^>]*)(>?))""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACES = re.compile(r"\s+")  # of Unicode


def _furniture(name: str, attributes: str, within_article: bool) -> bool:
    if name in DROPPED or name == "header" and not within_article:
        return True
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and HINTS & set(re.split(r"[\s_-]+", value)):
            return True
        if key in ("class", "id") and name == "article" and HINTS & set(re.split(r"[\s_-]+", value)) & {"comment", "comments", "reply", "ad", "ads", "advert", "related", "recommended", "sponsored", "promo"}:
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, whether it stands in a marked article) of the blocks that are
    not page furniture, in page order."""
    return [(text, bool(kind & MAIN)) for text, kind in all_blocks(page) if not kind & FURNITURE]


def all_blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of all blocks of a page, in page order."""
    page = page or ""
    out: list[tuple[str, int]] = []
    run: list[tuple[str, bool, bool]] = []  # text, furniture, link
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, article
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    walls: list[int] = []  # places of those that start a block
    inside = (False, False)

    def flush() -> None:
        if not run:
            return
        heading = HEADING if walls and stack[walls[-1]][0] in HEADINGS else 0
        for furniture in (False, True):
            own = [(t, link) for t, dull, link in run if dull is furniture]
            text = SPACES.sub(" ", html.unescape("".join([t for t, _ in own]))).strip() if own else ""
            if text:
                links = sum(len(t) for t, link in own if link)
                kind = heading | (FURNITURE if furniture else 0) | (MAIN if inside[1] and not furniture else 0) | (LINKS if 2 * links > sum(len(t) for t, _ in own) else 0)
                out.append((text, kind))
        run.clear()

    def add(text: str) -> None:
        if text:
            run.append((text, inside[0], bool(places["a"])))

    def pop(to: int) -> None:
        nonlocal inside
        if walls and walls[-1] >= to:
            flush()
        while len(stack) > to:
            places[stack.pop()[0]].pop()
        while walls and walls[-1] >= to:
            walls.pop()
        inside = stack[-1][1:] if stack else (False, False)

    def deepest(names: set[str]) -> int:
        return max((places[x][-1] for x in names if places[x]), default=-1)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1]:  # comment
            end = page.find("-->", m.end() - 2)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        if m[7] is not None:  # quotes that do not match, or the page ends in the tag
            if not m[8]:
                break
            head = re.match(r"(/?)([a-zA-Z][^\s/>]*)(.*)", m[7], re.S)
            closing, name, attributes = head[1], head[2].lower(), head[3]
        else:
            closing, name, attributes = m[3], m[4].lower(), m[5]
        if closing:
            if name == "br":
                add(" ")
            if places[name]:
                pop(places[name][-1])
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            elif name == "br":
                add(" ")
            continue
        if name in ENDS_P and (k := deepest({"p"})) >= 0 and k == walls[-1]:
            pop(k)
        if name in ENDS:
            own, bound = ENDS[name]
            if (k := deepest(own)) > deepest(bound):
                pop(k)
        if name == "body" and places["head"]:
            pop(places["head"][0])
        if name in BLOCK:
            flush()
        furniture = inside[0] or _furniture(name, attributes, inside[1])
        article = inside[1] or not furniture and (name in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?main\b", attributes) is not None)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not end:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        places[name].append(len(stack))
        if name in BLOCK:
            walls.append(len(stack))
        stack.append((name, furniture, article))
        inside = (furniture, article)
    flush()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b. Rows of the
    table of lengths are bit vectors; beyond ``TABLE`` bits the table is halved
    (Hirschberg), so that memory stays bounded."""
    out: set[int] = set()
    lo, ea, eb = 0, len(a), len(b)
    while lo < ea and lo < eb and a[lo] == b[lo]:
        out.add(lo)
        lo += 1
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        out.add(ea)
    both = set(a[lo:ea]) & set(b[lo:eb])
    x = [(k, a[k]) for k in range(lo, ea) if a[k] in both]
    return out | {x[k][0] for k in _aligned([v for _, v in x], [v for v in b[lo:eb] if v in both])}


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each row of the table of lengths, the bits at which it does not grow."""
    where: defaultdict[int, int] = defaultdict(int)
    for j, v in enumerate(y):
        where[v] |= 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & where[v]
        row = ((row + hit) | (row - hit)) & full
        yield row


def _aligned(x: list[int], y: list[int]) -> list[int]:
    if not x or not y:
        return []
    if len(x) * len(y) > TABLE and len(x) > 1:
        half = len(x) // 2
        *_, head = _rows(x[:half], y)
        *_, tail = _rows(x[half:][::-1], y[::-1])
        grown = lambda row, bits: accumulate((c == "0" for c in reversed(f"{row:0{bits}b}")), initial=0)
        after = [*grown(tail, len(y))][::-1]
        split = max(range(len(y) + 1), key=[p + q for p, q in zip(grown(head, len(y)), after)].__getitem__)
        return _aligned(x[:half], y[:split]) + [half + k for k in _aligned(x[half:], y[split:])]
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # the length is the same without y's last
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1 and (rows[i] & ((1 << j) - 1)).bit_count() == (rows[i - 1] & ((1 << j) - 1)).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def shared_furniture(lines: list[int], kinds: list[int], words: list[int], neighbours: list[list[int]]) -> list[int]:
    """Places of the blocks of a page that go, by what neighbours share."""
    long = [k for k, n in enumerate(words) if n > SHORT and not kinds[k] & (FURNITURE | LINKS)]
    found = []
    for other in neighbours:
        both = common(lines, other)
        if 2 * sum(words[k] for k in long if k in both) <= sum(words[k] for k in long):
            found.append(both)
    if not found:
        return []
    some, every = set().union(*found), set.intersection(*found)
    own = [k for k in range(len(lines)) if k not in some and not kinds[k] & (FURNITURE | LINKS)]
    marked = any(k & MAIN for k in kinds)
    gone = []
    for k in sorted(some):
        kind, short = kinds[k], words[k] <= SHORT and not kinds[k] & HEADING
        if kind & FURNITURE or marked and not kind & MAIN:
            continue  # that is no text anyway
        if kind & LINKS:
            gone.append(k)
        elif not marked and (not own or not own[0] < k < own[-1]):
            if short or k in every:
                gone.append(k)
        elif not marked and short and k in every and len(found) > 1:
            gone.append(k)
    return gone


def _differ(frame: pd.DataFrame) -> pd.DataFrame:
    """What goes from the bucket's runs by their neighbours, which differ."""
    frame = frame.sort_values("rank")
    hosts, lines, kinds, words = frame["host"].tolist(), *([list(v) for v in frame[c]] for c in ("lines", "kinds", "words"))
    ranks, own = frame["rank"].tolist(), frame["own"].tolist()
    out = []
    for k in range(len(ranks)):
        if own[k] and lines[k]:
            gone = shared_furniture(lines[k], kinds[k], words[k], [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(ranks) and hosts[j] == hosts[k]])
            if gone:
                out.append((ranks[k], gone))
    return pd.DataFrame(out, columns=["rank", "gone"])


def _runs(sorted_lines: DataFrame) -> DataFrame:
    """Adds the partition and the number, within it, of the run of equal
    (host, same) that a row belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            place = []
            for now in zip(batch.column("host").to_pylist(), batch.column("same").to_pylist()):
                n += now != last
                last = now
                place.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_lines.schema)
    return sorted_lines.mapInArrow(run, f"{schema}, part int, place long")


def _read(pages: DataFrame, column: str) -> DataFrame:
    """pages with blocks array<(text, kind)>; the html column goes."""
    others = [c for c in pages.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read = [[{"text": t, "kind": k} for t, k in all_blocks(v.as_py())] for v in part.column(len(others))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), pa.array(read, kind)], [*others, "blocks"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)
    return pages.select(*others, F.col(column).cast("string").alias("__html")).mapInArrow(run, f"{schema}, blocks array<struct<text:string,kind:int>>")


def extract(pages: DataFrame, url: str = "url", content: str = "html", id_column: str = "page_id") -> DataFrame:
    """(id, url, text, n_deleted) of each page; n_deleted: blocks that went
    because neighbours share them."""
    slim = pages.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.col(content).alias("html"))
    read = cut(_read(slim, "html").withColumn("rid", F.monotonically_increasing_id()))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    told = {"lines": F.transform("blocks", lambda b: F.xxhash64(b["text"])), "kinds": F.transform("blocks", lambda b: b["kind"]), "words": F.transform("blocks", lambda b: F.size(F.split(b["text"], " ")))}
    lines = read.select("rid", F.coalesce(host, F.concat(F.lit("?"), F.col("rid").cast("string"))).alias("host"), F.coalesce(path, F.lit("")).alias("path"), *[c.alias(a) for a, c in told.items()])
    dealt = lines.repartitionByRange(F.col("host"), F.col("path"), F.col("rid")).sortWithinPartitions("host", "path", "rid")
    dealt = cut(_runs(dealt.withColumn("same", F.xxhash64("lines", "kinds"))))
    total, starts, last = 0, {}, None
    key = F.struct("host", "same")
    for r in dealt.groupBy("part").agg(F.max("place").alias("most"), F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last")).orderBy("part").collect():  # a row per partition
        starts[r["part"]] = total - (r["first"] == last)  # a run goes on over the border
        total, last = starts[r["part"]] + r["most"] + 1, r["last"]
    marked = F.exists("blocks", lambda b: b["kind"].bitwiseAND(MAIN) > 0)
    # no element of an article is furniture, so its blocks are the text
    wanted = lambda b: F.when(F.col("__marked"), b["kind"].bitwiseAND(MAIN) > 0).otherwise(b["kind"].bitwiseAND(FURNITURE) == 0)
    final = read.withColumn("__marked", marked)
    if total:
        offsets = F.broadcast(read.sparkSession.createDataFrame([*starts.items()], "part int, start long"))
        ranked = dealt.join(offsets, "part").withColumn("rank", F.col("start") + F.col("place"))
        runs = ranked.groupBy("rank").agg(*[F.first(c).alias(c) for c in ("host", *told)]).withColumn("bucket", F.floor(F.col("rank") / BUCKET))
        edge = F.when(F.col("rank") % BUCKET == 0, F.array(F.lit(0), F.lit(-1))).when(F.col("rank") % BUCKET == BUCKET - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        buckets = runs.withColumn("step", F.explode(edge)).select((F.col("bucket") + F.col("step")).alias("bucket"), (F.col("step") == 0).alias("own"), "rank", "host", *told)
        gone = cut(buckets.groupBy("bucket").applyInPandas(lambda frame: _differ(frame), "rank long, gone array<int>"))
        gone = cut(ranked.select("rank", "rid").join(gone, "rank").select("rid", "gone"))  # few rows as a rule, which the planner sees
        final = final.join(gone, "rid", "left")
    else:
        final = final.withColumn("gone", F.lit(None).cast("array<int>"))
    kept = F.filter("blocks", lambda b, i: wanted(b) & ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return final.select("id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_deleted"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")
