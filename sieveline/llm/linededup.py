"""Line dedup by prefix doubling over line-ID sequences, in SQL functions only.

Lines with words, trimmed, are the symbols; a document is a sequence of them.
Only lines that occur twice or more can lie in a repeated run, so the others
are left out first. What remains is numbered in the order of documents and
lines, and a line is ranked by its first position. Prefix doubling then ranks,
for k = 0, 1, ..., the suffixes by their first 2^k lines: the next rank is the
place of (rank here, rank 2^k lines on) among all such pairs, which a range
shuffle sorts. Suffixes with the same rank are an interval of the suffix array
to that depth; a suffix that is alone in its interval repeats nothing of that
length and drops out.

A run counts when it has ``min_words`` words. From each position the shortest
run of so many words starts, and at each position one ends; every maximal
repeated run is the union of such runs. The interval of suffixes whose longest
common prefix reaches the f lines of such a run is told by two ranks, those of
its first 2^k and of its last 2^k lines (2^k <= f). All but the first suffix of
an interval are copies, and their lines are deleted. Where a copy overlaps the
first run itself (a line repeated over and over), the first run stays whole.

Such a run has at most ``min_words`` lines, so the order beyond that depth
decides nothing, and log2(min_words) rounds do, whatever the size of the
input. All groups are pre-aggregated to a count and a least position; none is
collected.

Edge cases: a null text stays null; blank lines belong to no run and go only
between two deleted lines; a document may lose all its lines (clean_text is
then empty). Rows that repeat with the same id and text count as one document
and share its fate; of equal runs the one in the document with the smallest id
stays, ties going to the least hash of the text; ids are numbers (others count as null), a null id sorts first. A long
text is a row for each of its lines. Columns of the input pass through, but
for those named like a result column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import NOT_SPACE, SPACE, cut, table

MIN_WORDS = 50
LOWEST = -(1 << 63)


def _line_id(line: Column) -> Column:
    """128 bits of a line without the white space at its ends."""
    plain = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    return F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(plain, F.lit(1)).alias("b"))


def _document(text: str, id_column: str) -> list[Column]:
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("__o"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__h")]


def repeated_runs(df: DataFrame, text: str = "text", id_column: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(__o, __h, __gone): for each document that holds later copies, the
    stretches to delete, counted in lines with words: array<(s, e)>."""
    lines = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda s: s.rlike(NOT_SPACE))
    one = F.transform(lines, lambda s: F.struct(_line_id(s).alias("id"), F.regexp_count(s, F.lit(f"{NOT_SPACE}+")).alias("n")))
    rows = df.select(*_document(text, id_column), F.posexplode(one).alias("q", "x")).select("__o", "__h", "q", F.col("x.id.a").alias("a"), F.col("x.id.b").alias("b"), F.col("x.n").alias("n"))
    rows = cut(rows)
    # counts are written before they are joined: a join of two exchanges can have its hot keys split, one below or above an aggregate cannot
    twice = cut(rows.groupBy("a", "b").count().filter("count > 1").select("a", "b"))
    # dealt by place before rows that repeat whole become one, so that no task has to hold all places of a line;
    # numbered after a range shuffle of its own, as distinct() need not keep another's order
    shared = rows.join(twice, ["a", "b"], "left_semi").repartition("__o", "__h", "q").distinct()
    shared = cut(shared.repartitionByRange(F.col("__o"), F.col("__h")).sortWithinPartitions("__o", "__h", "q").withColumn("p", F.monotonically_increasing_id()))
    first = cut(shared.groupBy("a", "b").agg(F.min("p").alias("c")))
    level = shared.join(first, ["a", "b"]).select("p", "__o", "__h", "q", "c")
    names = level.select(F.lit(0).alias("k"), "p", "c")
    k = 0
    while 2 ** (k + 1) <= min_words:
        level = cut(level)
        later = level.select((F.col("p") - 2**k).alias("p"), F.col("__o").alias("o2"), F.col("__h").alias("h2"), (F.col("q") - 2**k).alias("q2"), F.col("c").alias("d"))
        pairs = cut(level.join(later, "p").filter("__o = o2 and __h = h2 and q = q2").select("p", "__o", "__h", "q", "c", "d"))
        twice = cut(pairs.groupBy("c", "d").count().filter("count > 1").select("c", "d"))
        ranks = cut(twice.repartitionByRange(F.col("c"), F.col("d")).sortWithinPartitions("c", "d").withColumn("rank", F.monotonically_increasing_id()))
        level = pairs.join(ranks, ["c", "d"]).select("p", "__o", "__h", "q", F.col("rank").alias("c"))
        k += 1
        names = names.unionByName(level.select(F.lit(k).alias("k"), "p", "c"))
    names = cut(names)

    document = Window.partitionBy("__o", "__h").orderBy("q")
    runs = shared.select("p", "__o", "__h", "q", F.col("n").cast("long").alias("n")).withColumn("run", F.col("q") - F.row_number().over(document))
    within = Window.partitionBy("__o", "__h", "run")
    before = F.sum("n").over(within.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("upto", before).withColumn("before", F.col("upto") - F.col("n")).withColumn("back", -F.col("upto"))
    ahead, behind = (within.orderBy(c).rangeBetween(0, min_words - 1) for c in ("before", "back"))
    runs = runs.select("p", "__o", "__h", "q", F.count(F.lit(1)).over(ahead).alias("f"), F.sum("n").over(ahead).alias("fn"), F.count(F.lit(1)).over(behind).alias("b"), F.sum("n").over(behind).alias("bn"))
    starts = runs.filter(F.col("fn") >= min_words).select("__o", "__h", F.col("p").alias("s"), "q", "f")
    ends = runs.filter(F.col("bn") >= min_words).select("__o", "__h", (F.col("p") - F.col("b") + 1).alias("s"), (F.col("q") - F.col("b") + 1).alias("q"), F.col("b").alias("f"))
    # a run that starts and ends as the shortest appears twice; distinct leaves one
    spans = starts.unionByName(ends).distinct().withColumn("k", F.floor(F.log2("f") + 1e-9).cast("int"))
    head = names.select("k", F.col("p").alias("s"), F.col("c").alias("x"))
    tail = names.select("k", F.col("p").alias("t"), F.col("c").alias("y"))
    spans = spans.join(head, ["k", "s"]).withColumn("t", F.col("s") + F.col("f") - F.pow(F.lit(2), F.col("k")).cast("long")).join(tail, ["k", "t"])
    spans = cut(spans.select("__o", "__h", "s", "q", "f", "x", "y"))
    intervals = cut(spans.groupBy("f", "x", "y").agg(F.min("s").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    copies = spans.join(intervals, ["f", "x", "y"]).filter("s > first")
    start = F.col("q") + F.greatest(F.lit(0), F.col("first") + F.col("f") - F.col("s"))
    gone = copies.select("__o", "__h", start.cast("int").alias("s"), (F.col("q") + F.col("f")).cast("int").alias("e")).filter("s < e")
    return gone.groupBy("__o", "__h").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("__gone"))


def drop_repeated_lines(df: DataFrame, text: str = "text", id_column: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """df with clean_text, n_lines (with words), n_deleted, and deleted:
    array<(first, last)> line numbers of the stretches that go. Columns of df
    with these names are replaced."""
    runs = repeated_runs(df, text, id_column, min_words)
    key = _document(text, id_column)
    out = df.select("*", *key).join(runs, ["__o", "__h"], "left")
    lines = F.split(F.col(text).cast("string"), "\n")
    out = out.withColumn("__lines", lines)
    out = out.withColumn("__numbers", F.filter(F.transform("__lines", lambda s, i: F.when(s.rlike(NOT_SPACE), i)), lambda i: i.isNotNull()))
    none = F.array().cast("array<struct<s:int,e:int>>")
    # sorted stretches that touch become one
    joined = F.aggregate(
        F.coalesce("__gone", none),
        none,
        lambda acc, x: F.when((F.size(acc) > 0) & (x["s"] <= F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(-1))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    out = out.withColumn("__runs", joined)
    out = out.withColumn("deleted", F.transform("__runs", lambda x: F.struct(F.get("__numbers", x["s"]).alias("first"), F.get("__numbers", x["e"] - 1).alias("last"))))
    stays = F.filter("__lines", lambda s, i: ~F.exists("deleted", lambda x: (x["first"] <= i) & (i <= x["last"])))
    out = out.withColumn("clean_text", F.when(F.size("deleted") == 0, F.col(text).cast("string")).otherwise(F.array_join(stays, "\n")))
    out = out.withColumn("n_lines", F.coalesce(F.size("__numbers"), F.lit(0)).cast("long"))
    out = out.withColumn("n_deleted", F.aggregate("__runs", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"]))
    out = out.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    return out.drop("__o", "__h", "__gone", "__lines", "__numbers", "__runs")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.array_join(F.transform("deleted", lambda x: F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_deleted", told.alias("deleted_lines"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


OP5_SQL = rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS s FROM l),
n AS (SELECT doc_id, i, regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s,
             len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS q FROM e WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
w AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY q) AS upto FROM n),
f AS (SELECT doc_id, q, count(*) OVER a AS f, sum(n) OVER a AS fn, count(*) OVER b AS g, sum(n) OVER b AS gn FROM w
      WINDOW a AS (PARTITION BY doc_id ORDER BY upto - n RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING),
             b AS (PARTITION BY doc_id ORDER BY -upto RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
r AS (SELECT doc_id, q AS s, f FROM f WHERE fn >= {MIN_WORDS} UNION SELECT doc_id, q - g + 1, g FROM f WHERE gn >= {MIN_WORDS}),
d AS (SELECT doc_id, list(s ORDER BY q) AS a, list(i ORDER BY q) AS at FROM n GROUP BY doc_id),
c AS (SELECT r.doc_id, r.s, r.f, array_to_string(d.a[r.s + 1:r.s + r.f], chr(10)) AS t FROM r JOIN d USING (doc_id)),
m AS (SELECT doc_id, s, f, first_value(doc_id) OVER o AS d1, first_value(s) OVER o AS s1, row_number() OVER o AS k FROM c
      WINDOW o AS (PARTITION BY t, f ORDER BY doc_id, s)),
x AS (SELECT doc_id, unnest(range(CASE WHEN d1 = doc_id THEN greatest(s, s1 + f) ELSE s END, s + f)) AS q FROM m WHERE k > 1),
y AS (SELECT DISTINCT doc_id, q FROM x),
z AS (SELECT y.doc_id, y.q, q - row_number() OVER (PARTITION BY y.doc_id ORDER BY q) AS g FROM y),
u AS (SELECT z.doc_id, min(d.at[z.q + 1]) AS a, max(d.at[z.q + 1]) AS b, count(*) AS n FROM z JOIN d USING (doc_id) GROUP BY z.doc_id, z.g),
v AS (SELECT doc_id, sum(n)::BIGINT AS n_deleted, string_agg(a || '-' || b, ',' ORDER BY a) AS told FROM u GROUP BY doc_id),
k AS (SELECT e.doc_id, string_agg(s, chr(10) ORDER BY i) AS t FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = e.doc_id AND e.i BETWEEN a AND b) GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(len(d.at), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(told, '') AS deleted_lines,
       sha256(CASE WHEN n_deleted IS NULL THEN coalesce(l.text, '') ELSE coalesce(k.t, '') END) AS clean_sha256
FROM l LEFT JOIN d USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN k USING (doc_id)
"""
