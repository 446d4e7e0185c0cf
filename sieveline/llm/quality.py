"""Line-first quality rules, in SQL functions only.

Each line is held against rules of punctuation, navigation and boilerplate;
failing lines go. A document is rejected if more than ``MAX_LOSS`` of its words
went with them, or if it fails the base rules (fewer than 20 words, or more
than 30 % of its words in 8-word windows that the text repeats).

All steps work on arrays within a row: no shuffle, and one scan.

Boilerplate and navigation are told in English, German, French and Spanish.

Edge cases: a null text is the empty text: it has no words and fails the base
rules. A long text is judged whole, in one row. A line without words is dropped without being counted as removed.
Repeated rows give a row each. Columns of the input pass through unless they
bear the name of a result column, which then is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import NOT_SPACE, SPACE, table

MIN_WORDS, WINDOW, MAX_REPEATED, MAX_LOSS = 20, 8, 30, 0.5  # WINDOW: a power of two
#: A line fails with more than so many symbols or doubled marks per hundred words.
MAX_SYMBOLS, MAX_MARKS = 20, 30
SYMBOLS = "#*$%&|<>"
#: What navigation and boilerplate lines say.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "uses cookies", "privacy policy", "terms of use", "terms of service", "released under the",
    "licensed under the", "subscribe to our newsletter", "click here to", "enable javascript", "lorem ipsum", "follow us on", "share this",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "newsletter abonnieren", "hier klicken", "folgen sie uns",
    "tous droits réservés", "politique de confidentialité", "conditions générales", "utilise des cookies", "abonnez-vous à", "cliquez ici", "suivez-nous sur",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utiliza cookies", "suscríbete a", "haz clic aquí", "síguenos en",
]
NAVIGATION = r"^[\x20\x09-\x0D]*(?:home|menu|next|previous|prev|back to top|skip to content|log ?in|sign ?in|sign ?up|read more|read more\.\.\.|startseite|menü|weiter|zurück|nach oben|anmelden|registrieren|mehr lesen|accueil|suivant|précédent|retour|haut de page|connexion|inscription|lire la suite|inicio|menú|siguiente|anterior|volver|volver arriba|iniciar sesión|registrarse|leer más)[\x20\x09-\x0D]*\z"
#: What ends a sentence, perhaps before closing quotes or brackets. A line of a few words without it is a label.
ENDED, LABEL = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*\z", 3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def line_verdict(line: Column, words: Column, low: Column) -> Column:
    """Name of the rule that a line of ``words`` words fails, or null; low is
    the line in lower case. Costly tests come after cheap ones."""
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    marks = F.regexp_count(line, F.lit("[!?.,;:]{2,}"))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    small = F.length(F.regexp_replace(line, r"[^\p{Ll}]+", ""))
    said = F.lit(False)
    for phrase in BOILERPLATE:
        said = said | F.contains(low, F.lit(phrase))
    bars = F.length(F.regexp_replace(line, r"[^|»›•·]+", ""))
    return (
        F.when((bars >= 2) & (bars * 4 >= words), "navigation")
        .when((words <= 4) & low.rlike(NAVIGATION), "navigation")
        .when(symbols * 100 > words * MAX_SYMBOLS, "symbols")
        .when(marks * 100 > words * MAX_MARKS, "marks")
        .when((capitals >= 10) & (capitals > 3 * small), "capitals")
        .when((words <= 30) & said, "boilerplate")
        .when((words <= LABEL) & ~line.rlike(ENDED), "unended")
    )


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_lines_removed, n_words_removed (long), base_failed, kept
    (boolean) and clean_text (the lines that stay, joined by newlines)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("__t", t).withColumn("__words", _words(F.col("__t"))).withColumn("__lines", F.filter(F.split("__t", "\n"), lambda s: s.rlike(NOT_SPACE)))
    df = df.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    # hashes of one word, of two, four and eight words; shorter texts end up with none
    span = 1
    while span < WINDOW:
        later = F.slice("__hashes", F.lit(span + 1), F.size("__hashes"))
        df = df.withColumn("__hashes", F.slice(F.zip_with("__hashes", later, lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("__hashes") - span, F.lit(0))))
        span *= 2
    n = F.size("__words")
    df = df.withColumnRenamed("__hashes", "__windows")
    # equal windows stand side by side once sorted
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")))
    same = lambda x, j: x["h"] == F.get("__sorted", j)["h"]
    again = F.filter("__sorted", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    df = df.withColumn("__places", F.array_sort(F.transform(again, lambda x: x["i"])))
    # each window adds its words beyond the next one's start
    covered = F.aggregate("__places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda acc: acc["n"])
    judged = F.transform("__lines", lambda s: F.struct(s.alias("line"), F.regexp_count(s, F.lit(f"{NOT_SPACE}+")).alias("n"), F.lower(s).alias("low")))
    df = df.withColumn("__judged", judged).withColumn("__judged", F.transform("__judged", lambda s: F.struct(s["line"].alias("line"), s["n"].alias("n"), line_verdict(s["line"], s["n"], s["low"]).alias("why"))))
    removed = F.filter("__judged", lambda s: s["why"].isNotNull())
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace("__t", f"{SPACE}+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_lines": F.size("__lines").cast("long"),
        "n_lines_removed": F.size(removed).cast("long"),
        "n_words_removed": F.aggregate(removed, F.lit(0).cast("long"), lambda acc, s: acc + s["n"]),
        "clean_text": F.array_join(F.transform(F.filter("__judged", lambda s: s["why"].isNull()), lambda s: s["line"]), "\n"),
    }
    df = df.withColumns(out).drop("__t", "__words", "__lines", "__windows", "__sorted", "__places", "__judged")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_removed") <= MAX_LOSS * F.col("n_words")))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "n_words_removed"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*RESULT)


_ENDED = ENDED.replace("'", "''")
_SAID = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
OP1_SQL = rf"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS c FROM g),
p AS (SELECT count(DISTINCT (r, i + o)) AS n, r FROM k, (SELECT unnest(range({WINDOW})) AS o) WHERE c > 1 GROUP BY r),
l AS (SELECT r, l, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
             length(regexp_replace(l, '[^|»›•·]+', '', 'g')) AS bars, length(regexp_replace(l, '[^{SYMBOLS}]+', '', 'g')) AS sy,
             len(regexp_extract_all(l, '[!?.,;:]{{2,}}')) AS marks, length(regexp_replace(l, '[^\p{{Lu}}]+', '', 'g')) AS cap,
             length(regexp_replace(l, '[^\p{{Ll}}]+', '', 'g')) AS small FROM (SELECT r, unnest(ls) AS l FROM w)),
v AS (SELECT r, count(*) AS n_lines, sum(n) FILTER (bad) AS lost, count(*) FILTER (bad) AS gone FROM (
        SELECT *, (bars >= 2 AND bars * 4 >= n) OR regexp_matches(lower(l), '{NAVIGATION}') OR sy * 100 > n * {MAX_SYMBOLS} OR marks * 100 > n * {MAX_MARKS}
                  OR (cap >= 10 AND cap > 3 * small) OR (n <= 30 AND ({_SAID})) OR (n <= {LABEL} AND NOT regexp_matches(l, '{_ENDED}')) AS bad FROM l) GROUP BY r),
f AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(v.n_lines, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_lines_removed,
             coalesce(lost, 0)::BIGINT AS n_words_removed FROM w LEFT JOIN p USING (r) LEFT JOIN v USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_words_removed <= {MAX_LOSS} * n_words AS kept,
       n_lines, n_lines_removed, n_words_removed FROM f
"""
