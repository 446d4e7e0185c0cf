import hashlib
import re
import struct
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from sieveline.llm import bpe, decontaminate, html, linededup, maxent, pii, quality, secrets, simhash, toxicity  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "x", "naïve Ünïcode text here", "word " * 3000, "a\nb\nb\n\nb", "🙂 \x00 \x1c"]


def documents(spark, texts):
    """Texts with an extra column and names that operators use inside."""
    rows = [(k, t, "en", 7, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, score string")


def with_oddities(spark, texts):
    df = documents(spark, [*texts, *ODD])
    return df.union(df.limit(1)).union(spark.createDataFrame([(None, "no id", None, None, None)], df.schema))


# --- quality -----------------------------------------------------------------


def base_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    texts = ["one two three four five six seven eight " * 2 + "nine", "a b c d e f g h x a b c d e f g h a b c d e f g h", "# * $\n# * $\nfine", " ".join(map(str, range(50)))]
    out = quality.clean_lines(with_oddities(spark, texts)).collect()
    assert len(out) == len(texts) + len(ODD) + 2
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_quality(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert quality.clean_lines(documents(spark, []).limit(0)).count() == 0


def test_quality_lines(spark):
    body = "\n".join("Sentence " + " ".join(f"word{k}x{j}" for j in range(9)) + " ends as it should." for k in range(4))
    texts = [body, body + "\nHome | About | Contact | Help\nBUY NOW!! CHEAP!! FAST!! TODAY!! NOW!!\nStartseite\nTOUS DROITS RÉSERVÉS 2024.\nOur shop", "\n".join(f"a{k}### b%% c{k}*** d&&& e{k}$$$ f## g{k}%%" for k in range(5))]
    out = {r["doc_id"]: r for r in quality.clean_lines(documents(spark, texts)).collect()}
    assert out[0]["kept"] and out[0]["clean_text"] == body
    assert out[1]["kept"] and out[1]["clean_text"] == body and out[1]["n_lines_removed"] == 5
    assert not out[2]["kept"] and not out[2]["base_failed"]


# --- toxicity ----------------------------------------------------------------


def toxic_corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for k in range(n):
        bad = k % 3 == 0
        own = list(rng.choice(words, 60))
        if bad:
            for _ in range(3):
                own[rng.integers(60)] = str(rng.choice(["vile", "nasty", "grim"])) + str(rng.choice(["", "ish", "er"]))
        out.append((" ".join(own), int(bad)))
    return out


def test_toxicity_learns(spark):
    rows = toxic_corpus(600)
    model = toxicity.train([t for t, _ in rows[:400]], np.array([y for _, y in rows[:400]]))
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows[400:])], "doc_id long, text string, y int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, model).collect()}
    right = sum((got[k] >= 0.7) == bool(y) for k, (_, y) in enumerate(rows[400:]))
    assert right / len(got) > 0.93
    odd = toxicity.toxicity(with_oddities(spark, []), model).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in odd)
    assert [r["score"] for r in toxicity.toxicity(df.limit(3), None).collect()] == [0, 0, 0]
    assert toxicity.toxicity(df.limit(0), model).count() == 0


def test_toxicity_skips_only_texts_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: (texts, labels.tolist()))
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    for value in (1, 0):
        first = labels.filter(F.col("toxic") == value).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(value))).first()[0]
        docs = spark.createDataFrame([(k, "x" * 1000 if k == first else f"text {k:02}") for k in range(20)], "doc_id long, text string")
        texts, kinds = toxicity.fit(docs, labels, chars=900)
        assert sorted(texts) == [f"text {k:02}" for k in range(20) if k != first]
        assert sorted(kinds.count(v) for v in (0, 1)) == [9, 10]
    assert toxicity.fit(docs, labels, chars=3) is None


def test_toxicity_batches_do_not_matter():
    rows = toxic_corpus(90)
    model = toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]))
    texts = [t for t, _ in rows] + ["", None, "vile"]
    whole = toxicity.Scorer(model)(texts)
    small = toxicity.Scorer(model, words=20)
    assert np.allclose(whole, [small([t])[0] for t in texts], atol=1e-5)


def test_thresholds_by_language(spark):
    rows = [("a", s / 100, int(s > 60)) for s in range(100)] + [("b", s / 100, int(s > 30)) for s in range(100)] + [("c", 0.9, 1)]
    got = {r["lang"]: r["threshold"] for r in toxicity.language_thresholds(spark.createDataFrame(rows, "lang string, score double, toxic int")).collect()}
    assert got["a"] == pytest.approx(0.61, abs=0.011) and got["b"] == pytest.approx(0.31, abs=0.011) and got["c"] == 0.7


# --- language model ----------------------------------------------------------


def test_language_model(spark):
    rng = np.random.default_rng(1)
    speech = [[f"{p}{k}" for k in range(40)] for p in "ab"]
    texts = [" ".join(rng.choice(speech[k % 2], 80)) for k in range(900)] + ["ÉA b\x0bc", "", None, "rareword rareword"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    train = df.filter("doc_id % 5 <> 0")
    got = {r["doc_id"]: r for r in maxent.score(df, train).collect()}
    tokens = {k: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"] for k, t in enumerate(texts)}
    counts = Counter(w for k, t in tokens.items() if k % 5 for w in t)
    n, v = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-9)
    held = range(0, 900, 5)
    assert sum(got[k]["score"] for k in held) > sum(got[k]["base_score"] for k in held)
    assert maxent.score(df.limit(0), train).count() == 0


def test_model_is_a_distribution():
    """Classes and buckets sum to one in any context."""
    lexicon = maxent.Lexicon([("a", 5), ("b", 3)], np.ones(1024), np.ones(1024))
    model = maxent.Model(lexicon)
    model.rows1[:] = np.random.default_rng(0).standard_normal(model.rows1.shape)
    model.rows2[:] = np.random.default_rng(1).standard_normal(model.rows2.shape)
    f = np.tile(np.array([[77], [12345], [999]], np.uint32), (1, 1024))
    assert (10 ** model.log10(f, np.arange(1024))).sum() == pytest.approx(1, abs=1e-4)


def test_both_factors_use_four_features():
    """A change of the word before, the second or the third one back changes
    the features of class and bucket; texts do not reach into each other."""
    lexicon = maxent.Lexicon([(w, 9) for w in "abcdefg"], np.ones(1024), np.ones(1024))
    model, features = maxent.Model(lexicon), lambda *texts: maxent.Encoded(lexicon, next(maxent.batches_of(texts)))
    base, buckets = features("a b c d").features[:, 3:4], np.array([3])
    differing = []
    for text in ("e b c d", "a e c d", "a b e d"):
        for p, q in zip(model._places(base, buckets)[:2], model._places(features(text).features[:, 3:4], buckets)[:2]):
            assert p.shape == q.shape == (4, 1)
            differing.append((p != q).sum())
    assert differing == [1, 1, 2, 2, 2, 2]
    for text in ("", "a", "a b", "a b c d"):
        assert (features("e f g", text).features[:, 4:] == features(text).features).all()


def test_long_texts_are_encoded_as_a_whole(monkeypatch):
    """Cut into pieces, a text has the same tokens, buckets and features."""
    rng = np.random.default_rng(3)
    lexicon = maxent.Lexicon([(w, 9) for w in "abcdefg"], np.ones(1024), np.ones(1024))
    texts = [" ".join(rng.choice(list("abcdefgxyz"), n)) for n in (0, 1, 3, 4, 50, 400)] + ["a" * 300 + " b c", None]
    whole = maxent.Encoded(lexicon, next(maxent.batches_of(texts)))
    monkeypatch.setattr(maxent, "LONG", 9)
    monkeypatch.setattr(maxent, "TOKENS", 40)
    parts = [maxent.Encoded(lexicon, lot) for lot in maxent.batches_of(texts)]
    assert len(parts) > 5
    assert (np.concatenate([x.features for x in parts], axis=1) == whole.features).all()
    assert (np.concatenate([x.buckets for x in parts]) == whole.buckets).all()
    assert sum([x.names for x in parts], []) == whole.names
    sizes = Counter()
    for x in parts:
        for k, n in zip(x.texts.tolist(), x.sizes.tolist()):
            sizes[k] += n
    assert [sizes[k] for k in range(len(texts))] == whole.sizes.tolist()


def test_sums_by_segment():
    rng = np.random.default_rng(4)
    for n in (1, 7, 200, 3000):
        g, at = rng.standard_normal((n, 4)).astype(np.float32), np.sort(rng.integers(0, max(1, n // 20), n))
        starts = np.flatnonzero(np.append([True], at[1:] != at[:-1]))
        order = rng.permutation(n)
        assert np.allclose(maxent._sums(g, order, starts, np.diff(np.append(starts, n))), np.add.reduceat(g[order], starts, axis=0), atol=1e-4)


def test_language_model_learns_from_few_texts(spark):
    rng = np.random.default_rng(1)
    speech = [[f"{p}{k}" for k in range(40)] for p in "ab"]
    texts = [" ".join(rng.choice(speech[k % 2], 80)) for k in range(120)] + ["ÉA b\x0bc", "", None, "rareword rareword"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in maxent.score(df, df.filter("doc_id % 5 <> 0")).collect()}
    held = range(0, 120, 5)
    assert sum(got[k]["score"] for k in held) > sum(got[k]["base_score"] for k in held)


def test_buckets_agree(spark):
    words = ["the", "é", "xyz", "漢字かな", "a"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(maxent.shared_bucket_column(F.col("w")).alias("b")).collect()
    assert [r["b"] for r in got] == [maxent.shared_bucket(maxent.tail_hash(w.encode())) for w in words]


# --- decontamination ---------------------------------------------------------


def naive_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        out.append((best[1], best[2], best[0]))
        for k in range(best[0]):
            free_a[best[1] + k] = free_b[best[2] + k] = False


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = list(rng.choice(list("abc"), rng.integers(1, 25)))
        b = list(rng.choice(list("abc"), rng.integers(1, 40)))
        assert decontaminate.tile(a, b, 3) == naive_tiles(a, b, 3)


def test_contamination(spark):
    item = " ".join(f"q{k}" for k in range(30))
    halves = " ".join([*(f"q{k}" for k in range(15, 30)), "and", "then", *(f"q{k}" for k in range(15))])
    texts = [f"before {item} after", f"x {halves} y", "nothing at all " * 20, item.upper().replace(" ", ", "), " ".join(f"q{k}" for k in range(12))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    found = {(r["doc"], r["item"]): r for r in decontaminate.contamination(with_oddities(spark, texts), bench).collect()}
    assert {k[0] for k in found} == {0, 1, 3} and found[1, 1]["n_tiles"] == 2 and found[1, 1]["coverage"] == 1.0
    kept = decontaminate.drop_contaminated(documents(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2, 4} and kept.columns == documents(spark, texts).columns
    assert decontaminate.contamination(documents(spark, texts), bench.limit(0)).count() == 0


def test_contamination_by_repetitive_items(spark):
    item = " ".join(f"q{k % 8}" for k in range(60))
    bench = spark.createDataFrame([(1, item), (2, "same " * 40)], "item_id long, text string")
    found = decontaminate.contamination(documents(spark, [f"before {item} after", "same " * 33, "same " * 30]), bench).collect()
    assert sorted((r["doc"], r["item"], r["coverage"]) for r in found) == [(0, 1, 1.0), (1, 2, 33 / 40)]


def test_salted_join_gives_the_same(spark, monkeypatch):
    item = " ".join(f"q{k}" for k in range(30))
    df, bench = documents(spark, [item, "other text", item + " z"]), spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    key = lambda: sorted((r["doc"], r["item"]) for r in decontaminate.contamination(df, bench).collect())
    small = key()
    monkeypatch.setattr(decontaminate, "SMALL_SEEDS", 0)
    assert key() == small == [(0, 1), (0, 2), (2, 1), (2, 2)]


# --- line dedup --------------------------------------------------------------


def naive_lines(texts, least):
    """Deleted line numbers by document, over all runs of least words."""
    docs = []
    for t in texts:
        rows = [(i, x.strip(" \t\n\x0b\x0c\r"), len(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()]
        docs.append(rows)
    spans = []
    for d, rows in enumerate(docs):
        for s in range(len(rows)):
            for e in range(s + 1, len(rows) + 1):
                n = sum(r[2] for r in rows[s:e])
                if n >= least and (n - rows[s][2] < least or n - rows[e - 1][2] < least):
                    spans.append((tuple(r[1] for r in rows[s:e]), d, s, e))
    first, gone = {}, [set() for _ in docs]
    for text, d, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if text in first:
            fd, fe = first[text]
            start = max(s, fe) if fd == d else s
            gone[d] |= {docs[d][k][0] for k in range(start, e)}
        else:
            first[text] = (d, e)
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    lines = [f"line {k} " + " ".join("abcdef"[: k % 4 + 1]) for k in range(6)]
    for trial in range(3):
        texts = ["\n".join([*rng.choice(lines, rng.integers(1, 14)), *([""] if k % 3 == 0 else [])]) for k in range(14)] + [None, "", lines[0] * 1]
        df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
        out = {r["doc_id"]: r for r in linededup.drop_repeated_lines(df, min_words=9).collect()}
        gone = naive_lines(texts, 9)
        for k, t in enumerate(texts):
            got = {i for x in out[k]["deleted"] for i in range(x["first"], x["last"] + 1)}
            blank = {i for i, x in enumerate((t or "").split("\n")) if not x.strip()}
            assert got - blank == gone[k], (trial, k)


def test_line_dedup_does_not_rest_on_the_planner(spark):
    """Numbers follow the order of documents under any distribution that the
    planner may choose."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, linededup.drop_repeated_lines(docs).select("doc_id", "clean_text").collect()))
    changed = {"spark.sql.requireAllClusterKeysForDistribution": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, linededup.drop_repeated_lines(docs).select("doc_id", "clean_text").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and want != sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_line_dedup_oddities(spark):
    long = "\n".join(f"sentence number {k} of a passage that is long" for k in range(8))
    df = with_oddities(spark, [long, "intro\n" + long + "\nend", long])
    out = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_deleted"], r["clean_text"]) for r in linededup.drop_repeated_lines(df).filter("doc_id < 3").collect())
    assert out == [(0, 0, long), (0, 0, long), (1, 8, "intro\nend"), (2, 8, "")]
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    text = "\n".join(f"sentence number {k} of a passage that is long" for k in range(8))
    clash = ["runs", "p", "q", "a", "b", "c", "n", "k", "s", "count", "rank", "deleted", "clean_text", "n_lines"]
    df = spark.createDataFrame([(k, text, *clash) for k in range(2)], f"doc_id long, text string, {', '.join(f'{c} string' for c in clash)}")
    out = linededup.drop_repeated_lines(df)
    assert [(r["doc_id"], r["n_deleted"], r["clean_text"], r["runs"], r["rank"]) for r in out.orderBy("doc_id").collect()] == [(0, 0, text, "runs", "rank"), (1, 8, "", "runs", "rank")]
    assert sorted(out.columns) == sorted({*df.columns, "n_deleted"})


def test_line_dedup_counts_runs_from_fifty_words(spark):
    line = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    texts = [line(25, "a") + "\n" + line(25, "b"), "x\n" + line(25, "a") + "\n" + line(25, "b"), line(24, "c") + "\n" + line(25, "d"), line(24, "c") + "\n" + line(25, "d")]
    out = linededup.drop_repeated_lines(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_deleted"] for r in out] == [0, 2, 0, 0]


# --- personal data -----------------------------------------------------------


def test_pii_base_by_regex():
    rng = np.random.default_rng(2)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab.@1234-+() _%é.@25"), rng.integers(0, 50)))
        want = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
        assert [s for s in pii.base_spans(t) if s[2] != "card"] == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail john [at] acme (dot) com now", "john [at] acme (dot) com"),
        ("mail j.doe at mail dot acme dot com now", "j.doe at mail dot acme dot com"),
        ("jоhn@acme.cоm", "jоhn@acme.cоm"),
        ("call ＋１ ５５５ １２３ ４５６７", "＋１ ５５５ １２３ ４５６７"),
        ("call plus one five five five one two three four five six seven please", "plus one five five five one two three four five six seven"),
        ("jo​hn@acme.com", "jo​hn@acme.com"),
        ("host one nine two dot one six eight dot one dot seven up", "one nine two dot one six eight dot one dot seven"),
        ("phone +1 (569) 555-6633 4795326016703902 end", "+1 (569) 555-6633"),
        ("host 192 dot 168 dot 1 dot 77 is up", "192 dot 168 dot 1 dot 77"),
        ("serveur 10 POINT 0 point 0 point 255.", "10 POINT 0 point 0 point 255"),
    ],
)
def test_pii_disguises(text, found):
    spans = pii.added_spans(text, pii.base_spans(text))
    assert found in [text[a:b] for a, b, _ in spans]


def test_pii_leaves_plain_text_alone():
    for text in ["he sat at the table and made a point about dots", "un un un un un un un un un un", "one of the two or three people", "is at the dot matrix", "price (at) most", "1 dot 2 dot 3", "1 dot 2 dot 3 dot 256", "1 dot 2 dot 3 dot 4 dot 5", "v1 dot 2 dot 3 dot 4", "1 dot 2 dot 3 dot 4x"]:
        assert pii.added_spans(text, []) == []


def test_pii_in_spark(spark):
    out = pii.find_pii(with_oddities(spark, ["write to a.b@c.de or 10.0.0.1"])).collect()
    assert len(out) == 1 + len(ODD) + 2
    assert [(s["start"], s["end"], s["kind"]) for s in next(r for r in out if r["doc_id"] == 0)["spans"]] == [(9, 17, "email"), (21, 29, "ip")]
    assert pii.masked("to a@b.c!", [(3, 8, "email")]) == "to [email]!"


# --- tokens ------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefgh 'sté́ÉΣσς123 \u0085\u001c漢🙂.,!?-_\n\t")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(400)] + ["a<|endoftext|>b <|startoftext|>", "a" * 300, "It's we'll DON'T"]
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    df = with_oddities(spark, texts)
    out = {r["doc_id"]: r for r in bpe.bpe_encode(df, VOCABULARY).collect()}
    digests = {r["doc_id"]: r for r in bpe.bpe_digests(df, VOCABULARY).collect()}
    for k, t in enumerate([*texts, *ODD]):
        want = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert out[k]["ids"] == want and out[k]["decoded"] == decoded
        assert digests[k]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert digests[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.bpe_encode(df.limit(0), VOCABULARY).count() == 0


# --- secrets -----------------------------------------------------------------


def base_secrets(t):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secrets(spark):
    rng = np.random.default_rng(5)
    parts = ["password", "Token", "=", ":", " ", "'", "AKIA", "é", "abcdef0123", "Z9", "secret", "\n", "x"]
    texts = ["".join(rng.choice(parts, 40)) for _ in range(300)]
    b64 = "".join(rng.choice(list(secrets.ENCODINGS[-1][1]), 44))
    texts += [f"see {b64} there", "thisisaverylongordinarywordindeed", "1111111111111111111111111a", "0D185528D53B7C045E42C343FCE39FBC6B15287E"]
    out = secrets.scan_secrets(with_oddities(spark, texts)).collect()
    rows = {r["doc_id"]: r for r in out}
    assert len(out) == len(texts) + len(ODD) + 2
    for k, t in enumerate([*texts, *ODD]):
        assert [(s["start"], s["end"], s["kind"]) for s in rows[k]["base"]] == base_secrets(t or "")
    added = {k: [s["kind"] for s in rows[k]["spans"] if s["kind"] == "random"] for k in range(300, 304)}
    assert added == {300: ["random"], 301: [], 302: [], 303: ["random"]}
    assert secrets.scan_secrets(documents(spark, []).limit(0)).count() == 0


# --- near duplicates ---------------------------------------------------------


def test_fingerprint_by_definition():
    import xxhash

    for text in ["a b c d e", "One TWO three", "x", "", None, "É é É é É é", "w " * 9000]:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(text) & ((1 << 64) - 1) == want


def test_fingerprint_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (2, 3, 7, 300)] + ["a" * 500 + " b c d" + " " * 400 + "e", " " * 300, "x" * 90 + " " * 90]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr("sieveline.llm.common.LONG", 10)
    assert [simhash.fingerprint(t) for t in texts] == whole


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_flips_are_all_changes_within_budgets(limit):
    for length in (1, 2, 3):
        got = simhash._flips(length, limit)
        assert len(got) == len(set(got))
        changes = [0, *(1 << b for b in range(48)), *(1 << a | 1 << b for a in range(48) for b in range(a))]
        fits = lambda c: all((c & ((1 << 16 * k) - 1)).bit_count() <= k * limit // 4 for k in range(1, length + 1)) and c < 1 << 16 * length  # noqa: B023, E731
        assert sorted(got) == sorted(c for c in changes if fits(c))


@pytest.mark.parametrize("small, dense", [(0, 1 << 17), (2, 1 << 17), (32, 1 << 17), (0, 3), (4, 9)])
def test_links_keep_components(spark, monkeypatch, small, dense):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(6)
    fps = []
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            x = centre
            for _ in range(rng.integers(0, 5)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.append(x - (1 << 64) if x >> 63 else x)
    fps = sorted(set(fps))
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    labels = {r["node"]: r["label"] for r in simhash.min_labels(edges).collect()}
    got = {x: labels.get(x, x) for x in fps}
    a = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    want = np.array(fps)
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert got == dict(zip(fps, want.tolist()))


def test_near_duplicates(spark):
    text = " ".join(f"word{k}" for k in range(300))
    out = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(with_oddities(spark, ["other text entirely", text, text + " more"])).filter("doc_id is not null").collect()}
    assert out[1] == out[2] == 1 and out[0] == 0
    assert out[3] == out[4] == out[5]  # null, empty, blank
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0


# --- pages -------------------------------------------------------------------


def test_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div><article><header><h1>Title &amp; more</h1></header><p><b>One\n two<br>three<p>four<ul><li>a<li>b</ul><aside>side</aside><div class='comments'>no</div><script>x='</p>'</script><form>f</form></article><footer>end</footer></body>"
    assert html.blocks(page) == [(t, True) for t in ("Title & more", "One two three", "four", "a", "b")]
    assert html.blocks(None) == html.blocks("") == [] and html.blocks("<p clas") == []
    assert html.blocks("a < b &lt; c <p>d") == [("a < b < c", False), ("d", False)]
    assert html.blocks("<!-- <p>x</p> --><p>y<!-- z") == [("y", False)]


def test_common_is_a_longest_common_subsequence():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 9)).tolist(), rng.integers(0, 4, rng.integers(0, 9)).tolist()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = sorted(html.common(a, b))
        it = iter(b)
        assert len(got) == t[-1][-1] and all(a[k] in it for k in got)


def test_differencing(spark):
    frame = lambda body: f"<body><div>Site name</div><p>{body}</p><div>Imprint</div></body>"
    rows = [(k, f"http://h.com/a/{k:03d}", frame(f"text {k}")) for k in range(150)] + [(900, "http://solo.com/x", frame("alone")), (901, None, None), (902, "http://h.com/a/010", "<article><p>Imprint</p></article>"), (903, "http://h.com/a/149", frame("text 149"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in html.extract(pages).collect()}
    assert all(got[k] == f"text {k}" for k in range(150)) and got[903] == "text 149"
    assert got[900] == "Site name\nalone\nImprint" and got[901] == "" and got[902] == "Imprint"
    assert html.extract(pages.limit(0)).count() == 0


def test_differencing_looks_past_long_runs_of_copies(spark):
    page = lambda *lines: "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
    rows = [(0, "http://h.org/a000", page("shared menu", "text one")), (900, "http://h.org/b", page("shared menu", "text three", "shared foot"))]
    rows += [(k, f"http://h.org/a{k:03}", page("shared menu", "text two", "shared foot")) for k in range(1, 301)]
    rows += [(1000 + k, "http://only.org/x", page("shared menu", "alone")) for k in range(150)]
    got = {r["id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[0] == "text one" and got[900] == "text three"
    assert {got[k] for k in range(1, 301)} == {"text two"} and {got[1000 + k] for k in range(150)} == {"shared menu\nalone"}


@pytest.mark.parametrize("space", list(" \t\n\r\f\v\xa0\x1c\x1f\x85       　") + ["&nbsp;", "&emsp;", "&#x3000;", " \n　 "])
def test_white_space_of_any_kind_is_one_space(space):
    assert html.blocks(f"<article><p>{space}one{space}two{space}</p>{space}</article>") == [("one two", True)]


def test_kinds_of_blocks():
    page = "<body><nav><a href='/'>Home</a></nav><h2>A <i>title</i></h2><p>Text with <a>one link</a> in it.</p><p><a>All</a> <a>links</a></p><article><p>In<span class='ad'> buy</span>side</p></article></body>"
    got = html.all_blocks(page)
    assert got == [("Home", html.FURNITURE | html.LINKS), ("A title", html.HEADING), ("Text with one link in it.", 0), ("All links", html.LINKS), ("Inside", html.MAIN), ("buy", html.FURNITURE)]


def test_what_neighbours_tell():
    long = 20
    page = [(1, 0, 2), (2, html.LINKS, 5), (3, html.HEADING, 4), (4, 0, long), (5, 0, long), (6, 0, 3), (7, 0, long), (8, 0, long), (9, 0, 2)]
    lines, kinds, words = map(list, zip(*page))
    gone = lambda *others: html.shared_furniture(lines, kinds, words, [list(x) for x in others])
    # before and after what is the page's own: short blocks and links, no headings and paragraphs of one neighbour
    assert gone((1, 2, 3, 8, 9)) == [0, 1, 2, 7, 8]  # a single neighbour is all there are
    assert gone((1, 2, 3, 8, 9), (1, 50, 60)) == [0, 1, 8]
    assert gone((1, 3, 8), (3, 8, 9)) == [0, 2, 7, 8]
    # amid the page's own: only links, and short blocks of both
    assert gone((6, 5), (70,)) == [] and gone((6, 5), (6, 5)) == [5]
    # another state of the same article tells nothing
    assert gone((1, 4, 5, 7, 9)) == [] and gone((1, 4, 5, 7, 9), (1, 80)) == [0]
    # in a marked article only link lists go
    kinds = [k | html.MAIN for k in kinds]
    assert gone((1, 2, 3, 8, 9), (1, 2, 3, 9)) == [1]
    assert html.shared_furniture([], [], [], [[1]]) == [] == gone()


def test_differencing_runs_on_marked_pages(spark):
    page = lambda k: f"<body><div>Site</div><article><h1>Title {k}</h1><p>{'text ' * 60}{k}</p><p><a href='/x'>More of this</a></p><p>{'shared words ' * 20}</p><p>end {k}</p></article></body>"
    rows = [(k, f"http://h.org/{k:03}", page(k)) for k in range(80)]
    got = {r["id"]: (r["text"].split("\n"), r["n_deleted"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == ([f"Title {k}", f"{'text ' * 60}{k}", ("shared words " * 20).strip(), f"end {k}"], 1) for k in range(80))
