"""Spelling variants, token counts, filter interaction."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from sieveline.llm import interaction, tokencount, variants  # noqa: E402

ODD = [None, "", " \n\t ", "x", "naïve Ünïcode text here", "word " * 3000, "a\nb\nb\n\nb", "🙂 \x00 \x1c"]


def documents(spark, texts, extra="s"):
    rows = [(k, t, "en", f"{extra}{k % 3}", "clash", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string, row long")


# --- variants ----------------------------------------------------------------


def brute_variants(rows):
    held = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if ident is None else ident}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                held[w] += 1
    n = {w: k for w, k in held.items() if k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {a: [b for b in n if b != a and near(a, b)] for a in n}
    form = {}
    for w, others in by.items():
        if others:
            best = min(others, key=lambda b: (-n[b], b))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["aaaaa", "aabaa", "lettre", "éèéèé", "Straße", "banana", "ÀÁÂÃÄ", "ooooooo"]
    texts = []
    for k in range(60):
        words = []
        for _ in range(60):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "é", "O", "b"])
            words.append("".join(w))
        texts.append(rng.choice([" ", ", ", "\n", "1", "_"]).join(words))
    frame = documents(spark, [*texts, *ODD, "longest" * 90 + " and " + "longest" * 89 + "longes"] + ["twice" * 200 + " " + "twice" * 199 + "twic"] * 4)
    frame = frame.union(frame.limit(1)).union(spark.createDataFrame([(None, "lettre lettre lettres", None, None, None, None)], frame.schema))
    got = variants.group_variants(variants.vocabulary(frame)).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert sorted(map(tuple, got.collect())) == want and any(r[1] for r in want)


def test_variants_without_words(spark):
    for texts in ([], ["a b c", None]):
        out = variants.group_variants(variants.vocabulary(documents(spark, texts)))
        assert out.count() == 0 and set(out.columns) == {"word", "form", "root", "n", "n_near", "form_n"}


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_neighbourhood_is_full_and_distinct(monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    letters = np.array(sorted(map(ord, "abé")), np.uint64)
    for words in (["aab"], ["ab", "ba"], ["éa", "ab"], ["aaaa"]):
        (places, codes), *_ = variants._by_length(words) if block > 10 else [(np.arange(len(words)), np.array([[ord(c) for c in w] for w in words], np.uint64))]
        made = defaultdict(list)
        for kind, at, hashes, counts in variants.neighbours(codes, letters):
            for w, i, c in zip(*np.nonzero(np.broadcast_to(counts, hashes.shape))):
                spelt = variants._spelt(words[w], kind, at + int(i), chr(int(letters[c])))
                made[words[w]].append(spelt)
                if spelt:
                    assert variants._ends(np.array([[ord(x) for x in spelt]], np.uint64))[0][0, -1] == hashes[w, i, c]
        for w in words:
            want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abé"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"}
            assert len(made[w]) == len(set(made[w])) and set(made[w]) == want - {w}


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    words = spark.createDataFrame([(f"word{chr(97 + a)}{chr(97 + b)}", 3 + a) for a in range(12) for b in range(12)], "word string, n long")
    want = sorted(map(tuple, variants.near_words(words).collect()))
    monkeypatch.setattr(variants, "MAX_BITS", 6)
    assert sorted(map(tuple, variants.near_words(words).collect())) == want and len(want) == 144 * 22


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"Wörter{k % 7}abcdefg hello{k}" for k in range(300))
    whole = variants.runs(text, "5")
    monkeypatch.setattr(variants, "PIECE", 50)
    assert variants.runs(text, "5") == whole


def test_chains_of_forms_reach_the_last(spark):
    words = [("x" * 6 + "a" * k + "b" * (20 - k), 3 * 2**k) for k in range(21)]
    out = {r["word"]: r for r in variants.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r["root"] for r in out.values()} == {words[-1][0]} and out[words[0][0]]["form"] == words[1][0]


# --- token counts ------------------------------------------------------------


def test_counts_equal_the_library(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "The", "don't", "we'll", "'S", "ß", "é", "é", "日本", "١٢", "½", "🙂", "12", "3", "<|endoftext|>", "<|", "|>", ".", ",,", "-", "​", "\r\n", "\x85", "'s"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["word", "Wörter", "it's", "a\nb", "x"]) for _ in range(50)) for _ in range(100)]
    for size in ("whole", "pieces"):
        if size == "pieces":
            monkeypatch.setattr(tokencount, "PIECE", 12)
            texts = texts[:300] + [" ".join(texts)]
        rows = [*texts, *ODD]
        frame = documents(spark, rows).drop("n").withColumnRenamed("lang", "chunk")
        frame = frame.union(frame.limit(2))
        got = tokencount.token_counts(frame, path).collect()
        want = [(k, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for k, t in [*enumerate(rows), *enumerate(rows[:2])]]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_counts_of_pieces_of_a_text_add_up(monkeypatch):
    monkeypatch.setattr(tokencount, "PIECE", 5)
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        own = tokencount.PreTokens(file.read())
    text = "one  two\n three<|endoftext|>four   \n five " * 30
    parts = [own.frequencies(p) for p in tokencount._parts(text)]
    whole = own.frequencies(text)
    assert len(parts) > 20 and sum((p[0] for p in parts), Counter()) == whole[0] and sum(p[1] for p in parts) == whole[1] == 30


def test_many_chunks(spark, monkeypatch):
    """Chunks of a few documents, so that pre-tokens meet from many chunks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{j * k % 31}" for j in range(k)) for k in range(200)]
    want = {tuple(r) for r in tokencount.token_counts(documents(spark, texts), path).collect()}
    rows = documents(spark, texts).repartition(7)
    assert {tuple(r) for r in tokencount.token_counts(rows, path).collect()} == want
    assert tokencount.token_counts(rows.limit(0), path).count() == 0


def test_vectors_survive_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        numbers, times = rng.choice(1 << 20, n, replace=False), rng.integers(1, 1 << 17, n)
        a, b = tokencount.unpacked(tokencount.packed(numbers, times))
        assert dict(zip(a.tolist(), b.tolist())) == dict(zip(numbers.tolist(), times.tolist())) and (np.diff(a) > 0).all()


# --- filter interaction ------------------------------------------------------


def brute_interaction(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = defaultdict(list)
    for ident, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else "") + ("D" if re.search("[#$%&*|]", t) else "")
        if ident is not None and any((o or "") == t and i is not None and i < ident for i, o, _ in rows):
            fails += "E"
        judged[source or ""].append((set(fails), ident in good, ident in toxic))
    out = []
    for part, docs in judged.items():
        removed_by, told = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                before, own = set(order[: step - 1]), order[step - 1]
                here = [d for d in docs if own in d[0] and not d[0] & before]
                removed_by[own] += len(here)
                told.append((part, order, step, sum(not d[0] & (before | {own}) for d in docs), len(here), sum(own in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {own} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)))
        out += [(*t, removed_by[t[1][t[2] - 1]]) for t in told]
    return sorted(out)


def test_interaction_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["plain words " * 30, "SHOUT # loud " * 3, " ".join(f"w{k}" for k in range(60)), "few words", "a | b", None, "", " ".join(f"Word{k}" for k in range(60)) + " $", "é" * 20 + " A", "\x0b\x1c # x"]
    rows = [(rng.choice([k, k, k, 3, None]), rng.choice(pool), rng.choice(["web", "wiki", None, "", "news"])) for k in range(160)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for k in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, mask string, good int")
    marks = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = interaction.outcomes(interaction.masks(docs, marks))
    assert sorted(map(tuple, got.collect())) == brute_interaction(rows, labels)
    assert interaction.outcomes(interaction.masks(docs.limit(0), marks)).count() == 0
    alone = interaction.outcomes(interaction.masks(docs.filter("source = 'web'"), marks.limit(0))).collect()
    assert len(alone) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in alone)


def test_matrices_are_32_by_600():
    columns, by = interaction.matrices()
    assert len(columns) == 600 and all(m.shape == (32, 600) for m in by.values())
    assert (by["kept"] + by["removed"] + by["redundant"] <= 1).all() and by["shapley"].max() <= 120


# --- long texts --------------------------------------------------------------

MB = 1_000_000
LONG = {
    "one word": "a" * MB,
    "words": "ab, cdefgh. " * (MB // 12),
    "spaces": " \n" * (MB // 2),
    "new words": " ".join(f"word{k}é" for k in range(MB // 10)),
    "special": "<|endoftext|>x " * (MB // 15),
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts(spark, name):
    path, text = public_tokenizers.path("byte_bpe_50k.json"), LONG[name]
    frame = documents(spark, [text, "short text here"])
    got = {r["doc_id"]: tuple(r)[1:] for r in tokencount.token_counts(frame, path).collect()}
    assert got[0] == (len(text.encode()), len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)) and got[1][1] == 3
    told = interaction.outcomes(interaction.masks(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert told.count() == 1200


def test_words_of_many_letters_are_taken_in_ranges(spark):
    """A word of 20,000 letters has two million neighbours."""
    long = "ab" * 10_000
    words = spark.createDataFrame([(long, 9), (long + "a", 3), (long[:-1], 4), ("other", 5)], "word string, n long")
    got = {r["word"]: (r["form"], r["n_near"]) for r in variants.group_variants(words).collect()}
    assert got[long] == (None, 2) and got[long + "a"] == (long, 1) and got[long[:-1]] == (long, 1) and got["other"] == (None, 0)
