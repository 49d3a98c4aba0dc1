"""Phrases, min-max hashing and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import corpus, frame

from tessera.llm import common, meeting, minmax, ngram_join, phrases, yinyang
from tessera.llm.shingles import Sets


# ------------------------------------------------------------------ phrases
def plain_phrases(rows, max_words, least, top):
    seen, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    seen[lang, tuple(w[i : i + k])] += 1
    out = []
    for (lang, p), a in seen.items():
        if len(p) < 2 or a < least:
            continue
        longer = [f for (x, q), f in seen.items() if x == lang and len(q) > len(p) and f >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * f >= 50 * a for f in longer):
            continue
        cuts = [(1_000_000 * a * a // (seen[lang, p[:k]] * seen[lang, p[k:]]), k, seen[lang, p[:k]], seen[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= top:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return ranked


def phrase_rows(spark, rows, **more):
    df = spark.createDataFrame([(1, t, lang, "clash", 3, 4) for t, lang in rows], "batch long, text string, lang string, phrase string, code int, id long")
    found = phrases.mine_phrases(df.repartition(3), **more).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)


@pytest.mark.parametrize("max_words, least, top", [(3, 3, 2000), (5, 3, 7)])
def test_phrases(spark, max_words, least, top):
    rng = random.Random(2)
    words = ["new", "york", "New", "Zürich", "日本", "the", "of", "a's", "x-y", "ÉTÉ", "\x00"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("one", None), (". , ;", "de"), ("New York city, new york city! new york city", "")]
    for _ in range(150):
        w = [rng.choice(words) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            w[3:3] = ["new", "york", "stock", "exchange"]
        rows.append((rng.choice([" ", "  ", "\t"]).join(x + rng.choice(["", "", "", ",", ".\n", "?"]) for x in w), rng.choice(["en", "de", None, ""])))
    rows += rows[20:30]  # repeated rows count again
    rows.append((" ".join(rng.choice(words) for _ in range(5000)), "en"))
    assert phrase_rows(spark, rows, max_words=max_words, least=least, top=top) == sorted(plain_phrases(rows, max_words, least, top))


def test_phrases_of_many_batches_and_none(spark, monkeypatch):
    rows = [("alpha beta gamma. " * 3, "en")] * 30 + [("alpha beta", "de")] * 12
    assert phrase_rows(spark, rows, least=10) == sorted(plain_phrases(rows, 3, 10, 2000))
    assert phrase_rows(spark, rows, least=1000) == []
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.mine_phrases(empty).collect() == []


def test_scores_pass_64_bits(spark):
    big = 3 * 10**14
    got = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 7).alias("l"), F.lit(big + 9).alias("r")).select(phrases._score("a", F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert got == big * big * 1_000_000 // ((big + 7) * (big + 9))


# ------------------------------------------------------------------ min-max hashing
def word_sets(docs, k):
    out = {}
    for i, text in docs.items():
        w = brute.BLANK.findall(brute.lower(text))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def plain_components(docs, k, percent):
    sets = word_sets(docs, k)
    ids = sorted(docs)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k, percent", [(4, 80), (2, 80)])
def test_near_duplicates(spark, k, percent):
    docs = corpus(5, 160)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(frame(spark, docs), k, percent).collect()}
    assert got == plain_components(docs, k, percent)


def test_near_duplicates_special_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h"), (None, "g h"), (None, None), (7, ""), (7, "G  h"), (9, "one"), (8, "ONE")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, node long, sigs string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["is_first"]) for r in minmax.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True)] * 2 + [(1, 1, None, False), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 1, None, False), (9, 1, 8, False), (8, 1, 8, True)], key=repr)
    assert minmax.near_duplicates(df.limit(0)).collect() == []


def test_estimates_are_unbiased():
    """Equal first and last values are as frequent as the sets are similar."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words[:300]), " ".join(words[50:350])
    s = Sets(pa.array([a, b]), 1, None)
    low, high = minmax.min_max(s, 1024)
    assert (low <= high).all()
    for v in (low, high):
        assert abs((v[0] == v[1]).mean() - 250 / 350) < 0.06
    assert (minmax.bands(low[:, :64], 1)[0] == minmax.bands(low[:, :64], 1)[1]).mean() < 1


def spread_group(m, words=120):
    """m texts that differ in one word each."""
    base = [f"b{i}" for i in range(words)]
    return {i: " ".join([*base[: i % words], f"x{i}", *base[i % words + 1 :]]) for i in range(m)}


@pytest.mark.parametrize("join", [ngram_join.similarity_components, minmax.near_duplicates])
def test_group_of_near_copies_makes_few_pairs(spark, monkeypatch, join):
    """A group larger than a block is one component, and its pairs grow as its rows do."""
    made = {}
    whole = meeting._links

    def counted(pairs, *rest):
        pairs = pairs.persist()
        made[m] = made.get(m, 0) + pairs.distinct().count()
        return whole(pairs, *rest)

    monkeypatch.setattr(meeting, "_links", counted)
    monkeypatch.setattr(meeting, "BLOCK_SETS", 64)
    for m in (300, 900):
        docs = spread_group(m) | {-5: "quite another text of a few words", 10_000: None}
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in join(df).collect()}
        assert got == {i: (0 if 0 <= i < m else i) for i in docs}
    assert made[900] <= 3.5 * made[300]


def test_links_that_no_hub_finds(spark, monkeypatch):
    """Without turns all pairs are compared in blocks; the components are the same."""
    docs = corpus(11, 120)
    monkeypatch.setattr(meeting, "TURNS", 0)
    monkeypatch.setattr(meeting, "BLOCK_SETS", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(frame(spark, docs)).collect()}
    assert got == plain_components(docs, 4, 80)


# ------------------------------------------------------------------ vector codes
def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    d = len(kept[0][1]) // parts
    cut = [[tuple(v[p * d : p * d + d]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    codes = nearest()
    errors = [sum(dist(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in code), e, by_label[label], sha) for (i, _, label), code, e in zip(kept, codes, errors))


def coded(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", b"z") for r in rows], "vec_id long, embedding array<float>, label int, part string, x binary")
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in yinyang.compress(df.repartition(3), **more).collect())


@pytest.mark.parametrize("entries", [256, 20])
def test_vector_codes(spark, entries):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(7 * i - 100, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([0, 1, 1, 1, None])) for i in range(300)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [None] * 8, 1), (9003, [float("nan")] + [0.0] * 7, 1), (9004, [float("inf")] * 8, 1), (9005, [0.0] * 8, 1), (9006, [0.0] * 8, None)]
    rows += [(9100 + i, rows[3][1], 0) for i in range(40)]  # ties: entries of equal parts
    rows += [(rows[5][0], rows[5][1], 1)]  # a repeated id
    assert coded(spark, rows, entries=entries) == plain_codes(rows, entries=entries)


def test_few_and_no_vectors(spark):
    rows = [(3, [1.0, -2.0, 0.5, -0.0005], None), (1, [0.0] * 4, 2)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError):
        coded(spark, [(1, [1.0] * 6, 1)])
    with pytest.raises(ValueError):
        coded(spark, [(1, [1e30] * 8, 1)])


def test_bounds_never_lose_the_nearest_entry():
    """Rounds by bounds give the codes of full comparisons, ties included, and compute fewer distances."""
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (4000, 6)) + 100 * rng.integers(0, 12, (4000, 1))
    x[::7] = x[3]
    book = yinyang.Codebook(x[:64].copy(), yinyang.grouped(x[:64]), np.zeros(64))
    code, upper, lower = yinyang.assign_all(x, book)
    for _ in range(6):
        entries = book.entries.copy()
        for e in range(64):
            if (code == e).any():
                entries[e] = x[code == e].sum(axis=0) // (code == e).sum()
        moved = np.sqrt(((entries - book.entries) ** 2).sum(axis=1)) * (1 + 1e-12)
        book = yinyang.Codebook(entries, book.group, moved)
        code, upper, lower, looked = yinyang.assign_again(x, book, code, upper, lower)
        d2 = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == d2.argmin(axis=1)).all()
        assert looked < 0.8 * d2.size
        d = np.sqrt(d2)
        assert (upper >= d[np.arange(len(x)), code]).all()
        d[np.arange(len(x)), code] = np.inf
        for g, m in enumerate(book.members):
            assert (lower[:, g] <= d[:, m].min(axis=1)).all()


def test_large_components_are_exact():
    x = np.array([[2**29, -(2**29)], [2**29 - 1, 5]], np.int64)
    assert (yinyang.squares(x, x) == np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x])).all()
