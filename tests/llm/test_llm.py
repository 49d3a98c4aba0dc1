"""Each corpus operator against a plain version, on texts with nulls, blanks, repeats, long texts and copies."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from math import log10

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fmindex, hilbert, lines, ngram_join, quality, rans, sharding, substring, trie_lm

SCHEMA = "doc_id long, text string, lang string, n_words string, score double, shard int"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "the", "THE", "a's", "x|y", "don't", "日本", "12.5%", "<|endoftext|>"]
    passage = " ".join(rng.choice(words) for _ in range(45))
    texts = [None, "", " \n\t ", "one", "one two", "one two", "The one\nthe one\n\nthe one", "a b c d e f g h", passage, "x" * 5000 + "  " + "y z q" * 40, " lead and trail  "]
    while len(texts) < n - 6:
        kind = rng.random()
        if kind < 0.25 and len(texts) > 20:  # near copies
            w = (rng.choice(texts) or "").split(" ")
            if w and rng.random() < 0.8:
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.4:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) + "\n" + passage + rng.choice(["", " tail"]))
        elif kind < 0.5:
            texts.append(" ".join([rng.choice(words)] * rng.randrange(2, 60)))
        else:
            texts.append(rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(200))))
    texts.append(" ".join(rng.choice(words) for _ in range(6000)))  # a very long one
    return {3 * i - 50: t for i, t in enumerate(texts)}


def frame(spark, docs):
    rows = [(i, t, None, "clash", 0.5, 7) for i, t in docs.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return corpus()


RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# ------------------------------------------------------------------ quality classifier
def test_quality(spark):
    rng = random.Random(3)
    good = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) for i in range(0, 300, 2)}
    bad = {i: " ".join(["SPAM!!"] * 40 + [str(rng.random())]) for i in range(1, 300, 2)}
    df = frame(spark, {**good, **bad, 1000: None, 1001: ""})
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(200)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    w = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, w).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i in good) for i in range(200, 300))
    assert got[1000] == got[1001]
    again = quality.fit(df.repartition(7), labels)
    assert np.array_equal(w, again)
    assert quality.with_score(df, w, "extra").columns[-1] == "extra"
    assert quality.score(empty(spark), w).count() == 0
    assert quality.score(df, quality.fit(df, labels.limit(0))).count() == 302


def test_quality_updates():
    """Weights against follow-the-regularised-leader in plain Python."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["red", "Blue!", "12", "green", "green"]) for _ in range(rng.randrange(12))) for _ in range(40)]
    y = np.array([float("Blue!" in t) for t in texts])
    f = quality.Features(pa.array(texts), bits=10)
    got = quality.train([(f, y)], bits=10, epochs=3)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - (quality.L1 if z[i] > 0 else -quality.L1)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for p in range(3):
        for i in np.random.default_rng(p).permutation(len(y)):
            row = [(int(s), float(np.float32(v))) for s, v in zip(f.slot[f.bound[i] : f.bound[i + 1]], f.value[f.bound[i] : f.bound[i + 1]])] + [(1 << 10, float(np.float32(quality.HABIT)))]
            w = {s: weight(s) for s, _ in row}
            p1 = 1 / (1 + np.exp(-sum(w[s] * v for s, v in row)))
            old = dict(n)
            for s, v in dict(row).items():
                g = (p1 - y[i]) * v
                z[s] += g - ((old.get(s, 0) + g * g) ** 0.5 - old.get(s, 0) ** 0.5) / quality.ALPHA * w[s]
                n[s] = old.get(s, 0) + g * g
    assert got == pytest.approx([weight(i) for i in range((1 << 10) + 1)], abs=2e-3)


def test_quality_ties_and_long_texts(spark):
    """Equal texts have equal scores, whatever their ids; a very long text is scored whole."""
    df = spark.createDataFrame([(1, "good words here"), (2, "good words here"), (None, "good words here"), (3, "bad " * 50_000 + "end"), (4, "bad " * 50_000)], "doc_id long, text string")
    w = quality.fit(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    got = [(r["doc_id"], r["score"]) for r in quality.score(df, w).collect()]
    assert len({s for i, s in got if i in (1, 2, None)}) == 1 and dict(got)[3] < 0.5 < dict(got)[1]


# ------------------------------------------------------------------ line dedup
def test_lines(spark, docs):
    got = {r["doc_id"]: r for r in lines.dedupe_lines(frame(spark, docs)).collect()}
    want = brute.line_removals(docs)
    for i, t in docs.items():
        assert got[i]["text"] == (None if t is None else "\n".join(want[i])), i
        assert got[i]["n_removed"] == (0 if t is None else t.count("\n") + 1 - len(want[i]))
        assert got[i]["shard"] == 7
    assert lines.dedupe_lines(empty(spark)).count() == 0


def test_lines_repeated_rows(spark):
    rows = [(1, "a b c\na b c"), (1, "a b c\na b c"), (None, "a b c"), (None, None), (2, "z z\n")]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, "", 2), (1, "", 2), (None, "a b c", 0), (None, None, 0), (2, "z z\n", 0)], key=repr)


LIKE_CRC = ("alpha 47219 beta gamma delta 330533", "alpha 143238 beta gamma delta 1002666")  # one CRC-32


def test_lines_rows_with_like_checksums(spark):
    rows = [(1, "p q r s t\n" + LIKE_CRC[0]), (7, LIKE_CRC[0]), (7, LIKE_CRC[1]), (None, LIKE_CRC[1]), (-(1 << 63), "only here")]
    got = sorted(((r["doc_id"], r["text"]) for r in lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, rows[0][1]), (7, ""), (7, ""), (None, LIKE_CRC[1]), (-(1 << 63), "only here")], key=repr)


def test_lines_long_and_near(spark, monkeypatch):
    """Lines of every class of lengths, each with near copies, and a group of many near copies."""
    rng = random.Random(4)
    docs, words = {}, [f"v{i}" for i in range(6000)]
    for k, n in enumerate([6, 30, 90, 97, 130, 380, 420, 1500, 1700, 3000]):
        base = rng.sample(words, n)
        for j, share in enumerate((0, 0.05, 0.1, 0.12, 0.3)):
            near = [w if rng.random() >= share else rng.choice(words) for w in base]
            docs[100 * k + j] = " ".join(near[: n - int(0.5 * share * n)]) + "\nshared tail of five words here"
    base = rng.sample(words, 40)
    for j in range(150):
        near = list(base)
        for _ in range(rng.randrange(5)):
            near[rng.randrange(40)] = rng.choice(words[:50])
        docs[5000 + j] = " ".join(near)
    monkeypatch.setattr(lines, "STAR_BUCKET_LOG2", 4)
    got = {r["doc_id"]: r["text"] for r in lines.dedupe_lines(frame(spark, docs)).collect()}
    want = brute.line_removals(docs)
    assert got == {i: "\n".join(want[i]) for i in docs}


def test_line_sketches(spark):
    """Every lane against a plain count of bits, and the same when folded."""
    rng = random.Random(2)
    rows = [([rng.randrange(1 << 40) for _ in range(n)],) for n in (1, 50, 77, 78, 96, 100, 330, 1500, 2000)]
    df = spark.createDataFrame(rows, "t array<long>").withColumn("n", F.size("t"))
    df = df.withColumn("s", lines.sketches(F.col("t"), F.col("n"), 80))
    widths = []
    for r in df.collect():
        k = len(r["s"])
        widths.append(k)
        want = [0] * k
        for t in r["t"]:
            want[(t >> 6) % k] ^= 1 << (t & 63)
        assert [x % (1 << 64) for x in r["s"]] == want
    assert widths == [1, 1, 1, 4, 4, 4, 16, 64, 64]
    four = df.where(F.size("s") == 16).select("s", *[lines._lane(F.col("s"), i, 4).alias(f"f{i}") for i in range(4)]).first()
    assert all(four[f"f{i}"] == four["s"][i] ^ four["s"][i + 4] ^ four["s"][i + 8] ^ four["s"][i + 12] for i in range(4))


def test_lines_compare_without_lambdas(spark):
    """Spark interprets a lambda with all that is in it: lines met their hubs there, and a text was split for each line asked for."""
    plans = {}

    class Kept:
        def save(self, df, name):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return df

    first = "first struct<id: bigint, pos: int, h: bigint>"
    sets = spark.createDataFrame([], f"key bigint, {first}, copies bigint, n int, prefix array<bigint>, sketch array<bigint>")
    stars = lines._stars(sets, 80)
    assert "filter(" not in stars._jdf.queryExecution().optimizedPlan().toString()
    keys = spark.createDataFrame([(1, 2, "a b\nc d")], "id bigint, h bigint, text string")
    lines._similar(stars, sets, keys, lambda line: F.array(F.xxhash64(line)), 80, Kept(), "some")
    assert "split(" in plans["some-tokens"] and not re.search(r"lambdafunction\([^\n]*split\(", plans["some-tokens"])


def test_lines_meet_hubs_by_any_width_of_sketch(spark):
    """Sketches of one, four, 16 and 64 lanes: pairs are those of a plain fold."""
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(64)]
    rows = []
    for k, lanes in enumerate([1, 1, 4, 4, 16, 16, 64, 64, 1, 4, 16, 64]):
        sketch = [functools.reduce(lambda a, b: a ^ b, base[i::lanes]) ^ (k % 3) for i in range(lanes)]
        rows.append((k, (k, 0, 0), 1, 50 + k, [7], sketch if k < 10 else [rng.getrandbits(63) for _ in range(lanes)]))
    sets = spark.createDataFrame(rows, "key bigint, first struct<id: bigint, pos: int, h: bigint>, copies bigint, n int, prefix array<bigint>, sketch array<bigint>")
    got = {tuple(r) for r in lines._stars(sets, 80).collect()}
    xor = lambda s: functools.reduce(lambda a, b: a ^ b, s)
    four = lambda s: [xor(s[i::4]) for i in range(4)] if len(s) > 1 else s
    want = set()
    for like in {int(4 * math.log(r[3])) for r in rows}:
        bucket = [r for r in rows if int(4 * math.log(r[3])) == like]
        for at, (x, _, _, n, _, s) in enumerate(bucket):
            for y, _, _, m, _, o in bucket[: min(at, lines.STAR_HUBS)]:
                both = len(s) > 1 and len(o) > 1
                gap = sum((a ^ b).bit_count() for a, b in zip(four(s), four(o))) if both else (xor(s) ^ xor(o)).bit_count()
                if 100 * min(n, m) >= 80 * max(n, m) and 20 * (n + m) >= 180 * (1 if (n + m) % 2 else 2) and 180 * gap <= 20 * (n + m):
                    want.add((x, y))
    assert got == want and len(want) > 3


def test_lines_clashing_names(spark):
    rows = [(1, "a b", 9, "x", "y"), (2, "a b", 8, "z", "w")]
    out = lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, __id string, __gone string")).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed", "__id", "__gone"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 1, 0, "x", "y"), (2, "", 1, 1, "z", "w")]


# ------------------------------------------------------------------ token files
def test_token_files(spark, docs, tmp_path):
    rans.write_token_files(frame(spark, docs), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rans.read_token_files(spark, f"file://{tmp_path}/t").collect()}
    assert got == brute.token_files(docs)


def test_token_files_odd_tables(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rans.write_token_files(empty(spark), path, f"file://{tmp_path}/e")
    assert rans.read_token_files(spark, f"file://{tmp_path}/e").count() == 0
    rows = spark.createDataFrame([(None, "b"), (1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    rans.write_token_files(rows, path, f"file://{tmp_path}/n")
    got = rans.read_token_files(spark, f"file://{tmp_path}/n").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1] and got[-1]["start"] + got[-1]["n_tokens"] == sum(r["n_tokens"] for r in got)


@pytest.mark.parametrize("n", [0, 1, rans.LANES - 1, rans.LANES, 3 * rans.LANES + 5, rans.LANES * rans.CHECKPOINT_STEPS * 2 + 17])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint32)
    t = rans.Table(np.bincount(ids, minlength=50_257) + (np.arange(50_257) == 3))
    words, marks = rans.encode_ids(ids, t)
    assert np.array_equal(rans.decode_ids(words, marks, n, t), ids)
    raw = rans.pack_block(5, np.array([1]), np.array([1]), np.array([n]), ids, t)
    assert np.array_equal(rans.unpack_block(raw, t)[4], ids)
    if n > rans.LANES:
        with pytest.raises(ValueError):
            rans.unpack_block(raw[:-1] + bytes([raw[-1] ^ 1]), t)


# ------------------------------------------------------------------ n-gram Jaccard join
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_components(spark, docs, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(frame(spark, docs), k, percent).collect()}
    assert got == brute.jaccard_components(docs, k, percent)


def test_components_frequent_tokens(spark, monkeypatch):
    """Many long sets over few tokens: pairs of frequent tokens index them."""
    rng = random.Random(5)
    base = [rng.choice([f"t{i}" for i in range(30)]) for _ in range(400)]
    docs = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(400)] = f"t{rng.randrange(30)}"
        docs[i] = " ".join(w)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_TIMES", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(frame(spark, docs)).collect()}
    assert got == brute.jaccard_components(docs)


def test_components_odd_tables(spark):
    assert ngram_join.similarity_components(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, None), (7, ""), (8, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.similarity_components(rows).where("doc_id is not null").select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(5, 2, None), (5, 2, None), (6, 0, 6), (7, 0, 7), (8, 0, 8)]


def test_components_every_row_twice(spark):
    """Groups of a signature in which each node came twice are still told apart."""
    rng = random.Random(11)
    docs = {}
    for i in range(0, 60, 2):
        docs[i] = " ".join(f"v{rng.randrange(5000)}" for _ in range(50))
        docs[i + 1] = docs[i] + " tail"
    rows = [(i, t) for i, t in docs.items()] * 2 + [(None, "p q r s"), (None, "p q r s")]
    found = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert len(found) == len(rows) and got.pop(None) == (2, None)
    assert got == brute.jaccard_components(docs) and all(c == i - i % 2 for i, (_, c) in got.items())


# ------------------------------------------------------------------ nearest neighbours
def test_hilbert_curve_is_a_path():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 8)).round(3)
    v[10:40] = v[10]  # copies
    rows = [(i, [float(x) for x in v[i]], "c") for i in range(400)]
    odd = [(900, None, "c"), (901, [0.0] * 8, "c"), (902, [float("nan")] + [1.0] * 7, "c"), (903, [None] + [1.0] * 7, "c"), (904, [1.0], "c"), (None, [1.0] * 8, "c"), (5, rows[5][1], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in hilbert.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        s = v @ v[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [i for i, _ in found] == want
        assert np.allclose([x for _, x in found], s[want])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, score string")
    assert hilbert.nearest(few, lambda i: i % 20 == 0).count() == 2
    assert hilbert.nearest(few.limit(0), lambda i: i % 20 == 0).count() == 0


def test_nearest_recall(spark):
    v = np.random.default_rng(1).standard_normal((3000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    hits = 0
    for r in hilbert.nearest(df, lambda i: i % 100 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        s = v @ v[r["query_id"]]
        s[r["query_id"]] = -1e9
        hits += len(set(np.argsort(-s)[:20]) & set(r["ids"]))
    assert hits / (30 * 20) >= 0.9


def test_nearest_recall_unequal_norms(spark):
    """One very long vector leaves the order of the others as it is; norms with a long tail lose nothing."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((16_000, 64))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    for norms in (np.where(np.arange(len(v)) == 7, 100.0, 1.0), np.exp(rng.standard_normal(len(v)))):
        long = v * norms[:, None]
        df = spark.createDataFrame([(i, r) for i, r in enumerate(long.tolist())], "vec_id long, embedding array<double>")
        hits = 0
        for r in hilbert.nearest(df, lambda i: i % 400 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
            s = long @ long[r["query_id"]]
            s[r["query_id"]] = -np.inf
            hits += len(set(np.argsort(-s)[:20]) & set(r["ids"]))
        assert hits / (40 * 20) >= 0.9


# ------------------------------------------------------------------ language model
def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1 << 40), (1000, 1 << 20), (5000, 5000), (300, 1 << 52)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        e = trie_lm.EliasFano(n, *trie_lm.EliasFano.encode(values, universe))
        if n:
            assert np.array_equal(e.get(np.arange(n)), values)
        keys = np.concatenate((values, rng.integers(0, universe, 200).astype(np.uint64)))
        at = e.find(keys)
        known = set(values.tolist())
        assert all((k in known) == (p >= 0) for k, p in zip(keys.tolist(), at.tolist()))
        assert np.array_equal(values[at[at >= 0]], keys[at >= 0])


def test_lm(spark, docs):
    training = lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 1
    got = {r["doc_id"]: r for r in trie_lm.score_texts(frame(spark, docs), training).collect()}
    for i, (held, n, known, total, base) in brute.unigram_base(docs).items():
        r = got[i]
        assert (not r["training"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert trie_lm.score_texts(empty(spark), training).count() == 0
    none = trie_lm.score_texts(frame(spark, {1: "a b", 2: None}), lambda i: i < 0).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"]) for r in none] == [(3, 0), (1, 0)]


@pytest.mark.parametrize("least,tokens", [(64, 2_000_000), (2, 50)])
def test_lm_scores(spark, docs, monkeypatch, least, tokens):
    """Against a plain model; with frequent words, and with shards that several tasks read."""
    monkeypatch.setattr(trie_lm, "FREQUENT_LEAST", least)
    monkeypatch.setattr(trie_lm, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(trie_lm, "BATCH_BYTES", 4000)
    training = lambda i: F.pmod(i, F.lit(3)) != 1
    got = {r["doc_id"]: r for r in trie_lm.score_texts(frame(spark, docs), training).collect()}
    want = brute.bigram_scores(docs, lambda i: i % 3 != 1)
    assert got.keys() == want.keys()
    for i, score in want.items():
        assert got[i]["score"] == pytest.approx(score, rel=1e-4, abs=1e-4), i


def test_lm_odd_rows(spark):
    """Ids that are null or occur twice: each row by itself."""
    rows = [(None, "alpha beta"), (None, "gamma"), (None, None), (5, "alpha 47219 beta gamma delta 330533"), (5, "alpha 143238 beta gamma delta 1002666"), (5, "gamma"), (5, "gamma")]
    got = trie_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: i == 5).collect()
    # training: five words and the end, twice, and gamma and the end, twice
    assert sorted(((r["doc_id"], r["training"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=repr) == sorted([(None, False, 3, 3, 18), (None, False, 2, 2, 18), (None, False, 1, 1, 18), (5, True, 7, 7, 18), (5, True, 7, 7, 18), (5, True, 2, 2, 18), (5, True, 2, 2, 18)], key=repr)
    plain = {i: t for i, (_, t) in enumerate(rows)}
    want = sorted(brute.bigram_scores(plain, lambda i: i > 2).values())
    assert sorted(r["score"] for r in got) == pytest.approx(want, rel=1e-4)


def test_lm_pairs_seen_once(spark):
    """Of texts of the same words the one whose pairs were seen once scores higher."""
    words = [f"k{i}" for i in range(12)]
    texts = {2: " ".join(words), 4: " ".join(words[::-1] + ["z"]), 1: "k0 k1 k2 k3", 3: "k0 k2 k3 k1"}
    got = {r["doc_id"]: r for r in trie_lm.score_texts(frame(spark, texts), lambda i: i % 2 == 0).collect()}
    assert got[1]["base_score"] == pytest.approx(got[3]["base_score"])
    assert got[1]["score"] > got[3]["score"] + 0.1


def test_lm_words_with_like_hashes(spark):
    """The hashes of c3744552 and c2007633 share their first 40 bits, as those of c3462356 and c901651."""
    texts = {2: "c3744552 c3462356 c901651 c901651", 4: "x c3462356", 1: "c2007633 c3744552 c901651", 3: "y x c901651 c2007633"}
    held = lambda i: i % 2 == 0
    got = {r["doc_id"]: r for r in trie_lm.score_texts(frame(spark, texts), held).collect()}
    c = Counter(w for i in (2, 4) for w in [*texts[i].split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        ws = [*t.split(), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert abs(got[i]["base_score"] - sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6


# ------------------------------------------------------------------ substring dedup
@pytest.mark.parametrize("seed", [0, 1])
def test_repeats(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute.repeats(docs)


def test_repeats_spans_and_odd_tables(spark):
    words = " ".join(f"v{i}" for i in range(30))
    rows = spark.createDataFrame([(1, words), (1, words), (2, "x " + words + " y"), (None, words), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in substring.remove_repeats(rows).collect()), key=repr)
    assert got == sorted([(1, 30, [(0, 30)]), (1, 30, [(0, 30)]), (2, 30, [(1, 31)]), (None, 0, []), (3, 0, [])], key=repr)
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_prefix_groups():
    counts = np.zeros(substring.PREFIX_SLOTS, np.int64)
    counts[:1000], counts[5], counts[9] = 10, 100_000, 2_000
    first, spread, words = substring.prefix_groups(counts, 64)
    budget = counts.sum() // 64
    load = {}
    for s in range(1000):
        if spread[s] == 1:
            load[first[s]] = load.get(first[s], 0) + counts[s]
    assert max(load.values()) <= budget and words[5] == 0 and words[9] in (2, 4) and spread[5] > 32


# ------------------------------------------------------------------ BPE
def test_bpe(spark, docs):
    out = bpe.bpe_decode(bpe.bpe_encode(frame(spark, docs), RANKS, PATTERN), RANKS, PATTERN)
    got = {r["doc_id"]: (r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in out.collect()}
    assert got == brute.bpe(docs)
    assert bpe.bpe_encode(empty(spark), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_bpe_joins(leaf):
    codec = bpe.TreeCodec(RANKS, PATTERN, leaf=leaf, window=1)
    whole = brute.tiktoken_encoding()
    rng = random.Random(leaf)
    parts = [" ", "  ", "\n", "\t\n", "'", "'s", "'ll", "a", "Ab", "été", "日", "12", "!", " ", " ", "\x1c", "don't", "🙂"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        ids = codec.encode(text)
        assert ids.tolist() == whole.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_texts_are_joined(docs, monkeypatch):
    """Production parameters: every text longer than a leaf goes through joins, one less than it has leaves."""
    coder, joins = bpe.TreeCodec(RANKS, PATTERN), []
    own = bpe.TreeCodec._join
    monkeypatch.setattr(bpe.TreeCodec, "_join", lambda self, *a: joins.append(1) or own(self, *a))
    long = [t for t in docs.values() if t and len(t) > bpe.LEAF_CHARS]
    assert len(long) > 20
    for text in long:
        joins.clear()
        coder.encode(text)
        assert len(joins) >= len(text) / bpe.LEAF_CHARS - 1


def test_pieces_are_independent():
    """The token files' memo splits where every byte-level splitting does."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, whole = rans.UnitEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "'", "'s", "'re", "a", "Ab", "été", "日", "12", "!", "!!", " ", " ", "\x1c", "<|endoftext|>", "<|", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    ids, sizes = enc.encode(pa.chunked_array([pa.array(texts)]))
    for t, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


# ------------------------------------------------------------------ decontamination
def test_contamination(spark, docs, monkeypatch):
    items = {1: docs[-50 + 3 * 8], 2: "one two", 3: None, 4: "", 5: "w1 w2 w3", 6: docs[-50 + 3 * 8], 11: "ÉTÉ the"}
    table = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(None, "one", 1), (2, "one two", 1)], "item_id long, text string, spans int")
    want = brute.contamination(docs, items)

    def check():
        for r in fmindex.find_contamination(frame(spark, docs), table).collect():
            n, hit, found, digest, _ = want[r["doc_id"]]
            assert (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["items"])) == (n, hit, found)
            assert hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest() == digest

    check()
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 5)  # several passes
    check()
    assert fmindex.find_contamination(empty(spark), table).count() == 0
    assert all(r["items"] == [] for r in fmindex.find_contamination(frame(spark, docs), table.limit(0)).collect())


def test_fm_index():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 500)
    index = fmindex.FMIndex(text, 6)
    phrases = [text[a : a + n] for a in range(0, 480, 7) for n in (1, 3, 9)] + [np.array([4, 4, 4, 4, 4, 4, 4, 4, 4])]
    table = np.zeros((len(phrases), 9), np.int64)
    for i, p in enumerate(phrases):
        table[i, 9 - len(p) :] = p
    lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, z in zip(phrases, lo, hi):
        want = [i for i in range(500 - len(p) + 1) if np.array_equal(text[i : i + len(p)], p)]
        assert sorted(index.locate(np.arange(a, z)).tolist()) == want


# ------------------------------------------------------------------ sharding
def test_sharding(spark, docs):
    got = {r["doc_id"]: r for r in sharding.assign_shards(frame(spark, docs), 7).collect()}
    for i, t in docs.items():
        raw = (t or "").encode()
        assert (got[i]["shard"], got[i]["grown_shard"]) == (brute.jump(i, 7), brute.jump(i, 8))
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert got[i]["grown_shard"] in (got[i]["shard"], 7)
    for s in range(7):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(empty(spark)).count() == 0
    odd = sharding.assign_shards(spark.createDataFrame([(None, None), (2**62, "a"), (2**62, "a"), (-(2**63), "b")], "doc_id long, text string"), 40).collect()
    assert {r["shard"] for r in odd if r["doc_id"] == 2**62} == {brute.jump(2**62, 40)} and {r["shard"] for r in odd if r["doc_id"] == -(2**63)} == {brute.jump(-(2**63), 40)}


# ------------------------------------------------------------------ pipeline
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_input(spark, path):
    rng = random.Random(0)
    vocabulary = [f"v{i}" for i in range(400)]
    item = " ".join(rng.choice(vocabulary) for _ in range(20))
    docs = {i: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(3)) for i in range(60)}
    docs |= {i: " ".join(["BUY!!"] * 100 + [str(i)]) for i in range(60, 90)}
    docs[90] = docs[0].replace("\n", " ") + " extra words here"  # a near copy, but of no line
    docs[91] = item + " " + item
    docs[92], docs[93] = None, ""
    docs[94] = docs[7].split("\n")[1] + "\n" + " ".join(f"u{i}" for i in range(30))  # a repeated line
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, {1: item}


def test_pipeline(spark, tmp_path):
    """Each stage against its plain version, on all that the stage before it kept."""
    import corpus_pipeline
    from test_mining import plain_components

    docs, items = pipeline_input(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    w = quality.fit(table, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    scores = {r["doc_id"]: r["score"] for r in quality.score(table, w).collect()}
    docs = {i: t for i, t in docs.items() if scores[i] >= corpus_pipeline.QUALITY_THRESHOLD}
    assert set(range(60)) <= set(docs) and not set(range(60, 90)) & set(docs)
    docs = {i: "\n".join(x) for i, x in brute.line_removals(docs).items()}
    assert docs[94].startswith("u0 ")
    groups = plain_components(docs, 5, 80)
    assert groups[90][1] == 0
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    hits = brute.contamination(docs, items)
    assert hits[91][-1]
    docs = {i: t for i, t in docs.items() if not hits[i][-1]}
    want = {i: (x[0], x[2]) for i, x in brute.bpe(docs).items()}
    got = {r["doc_id"]: (r["n_tokens"], r["text_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Clashing columns, null ids, repeated rows and an empty table, stage by stage."""
    import corpus_pipeline

    docs, _ = pipeline_input(spark, tmp_path)
    more = {c: F.lit(i) for i, c in enumerate(("__score", "score", "__id", "id", "__hash", "hash", "__key", "key", "node", "_score"))}
    rows = [(None, docs[3], "en", "s", 1), (None, None, "en", "s", 0), (5, docs[5], "en", "s", 1), (5, docs[5], "en", "s", 1)]
    odd = spark.createDataFrame(rows, DOCUMENTS).withColumns(more)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), str(tmp_path))
        assert out.collect() == []
        got = stage(spark, odd, str(tmp_path)).collect()
        assert len(got) == {"near_duplicates": 3}.get(name, 4), name
        if name != "tokens":
            assert out.columns == odd.columns
            assert all(r[c] == i for r in got for i, c in enumerate(more))


def test_other_results_outlive_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    pipeline_input(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lazy = [lines.dedupe_lines(docs), ngram_join.similarity_components(docs), substring.remove_repeats(docs), corpus_pipeline.run(spark, str(tmp_path))]
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert [df.count() for df in lazy] == [95, 95, 95, n]


def test_pipeline_near_duplicates_under_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    base = [" ".join(f"n{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    rows = [(0, base[0]), (1, base[0] + " copy"), (1, base[1]), (7, base[2]), (7, base[2] + " copy"), (8, base[3]), (8, base[4]), (9, base[4] + " copy"), (10, base[5]), (10, base[5]), (11, ""), (12, ""), (13, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept)) == 9
    assert sum(i == 7 for i, _ in kept) == 1
    assert {x for x in kept if x[0] != 7} == {(0, base[0]), (1, base[1]), (8, base[3]), (8, base[4]), (10, base[5]), (11, ""), (12, ""), (13, None)}


# ------------------------------------------------------------------ rows that share an id
@pytest.mark.parametrize("times", [2, 3])
def test_components_of_repeated_rows(spark, times):
    docs = corpus(seed=8, n=60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(frame(spark, docs).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))).collect()}
    assert got == brute.jaccard_components(docs)


def test_components_of_large_groups(spark, monkeypatch):
    """A star, a path, two stars that share their leaves, loops and repeated edges; edges left fall fast from round to round."""
    from tessera.llm import common, components

    star = [(1000, k) for k in range(1001, 1400)]
    path = [(k, k + 1) for k in range(2000, 2200)]
    hubs = [(h, k) for h in (3000, 3999) for k in range(3001, 3300)]
    edges = star + path + hubs + [(7, 7), (8, 9), (9, 8), (8, 9)]
    sizes, save = [], common.Workspace.save

    def counted(self, df, name, *rest):
        out = save(self, df, name, *rest)
        if "-edges" in name:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(common.Workspace, "save", counted)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Workspace(spark, "test"))
    want = {k: 1000 for k in range(1000, 1400)} | {k: 2000 for k in range(2000, 2201)} | {k: 3000 for k in [*range(3000, 3300), 3999]} | {8: 8, 9: 8}
    assert {r["node"]: r["label"] for r in got.collect()} == want and got.count() == len(want)
    assert sizes[-1] == 0 and sum(sizes) <= 2 * sizes[0]
    none = components.connected_components(spark.createDataFrame([(5, 5)], "a long, b long"), common.Workspace(spark, "test"))
    assert none.columns == ["node", "label"] and none.count() == 0


def test_rows_of_one_id_and_checksum(spark):
    """Texts of one CRC-32 under one id, or under none, stay apart."""
    rows = [(7, LIKE_CRC[0]), (7, LIKE_CRC[1]), (None, LIKE_CRC[0]), (None, LIKE_CRC[1]), (-(1 << 63), LIKE_CRC[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["is_first"]) for r in ngram_join.similarity_components(df).collect()), key=repr)
    assert got == sorted([(7, None, False), (7, None, False), (None, None, True), (None, None, True), (-(1 << 63), None, False)], key=repr)
    long = [(i, t + " " + " ".join(f"q{k}" for k in range(20))) for i, t in rows]
    kept = [(r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(long, "doc_id long, text string")).collect()]
    assert sorted(kept, key=repr) == sorted([(None, 0), (None, 20), (-(1 << 63), 26), (7, 26), (7, 26)], key=repr)
