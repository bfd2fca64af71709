"""Whitening, cached token counts and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagline.llm import nra, tokens, whitening

tokenizers_found = pytest.importorskip("public_tokenizers")


# --- whitening ------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["plain", "low rank", "repeated values", "scales"])
def test_rank_one_updates_follow_the_covariance(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 7))
    if kind == "low rank":
        x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 7))
    if kind == "repeated values":
        x = rng.integers(-1, 2, size=(200, 7)).astype(float)
    if kind == "scales":
        x = x * 10.0 ** rng.integers(-3, 4, 7) + 1e5
    parts = [whitening.Spectrum(7) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    whole = whitening.Spectrum(7)
    for p in parts:
        whole.merge(p.n, p.mean, p.lam, p.vectors)
    scatter = np.cov(x.T, bias=True) * len(x)
    top = np.abs(scatter).max()
    assert whole.n == 200 and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.vectors @ np.diag(whole.lam) @ whole.vectors.T - scatter).max() < 1e-11 * top
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(7)).max() < 1e-12
    assert np.abs(whole.lam - np.linalg.eigvalsh(scatter)).max() < 1e-11 * top


def plain_whitened(vectors, k):
    """By id the rows, from numpy's own eigenvectors of the distinct lattice vectors."""
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=float)
    n, sums = len(fit), [sum(int(v) for v in c) for c in zip(*sorted(set(map(tuple, x))))]
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    out = []
    for v in x:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        y = (np.array(v) - np.array(sums) / n) @ u / np.sqrt(np.where(e > 1e-9 * e.sum(), e, np.nan))
        out.append([(i + 1, n, dev, abs(y[i]), max(e[i], 0) / e.sum() if e.sum() else 0.0) for i in range(min(k, len(v)))])
    return out


def whitened(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, n string, component int")
    found = whitening.whiten(df.select("vec_id", "x", "n", "component", whitening.quantised("embedding", 256).alias("v")).repartition(5), "vec_id", "v", 4)
    return found.collect()


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, .7, .1]).astype(np.float32).tolist()
    good += [good[0]] * 50 + [[0.0] * 6, [-0.0] * 6]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], []]
    rows = [(i, v, 1, "a", None) for i, v in enumerate(good + bad)]
    got = whitened(spark, rows)
    assert len(got) == 4 * len(good) and {r["vec_id"] for r in got} == set(range(len(good)))
    want = plain_whitened(good, 4)
    for r in got:
        i, n, dev, y, share = want[r["vec_id"]][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(abs(r["whitened"]) - y) < 1e-9 * (1 + y) and abs(r["explained"] - share) < 1e-10
        assert r["identity_error"] < 1e-10


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 9, [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]], [[0.5], [1.5], [4.0]], []])
def test_flat_tables(spark, vectors):
    got = whitened(spark, [(None, v, 1, "a", 2) for v in vectors])
    assert len(got) == sum(min(4, len(v)) for v in vectors)
    want = plain_whitened(vectors, 4) if vectors else []
    for r in got:
        mine = [w[r["component"] - 1] for w in want]
        assert r["n"] == mine[0][1] and r["deviation"] in {m[2] for m in mine}
        assert (r["whitened"] is None) == (r["explained"] == 0.0)
        assert r["identity_error"] < 1e-10


def test_vectors_of_two_lengths_and_of_huge_entries(spark):
    rows = [(i, [float(i), float(i * i % 7)], 1, "a", None) for i in range(9)] + [(20 + i, [float(i % 2), 3.0, 1e30], 1, "a", None) for i in range(4)]
    got = whitened(spark, rows)
    assert Counter(r["n"] for r in got) == {9: 18, 2: 12}
    assert all(r["deviation"] is not None for r in got)
    got = whitened(spark, [(0, [1e30, 0.0], 1, "a", None), (1, [-1e30, 1.0], 1, "a", None)])
    assert [r["deviation"] for r in got] == [None] * 4


# --- token counts ---------------------------------------------------------------------------------

PARTS = [" ", " ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "​", "a", "Bc", "1", "23", "'s", "'ll", ".", "!", "é", "界", "😀", "<|endoftext|>",
         "﻿", "\r\n", "\x00", "_", "x" * 90]


def odd_texts(count, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("memo", [5, 400_000])
def test_counts_by_words_are_the_library_s(memo):
    from tokenizers import Tokenizer

    path = tokenizers_found.path("byte_bpe_50k.json")
    how = tokens.version(path)
    assert tokens.cuts_at_spaces(how.data)
    texts = odd_texts(4000)
    mine = tokens.counter(how.kind, how.data, memo)
    library = Tokenizer.from_file(path)
    assert [n for i in range(0, 4000, 40) for n in mine(texts[i:i + 40])] == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def plain_counts(name, texts):
    path = tokenizers_found.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [len(library.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, tmp_path, name, monkeypatch):
    path, cache = tokenizers_found.path(name), str(tmp_path / "cache")
    texts = [t.replace("\x00", "") for t in odd_texts(60, 2)] + ["long words " * 40_000, None, ""]
    rows = [(i, t, "k", 5) for i, t in enumerate(texts)] + [(None, texts[3], "k", 5), (2, texts[2], "k", 5), (2, "other", "k", 5)] + [(9, texts[9], "k", 5)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens long")
    want = sorted(((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n)
                   for r, n in zip(rows, plain_counts(name, [r[1] or "" for r in rows]))))

    def counted(df):
        found = tokens.token_counts(df, path, cache).collect()
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found)

    assert counted(docs.limit(0)) == []
    some = docs.where("doc_id < 30")
    assert counted(some) == [w for w in want if not w[0] and w[1] < 30]
    first = spark.read.parquet(cache)
    assert first.count() == first.select("digest").distinct().count() == len({t for i, t, *_ in rows if i is not None and i < 30})
    # A stored count is believed; only texts without one are encoded and appended.
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 3)
    assert counted(docs) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})
    monkeypatch.setattr(tokens, "_encode", None)
    assert counted(docs) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})


def test_two_appends_and_two_tokenizers(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, "one two")], "doc_id long, text string")
    a, b = (tokenizers_found.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    tokens.token_counts(docs, a, cache)
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache + "2")
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache + "2")
    assert tokens.token_counts(docs, a, cache + "2").count() == 2
    tokens.token_counts(docs, b, cache)
    assert spark.read.parquet(cache).count() == 2
    with pytest.raises(ValueError):
        tokens.version("vocabulary.txt")


# --- ranked search --------------------------------------------------------------------------------

def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranks(docs, items, k=20):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    N, L = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for i, b, n in bags:
            m = 75 + 25 * n * N // L
            s = sum(c * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
                    for t, c in asked.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed=4, docs=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "x1", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(docs)]
    texts += [texts[5]] * 40 + [None, "", " ,. ", "W1 w1, w1", "the " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, texts[7]), (8, texts[8])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    return rows, [*items, (50, None), (51, "absent"), (52, ""), (53, "THE the THE"), (None, "w3 w4"), (3, "über w9")]


@pytest.mark.parametrize("shard,block,step,k", [(32_768, 200_000, 64, 20), (37, 15, 1, 20), (100, 30, 4, 3)])
def test_ranked_search(spark, monkeypatch, shard, block, step, k):
    monkeypatch.setattr(nra, "SHARD_DOCS", shard)
    monkeypatch.setattr(nra.best, "__defaults__", (step,))
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = nra.ranked(docs, asked, k, block_terms=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_ranks(rows, items, k)
    assert nra.ranked(docs.limit(0), asked).count() == 0 and nra.ranked(docs, asked.limit(0)).count() == 0


def test_bounds_stop_reading_before_the_lists_end():
    """Members and scores are settled when nothing unread can change them; ties with the last are all kept."""
    rng = np.random.default_rng(2)
    docs = 5000
    rows = [np.sort(rng.choice(docs, 2000, replace=False)) for _ in range(3)]
    impact = [rng.integers(1, 50, 2000) for _ in rows]
    for i in range(3):
        rows[i] = np.union1d(rows[i], np.arange(30))
        impact[i] = np.where(rows[i] < 30, 1000, rng.integers(1, 50, len(rows[i])))
    lists = nra.Lists(docs, np.concatenate(rows), np.repeat(np.arange(3), [len(r) for r in rows]), np.concatenate(impact))
    found, score, read = nra.best(lists, [(0, 1), (1, 2), (2, 1), (9, 1)], 10, 8)
    assert sorted(found) == list(range(30)) and set(score) == {4000} and read < 300


def test_text_lengths_beyond_64_bits_do_not_overflow():
    n = np.array([10 ** 9, 5])
    got = nra.impacts(np.array([7, 1]), n, np.array([3, 2]), 10 ** 11, 10 ** 14)
    m = [75 + 25 * int(x) * 10 ** 11 // 10 ** 14 for x in n]
    assert got.tolist() == [3 * (7 * 10 ** 9 // (7000 + 12 * m[0])), 2 * (10 ** 9 // (1000 + 12 * m[1]))]
    assert nra.weight(10, 10) >= 0
