"""Language model, language identification and quality classifier against plain versions."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

from sagline.llm import kneser, language, quality

SF = "/root/testdata/sf0.01"


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def plain_kneser(train, texts):
    pairs = Counter(p for t in train for p in zip(["^", *tokens(t)], tokens(t)))
    count, before, total = Counter(), defaultdict(set), Counter()
    for (a, b), c in pairs.items():
        count[b] += c
        before[b].add(a)
        total[a] += c
    kinds = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    d = kneser.discounts(kinds(pairs.values()))
    e = kneser.discounts(kinds([len(x) for x in before.values()]))
    rest = sum(e[min(len(x), 3)] for x in before.values()) / max(len(pairs), 1) if pairs else 1.0
    held = defaultdict(float)
    for (a, _), c in pairs.items():
        held[a] += d[min(c, 3)]
    n, v = sum(count.values()), len(count)

    def chance(a, b):
        k = len(before[b]) if b in before else 0
        low = (k - e[min(k, 3)]) / max(len(pairs), 1) + rest / (v + 1)
        if not total[a]:
            return low
        c = pairs[a, b]
        return (c - d[min(c, 3)]) / total[a] + held[a] / total[a] * low

    def score(t):
        own = tokens(t)
        return (len(own), sum(w in count for w in own), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own),
                sum(math.log10(chance(a, b)) for a, b in zip(["^", *own], own)))

    return [score(t) for t in texts], n, chance, [*count]


@pytest.mark.parametrize("shard_bytes", [32_000_000, 300])
def test_kneser_ney(spark, shard_bytes):
    rng = random.Random(6)
    vocabulary = ["a", "B", "été", "d", "e", "f", "g"]
    texts = [" ".join(rng.choices(vocabulary, range(1, 8), k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "new words a B", "a " * 3000]
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(3, texts[3], "y", None), (None, "a B", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, score double").repartition(4)
    learned = [t for i, t, *_ in rows if i is not None and crc32(str(i).encode()) % 5 != 1]
    model = kneser.train(docs.where(~kneser.held_out()), shard_bytes=shard_bytes)
    want, n, chance, vocabulary = plain_kneser(learned, [r[1] for r in rows])
    assert model.tokens == n
    got = kneser.perplexity(kneser.score(docs, model)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            w = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"]) == w[:2]
            assert r["base_score"] == pytest.approx(w[2], rel=1e-9) and r["score"] == pytest.approx(w[3], rel=1e-9)
            assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 1)
        else:
            assert r["held_out"]
    for a in ("^", b"a", b"unknown"):
        assert sum(chance(a, b) for b in [*vocabulary, b"unseen"]) == pytest.approx(1.0)


def plain_order_three(train, texts):
    """Chances by nested dictionaries; a text begins with two begin marks."""
    padded = [["^", "^", *tokens(t)] for t in train]
    top = Counter(g for p in padded for g in zip(p, p[1:], p[2:]))
    levels = {3: top, 2: Counter(g[1:] for g in top)}
    levels[1] = Counter(g[1:] for g in levels[2])
    d = {k: kneser.discounts([sum(c == i for c in n.values()) for i in (1, 2, 3, 4)]) for k, n in levels.items()}
    total, held = {k: Counter() for k in (1, 2, 3)}, {k: defaultdict(float) for k in (1, 2, 3)}
    for k, n in levels.items():
        for g, c in n.items():
            total[k][g[:-1]] += c
            held[k][g[:-1]] += d[k][min(c, 3)]

    def chance(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        k, below = len(g), chance(g[1:])
        if not total[k][g[:-1]]:
            return below
        c = levels[k][g]
        return (c - d[k][min(c, 3)] + held[k][g[:-1]] * below) / total[k][g[:-1]]

    return [sum(math.log10(chance(g)) for g in zip(["^", "^", *tokens(t)], ["^", *tokens(t)], tokens(t))) for t in texts], chance, levels


@pytest.mark.parametrize("shard_bytes", [32_000_000, 300])
def test_kneser_ney_order_three(spark, shard_bytes):
    rng = random.Random(16)
    texts = [" ".join(rng.choices(["a", "B", "été", "d", "e", "f", "g"], range(1, 8), k=rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "new words a B", "a " * 3000, "a d a d g " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    learned = [t for i, t in enumerate(texts) if crc32(str(i).encode()) % 5 != 1]
    want, chance, levels = plain_order_three(learned, texts)
    assert max(levels[3].values()) > 255
    for r in kneser.score(docs, kneser.train(docs.where(~kneser.held_out()), shard_bytes=shard_bytes, order=3)).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)
    for context in (("^", "^"), ("^", b"a"), (b"a", b"d"), (b"unknown", b"a")):
        assert sum(chance((*context, w)) for (w,) in [*levels[1], (b"unseen",)]) == pytest.approx(1.0)


@pytest.mark.parametrize("whole", [1, 1 << 18])
def test_kneser_ney_tables_are_small_and_whole(spark, whole):
    """A rare gram takes its hash alone, a context with one follower, once, nothing; all of them are still scored as the plain model does."""
    rng = random.Random(26)
    texts = [" ".join(rng.choice("abcdefghijkl") + str(rng.randrange(40)) for _ in range(rng.randint(0, 90))) for _ in range(100)] + ["", "solo", "a1 a1 a1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learned = [t for i, t in enumerate(texts) if crc32(str(i).encode()) % 5 != 1]
    want, _, levels = plain_order_three(learned, texts)
    model = kneser.train(docs.where(~kneser.held_out()), order=3, whole_keys=whole)
    for r in kneser.score(docs, model).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)
    if whole > 1:
        files = Path(model.folder.removeprefix("file:")).iterdir()
        assert sum(f.stat().st_size for f in files if not f.name.startswith("words")) < 20 * len(levels[3])


def test_packed_keys():
    rng = np.random.default_rng(8)
    key = rng.integers(0, 1 << 64, 400_000, np.uint64, endpoint=False)
    key = np.unique(np.concatenate([key, key[:2000] ^ np.uint64(1), key[:2000] ^ np.uint64(0x8001), [np.uint64(0), np.uint64((1 << 64) - 1)]]))
    other = np.concatenate([key[::7] ^ np.uint64(2), rng.integers(0, 1 << 64, 50_000, np.uint64)])
    for n, whole in ((len(key), 1 << 18), (len(key), 1 << 30), (len(key), 1), (1, 1), (0, 1), (0, 0)):
        packed = kneser._packed_keys(key[:n], whole)
        assert (kneser._places(packed, key[:n]) == np.arange(n)).all()
        assert (kneser._places(packed, other) == [{int(k): i for i, k in enumerate(key[:n])}.get(int(x), -1) for x in other]).all() if n < 2 else (
            (kneser._places(packed, other) >= 0) == np.isin(other, key[:n])).all()
    assert len(kneser._packed_keys(key, 1 << 18)) < 7 * len(key)


@pytest.mark.parametrize("high", [9, 1 << 30])
def test_numbers_of_grams_of_few_and_of_many_words(high):
    rng = np.random.default_rng(9)
    a, b, c = (rng.integers(0, 9, 3000).astype(np.uint64) * np.uint64(high // 9) for _ in range(3))
    first, at = kneser._numbered_pairs(a, b)
    assert (a[first][at] == a).all() and (b[first][at] == b).all() and len(first) == len(set(zip(a, b)))
    grams, count = kneser._distinct([a, b, c], high.bit_length())
    assert Counter(dict(zip(zip(*grams), count))) == Counter(zip(a, b, c)) and (np.diff(grams[1].astype(int)) >= 0).all()


def test_kneser_ney_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kneser.train(docs.limit(0))
    got = kneser.score(docs, model).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in got) and len(got) == 2
    assert kneser.score(docs.limit(0), model).count() == 0


def greedy(sample, text):
    """Phrases of a text by substring search; an unknown character is a phrase."""
    s = "".join(chr(200 + x) for x in sample)
    phrases = 0
    for start in range(0, len(text), language.PIECE):
        own = None
        for c in (chr(200 + x) for x in text[start:start + language.PIECE]):
            if own is not None and own + c in s:
                own += c
            else:
                phrases += 1
                own = c if c in s else None
    return phrases


@pytest.mark.parametrize("kinds", [6, 40, 3000])
def test_automaton(kinds):
    rng = np.random.default_rng(7)
    sample = rng.integers(1, kinds, 900).astype(np.int32)
    texts = [rng.integers(0, kinds + 1, n).astype(np.int32) for n in (0, 1, 5, 512, 513, 1500)] + [sample[100:700], np.tile(sample[5:9], 200)]
    alphabet = language.Alphabet(np.zeros(0x110000, np.int32), np.zeros(0x110000, bool), kinds + 2)
    model = language.Model(["x"], alphabet, [language.automaton(sample, kinds + 2)], np.ones(1))
    assert model.phrases(texts)[0].tolist() == [greedy(sample, t) for t in texts]


def test_languages_of_one_large_script(spark):
    """Words of thousands of letters; both languages use all of them, also beyond U+FFFF; documents open with a shared passage."""
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(2500)] + [chr(0x20000 + i) for i in range(500)]
    words = {name: ["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(1500)] for name in ("first", "second")}
    shared = "\n".join("shared opening words of every page " * 8 + str(i) for i in range(8)) + "\n"
    rows = [(i, shared + "\n".join(" ".join(rng.choices(words[name], k=12)) for _ in range(6)), name)
            for i, name in enumerate(["first", "second"] * 300)]
    docs = spark.createDataFrame([*rows, *[(1000 + i, "short and odd", f"label {i}") for i in range(5)]], "doc_id long, text string, lang string")
    model = language.learn(docs.where(~language.held_out()))
    tests = spark.createDataFrame([(i, " ".join(rng.choices(words[name], k=20)), name) for i, name in enumerate(["first", "second"] * 100)],
                                  "doc_id long, text string, lang string")
    got = language.identify(tests, model).join(tests.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.where(~language.held_out()))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99 and got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !?", "c"), (4, "中文", None), (None, "the " * 5000, "e"), (4, "\U00010400", None)],
                                "doc_id long, text string, lang_pred string")
    rows = language.identify(odd, model).collect()
    assert len(rows) == 6 and [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(r["lang_pred"] in model.languages for r in rows if r["doc_id"] in (4, None))
    nothing = language.learn(docs.where("lang IS NULL").select("doc_id", "text", "lang").limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_votes_are_learned():
    rng = np.random.default_rng(8)
    good = rng.random(20000) < 0.8
    rates = [(0.9, 0.2), (0.1, 0.7), (0.02, 0.5)]
    votes = np.stack([np.where(rng.random(len(good)) < np.where(good, a, b), 2 if i else 1, 0) for i, (a, b) in enumerate(rates)], 1)
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(kinds, counts.astype(float), rounds=500)
    post = model.posterior(votes)
    assert ((post > 0.5) == good).mean() > 0.85


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs).join(labels, "doc_id").toPandas()
    assert (got["_keep"] == (got["quality"] == 1)).mean() > 0.97
    assert got.loc[got["quality"] == 1, "_keep"].mean() > 0.99


def test_quality_edges(spark):
    junk = " ".join(["BUY NOW!!"] * 50)
    clean = "The house of the old man is on the hill and it was there for a long time."
    rows = [(i, clean + f" It is number {i}.", "x") for i in range(40)] + [(100 + i, junk, "y") for i in range(10)]
    rows += [(200, None, "z"), (201, "", None), (202, "word " * 30000, "w"), *[(210 + i, f"w{i} " * 80, "w") for i in range(8)], (None, clean, "n"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(40)) <= set(ids) and None in ids and ids.count(3) == 2 and not {100, 202, 210} & set(ids)
    assert quality.judged(docs).count() == len(rows)
    assert quality.keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize("period", [12, 100, 700])
@pytest.mark.parametrize("n", [2900, 4000, 30000])
def test_loops_of_any_length_are_faults(period, n):
    own = quality.HEURISTICS.index("variety")
    rng = random.Random(17)
    sentence = [rng.choice(["the", "of", "and", f"word{i}"]) for i in range(period)]
    looped = " ".join((sentence * (n // period + 1))[:n]).encode()
    assert quality.votes(looped)[own] == 2
    varied = " ".join(rng.choice(["the", "of", "and", f"word{rng.randrange(900)}"]) for _ in range(n)).encode()
    assert quality.votes(varied)[own] == 0
