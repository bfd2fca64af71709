"""Benchmark passages against a plain search."""

import random
import re

import pytest

from sagline.llm import passages


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    vocabulary = ["one", "Two", "été", "vier", "5", "seis", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (3, text(3)), (10, text(25)), (11, None), (12, "..."), (None, text(4)), (2, text(11)), (20, "zzz only here")]
    docs = [(i, text(rng.randint(1, 80)) + rng.choice([". ", "\n", ""]) + (rng.choice(items)[1] or "") + "! " + text(5), i) for i in range(40)]
    docs += [(100, None, 0), (101, "", 0), (102, "-- ,", 0), (5, docs[5][1], 0), (None, items[0][1], 0), (103, (items[3][1] + " ") * 400, 0),
             (104, text(3000), 0), (105, "clean words nobody knows", 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, hits int").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"), docs, items)


def brute(text, items, window=10):
    w, hit, found = words(text), set(), {}
    for name, t in items:
        own = words(t)
        if name is None or not own:
            continue
        n = min(window, len(own))
        for i in range(len(own) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == own[i:i + n]:
                    hit.update(range(j, j + n))
                    k = n
                    while i + k < len(own) and j + k < len(w) and own[i + k] == w[j + k]:
                        k += 1
                    found[str(name)] = max(found.get(str(name), 0), k)
    return len(w), sorted(hit), found


@pytest.mark.parametrize("shard_words,block_bytes", [(2_000_000, 16_000_000), (50, 16_000_000), (200, 40)])
def test_found(tables, shard_words, block_bytes):
    docs, bench, rows, items = tables
    got = passages.find_passages(docs, bench, shard_words=shard_words, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    want = {}
    for key, text, _ in rows:
        if text is None or len(text) < 5000:
            want[key] = brute(text, items)
    for r in got:
        if r["doc_id"] in want:
            n, hits, found = want[r["doc_id"]]
            longest = {}
            for m in r["matches"]:
                longest[m["item_id"]] = max(longest.get(m["item_id"], 0), m["n_words"])
            assert (r["n_words"], r["hits"], longest) == (n, hits, found)
        elif r["doc_id"] == 103:
            assert {m["item_id"]: m["n_words"] for m in r["matches"]}["10"] == 25 and len(r["hits"]) == r["n_words"]
    kept = passages.drop_contaminated(docs, bench, shard_words=shard_words, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, w in want.items() if k is None or not w[1]}


def test_empty(tables):
    docs, bench, rows, _ = tables
    assert passages.find_passages(docs.limit(0), bench).count() == 0
    assert all(r["hits"] == [] for r in passages.find_passages(docs, bench.limit(0)).collect())


def test_rows_and_items_without_id(spark):
    leak = "ein ganz besonderer Satz aus zehn Wörtern für diese Prüfung hier"
    docs = spark.createDataFrame([(1, "x " + leak), (1, "clean words"), (None, leak), (None, "clean too"), (2, "a short hidden item b")],
                                 "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(7, leak), (None, "short hidden item")], "item_id long, text string")
    for block_bytes in (16_000_000, 10):
        kept = passages.drop_contaminated(docs, bench, unnamed=True, block_bytes=block_bytes)
        assert sorted(r["text"] for r in kept.collect()) == ["clean too", "clean words"]
        found = passages.find_passages(docs, bench, unnamed=True, block_bytes=block_bytes).where("doc_id = 2").first()
        assert found["hits"] == [1, 2, 3] and [m["item_id"] for m in found["matches"]] == [None]
    assert sorted(r["text"] for r in passages.drop_contaminated(docs, bench).collect()) == sorted([leak, "clean too", "clean words", "a short hidden item b"])
