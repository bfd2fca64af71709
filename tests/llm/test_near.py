"""SimHash groups, components and fuzzy lines against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sagline.llm import lines, simhash
from sagline.llm.components import components

DOCS = "doc_id long, text string, fp int, rep string, component_id int"


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [words[i:i + 4] for i in range(len(words) - 3)] or [words]
    h = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_prints_and_groups(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta Gamma delta été über tau pi".split()) for _ in range(n)) for n in (1, 3, 5, 60, 400, 9000)]
    texts = [None, "", " \n\t", *base, base[4] + " end", "x " + base[5], base[3].upper(), base[3], "a b", "tail " + base[4]]
    rows = [(i * 3 + 1, t, 1, "x", 2) for i, t in enumerate(texts)] + [(7, texts[2], 0, None, None), (None, base[3], 0, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    want = {i * 3 + 1: plain_print(t) for i, t in enumerate(texts)}
    named = groups(sorted(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == want[r["doc_id"]] and r["component_id"] == named[r["doc_id"]]
    assert next(r for r in got if r["doc_id"] is None)["component_id"] == named[19]
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(named.values()))
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("middle", [5, None])
def test_a_row_without_id_connects_others(spark, monkeypatch, middle):
    """Two fingerprints that differ in eight bits meet through a third, whatever its id."""
    prints = spark.createDataFrame([(2, 0), (1, 0xFF), (middle, 0x0F), (9, 0xFFFF0000), (None, 0xFFFF << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: prints)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_groups(prints).collect()}
    assert got == {(2, 0): 1, (1, 0xFF): 1, (middle, 0x0F): 1, (9, 0xFFFF0000): 9, (None, 0xFFFF << 40): None}


@pytest.mark.parametrize("dense,block", [(1 << 14, 4096), (0, 5), (20, 3)])
def test_hamming_links(spark, dense, block):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0]
    prints = set(seeds)
    for s in seeds[:5]:
        for _ in range(25):
            prints.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    rows = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(sorted(prints))]
    value = {i: p for p, i in rows}
    links = simhash.hamming_links(spark.createDataFrame(rows, "fp long, rep long"), dense, block)
    assert all(((value[a] ^ value[b]) % (1 << 64)).bit_count() <= 4 for a, b in links.collect())
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = groups(sorted(value), lambda a, b: ((value[a] ^ value[b]) % (1 << 64)).bit_count() <= 4)
    assert all(got.get(n, n) == c for n, c in want.items())


def test_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (None, 1), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == dict.fromkeys(range(n), 0)
    assert components(links.limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    family = [sentence(40) for _ in range(3)]
    variants = [f.replace(f.split()[rng.randrange(40)], word(), 1) for f in family for _ in range(14)]
    pool = [*family, *variants, *[sentence(rng.randint(1, 30)) for _ in range(25)], "ab", "abcdefgh", sentence(4000), family[0] + " " + family[1]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(6)) + "\n  \n" + rng.choice(pool) + " ", 1) for i in range(60)]
    rows += [(100, None, 1), (101, "", 1), (3, rows[3][1], 1), (None, family[2], 1), (102, "éè" * 30 + "\n\n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = lines.repeated_lines(docs, bands=60, rows=2).collect()
    assert len(got) == len(rows)
    places = [(-1 if d is None else d, n, p, x.strip(" ")) for n, (d, t, _) in enumerate(rows) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    k = lines.SHINGLE
    cut = lambda x: {x[i:i + k] for i in range(max(len(x) - k + 1, 1))}
    sets = {x: cut(x) for x in {p[3] for p in places}}
    ids = sorted(sets)
    component = groups(ids, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    total = sum(r["n_lines"] for r in got)
    assert total == len(places)
    keep = {}
    for place in sorted(places[:]):
        keep.setdefault(component[place[3]], (place[0], place[2]))
    # Two rows have id 3, so places are counted.
    dropped = Counter((-1 if r["doc_id"] is None else r["doc_id"], p) for r in got for p in r["dropped"])
    assert Counter((d, p) for d, _, p, _ in places) - dropped == Counter(keep.values())
    out = lines.drop_repeated_lines(docs, bands=60, rows=2)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = [x.strip(" ") for r in out.collect() for x in (r["text"] or "").split("\n") if x.strip(" ")]
    assert sorted(component[x] for x in left) == sorted(set(component.values()))
    assert lines.repeated_lines(docs.limit(0)).count() == 0


def test_short_lines_as_in_production(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    base = ["Copyright 2021 Example Inc. All rights reserved."]
    for _ in range(80):
        n, line = rng.randint(40, 70), f"no {rng.randint(1000, 9999)}"
        while len(line) < n:
            line += " " + word()
        base.append(line)
    pool = base + ["Copyright 2022 Example Inc. All rights reserved.", *[x.replace(x[6], str((int(x[6]) + 1) % 10), 1) for x in base[1:]]]
    rng.shuffle(pool)
    docs = spark.createDataFrame([(i, "\n".join(pool[i::20])) for i in range(20)], "doc_id long, text string")
    cut = {x: {x[i:i + 4] for i in range(len(x) - 3)} for x in pool}
    component = groups(sorted(cut), lambda a, b: len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b]))
    assert len(set(component.values())) < 0.6 * len(cut)
    left = [x for r in lines.drop_repeated_lines(docs).collect() for x in r["text"].split("\n") if x]
    assert sorted(component[x] for x in left) == sorted(set(component.values()))
    assert sum(x.startswith("Copyright") for x in left) == 1


def test_shingles_of_any_characters_and_each_pair_once(spark):
    """Shingles are whole characters, also beyond 16 bits, and a member that meets its pivot in several bands is named once."""
    texts = ["", "ab", "abcd", "aaaaaaaa", "é😀x😀é😀x😀y", "abcdefgh" * 40 + "é" * 90]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, line string")
    got = {r["id"]: r["s"] for r in rows.select("id", lines.shingles(F.col("line")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = {t[k:k + 4] for k in range(max(len(t) - 3, 1))}
        assert set(got[i]) == {xxhash.xxh64_intdigest(x.encode("utf-32-be"), 42) - (1 << 64 if xxhash.xxh64_intdigest(
            x.encode("utf-32-be"), 42) >> 63 else 0) for x in want} and len(got[i]) == len(want)
    near = spark.createDataFrame([(i, "the same long line of text with a number " * 3 + str(i), 1) for i in range(9)], "id long, line string, n long")
    met = [tuple(r) for r in lines.buckets(near).collect()]
    assert len(met) == len(set(met)) and {a for a, _ in met} == set(range(9))


@pytest.mark.parametrize("small", [64, 2])
def test_few_pairs_of_unlike_lines_reach_their_texts(spark, monkeypatch, small):
    """Lines of few syllables meet by chance in many buckets; sketches rule them out, and no link is lost in small or large buckets."""
    rng = random.Random(15)
    part = ["the", "ing", "ou", "th", "er", "ea", "on", "and ", "re ", "ti ", "an ", ". "]
    line = lambda n: "".join(rng.choice(part) for _ in range(n))
    base = [line(rng.choice((12, 30, 60, 120))).strip() for _ in range(250)]
    near = [x[:k] + rng.choice("xyz") + x[k + 1:] for x in base[:40] for k in (rng.randrange(len(x)),)]
    family = [f"{base[200][:90]} number {i} of the same family of lines" for i in range(30)]
    pool = sorted({*base, *near, *family})
    compared = []
    exact = lines.jaccard
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "jaccard", lambda pairs, *a: compared.append(pairs.count()) or exact(pairs, *a))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(pool)], "doc_id long, text string")
    got = {r["doc_id"] for r in lines.repeated_lines(docs).collect() if not r["dropped"]}
    cut = {x: {x[i:i + 4] for i in range(max(len(x) - 3, 1))} for x in pool}
    alike = {(a, b) for a in pool for b in pool if a < b and len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b])}
    component = groups(pool, lambda a, b: (a, b) in alike)
    assert {pool[i] for i in got} == set(component.values())
    assert sum(compared) < 3 * len(alike)


def test_rows_of_buckets_are_stored_for_a_turn_alone(spark, monkeypatch):
    """Tables of large buckets, which grow faster than the input, are gone when the links are found."""
    from pathlib import Path

    from sagline.llm.shared import shared_dir

    monkeypatch.setattr(lines, "SMALL", 2)
    family = [f"the same long line of some words with a number {i} at its end and a few words more" for i in range(10, 20)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(family)], "doc_id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    links = lines.line_links(docs).collect()
    assert len({x for r in links for x in (r["a"], r["b"])}) == len(family)
    kinds = {p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before}
    assert "line-signatures" in kinds and "line-buckets" not in kinds


def test_drop_near_by_row(spark):
    once = "one two three four five six seven eight nine ten"
    rows = [(5, once), (5, once), (9, once), (None, once), (None, "only here without an id"), (None, "only here without an id"), (5, "another text of id five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.drop_near(docs).collect()), key=str)
    assert got == sorted([(5, once), (None, "only here without an id"), (5, "another text of id five")], key=str)
