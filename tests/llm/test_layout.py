"""Sharding, mixing, chat formatting and nearest neighbours against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagline.llm import chat, cube, hilbert, vptree


@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3), (1, 4)])
def test_curve_visits_every_cell_by_single_steps(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = hilbert.curve_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def odd_docs(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(0, 60), rng.choice(["en", "de", None]), rng.choice(["a"] * 5 + ["b", "c", None]), 0) for i in range(200)]
    rows += [(300, None, None, None, 0), (301, "", "en", "a", 0), (5, rows[5][1], "en", "a", 0), (None, "x", "en", "a", 0), (302, "é" * 50000, "de", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int"), rows


def test_shards(spark, tmp_path):
    docs, rows = odd_docs(spark)
    got = hilbert.hilbert_shards(docs, 7).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]])) for r in got)
    again = hilbert.hilbert_shards(docs.repartition(5), 7)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    assert hilbert.hilbert_shards(docs.limit(0), 7).count() == 0
    assert Counter(r["shard"] for r in hilbert.hilbert_shards(docs.limit(3), 7).collect()).most_common(1)[0][1] == 1
    hilbert.write_shards(docs.where("doc_id < 100"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).where("shard_number = 2").count() == 25


def test_targets():
    assert cube.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    out = cube.targets([10, 500, 490], [5, 2, 1])
    assert out[0] == 30 and sum(out) == pytest.approx(1000) and out[1] == pytest.approx(2 * out[2])
    assert cube.targets([0, 0], [5, 2]) == [0.0, 0.0] and cube.targets([], []) == []


def test_flight_is_balanced_and_fair():
    size = np.random.default_rng(10).integers(0, 500, 400).astype(float)
    taken = np.zeros(400)
    for seed in range(200):
        p = cube.fly(np.full(400, 0.3), size, np.random.default_rng(seed))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(120) and (p * size).sum() == pytest.approx(0.3 * size.sum())
        taken += p
    assert abs(taken / 200 - 0.3).max() < 0.2


@pytest.mark.parametrize("chunk", [4096, 6])
def test_mix(spark, chunk):
    docs, rows = odd_docs(spark)
    got = cube.mix(docs, chunk=chunk).collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {n: sum(len((r[1] or "").split()) for r in rows if r[3] == n) for n in names}
    goal = dict(zip(names, cube.targets(list(size.values()), [5, 2, 1, 5])))
    source = {r[0]: r[3] for r in rows if r[0] != 5}
    taken = Counter()
    for r in got:
        assert r["copies"] <= 3
        n = source.get(r["doc_id"], "a")
        if r["doc_id"] not in (5, None):
            assert r["source_size"] == size[n] and r["target"] == pytest.approx(goal[n])
        taken[r["source_size"], r["target"]] += r["copies"] * r["size"]
    for (_, target), words in taken.items():
        assert abs(words - target) <= 60
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, cube.mix(docs, chunk=chunk).collect()), key=repr)
    out = cube.mixed(docs, chunk=chunk)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert cube.mix(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(11)
    bits = ["<", "[", "\\", "|", "<|end|>", "<|message|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "\n", "é", "$1", "ok", ""]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    told = {c: [(t, rng.choice(["user", "assistant", "<|end|>", None]), rng.choice([None, text(), text()])) for t in range(rng.randint(1, 6))]
            for c in range(120)}
    told[500] = [(0, "user", "x" * 100_000), (1, "assistant", "<|end|>" * 3000)]
    told[501] = [(None, "user", "a"), (2, "user", "b"), (2, "user", "b")]
    rows = [(c, t, r, x, 1) for c, own in told.items() for t, r, x in own] + [(None, 0, "user", "alone", 1)]
    rng.shuffle(rows)
    found = chat.format_chat(chat.text_parts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")))
    got = found.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(got) == len(told) + 1
    for r in got:
        if r["conv_id"] is not None:
            own = [(role or "", x or "") for _, role, x in told[r["conv_id"]]]
            assert [(t["role"], t["body"]) for t in r["turns"]] == own
            assert r["learned"] == "".join(x for role, x in own if role == "assistant")
            assert r["formatted"].count(chat.END) == len(own) and not any(
                s in r["formatted"] for s in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>"))


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), None,
                            ("audio", None, "b.wav", None, None, 2.02, None), ("film", "?", None, None, None, None, None)]),
            (1, 1, "assistant", [("text", "a <|image|>", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3),
                                 ("image", None, None, None, 5, None, None)]), (2, 0, None, None)]
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).collect()}
    assert got[1]["formatted"] == ("<|start|>user<|message|>see <|image|><|audio|><|end|>"
                                   "<|start|>assistant<|message|>a <\\|image|><|document|><|image|><|end|>")
    assert [tuple(a) for a in got[1]["attachments"]] == [(1, 0, "image", "a.png", 3), (2, 0, "audio", "b.wav", 51), (3, 1, "document", "c.pdf", 1536),
                                                         (4, 1, "image", None, 0)]
    assert got[1]["expanded_tokens"] == 1590 and got[2]["formatted"] == "<|start|><|message|><|end|>"
    assert chat.format_chat(chat.text_parts(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def plain_nearest(rows, every, k):
    out = []
    for q, a in rows:
        if q % every == 0:
            near = sorted((-vptree.cosine(a, b), i) for i, b in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shard_vectors,query_block", [(8192, 256), (150, 3)])
def test_nearest(spark, shard_vectors, query_block):
    rng = np.random.default_rng(12)
    fine = [(i, rng.normal(size=6).tolist()) for i in range(700)] + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(90)]
    fine += [(2000, [2.0, 4.0, 0.0, 0.0, 0.0, 2.0]), (2001, [1e300] * 6), (2002, [1e-200] * 6)]
    fine += [(2050, [1e-200, 3e-200, 0.0, 0.0, 0.0, 5e-324]), (2100, [1e300, -1e300, 0.0, 1e-300, 1e308, 0.0])]
    bad = [(3000, None), (3050, [0.0] * 6), (3100, [float("nan")] * 6), (3150, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3200, [float("inf")] + [0.0] * 5),
           (3250, []), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in fine + bad], "vec_id long, embedding array<double>, shard string")
    got = vptree.nearest(table, shard_vectors=shard_vectors, query_block=query_block).collect()
    assert sorted(map(tuple, got)) == plain_nearest(fine, 50, 5)
    assert vptree.nearest(table.limit(0)).count() == 0
    few = vptree.nearest(table.where("vec_id IN (0, 1, 2)")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_relaxed_search_recalls_most(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(20, 16))
    unit = vptree._unit(centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16)))
    tree = vptree.Tree.build(unit, 16)
    exact, loose = tree.search(unit[:100], 5), tree.search(unit[:100], 5, 0.7)
    true = [set(np.argsort(-(unit @ q))[:5]) for q in unit[:100]]
    assert all(t <= set(e.tolist()) for t, e in zip(true, exact))
    assert np.mean([len(t & set(f.tolist())) / 5 for t, f in zip(true, loose)]) >= 0.9


def test_cosine_of_tiny_and_huge_vectors():
    rng = np.random.default_rng(1)
    for a, b in rng.normal(size=(50, 2, 8)):
        plain = float(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5))
        assert vptree.cosine(a.tolist(), b.tolist()) == pytest.approx(plain, rel=1e-14)
        for s in (2.0 ** 900, 2.0 ** -900):
            assert vptree.cosine((a * s).tolist(), b.tolist()) == vptree.cosine(a.tolist(), b.tolist())
    assert vptree.cosine([1e300, 1e300], [1.0, 1.0]) == pytest.approx(1) and vptree.cosine([1e-200, 1e-200], [1.0, -1.0]) == 0
