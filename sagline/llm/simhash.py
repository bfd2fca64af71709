"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into three segments. If two differ in at most four bits, they differ in at
most one bit of the first segment, or at most one of the second, or not at all in the third: otherwise they
would differ in five. So every fingerprint is stored under its three segments, looks under all keys of those
small balls, and compares whole fingerprints with what it finds there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline.llm.components import components
from sagline.llm.shared import bounded, stored

# First bit, width and ball radius of each segment.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
MAX_BITS = 4
# A key with more comparisons than this is compared in blocks, which yield only a spanning forest of its links.
DENSE = 1 << 14
BLOCK = 4096
# Numbers of kept rows are broadcast up to this count, 8 bytes each; else joined by shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 values of all shingles; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(0)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` of every row, nulls and repeats included; ``fp`` is the fingerprint's signed value."""
    rows = docs.select(F.col(text).cast("binary").alias("t"), F.col(key).cast("long").alias("doc_id"))
    return rows.mapInArrow(_prints, "doc_id long, fp long")


def _segment(s: int) -> F.Column:
    first, width, _ = SEGMENTS[s]
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(s: int, ball: bool) -> F.Column:
    """Keys of segment ``s``, its number in the high bits: the own one, or the whole ball."""
    width, radius = SEGMENTS[s][1:]
    assert radius in (0, 1)
    flips = [0] + [1 << i for i in range(width)] * (radius if ball else 0)
    own = _segment(s) + F.lit(s << 32)
    return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda m: own.bitwiseXOR(m))


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the probes and the entries of one block."""
    probe = pdf.loc[pdf["probe"], ["fp", "rep"]].drop_duplicates().to_numpy(np.int64)
    entry = pdf.loc[~pdf["probe"], ["fp", "rep"]].drop_duplicates().to_numpy(np.int64)
    group = np.arange(len(entry))
    own: dict[int, int] = {int(r): i for i, r in enumerate(entry[:, 1])}
    out: list[tuple[int, int]] = []
    for fp, rep in probe:
        near = np.flatnonzero(np.bitwise_count((entry[:, 0] ^ fp).view(np.uint64)) <= MAX_BITS)
        roots, first = np.unique(group[near], return_index=True)
        mine = group[own[int(rep)]] if int(rep) in own else -1
        for root, i in zip(roots, near[first]):
            if root != mine:
                out.append((int(rep), int(entry[i, 1])))
        if len(roots):
            group[np.isin(group, np.append(roots, mine) if mine >= 0 else roots)] = roots[0]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def hamming_links(prints: DataFrame, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """``a, b`` links between the ``rep`` of distinct ``fp``, enough to connect all that differ in at most four bits.

    ``prints`` has one row per distinct fingerprint. Ordinary keys give every link once; a key with more than
    ``dense`` comparisons is dealt to blocks of about ``block`` x ``block``, each of which gives a forest.
    """
    entry = prints.select("fp", "rep", F.explode(F.concat(*[_keys(s, False) for s in range(3)])).alias("k"))
    probe = prints.select("fp", "rep", F.explode(F.concat(*[_keys(s, True) for s in range(3)])).alias("k"))
    size = probe.groupBy("k").agg(F.count(F.lit(1)).alias("probes")).join(
        entry.groupBy("k").agg(F.count(F.lit(1)).alias("entries")), "k")
    full = bounded(stored(size.where(F.col("probes") * F.col("entries") > dense), "full-keys"), 50_000)

    p = probe.join(full.select("k"), "k", "left_anti").select("k", F.col("fp").alias("x"), F.col("rep").alias("a"))
    e = entry.select("k", F.col("fp").alias("y"), F.col("rep").alias("b"))
    plain = p.join(e, "k").where((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS))

    def dealt(side: DataFrame, is_probe: bool) -> DataFrame:
        rows, cols = (F.ceil(F.col(c) / block).cast("int") for c in ("probes", "entries"))
        mine, other, names = (rows, cols, ("r", "c")) if is_probe else (cols, rows, ("c", "r"))
        return side.join(full, "k").withColumn(names[0], F.pmod(F.xxhash64("fp"), mine).cast("int")).withColumn(
            names[1], F.explode(F.sequence(F.lit(0), other - 1))).select("k", "r", "c", "fp", "rep", F.lit(is_probe).alias("probe"))

    blocks = dealt(probe, True).unionByName(dealt(entry, False)).groupBy("k", "r", "c").applyInPandas(_forest, "a long, b long")
    return plain.select("a", "b").unionByName(blocks)


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``.

    Documents of the same or linked fingerprints form a component, named by its smallest id. Null and empty
    texts have fingerprint 0 and are linked like any other. A row whose id is null connects others and gets
    its component, null if no row there has an id; repeated rows are all returned.
    """
    rows = stored(fingerprints(docs, text, key), "prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    # Fingerprints are linked as such, so that one whose rows have no id still connects others.
    found = components(hamming_links(prints.select("fp", F.col("fp").alias("rep"))))
    member = stored(prints.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first"), "print-components")
    name = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.select("fp", "component").join(name, "component")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the first by id, nulls last, and by place among rows of that id.

    The rows are stored once to number them.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc")),
                  "near-documents")
    id_ = F.col("doc").getField(key)
    groups = near_groups(rows.select("row", F.col("doc").getField(text).alias("text")), "text", "row").select(
        F.col("doc_id").alias("row"), "component_id")
    named = groups.join(rows.select("row", F.struct(id_.isNull(), id_, F.col("row").alias("row")).alias("place")), "row")
    kept = stored(named.groupBy("component_id").agg(F.min("place").alias("first")).select(
        F.col("first.row").alias("row")), "kept-rows")
    return rows.join(bounded(kept, BROADCAST_ROWS), "row", "left_semi").select("doc.*")
