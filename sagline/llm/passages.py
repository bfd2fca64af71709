"""Benchmark decontamination with suffix arrays over shards of the training text.

Texts become sequences of word numbers in the benchmark's own vocabulary, 0 for any other word, so that only
runs of known words can match. Each task orders the suffixes of its shard that start with enough known words
(several words packed into one sort key, ties refined by the next key), and finds every window of every
benchmark text by binary search in that order, all windows at once. Consecutive windows on one diagonal give
the longest verbatim matches. Nothing is shuffled; the benchmark is broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagline.llm.shared import bounded, stored

WINDOW = 10
# Words of training text per suffix array, and UTF-8 bytes of benchmark text per broadcast block.
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 16_000_000
# Numbers of contaminated rows are broadcast up to this count, 8 bytes each; else joined by shuffle.
BROADCAST_ROWS = 1_000_000
# A-Z become lower case; bytes of other words' separators become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_from", T.LongType()),
                      T.StructField("doc_from", T.LongType()), T.StructField("n_words", T.LongType())])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                      T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("matches", T.ArrayType(MATCH))])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())),
                    ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_from", pa.int64()),
                                                    ("doc_from", pa.int64()), ("n_words", pa.int64())])))])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Block:
    """Benchmark texts as one sequence: word numbers, windows (start, length, item, place in the item), item names."""

    vocabulary: dict[bytes, int]
    sequence: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    places: np.ndarray
    names: list[str]


def encode(rows: list[tuple[str, bytes]], window: int = WINDOW) -> Block:
    vocabulary: dict[bytes, int] = {}
    sequence, windows, names = [], [], []
    for name, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        if not ids:
            continue
        length = min(window, len(ids))
        windows += [(len(sequence) + i, length, len(names), i) for i in range(len(ids) - length + 1)]
        sequence += [*ids, 0]
        names.append(name)
    table = np.array(windows, np.int64).reshape(-1, 4)
    return Block(vocabulary, np.array(sequence, np.int64), table[:, 0], table[:, 1], table[:, 2], table[:, 3], names)


class SuffixArray:
    """The suffixes of ``sequence`` at ``at``, ordered by their first ``depth`` words.

    ``bits`` bounds the word numbers; as many words as fit are packed into one key.
    """

    def __init__(self, sequence: np.ndarray, at: np.ndarray, depth: int, bits: int):
        self.bits, self.per = bits, max(62 // bits, 1)
        self.sequence = np.concatenate([sequence, np.zeros(depth + self.per, np.int64)])
        order = at[np.argsort(self.key(at, 0), kind="stable")]
        key = self.key(order, 0)
        head = np.ones(len(order), bool)
        head[1:] = key[1:] != key[:-1]
        tied = np.arange(len(order))
        for chunk in range(1, -(-depth // self.per)):
            alone = head[tied] & np.append(head[tied[1:]], True)
            tied = tied[~alone]
            if not len(tied):
                break
            group, key = np.cumsum(head[tied]), self.key(order[tied], chunk)
            by = np.lexsort((key, group))
            order[tied], key = order[tied][by], key[by]
            head[tied[1:]] |= key[1:] != key[:-1]
        self.order = order

    def key(self, at: np.ndarray, chunk: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(chunk * self.per, (chunk + 1) * self.per):
            out = (out << self.bits) | self.sequence[at + i]
        return out

    def _first(self, low: np.ndarray, high: np.ndarray, chunk: int, key: np.ndarray) -> np.ndarray:
        """First place in each ``[low, high)`` whose key is not below ``key``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low[open_] + high[open_]) // 2
            below = self.key(self.order[mid], chunk) < key[open_]
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
        return low

    def search(self, sequence: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of ``order`` for each window ``sequence[start:start + length]``."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        padded = np.append(sequence, np.zeros(self.per, np.int64))
        for chunk in range(-(-int(lengths.max(initial=0)) // self.per)):
            go = np.flatnonzero((low < high) & (lengths > chunk * self.per))
            least, most = np.zeros(len(go), np.int64), np.zeros(len(go), np.int64)
            for i in range(chunk * self.per, (chunk + 1) * self.per):
                inside = lengths[go] > i
                word = padded[np.where(inside, starts[go] + i, 0)]
                least = (least << self.bits) | np.where(inside, word, 0)
                most = (most << self.bits) | np.where(inside, word, (1 << self.bits) - 1)
            low[go], high[go] = self._first(low[go], high[go], chunk, least), self._first(low[go], high[go], chunk, most + 1)
        return low, high


def _occurrences(block: Block, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(position in sequence, window)`` of every occurrence of every window."""
    stops = np.append(np.flatnonzero(sequence == 0), len(sequence))
    known = stops[np.searchsorted(stops, np.arange(len(sequence)))] - np.arange(len(sequence))
    at = np.flatnonzero(known >= block.lengths.min(initial=1 << 40))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    array = SuffixArray(sequence, at, int(block.lengths.max()), max(len(block.vocabulary).bit_length(), 1))
    low, high = array.search(block.sequence, block.starts, block.lengths)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return array.order[rank], window


def scan(block: Block, ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
    """Hits and longest matches in one shard of encoded texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    sequence = np.zeros(int((sizes + 1).sum()), np.int64)
    for b, t in zip(begin, texts):
        sequence[b:b + len(t)] = t
    at, window = _occurrences(block, sequence)
    doc = np.searchsorted(begin, at, "right") - 1
    hit, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    matches: list[list[dict]] = [[] for _ in ids]
    if len(at):
        n = len(sequence) + 1
        depth = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + block.lengths[window], minlength=n))
        hit = np.flatnonzero(depth > 0)
        of = np.searchsorted(begin, hit, "right") - 1
        item, place, start = block.items[window], block.places[window], at - begin[doc]
        by = np.lexsort((start, start - place, item, doc))
        doc, item, place, start, length = doc[by], item[by], place[by], start[by], block.lengths[window][by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - place[1:] != start[:-1] - place[:-1]) | (
            start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(doc))) - 1 + length[first]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for f, n in zip(first, run):
            k = (int(doc[f]), int(item[f]))
            if k not in best or n > best[k][0]:
                best[k] = (int(n), int(f))
        for (d, i), (n, f) in best.items():
            matches[d].append({"item_id": block.names[i], "item_from": int(place[f]), "doc_from": int(start[f]), "n_words": n})
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids)))]).astype(np.int32)
    hits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hit - begin[of]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), hits,
                                       pa.array(matches, _ARROW.field(3).type)], schema=_ARROW)


def _scanner(handle, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = handle.value
        number = block.vocabulary.get
        ids, texts, count = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own = words(text.as_py())
                ids.append(key.as_py())
                texts.append(np.fromiter((number(w, 0) for w in own), np.int32, len(own)))
                count += len(own)
                if count >= shard_words:
                    yield scan(block, ids, texts)
                    ids, texts, count = [], [], 0
        if ids:
            yield scan(block, ids, texts)
    return run


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int, unnamed: bool) -> Iterator[Block]:
    rows, size = [], 0
    chosen = benchmark.where(F.col(text).isNotNull() & (F.lit(unnamed) | F.col(item).isNotNull()))
    for name, value in chosen.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        rows.append((name, bytes(value)))
        size += len(value)
        if size >= block_bytes:
            yield encode(rows, window)
            rows, size = [], 0
    yield encode(rows, window)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS,
                  block_bytes: int = BLOCK_BYTES, unnamed: bool = False) -> DataFrame:
    """``doc_id, n_words, hits, matches`` of every row of ``docs``.

    ``hits`` are the places of the words inside an occurrence of a benchmark window (``window`` consecutive
    words of an item; all of a shorter one), ``matches`` the longest verbatim match with each item that has one.
    Null and empty texts have no words; items without words take no part, and items without id only if
    ``unnamed``, each under a null ``item_id``; repeated rows are returned each. A benchmark beyond ``block_bytes`` is scanned block by block; the rows are numbered and stored for that, and
    the blocks' hits are united by number.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    blocks = list(_blocks(benchmark, item, item_text, window, block_bytes, unnamed))
    if len(blocks) == 1:
        return _scanned(rows, blocks[0], shard_words)
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    out = numbered.select("row", "doc_id")
    for i, block in enumerate(blocks):
        more = _scanned(numbered.select(F.col("row").alias("doc_id"), "t"), block, shard_words).select(
            F.col("doc_id").alias("row"), "n_words", F.col("hits").alias("h"), F.col("matches").alias("m"))
        if i:
            more = more.drop("n_words")
        out = out.join(more, "row")
        both = {"hits": F.col("h"), "matches": F.col("m")} if not i else {
            "hits": F.array_sort(F.array_union("hits", "h")), "matches": F.concat("matches", "m")}
        out = stored(out.withColumns(both).drop("h", "m"), "block-hits")
    return out.select("doc_id", "n_words", "hits", "matches")


def _scanned(rows: DataFrame, block: Block, shard_words: int) -> DataFrame:
    return rows.mapInArrow(_scanner(rows.sparkSession.sparkContext.broadcast(block), shard_words), FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_hits: int = 1, key: str = "doc_id", text: str = "text",
                      unnamed: bool = False, **options) -> DataFrame:
    """``docs`` without the rows that have at least ``min_hits`` words inside benchmark windows.

    Every row is judged by its own text, whatever other rows have its id. Rows and items without an id take part if
    ``unnamed``; else such rows stay. The rows are stored once to number them.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc")),
                  "judged-texts")
    judged = rows if unnamed else rows.where(F.col("doc").getField(key).isNotNull())
    found = find_passages(judged.select("row", F.col("doc").getField(text).alias("text")), benchmark, key="row", text="text",
                          unnamed=unnamed, **options)
    bad = stored(found.where(F.size("hits") >= min_hits).select(F.col("doc_id").alias("row")), "contaminated-rows")
    return rows.join(bounded(bad, BROADCAST_ROWS), "row", "left_anti").select("doc.*")
