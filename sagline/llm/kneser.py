"""Interpolated modified Kneser-Ney language model of any order from two.

Training texts are counted by tasks into blocks of distinct runs of ``order`` words (grams), which Spark deals to
shards by the hash of the last word but one, so that a gram and all its endings of two words or more meet in one
shard. Every shard merges its blocks and writes sorted hash arrays into the shared folder, for each length: grams
with counts (shorter ones with the number of distinct words before them), contexts with their totals, and, dealt by
the last word, words with their counts and the number of distinct words before them. Most grams count once and most
contexts have one follower, once: of such grams only the hash is kept, and such contexts are left out, as a known
word or gram without a context of its own has just that one. A large table keeps six bytes of a hash, the rest is its
bucket. Workers map these files into memory and look up all distinct grams of a batch in hash order, so that pages are
read in sequence and shared by all workers of a machine. A text begins with as many begin marks as a context has words.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagline.llm.shared import fresh_path, stored

# Bytes of training text per shard of the model, and tokens counted at a time.
SHARD_BYTES = 32_000_000
BLOCK_TOKENS = 2_500_000
# Tokens scored in one step; what is sorted and looked up is held for these alone.
SCORE_TOKENS = 500_000
# Tables with fewer keys keep them whole; in the others a bucket has 4 to 32 keys.
WHOLE_KEYS = 1 << 18
# Words whose hashes a task remembers; beyond that it starts anew.
KNOWN_WORDS = 300_000
_U = np.uint64
BEGIN, END = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_GRAMS, _CONTEXTS, _WORDS = "grams", "contexts", "words"


class Hasher:
    """64-bit hashes of lower-cased words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        own = text.lower().split() if text else []
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(own).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.append(np.fromiter(map(known.__getitem__, own), _U, len(own)), END)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for a pair of hashes."""
    k = (a ^ (a >> _U(33))) * _U(0xFF51AFD7ED558CCD) + b * _U(0xC4CEB9FE1A85EC53)
    k ^= k >> _U(29)
    return k * _U(0x9E3779B97F4A7C15)


def grams_of(last: np.ndarray, sizes: np.ndarray, order: int, begin) -> list[np.ndarray]:
    """The last ``order`` words, the oldest first, at every token of texts of the given sizes; each text begins anew."""
    place = np.arange(len(last)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [last]
    for back in range(1, order):
        before = np.full_like(last, begin)
        before[back:] = np.where(place[back:] >= back, last[:-back], begin)
        out.insert(0, before)
    return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.array([len(t) for t in texts], np.int64)


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    return np.append(True, x[1:] != x[:-1])[:len(x)]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them."""
    order = np.argsort(x)
    x = x[order]
    new, at = _new(x), np.empty(len(x), _U)
    at[order] = np.cumsum(new) - 1
    return x[new], at


def _numbered_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the distinct pairs of two arrays of small numbers: a place of each, and each place's number.

    Sorting both with the place in one word takes a tenth of the time of sorting indices.
    """
    n, of_b, of_place = len(a), int(b.max()).bit_length(), len(a).bit_length()
    if int(a.max()).bit_length() + of_b + of_place > 64:
        _, first, at = np.unique(a << _U(of_b) | b, return_index=True, return_inverse=True)
        return first, at.astype(_U)
    x = np.sort((a << _U(of_b) | b) << _U(of_place) | np.arange(n, dtype=_U))
    place = (x & _U((1 << of_place) - 1)).astype(np.int64)
    new, at = _new(x >> _U(of_place)), np.empty(n, _U)
    at[place] = np.cumsum(new) - 1
    return place[new], at


def gram_keys(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each gram's context and of the whole gram."""
    context = grams[0]
    for word in grams[1:-1]:
        context = mix(context, word)
    return context, mix(context, grams[-1])


def _merge(grams: list[np.ndarray], c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct grams in order of their hash: key, words, and count."""
    key = gram_keys(grams)[1]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(_new(key))
    count = np.add.reduceat(c[order], first) if len(first) else c
    return key[first], [g[order[first]] for g in grams], count


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of each of ``values``."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(_new(key))
    return [key[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]]


def _planes(x: np.ndarray) -> bytes:
    """Numbers in planes of bytes, of which those with zeros alone take nothing once compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _of_planes(body: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<u8").reshape(n)


def _blob(word: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted hashes by their differences, and numbers for each; compressed."""
    body = b"".join(map(_planes, [np.diff(word, prepend=_U(0)), *(x.astype(_U) for x in values)]))
    return np.array([len(word), len(body)], "<u8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _of_blob(blob: bytes) -> list[np.ndarray]:
    n, size = np.frombuffer(blob, "<u8", 2).astype(int).tolist()
    body = pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True)
    word, *values = [_of_planes(body, n, at) for at in range(0, size, 8 * n)]
    return [np.cumsum(word, dtype=_U), *values]


def _distinct(grams: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct grams of word numbers of so many bits, by the last word but one, those before it and the last; their counts."""
    columns = [*grams[-2::-1], grams[-1]]
    if bits * len(columns) <= 64:
        x = columns[0].astype(_U)
        for word in columns[1:]:
            x <<= _U(bits)
            x |= word
        x.sort()
        first = np.flatnonzero(_new(x))
        x = x[first]
        columns = [(x >> _U(bits * i) & _U((1 << bits) - 1)).astype(grams[0].dtype) for i in range(len(columns) - 1, -1, -1)]
    else:
        order = np.lexsort(columns[::-1])
        x = [word[order] for word in columns]
        first = np.flatnonzero(np.any([_new(word) for word in x], 0))
        columns = [word[first] for word in x]
    return [*columns[-2::-1], columns[-1]], np.diff(np.append(first, len(grams[0])))


def _pack(names: np.ndarray, grams: list[np.ndarray], c: np.ndarray) -> bytes:
    """Grams in order of the last word but one: the words' sorted hashes by their differences, each gram's words as places
    among them, counts in a byte with 255 for the few larger ones, which follow; compressed."""
    grams = [g.astype("<u4") for g in grams]
    grams[-2] = np.diff(grams[-2], prepend=np.uint32(0))
    small, big = np.minimum(c, 255).astype(np.uint8), c[c >= 255]
    body = _planes(np.diff(names, prepend=_U(0))) + b"".join(map(_planes, grams)) + small.tobytes() + big.astype("<u8").tobytes()
    return np.array([len(names), len(c), len(big), len(body)], "<u8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    words, n, big, size = np.frombuffer(blob, "<u8", 4).astype(int).tolist()
    body = pa.decompress(blob[32:], decompressed_size=size, codec="zstd", asbytes=True)
    names, body = np.cumsum(_of_planes(body, words), dtype=_U), memoryview(body)[8 * words:]
    planes = np.frombuffer(body, np.uint8, 4 * order * n).reshape(order, 4, n)
    at = planes.transpose(0, 2, 1).copy().view("<u4").reshape(order, n)
    at[-2] = np.cumsum(at[-2], dtype=np.uint32)
    c = np.frombuffer(body, np.uint8, n, 4 * order * n).astype(np.int64)
    c[c == 255] = np.frombuffer(body, "<u8", big, (4 * order + 1) * n).astype(np.int64)
    return [names[x] for x in at], c


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under a temporary name and rename, so that a repeated task replaces a whole file by the same."""
    path = _local(folder)
    if path is None:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        part = f"{base}/{name}.part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(array.tobytes())
        fs.move(part, f"{base}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/{name}.part-{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{path}/{name}")


def _packed_keys(key: np.ndarray, whole: int) -> np.ndarray:
    """Bytes of sorted keys: their number, the bits of a bucket, where each bucket begins, and of each key the other bits
    in four and two bytes; below ``whole`` keys there are no buckets and all eight bytes follow."""
    n = len(key)
    bits = max((n // 16).bit_length() - 1, 16) if n >= whole else 0
    parts = [np.array([n, bits], "<u8"), key.astype("<u8")]
    if bits:
        rest = key & _U((1 << 64 - bits) - 1)
        cuts = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U))
        parts[1:] = [cuts.astype("<u4"), (rest >> _U(16)).astype("<u4"), (rest & _U(0xFFFF)).astype("<u2")]
    return np.concatenate([x.view(np.uint8) for x in parts])


def _places(packed: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key among packed ones, -1 for keys that are not there."""
    n, bits = packed[:16].view("<u8").astype(int).tolist()
    if not n or not len(key):
        return np.full(len(key), -1)
    if not bits:
        keys = packed[16:].view("<u8")
        at = np.minimum(np.searchsorted(keys, key), n - 1)
        return np.where(keys[at] == key, at, -1)
    edge = 16 + 4 * ((1 << bits) + 1)
    cuts, high, low = packed[16:edge].view("<u4"), packed[edge:edge + 4 * n].view("<u4"), packed[edge + 4 * n:].view("<u2")
    bucket, rest = (key >> _U(64 - bits)).astype(np.int64), key & _U((1 << 64 - bits) - 1)
    h, l = (rest >> _U(16)).astype("<u4"), (rest & _U(0xFFFF)).astype("<u2")
    begin, end = cuts[bucket].astype(np.int64), cuts[bucket + 1].astype(np.int64)
    # Hashes are spread evenly, so a key is a few steps from its share of the bucket.
    at = begin + ((rest >> _U(16)) * (end - begin).astype(_U) >> _U(48 - bits)).astype(np.int64)
    go = np.flatnonzero(at < end)
    while len(go := go[high[at[go]] < h[go]]):
        at[go] += 1
        go = go[at[go] < end[go]]
    go = np.flatnonzero(at > begin)
    while len(go := go[high[at[go] - 1] >= h[go]]):
        at[go] -= 1
        go = go[at[go] > begin[go]]
    same = np.flatnonzero(at < end)
    same = go = same[high[at[same]] == h[same]]
    while len(go := go[low[at[go]] < l[go]]):
        at[go] += 1
        go = go[at[go] < end[go]]
        go = go[high[at[go]] == h[go]]
    same = same[at[same] < end[same]]
    same = same[(high[at[same]] == h[same]) & (low[at[same]] == l[same])]
    out = np.full(len(key), -1)
    out[same] = at[same]
    return out


def _save_table(folder: str, name: str, key: np.ndarray, values: np.ndarray, whole: int) -> None:
    """Keys, and values in a byte, 255 for the few larger ones, whose places and values follow in a file of their own."""
    _save(folder, f"{name}.key", _packed_keys(key, whole))
    flat = np.append(values.reshape(-1), 0)
    place = np.flatnonzero(flat >= 255)
    _save(folder, f"{name}.small", np.minimum(flat, 255).astype(np.uint8))
    _save(folder, f"{name}.big", np.stack([np.append(place, -1), np.append(flat[place], 0)], 1).astype("<i8"))


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the model as an array over mapped memory; a remote one is copied to an unlinked local file first."""
    path = _local(folder)
    if path is None:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{base}/{name}") as source:
            while part := source.read(1 << 24):
                copy.write(part)
            copy.flush()
            return np.memmap(copy, kind, "r")
    file = f"{path}/{name}"
    return np.memmap(file, kind, "r")


def _counted(shards: int, order: int):
    """Blocks of distinct grams by shard of the last word but one."""
    def flush(texts: list[np.ndarray]) -> pa.RecordBatch:
        last, sizes = _joined(texts)
        texts.clear()
        names, last = _numbered(last)
        names = np.append(names, BEGIN)
        # Words are numbered by their shard, so that sorted grams lie together by shard.
        by = np.lexsort((names, names % _U(shards)))
        names, number = names[by], np.empty(len(by), np.uint32)
        number[by] = np.arange(len(by), dtype=np.uint32)
        last = number[last]
        grams, c = _distinct(grams_of(last, sizes, order, number[-1]), len(by).bit_length())
        cuts = np.searchsorted(grams[-2], np.searchsorted(names % _U(shards), np.arange(shards + 1, dtype=_U)).astype(np.uint32))
        place, rows = np.zeros(len(by), np.uint32), []
        for s in range(shards):
            own = slice(cuts[s], cuts[s + 1])
            if cuts[s] < cuts[s + 1]:
                used = np.unique(np.concatenate([g[own] for g in grams]))
                used = used[np.argsort(names[used])]
                place[used] = np.arange(len(used), dtype=np.uint32)
                rows.append((s, _pack(names[used], [place[g[own]] for g in grams], c[own])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                          ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, texts, count = Hasher(), [], 0
        for batch in batches:
            for t in batch.column(0):
                texts.append(encode(t.as_py()))
                count += len(texts[-1])
                if count >= BLOCK_TOKENS:
                    yield flush(texts)
                    texts, count = [], 0
        if texts:
            yield flush(texts)
    return run


def _frequencies(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _shard_of_grams(folder: str, shards: int, order: int, whole: int):
    """Merge a shard's blocks, write its grams and contexts of every length, pass on its words' counts by their own shard."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s, frequencies = int(rows["shard"].iloc[0]), []
        sizes = [int(np.frombuffer(x, "<u8", 1, 8)[0]) for x in rows["block"]]
        grams, c, end = [np.empty(sum(sizes), _U) for _ in range(order)], np.empty(sum(sizes), np.int64), 0
        for x, n in zip(rows["block"], sizes):
            part, c[end:end + n] = _unpack(x, order)
            for whole_column, column in zip(grams, part):
                whole_column[end:end + n] = column
            end += n
        for k in range(order, 1, -1):
            key, grams, c = _merge(grams, c)
            _save(folder, f"{_GRAMS}{k}-{s}.once", _packed_keys(key[c == 1], whole))
            _save_table(folder, f"{_GRAMS}{k}-{s}", key[c > 1], c[c > 1], whole)
            del key
            context, *stats = _sums(gram_keys(grams)[0], c, *((c == i if i < 3 else c >= 3).astype(np.int64) for i in (1, 2, 3)))
            # Begin marks alone are no gram, so their context is always kept.
            kept = (stats[0] > 1) | (context == gram_keys([np.array([BEGIN])] * k)[0])
            _save_table(folder, f"{_CONTEXTS}{k}-{s}", context[kept], np.column_stack(stats)[kept], whole)
            frequencies = _frequencies(c) + frequencies
            if k == order:
                word, count = _sums(grams[-1], c)
            if k > 2:
                grams, c = grams[1:], np.ones(len(c), np.int64)
        before = _sums(grams[-1], np.ones(len(c), np.int64))[1]
        to = (word % _U(shards)).astype(np.int64)
        out = [(int(t), _blob(*(x[to == t] for x in (word, count, before)))) for t in np.unique(to)]
        found = [(t, blob, []) for t, blob in out] + [(-1 - s, b"", frequencies)]
        return pd.DataFrame(found, columns=["shard", "block", "frequencies"])
    return run


def _shard_of_words(folder: str, whole: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        word, count, before = _sums(*map(np.concatenate, zip(*map(_of_blob, rows["block"]))))
        count, before = count.astype(np.int64), before.astype(np.int64)
        _save_table(folder, f"{_WORDS}-{s}", word, np.column_stack([count, before]), whole)
        return pd.DataFrame([(s, int(count.sum()), len(word), int(before.sum()), _frequencies(before), int((before >= 3).sum()))],
                            columns=["shard", "tokens", "words", "pairs", "frequencies", "frequent"])
    return run


def discounts(f: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of entries counted 1 to 4 times.

    Where a number needed is 0, as in tiny tables, the discount is half a count.
    """
    y = f[0] / (f[0] + 2 * f[1]) if f[0] else 0.0
    out = [0.0]
    for i in (1, 2, 3):
        d = i - (i + 1) * y * f[i] / f[i - 1] if f[i - 1] and f[i] else 0.5
        out.append(min(max(d, 0.05), i - 0.05))
    return np.array(out)


@dataclass
class Model:
    folder: str
    shards: int
    tokens: int
    words: int
    pairs: int
    gram_discounts: dict[int, np.ndarray]  # by length
    word_discounts: np.ndarray
    rest: float  # share that the discounted word distribution leaves to all words alike
    full: dict[str, frozenset[int]]  # shards with words, and with grams and contexts

    def _open(self, name: str, s: int, kind: str) -> np.ndarray:
        cache = self.__dict__.setdefault("_files", {})
        if (name, s) not in cache:
            cache[name, s] = np.asarray(_mapped(self.folder, name.replace("*", str(s)), kind))
        return cache[name, s]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_files"}

    def _find(self, table: str, width: int, dealt: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Values of distinct keys in the sorted arrays of a table, 0 where it has none; ``dealt`` chooses the shard."""
        out = np.zeros((len(key), width), np.int64)
        # By shard, and within it nearly in order of the hash; the rest of the word is the place.
        of_shard, of_place = _U(self.shards.bit_length()), _U(len(key).bit_length())
        order = np.sort(dealt % _U(self.shards) << _U(64) - of_shard | key >> of_shard >> of_place << of_place
                        | np.arange(len(key), dtype=_U))
        cuts = np.searchsorted(order >> _U(64) - of_shard, np.arange(self.shards + 1, dtype=_U))
        order = (order & (_U(1) << of_place) - _U(1)).astype(np.int64)
        for s in range(self.shards):
            own = order[cuts[s]:cuts[s + 1]]
            if not len(own) or s not in self.full[_WORDS if table == _WORDS else _GRAMS]:
                continue
            if table.startswith(_GRAMS):
                once = _places(self._open(f"{table}-*.once", s, "u1"), key[own]) >= 0
                out[own[once]] = 1
                own = own[~once]
            at = _places(self._open(f"{table}-*.key", s, "u1"), key[own])
            values = self._open(f"{table}-*.small", s, "u1")[:-1].reshape(-1, width)
            hit = at >= 0
            place, found = at[hit], values[at[hit]]
            row, column = np.nonzero(found == 255)
            found = found.astype(np.int64)
            if len(row):
                big = self._open(f"{table}-*.big", s, "<i8").reshape(-1, 2)
                found[row, column] = big[np.searchsorted(big[:-1, 0], place[row] * width + column), 1]
            out[own[hit]] = found
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score (log10) of each encoded text."""
        last, sizes = _joined(texts)
        starts = np.cumsum(sizes) - sizes
        words, word = _numbered(last)
        values = self._find(_WORDS, 2, words, words)
        count, before = values[word].T
        chance = (before - self.word_discounts[np.minimum(before, 3)]) / max(self.pairs, 1) + self.rest / (self.words + 1)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        # The distinct grams of one length: hash, last word and count; and the number of the one that ends at each token.
        key, end, c, at = words, words, values[:, 0], word
        for k, d in sorted(self.gram_discounts.items()):
            # A token's context is the shorter gram that ends at the token before, number 0 at a text's begin.
            key = np.append(gram_keys([np.array([BEGIN])] * k)[0], key)
            end = np.append(BEGIN, end)
            total, n1, n2, n3 = self._find(f"{_CONTEXTS}{k}", 4, end, key).T
            # A known one that the table leaves out has one follower, once.
            once = np.append(False, c > 0) & (total == 0)
            total, n1 = np.maximum(total + once, 1), n1 + once
            back = np.where((n1 > 0) | (n2 > 0) | (n3 > 0), (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1.0)
            context = np.append(_U(0), at[:-1] + _U(1))
            context[starts] = 0
            first, at = _numbered_pairs(context, word)
            key, end, dealt = mix(key[context[first]], last[first]), last[first], end[context[first]]
            c = self._find(f"{_GRAMS}{k}", 1, dealt, key)[:, 0]
            chance = (c - d[np.minimum(c, 3)])[at] / total[context] + back[context] * chance
        return (np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts),
                np.add.reduceat(np.log10(chance), starts))


def train(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, order: int = 2, whole_keys: int = WHOLE_KEYS) -> Model:
    """A model of grams of up to ``order`` words.

    Count all of ``docs`` and write the model into the shared folder. Null texts count as empty: an end only.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    raw = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    size = raw.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(ceil(size / shard_bytes), 4)
    folder = fresh_path(spark, "kneser-ney")
    blocks = raw.mapInArrow(_counted(shards, order), "shard int, block binary")
    passed = stored(blocks.groupBy("shard").applyInPandas(_shard_of_grams(folder, shards, order, whole_keys),
                                                          "shard int, block binary, frequencies array<long>"), "word-blocks")
    with_grams = passed.where("shard < 0").select(-1 - F.col("shard"), "frequencies").collect()
    f = np.reshape(np.sum([r[1] for r in with_grams], 0) if with_grams else [0] * 4 * (order - 1), (order - 1, 4)).tolist()
    done = stored(passed.where("shard >= 0").select("shard", "block").groupBy("shard").applyInPandas(
        _shard_of_words(folder, whole_keys), "shard int, tokens long, words long, pairs long, frequencies array<long>, frequent long"), "word-shards")
    with_words = done.collect()
    tokens, words, pairs, frequent = (sum(r[c] for r in with_words) for c in ("tokens", "words", "pairs", "frequent"))
    g = np.sum([r["frequencies"] for r in with_words], 0) if with_words else [0] * 4
    by_word = discounts([int(x) for x in g])
    rest = float(by_word[1] * g[0] + by_word[2] * g[1] + by_word[3] * frequent) / pairs if pairs else 1.0
    full = {_WORDS: frozenset(r["shard"] for r in with_words), _GRAMS: frozenset(r[0] for r in with_grams)}
    return Model(folder, shards, tokens, words, pairs, {k + 2: discounts(x) for k, x in enumerate(f)}, by_word, rest, full)


def _scored(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        encode, rows, texts, count = Hasher(), [], [], 0

        def flush() -> pa.RecordBatch:
            known, base, score = model.score(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array(known), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for t, key, held in zip(*batch.columns):
                texts.append(encode(t.as_py()))
                rows.append((key.as_py(), held.as_py()))
                count += len(texts[-1])
                if count >= SCORE_TOKENS:
                    yield flush()
                    rows, texts, count = [], [], 0
        if rows:
            yield flush()
    return run


def held_out(key: str = "doc_id", parts: int = 5, part: int = 1):
    """Whether a row is kept from training; a row without an id is."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(True))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` of every row, null texts as empty ones, repeats each."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), F.col(key).cast("long").alias("doc_id"),
                       held_out(key).alias("held_out"))
    return rows.mapInArrow(_scored(handle), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame):
    """Perplexity per document: ten to the mean negative log10 probability of its tokens."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
