"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every document. Votes are counted by pattern over the
whole table; expectation-maximisation on the counts estimates how each heuristic votes on good and on bad
documents, and so a posterior for each pattern. The posteriors train a linear scorer on hashed word, shape and
repetition features, which judges every document by its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
# Documents the scorer is fitted on; the vote model uses all.
FIT_DOCS = 6000
PRIOR_GOOD = 0.5
# Words of a stretch over which variety is measured, so that it does not fall with length, and of a run that may repeat.
STRETCH, RUN = 500, 5
# Common function words of the four languages, lower case.
FUNCTION_WORDS = frozenset((
    "a and are as at be by for from in is it of on that the this to was with "
    "au avec de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der des die ein eine im in ist mit nicht sich und von zu "
    "al con de del el en es la las lo los no para por que se su un una y").encode().split())
_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
               for c in range(256))
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes(c for c in range(256) if _SHAPE[c] in b"aA")
_SPACES = b" \t\n\r\x0b\x0c"
# What is left of a text without these are symbols.
_PLAIN = _LETTERS + b"0123456789" + _SPACES + b".,;:'\"?!-()"
HEURISTICS = ("repeats", "variety", "capitals", "symbols", "tails", "bars", "function_words", "word_length")


class Counted(NamedTuple):
    """Number of words, distinct words with counts, share of words that repeat the one before, share of distinct words
    over all stretches of the text, share of runs of words that it has had before."""

    n: int
    count: Counter
    same: float
    variety: float
    looped: float


def _vote(bad: bool, good: bool = False) -> int:
    return 2 if bad else 1 if good else 0


def _looped(own: list[bytes], count: Counter) -> float:
    """Share of the runs of ``RUN`` words that the text has had before."""
    n = len(own) - RUN + 1
    if n < 2:
        return 0.0
    number = dict(zip(count, range(1, len(count) + 1)))
    at = np.fromiter(map(number.__getitem__, own), np.uint64, len(own))
    runs = at[:n].copy()
    for i in range(1, RUN):
        runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + at[i:i + n]
    return 1 - len(np.unique(runs)) / n


def _counted(text: bytes | None) -> Counted:
    own = text.split() if text else []
    n, count = len(own), Counter(own)
    distinct = len(count) if n <= STRETCH else sum(len(set(own[i:i + STRETCH])) for i in range(0, n, STRETCH))
    return Counted(n, count, sum(map(bytes.__eq__, own, own[1:])) / max(n, 1), distinct / max(n, 1), _looped(own, count))


def votes(text: bytes | None, counted: Counted | None = None) -> list[int]:
    """0 abstain, 1 good, 2 bad, for each of ``HEURISTICS``; in a text without words the last two find a fault."""
    n, count, same, variety, looped = counted or _counted(text)
    if not n:
        return [0, 0, 0, 0, 0, 0, 2, 2]
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    letters = len(text) - len(text.translate(None, _LETTERS))
    solid = len(text.translate(None, _SPACES))
    symbols = len(text.translate(None, _PLAIN))
    tails = sum([c for w, c in count.items() if w[-2:] in _TAILS]) / n
    common = sum([c for w, c in count.items() if len(w) < 6 and w.lower() in FUNCTION_WORDS]) / n
    length, long = solid / n, n >= 20
    return [_vote(same > 0.1 and n > 5), _vote((variety < 0.15 or looped > 0.5) and long),
            _vote(capitals > 0.35 * letters and letters > 10), _vote(symbols > 0.08 * solid), _vote(tails > 0.2),
            _vote(count[b"|"] > 0.12 * n), _vote(common < 0.03 and long, common > 0.08),
            _vote(not 2 <= length <= 20, 3 <= length <= 12)]


_TAILS = frozenset(bytes([a, b]) for a in range(33, 127) for b in range(33, 127)
                   if not chr(a).isalnum() and not chr(b).isalnum() and a == b)


def pattern(own: list[int]) -> int:
    out = 0
    for v in own:
        out = out * 3 + v
    return out


@dataclass
class VoteModel:
    """Class prior and, per heuristic, the chances of its votes on good and on bad documents."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of votes."""
        k = np.arange(rows.shape[1])
        a = math.log(self.prior) + np.log(self.good[k, rows]).sum(1)
        b = math.log(1 - self.prior) + np.log(self.bad[k, rows]).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> VoteModel:
    """Fit by EM.

    A bad vote names a fault and most heuristics have only that vote, so the start takes every document with one for
    bad, and counts are smoothed by one vote of each kind except for faults of good documents, which need evidence.
    """
    k, kinds = patterns.shape[1], 3
    q = np.where((patterns == 2).any(1), 0.05, 0.95)
    model = VoteModel(PRIOR_GOOD, np.full((k, kinds), 1 / 3), np.full((k, kinds), 1 / 3))
    for _ in range(rounds):
        g, b = counts * q, counts * (1 - q)
        chances = []
        for w, smooth in ((g, (1.0, 1.0, 0.05)), (b, (1.0, 1.0, 1.0))):
            seen = np.stack([(w[:, None] * (patterns == v)).sum(0) for v in range(kinds)], 1) + smooth
            chances.append(seen / seen.sum(1, keepdims=True))
        model = VoteModel(float(np.clip((g.sum() + 1) / (counts.sum() + 2), 0.01, 0.99)), *chances)
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def features(text: bytes | None, counted: Counted | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the whole text (places may repeat): shares of lower-cased words, word shapes, repetitions."""
    n, count, same, variety, looped = counted or _counted(text)
    mask, m = (1 << bits) - 1, len(count)
    if not n:
        return np.array([crc32(b"empty") & mask]), np.ones(1)
    share = np.fromiter(count.values(), np.float64, m) / n
    words = np.fromiter(map(crc32, map(bytes.lower, count)), np.int64, m)
    shapes: dict[bytes, float] = {}
    for w, c in count.items():
        w = w[:1] + w[-2:]
        shapes[w] = shapes.get(w, 0) + c
    found: dict[bytes, float] = {}
    for w, c in shapes.items():
        w = w.translate(_SHAPE)
        found[w] = found.get(w, 0) + 4 * c / n
    found |= {b"same": 8 * same, b"distinct": 2 * variety, b"looped": 2 * looped}
    others = np.fromiter((crc32(b"shape " + w) for w in found), np.int64, len(found))
    return np.concatenate([words, others]) & mask, np.concatenate([share, np.fromiter(found.values(), np.float64, len(found))])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        z = float(self.weights[at] @ value) + self.bias
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS, epochs: int = 12,
               rate: float = 0.5) -> Scorer:
    """Logistic regression on soft targets, adaptive steps, in the rows' order; classes weigh the same."""
    w, grad, bias, bias_grad = np.zeros(1 << bits), np.full(1 << bits, 1e-6), 0.0, 1e-6
    share = float(np.clip(target.mean(), 0.02, 0.98)) if len(target) else 0.5
    for _ in range(epochs):
        for (at, value), t in zip(rows, target):
            z = float(w[at] @ value) + bias
            err = (1 / (1 + math.exp(-max(min(z, 50.0), -50.0))) - t) * (0.5 / share * t + 0.5 / (1 - share) * (1 - t))
            g = err * value
            np.add.at(grad, at, g * g)
            bias_grad += err * err
            np.add.at(w, at, -rate * g / np.sqrt(grad[at]))
            bias -= rate * err / math.sqrt(bias_grad)
    return Scorer(w, bias)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t.as_py())) for t in batch.column(0)], pa.int32())], ["pattern"])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in batch.column(0):
            raw = t.as_py()
            counted = _counted(raw)
            out.append((pattern(votes(raw, counted)), *features(raw, counted)))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())),
                                          pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["pattern", "at", "value"])


def unpacked(codes: np.ndarray) -> np.ndarray:
    k = len(HEURISTICS)
    return (codes[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3


@dataclass
class Model:
    votes: VoteModel
    scorer: Scorer


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    """The vote model from all rows, the scorer from at most ``fit_docs`` rows chosen by their id's hash."""
    raw = F.col(text).cast("binary").alias("t")
    counts = docs.select(raw).mapInArrow(_patterns, "pattern int").groupBy("pattern").count().collect()
    codes = np.array([r["pattern"] for r in counts], np.int64)
    model = expectation_maximisation(unpacked(codes), np.array([r["count"] for r in counts], float))
    total = sum(r["count"] for r in counts)
    share = min(1.0, fit_docs / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(3), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 30))
    some = docs.where(draw <= int(share * (1 << 30))).select(draw.alias("_h"), raw)
    some = some.mapInArrow(_with_hash(_encoded), "h long, pattern int, at array<long>, value array<double>")
    rows = some.orderBy("h", "pattern").limit(2 * fit_docs).collect()
    target = model.posterior(unpacked(np.array([r["pattern"] for r in rows], np.int64).reshape(-1))) if rows else np.zeros(0)
    return Model(model, fit_scorer([(np.array(r["at"]), np.array(r["value"])) for r in rows], target))


def _with_hash(inner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(1)], ["t"])
            for out in inner(iter([own])):
                yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["h", *out.schema.names])
    return run


def _judge(handle, carried: int):
    """Append weak label and score; the text comes first, ``carried`` columns after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        for batch in batches:
            score, codes = [], []
            for t in batch.column(0):
                raw = t.as_py()
                counted = _counted(raw)
                codes.append(votes(raw, counted))
                score.append(model.scorer.score(*features(raw, counted)))
            weak = model.votes.posterior(np.array(codes)) if codes else np.zeros(0)
            names = batch.schema.names[1:1 + carried]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weak), pa.array(score, pa.float64())],
                                             [*names, "_weak", "_score"])
    return run


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """``docs`` with ``_weak``, ``_score`` (chances of a good document by votes and by the scorer) and ``_keep``.

    ``_keep`` says that the scorer's chance reaches ``threshold``. Null and empty texts are judged as texts
    without words, repeated rows alike, whatever their id. Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("_weak", "_score", "_keep")
    if model is None:
        model = fit(docs, text, key)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    raw = docs.select(F.col(text).cast("binary").alias("_t"), *[F.col(c) for c in docs.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = raw.mapInArrow(_judge(handle, len(docs.columns)), f"{schema}, _weak double, _score double")
    return out.withColumn("_keep", F.col("_score") >= threshold)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    text, key = options.pop("text", "text"), options.pop("key", "doc_id")
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("doc_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    return judged(rows, **options).where("_keep").select("doc.*")
