"""Language identification by cross-parsing.

A suffix automaton of sample text per language reads a document and tells where its longest match with the
sample ends; the next phrase starts there, and a character that the sample lacks is a phrase of its own. The
language whose sample needs the fewest phrases, weighed by the bits that name a place in the sample, wins. The
transitions of all states lie in one array, each state's shifted to free places, so that many pieces of text
advance by one character in a few vector operations. Texts are cut to pieces of fixed length for this; a phrase
ends with its piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagline.llm.shared import stored

# Sample characters per language (all languages together at most MAX_CHARS), chosen among CHOICE times as many; from about
# SAMPLE_DOCS documents per language, of the MAX_LABELS commonest labels; shingle by which a line counts as new to the sample.
SAMPLE_CHARS, MAX_CHARS, CHOICE, SAMPLE_DOCS, MAX_LABELS, NEW = 20_000, 2_000_000, 10, 400, 2_000, 12
# Longer lines are cut to stretches, all of which may be drawn.
STRETCH = 400
PIECE = 512
BATCH_CHARS = 4_000_000
UNKNOWN, SPACE = 0, 1


@cache
def _folded() -> np.ndarray:
    """Every code point's letter without case; zero for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@dataclass
class Alphabet:
    """Symbol of every character: letters of the samples without case, each its own; other letters unknown; the rest spaces."""

    symbols: np.ndarray
    letters: np.ndarray
    size: int

    @classmethod
    def of(cls, texts: list[str]) -> Alphabet:
        folded = _folded()
        seen = np.zeros(len(folded), bool)
        for t in texts:
            seen[folded[_points(t)]] = True
        seen[0] = False
        code = np.zeros(len(folded), np.int32)
        code[seen] = np.arange(2, 2 + int(seen.sum()))
        return cls(np.where(folded > 0, code[folded], SPACE).astype(np.int32), folded > 0, int(seen.sum()) + 2)

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text, runs of spaces as one; whether it has a letter."""
        points = _points(text)
        out = self.symbols[points]
        space = out == SPACE
        return out[~(space & np.append(False, space[:-1]))], bool(self.letters[points].any())


@dataclass
class Automaton:
    """Transitions of state ``s`` by symbol ``c`` at ``base[s] + c``, valid where ``owner`` there is ``s``.

    ``root`` holds the state after a phrase's first symbol. The last state has no transitions: a parse is there before its
    first symbol and after one that the sample lacks.
    """

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    root: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more symbol each, and whether it began a phrase."""
        at = self.base.take(state) + symbol
        new = self.owner.take(at) != state
        return np.where(new, self.root.take(symbol), self.target.take(at)), new


def automaton(sample: np.ndarray, size: int) -> Automaton:
    """The suffix automaton of ``sample`` over ``size`` symbols."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample.tolist():
        own = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = own
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[own] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[own] = copy
        last = own
    return _placed(steps, size)


def _placed(steps: list[dict[int, int]], size: int) -> Automaton:
    """Rows of transitions shifted so that no two need the same place; the longest rows choose first."""
    dead = len(steps)
    root = np.full(size, dead, np.int32)
    root[list(steps[0])] = list(steps[0].values())
    total = sum(map(len, steps[1:]))
    base = np.zeros(dead + 1, np.int32)
    free = np.ones(3 * size + 2 * total + 4096, bool)
    placed: list[tuple[int, np.ndarray]] = []
    rows = sorted((s for s in range(1, dead) if len(steps[s]) > 1), key=lambda s: -len(steps[s]))
    low, width = size, 0
    for s in rows:
        symbols = np.fromiter(steps[s], np.int64)
        if len(symbols) != width:
            low, width = size, len(symbols)
        least = int(symbols.min())
        while True:
            if low + 2048 + size > len(free):
                free = np.append(free, np.ones(len(free), bool))
            fits = free[low:low + 2048].copy()
            for c in symbols:
                if c != least:
                    fits &= free[low + c - least:low + c - least + 2048]
            k = int(fits.argmax())
            if fits[k]:
                break
            low += 2048
        low += k
        base[s] = low - least
        at = base[s] + symbols
        free[at] = False
        placed.append((s, at))
    single = [s for s in range(1, dead) if len(steps[s]) == 1]
    at = size + np.flatnonzero(free[size:])[:len(single)]
    # Every base may be read with every symbol.
    owner, target = np.full(len(free) + size, -1, np.int32), np.zeros(len(free) + size, np.int32)
    for s, own in placed:
        owner[own], target[own] = s, list(steps[s].values())
    owner[at], target[at] = single, [next(iter(steps[s].values())) for s in single]
    base[single] = at - [next(iter(steps[s])) for s in single]
    end = int(base.max()) + size
    return Automaton(base, owner[:end], target[:end], root)


@dataclass
class Model:
    languages: list[str]
    alphabet: Alphabet
    tables: list[Automaton]
    bits: np.ndarray

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language's sample needs for each encoded text."""
        pieces = [max(-(-len(t) // PIECE), 1) for t in texts]
        codes = np.zeros((sum(pieces), PIECE), np.int32)
        sizes = np.full(len(codes), PIECE)
        ends = np.cumsum(pieces)
        flat = codes.reshape(-1)
        for t, e, n in zip(texts, ends, pieces):
            flat[(e - n) * PIECE:(e - n) * PIECE + len(t)] = t
            sizes[e - 1] = len(t) - (n - 1) * PIECE
        order = np.argsort(-sizes, kind="stable")
        alive = np.searchsorted(-sizes[order], -np.arange(PIECE), "left")
        by_step = np.ascontiguousarray(codes[order].T)
        out = np.zeros((len(self.tables), len(texts)), np.int64)
        for k, table in enumerate(self.tables):
            state, count = np.full(len(codes), len(table.base) - 1, np.int32), np.zeros(len(codes), np.int32)
            for step in range(PIECE):
                n = alive[step]
                if not n:
                    break
                state[:n], new = table.step(state[:n], by_step[step, :n])
                count[:n] += new
            back = np.empty_like(count)
            back[order] = count
            out[k] = np.add.reduceat(back, ends - pieces)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [self.alphabet.encode(t) if t else (np.zeros(0, np.int32), False) for t in texts]
        if not self.tables or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.phrases([c for c, _ in coded]) * self.bits[:, None]
        best = cost.argmin(0)
        low = cost[best, np.arange(len(texts))]
        rest = np.sort(cost, 0)[1] if len(cost) > 1 else None
        score = np.ones(len(texts)) if rest is None else rest / np.maximum(rest + low, 1e-9)
        return ([self.languages[b] if some else "und" for b, (_, some) in zip(best, coded)],
                [float(s) if some else 0.0 for s, (_, some) in zip(score, coded)])


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning; a row without an id is."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(True))


def _fresh_lines(lines: list[str], per: int) -> list[str]:
    """Lines most of whose shingles are new, up to twice the sample's size."""
    seen: set[str] = set()
    out, size = [], 0
    for line in lines:
        parts = {line[i:i + NEW] for i in range(max(len(line) - NEW + 1, 1))}
        if size < 2 * per and 2 * len(parts - seen) > max(len(parts), len(line) - NEW):
            seen |= parts
            out.append(line)
            size += len(line)
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Automata from a bounded sample of the labelled rows: the documents of lowest id hash.

    Common texts must not crowd out the language: a line is taken if most of it is new to the sample and to itself, and lines
    seen under several labels are left out.
    Sampled documents take part whole: lines longer than STRETCH are cut, and lines are read in the order of their hash.
    Languages are the distinct labels, in order, the MAX_LABELS commonest if there are more; one whose sampled texts hold no
    letter is not learned.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 30)).alias("draw"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LABELS).collect()}
    per = min(SAMPLE_CHARS, MAX_CHARS // max(len(counts), 1))

    def with_limit(rows: DataFrame, drawn: str, wanted: float, totals: dict[str, int]) -> DataFrame:
        """Rows whose draw of ``1 << 30`` lies in their label's share; at most MAX_LABELS labels."""
        shares = [(name, min(1 << 30, int((1 << 30) * wanted / max(n, 1)) + 1)) for name, n in totals.items()]
        limits = docs.sparkSession.createDataFrame(shares, "lang string, upto long")
        return rows.join(F.broadcast(limits), "lang").where(F.col(drawn) <= F.col("upto")).drop("upto")

    parts = with_limit(labelled, "draw", SAMPLE_DOCS, counts).select("lang", F.explode(
        F.regexp_extract_all("text", F.lit(r"([^\n]{1,%d})" % STRETCH), F.lit(1))).alias("line"))
    lines = stored(parts.groupBy("line").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other").select(
        "lang", "line", F.pmod(F.xxhash64(F.lit(12), "line"), F.lit(1 << 30)).alias("place")), "language-lines")
    sizes = {r[0]: r[1] for r in lines.groupBy("lang").agg(F.sum(F.length("line"))).collect()}
    rows = with_limit(lines, "place", CHOICE * per, sizes).select("lang", "place", "line").collect()
    found: dict[str, list[str]] = {name: [] for name in sorted(sizes)}
    for name, _, line in sorted(map(tuple, rows)):
        found[name].append(line)
    return build(_own_lines({name: _fresh_lines(own, per) for name, own in found.items()}, per), per)


def build(texts: dict[str, list[str]], per: int = SAMPLE_CHARS) -> Model:
    """Automata of the given lines by language; languages without a letter are left out."""
    alphabet = Alphabet.of([t for own in texts.values() for t in own])
    samples = {name: alphabet.encode("\n".join(own))[0][:per] for name, own in texts.items() if any(map(str.isalpha, "".join(own)))}
    return Model(list(samples), alphabet, [automaton(s, alphabet.size) for s in samples.values()],
                 np.array([np.log2(len(s) + 1) for s in samples.values()]))


def _own_lines(texts: dict[str, list[str]], per: int) -> dict[str, list[str]]:
    """Lines that the other half of the sample takes for their label's, as documents also hold foreign lines."""
    kept: dict[str, list[str]] = {name: [] for name in texts}
    for half in (0, 1):
        model = build({name: own[1 - half::2] for name, own in texts.items()}, per)
        for name, own in texts.items():
            found = model.predict(own[half::2])[0]
            kept[name] += [t for t, f in zip(own[half::2], found) if f == name or name not in model.languages]
    return {name: kept[name] or own for name, own in texts.items()}


def _predicted(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        for batch in batches:
            keys, held, texts = batch.columns
            sizes = np.cumsum([len(t) for t in texts.to_pylist() if t is not None] or [0])
            step = max(1, int(batch.num_rows * BATCH_CHARS / max(int(sizes[-1]), 1)))
            for at in range(0, batch.num_rows, step):
                part = texts.slice(at, step).to_pylist()
                names, scores = model.predict(part)
                yield pa.RecordBatch.from_arrays([keys.slice(at, step), held.slice(at, step), pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, repeats each.

    A null text and one without a letter is ``und`` with score 0, as is every text where nothing was learned.
    The score is the runner-up's share of the bits that it and the winner need: a half for a tie, 1 where only one
    language was learned. Of languages with equal costs the first in order wins.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_predicted(handle), "doc_id long, held_out boolean, lang_pred string, score double")
