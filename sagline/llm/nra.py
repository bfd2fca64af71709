"""Ranked lexical search without random access (NRA) over impact-sorted lists.

One pass over the documents keeps, per document, its number of terms and its counts of the terms that some query
asks for. From those the corpus totals follow, and each term's number of documents. Every task then cuts its
documents into shards of bounded size, turns counts into impacts, and sorts each term's list by falling impact.
A query reads its lists from the top, all of them in steps. What a document has been seen with is its lower bound;
its upper bound adds, for every list where it was not met yet, the impact that stands next there. Documents whose
upper bound is below the k-th lower bound are out. Reading goes on until no unseen document can enter and every
document still in has equal bounds, so that members, ties and scores are exact. The shards' best rows are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagline.llm.passages import words
from sagline.llm.shared import stored

TOP = 20
# Distinct terms per query, added up, that are searched at once: they are broadcast, about 100 bytes each.
BLOCK_TERMS = 200_000
# A shard is closed when it holds so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 32_768, 2_000_000
# Entries read from every list in the first step; each step reads twice as many as the one before.
STEP = 64

POSTINGS = "doc_id long, n long, terms binary, counts binary"
FOUND = "query long, doc_id long, score long"


def _query_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(q, t.decode(), c) for q, text in zip(batch["query"], batch["text"]) for t, c in Counter(words(text)).items()]
        yield pd.DataFrame(rows, columns=["query", "term", "copies"])


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for t in batch.column(1):
                found = words(t.as_py())
                mine = sorted((number[w], c) for w, c in Counter(found).items() if w in number)
                sizes.append(len(found))
                terms.append(np.array([i for i, _ in mine], np.int32).tobytes())
                counts.append(np.array([c for _, c in mine], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()),
                                              pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])
    return run


def _frequencies(size: int):
    """Documents per term, added up within a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
        some = np.nonzero(df)[0]
        yield pd.DataFrame({"term": some, "df": df[some]})
    return run


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, docs: int, total: int) -> np.ndarray:
    """``w * ((1000000000 tf) div (1000 tf + 12 m))`` with ``m = 75 + (25 n docs) div total``, in 64-bit integers."""
    if int(n.max(initial=0)) * docs * 25 < 1 << 63:
        m = 75 + 25 * n * docs // total
    else:
        m = np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)
    tf = tf.astype(np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 12 * m))


class Lists:
    """A shard's lists: of each term its documents, numbered within the shard, by falling impact."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.docs = docs
        by = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[by], impact[by]
        self.term, start = np.unique(term[by], return_index=True)
        self.start = np.append(start, len(by))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.term, term)
        if at == len(self.term) or self.term[at] != term:
            return self.doc[:0], self.impact[:0]
        part = slice(self.start[at], self.start[at + 1])
        return self.doc[part], self.impact[part]


def best(lists: Lists, query: list[tuple[int, int]], k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``k`` best of a query (terms with their copies), their scores, and entries read.

    All documents that tie with the last are returned; every score is above 0.
    """
    own = [(d, s * c) for t, c in query for d, s in [lists.of(t)] if len(d) and s[0] > 0]
    low = np.zeros(lists.docs, np.int64)
    seen = np.zeros((len(own), lists.docs), bool)
    at, read = [0] * len(own), 0
    # What may still come from each list, for a document not yet met in it.
    next_ = np.array([s[0] for _, s in own], np.int64)
    inside = np.zeros(0, np.int64)
    met = np.zeros(lists.docs, bool)
    admit = True
    while True:
        for i, (d, s) in enumerate(own):
            if next_[i] and (admit or not seen[i, inside].all()):
                part = slice(at[i], at[i] + step)
                low[d[part]] += s[part]
                seen[i, d[part]] = True
                if admit:
                    met[d[part]] = True
                at[i] += len(d[part])
                read += len(d[part])
                next_[i] = s[at[i]] if at[i] < len(d) else 0
        step *= 2
        if admit:
            inside = np.nonzero(met)[0]
        kth = np.partition(low[inside], len(inside) - k)[len(inside) - k] if len(inside) >= k else 0
        high = low[inside] + next_.sum() - next_ @ seen[:, inside]
        keep = high >= max(kth, 1)
        inside, high = inside[keep], high[keep]
        admit = admit and next_.sum() >= max(kth, 1)
        if not admit and (low[inside] == high).all():
            return inside, low[inside], read


def _search(queries, weights, docs: int, total: int, k: int):
    def shard(ids: list, sizes: list[int], terms: list[bytes], counts: list[bytes]) -> pd.DataFrame:
        term = np.frombuffer(b"".join(terms), np.int32)
        doc = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in terms])
        impact = impacts(np.frombuffer(b"".join(counts), np.int32), np.array(sizes, np.int64)[doc], weights.value[term], docs, total)
        lists = Lists(len(ids), doc, term, impact)
        # Places in the order of ids, those without one last.
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        out = []
        for name, asked in queries.value:
            found, score, _ = best(lists, asked, k)
            first = np.lexsort((place[found], -score))[:k]
            out += [(name, ids[d], s) for d, s in zip(found[first].tolist(), score[first].tolist())]
        return pd.DataFrame(out, columns=["query", "doc_id", "score"]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        ids, sizes, terms, counts, held = [], [], [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for kept, v in zip((ids, sizes, terms, counts), row):
                    kept.append(v)
                held += len(row[2]) // 4
                if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield pa.RecordBatch.from_pandas(shard(ids, sizes, terms, counts), schema, preserve_index=False)
                    ids, sizes, terms, counts, held = [], [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pandas(shard(ids, sizes, terms, counts), schema, preserve_index=False)
    return run


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item, rank, key, score``: the ``k`` best documents above score 0 of every row of ``queries``.

    Equal scores rank by ascending id, rows without an id last. Null and empty texts, of documents or queries, have
    no terms: such documents are found by nothing, such queries find nothing. Every row of either table counts for
    itself: repeated documents are ranked one after the other, a repeated item has its ranks once per row. Further
    columns play no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(item).alias("item"),
                                  F.col(item_text).cast("binary").alias("text")), "queries")
    asked = stored(named.select("query", "text").mapInPandas(_query_terms, "query long, term string, copies long"), "query-terms")
    blocks = max(ceil(asked.count() / block_terms), 1)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    found, totals = None, None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})
        # A document without a queried term is needed for the totals alone.
        index = stored(texts.mapInArrow(_postings(vocabulary), POSTINGS), "postings")
        if totals is None:
            totals = index.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        hits = index.where(F.octet_length("terms") > 0)
        many = hits.select("terms").mapInPandas(_frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = np.zeros(max(len(terms), 1), np.int64)
        for r in many.collect():
            weights[r["term"]] = weight(r["df"], totals[0])
        plans: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            plans.setdefault(r["query"], []).append((number[r["term"]], r["copies"]))
        search = _search(spark.sparkContext.broadcast(sorted(plans.items())), spark.sparkContext.broadcast(weights), totals[0], totals[1], k)
        part = stored(hits.mapInArrow(search, FOUND), "shard-answers")
        vocabulary.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(named.select("query", "item"), "query").select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")
