"""Token counts through a digest cache.

A text's count depends on its bytes and on the tokenizer alone, so counts are stored under two digests: of the
content, and of the tokenizer (library, its version, vocabulary file). Rows are reduced to content digests,
joined to the stored counts, and only the distinct texts without one are encoded and appended. Rows then meet
their counts by digest. A cache is a Parquet folder, partitioned by tokenizer digest; appending is one Spark
write, so a lost executor or a stopped job leaves no partial batch, and a second run finds what the first one stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline.llm.shared import bounded, stored

CACHE = "tokenizer string, digest binary, n_bytes long, n_tokens long"
# Missing digests are broadcast up to this count (32 bytes each), so that only their texts are shuffled.
BROADCAST_ROWS = 200_000
# A task remembers the counts of about this many words at a time; longer words are not remembered.
MEMO_WORDS, MEMO_LENGTH = 400_000, 64
# New words go to the library so many at a time, texts that may not be cut one at a time.
CALL_WORDS = 5_000
# Texts are counted in groups of about this many characters.
GROUP_CHARS = 1_000_000

Count = Callable[[list[str]], list[int]]


@dataclass(frozen=True)
class Version:
    """A tokenizer: the kind of its file, the file's bytes, and the digest of both with the library's version."""

    kind: str
    data: bytes
    digest: str


def version(path: str) -> Version:
    """Read a vocabulary file: ``.json`` is for ``tokenizers``, ``.model`` for ``sentencepiece``."""
    kind = Path(path).suffix
    if kind == ".json":
        import tokenizers as library
    elif kind == ".model":
        import sentencepiece as library
    else:
        raise ValueError(f"no library for {path}")
    data = Path(path).read_bytes()
    mark = f"{library.__name__} {library.__version__} plain\n".encode()
    return Version(kind, data, hashlib.sha256(mark + data).hexdigest())


# Before a space that follows a character which is no white space in any table.
_CUT = re.compile(r"(?<=\S)(?= )")


def cuts_at_spaces(data: bytes) -> bool:
    """Whether a ``tokenizers`` file gives a text the sum of its pieces' counts when it is cut as in ``_CUT``.

    The byte-level pattern never joins white space to what stands before it, and looks ahead only from white space.
    """
    said = json.loads(data)
    before = said.get("pre_tokenizer") or {}
    added = said.get("added_tokens") or []
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and not said.get("normalizer") and not said.get("post_processor") and said["model"]["type"] == "BPE"
            and not said["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added))


def counter(kind: str, data: bytes, memo_words: int = MEMO_WORDS) -> Count:
    """A function from texts to their counts: no begin, end or added special tokens, no truncation, no padding."""
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_buffer(data)
    library.no_truncation()
    library.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(library.encode_batch_fast([t], add_special_tokens=False)[0]) for t in texts]

    if not cuts_at_spaces(data):
        return whole
    known: dict[str, int] = {}

    def learn(words: list[str]) -> None:
        """Ask the library for words' counts. Those that can stand behind each other are one text, told apart by offsets."""
        alone = [w for w in words if w[0] != " " or w[-1].isspace()]
        known.update(zip(alone, whole(alone)))
        row = [w for w in words if w[0] == " " and not w[-1].isspace()]
        for at in range(0, len(row), CALL_WORDS):
            part = row[at:at + CALL_WORDS]
            starts = np.array(library.encode("".join(part), add_special_tokens=False).offsets)[:, 0]
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            known.update(zip(part, np.diff(np.searchsorted(starts, ends), prepend=0).tolist()))

    def count(texts: list[str]) -> list[int]:
        """Sums of words' counts, each asked for once and remembered."""
        split = [_CUT.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > memo_words:
            known.clear()
            new = set().union(*split)
        learn(list(new))
        sums = [sum(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del known[w]
        return sums

    return count


@lru_cache(maxsize=2)
def _counter(kind: str, digest: str, files: Broadcast) -> Count:
    return counter(kind, files.value)


def _encode(kind: str, digest: str, files: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(kind, digest, files)
        for batch in batches:
            out: list[int] = []
            group, chars = [], 0
            for t in batch.column(1):
                group.append(t.as_py())
                chars += len(group[-1])
                if chars >= GROUP_CHARS:
                    out += count(group)
                    group, chars = [], 0
            out += count(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["digest", "n_bytes", "n_tokens"])
    return run


def read_cache(spark: SparkSession, path: str, tokenizer: Version) -> DataFrame:
    """``digest, n_bytes, n_tokens`` stored for a tokenizer, each digest once even where two runs appended it at the same time."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == tokenizer.digest).groupBy("digest").agg(
        F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` for every row of ``docs``; counts that ``cache`` lacks are appended to it.

    A null text counts as empty: no bytes, no tokens. Every row gives one row, whatever its id: ids may be null or
    repeated, and further columns of ``docs`` play no part. Equal texts are encoded once, over all runs that use the
    same cache. A change of the vocabulary file or of the library's version starts counts of its own. An empty table
    gives no rows. Texts are encoded whole: words are counted apart only where the sum of their
    counts is the text's (see :func:`cuts_at_spaces`).
    """
    spark = docs.sparkSession
    how = version(tokenizer)
    content = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    content = content.withColumns({"digest": F.unhex(F.sha2("text", 256)), "n_bytes": F.octet_length("text").cast("long")})
    rows = stored(content.select("key", "digest", "n_bytes"), "content-digests")
    asked = rows.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"))
    missing = stored(asked.join(read_cache(spark, cache, how), "digest", "left_anti"), "missing-digests")
    if missing.take(1):
        # Texts are shuffled once per task and digest; all of them only where most are missing.
        few = missing.select("digest").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = content.join(F.broadcast(missing.select("digest")), "digest", "left_semi") if few else content
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"), F.first("n_bytes").alias("n_bytes"))
        if not few:
            texts = texts.join(missing.select("digest"), "digest", "left_semi")
        files = spark.sparkContext.broadcast(how.data)
        new = texts.select("digest", "text", "n_bytes").mapInArrow(_encode(how.kind, how.digest, files), "digest binary, n_bytes long, n_tokens long")
        new.withColumn("tokenizer", F.lit(how.digest)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored(asked.select("digest").join(read_cache(spark, cache, how), "digest"), "token-counts")
    return rows.join(bounded(counts.select("digest", "n_tokens"), BROADCAST_ROWS), "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
