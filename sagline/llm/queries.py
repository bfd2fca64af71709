"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagline.llm import chat, cube, hilbert, kneser, language, lines, nra, passages, quality, simhash, tokens, vptree, whitening
from sagline.llm.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_suffix_decontamination(spark, sf):
    found = passages.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"), unnamed=True)
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


# Windows are compared as words joined by a space: ten words of an item, or all of a shorter one.
ORACLES["op1_suffix_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, m WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_hilbert_shards(spark, sf):
    found = hilbert.hilbert_shards(table(spark, sf, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_fuzzy_lines(spark, sf):
    found = lines.repeated_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


@query
def op4_typed_parts(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    told = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = chat.format_chat(chat.text_parts(rows.unionByName(told)))
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.body, F.lit("\n"))), "")
    back = found.select("conv_id", "formatted", F.size(turns).cast("long").alias("n_turns"), said.alias("said"),
                        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


# Every control string inside a text costs one character of escape, every turn 27 for its control strings.
ORACLES["op4_typed_parts"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, esc)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, esc) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(esc) + 27) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op5_cube_mix(spark, sf):
    found = cube.mix(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op6_simhash_groups(spark, sf):
    found = simhash.near_groups(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_weak_label_quality(spark, sf):
    found = quality.judged(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_weak").alias("weak_label"), F.col("_score").alias("score"), F.col("_keep").alias("keep"))


@query
def op8_cross_parsing(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.learn(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    return language.identify(docs, model)


@query
def op9_vantage_point_search(spark, sf):
    return vptree.nearest(table(spark, sf, "embeddings"))


# Sums run from first to last component of vectors scaled by powers of two, as in the operator.
ORACLES["op9_vantage_point_search"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x * pow(2, -floor(log2(list_max(list_transform(e, lambda y: abs(y))))))) AS e FROM v),
n AS (SELECT vec_id, e, list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y) AS s FROM u),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda x, y: x + y) / (sqrt(q.s) * sqrt(c.s)) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
WHERE rank <= 5
"""


@query
def op10_kneser_ney(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = kneser.train(docs.where(~kneser.held_out()), order=3)
    found = kneser.perplexity(kneser.score(docs, model))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                        "base_score", "score", "perplexity")


@query
def op11_incremental_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings").select("vec_id", whitening.quantised("embedding", 256).alias("x")), "vec_id", "x", 4)


@query
def op12_digest_token_counts(spark, sf):
    """The cache starts empty, so that every distinct text is encoded and appended in the run."""
    import public_tokenizers

    found = tokens.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op13_nra_search(spark, sf):
    return nra.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES["op13_nra_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
qt AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS t FROM q) GROUP BY ALL),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
dt AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM dt GROUP BY t),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(c * CAST(floor(1000 * ln((2 * total.n + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * dt.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM qt JOIN dt USING (t) JOIN f USING (t), total GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
