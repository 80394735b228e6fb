"""Registered queries of the text operators: whole tables, the parameters of the contracts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.session import shared_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)


@register
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.tokens import read_token_files, write_token_files
    folder = shared_path(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=2)
    return read_token_files(spark, folder)


@register
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.simhash import linked_groups
    return linked_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@register
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.decontaminate import overlaps
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.common import remainder
    from precinct.llm.knn import fit, score, training_labels
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, training_labels(labels, 3, 1), "quality"))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.pii import find, fit
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


@register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.rules import Cascade, judge
    docs = table(spark, sf_dir, "documents")
    return judge(docs, Cascade(docs))


ORACLES["op4_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id),
s AS (
  SELECT t.doc_id, text, words, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    n_symbols > 0.3 * n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR n_dup_lines > 0.5 * n_lines
    OR length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) > 0.6 * (length(text) - length(regexp_replace(text, '\p{L}', '', 'g')))
    OR length(text) - length(replace(text, '!', '')) > 0.5 * n_words
    OR len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 0.5 * n_words
    OR len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > 0.3 * n_words) AS kept
FROM b
"""


@register
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.licences import scan
    return scan(table(spark, sf_dir, "documents"))


@register
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.common import remainder
    from precinct.llm.toxicity import fit, score, training_labels
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, training_labels(labels, 4, 2), "toxic"))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.common import remainder
    from precinct.llm.hmm import score
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


@register
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.sharding import shard
    return shard(table(spark, sf_dir, "documents"), shards=24)


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.prefix_trie import prefix_nodes
    return prefix_nodes(table(spark, sf_dir, "conversations"))


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precinct.llm.negatives import hard_negatives
    return hard_negatives(table(spark, sf_dir, "embeddings"), every=50, positives=5, negatives=3)


ORACLES["op11_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

# The crc32 of a short text, bit by bit; the prefixes of each rebuilt conversation as lists of turns.
ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS head, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns,
    CAST(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda k: 0::UBIGINT)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS UBIGINT) AS crc
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (
  SELECT t.c, list_concat(coalesce(f.turns, [])[1:CAST(xor(t.crc, 4294967295::UBIGINT) % 4 AS BIGINT)], t.turns[CAST(xor(t.crc, 4294967295::UBIGINT) % 4 AS BIGINT) + 1:]) AS p
  FROM t LEFT JOIN t f ON f.c = t.head),
m AS (SELECT c, p[1:d] AS node, d, len(p) = d AS ends FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM b)),
n AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM m GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node),
u AS (
  SELECT node[1:a] AS node, a, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u ON u.node = w.node LEFT JOIN w f ON w.d > 0 AND f.d = w.d - 1 AND f.node = w.node[1:w.d - 1]
"""
