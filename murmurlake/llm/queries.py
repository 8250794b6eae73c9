"""Queries over the corpus tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html_extract,
    line_dedup,
    minhash,
    ngram_join,
    pii,
    prefix_trie,
    resample,
    suffix_dedup,
    token_count,
    toxicity,
)

#: The setting that holds the key of pseudonyms.
KEY_SETTING = "spark.murmurlake.pii.key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of ``KEY_SETTING``; where it is unset the session gets a random one, so nobody who reads the code can invert pseudonyms."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return pii.documents_with_pii(_table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.train(docs, labels))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.kept_text")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_of_rows(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_run_length_index,
            op2_decontaminate,
            op3_feistel_pii,
            op4_toxicity,
            op5_ngram_join,
            op6_token_counts,
            op7_line_dedup,
            op8_html_extract,
            op9_exact_dedup,
            op10_bpe,
            op11_resample,
            op12_minhash,
            op13_prefix_trie,
        )
    }


OP7_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i - 1 AS line, array_to_string(ls[i:i + 2], chr(10)) AS three
  FROM l, unnest(range(1, len(ls) - 1)) AS u(i) WHERE len(ls) >= 3),
s AS (SELECT * FROM w WHERE regexp_replace(three, '\\s+', '', 'g') <> ''),
r AS (
  SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, line) AS k FROM s),
g AS (
  SELECT DISTINCT doc_id, line + d AS line FROM r, unnest([0, 1, 2]) AS u(d) WHERE k > 1),
p AS (
  SELECT l.doc_id, i - 1 AS line, ls[i] AS t FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
q AS (
  SELECT p.doc_id, count(g.line) AS n_removed, string_agg(p.t, chr(10) ORDER BY p.line) FILTER (g.line IS NULL) AS kept
  FROM p LEFT JOIN g USING (doc_id, line) GROUP BY p.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept_text
FROM l LEFT JOIN q USING (doc_id)
"""

OP9_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


OP11_SQL = r"""
WITH w AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
x AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM w)),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(hx), 2),
    lambda i: [('0x' || hx[i:i + 1])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295) % 10000 AS bucket
  FROM x),
f AS (SELECT side, doc_id, bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM f GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM s),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain
  FROM s, z),
d AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
e AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
k AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)
"""

OP13_SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, o.role, o.text, 0 AS own, o.pos FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.role, o.text, 1, o.pos FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
s AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, pos) AS keys,
    list(octet_length(encode(text)) ORDER BY own, pos) AS sizes
  FROM r GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM c LEFT JOIN s USING (conv_id)),
m AS (
  SELECT conv_id, d AS depth, len(keys) AS n, array_to_string(keys[1:d], ' ') AS path,
    CASE WHEN d > 0 THEN array_to_string(keys[1:d - 1], ' ') END AS up, coalesce(sizes[d], 0) AS size
  FROM a, unnest(range(0, len(keys) + 1)) AS u(d)),
t AS (
  SELECT path, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(size) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM m GROUP BY path),
k AS (SELECT up AS path, count(*) AS n FROM t WHERE up IS NOT NULL GROUP BY up),
e AS (
  SELECT array_to_string(string_split(path, ' ')[1:d], ' ') AS path, sum(saved) AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves
  FROM t LEFT JOIN k USING (path), unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, coalesce(k.n, 0) AS n_children, e.n_leaves,
  e.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM t JOIN e USING (path) LEFT JOIN k USING (path) LEFT JOIN t p ON t.up = p.path
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_resample": OP11_SQL, "op13_prefix_trie": OP13_SQL}
