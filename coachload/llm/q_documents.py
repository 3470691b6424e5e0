"""Registered queries of this subpackage: each derives its result columns from
the operator's own output over the whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coachload.session import scratch_path

from . import (decontaminate, exact, lines, lm, minhash, pieces, quality, secrets, substring, token_cache, tokens, trie,
               whiten)
from .base import remainder, table

# Places of the public vocabulary files.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_VOCABULARY = os.environ.get("BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
WORD_VOCABULARY = os.environ.get("WORD_VOCABULARY", "/opt/tokenizers/word_bpe_49k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECE_MODEL)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"), percent=85, width=3)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, b FROM reach JOIN link ON a = y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_path(spark, 'tokens')}-{uuid.uuid4().hex}"
    files = tokens.write_tokens(table(spark, sf_dir, "documents"), folder, WORD_VOCABULARY, end_id=2, by_word=True)
    return tokens.read_tokens(spark, folder, files)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (lines.remove_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_removed", "kept_sha256"))


# A pair of lines one edit apart shares the shorter one, or one place's rest.
OP8_SQL = r"""
WITH l AS (SELECT doc_id, no, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents)),
f AS (SELECT s, min(doc_id * 1000000 + no) AS first FROM l WHERE s <> '' GROUP BY 1),
d AS (SELECT s, first, i, left(s, CAST(i AS INTEGER) - 1) || substr(s, i + 1) AS v
      FROM (SELECT s, first, unnest(range(1, length(s) + 1)) AS i FROM f WHERE length(s) >= 20)),
near AS (SELECT s FROM (SELECT s, first, min(first) OVER (PARTITION BY md5(v), i) AS least FROM d) WHERE least < first
         UNION SELECT d.s FROM d JOIN f w ON d.v = w.s AND length(w.s) >= 20 WHERE w.first < d.first
         UNION SELECT w.s FROM d JOIN f w ON d.v = w.s AND length(w.s) >= 20 WHERE w.first > d.first),
j AS (SELECT l.doc_id, l.no, l.x, l.s <> '' AND (near.s IS NOT NULL OR f.first < l.doc_id * 1000000 + l.no) AS gone
      FROM l LEFT JOIN f USING (s) LEFT JOIN near USING (s))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= quality.KEEP_FROM).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return (decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated"))


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, w, least(len(w), 10) AS k FROM (
         SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
         FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dwin.k, i, item_id FROM dwin JOIN bwin USING (k, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(trie.turn_digests(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(trie.with_shared_heads(turns))


# CRC-32 of the decimal id in plain SQL: -1 stands for one of a byte's eight steps.
OP11_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295) % 9 AS h FROM c),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, octet_length(encode(coalesce(text, ''))) AS size,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, p, k, size FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND p <= h
      UNION ALL SELECT conv_id, p, k, size FROM h JOIN t USING (conv_id) WHERE p > h),
l AS (SELECT conv_id, list(k ORDER BY p) AS ks, list(size ORDER BY p) AS sizes FROM r GROUP BY 1),
m AS (SELECT conv_id, coalesce(ks, []) AS ks, coalesce(sizes, []) AS sizes FROM c LEFT JOIN l USING (conv_id)),
x AS (SELECT conv_id, d, md5(array_to_string(ks[1:d], '')) AS node, md5(array_to_string(ks[1:d - 1], '')) AS parent,
             CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(ks) AS last
      FROM (SELECT conv_id, ks, sizes, unnest(range(0, len(ks) + 1)) AS d FROM m)),
n AS (SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, node)),
below AS (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bnode FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.d >= a.d),
s AS (SELECT below.d, below.node, count(*) FILTER (e.n_children = 0) AS n_leaves, CAST(sum((e.n_convs - 1) * e.size) AS BIGINT) AS saved_tokens
      FROM below JOIN e ON e.d = bd AND e.node = bnode GROUP BY 1, 2)
SELECT e.conv_id, e.d AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM e JOIN s ON s.d = e.d AND s.node = e.node LEFT JOIN e p ON p.d = e.d - 1 AND p.node = e.parent AND e.d > 0
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{scratch_path(spark, 'token_cache')}-{uuid.uuid4().hex}"
    counted = token_cache.count_tokens(table(spark, sf_dir, "documents"), cache, BYTE_VOCABULARY)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash": op5_minhash,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op2_substring_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_minhash": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
}
