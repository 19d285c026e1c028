"""The queries of this subpackage, for the registry, and their SQL where SQL can say them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.llm import bpe, exact_dedup, katz, language_id, mixing, ngram_join, order_minhash, quality, url_filter, warc
from sonogrid.llm._learn import remainder

#: rank file of the byte-level vocabulary, on the driver
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path() -> str:
    import public_tokenizers

    return os.environ.get("SONOGRID_VOCABULARY") or public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), remainder("doc_id", 3) == 1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.normalise_archives(records, least=0))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", *mixing.RESULTS)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 4) == 2
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs, usable=remainder("doc_id", 4) != 2, carry=[("held_out", held)])


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict:
    found = [op1_ngram_join, op2_quality, op3_warc, op4_order_minhash, op5_mixing, op6_language_id, op7_katz, op8_url_filter, op9_exact_dedup, op10_bpe]
    return {f.__name__: f for f in found}


_OP9 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)"""


# links by joining the shingles of classes; a component's least id reaches all its members over greater ids
_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
d AS (SELECT doc_id, len(s)::BIGINT AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM s),
t AS (SELECT doc_id AS id, n, unnest(s) AS t FROM d WHERE doc_id = class_id AND n > 0),
l AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.t = b.t AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND r.root < e.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, class_id, coalesce(root, class_id) AS component_id FROM d LEFT JOIN m ON m.id = class_id"""

# base32: each five hexadecimal digits of the SHA-1 are four signs of five bits
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages),
h AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(sha1(html), 5 * g + 1, 5))::BIGINT) AS v FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1, "op3_warc": _OP3, "op8_url_filter": url_filter.oracle(), "op9_exact_dedup": _OP9}
