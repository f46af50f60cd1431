"""The queries of this package: op1_ to op12_, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, licenses, lines, packing, quality, simhash, substrings, topk, toxicity, trie, urls

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores are dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_read(spark, sf_dir, "documents"), mode="all", min_docs=10, min_chars=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_read(spark, sf_dir, "documents"), window=50)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), size=1024)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), radius=2, width=3)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), similarity=0.8)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(_read(spark, sf_dir, "conversations"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    made = (
        op1_line_dedup, op2_toxicity, op3_substring_dedup, op4_packing, op5_quality, op6_simhash, op7_licenses, op8_decontamination, op9_top_k, op10_urls,
        op11_prefix_trie, op12_language,
    )
    return {f.__name__: f for f in made}


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, arr[i] AS line, trim(translate(arr[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents) d, unnest(range(1, len(arr) + 1)) AS r(i)
), hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot ON lines.k = hot.k GROUP BY doc_id
"""

OP3_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM docs, unnest(range(1, len(w) - 48)) AS r(i)),
firsts AS (SELECT h, min(doc_id) AS first FROM spans GROUP BY h),
later AS (SELECT doc_id, i FROM spans JOIN firsts USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 50)) AS r(j)),
words AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) AS r(p))
SELECT d.doc_id, len(any_value(d.w)) AS n_words, count(gone.p) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM docs d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY d.doc_id
"""


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) q JOIN v ON q.vec_id <> v.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


# DuckDB's crc32 is not among its functions: the table's steps are spelt out over the digits of an id.
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS n FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM bits WHERE n < 8
), steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE n = 8),
ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1])), 4294967295) % 4 END AS h FROM ids, steps
), seq AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL
), mixed AS (
  SELECT crc.c, 0 AS mine, p, role, text FROM crc JOIN seq ON seq.c = crc.c - crc.c % 20 AND p <= h WHERE crc.c % 20 <> 0
  UNION ALL SELECT crc.c, 1, p, role, text FROM crc JOIN seq USING (c) WHERE p > h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY mine, p) AS d, md5(role || chr(1) || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM mixed
), paths AS (
  SELECT c, d, words, md5(string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM turns UNION ALL SELECT c, 0, 0, '' FROM ids
), lens AS (SELECT c, max(d) AS l FROM paths GROUP BY c),
owned AS (SELECT p.*, l, min(p.c) OVER (PARTITION BY d, k) AS o FROM paths p JOIN lens USING (c)),
nodes AS (
  SELECT o, d, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, max(l) = d AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = l), '')) AS ends FROM owned GROUP BY o, d
), up AS (SELECT n.o, n.d, p.o AS parent FROM nodes n LEFT JOIN owned p ON p.c = n.o AND p.d = n.d - 1),
below AS (
  SELECT a.o, a.d, sum(n.saved) AS saved_tokens, sum(CAST(n.leaf AS INTEGER)) AS n_leaves FROM nodes n JOIN owned a ON a.c = n.o AND a.d <= n.d GROUP BY a.o, a.d
), kids AS (SELECT parent AS o, d - 1 AS d, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY parent, d)
SELECT n.o AS conv_id, CAST(n.d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM nodes n JOIN up USING (o, d) JOIN below USING (o, d) LEFT JOIN kids USING (o, d)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11_SQL, "op1_line_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op9_top_k": OP9_SQL}
