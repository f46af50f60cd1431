"""The jobs as queries: each runs twice into a new folder of the shared one, and what stands there then is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import job1_knowledge, job2_archive
from lexspark import store
from lexspark.plans import oracles

Query = Callable[[SparkSession, str], DataFrame]

#: Limits that some of the given documents exceed.
MOST_BYTES, MOST_CONTENT = 30_000, 12_000


def _long(output: str, df: DataFrame, **columns) -> DataFrame:
    """Rows of one output, in the columns that all have."""
    kinds = {"id": "long", "no": "long", "part": "string", "name": "string", "sha256": "string", "n": "long", "score": "double"}
    return df.select(F.lit(output).alias("output"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def _sha(x: str):
    return F.sha2(F.col(x).cast("binary"), 256)


def job1_knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{store.root(spark)}/job1-{uuid.uuid4().hex}"
    s = job1_knowledge.Settings(f"{sf_dir}/documents.parquet", f"{sf_dir}/events.parquet", out, most_bytes=MOST_BYTES, most_content=MOST_CONTENT)
    for _ in range(2):
        tables = job1_knowledge.run(spark, s)
    c = F.col
    parts = [
        _long("chunks", tables["chunks"], id=c("source_id"), no=c("chunk_no"), part=c("kind"), name=c("title"), sha256=_sha("content"), n=F.octet_length("content")),
        _long("sources", tables["sources"], id=c("source_id"), part=c("tier"), name=c("kind"), sha256=c("content_hash"), n=c("chunk_count"), score=F.round("retention_score", 6)),
        _long("evicted", tables["evicted"], id=c("source_id"), part=c("eviction_reason"), name=c("kind"), sha256=c("content_hash"), n=c("content_bytes")),
        _long("rejected", tables["rejected"], id=c("source_id"), no=c("rows"), part=c("reason"), sha256=c("content_hash"), n=c("bytes")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def job2_session_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{store.root(spark)}/job2-{uuid.uuid4().hex}"
    s = job2_archive.Settings(f"{sf_dir}/conversations.parquet*", f"{at}/archive", f"{at}/checkpoint")
    for _ in range(2):
        job2_archive.run(spark, s)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{s.out}/{name}")
    c = F.col
    messages = job2_archive.current(read("messages", job2_archive.MESSAGES))
    parts = [
        _long("messages", messages, id=c("conv_id"), no=c("turn"), part=c("role"), sha256=_sha("text"), n=F.octet_length("text")),
        _long("cards", read("cards", job2_archive.CARDS), id=c("conv_id"), no=c("n_messages"), part=c("indexable"), name=c("title"), sha256=F.concat_ws("/", "n_user", "n_assistant", "first_turn", "last_turn"), n=c("bytes")),
        _long("rejected", read("rejected", job2_archive.REJECTED), id=c("conv_id"), no=c("turn"), part=c("reason"), name=c("role")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (job1_knowledge_base, job2_session_archive)}


def _job1_sql() -> str:
    s = job1_knowledge.Settings("", "", "")
    kinds = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(origin, ''), '{p}') THEN '{k}'" for p, k in s.kinds) + " ELSE 'ephemeral' END"
    clean = oracles._redacted("coalesce(text, '')")
    red = f"""given AS (SELECT doc_id AS source_id, source AS origin, strlen(coalesce(text, '')) AS bytes, {clean} AS text FROM documents),
marked AS MATERIALIZED (SELECT *, sha256(text) AS content_hash, CASE WHEN source_id IS NULL THEN 'no id' WHEN bytes > {MOST_BYTES} THEN 'too large' END AS reason FROM given),
chosen AS (SELECT source_id, min(content_hash) AS content_hash FROM (SELECT content_hash, min(source_id) AS source_id FROM marked WHERE reason IS NULL GROUP BY content_hash) GROUP BY source_id),
facts AS (SELECT m.source_id, m.content_hash, max(bytes) AS bytes, count(*) AS rows_, bool_or(c.source_id IS NOT NULL) AS chosen FROM marked m LEFT JOIN chosen c ON c.source_id = m.source_id AND c.content_hash = m.content_hash WHERE reason IS NULL GROUP BY ALL),
rejected AS (SELECT source_id, content_hash, bytes, 'repeated' AS reason, rows_ - CAST(chosen AS BIGINT) AS rows_ FROM facts WHERE NOT chosen OR rows_ > 1
  UNION ALL SELECT source_id, content_hash, bytes, reason, count(*) FROM marked WHERE reason IS NOT NULL GROUP BY ALL),
red AS MATERIALIZED (SELECT m.source_id, m.content_hash, min(origin) AS origin, min(text) AS text FROM marked m JOIN chosen c ON c.source_id = m.source_id AND c.content_hash = m.content_hash WHERE reason IS NULL GROUP BY ALL)"""
    return rf"""WITH {oracles.CHUNKS.replace(oracles.RED, red)},
seen AS (SELECT user_id AS source_id, min(ts) AS first_at, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS access_count, max(ts) FILTER (WHERE event_type IN ('view', 'click')) AS last_at FROM events GROUP BY user_id),
pieces AS (SELECT source_id, count(*) AS chunk_count, count(*) FILTER (WHERE regexp_matches(content, '(?s)```[0-9A-Za-z_]*\n.*?```')) AS code, sum(length(content)) AS chars FROM chunks GROUP BY source_id),
src AS (SELECT red.source_id, {kinds} AS kind, content_hash, coalesce(chunk_count, 0) AS chunk_count, coalesce(code, 0) AS code, coalesce(chars, 0) AS chars, coalesce(access_count, 0) AS n, coalesce(first_at, TIMESTAMP '{s.since}') AS indexed_at, last_at
  FROM red LEFT JOIN seen USING (source_id) LEFT JOIN pieces USING (source_id)),
aged AS (SELECT *, greatest(0, epoch(TIMESTAMP '{s.as_of}') - epoch(indexed_at)) / 86400.0 AS age, greatest(0, epoch(TIMESTAMP '{s.as_of}') - epoch(last_at)) / 86400.0 AS idle FROM src),
scored AS (SELECT *, CASE WHEN kind <> 'durable' THEN 0 ELSE (CASE WHEN code > 0 AND code = chunk_count THEN 0.7 WHEN code > 0 THEN 0.6 ELSE 0.5 END + least(0.2, n * 0.02)) * exp(-0.045 * age) + CASE WHEN n > 0 AND last_at IS NOT NULL THEN 0.3 / (1.0 + idle) ELSE 0 END END AS score FROM aged),
tiered AS (SELECT *, CASE WHEN kind <> 'durable' THEN CASE WHEN age > CASE kind WHEN 'ephemeral' THEN 1 ELSE 60 END THEN 'stale' ELSE 'fresh' END WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.15 THEN 'cold' ELSE 'evictable' END AS tier FROM scored),
judged AS (SELECT *, CASE WHEN chars > {MOST_CONTENT} THEN 'oversized' WHEN kind = 'durable' AND score < 0.15 AND n = 0 THEN 'retention' WHEN tier = 'stale' THEN 'ttl_' || kind END AS gone FROM tiered)
SELECT 'chunks' AS output, c.source_id AS id, CAST(chunk_no AS BIGINT) AS no, kind AS part, title AS name, sha256(content) AS sha256, strlen(content) AS n, CAST(NULL AS DOUBLE) AS score FROM chunks c JOIN judged j ON j.source_id = c.source_id AND gone IS NULL
UNION ALL SELECT 'sources', source_id, NULL, tier, kind, content_hash, chunk_count, round(score, 6) FROM judged WHERE gone IS NULL
UNION ALL SELECT 'evicted', source_id, NULL, gone, kind, content_hash, chars, NULL FROM judged WHERE gone IS NOT NULL
UNION ALL SELECT 'rejected', source_id, rows_, reason, NULL, content_hash, bytes, NULL FROM rejected"""


def _job2_sql() -> str:
    return rf"""WITH given AS (SELECT CAST(conv_id AS BIGINT) AS c, CAST(turn AS BIGINT) AS t, role, {oracles._redacted(oracles.trim("coalesce(text, '')"))} AS text,
  CASE WHEN conv_id IS NULL THEN 'no session' WHEN turn IS NULL THEN 'no turn' WHEN coalesce(role, '') NOT IN ('user', 'assistant', 'system') THEN 'unknown role' END AS reason FROM conversations),
kept AS (SELECT * FROM given WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY role DESC, text DESC) = 1),
cards AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a, sum(strlen(text)) AS bytes, min(t) AS lo, max(t) AS hi,
  regexp_replace(arg_min(text, t) FILTER (WHERE role = 'user' AND text <> ''), '[\r\n]+', ' ', 'g') AS title,
  count(*) FILTER (WHERE role = 'assistant' AND text <> '') >= 2 AND coalesce(sum(strlen(text)) FILTER (WHERE role = 'assistant'), 0) >= 200 AS ok FROM kept GROUP BY c)
SELECT 'messages' AS output, c AS id, t AS no, role AS part, CAST(NULL AS VARCHAR) AS name, sha256(text) AS sha256, strlen(text) AS n, CAST(NULL AS DOUBLE) AS score FROM kept
UNION ALL SELECT 'cards', c, n, CAST(ok AS VARCHAR), CASE WHEN title IS NULL THEN '' WHEN length(title) <= 120 THEN title ELSE left(title, 120) || '…' END, u || '/' || a || '/' || lo || '/' || hi, CAST(bytes AS BIGINT), NULL FROM cards
UNION ALL SELECT 'rejected', c, t, reason, role, NULL, NULL, NULL FROM given WHERE reason IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {"job1_knowledge_base": _job1_sql(), "job2_session_archive": _job2_sql()}
