"""The engine's entities over the driver's tables, in Spark and as SQL with the same columns.

Attributes that the tables lack (tenant, tags, access, nullable times, job fields) are derived from their keys by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks with tenant, tags, path, url, access and times."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id AS chunk_id", "0 AS chunk_index", "text", "lang", "source AS source_id", "concat('t', length(source) % 2) AS tenant_id",
        "CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'pdf' ELSE 'repo' END AS source_type",
        "CASE doc_id % 3 WHEN 0 THEN array('news', lang) WHEN 1 THEN array(lang) END AS tags",
        "CASE WHEN doc_id % 5 <> 0 THEN concat('docs/', lang, '/', doc_id, '.md') END AS path",
        "CASE WHEN doc_id % 5 = 0 THEN concat('https://example.com/', lang, '/', doc_id) END AS url",
        "CASE doc_id % 4 WHEN 0 THEN 'acl-a' WHEN 1 THEN 'acl-b' WHEN 2 THEN 'public' END AS acl_hash",
        "CASE WHEN doc_id % 7 = 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 700 AS INT)) END AS ingested_at",
        "CASE WHEN doc_id % 9 = 0 THEN timestamp_ntz'2024-01-12 00:00:00' + make_dt_interval(0, CAST(doc_id % 300 AS INT)) END AS doc_updated_at",
        "CASE WHEN doc_id % 11 <> 0 THEN timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(0, CAST(doc_id % 500 AS INT)) END AS created_at",
    )


CHUNKS = """chunks AS (SELECT doc_id, doc_id AS chunk_id, text, lang, source AS source_id, 't' || (length(source) % 2) AS tenant_id,
  CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'pdf' ELSE 'repo' END AS source_type,
  CASE doc_id % 3 WHEN 0 THEN ['news', lang] WHEN 1 THEN [lang] END AS tags,
  CASE WHEN doc_id % 5 <> 0 THEN 'docs/' || lang || '/' || doc_id || '.md' END AS path,
  CASE WHEN doc_id % 5 = 0 THEN 'https://example.com/' || lang || '/' || doc_id END AS url,
  CASE doc_id % 4 WHEN 0 THEN 'acl-a' WHEN 1 THEN 'acl-b' WHEN 2 THEN 'public' END AS acl_hash,
  CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id % 700)::INT) END AS ingested_at,
  CASE WHEN doc_id % 9 = 0 THEN TIMESTAMP '2024-01-12 00:00:00' + to_hours((doc_id % 300)::INT) END AS doc_updated_at,
  CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-10 00:00:00' + to_hours((doc_id % 500)::INT) END AS created_at
  FROM documents)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ingestion jobs."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS job_id", "concat('s', user_id) AS source_id", "ts AS created_at", "value", "props AS stats",
        "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'dead_lettered' END AS status",
        "CAST(event_id % 5 AS INT) AS attempts",
        "CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS available_at",
        "CASE WHEN event_type IN ('purchase', 'error', 'view') THEN ts + INTERVAL 2 HOURS END AS completed_at",
        "CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN ts + INTERVAL 6 HOURS END AS lease_expires_at",
        "CAST(floor(value) AS BIGINT) AS doc_count", "CAST(floor(value * 10) AS BIGINT) AS chunk_count",
    )


JOBS = """jobs AS (SELECT event_id AS job_id, 's' || user_id AS source_id, ts AS created_at, value, props AS stats,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'dead_lettered' END AS status,
  (event_id % 5)::INT AS attempts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS available_at,
  CASE WHEN event_type IN ('purchase', 'error', 'view') THEN ts + INTERVAL 2 HOUR END AS completed_at,
  CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN ts + INTERVAL 6 HOUR END AS lease_expires_at,
  floor(value)::BIGINT AS doc_count, floor(value * 10)::BIGINT AS chunk_count FROM events)"""
