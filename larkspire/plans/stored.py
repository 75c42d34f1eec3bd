"""Registered queries over stored structures: tables merged on read, the inverted index, the embedding cache, whole ingestions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.functions import vector as V
from larkspire.operators import code, quality, retire, retrieval, snapshot, store
from larkspire.operators.corpus import Corpus, EmbeddingCache
from larkspire.operators.lexindex import LexicalIndex
from larkspire.operators.merge import MergeTable
from larkspire.plans.catalogue import DENSE, DTOK, QTOK, TOP, _asked, _points, _ranked, _vectors, now_col, query
from larkspire.plans.entities import table
from larkspire.plans.more import SOURCE, WINDOW, _candidate, _previous
from larkspire.session import shared_folder
from larkspire.sources import feed


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Tables merged on read: three batches over customer, the second of deletions.

BATCHES = """one AS (SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 4 = 0),
two AS (SELECT o.c_custkey, o.c_name, CASE WHEN o.c_custkey % 3 = 0 THEN round(o.c_acctbal + 1, 2) ELSE o.c_acctbal END AS c_acctbal FROM one o WHERE o.c_custkey % 7 <> 0),
three AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE c_name END AS c_name, c_acctbal FROM (SELECT * FROM two UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 35 = 0))"""


def _merged(spark: SparkSession, sf_dir: str) -> MergeTable:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    t = MergeTable.create(spark, _root(spark, "merged"), c, ["c_custkey"])
    more = c.where("c_custkey % 4 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    grown = c.unionByName(more).where("c_custkey % 3 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))
    t.upsert(more.unionByName(grown).withColumn("at", F.col("c_acctbal")), "at")  # of a key in both the greater balance is the later
    t.delete(c.unionByName(more).where("c_custkey % 7 = 0"))
    back = c.where("c_custkey % 35 = 0")
    t.upsert(c.unionByName(more).where("c_custkey % 5 = 0 AND c_custkey % 7 <> 0").withColumns({"c_name": F.lower("c_name"), "c_acctbal": F.when(F.col("c_custkey") % 3 == 0, F.round(F.col("c_acctbal") + 1, 2)).otherwise(F.col("c_acctbal"))}).unionByName(back.withColumn("c_name", F.lower("c_name"))))
    return t


@query(f"WITH {BATCHES} SELECT * FROM three")
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches behind a base, merged by the reader."""
    return _merged(spark, sf_dir).read()


@query(f"WITH {BATCHES} SELECT * FROM three")
def store_merge_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _merged(spark, sf_dir)
    t.compact()
    t.vacuum()
    return t.read()


@query(f"WITH {BATCHES} SELECT * FROM one WHERE c_custkey NOT IN (SELECT c_custkey FROM three) AND c_custkey <= 1000000 UNION ALL SELECT * FROM three WHERE false")
def store_merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first version had and the last one lacks: an older version is read as it was."""
    t = _merged(spark, sf_dir)
    return t.read(1).join(t.read().select("c_custkey"), "c_custkey", "left_anti").select("c_custkey", "c_name", "c_acctbal")


# The inverted index after an update: two documents in three first, then the others and changed ones written, stale ones gone.

CHANGED = "changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN lang || ' of ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"
CTOK = DTOK.replace("FROM documents", "FROM changed")
LEXICAL = f"WITH {CHANGED}, {QTOK}, {CTOK}, s AS (SELECT query_id, chunk_id, sum(times * tf) / sqrt(any_value(n)) AS score FROM q JOIN d USING (t) GROUP BY ALL), r AS (SELECT *, {TOP} FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"
SPARSE = f"WITH {CHANGED}, {QTOK}, {CTOK}, n AS (SELECT count(*) AS n FROM changed), i AS (SELECT t, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM d, n GROUP BY t), s AS (SELECT query_id, chunk_id, round(sum(times * tf * idf), 6) AS score FROM q JOIN i USING (t) JOIN d USING (t) GROUP BY ALL), r AS (SELECT *, {TOP} FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"


def _updated(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """Sparse and dense vectors of what is written go in with one commit."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    points = _points(spark, sf_dir).select("chunk_id", "vector")
    index = LexicalIndex(spark, _root(spark, "lexical"))
    index.build(d.where("chunk_id % 3 <> 0"), points=points)
    written = d.where("(chunk_id % 3 = 0 OR chunk_id % 10 = 1) AND chunk_id % 7 <> 0").withColumn("text", F.when(F.col("chunk_id") % 10 == 1, F.concat("lang", F.lit(" of "), "text")).otherwise(F.col("text")))
    index.update(written, d.where("chunk_id % 7 = 0"), points)
    return index


@query(LEXICAL)
def index_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_updated(spark, sf_dir).search(_asked(spark, sf_dir), 10))


@query(LEXICAL)
def index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _updated(spark, sf_dir)
    index.merge()
    return _ranked(index.search(_asked(spark, sf_dir), 10))


@query(SPARSE)
def hybrid_upsert_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_updated(spark, sf_dir).search(_asked(spark, sf_dir), 10, idf=True))


@query(f"WITH {DENSE}, r AS (SELECT *, {TOP} FROM s WHERE chunk_id IN (SELECT doc_id FROM documents) AND chunk_id % 7 <> 0) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def hybrid_upsert_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.dense(_vectors(spark, sf_dir), _updated(spark, sf_dir).points(), 10))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 7 <> 0")
def index_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).ids()


# The embedding cache: two runs of different texts, then what the second hasn't used goes.


@query("SELECT DISTINCT sha256(text) AS key, 16::INTEGER AS dimension FROM documents WHERE doc_id % 3 = 1")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache, embed = EmbeddingCache(spark, _root(spark, "vectors")), V.hash_embedding(16)
    cache.vectors(d.where("doc_id % 3 = 0"), embed, "hash-16", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    cache.vectors(d.where("doc_id % 3 = 1"), embed, "hash-16", now_col())
    cache.evict(F.expr("timestamp_ntz'2024-01-02 00:00:00'"))
    return cache.table().read().select("key", F.size("vector").alias("dimension"))


# A corpus through two ingestions: chunks of the second generation, whether they were taken over, and whether the index has them.


@query(f"WITH {WINDOW} SELECT doc_id, chunk_index, doc_id % 5 <> 0 AS reused, 'g2' AS generation_id, CASE WHEN doc_id % 5 <> 0 THEN '1.1' ELSE '1.0' END AS document_version, sha256(doc_id || chr(0) || chunk_index || chr(0) || sha256(text)) AS chunk_id, true AS indexed FROM u WHERE doc_id % 13 <> 0")
def corpus_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(spark, _root(spark, "corpus"))
    none, docs = (x.limit(0) for x in _previous(spark, sf_dir))
    c = _candidate(spark, sf_dir)
    corpus.run(c.where("doc_id % 5 <> 0"), SOURCE, "g1", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), none, docs)
    corpus.run(c.where("doc_id % 13 <> 0"), SOURCE, "g2", now_col(), none, docs)
    has = corpus.index.ids().withColumn("indexed", F.lit(True))
    rows = corpus.generations.read().select("doc_id", "chunk_index", "reused", "generation_id", "document_version", "chunk_id")
    return rows.join(has, "chunk_id", "full_outer").select("doc_id", "chunk_index", "reused", "generation_id", "document_version", "chunk_id", "indexed")


# A change feed of documents: a split for each source, read by a stream twice, the second time from its checkpoint.


@query("SELECT doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 5 = 0 THEN '2' ELSE '1' END AS remote_version, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END) AS checksum, source AS split FROM documents WHERE doc_id % 9 <> 0")
def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _root(spark, "feed")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("split"), F.col("doc_id").cast("string").alias("external_id"), "text")

    def change(rows: DataFrame, kind: str, version: str | None, text) -> DataFrame:
        return rows.select("doc_id", "split", F.lit(kind).alias("kind"), "external_id", F.lit(version).cast("string").alias("remote_version"), (F.to_json(F.struct(text.alias("text"))) if version else F.lit(None).cast("string")).alias("record"))

    first = change(d, "upsert", "1", F.col("text"))
    second = change(d.where("doc_id % 5 = 0"), "upsert", "2", F.concat("text", F.lit(" changed"))).unionByName(change(d.where("doc_id % 9 = 0"), "delete", None, None))
    for i, rows in enumerate((first, second)):
        feed.exported(rows, root, i, ["doc_id", F.desc("kind")])  # a delete after what it deletes
        q = feed.stream(spark, "larkspire.sources.feed:FolderConnector", {"root": root}).writeStream.format("parquet").option("path", f"{root}/received").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    received = spark.read.parquet(f"{root}/received")
    none = received.limit(0).select("external_id", "remote_version", "record", "split")
    got = snapshot.apply_changes(none, received, "external_id", "position")
    return got.select("external_id", "remote_version", F.sha2(F.get_json_object("record", "$.text"), 256).alias("checksum"), F.regexp_replace("split", "^split=", "").alias("split"))


# Quick imports, retirement of uploads, subset checks.


@query("WITH r AS (SELECT sha256('t' || chr(0) || 'web' || chr(0) || 'http://a.org/' || (user_id % 20))[1:32] AS source_id, event_id % 50 AS k, event_id FROM events) SELECT sha256('quick-ingest' || chr(0) || source_id || chr(0) || k)[1:32] AS job_id, source_id, CASE WHEN k = 7 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN k = 7 THEN 0 ELSE min(event_id) END AS created_at FROM r GROUP BY source_id, k")
def store_import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of quick imports; those of one key are there already and stay as they are."""
    req = table(spark, sf_dir, "events").selectExpr("'t' AS tenant_id", "'web' AS source_type", "concat(IF(event_id % 2 = 0, 'HTTP://A.org/', 'http://a.org/'), user_id % 20, IF(event_id % 3 = 0, '/', '')) AS location", "event_id AS at", "event_id % 50 AS idempotency_key")
    none = spark.createDataFrame([], "job_id string, source_id string, status string, created_at long")
    old = store.import_jobs(none, req.where("idempotency_key = 7")).withColumns({"status": F.lit("completed"), "created_at": F.lit(0).cast("long")})
    return store.import_jobs(store.import_jobs(old, req), req)


RETIRED = """i AS (SELECT p_partkey::VARCHAR AS object_id, 't' || (p_size % 2) AS tenant_id, CASE p_size % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'orphaned' ELSE 'active' END AS state, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS retired_at, TIMESTAMP '2024-01-20' + to_hours((p_partkey % 400)::INT) AS created_at FROM part),
u AS (SELECT l_partkey::VARCHAR AS object_id, 't' || (l_suppkey % 2) AS tenant_id, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 4 <> 0 GROUP BY ALL),
m AS (SELECT object_id, tenant_id, created_at, coalesce(n, 0) AS ref_count, CASE WHEN i.state IS NULL THEN 'dangling' WHEN i.state = 'deleted' THEN 'deleted' WHEN n > 0 THEN 'active' WHEN i.state = 'orphaned' THEN 'orphaned' ELSE 'retired' END AS state, CASE WHEN i.state = 'deleted' THEN retired_at WHEN i.state IS NULL OR n > 0 THEN NULL WHEN i.state = 'orphaned' THEN retired_at ELSE coalesce(retired_at, TIMESTAMP '2024-01-30') END AS retired_at FROM i FULL JOIN u USING (object_id, tenant_id))"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS string) AS object_id", "concat('t', p_size % 2) AS tenant_id", "CASE p_size % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'orphaned' ELSE 'active' END AS state", "CASE WHEN p_partkey % 3 = 0 THEN timestamp_ntz'2024-01-01 00:00:00' END AS retired_at", "timestamp_ntz'2024-01-20 00:00:00' + make_dt_interval(0, CAST(p_partkey % 400 AS INT)) AS created_at")
    uses = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_partkey % 4 <> 0").selectExpr("CAST(l_partkey AS string) AS object_id", "concat('t', l_suppkey % 2) AS tenant_id")
    return retire.marked(inventory, uses, now_col())


@query(f"WITH {RETIRED} SELECT object_id, tenant_id, ref_count, state, retired_at FROM m")
def uploads_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir).select("object_id", "tenant_id", "ref_count", "state", "retired_at")


@query(f"WITH {RETIRED} SELECT object_id FROM m WHERE state IN ('orphaned', 'retired') AND ref_count = 0 AND coalesce(retired_at, created_at) <= TIMESTAMP '2024-01-29'")
def uploads_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retire.due(_uploads(spark, sf_dir), now_col()).select("object_id")


@query("WITH r AS (SELECT lang, list(DISTINCT source) AS a, list(DISTINCT source) FILTER (WHERE quality = 0) AS b FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang), x AS (SELECT lang, list_sort(list_filter(a, lambda s: NOT list_contains(coalesce(b, []), s))) AS m FROM r) SELECT lang, len(m) = 0 AS passed, array_to_string(m, ',') AS missing FROM x")
def eval_subset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language, whether every source has a document of low quality, and which haven't."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    per = d.groupBy("lang").agg(F.collect_set("source").alias("a"), F.collect_set(F.when(F.col("quality") == 0, F.col("source"))).alias("b"))
    return per.select("lang", quality.subset(F.col("a"), F.col("b")).alias("c")).select("lang", "c.passed", F.array_join("c.missing", ",").alias("missing"))


@query(f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM d) SELECT doc_id, i::INTEGER AS line, greatest(i - {code.CONTEXT}, 1)::INTEGER AS line_start, least(i + {code.CONTEXT}, len(l))::INTEGER AS line_end, array_to_string(list_slice(l, greatest(i - {code.CONTEXT}, 1), least(i + {code.CONTEXT}, len(l))), chr(10)) AS snippet FROM x WHERE contains(lower(t), 'tion')")
def code_search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word, with the lines around it."""
    return code.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "Tion", "doc_id").select("doc_id", "line", "line_start", "line_end", "snippet")
