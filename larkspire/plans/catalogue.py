"""The registered queries: name, Spark form, SQL form. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.functions import text as T
from larkspire.functions.vector import dot
from larkspire.operators import catalog, chat, chunking, lexindex, quality, relevance, retrieval, snapshot
from larkspire.operators.filters import Filter, search
from larkspire.plans.entities import CHUNKS, JOBS, NOW, chunks, jobs, table
from larkspire.session import kept, shared_folder
from larkspire.sources import html
from larkspire.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now_col():
    return F.expr(f"timestamp_ntz'{NOW}'")


#: Tokens of a text as the lexical operators see them (there is no CJK in the driver's tables).
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_\\-]+'), lambda t: lower(t))"
KEPT = f"list_filter({TOKENS}, lambda t: t NOT IN ({STOP}))"


def terms_sql(c: str) -> str:
    kept, tokens = KEPT.format(c), TOKENS.format(c)
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens} END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Filters


def _filtered(name: str, f: Filter, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f.apply(chunks(spark, sf_dir)).select("doc_id", "tenant_id", "source_type", "acl_hash")

    run.__name__ = name
    query(f"WITH {CHUNKS} SELECT doc_id, tenant_id, source_type, acl_hash FROM chunks WHERE {where}")(run)


_filtered("filter_tenant", Filter(tenant_id="t1"), "tenant_id = 't1'")
_filtered("filter_source_types", Filter(source_types=("pdf", "repo")), "source_type IN ('pdf', 'repo')")
_filtered("filter_doc_ids", Filter(doc_ids=(3, 5, 8, 13)), "doc_id IN (3, 5, 8, 13)")
_filtered("filter_tags", Filter(tags=("news", "de")), "list_has_any(coalesce(tags, []), ['news', 'de'])")
_filtered("filter_path_prefix", Filter(path_prefix="docs/fr/"), "starts_with(coalesce(path, ''), 'docs/fr/')")
_filtered("filter_url_prefix", Filter(url_prefix="https://example.com/en"), "starts_with(coalesce(url, ''), 'https://example.com/en')")
_filtered("filter_time_range", Filter(start="2024-01-05 00:00:00", end="2024-01-20 00:00:00"), "coalesce(ingested_at, doc_updated_at, created_at) IS NULL OR coalesce(ingested_at, doc_updated_at, created_at) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
_filtered("filter_acl", Filter(security_scope=("public", "acl-a")), "coalesce(acl_hash, 'public') IN ('public', 'acl-a')")
_filtered(
    "filter_all",
    Filter(tenant_id="t0", source_types=("web", "pdf"), tags=("news",), start="2024-01-02 00:00:00", security_scope=("public",)),
    "tenant_id = 't0' AND source_type IN ('web', 'pdf') AND list_has_any(coalesce(tags, []), ['news']) AND (coalesce(ingested_at, doc_updated_at, created_at) IS NULL OR coalesce(ingested_at, doc_updated_at, created_at) >= TIMESTAMP '2024-01-02') AND coalesce(acl_hash, 'public') = 'public'",
)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || chr(10) || c_mktsegment), 'auto')")
def filter_catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "customer"), "AUTO", "c_name", "c_mktsegment").select("c_custkey", "c_name")


@query("SELECT user_id, count(*) AS n FROM events WHERE ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.25 GROUP BY user_id")
def filter_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(T.sampled(F.col("event_id"), 0.25)).groupBy("user_id").agg(F.count("*").alias("n"))


# Scalar functions


@query(f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS lexemes FROM documents")
def text_lexicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.lexicalize(F.col("text")), " ").alias("lexemes"))


@query(f"SELECT doc_id, len({terms_sql('text')}) AS n_terms FROM documents")
def text_stop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.search_terms(F.col("text"))).cast("long").alias("n_terms"))


@query("SELECT doc_id, sha256(text) AS checksum, md5(text) AS md5 FROM documents")
def text_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.md5("text").alias("md5"))


@query("SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END::INTEGER AS tokens FROM conversations")
def text_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, regexp_extract(p_brand, '^(.*?)([0-9]+)([^0-9]*)$', 1) || (regexp_extract(p_brand, '([0-9]+)[^0-9]*$', 1)::BIGINT + 1)::VARCHAR AS next FROM part")
def text_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.next_version(F.col("p_brand")).alias("next"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[\\s_\\-]', '', 'g') AS ident FROM customer")
def text_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.canonical_identifier(F.col("c_name")).alias("ident"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(regexp_replace(text, '\\s+$', ''), '[.!?;:]$')) AS n_boundary FROM documents GROUP BY lang")
def text_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(T.ends_at_boundary(F.col("text")), 1)).alias("n_boundary"))


@query("SELECT event_type, sum((props->>'$.k')::BIGINT) AS sum_k, max((props->>'$.k')::BIGINT) AS max_k FROM events GROUP BY event_type")
def text_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || coalesce(nullif(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), ''), '/') || regexp_extract(url, '^[^?#]*([?][^#]+)', 1) AS location FROM pages")
def text_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspire.sources.files import canonical

    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), canonical(F.col("url")).alias("location"))


# Lexical, dense and sparse retrieval. The queries are the benchmark's passages, the vectors those divisible by 20.

QTOK = f"q AS (SELECT item_id AS query_id, t, count(*) AS times FROM (SELECT item_id, unnest({terms_sql('text')}) AS t FROM benchmark) GROUP BY ALL)"
DTOK = f"d AS (SELECT doc_id AS chunk_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(x) AS t, len(x) AS n FROM (SELECT doc_id, {terms_sql('text')} AS x FROM documents)) GROUP BY doc_id, t)"
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, sf_dir: str) -> lexindex.LexicalIndex:
    """The stored index of documents, built by the first query that asks for it."""
    return lexindex.stored_index(chunks(spark, sf_dir).select("chunk_id", "text"), shared_folder(spark))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {QTOK}, {DTOK}, s AS (SELECT query_id, chunk_id, sum(times * tf) / sqrt(any_value(n)) AS score FROM q JOIN d USING (t) GROUP BY ALL), r AS (SELECT *, {TOP} FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_index(spark, sf_dir).search(_asked(spark, sf_dir), 10))


@query(f"WITH {QTOK}, {DTOK}, need AS (SELECT query_id, count(*) AS k FROM q GROUP BY ALL), s AS (SELECT query_id, chunk_id, sum(times * tf) / sqrt(any_value(n)) AS score, count(*) AS got FROM q JOIN d USING (t) GROUP BY ALL), r AS (SELECT s.query_id, chunk_id, score, {TOP.replace('query_id', 's.query_id')} FROM s JOIN need ON s.query_id = need.query_id AND got = k) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def lexical_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_index(spark, sf_dir).search(_asked(spark, sf_dir), 10, every=True))


@query(f"WITH {QTOK}, {DTOK}, n AS (SELECT count(*) AS n FROM documents), i AS (SELECT t, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM d, n GROUP BY t), s AS (SELECT query_id, chunk_id, round(sum(times * tf * idf), 6) AS score FROM q JOIN i USING (t) JOIN d USING (t) GROUP BY ALL), r AS (SELECT *, {TOP} FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_index(spark, sf_dir).search(_asked(spark, sf_dir), 10, idf=True))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector", F.col("label").alias("query_label"))


DENSE = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS query_label, b.label AS label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)"


@query(f"WITH {DENSE}, r AS (SELECT *, {TOP} FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.dense(_vectors(spark, sf_dir), _points(spark, sf_dir), 10))


@query(f"WITH {DENSE}, r AS (SELECT *, {TOP} FROM s WHERE label IN (1, 2, 3)) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.dense(_vectors(spark, sf_dir), _points(spark, sf_dir), 5, F.col("label").isin(1, 2, 3)))


@query("SELECT label, i AS dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1)::INTEGER - 1 AS i FROM embeddings) GROUP BY ALL")
def dense_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def dense_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(e, e)), 5).alias("norm"))


# Fusion. The queries have a text and a vector of the same number.

HYBRID = f"""WITH {QTOK}, {DTOK},
v AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id CROSS JOIN embeddings b),
dr AS (SELECT * FROM (SELECT query_id, chunk_id, {TOP} FROM v) WHERE rank <= 40),
l AS (SELECT query_id, chunk_id, sum(times * tf) / sqrt(any_value(n)) AS score FROM q JOIN d USING (t) GROUP BY ALL),
lr AS (SELECT * FROM (SELECT query_id, chunk_id, {TOP} FROM l) WHERE rank <= 40)"""
FUSED = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id)::INTEGER AS rank"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).join(_points(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "vector"), "query_id")


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = _both(spark, sf_dir)
    return retrieval.dense(q, _points(spark, sf_dir), 40), _index(spark, sf_dir).search(q, 40)


def _fusion(name: str, constant: int, a: float, b: float) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d, x = _branches(spark, sf_dir)
        return retrieval.rrf(d, x, 10, a, b, constant).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))

    run.__name__ = name
    query(
        f"{HYBRID}, u AS (SELECT query_id, chunk_id, rank AS dense_rank, NULL::INTEGER AS lexical_rank, {a}::DOUBLE / ({constant} + rank) AS p FROM dr UNION ALL SELECT query_id, chunk_id, NULL, rank, {b}::DOUBLE / ({constant} + rank) FROM lr), "
        f"f AS (SELECT query_id, chunk_id, sum(p) AS score, min(dense_rank) AS dense_rank, min(lexical_rank) AS lexical_rank FROM u GROUP BY ALL), r AS (SELECT *, {FUSED} FROM f) SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM r WHERE rank <= 10"
    )(run)


_fusion("fusion_rrf", 60, 0.5, 0.5)
_fusion("fusion_weighted", 60, 0.8, 0.2)
_fusion("fusion_store", 2, 1.0, 1.0)

POLICY = f"""t3 AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS body FROM lr JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY query_id),
c AS (SELECT b.item_id AS query_id, len(list_intersect(list_distinct({KEPT.format('b.text')}), {KEPT.format('t3.body')})) / len(list_distinct({KEPT.format('b.text')})) AS confidence
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id LEFT JOIN t3 ON t3.query_id = b.item_id)"""


@query(f"{HYBRID}, {POLICY} SELECT query_id, round(coalesce(confidence, 0), 6) AS confidence, CASE WHEN query_id NOT IN (SELECT query_id FROM lr) THEN 1.0 WHEN confidence >= 0.65 THEN 0.5 WHEN confidence >= 0.35 THEN 0.65 ELSE 0.8 END::DOUBLE AS dense_weight, CASE WHEN query_id NOT IN (SELECT query_id FROM lr) THEN 'lexical-unavailable' WHEN confidence >= 0.65 THEN 'strong-lexical-evidence' WHEN confidence >= 0.35 THEN 'moderate-lexical-evidence' ELSE 'weak-lexical-evidence' END AS policy FROM c")
def fusion_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _both(spark, sf_dir), chunks(spark, sf_dir)
    told = retrieval.told(q, retrieval.dense(q, _points(spark, sf_dir), 40), kept(_index(spark, sf_dir).search(q, 40), "lexical"), c)
    return retrieval.policy(told).select("query_id", F.round("confidence", 6).alias("confidence"), "dense_weight", "policy")


@query(
    f"{HYBRID}, {POLICY}, w AS (SELECT query_id, CASE WHEN confidence >= 0.65 THEN 0.5 WHEN confidence >= 0.35 THEN 0.65 ELSE 0.8 END::DOUBLE AS a FROM c), u AS (SELECT query_id, chunk_id, rank AS dense_rank, NULL::INTEGER AS lexical_rank, a / (60 + rank) AS p FROM dr JOIN w USING (query_id) UNION ALL SELECT query_id, chunk_id, NULL, rank, round(1 - a, 2) / (60 + rank) FROM lr JOIN w USING (query_id)), "
    f"f AS (SELECT query_id, chunk_id, sum(p) AS score, min(dense_rank) AS dense_rank, min(lexical_rank) AS lexical_rank FROM u GROUP BY ALL), r AS (SELECT *, {FUSED} FROM f) "
    "SELECT query_id, chunk_id, rank, round(score, 9) AS score, CASE WHEN chunk_id % 5 <> 0 THEN chunk_id || ':docs/' || lang || '/' || chunk_id || '.md:chunk=0' ELSE chunk_id || ':https://example.com/' || lang || '/' || chunk_id || ':chunk=0' END AS citation FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10"
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both branches, adaptive weights, fusion, citations."""
    c = chunks(spark, sf_dir)
    ranked = retrieval.hybrid(_both(spark, sf_dir), c, _points(spark, sf_dir), 10, index=_index(spark, sf_dir))
    return retrieval.materialised(ranked.drop("policy"), c).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "citation")


#: Greedy suppression by recursion over ranks: a hit goes if one of those kept before it is a near copy.
DIVERSE = f"""WITH RECURSIVE {QTOK}, {DTOK}, s AS (SELECT query_id, chunk_id, sum(times * tf) / sqrt(any_value(n)) AS score FROM q JOIN d USING (t) GROUP BY ALL), r AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, {TOP} FROM s) WHERE rank <= 40),
w AS MATERIALIZED (SELECT query_id, chunk_id, rank, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM r JOIN documents ON doc_id = chunk_id),
p AS MATERIALIZED (SELECT a.query_id, a.rank, list(b.rank) AS near FROM w a JOIN w b ON a.query_id = b.query_id AND b.rank < a.rank AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.92 GROUP BY ALL),
g AS (SELECT query_id, 0 AS pos, []::INTEGER[] AS kept FROM (SELECT DISTINCT query_id FROM w) UNION ALL
  SELECT g.query_id, g.pos + 1, CASE WHEN list_has_any(coalesce(p.near, []), g.kept) THEN g.kept ELSE list_append(g.kept, g.pos + 1) END FROM g JOIN w ON w.query_id = g.query_id AND w.rank = g.pos + 1 LEFT JOIN p ON p.query_id = g.query_id AND p.rank = g.pos + 1),
k AS (SELECT query_id, unnest(kept) AS rank FROM (SELECT query_id, arg_max(kept, pos) AS kept FROM g GROUP BY query_id))
SELECT query_id, chunk_id, rank FROM r JOIN k USING (query_id, rank)"""


@query(DIVERSE)
def hybrid_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    ranked = _index(spark, sf_dir).search(_asked(spark, sf_dir), 40).join(c.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "rank", "text")
    return retrieval.diversified(ranked).drop("text")


# Chunks, blocks, duplicates

WIN = "w AS (SELECT doc_id, i::INTEGER AS i, trim(substr(text, (i * 880 + 1)::BIGINT, 1000), chr(32) || chr(10) || chr(9) || chr(13)) AS t FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 880.0))::BIGINT)) AS i FROM documents WHERE length(text) > 0)), k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, t AS text FROM w WHERE t <> '')"


@query(f"WITH {WIN} SELECT doc_id, chunk_index, length(text)::INTEGER AS n_chars, sha256(text) AS checksum FROM k")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.length("text").alias("n_chars"), "checksum")


@query(f"WITH {WIN} SELECT lang, count(*) AS n_chunks, round(avg(length(k.text)), 6) AS mean_chars, round(quantile_cont(length(k.text), 0.5), 6) AS p50_chars, round(quantile_cont(length(k.text), 0.95), 6) AS p95_chars, max(length(k.text))::INTEGER AS max_chars, round(avg(CASE WHEN regexp_matches(k.text, '[.!?;:]$') THEN 0 ELSE 1 END), 6) AS non_boundary FROM k JOIN documents USING (doc_id) GROUP BY lang")
def chunk_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.shape(chunking.chunked(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), ["lang"])


@query(f"WITH {WIN}, n AS (SELECT doc_id, sum(length(text)) AS c FROM k GROUP BY doc_id) SELECT source, round(sum(c) / sum(length(text)), 6) AS inflation FROM documents JOIN n USING (doc_id) GROUP BY source")
def chunk_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    c = chunking.chunked(d).groupBy("doc_id").agg(F.sum(F.length("text")).alias("c"))
    return d.join(c, "doc_id").groupBy("source").agg(F.round(F.sum("c") / F.sum(F.length("text")), 6).alias("inflation"))


@query(f"WITH {WIN} SELECT doc_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY chunk_index) AS n FROM k) WHERE n = 1")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.deduplicated(chunking.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "chunk_index")


@query("SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return d.groupBy("checksum").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("c")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(regexp_replace(b.text, '\\s+', ' ', 'g')))")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage whole, with white space and case normalised."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.normalized(F.col("text")).alias("passage"))
    return relevance.containing(table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("body")), items)


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(table(spark, sf_dir, "pages"))


@query()
def html_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = html.blocks(table(spark, sf_dir, "pages")).withColumn("page", F.lit(None).cast("int"))
    return chunking.coalesced(b, "page_id", 1500).select("page_id", "block_index", "kind", F.length("text").alias("n_chars"), F.size("sources").alias("n_sources"))


# Snapshots. The previous snapshot lacks every ninth document, and every seventh had another text.

OLD = "old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS checksum, 'p' || doc_id AS point_id FROM documents WHERE doc_id % 9 <> 0), new AS (SELECT doc_id, sha256(text) AS checksum FROM documents WHERE doc_id % 8 <> 0)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    before = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.where("doc_id % 9 <> 0").select("doc_id", F.col("doc_id").alias("chunk_id"), F.sha2(before, 256).alias("checksum"), F.concat(F.lit("p"), "doc_id").alias("point_id"))
    return old, d.where("doc_id % 8 <> 0").select("doc_id", F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("checksum"))


@query(f"WITH {OLD} SELECT new.doc_id, old.point_id, old.doc_id IS NOT NULL AS reused FROM new LEFT JOIN old ON old.doc_id = new.doc_id AND old.checksum = new.checksum")
def snapshot_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return snapshot.reused(new, old, ["doc_id", "checksum"], ["point_id"]).select("doc_id", "point_id", "reused")


@query(f"WITH {OLD} SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed' WHEN old.checksum = new.checksum THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.changes(*_snapshots(spark, sf_dir), "doc_id", "checksum")


@query(f"WITH {OLD} SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def snapshot_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.stale(*_snapshots(spark, sf_dir)).select("doc_id")


FEED = "feed AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, round(value, 2) AS value FROM events), prev AS (SELECT DISTINCT user_id, -1.0::DOUBLE AS value FROM events UNION ALL SELECT 1000000 + c_custkey, c_acctbal FROM customer), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM feed) WHERE n = 1)"


@query(f"WITH {FEED} SELECT user_id, value FROM prev WHERE user_id NOT IN (SELECT user_id FROM last) UNION ALL SELECT user_id, value FROM last WHERE kind = 'upsert'")
def snapshot_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    feed = e.select("event_id", "user_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("kind"), F.round("value", 2).alias("value"))
    prev = e.select("user_id").distinct().withColumn("value", F.lit(-1.0)).unionByName(table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("user_id"), F.col("c_acctbal").alias("value")))
    return snapshot.apply_changes(prev, feed, "user_id", "event_id")


# Catalog and queue


@query(f"WITH {JOBS} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'dead_lettered') AS dead_lettered, min(created_at) FILTER (WHERE status = 'pending') AS oldest_pending_at, count(*) FILTER (WHERE status = 'running' AND lease_expires_at <= {NOW_SQL}) AS stale_running, count(*) FILTER (WHERE status = 'completed' AND completed_at >= {NOW_SQL} - INTERVAL 24 HOUR) AS completed_24h, count(*) FILTER (WHERE status = 'failed' AND completed_at >= {NOW_SQL} - INTERVAL 24 HOUR) AS failed_24h FROM jobs")
def catalog_queue_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.queue_overview(jobs(spark, sf_dir), now_col()).toDF("pending", "running", "failed", "dead_lettered", "oldest_pending_at", "stale_running", "completed_24h", "failed_24h")
    return o


@query("WITH s AS (SELECT CASE WHEN c_acctbal < 0 THEN 'deleted' WHEN c_mktsegment = 'BUILDING' THEN 'paused' ELSE 'active' END AS status, c_custkey % 2 = 0 AS sync_enabled, c_acctbal AS sync_next_at FROM customer) SELECT count(*) FILTER (WHERE status <> 'deleted') AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'paused') AS paused, count(*) FILTER (WHERE status <> 'deleted' AND sync_enabled) AS scheduled, min(sync_next_at) FILTER (WHERE status <> 'deleted' AND sync_enabled) AS next_sync_at FROM s")
def catalog_source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_overview(table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_acctbal < 0 THEN 'deleted' WHEN c_mktsegment = 'BUILDING' THEN 'paused' ELSE 'active' END AS status", "c_custkey % 2 = 0 AS sync_enabled", "c_acctbal AS sync_next_at"))


@query(f"WITH {JOBS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, job_id DESC) AS n FROM jobs WHERE status = 'completed') WHERE n = 1) SELECT coalesce(sum(doc_count), 0)::BIGINT AS documents, coalesce(sum(coalesce(try_cast(nullif(stats->>'$.chunks_total', '') AS BIGINT), chunk_count, 0)), 0)::BIGINT AS chunks FROM l")
def catalog_knowledge_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.knowledge_size(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT source_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, job_id DESC) AS n FROM jobs) WHERE n = 1")
def catalog_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(jobs(spark, sf_dir), "source_id", "created_at", "job_id").select("source_id", "job_id", "status")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def catalog_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 20).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (SELECT (o_orderdate, o_orderkey) FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 19) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def catalog_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    seen = catalog.page(o, "o_orderdate", "o_orderkey", 19).collect()  # the page that a reader has
    if len(seen) < 20:
        return o.select("o_orderkey", "o_orderdate").limit(0)
    return catalog.page(o, "o_orderdate", "o_orderkey", 20, (seen[-1]["o_orderdate"], seen[-1]["o_orderkey"])).select("o_orderkey", "o_orderdate")


@query(f"WITH {JOBS} SELECT job_id, status, completed_at FROM jobs WHERE status IN ('failed', 'dead_lettered') ORDER BY completed_at DESC, job_id DESC LIMIT 10")
def catalog_recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where("status IN ('failed', 'dead_lettered')").orderBy(F.desc("completed_at"), F.desc("job_id")).limit(10).select("job_id", "status", "completed_at")


@query(f"WITH {JOBS} SELECT job_id, attempts FROM jobs WHERE status = 'pending' AND coalesce(available_at, created_at) <= {NOW_SQL} AND attempts < 3")
def queue_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.claimable(jobs(spark, sf_dir), now_col()).select("job_id", "attempts")


@query(f"WITH {JOBS} SELECT job_id, attempts + 1 AS attempts, 'running' AS status, {NOW_SQL} + INTERVAL 60 SECOND AS lease_expires_at FROM jobs WHERE status = 'pending' AND coalesce(available_at, created_at) <= {NOW_SQL} AND attempts < 3 ORDER BY created_at, job_id LIMIT 25")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.claimed(jobs(spark, sf_dir), now_col(), "w1", 25).select("job_id", "attempts", "status", "lease_expires_at")


@query(f"WITH {JOBS} SELECT t AS transition, count(*) AS n FROM (SELECT CASE WHEN status = 'running' AND lease_expires_at <= {NOW_SQL} AND attempts >= 3 THEN 'dead_lettered_running' WHEN status = 'running' AND lease_expires_at <= {NOW_SQL} THEN 'recovered_running' WHEN status = 'failed' AND attempts < 3 THEN 'recovered_failed' WHEN status IN ('failed', 'pending') AND attempts >= 3 THEN 'dead_lettered_exhausted' ELSE 'kept' END AS t FROM jobs) GROUP BY t")
def queue_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reconciled(jobs(spark, sf_dir), now_col()).groupBy("transition").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS} SELECT job_id, least(300, 2.0 * pow(2, attempts - 1))::DOUBLE AS delay FROM jobs WHERE status = 'failed'")
def queue_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where("status = 'failed'").select("job_id", catalog.backoff(F.col("attempts")).alias("delay"))


@query(f"WITH {JOBS}, g AS (SELECT o_orderkey AS generation_id, o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'P' THEN 'prepared' ELSE 'active' END AS status FROM orders) SELECT generation_id, jobs.status AS job_status FROM g LEFT JOIN jobs USING (job_id) WHERE g.status IN ('staging', 'prepared') AND (jobs.status IS NULL OR jobs.status <> 'running')")
def queue_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS generation_id", "o_orderkey AS job_id", "CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'P' THEN 'prepared' ELSE 'active' END AS status")
    return catalog.orphaned(g, jobs(spark, sf_dir)).select("generation_id", "job_status")


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS batch FROM events")
def outbox_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.outbox(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "batch")


# Metrics, evaluation, gates


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS requests, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95_linear, max(value) FILTER (WHERE i = least(floor(n * 0.95)::BIGINT + 1, n)) AS p95 FROM r GROUP BY event_type")
def metrics_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    linear = e.groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95_linear"))
    return linear.join(quality.truncated_percentile(e, ["event_type"], "value", 0.95), "event_type")


@query("WITH c AS (SELECT o_orderpriority AS tier, o_orderstatus AS model, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS task, ((o_totalprice - o_totalprice / 4) * 3 + o_totalprice / 4 * 0.3 + o_totalprice / 10 * 15) / 1e6 AS cost_usd, o_custkey AS tokens FROM orders) SELECT tier, model, task, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd, sum(tokens)::BIGINT AS tokens FROM c GROUP BY GROUPING SETS ((tier), (model), (task), ())")
def metrics_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("model"), F.when(p > 200000, "large").otherwise("small").alias("task"), quality.cost(p, p / 4, p / 10, 3.0, 0.3, 15.0).alias("cost_usd"), F.col("o_custkey").alias("tokens"))
    return quality.costs(c)


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def metrics_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_type", "value")


# A case is a query vector, relevant is what has its label, its category is the label.
CASES = f"{DENSE}, r AS (SELECT *, {TOP} FROM s WHERE query_id <> chunk_id), h AS (SELECT query_id, query_label, rank, label = query_label AS rel FROM r WHERE rank <= 10), tot AS (SELECT a.vec_id AS query_id, a.label AS category, count(*) FILTER (WHERE b.label = a.label AND b.vec_id <> a.vec_id) AS total FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 GROUP BY ALL), e AS (SELECT query_id, min(rank) FILTER (WHERE rel) AS first_rank, count(*) FILTER (WHERE rel AND rank <= 5) AS h5, count(*) FILTER (WHERE rel) AS h10, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel), 0) AS dcg FROM h GROUP BY query_id), sc AS (SELECT query_id AS case_id, category, total, first_rank, CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END AS rr_10, h5 / 5.0::DOUBLE AS precision_5, h10 / 10.0::DOUBLE AS precision_10, CASE WHEN total > 0 THEN least(1.0, h10 / total::DOUBLE) END AS recall_10, dcg / list_sum(list_transform(generate_series(1, least(greatest(total, 1), 10)), lambda x: 1 / log2(x + 1))) AS ndcg_10, coalesce(first_rank <= 5, false) AS passed FROM tot JOIN e USING (query_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, asked = _points(spark, sf_dir), _vectors(spark, sf_dir)
    found = retrieval.dense(asked, points, 11).where("query_id <> chunk_id")
    hits = retrieval.top(found.drop("rank"), 10).join(points.select("chunk_id", "label"), "chunk_id").join(asked.select("query_id", "query_label"), "query_id")
    hits = hits.select(F.col("query_id").alias("case_id"), "rank", (F.col("label") == F.col("query_label")).alias("relevant"), F.col("chunk_id").alias("entity"))
    sizes = points.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("total"))
    totals = asked.join(sizes, "query_label").select(F.col("query_id").alias("case_id"), F.col("query_label").alias("category"), "total")
    return quality.case_scores(hits, totals)


@query(f"WITH {CASES} SELECT case_id, category, total, first_rank, round(rr_10, 6) AS rr_10, precision_5, precision_10, round(recall_10, 6) AS recall_10, round(ndcg_10, 6) AS ndcg_10, passed FROM sc")
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("rr_10", "recall_10", "ndcg_10")})


@query(f"WITH {CASES} SELECT category, count(*) AS cases, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5, 10)) + ", " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("rr_10", "precision_5", "precision_10", "recall_10", "ndcg_10")) + " FROM sc GROUP BY GROUPING SETS ((), (category))")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(_scores(spark, sf_dir))


@query(f"WITH {CASES}, m AS (SELECT avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END) AS hit_5, avg(rr_10) AS rr_10 FROM sc) SELECT 'hit_5' AS metric, 'min' AS kind, 0.7::DOUBLE AS threshold, round(hit_5, 6) AS value, hit_5 >= 0.7 AS ok FROM m UNION ALL SELECT 'rr_10', 'min', 0.45, round(rr_10, 6), rr_10 >= 0.45 FROM m")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.summary(_scores(spark, sf_dir)).where("category IS NULL")
    return quality.gate(m, [("hit_5", "min", 0.7), ("rr_10", "min", 0.45)])


@query("WITH m AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'c' END AS side, round(avg(o_totalprice), 4) AS price, round(quantile_cont(o_totalprice, 0.95), 4) AS p95_ms FROM orders GROUP BY ALL), x AS (SELECT b.price AS bp, b.p95_ms AS bl, c.price AS cp, c.p95_ms AS cl FROM m b, m c WHERE b.side = 'b' AND c.side = 'c') SELECT 'price' AS metric, bp AS baseline, cp AS candidate, cp >= bp - 100.0 AS ok FROM x UNION ALL SELECT 'p95_ms', bl, cl, cl <= bl * 1.15 FROM x")
def eval_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda n: o.where(F.col("o_orderkey") % 2 == n).agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95_ms"))
    return quality.promotion(side(0), side(1), ["price"], 100.0)


@query()
def catalog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fingerprint(chunks(spark, sf_dir).withColumn("checksum", F.sha2("text", 256))).select("rows", "xor", F.col("total").cast("string").alias("total"))


# Conversations

STRIP = "regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '')"


@query(f"WITH t AS (SELECT conv_id, turn, lower(trim(role)) AS role, {STRIP} AS c FROM conversations), a AS (SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'user' AND c <> ''), max(turn)) AS asked FROM t GROUP BY conv_id) SELECT t.conv_id, max(c) FILTER (WHERE turn = asked) AS query, array_to_string(list(c ORDER BY turn) FILTER (WHERE role = 'system' AND c <> ''), chr(10) || chr(10)) AS system_prompt, count(*) FILTER (WHERE c <> '' AND role IN ('user', 'assistant') AND turn <> asked)::INTEGER AS n_history FROM t JOIN a USING (conv_id) GROUP BY t.conv_id")
def chat_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prepared(table(spark, sf_dir, "conversations")).select("conv_id", "query", "system_prompt", F.size("history").alias("n_history"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def chat_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.session(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


def _route_sql() -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains(text, '{h}')" for h in hints)} THEN '{name}'" for name, hints in chat.ROUTES)
    return f"SELECT conv_id, turn, CASE {cases} ELSE 'mixed' END AS route FROM conversations"


@query(_route_sql())
def chat_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.route(F.col("text")).alias("route"))


# Streams, as the batch that they amount to


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours((6 * i)::INT) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "12 hours", slide="6 hours")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"))


# The relational surface of the SQL tool: one statement for both engines

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
STATEMENTS = {
    "sql_inner_join": "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_mktsegment, count(*) AS n_rows, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_mktsegment",
    "sql_full_join": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, n_suppliers, n_customers FROM (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) b ON s_nationkey = c_nationkey",
    "sql_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sql_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_theta_join": "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "sql_aggregates": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_cube": "SELECT p_type, p_size, count(*) AS n FROM part GROUP BY CUBE (p_type, p_size)",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "sql_ranking": "SELECT c_custkey, c_nationkey, r, d FROM (SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer) t WHERE r <= 3",
    "sql_frames": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS recent, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "sql_union": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    "sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sql_correlated_subquery": "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer d WHERE d.c_nationkey = c.c_nationkey)",
    "sql_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_with": "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey), m AS (SELECT max(q) AS top FROM big) SELECT l_orderkey, round(q, 2) AS q FROM big, m WHERE q > top * 0.7",
}


def _statement(name: str, statement: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from larkspire.operators.sqltool import SqlTool

        return SqlTool(spark, {t: table(spark, sf_dir, t) for t in _TABLES}, 2**31 - 1, with_clauses=True).select(statement)

    run.__name__ = name
    query(statement)(run)


for _name, _sql in STATEMENTS.items():
    _statement(_name, _sql)


# Evidence, code, lifecycle

from larkspire.operators import code, evidence, lifecycle  # noqa: E402


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return evidence.deduplicated(c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), "text")).select(F.col("request_id").alias("conv_id"), F.col("position").alias("turn"))


@query()
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), (F.col("turn") % 3).cast("double").alias("score"), "text")
    return evidence.compressed(c, 2000, 900).select("request_id", "position", F.length("text").alias("n_chars"))


@query(
    "WITH q AS (SELECT conv_id, list_filter(regexp_extract_all(lower(arg_min(text, turn)), '[A-Za-z0-9_\\-]+'), lambda t: length(t) > 1) AS ks FROM conversations GROUP BY conv_id), "
    "p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS ss FROM conversations), "
    "s AS (SELECT conv_id, turn, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM p), "
    "g AS (SELECT conv_id, s, max(len(list_filter(ks, lambda k: contains(lower(s), k))) * 2 + least(length(s) // 80, 2)) AS score, min((turn, i)) AS place FROM s JOIN q USING (conv_id) GROUP BY ALL), "
    "r AS (SELECT conv_id, s, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, place) AS n FROM g) SELECT conv_id, n::INTEGER AS rank, score::INTEGER AS score, s AS sentence FROM r WHERE n <= 3"
)
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    asked = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    items = c.join(asked, "conv_id").select(F.col("conv_id").alias("request_id"), "query", F.col("turn").alias("position"), "text")
    return evidence.summary(items).withColumnRenamed("request_id", "conv_id")


@query("SELECT doc_id, i::INTEGER AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE contains(lower(l), 'worthless')")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.search(table(spark, sf_dir, "documents"), "Worthless", "doc_id").select("doc_id", "line")


@query("WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'HTTP status ' || (400 + event_id % 110) WHEN 'click' THEN 'Permission denied' WHEN 'view' THEN 'Source is deleted during ingestion' ELSE 'boom' END AS m, event_type, 400 + event_id % 110 AS s FROM events) SELECT c AS failure_class, r AS retryable, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' AND (s < 500 OR s IN (500, 502, 503, 504)) THEN 'http_' || s WHEN event_type = 'click' THEN 'configuration_error' WHEN event_type = 'view' THEN 'source_generation_mismatch' ELSE 'pipeline_failure' END AS c, CASE WHEN event_type = 'error' AND (s < 500 OR s IN (500, 502, 503, 504)) THEN s IN (408, 425, 429, 500, 502, 503, 504) WHEN event_type IN ('click', 'view') THEN false ELSE true END AS r FROM e) GROUP BY ALL")
def queue_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "CASE event_type WHEN 'error' THEN concat('HTTP status ', 400 + event_id % 110) WHEN 'click' THEN 'Permission denied' WHEN 'view' THEN 'Source is deleted during ingestion' ELSE 'boom' END"
    return table(spark, sf_dir, "events").select(lifecycle.failure(F.expr(m)).alias("f")).groupBy("f.failure_class", "f.retryable").agg(F.count("*").alias("n"))


SOURCES = "s AS (SELECT 's' || user_id AS source_id, 'active' AS status, user_id % 5 <> 0 AS sync_enabled, date_trunc('second', min(ts)) AS sync_next_at, (3600 + user_id)::BIGINT AS sync_interval FROM events GROUP BY user_id)"


@query(f"WITH {JOBS}, {SOURCES} SELECT source_id, 'sync-' || substr(sha256(source_id || ':' || epoch(sync_next_at)::BIGINT), 1, 27) AS job_id, source_id IN (SELECT source_id FROM jobs WHERE status IN ('pending', 'running')) AS blocked, sync_next_at + to_seconds(greatest(1, floor((epoch({NOW_SQL}) - epoch(sync_next_at)) / sync_interval)::BIGINT + 1) * sync_interval) AS sync_next_at FROM s WHERE sync_enabled AND sync_next_at <= {NOW_SQL} ORDER BY s.sync_next_at, source_id LIMIT 100")
def queue_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("sync_next_at"))
    s = s.selectExpr("concat('s', user_id) AS source_id", "'active' AS status", "user_id % 5 <> 0 AS sync_enabled", "sync_next_at", "3600 + user_id AS sync_interval")
    return lifecycle.due(s, jobs(spark, sf_dir), now_col())


@query(f"{HYBRID}, d10 AS (SELECT * FROM dr WHERE rank <= 10), l10 AS (SELECT * FROM lr WHERE rank <= 10) SELECT item_id AS query_id, round((SELECT count(*) FROM d10 JOIN l10 USING (query_id, chunk_id) WHERE query_id = item_id) / 10.0::DOUBLE, 4) AS overlap FROM benchmark JOIN embeddings ON vec_id = item_id")
def eval_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.shadow(*_branches(spark, sf_dir), 10)


@query("SELECT lang, count(*) AS chunks, min(source) AS source FROM documents GROUP BY lang")
def catalog_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.inventory(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND o_orderdate <= TIMESTAMP '2024-01-30' - INTERVAL 9000 DAY")
def catalog_deletable(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'retired' ELSE 'live' END AS state", "o_custkey % 3 AS ref_count", "o_orderdate AS updated_at")
    return lifecycle.deletable(o, now_col(), 9000).select("o_orderkey")
