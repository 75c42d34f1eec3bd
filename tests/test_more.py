"""Stores, sources, ingestion, golden sets and the engine's front against literal cases and plain Python."""

import collections
import hashlib
import json
import struct
import uuid
from datetime import UTC, datetime, timedelta

import pytest
import xxhash
from pyspark.sql import functions as F

from larkspire import engine as E
from larkspire.functions import text as T
from larkspire.functions import vector as V
from larkspire.operators import chunking, evidence, ingest, lifecycle, quality, relevance, retrieval, snapshot
from larkspire.operators.index import IndexVersions
from larkspire.operators.sqltool import NoSql, NotAllowed, SqlTool, looks_like_sql
from larkspire.plans import catalogue, more
from larkspire.sources import feed, files, html, remote


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expr.alias("y")).orderBy("i")
    return [r["y"] for r in rows.collect()]


def test_failures_by_any_state(spark):
    cases = {"server returned 503": ("http_503", True), "404": ("http_404", False), "409 conflict": ("http_409", False), "code 200 then 429": ("http_429", True), "error 5031": ("pipeline_failure", True), "API principal requires x": ("configuration_error", False), "source is deleted during ingestion": ("source_generation_mismatch", False), None: ("pipeline_failure", True)}
    got = column(spark, list(cases), lifecycle.failure(F.col("x")))
    assert [(r["failure_class"], r["retryable"]) for r in got] == list(cases.values())


def test_identifiers_fold(spark):
    assert column(spark, ["ＡＢ－12 _x", "Straße", "a­b−c – d", "Plain-Id 7", None], T.canonical_identifier(F.col("x"))) == ["ab12x", "strasse", "abcd", "plainid7", ""]


def test_versions_compare(spark):
    pairs = [("1.10", "1.9", True), ("1.0", "1", True), ("v2", "2", False), ("1.x", "1.0", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert rows.where(T.is_newer(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_point_ids(spark):
    u = uuid.uuid4()
    got = column(spark, ["12", str(u).upper(), "{" + str(u) + "}", "urn:uuid:" + str(u), "chunk", None], V.point_id(F.col("x"), F.lit("c-1")))
    made = str(uuid.uuid5(V.POINTS, "c-1"))
    assert got == ["12", str(u), str(u), str(u), made, made]


def test_sparse_vectors(spark):
    got = column(spark, ["B a_b a 深度 é", "", None], V.hash_sparse()(F.col("x")))
    want = collections.Counter(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") for w in ("b", "a", "b", "a", "深度", "é"))
    assert dict(zip(got[0]["indices"], got[0]["values"], strict=True)) == want and got[0]["indices"] == sorted(want)
    assert got[1]["indices"] == [] and got[2]["values"] == []


def test_the_sql_tool_walks_the_plan(spark):
    tool = SqlTool(spark, {"t": spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")}, 10)
    assert [r["n"] for r in tool.run("SELECT count(*) AS n FROM t WHERE y IN ('a', 'b') AND x > (SELECT min(x) FROM t);").collect()] == [1]
    for bad in (
        "SELECT try_reflect('java.lang.System','getProperty','user.home')", "SELECT reflect('a','b')", "SELECT java_method('a','b') FROM t", "SELECT x FROM t; SELECT 1", "WITH q AS (SELECT 1) SELECT * FROM q",
        "DROP TABLE t", "SELECT * FROM other", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM s.t", "SELECT y AS delete FROM t", "SELECT * FROM range(5)", "SELECT x FROM t WHERE y = try_reflect('a', 'b')", "SELECT (SELECT reflect('a', 'b')) FROM t",
        "SELECT TRANSFORM(x) USING 'cat' FROM t", "SELECT aes_decrypt(y, y) FROM t", "SELECT input_file_name() FROM t",
    ):
        with pytest.raises(NotAllowed):
            tool.select(bad)
    assert tool.simple("select x, z from t where y = 'b'").collect()[0].asDict() == {"x": 2, "z": None}
    with pytest.raises(NotAllowed):
        tool.simple("select x from t where x > 1")
    with pytest.raises(NotAllowed):
        NoSql().run("SELECT 1")
    assert looks_like_sql(" Select 1") and not looks_like_sql("how many?")


def test_places_are_checked():
    assert files.check_local("/srv/a/../b.txt", ("/srv",)) == "/srv/b.txt"
    for bad in ("/srv/../etc/passwd", "/srvx/a"):
        with pytest.raises(ValueError):
            files.check_local(bad, ("/srv",))
    with pytest.raises(ValueError):
        files.check_remote("http://10.0.0.1/")
    with pytest.raises(ValueError):
        files.check_remote("http://localhost/", resolve=True)


def test_files_objects_and_checkouts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("one")
    (tmp_path / "a/empty.txt").write_text("")
    (tmp_path / "b.txt").write_text("two " * 50)
    (tmp_path / "c.py").write_text("def f():\n    return 1\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/z.txt").write_text("no")
    root = str(tmp_path)
    assert files.listed(spark, root, max_files=1).count() == 1 and files.listed(spark, root).count() == 2  # Spark leaves empty files out
    o = {r["name"]: r for r in files.objects(spark, root, "d", max_bytes=100).collect()}
    assert set(o) == {"x.txt"} and o["x.txt"]["doc_id"] == "d:" + hashlib.sha256(f"{root}/a/x.txt".lstrip("/").encode()).hexdigest()[:16]
    assert [(r["language"], r["text"][:5]) for r in files.checkout(spark, root).collect()] == [("python", "def f")]


def test_blocks_keep_rows_without_key(spark):
    rows = spark.createDataFrame([(None, "<h1>a</h1><p>b</p>"), (1 << 60, "<p>c</p>"), (3, None)], "page_id long, html string")
    assert sorted(map(tuple, html.blocks(rows).collect()), key=str) == sorted([(None, 0, "heading", "a", "a"), (None, 1, "text", "b", "a"), (1 << 60, 0, "text", "c", None)], key=str)


DRIVE = {
    "files?parent=r": {"files": [{"id": "f", "mimeType": remote.FOLDER}, {"id": "1", "name": "a", "version": "1"}], "nextPageToken": "p"},
    "files?page=p&parent=r": {"files": [{"id": "2", "name": "b", "version": "7"}]}, "files?parent=f": {"files": [{"id": "r", "mimeType": remote.FOLDER}, {"id": "3", "name": "c"}]},
    "content?id=1": {"text": "one"}, "content?id=2": {"text": "two"}, "content?id=3": {"text": " "},
}


def crawled(spark, connector, config, known=()):
    listing = remote.crawl(spark, connector, config)
    got = remote.changes(listing, spark.createDataFrame(list(known), "external_id string, version string"), connector, config)
    return sorted((r["kind"], r["external_id"], r["record"] and json.loads(r["record"])["text"]) for r in got.collect())


def test_connectors_crawl_level_by_level(spark):
    drive = {"folder_id": "r", "recording": DRIVE}
    assert crawled(spark, remote.Drive, drive) == [("empty", "3", None), ("upsert", "1", "one"), ("upsert", "2", "two")]
    assert crawled(spark, remote.Drive, drive, [("1", ":1:"), ("2", "old"), ("3", "old"), ("9", "x")]) == [("delete", "3", None), ("delete", "9", None), ("upsert", "2", "two")]
    assert crawled(spark, remote.Drive, drive | {"recursive": False}) == [("upsert", "1", "one"), ("upsert", "2", "two")]
    block = lambda kind, t, **more: {"id": more.pop("id", "b"), "type": kind, kind: {"rich_text": [{"plain_text": t}], **more}}
    pages = {
        "pages/p": {"last_edited_time": "t1", "title": "P"}, "pages/q": {"last_edited_time": "t2"}, "blocks/q": {"results": [block("paragraph", "deep")]},
        "blocks/p": {"results": [block("heading_2", "H"), {"id": "q", "type": "child_page", "child_page": {"title": "Q"}}, block("code", "x", language="py")], "has_more": True, "next_cursor": "c"}, "blocks/p?cursor=c": {"results": [block("to_do", "t") | {"has_children": True, "id": "k"}, block("paragraph", "after")]}, "blocks/k": {"results": [block("paragraph", "nested")]},
    }
    assert crawled(spark, remote.Workspace, {"page_id": "p", "recording": pages}) == [("upsert", "p", "## H\nQ\n```py\nx\n```\n- t\nafter\nnested"), ("upsert", "q", "deep")]
    wiki = {"content?space=S&start=0": {"results": [{"id": 1, "version": {"number": 2}}, {"id": 2, "ancestors": [{"id": 9}]}]}, "content?space=S&start=2": {"results": []}, "content/1": {"title": "A", "body": {"storage": {"value": "<p>x &amp; y</p><ul><li>z</li></ul>"}}}, "content/2": {"body": {"storage": {"value": "<p>below</p>"}}}}
    assert crawled(spark, remote.Wiki, {"space_key": "S", "recording": wiki}) == [("upsert", "1", "x & y\nz"), ("upsert", "2", "below")]
    assert crawled(spark, remote.Wiki, {"space_key": "S", "root_page_id": "9", "recording": wiki}) == [("upsert", "2", "below")]


def test_checkpoints_move_on_after_publication(spark, tmp_path):
    sync = lambda recording: remote.Sync(spark, f"file://{tmp_path}", remote.Drive, {"folder_id": "r", "recording": recording})
    rows = lambda df: sorted((r["kind"], r["external_id"], r["remote_version"]) for r in df.collect())
    run, got = sync(DRIVE).stage()
    first = rows(got)
    assert first == [("upsert", "1", ":1:"), ("upsert", "2", ":7:")]
    changed = DRIVE | {"files?parent=r": {"files": [{"id": "1", "name": "a", "version": "2"}]}, "content?id=1": {"text": ""}}
    again, got = sync(changed).stage()  # as after a crash before publication
    assert again == run and rows(got) == first
    sync(changed).promote(run)
    sync(changed).promote(run)
    run, got = sync(changed).stage()
    assert rows(got) == [("delete", "1", ":2:"), ("delete", "2", None), ("delete", "3", None)]
    with pytest.raises(ValueError):
        sync(changed).promote("other")
    sync(changed).promote(run)
    assert rows(sync(changed).stage()[1]) == []


def test_providers_are_tried_again():
    slept, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise remote.ProviderError(503, 7 if len(calls) == 2 else None)
        return "ok"

    assert remote.retrying(call, sleep=slept.append, uniform=lambda: 1.0)(1) == "ok" and slept == [0.5, 7]
    with pytest.raises(remote.ProviderError):
        remote.retrying(lambda: (_ for _ in ()).throw(remote.ProviderError(404)), sleep=slept.append)()


def test_a_connector_as_a_data_source(spark):
    spark.dataSource.register(feed.ChangeFeed)
    drive = {"files?parent=r": {"files": [{"id": "1", "name": "a"}]}, "content?id=1": {"text": "one"}}
    rows = spark.read.format("change_feed").option("connector", "larkspire.sources.remote:Drive").option("config", json.dumps({"folder_id": "r", "recording": drive})).load().collect()
    assert [(r["kind"], r["external_id"]) for r in rows] == [("upsert", "1")]


def test_splitters():
    text = "First sentence here. Second one! " * 20 + "\n\n" + "word " * 100
    for how in (ingest.recursive_split, ingest.sentence_split):
        for size, overlap in ((50, 0), (120, 30)):
            parts = how(text, size, overlap)
            assert all(0 < len(p) <= size for p in parts)
            assert set(" ".join(parts).split()) >= set(text.split())
    assert ingest.recursive_split("aa bb cc", 5, 0) == ["aa bb", "cc"] and ingest.recursive_split("x" * 12, 5, 0) == ["xxxxx", "xxxxx", "xx"]
    assert ingest.sentence_split("One. Two. Three.", 10, 0) == ["One. Two.", "Three."]
    assert ingest.sentence_split("One. Two. Three.", 11, 5) == ["One. Two.", "Two. Three."]
    assert ingest.relocated("a\nb\nc\nb", ["a\nb", "c", "b", "zz"]) == [(1, 2), (3, 3), (4, 4), (4, 4)]


def test_split_against_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    spec = ingest.chunking_spec({"provider": "recursive", "chunk_size": 500, "chunk_overlap": 50})
    got = collections.defaultdict(list)
    for r in ingest.split(rows, spec).orderBy("doc_id", "place").collect():
        got[r["doc_id"]].append((r["text"], r["line_start"], r["line_end"]))
    for d, t in texts.items():
        parts = ingest.recursive_split(t or "", 500, 50)
        assert got.get(d, []) == [(p, *at) for p, at in zip(parts, ingest.relocated(t or "", parts), strict=True)]


def test_segments_of_blocks(spark):
    b = spark.createDataFrame([(1, 0, "A", "heading", "A"), (1, 1, "x" * 30, "text", "A"), (1, 2, "y" * 30, "text", "A"), (2, 0, "", "text", None)], "page_id long, block_index int, text string, kind string, section string")
    plain = ingest.segments(b, "page_id", ingest.chunking_spec({"chunk_size": 20, "chunk_overlap": 0})).orderBy("chunk_index").collect()
    assert [(r["block_index"], r["text"], r["chunk_index"]) for r in plain] == [(0, "A", 0), (1, "x" * 20, 1), (1, "x" * 10, 2), (2, "y" * 20, 3), (2, "y" * 10, 4)]
    joined = ingest.segments(b, "page_id", ingest.chunking_spec({"provider": "recursive", "chunk_size": 100, "chunk_overlap": 0, "block_coalescing": {"enabled": True}})).collect()
    assert [r["text"] for r in joined] == ["A\n\n" + "x" * 30 + "\n\n" + "y" * 30]
    assert ingest.chunking_spec({"chunk_size": 20, "chunk_overlap": 0}).config_hash != ingest.chunking_spec({"chunk_size": 21, "chunk_overlap": 0}).config_hash
    for bad in ({"provider": "x"}, {"strategy": "sentence"}, {"chunk_size": 5, "chunk_overlap": 5}):
        with pytest.raises(ValueError):
            ingest.chunking_spec(bad)


def test_a_second_run_takes_everything_over(spark, sf):
    first = more._run(spark, sf)
    old = first.current.drop("reused")
    now = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    again = ingest.ingested(more._candidate(spark, sf).where("doc_id % 13 <> 0"), old, first.documents, more.SOURCE, "g3", now)
    assert again.written.count() == 0 and again.stale.count() == 0 and again.removed_documents.count() == 0
    assert again.current.join(old, ["chunk_id", "point_id"]).count() == old.count()


def test_texts_are_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def count(s):
        seen.add(len(s))
        return s.map(lambda t: [float(len(t))])

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "b")], "i int, text string")
    got = {r["i"]: r["vector"] for r in ingest.embedded(rows, lambda c: count(c), prefix="q:").collect()}
    assert got == {1: [4.0], 2: [4.0], 3: [2.0], 4: [3.0]} and seen.value == 3


def test_batches_by_rows_and_bytes():
    import pandas as pd

    pdf = pd.DataFrame({"text": ["aaa", "b", "cc", None, "d" * 9]})
    assert [list(x.index) for x in ingest.batches([pdf], 3, 5)] == [[0, 1], [2, 3], [4]]


def test_index_versions(spark, sf, tmp_path):
    c = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS chunk_id", "doc_id", "sha2(text, 256) AS checksum", "text")
    now = [datetime(2024, 1, 1, tzinfo=UTC)]
    v = IndexVersions(spark, f"file://{tmp_path}", {"h8": (V.hash_embedding(8), 8), "wrong": (V.hash_embedding(4), 8)}, lambda: now[0])
    v.create("a", "h8")
    assert v.build("a", c) == c.count()
    with pytest.raises(ValueError):
        v.activate("a", c)
    v.mark_ready("a", {"mrr": 1.0}, True, c)
    v.activate("a", c)
    v.create("b", "h8")
    v.build("b", c)
    with pytest.raises(RuntimeError):
        v.mark_ready("b", {"mrr": 1.0}, True, c.where("doc_id > 3"))
    v.mark_ready("b", {"mrr": 1.0}, True, c)
    with pytest.raises(RuntimeError):
        v.activate("b", c, expected=None)
    v.activate("b", c, expected="a")
    assert v.active() == "b" and {r["version"]: r["status"] for r in v.table().collect()} == {"a": "retired", "b": "active"}
    v.rollback("a", c)
    assert v.active() == "a" and v.reconcile() == "consistent" and v.read().count() == c.count()
    assert v.prune() == []
    now[0] += timedelta(days=8)
    assert v.prune() == ["b"]
    v.create("w", "wrong")
    with pytest.raises(Exception, match="dimension"):
        v.build("w", c)
    assert {r["version"]: r["status"] for r in v.table().collect()} == {"a": "active", "w": "failed"}


def test_generations_replace_their_pointer(spark, tmp_path):
    g = snapshot.Generations(spark, f"file://{tmp_path}/g")
    for i, name in enumerate(("one", "two")):
        g.stage(spark.range(i + 1), name)
        g.activate(name, "one" if i else None)
    assert g.active() == "two" and g.read().count() == 2
    g.rollback()
    assert g.active() == "one"


def test_places_in_an_order(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert sorted((r["k"], r["position"]) for r in snapshot.numbered(rows, "k").collect()) == [(i, i) for i in range(1000)]
    assert snapshot.numbered(rows.limit(0), "k").count() == 0


def test_requests_and_plans():
    assert E.plan("vector") == "dense" and E.plan(None, "hybrid") == "hybrid_rrf"
    for bad in ({"top_k": 0}, {"candidate_pool": 0}, {"deadline_ms": -1}, {"fusion": E.Fusion()}, {"plan": "x"}, {"index_version": " "}):
        with pytest.raises(ValueError):
            E.Request(**bad)
    with pytest.raises(ValueError):
        E.Fusion(0, 1)
    assert [(f.dense, f.sparse) for f in E.fusions("1:1, 3:1,1:1")] == [(1, 1), (3, 1)] and E.Fusion().contract_id != E.Fusion(3, 1).contract_id


def test_the_engine(spark, sf):
    c = catalogue.chunks(spark, sf)
    e = E.hash_engine(c, 32)
    q = spark.createDataFrame([(1, "the of and"), (2, " "), (3, "深度")], "query_id long, query string")
    found, trace = e.search(q, E.Request(3, diversity=True))
    rows = found.collect()
    assert collections.Counter(r["query_id"] for r in rows) == {1: 3} and sorted(r["rank"] for r in rows) == [1, 2, 3]
    assert trace["plan"] == "hybrid_rrf" and trace["candidates"]["dense"] == 40 and set(trace["stage_ms"]) == {"dense", "lexical", "results"}
    with pytest.raises(E.DeadlineExceeded) as err:
        e.search(q, E.Request(3, deadline_ms=1))
    assert err.value.stage in ("dense", "lexical", "results")
    with pytest.raises(E.NotSupported):
        E.Engine(c).search(q, E.Request(3, "dense"))


def test_lexical_terms_are_those_of_spark(spark):
    cases = ["The Plan-B of 深度学习 x 书", "the of", "", "İstanbul K9", "é a_b A_B", "一"]
    got = column(spark, cases, T.search_terms(F.col("x")))
    for t, terms in zip(cases, got, strict=True):
        counts, n = retrieval.counted_terms(t)
        assert n == len(terms) and collections.Counter(terms) == +counts, t


def test_cjk_search(spark):
    docs = spark.createDataFrame([(1, "向量数据库支持相似度检索"), (2, "今天天气很好"), (3, "全文检索与向量检索")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "向量检索"), (2, "天气")], "query_id long, query string")
    first = {r["query_id"]: r["chunk_id"] for r in retrieval.lexical(q, docs, 5).where("rank = 1").collect()}
    assert first == {1: 3, 2: 2}


def test_golden_files(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"cases": [{"id": "a", "query": "q", "relevance": {"pages": ["1"], "max_rank": 3}}, {"id": "b", "query": "r", "category": "x"}]}))
    rows = {r["case_id"]: r for r in relevance.golden(spark, str(p)).collect()}
    assert rows["a"]["category"] == "default" and rows["a"]["pages"] == ["1"] and rows["b"]["category"] == "x"
    for bad in ([], [{"id": "a", "query": "q"}] * 2, [{"id": "", "query": "q"}]):
        p.write_text(json.dumps({"cases": bad}))
        with pytest.raises(ValueError):
            relevance.golden(spark, str(p))


def test_fingerprint_against_python(spark, sf):
    got = catalogue.catalog_fingerprint(spark, sf).first()
    xor = total = n = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        h = 42
        for raw in (struct.pack("<q", r["doc_id"]), struct.pack("<q", r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest().encode()):
            h = xxhash.xxh64_intdigest(raw, h)
        h -= (h >> 63) << 64
        xor, total, n = xor ^ h, total + h, n + 1
    assert (got["rows"], got["xor"], got["total"]) == (n, xor, str(total))


def test_diversified_against_python(spark, sf):
    ranked = retrieval.lexical(catalogue._asked(spark, sf), catalogue.chunks(spark, sf), 40).collect()
    texts = {r["doc_id"]: set((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, by = set(), collections.defaultdict(list)
    for r in sorted(ranked, key=lambda r: (r["query_id"], r["rank"])):
        s = texts[r["chunk_id"]]
        if not s or all(len(s & o) / len(s | o) < 0.92 for o in by[r["query_id"]]):
            by[r["query_id"]].append(s)
            want.add((r["query_id"], r["chunk_id"]))
    assert {(r["query_id"], r["chunk_id"]) for r in catalogue.hybrid_diversified(spark, sf).collect()} == want


def test_budget_against_python(spark, sf):
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        t = r["text"] or ""
        rows[r["conv_id"]].append((-float(r["turn"] % 3), r["turn"], t if len(t) <= 900 else t[:900] + evidence.TRUNCATED))
    want = set()
    for c, items in rows.items():
        total, any_kept = 0, False
        for _, turn, t in sorted(items):
            if not any_kept or total + len(t) <= 2000:
                want.add((c, turn, len(t)))
                total, any_kept = total + len(t), True
    assert {tuple(r) for r in catalogue.evidence_budget(spark, sf).collect()} == want


def test_coalesced_pages_against_python(spark, sf):
    got = collections.Counter()
    for r in catalogue.html_coalesced(spark, sf).collect():
        got[r["page_id"]] += r["n_sources"]
    want = {r["page_id"]: len(html.parse(r["html"])) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_confidence_has_three_steps(spark):
    rows = spark.createDataFrame([(True, True, None), (True, True, "sql_rows"), (True, False, None), (False, True, None)], "d boolean, e boolean, m string")
    assert [r[0] for r in rows.select(evidence.confidence(F.col("d"), F.col("e"), F.col("m"))).collect()] == ["high", "medium", "low", "low"]


def test_every_policy_case(spark):
    rows = [(0, 3, 0.9, False), (2, 0, 0.9, False), (0, 0, 0.0, False), (1, 1, 0.9, True), (1, 1, 0.7, False), (1, 1, 0.4, False), (1, 1, 0.1, False)]
    told = spark.createDataFrame(rows, "dense_hits int, lexical_hits int, confidence double, cross_language boolean")
    assert [(r["dense_weight"], r["lexical_weight"]) for r in retrieval.policy(told).collect()] == [(0.0, 1.0), (1.0, 0.0), (0.5, 0.5), (0.9, 0.1), (0.5, 0.5), (0.65, 0.35), (0.8, 0.2)]
    assert {r["policy"] for r in retrieval.policy(told.where("confidence > 0 AND dense_hits > 0 AND lexical_hits > 0"), True).collect()} == {"hash-development-fallback"}


def test_an_empty_table_of_events_has_metrics(spark):
    e = spark.createDataFrame([], "k string, v double")
    assert quality.truncated_percentile(e, ["k"], "v", 0.95).count() == 0
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(100)] + [("b", 5.0)], "k string, v double")
    want = {k: sorted(v)[min(int(len(v) * 0.95), len(v) - 1)] for k, v in {"a": [float(i % 7) for i in range(100)], "b": [5.0]}.items()}
    assert {r["k"]: r["p95"] for r in quality.truncated_percentile(rows, ["k"], "v", 0.95).collect()} == want


def test_chunk_segments_lose_no_text(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = collections.defaultdict(set)
    b = html.blocks(spark.read.parquet(f"{sf}/pages.parquet"))
    spec = ingest.chunking_spec({"provider": "sentence", "chunk_size": 400, "chunk_overlap": 80, "block_coalescing": {"enabled": True}})
    for r in ingest.segments(b, "page_id", spec).collect():
        assert len(r["text"]) <= 400
        got[r["page_id"]] |= set(r["text"].split())
    for k, h in pages.items():
        assert {w for _, _, t, _ in html.parse(h) for w in t.split() if len(w) < 400} <= got[k]
    assert chunking.STANDALONE


def test_hash_embeddings_against_python(spark):
    import numpy as np

    got = column(spark, ["B a_b a é x-1", "", None], V.hash_embedding(16)(F.col("x")))
    v = np.zeros(16)
    for w in ("b", "a_b", "a", "x-1"):
        v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 16] += 1
    assert np.allclose(got[0], v / np.linalg.norm(v)) and got[1] == [0.0] * 16 == got[2]


def test_embedders_in_bounded_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(1)
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, text string").coalesce(1)
    got = rows.select("i", ingest.batch_embedder(encode, 2, 2)(F.col("text")).alias("v")).collect()
    assert {r["i"]: r["v"] for r in got} == {i: [float(i), 1.0] for i in range(5)} and calls.value == 3
    with pytest.raises(Exception, match="must give 3"):
        rows.select(ingest.batch_embedder(encode, 3, 2)(F.col("text"))).collect()


def test_reports(spark):
    from larkspire.operators import reports

    t = spark.createDataFrame([("a|b", 0.5, None)], "name string, value double, note string")
    assert reports.markdown("T", t).splitlines()[4] == "| a\\|b | 0.5000 |  |"
    assert "<td>a|b</td><td>0.5000</td>" in reports.page("T", t)
    with pytest.raises(ValueError):
        reports.markdown("T", spark.range(1001))


def test_components_by_name():
    from larkspire import registry

    r = registry.default()
    r.load("a-group-that-no-package-has")
    assert r.create("chunker", "spec", config=None).size == 1000 and callable(r.create("reranker", "overlap"))
    with pytest.raises(ValueError):
        r.register("parser", "html", None)
    with pytest.raises(KeyError):
        r.create("embedder", "none")


def test_the_agents_loop():
    from larkspire.operators import chat

    tools = {"sql_query": lambda q: [], "retrieve": lambda q: ["doc"], "code_search": lambda q: ["code"]}
    lacks = lambda route, found: None if "doc" in found or route == "code" else ("doc_chunks", "retrieve")
    assert chat.answered("q", tools, lambda q: "sql", lacks) == {"route": "sql", "evidence": ["doc"], "actions": ["sql_query", "retrieve"], "confidence": "high"}
    none = chat.answered("q", tools | {"retrieve": lambda q: []}, lambda q: "mixed", lacks)
    assert none["confidence"] == "low" and len(none["actions"]) == 3


def test_the_worker_as_a_stream(spark, tmp_path):
    from larkspire.operators import store

    folder, seen = str(tmp_path / "in"), []
    spark.range(3).write.parquet(folder)
    q = store.work(spark.readStream.schema("id long").parquet(folder), lambda batch, i: seen.append((i, batch.count())), str(tmp_path / "c"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sum(n for _, n in seen) == 3


def test_corpus_units(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\f \fthree")
    got = [(r["page"], r["text"]) for r in files.units(spark, str(tmp_path)).orderBy("page").collect()]
    assert got == [(1, "one"), (2, "two"), (4, "three")]


def test_passages_in_slices(spark, sf, monkeypatch):
    want = sorted(map(tuple, catalogue.contamination(spark, sf).collect()))
    monkeypatch.setattr(relevance, "PASSAGES", 7)
    assert sorted(map(tuple, catalogue.contamination(spark, sf).collect())) == want


def test_answer_samples(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"question": "q", "ground_truth": "a b", "contexts": ["a c"], "answer": "a"}\n')
    row = quality.answer_quality(relevance.lines(spark, str(tmp_path / "s.jsonl"))).first()
    assert (row["faithfulness"], row["answer_relevancy"], row["context_precision"]) == (0.5, 0.0, 0.5)


def test_markers_of_keys_beyond_six_digits(spark, tmp_path):
    """The SQL's lpad cuts them, and the query gives what the SQL gives; the function keeps all digits."""
    import duckdb

    keys = [1, 999_999, 1_000_000, 1_234_567, 12_345_678]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, more.text_marker(spark, str(tmp_path)).collect())) == sorted(db.sql(catalogue.SQL["text_marker"]).fetchall())
    assert column(spark, [1_234_567], T.document_marker(F.col("x")), "long") == ["RB1234567A RB1234567B RB1234567C RB1234567D"]


@pytest.mark.parametrize("provider", ["recursive", "sentence"])
def test_texts_go_to_the_splitters_in_bounded_batches(spark, provider):
    from larkspire.session import BATCH_BYTES, BATCH_ROWS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    got = ingest.split(spark.range(3).select("id", F.lit("One two. Three four.").alias("text")), ingest.chunking_spec({"provider": provider, "chunk_size": 10, "chunk_overlap": 0}))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    assert got.groupBy("id").agg(F.collect_list("text")).count() == 3
