"""Literal cases, order-dependent operators against plain Python, and plans."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from larkspire.functions import text as T
from larkspire.functions import vector as V
from larkspire.operators import catalog, chat, chunking, quality, retrieval, snapshot
from larkspire.operators.filters import Filter, security_scope, tenants
from larkspire.operators.sqltool import NotAllowed, SqlTool
from larkspire.sources import files, html


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_lexicalize_cjk(spark):
    assert one(spark, T.lexicalize(F.col("x")), "Foo-Bar 深度学习 x 书 é9") == ["foo-bar", "x", "9", "深度", "度学", "学习", "书"]
    assert one(spark, T.contains_cjk(F.col("x")), "abc") is False
    assert one(spark, T.lexicalize(F.col("x")), None) == []


def test_stop_words_fall_back(spark):
    assert one(spark, T.search_terms(F.col("x")), "the of") == ["the", "of"]
    assert one(spark, T.search_terms(F.col("x")), "the plan") == ["plan"]


def test_versions(spark):
    assert [one(spark, T.next_version(F.col("x")), v) for v in ("1.0.0", "v2.3", "1", "a9b", "none")] == ["1.0.1", "v2.4", "2", "a10b", None]
    assert one(spark, T.version_parts(F.col("x")), "v1.x.3") == [1, 0, 3]


def test_identifier_and_boundary(spark):
    assert one(spark, T.canonical_identifier(F.col("x")), "AB-12_ 3­–4") == "ab1234"
    assert one(spark, T.ends_at_boundary(F.col("x")), "end。 ") is True
    assert one(spark, T.ends_at_boundary(F.col("x")), "no") is False
    assert one(spark, T.strip(F.col("x")), "　 a b \n") == "a b"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [])], "a array<double>, z array<double>, e array<double>")
    r = df.select(V.normalized(F.col("a")).alias("n"), V.normalized(F.col("z")).alias("z"), V.dot(F.col("e"), F.col("e")).alias("e")).first()
    assert r["n"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and r["e"] == 0.0
    with pytest.raises(Exception, match="different lengths"):
        df.select(V.dot(F.col("a"), F.col("e"))).collect()


def test_hash_embedding_is_normal(spark):
    v = one(spark, V.hash_embedding(16)(F.col("x")), "a b b c")
    assert math.isclose(sum(x * x for x in v), 1.0)
    assert one(spark, V.hash_embedding(16)(F.col("x")), "") == [0.0] * 16


def test_rrf_ties_keep_the_primary_order(spark):
    rank = "query_id long, chunk_id long, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], rank)
    b = spark.createDataFrame([(1, 20, 1), (1, 11, 2)], rank)
    got = [(r["chunk_id"], r["rank"]) for r in retrieval.rrf(a, b).orderBy("rank").collect()]
    assert got == [(11, 1), (10, 2), (20, 3)]


def test_diversity_is_greedy(spark):
    random.seed(4)
    words = [" ".join(random.choices("abcdefgh", k=random.randint(0, 5))) for _ in range(40)]
    df = spark.createDataFrame([(1, i, i + 1, w) for i, w in enumerate(words)], "query_id long, chunk_id long, rank int, text string")
    kept, sets = [], []
    for i, w in enumerate(words):
        s = set(w.split())
        if s and any(len(s & o) / len(s | o) >= 0.92 for o in sets):
            continue
        kept.append(i)
        sets.append(s)
    assert sorted(r["chunk_id"] for r in retrieval.diversified(df).collect()) == kept


def test_windows_against_python(spark):
    random.seed(2)
    for n in (0, 1, 9, 10, 11, 18, 19, 35):
        s = "".join(random.choice("ab \n") for _ in range(n))
        out, at = [], 0
        while at < len(s):
            end = at + 10
            if s[at:end].strip():
                out.append(s[at:end].strip())
            at = end - 2 if end < len(s) else end
        got = one(spark, chunking.windows(F.col("x"), 10, 2), s)
        assert [w["text"] for w in got] == out, s


def test_coalescing(spark):
    rows = [(1, 0, "aaaa", "text", 1, None), (1, 1, "bb", "text", 1, None), (1, 2, "T", "table", 1, None), (1, 3, "c", "text", 1, "s"), (1, 4, "d", "text", 2, "s"), (1, 5, "e" * 30, "text", 2, "s")]
    df = spark.createDataFrame(rows, "doc long, block_index int, text string, kind string, page int, section string")
    got = [(r["block_index"], r["text"], r["kind"], r["sources"]) for r in chunking.coalesced(df, "doc", 10).orderBy("block_index").collect()]
    assert got == [(0, "aaaa\n\nbb", "coalesced_text", [0, 1]), (2, "T", "table", [2]), (3, "c", "text", [3]), (4, "d", "text", [4]), (5, "e" * 30, "text", [5])]


def test_scopes(spark):
    p = spark.createDataFrame([("h1", True, None, None, None), ("h2", None, ["u"], None, None), ("h3", None, None, ["g"], None), ("h4", None, None, None, ["r"])], "acl_hash string, allow_all boolean, allow_users array<string>, allow_groups array<string>, allow_roles array<string>")
    assert sorted(r[0] for r in security_scope(p, "u", ["g"], []).collect()) == ["h1", "h2", "h3", "public"]
    t = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    assert (tenants(t, None).count(), tenants(t, []).count(), tenants(t, ["a"]).count()) == (2, 0, 1)
    assert t.where(Filter().condition()).count() == 2


def test_changes_win_in_order(spark):
    prev = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    feed = spark.createDataFrame([("a", 5, "upsert", 9), ("a", 6, "delete", None), ("c", 1, "delete", None), ("c", 2, "upsert", 7)], "k string, n int, kind string, v int")
    assert sorted(map(tuple, snapshot.apply_changes(prev, feed, "k", "n").collect())) == [("b", 2), ("c", 7)]
    assert sorted(map(tuple, snapshot.apply_changes(prev, feed, "k", "n", full_resync=True).collect())) == [("c", 7)]


def test_a_repeated_ingest_writes_nothing(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    a = chunking.chunked(d).withColumn("point_id", F.col("chunk_id"))
    again = snapshot.reused(chunking.chunked(d), a, ["doc_id", "chunk_index", "checksum"], ["point_id"])
    assert again.where("NOT reused").count() == 0 and snapshot.stale(a, again).count() == 0


def test_generations_swap_whole(spark, tmp_path):
    g = snapshot.Generations(spark, f"file://{tmp_path}/src")
    assert g.active() is None
    g.stage(spark.range(3).toDF("x"), "g1")
    g.activate("g1")
    g.stage(spark.range(5).toDF("x"), "g2")
    assert g.read().count() == 3
    with pytest.raises(RuntimeError):
        g.activate("g2", expected=None)
    g.activate("g2", expected="g1")
    assert g.read().count() == 5
    g.rollback()
    assert g.read().count() == 3


def test_cursor():
    c = catalog.encode_cursor("jobs", "2024-01-01", 7)
    assert catalog.decode_cursor("jobs", c) == ("2024-01-01", 7)
    with pytest.raises(ValueError):
        catalog.decode_cursor("sources", c)


def test_percentiles(spark):
    a = F.array(*[F.lit(float(i)) for i in range(1, 12)])
    assert one(spark, quality.percentile_nearest(a, 0.95)) == 11.0
    assert one(spark, quality.percentile_truncated(a, 0.5)) == 6.0
    assert one(spark, quality.percentile_rounded(a, 0.25)) == 3.0


def test_chat_falls_back_to_the_last_turn(spark):
    t = spark.createDataFrame([(1, 0, "system", " be kind "), (1, 1, "assistant", "hello"), (1, 2, "user", "  ")], "conv_id long, turn long, role string, text string")
    r = chat.prepared(t).first()
    assert r["query"] == "" and r["system_prompt"] == "be kind" and [h["content"] for h in r["history"]] == ["hello"]
    assert one(spark, chat.route(F.col("x")), "how to select rows") == "sql"


def test_sql_tool_lets_only_selects_through(spark):
    tool = SqlTool(spark, {"t": spark.range(1000).toDF("x")}, 50)
    assert tool.run("SELECT x FROM t WHERE x > 10").count() == 50
    free = SqlTool(spark, {"t": spark.range(1000).toDF("x")}, 50, with_clauses=True)
    assert free.run("WITH a AS (SELECT 'drop comment' AS c FROM t), b AS (SELECT * FROM a) SELECT * FROM b;", 5).count() == 5
    for good in ("SELECT 'drop it; now' AS c FROM t -- delete; this", "/* update */ SELECT `x` AS `drop` FROM t WHERE x IN (SELECT max(x) FROM t)", 'SELECT "a;b" AS c, sum(x) OVER (ORDER BY x) AS s FROM t', "SELECT CASE WHEN x LIKE '1%' THEN x END AS c, x::string AS d FROM t LATERAL VIEW explode(array(1, 2)) e AS y"):
        assert tool.run(good).count() > 0
    wide = ", ".join(["x"] * 40)
    for bad in (
        f"SELECT {wide}, reflect('java.lang.System', 'getProperty', 'user.home') FROM t", f"SELECT x FROM t WHERE x IN ({wide}, reflect('java.lang.System', 'getProperty', 'user.home'))", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM t",
        "SELECT * FROM IDENTIFIER('pa' || 'rquet.`/root/testdata/sf0.001/region.parquet`')", "SELECT try_reflect('java.lang.System', 'exit', 0)", "SELECT input_file_name() FROM t", "SELECT * FROM range(5)", "SELECT * FROM explode(array(1))",
        "SELECT (SELECT java_method('java.lang.System', 'nanoTime'))", "SELECT x FROM t ORDER BY reflect('java.lang.System', 'nanoTime')", "SELECT x FROM t WHERE EXISTS (SELECT 1 FROM u)", "SELECT * FROM t JOIN LATERAL (SELECT reflect('a', 'b')) l", "SELECT transform(array(1), i -> reflect('a', 'b')) FROM t",
        "SELECT sum(x) FILTER (WHERE reflect('a', 'b') = 'c') FROM t", "WITH a AS (SELECT 1) SELECT * FROM a", "TABLE t", "VALUES (1)", "SELECT * FROM VALUES (reflect('a', 'b'))", "SELECT TRANSFORM(x) USING 'cat' FROM t", "SELECT x FROM t LATERAL VIEW reflect('a', 'b') e", "SELECT x FROM default.t", "SELECT * FROM text.`/etc/passwd`",
    ):
        with pytest.raises(NotAllowed):
            tool.run(bad)
    for bad in ("DROP TABLE t", "SELECT * FROM u", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "SELECT * FROM parquet.`/etc`", "CREATE VIEW v AS SELECT 1", "SELECT reflect('java.lang.System', 'exit', 0)"):
        with pytest.raises(NotAllowed):
            tool.run(bad)
    assert tool.columns().count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\nbody")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.txt").write_text("no")
    (tmp_path / "b.bin").write_bytes(b"x")
    r = files.text_documents(spark, f"file://{tmp_path}", "d").collect()
    assert [(x["doc_id"], x["section"]) for x in r] == [("d:a.md", "Head")]
    kinds = {"https://drive.google.com/drive/folders/x": "gdrive", "https://drive.google.com/x": "web", "s3://b/k": "s3", "https://a.org/f.pdf": "pdf", "https://github.com/a/b": "repo", "https://a.org": "web", "/tmp/x": "local_fs"}
    assert {k: one(spark, files.source_type(F.col("x")), k) for k in kinds} == kinds
    assert one(spark, files.canonical(F.col("x")), "HTTPS://A.org/B/#c") == "https://a.org/B"
    for bad in ("http://127.0.0.1/x", "ftp://a.org", "http://u:p@a.org", "http://localhost"):
        with pytest.raises(ValueError):
            files.check_remote(bad)
    assert files.check_remote("https://a.org/x", ("a.org",))


def test_html_blocks():
    got = html.parse("<nav><p>no</p></nav><h1>T</h1><ul><li><p>in &amp; out</p></li></ul><pre>x  y</pre><script>no</script><table><tr><td>c</td></tr></table>")
    assert [(k, t, s) for _, k, t, s in got] == [("heading", "T", "T"), ("list_item", "in & out", "T"), ("text", "in & out", "T"), ("code", "x y", "T"), ("table", "c", "T")]


def test_change_feed_batch_and_stream(spark, tmp_path):
    from larkspire.sources.feed import ChangeFeed

    spark.dataSource.register(ChangeFeed)
    config = json.dumps({"changes": [["upsert", "a", "1", "{}"], ["delete", "b", "2", "{}"], ["upsert", "c", "3", "{}"]]})
    options = {"connector": "larkspire.sources.feed:ListConnector", "config": config, "rows": "2"}
    assert spark.read.format("change_feed").options(**options).load().count() == 3
    split = options | {"config": json.dumps({"splits": {"x": [["upsert", "a", "1", "{}"]] * 5, "y": [["delete", "b", None, None]], "z": []}})}
    rows = spark.read.format("change_feed").options(**split).load()
    assert rows.rdd.getNumPartitions() == 4 and sorted((r["split"], r["position"]) for r in rows.collect()) == [("x", i) for i in range(5)] + [("y", 0)]
    q = spark.readStream.format("change_feed").options(**options).load().writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert sorted(r["external_id"] for r in spark.table("feed").collect()) == ["a", "b", "c"]
    finally:
        q.stop()


def test_stream_equals_batch(spark, sf, tmp_path):
    from larkspire.streaming import windows

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    s = windows.events_stream(spark, f"{tmp_path}/in", e.schema)
    q = windows.tumbling(s, watermark="1 day").writeStream.format("memory").queryName("tumble").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("tumble").collect())) == sorted(map(tuple, windows.tumbling(e).collect()))
    finally:
        q.stop()


def test_queue_state_stream(spark, tmp_path):
    from larkspire.streaming import windows

    spark.createDataFrame([(1, 0, "enqueue"), (1, 1, "claim"), (1, 2, "done"), (2, 0, "enqueue"), (2, 1, "claim"), (2, 2, "fail")], "job_id long, at long, event string").write.parquet(f"{tmp_path}/q")
    s = spark.readStream.schema("job_id long, at long, event string").parquet(f"{tmp_path}/q")
    q = windows.queue_state(s).writeStream.format("memory").queryName("jobs_now").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("jobs_now").collect())) == [(1, "completed", 1), (2, "pending", 1)]
    finally:
        q.stop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    p = plan(catalog.page(o, "o_orderdate", "o_orderkey", 20).select("o_orderkey"))
    assert "TakeOrderedAndProject" in p and "o_totalprice" not in p.split("ReadSchema")[-1]
    q = spark.createDataFrame([(1, "the plan")], "query_id long, query string")
    lex = plan(retrieval.lexical(q, spark.createDataFrame([(1, "plan")], "chunk_id long, text string"), 3))
    assert "CartesianProduct" not in lex and "WindowGroupLimit" in lex
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(o.where("o_orderstatus = 'F'"))


def test_code(spark):
    from larkspire.operators import code

    py = "import os\n\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    assert [(s, a, b) for s, a, b, _ in code.symbols(py, "python")] == [("<imports>", 1, 2), ("A", 3, 5), ("f", 4, 5), ("g", 7, 8)]
    assert [(s, a, b) for s, a, b, _ in code.symbols("// x\nfunc A() {\n}\nfunc (r *R) B() {\n}\n", "go")] == [("<imports>", 1, 1), ("A", 2, 3), ("B", 4, 5)]
    assert [x[0] for x in code.symbols("def big():\n" + "    x = 1\n" * 20, "python", 60)] == ["big (part 1)", "big (part 2)", "big (part 3)", "big (part 4)"]
    assert code.symbols("def (", "python") == [(None, 1, 1, "def (")] and code.symbols("", "text") == []
    f = spark.createDataFrame([("a.py", "python", "one\nTwo\nthree\nfour")], "path string, language string, text string")
    assert code.chunked(f).count() == 1
    assert tuple(code.search(f, "two", context=1).first()) == ("a.py", 2, 1, 3, "one\nTwo\nthree")
    trace = 'File "a.py", line 2, in main\n at run (b.js:3:4)\nx.go:7 (C.java:9)\nValueError: x'
    got = spark.createDataFrame([(1, trace), (2, "see z.c:5")], "error_id int, text string")
    assert [[tuple(x) for x in r[0]] for r in got.select(code.locations(F.col("text"))).collect()] == [[("a.py", 2), ("b.js", 3), ("x.go", 7), ("C.java", 9)], [("z.c", 5)]]
    assert code.explained(got, f, 1).first()["snippet"] == "one\nTwo\nthree"
    assert [tuple(one(spark, code.reference(F.col("x")), q)) for q in ("see a/b.py:10-20", "a.py:3", "a.py", "none")] == [("a/b.py", 10, 20), ("a.py", 3, 23), ("a.py", None, None), ("none", None, None)]
    assert one(spark, code.patch()(F.lit("a\n"), F.lit("b\n"))).splitlines()[-2:] == ["-a", "+b"]
    assert one(spark, code.glob(F.col("x"), "src/**/*.py"), "src/a/b.py") and not one(spark, code.glob(F.col("x"), "src/*.py"), "src/a/b.py")


def test_evidence(spark):
    from larkspire.operators import evidence

    items = [(1, 0, 0.5, "a" * 50), (1, 1, 0.9, "b" * 200), (1, 2, 0.7, "c" * 90), (1, 3, 0.1, "d" * 5)]
    df = spark.createDataFrame(items, "request_id int, position int, score double, text string")
    kept = {r["position"]: len(r["text"]) for r in evidence.compressed(df, 130, 100).collect()}
    assert kept == {1: 100 + len(evidence.TRUNCATED), 3: 5}
    lacks = evidence.missing(F.lit("sql"), F.array(F.lit("sql_rows")), F.lit(0))
    assert one(spark, lacks) == "sql_rows" and one(spark, evidence.next_action(lacks)) == "sql_query" and one(spark, evidence.confidence(F.lit(True), F.lit(False), lacks)) == "low"
