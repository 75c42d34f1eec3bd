"""The inverted index and the corpus against plain scans."""

import random

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from larkspire.functions import vector as V
from larkspire.operators import chunking, lexindex, retrieval
from larkspire.operators.corpus import Corpus, EmbeddingCache
from larkspire.operators.log import Conflict
from larkspire.plans import more
from larkspire.plans.catalogue import now_col


def ranks(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(40_000)]
    rows, at = [], 0
    for i in range(900):
        n = r.choice([1, 3, 10, 40, 120])
        rows.append((i, " ".join(words[at : at + n]) if i % 50 else None))
        at = (at + n) % 39_000
    return spark.createDataFrame([*rows, (901, "深度学习 模型"), (902, "the of and"), (903, "")], "chunk_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(4)
    q = [(i, " ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(r.choice([1, 2, 5, 9])))) for i in range(60)]
    return spark.createDataFrame([*q, (60, ""), (61, None), (62, "学习"), (63, "the"), (64, "w1 w1 w2"), (65, "nowhere")], "query_id long, query string")


@pytest.mark.parametrize("shard", [7, 64, 5000])
def test_index_gives_what_a_scan_gives(spark, tmp_path, texts, asked, shard):
    ix = lexindex.LexicalIndex(spark, f"file://{tmp_path}", shard, 4)
    ix.build(texts)
    for k in (1, 5, 40):
        assert ranks(ix.search(asked, k)) == ranks(retrieval.lexical(asked, texts, k))
    assert ranks(ix.search(asked, 5, every=True)) == ranks(retrieval.lexical_and(asked, texts, 5))
    assert ranks(ix.search(asked, 5, idf=True)) == ranks(retrieval.sparse(asked, texts, 5))


def test_hits_say_what_they_match(spark, tmp_path, texts, asked):
    ix = lexindex.LexicalIndex(spark, f"file://{tmp_path}", 64, 4)
    ix.build(texts)
    hits = ix.search(asked, 10)
    a = sorted(map(tuple, retrieval.matched_confidence(asked, hits).collect()))
    b = sorted(map(tuple, retrieval.confidence(asked, hits.drop("matched", "cjk"), texts).collect()))
    assert a == b and any(x[1] for x in a)


def test_updates_and_merges(spark, tmp_path, texts, asked):
    ix = lexindex.LexicalIndex(spark, f"file://{tmp_path}", 64, 4)
    ix.build(texts.where("chunk_id % 3 = 0"))
    state = texts.where("chunk_id % 3 = 0")
    for i in (1, 2):
        new = texts.where(f"chunk_id % 3 = {i} OR chunk_id % 20 = {i}").withColumn("text", F.concat(F.lit(f"w{i} "), "text"))
        stale = state.where(f"chunk_id % 11 = {i}")
        ix.update(new, stale)
        state = spark.createDataFrame(state.join(new, "chunk_id", "left_anti").join(stale.select("chunk_id"), "chunk_id", "left_anti").unionByName(new).collect(), texts.schema)
        assert sorted(r[0] for r in ix.ids().collect()) == sorted(r[0] for r in state.collect())
        assert ranks(ix.search(asked, 7)) == ranks(retrieval.lexical(asked, state, 7))
        assert ranks(ix.search(asked, 7, idf=True)) == ranks(retrieval.sparse(asked, state, 7))
    assert len(ix.log.state()[1]["segments"]) == 3
    ix.merge()
    assert len(ix.log.state()[1]["segments"]) == 1
    assert ranks(ix.search(asked, 7)) == ranks(retrieval.lexical(asked, state, 7)) and ranks(ix.search(asked, 7, idf=True)) == ranks(retrieval.sparse(asked, state, 7))


def test_a_batch_reads_the_folders_of_its_words(spark, tmp_path, texts):
    ix = lexindex.LexicalIndex(spark, f"file://{tmp_path}", 64, 16)
    ix.build(texts)
    plan = ix.search(spark.createDataFrame([(1, "w1")], "query_id long, query string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert any("folder" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])


def test_a_stored_index_follows_its_files(spark, tmp_path, texts):
    texts.write.parquet(f"file://{tmp_path}/t")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/t")
    a = lexindex.stored_index(read(), f"file://{tmp_path}/x")
    assert lexindex.stored_index(read(), f"file://{tmp_path}/x").root == a.root and a.log.version() == 1
    texts.limit(3).write.mode("append").parquet(f"file://{tmp_path}/t")
    assert lexindex.stored_index(read(), f"file://{tmp_path}/x").root != a.root


def test_a_second_run_embeds_nothing(spark, tmp_path, texts):
    cache, embed = EmbeddingCache(spark, f"file://{tmp_path}"), V.hash_embedding(8)
    first = cache.vectors(texts, embed, "hash-8", now_col())
    n = cache.embedded.value
    want = {r["chunk_id"]: r["vector"] for r in texts.select("chunk_id", embed(F.coalesce("text", F.lit(""))).alias("vector")).collect()}
    assert n == texts.select(F.coalesce("text", F.lit(""))).distinct().count() and {r["chunk_id"]: r["vector"] for r in first.collect()} == want
    again = EmbeddingCache(spark, f"file://{tmp_path}")
    assert {r["chunk_id"]: r["vector"] for r in again.vectors(texts, embed, "hash-8", now_col()).collect()} == want and again.embedded.value == 0
    again.vectors(texts.limit(4), embed, "other", now_col())
    assert again.embedded.value > 0


def test_ingestion_from_end_to_end(spark, sf, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}")
    none, docs = (x.limit(0) for x in more._previous(spark, sf))
    c = more._candidate(spark, sf).where("doc_id < 60")
    embed = V.hash_embedding(8)
    corpus.run(c.where("doc_id < 40"), more.SOURCE, "g1", now_col(), none, docs, embed, "hash-8")
    n = corpus.cache.embedded.value
    out = corpus.run(c.where("doc_id >= 10"), more.SOURCE, "g2", now_col(), none, docs, embed, "hash-8")
    assert out.written.count() == c.where("doc_id >= 40").count() and corpus.cache.embedded.value - n <= out.written.count()
    rows = corpus.generations.read()
    assert sorted(r[0] for r in corpus.index.ids().collect()) == sorted(r[0] for r in rows.select("chunk_id").collect())
    assert corpus.index.points().count() == rows.count()
    q = spark.createDataFrame([(1, rows.where("doc_id = 45").first()["text"])], "query_id long, query string")
    assert corpus.search(q, 1).count() == 1
    # A run that was overtaken changes nothing; a crash between activation and index is put right by repair().
    stage = corpus.generations.stage

    def overtaken(r, g):
        n = stage(r, g)
        other = Corpus(spark, f"file://{tmp_path}").generations
        other.stage(r.limit(1), "g9")
        other.activate("g9", "g2")
        return n

    corpus.generations.stage = overtaken
    with pytest.raises(Conflict):
        corpus.run(c, more.SOURCE, "g3", now_col(), none, docs)
    assert corpus.generations.active() == "g9" and corpus.index.log.state()[1]["note"] == "g2"
    corpus.repair()
    assert corpus.index.ids().count() == 1 and corpus.index.log.state()[1]["note"] == "g9"


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_word_is_shuffled_as_a_row(spark, tmp_path, texts):
    """Building shuffles texts and blocks, merging shards and blocks: not a row for each word of each chunk."""
    ix = lexindex.LexicalIndex(spark, f"file://{tmp_path}", 300, 4)
    before = shuffled(spark)
    ix.build(texts)
    after = shuffled(spark)
    s = ix.log.state()[1]["segments"][0]
    blocks, postings = ix._blocks(s).agg(F.count("*"), F.sum("n")).first()
    assert postings > 2 * (blocks + texts.count())
    assert after - before <= texts.count() + blocks + 20
    ix.merge()
    assert shuffled(spark) - after <= 2 * (blocks + texts.count()) + 20


@pytest.mark.parametrize("buffer", [50, 1000])
def test_a_task_writes_shards_a_buffer_at_a_time(spark, tmp_path, texts, asked, buffer, monkeypatch):
    monkeypatch.setattr(lexindex, "BUFFER", buffer)
    monkeypatch.setattr(lexindex, "ROWS", 17)
    monkeypatch.setattr(TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    rows = texts.collect()
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows], schema=pa.schema([("chunk_id", pa.int64()), ("text", pa.string())]))
    out = pa.Table.from_batches(lexindex._Writer(64, "bigint").texts(iter([batch]))).to_pylist()
    shards = {r["shard"]: r for r in out if r["term"] is None}
    assert sorted(i for s in shards.values() for i in s["ids"]) == sorted(r["chunk_id"] for r in rows) and all(s >> 32 == 3 for s in shards)
    assert len([r for r in out if r["term"] is None]) == len(shards) and all(len(s["ids"]) <= 64 for s in shards.values())
    found = {(shards[r["shard"]]["ids"][p], r["term"]): n for r in out if r["term"] is not None for p, n in zip(r["places"], r["counts"], strict=True)}
    assert found == {(r["chunk_id"], w): n for r in rows for w, n in retrieval.counted_terms(r["text"] or "")[0].items()}
    assert all(r["places"] == sorted(r["places"]) for r in out if r["term"] is not None)
    lines = [{"segment": 0, "shard": s, "kind": 0, "term": None, "places": None, "counts": r["lengths"], "ids": r["ids"], "cjk": r["cjk"]} for s, r in shards.items()]
    lines += [{"segment": 0, "shard": s, "kind": 1, "places": [0]} for s in shards]
    lines += [{"segment": 0, "shard": r["shard"], "kind": 2, "term": r["term"], "places": r["places"], "counts": r["counts"]} for r in out if r["term"] is not None]
    lines.sort(key=lambda x: (x["shard"], x["kind"]))
    kinds = pa.schema([("segment", pa.int32()), ("shard", pa.int64()), ("kind", pa.int32()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("cjk", pa.list_(pa.bool_()))])
    stored = [pa.RecordBatch.from_pylist(lines[i : i + 7], schema=kinds) for i in range(0, len(lines), 7)]
    again = pa.Table.from_batches(lexindex._Writer(64, "bigint").stored(iter(stored))).to_pylist()
    dead = {r["ids"][0] for r in shards.values()}
    shards = {r["shard"]: r for r in again if r["term"] is None}
    assert {(shards[r["shard"]]["ids"][p], r["term"]): n for r in again if r["term"] is not None for p, n in zip(r["places"], r["counts"], strict=True)} == {k: n for k, n in found.items() if k[0] not in dead}
    assert sorted(i for s in shards.values() for i in s["ids"]) == sorted(r["chunk_id"] for r in rows if r["chunk_id"] not in dead)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_an_ingestion_shuffles_each_text_once(spark, tmp_path):
    """Dedup, reuse, versions and the index: texts that don't compress go through one shuffle, of the second run's index only new ones."""
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 40), i -> sha2(concat(id, '-', i), 256)))").alias("text"))
    c = chunking.chunked(rows.withColumns({"path": F.lit("p"), "url": F.lit(None).cast("string")})).drop("chunk_id", "start")
    size = c.agg(F.sum(F.length("text"))).first()[0]
    none, docs = c.limit(0).withColumns({"chunk_id": F.lit(""), "point_id": F.lit(""), "created_at": now_col()}), spark.createDataFrame([], "doc_id long, version string")
    corpus, before = Corpus(spark, f"file://{tmp_path}"), shuffled_bytes(spark)
    corpus.run(c.where("doc_id % 5 <> 0"), more.SOURCE, "g1", now_col(), none, docs)
    first = shuffled_bytes(spark) - before
    corpus.run(c, more.SOURCE, "g2", now_col(), none, docs)
    second = shuffled_bytes(spark) - before - first
    assert first < 1.3 * 0.8 * size and second < 2 * size
    got = {r["doc_id"]: r["document_version"] for r in corpus.generations.read().select("doc_id", "document_version").distinct().collect()}
    assert got == {i: "1.1" if i % 5 else "1.0" for i in range(400)}
    assert corpus.index.ids().count() == corpus.generations.read().count() == c.count()


def test_a_generation_of_the_same_name_is_indexed_anew(spark, sf, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}")
    none, docs = (x.limit(0) for x in more._previous(spark, sf))
    c = more._candidate(spark, sf)
    for part in ("doc_id < 20", "doc_id >= 10 AND doc_id < 30"):
        corpus.run(c.where(part), more.SOURCE, "g1", now_col(), none, docs)
        assert sorted(r[0] for r in corpus.index.ids().collect()) == sorted(r[0] for r in corpus.generations.read().select("chunk_id").collect())
