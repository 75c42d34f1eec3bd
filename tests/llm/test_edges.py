"""What the opN_ queries return, against brute force; awkward rows through the pipeline and the operators."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspire.llm import common, fasttok, fingerprint, knn, langid, pii, queries, subword, warc
from tests.llm.test_llm import ROWS, SCHEMA, check_packed, plain_spans


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with what the operators add."""
    rows = [(*r, len(r[1] or ""), 1, "x", 2, 3) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", n_chars long, score int, rejected string, n long, node long")


def test_pii_digest_against_patterns(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    extra = {10**9: "mail a@b.co and 4111 1111 1111 1111, +1 (555) 010-9999 from 10.0.0.1", 10**9 + 1: None, 10**9 + 2: "ssn 123-45-6789 é a@b.co"}
    df = spark.createDataFrame([*texts.items(), *extra.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    with_data = 0
    for d, t in {**texts, **extra}.items():
        base, r = plain_spans(t or ""), got[d]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}
        with_data += bool(base)
    assert with_data > 3


def test_language_digest_columns(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-5, "½ ² Ⅷ 12", "en"), (-6, None, "en"), (-7, "漢字", None), (-8, "ª", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.digest(d.select("doc_id", "text", "lang").unionByName(more)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values()) and {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "es", "und"}
    assert got[-5]["lang_pred"] == got[-6]["lang_pred"] == "und" and got[-5]["score"] == 0.0
    assert got[-7]["lang_pred"] != "und" and got[-8]["lang_pred"] != "und"


def test_language_learns_from_its_rows_alone(spark, sf):
    """Neither the label nor the text of a held-out row, nor any source, changes a prediction."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.digest(d).collect()}
    changed = d.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.digest(changed).collect()} == want


def test_short_labelled_rows_make_a_language(spark):
    rows = spark.createDataFrame([("ja", "ab"), ("en", "the words of the text and the rest of it"), ("no", "12")], "lang string, text string")
    assert set(langid.fit(rows)) == {"ja", "en", "no"} and all(len(x) >= 8 for x in langid.fit(rows).values())


def test_fingerprints_of_real_rows(spark, sf):
    """near_edited and near_next are the likenesses of fingerprints that are made one by one, and follow the generalised Jaccard similarity."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    order = sorted(texts, reverse=True)
    s, off = fingerprint.Sampler(), []
    for r in fingerprint.digest(d).collect():
        nxt = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        a, b, c = s.text(texts[r["doc_id"]]), s.text(fingerprint.edited(texts[r["doc_id"]], nxt)), s.text(nxt)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.hexed(a), fingerprint.hexed(b))
        assert r["near_edited"] == fingerprint.likeness(a, b) and r["near_next"] == fingerprint.likeness(a, c)
        x, y = (collections.Counter(fingerprint._WORD.findall(t.lower())) for t in (texts[r["doc_id"]], fingerprint.edited(texts[r["doc_id"]], nxt)))
        off.append(r["near_edited"] - sum((x & y).values()) / max(1, sum((x | y).values())))
    assert abs(float(np.mean(off))) < 0.02


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (2, [0.25, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, codes string, rank int")
    got = [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in knn.digest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 64)]


def test_neighbours_in_slices(spark, monkeypatch):
    monkeypatch.setattr(knn, "SLICE", 7)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(160, 6)), 1)
    got = collections.defaultdict(list)
    for r in knn.digest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(256 * x).astype(int)
    assert got == {i: sorted(((j, int(q[i] @ q[j])) for j in range(160) if j != i), key=lambda t: (-t[1], t[0]))[:5] for i in range(0, 160, 50)}


def test_archives_of_rows_without_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    body = "y" * 200
    rows = spark.createDataFrame([(None, "u", body), (None, "u", body), (2, "u", body), (2, "u", body), (3, "v", body)], "page_id long, url string, html string")
    manifest = warc.write(rows, f"file://{tmp_path}")
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(spark, manifest).collect())
    assert got == {(None, "response", None): 2, (2, "response", None): 2, (3, "revisit", 2): 1}
    ids = []
    for m in manifest:
        with open(m["path"].removeprefix("file://"), "rb") as f:
            ids += [warc.parse(raw)[0]["WARC-Record-ID"] for raw in warc.members(f)]
    assert len(ids) == len(set(ids)) == 5 + len(manifest)


def test_segmentations_are_returned_whole(spark, docs):
    vocab = fasttok.vocabulary("piece_bpe_32k.model")
    m = subword.model(vocab)
    plain = {(r["doc_id"], r["sample"], r["perturbed"]): r for r in subword.samples(docs, vocab).collect()}
    packed = {(r["doc_id"], r["sample"], r["perturbed"]): r for r in subword.samples(docs, vocab, packed=True).collect()}
    assert set(plain) == set(packed) and plain
    texts = collections.defaultdict(set)
    for d, t, *_ in ROWS:
        texts[d].add((t or ""))
    for k, r in packed.items():
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert ids.tolist() == plain[k]["ids"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["decodes"]
        assert m.decode(ids.tolist()) in {t.replace("\N{LOWER ONE EIGHTH BLOCK}", " ") for t in texts[r["doc_id"]]}


def test_samples_beyond_eight_differ(spark):
    df = spark.createDataFrame([(1, "a text that has many segmentations of its words")], "doc_id long, text string")
    rows = subword.samples(df, fasttok.vocabulary("piece_bpe_32k.model"), 12).collect()
    assert len({tuple(r["ids"]) for r in rows}) == 12 and all(r["decodes"] for r in rows)


def test_pipeline_of_awkward_rows(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "1 AS score", "'x' AS rejected", "2L AS n", "3L AS node")
    now, sizes = docs.unionByName(labelled), []
    for name, stage in corpus_pipeline.STAGES:
        new = common.stored(stage(spark, now, sf), name)
        if name != "best_fit_packing":
            assert new.columns == docs.columns
            sizes.append(new.count())
            now = new
    left = [r for r in now.collect() if (r["doc_id"] or 0) < 1000]
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in left)
    assert collections.Counter(r["doc_id"] for r in left)[1] <= 1 and sizes == sorted(sizes, reverse=True)
    assert check_packed(new.collect(), 4096) > 0
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


@pytest.mark.parametrize(("kind", "name"), [(fasttok.ByteBpe, "byte_bpe_50k.json"), (fasttok.WordBpe, "word_bpe_49k.json")])
def test_special_tokens_as_the_library_reads_them(kind, name):
    from tokenizers import Tokenizer

    enc, plain = fasttok.encoder(kind, fasttok.vocabulary(name)), Tokenizer.from_file(fasttok.vocabulary(name))
    for t in ("a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|>y", "a < b | c", "plain Words, and 12 more."):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_every_query_is_registered():
    assert [int(math.floor(float(n[2:].split("_")[0]))) for n in queries.queries()] == list(range(1, 14))


def test_tables_are_deleted_when_spent(spark):
    a = common.stored(spark.range(3), "a")
    path = a.stored_at.removeprefix("file://")
    import os

    assert os.path.isdir(path)
    b = common.stored(a.select("id"), "b", (a,))
    assert not os.path.isdir(path) and b.count() == 3


def test_workers_keep_one_operators_tables():
    freed = []
    common._kept.clear()
    common.keeps("a", lambda: freed.append("a"))
    assert list(common.in_worker(lambda b: iter([1]), "a")([])) == [1] and not freed
    assert list(common.in_worker(lambda b: iter([2]), "b")([])) == [2] and freed == ["a"] and not common._kept


def test_known_words_are_looked_up_without_python(monkeypatch):
    from larkspire.llm import fasttok

    m = fasttok.ByteBpe(fasttok.vocabulary("byte_bpe_50k.json"))
    text = "It's one word, (two) 12 345 a1b2 étés “trois” x\ty don't ' over-straße word"
    assert m.ids(text) == m.slow(text)
    monkeypatch.setattr(fasttok._After, "__missing__", lambda self, c: 1 / 0)
    assert m.ids(text) == m.slow(text)
    monkeypatch.undo()
    monkeypatch.setattr(fasttok, "WORDS", len(m.after) + len(m.words) + 2)  # full: right without the cache, and no larger
    more = " ".join(f"q{i}x r{i}" for i in range(50)) + " zzyzx qwrtp"
    assert m.ids(more) == m.slow(more) and len(m.after) + len(m.words) <= fasttok.WORDS


def test_many_texts_get_the_librarys_ids_and_each_word_is_encoded_once(monkeypatch):
    import random

    import pyarrow as pa

    from larkspire.llm import fasttok

    m = fasttok.ByteBpe(fasttok.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(5)
    bits = ["word", "étés", "straße", "it's", "'ll", "'", "''", ",", ".", "\n", "\n\n", "\t", "\r", " ", " ", " ", "  ", "12", "3", "_", "__init__", "%%%", "×", "“", "<", "<|endoftext|>", "ª", "½", "漢字", "\x85", "\xa0", "\x00", "Don't", "x" * 60]
    texts = [None, "", " ", "\n", "word ", "a.\nB, c.\n\nD", "x\n", *("".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(3000))]
    for some in (pa.array(texts), pa.array(texts)[2:9], pa.array([None, ""]), pa.array([], pa.string())):
        assert [x.tolist() for x in m.all_ids(some)] == [np.frombuffer(m.slow(t or ""), "<u4").tolist() for t in some.to_pylist()]
    made, piece = [], m.piece
    monkeypatch.setattr(m, "piece", lambda w: made.append(w) or piece(w))
    monkeypatch.setattr(fasttok, "WORDS", 0)  # a full cache
    some = [f"{i}x zzyzxq qwrtpq zzyzxq" for i in range(100)]
    assert [x.tobytes() for x in m.all_ids(pa.array(some))] == [m.slow(t) for t in some]
    assert made.count(" zzyzxq") == 1 and made.count(" qwrtpq") == 1


def test_the_drivers_tokenizer_does_not_go_along_with_tasks(spark, monkeypatch):
    from pyspark import cloudpickle

    from larkspire.llm import tokenfile

    sent, mapped = [], tokenfile.mapped_arrow
    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(tokenfile, "mapped_arrow", lambda df, run, schema, owner: sent.append(len(cloudpickle.dumps(common.in_worker(run, owner)))) or mapped(df, run, schema, owner))
    assert tokenfile.digest(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), fasttok.vocabulary("byte_bpe_50k.json")).count() == 1
    assert len(sent) == 2 and max(sent) < 1 << 17
