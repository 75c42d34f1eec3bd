"""Fill-in-middle, importance resampling and the quality classifier: brute force, awkward rows, skew."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from larkspire.llm import extract, fasttok, fim, fingerprint, importance, quality, queries, tokenfile, warc

AWKWARD = [
    (1, "a quick text of some words"), (2, None), (3, ""), (4, "holds <S> a marker"), (5, "<"), (6, "é漢字𝄞 ab\u0000c"), (7, " \n\t "), (8, "x" * 300_000),
    (9, "word " * 40_000), (10, "same text twice"), (10, "same text twice"), (None, "no id"), (None, "no id"), (None, None), (11, "cut <P"), (12, "A b. C, d! E"),
]
SCHEMA = "doc_id long, text string, n int, score string, rank int, `output` string, part int, `a.b` int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in AWKWARD], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_fim(key, text):
    """By the contract, on Python strings."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (len(text), "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return (len(text), "spm" if spm else "psm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fim_against_strings(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, awkward):
        got = collections.Counter(tuple(r) for r in fim.digest(df).collect())
        assert got == collections.Counter((r["doc_id"], *plain_fim(r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())
    assert {r["form"] for r in fim.digest(docs).collect()} == {"plain", "psm", "spm"}


def test_fim_keeps_extra_columns_and_replaces_its_own(spark, awkward):
    out = fim.transformed(awkward)
    assert out.columns == ["doc_id", "text", "score", "rank", "part", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.transformed(awkward.limit(0)).count() == 0 and fim.digest(awkward.limit(0)).count() == 0
    back = fim.restored(out).collect()
    assert all(r["restored"] == (r["text"] or "") and r["rank"] == 2 for r in back)


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_fim_cuts_at_boundaries_of_a_unit(unit):
    text = "one two\tthree\n\nfour  é𝄞 five\nlast"
    places = {"character": set(range(len(text) + 1)), "word": {m.start() for m in re.finditer(r"\s+|\S+", text)} | {len(text)}, "line": {0, len(text)} | {i + 1 for i, c in enumerate(text) if c == "\n"}}[unit]
    assert set(fim.boundaries(fim.points(text), unit).tolist()) == places
    seen = set()
    for i in range(200):
        n, form, a, m, output = fim.transform(text, (i * 7919, i * 104729 + 3, 0, i), unit)
        assert fim.restore(output, form) == text and n == len(text) and {a, a + m} <= places
        seen |= {a, a + m}
    assert len(seen) == len(places)


def test_fim_restores_whatever_surrounds_the_markers():
    for text in ("<", ">", "P>", "<S", "<M", "S>M>", "<<P", "<P<S<M"):
        for i in range(400):
            _, form, _, _, output = fim.transform(text, (i, i // 7, 0, i % 100))
            assert fim.restore(output, form) == text


def grams(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)], len(w)


def plain_importance(docs, target, order=1, buckets=10_000, share=10, least=20):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(b(f) for _, t in docs for f in grams(t, order)[0])
    t = collections.Counter(b(f) for x in target for f in grams(x, order)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in s}
    rows = []
    for key, text in docs:
        f, n = grams(text, order)
        weight = sum(gain[b(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: share * len(able) // 100])}
    return collections.Counter((*r[:4], drawn.get(id(r))) for r in rows)


@pytest.mark.parametrize("order", [1, 3])
def test_importance_against_counting(spark, sf, awkward, order):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(900, "one two three " * 9)] * 30 + [(None, "no key but words " * 8)] * 20 + AWKWARD
    target = [r["text"] for r in bench.collect()] + [None, ""]
    df, t = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x, 1) for x in target], "text string, pos int")
    got = collections.Counter(tuple(r) for r in importance.resampled(df, t, order=order, share=30).collect())
    assert got == plain_importance(rows, target, order, share=30)


def test_importance_of_empty_tables(spark, awkward):
    none = spark.createDataFrame([], "text string")
    assert importance.digest(awkward.limit(0), none).count() == 0
    got = collections.Counter(tuple(r) for r in importance.resampled(awkward, none, share=50, least_words=1).collect())
    assert got == plain_importance(AWKWARD, [], share=50, least=1)


def test_importance_shuffles_no_word_for_single_words(spark, sf):
    rows = importance.keyed(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    plan = importance.features(rows)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Window" in importance.features(rows, 2)._jdf.queryExecution().toString()


def test_sql_of_the_new_queries(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for name in ("op11_fim", "op12_importance"):
        rel = db.sql(queries.oracle_sql()[name])
        got = queries.queries()[name](spark, sf).select(*rel.columns).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(rel.fetchall())


def plain_features(word):
    s = f"<{word}>"
    return [s[i : i + n] for n in quality.GRAMS for i in range(len(s) - n + 1)]


def test_features_of_words():
    words = ["a", "the", "é漢𝄞", "x" * 50, "the"]
    ids, owner = quality.grams(words)
    assert np.bincount(owner).tolist() == [1 + len(plain_features(w)) for w in words]
    of = lambda w: sorted(quality.grams([w])[0].tolist())
    for i, w in enumerate(words):
        assert sorted(ids[owner == i].tolist()) == of(w)
    assert set(of("abcd")) & set(of("zabcz")) and not set(of("abcd")) & set(of("zzyy"))


def test_scores_are_those_of_averaged_vectors():
    """Word by word outputs give the softmax of the document's averaged vector, in whatever batch a text stands."""
    r = np.random.default_rng(1)
    vectors, out, bias = r.normal(size=(quality.BUCKETS + 2, 8)), r.normal(size=(8, 2)), r.normal(size=2)
    texts = ["one two two three", "x", "", None, "a a a", "one " * 500 + "tail", "é 漢字 𝄞𝄞"]
    m = quality.Model(vectors @ out, bias)
    got = m.scores(texts)
    for t, s in zip(texts, got, strict=True):
        ids, weights = quality.bag(t or "")
        z = (weights @ vectors[ids] if len(ids) else np.zeros(8)) @ out + bias
        assert s == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-5)
    assert [quality.Model(vectors @ out, bias).scores([t])[0] for t in texts] == got.tolist()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op13_quality(spark, sf).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    told = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(told) > 50 and sum(a == b for a, b in told) / len(told) >= 0.97


def test_quality_learns_from_its_rows_alone(spark, sf):
    """Labels and texts of held-out rows, and any other column, change nothing; equal texts score alike."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = {i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if r["doc_id"] in held else r["quality"]) for r in labels.collect()], "doc_id long, quality int")
    a, b = quality.digest(docs, labels).collect(), quality.digest(docs.drop("lang", "source").repartition(3), turned).collect()
    assert collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


def test_quality_of_awkward_tables(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (12, 1), (4, 0), (None, 1), (6, None), (77, 0)], "doc_id long, quality int")
    model = quality.fit(awkward, labels, steps=200)
    got = quality.scored(awkward, model).collect()
    assert len(got) == len(AWKWARD) and got[0].asDict().keys() == {"doc_id", "text", "n", "rank", "output", "part", "a.b", "score", "predicted"}
    empty = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(empty) == 1 and len({r["score"] for r in got if r["doc_id"] == 10}) == 1
    assert quality.sample(awkward, labels).count() == 4 and quality.scored(awkward.limit(0), model).count() == 0
    none = quality.fit(awkward, labels.limit(0), steps=50)
    assert {r["score"] for r in quality.scored(awkward, none).collect()} == {0.5}
    ones = quality.fit(awkward, labels.where("quality = 1"), steps=200)
    assert all(r["score"] > 0.5 for r in quality.scored(awkward, ones).collect())


def test_sample_of_one_document_with_a_third_of_the_rows(spark):
    """Rows of one id are aggregated before they are joined, and the sample stays bounded."""
    docs = spark.createDataFrame([(5 if i % 3 == 0 else i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(5 if i % 3 == 0 else i, i % 2) for i in range(3000)], "doc_id long, quality int")
    s = quality.sample(docs, labels, rows_per_label=16)
    rows = s.collect()
    assert len(rows) <= 32 and sum(r["n"] for r in rows) == 1001 * 2 + 1999


def test_bias_is_put_right_for_rare_labels():
    bags = [quality.bag(t) for t in ["good text here", "bad ### junk"] * 20]
    outputs, bias = quality.train(bags, [1, 0] * 20, 0.999, steps=2000)
    assert quality.Model(outputs, bias).scores([""])[0] > 0.95


def skewed(spark, n=1800):
    """A third of the rows without id, a third with one id."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of {i * i % 97} words") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def per_task(df, read):
    """Rows that each task of the last shuffle gets."""
    return sorted(r["n"] for r in read(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_ranges_are_cut_within_an_id():
    low = -(1 << 63)
    bounds = fingerprint.ranges([low] * 3 + [5] + [7] * 4 + [900])
    r = np.random.default_rng(0)
    o, h = np.concatenate((np.full(3000, low), np.full(4000, 7), r.integers(0, 1000, 2000))), r.integers(low, (1 << 63) - 1, 9000)
    got = fingerprint.range_numbers(bounds, o, h)
    want = [sum((a, b) <= (x, y) for a, b in zip(*(z.tolist() for z in bounds), strict=True)) for x, y in zip(o.tolist(), h.tolist(), strict=True)]
    assert got.tolist() == want
    assert np.bincount(got)[1:4].max() < 1200 and np.bincount(got)[5:8].max() < 1200


def test_fingerprints_and_files_of_hot_ids(spark, tmp_path):
    rows, df = skewed(spark)
    got = fingerprint.digest(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 600
    assert len({r["near_next"] for r in got}) > 1
    s = fingerprint.Sampler()
    assert collections.Counter(r["fingerprint"] for r in got) == collections.Counter(fingerprint.hexed(s.text(t)) for _, t in rows)
    vocab = fasttok.vocabulary("byte_bpe_50k.json")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        manifest = tokenfile.write(df, f"file://{tmp_path}/tok", vocab)
        docs = sorted(m["n_docs"] for m in manifest)
        assert sum(docs) == len(rows) and docs[-1] <= 3 * docs[len(docs) // 2]
        pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html"))
        files = warc.write(pages, f"file://{tmp_path}/warc")
        n = sorted(m["n_records"] for m in files)
        assert sum(n) == len(rows) and n[-1] <= 3 * n[len(n) // 2]
        assert warc.read(spark, files).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("html", ["<a " * 16_000, '<a ">"' * 16_000, "<div>" * 8000 + "</span>" * 8000, "<li><div>" + "<b>" * 8000 + "<li></li>" * 8000, "<a '\">" * 16_000, "<" * 100_000, "<!--" * 50_000 + ">"])
def test_broken_pages_take_time_in_proportion(html):
    began = time.process_time()
    list(extract.walk(html))
    assert time.process_time() - began < 2.5
    long = time.process_time()
    list(extract.walk(html * 4))
    assert time.process_time() - long < 12 * max(time.process_time() - began, 0.05)


def test_stray_starts_of_tags_are_text():
    assert [x for x in extract.events("a <b c")] == [("text", "a <b c", "")]
    assert list(extract.events('<p x=">">1 < 2<br>')) == [("start", "p", ' x=">"'), ("text", "1 < 2", ""), ("start", "br", "")]
    began = time.process_time()
    assert len(list(extract.events("<a " * 16_000))) == 1
    assert time.process_time() - began < 0.1
