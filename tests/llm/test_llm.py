"""The operators of the llm subpackage against brute force, round trips and held-out accuracy, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspire.llm import extract, fasttok, fingerprint, jaccard, knn, langid, packing, pii, subword, tokenfile, warc
from larkspire.llm.common import fresh_dir, stored

LONG = "word " * 30_000
#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "de", None), (5, "alpha beta gamma delta epsilon zeta", "en", "s"),
    (5, "alpha beta gamma delta epsilon zeta", "en", "s"), (5, "another text of the same id with words enough", "en", "t"), (None, "no id here but words enough for a set", "en", "s"), (9, LONG, "en", "s"), (1 << 60, "x" * 5000, "fr", "s"), (7, "𝟘 漢字 é́ ﬁ \x00", "fr", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with what the operators add."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], SCHEMA + ", score int, rejected string, n long")


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Personal data


def plain_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_spans_are_the_patterns(texts):
    random.seed(3)
    alphabet = "a.@-+%_ 0123456789()é\n"
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(4000)]
    made += ["a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "x" * 20000 + "@", "1" * 20000, "@" * 5000, "1." * 5000, "001.002.003.004"]
    for t in [*made, *texts.values()]:
        assert sorted(pii.base_spans(t), key=lambda x: (x[1], pii.KINDS.index(x[0]))) == plain_spans(t), t[:80]


def test_added_kinds_need_checks_and_context():
    assert ("iban", 5, 32) in [x[:3] for x in pii.spans("IBAN GB82 WEST 1234 5698 7654 32.")]
    assert not [x for x in pii.spans("IBAN GB83 WEST 1234 5698 7654 32.") if x[0] == "iban"]
    assert [x[0] for x in pii.spans("social security 123-45-6789")] == ["ssn"] and not pii.spans("code 123-45-6789")
    near, far = pii.spans("my email is a@b.co")[0], pii.spans("see a@b.co")[0]
    assert near[3] > far[3]
    assert pii.redacted("a a@b.co b 1.2.3.4") == "a <EMAIL> b <IP>" and pii.redacted("clean") == "clean" and pii.redacted(None) is None


def test_ibans_end_before_capitals_and_numbers():
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in ("", " BIC COBADEFF", " EUR 50", " 2024", " GB82 WEST 1234 5698 7654 32", "."):
            text = "to " + iban + after
            got = [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"]
            assert got == [iban] + ["GB82 WEST 1234 5698 7654 32"] * ("GB82" in after)
            assert "<IBAN>" in pii.redacted(text)
    text = "AB12 3456 7890 DE89 3704 0044 0532 0130 00 X"
    assert [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"] == [text[15:-2]]
    assert not [x for x in pii.spans("DE89 3704 0044 0532 0130 01 BIC") if x[0] == "iban"] and len(pii.spans("AB12 " * 50_000)) < 50_000


def test_pii_rows(docs, none):
    got = {(r["doc_id"], r["spans"]) for r in pii.digest(docs).collect()}
    assert len(got) == 10 - 1 and all(s == "" for _, s in got)
    assert pii.digest(none).count() == 0
    assert pii.detect(docs).count() == len(ROWS) and pii.redact(docs).columns == docs.columns


# Nearest neighbours


def brute_knn(vectors, k):
    out = set()
    for q, x in vectors.items():
        if q % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors.items() if v != q))[:k]
            out |= {(q, i, v, -t) for i, (t, v) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("kind", ["random", "hot", "huge", "few"])
def test_knn_is_exact(spark, kind):
    rng = np.random.default_rng(5)
    n = 4 if kind == "few" else 3000
    x = rng.normal(size=(n, 8)) + rng.integers(0, 4, (n, 1)) * 2
    if kind == "hot":
        x[: n // 3] = x[0]
    if kind == "huge":
        x *= 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {tuple(r) for r in knn.digest(df).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_knn({i: [math.floor(256 * c) for c in v] for i, v in enumerate(x)}, 5)


def test_knn_leaves_bad_vectors_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [2.0]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.digest(df).orderBy("rank").collect()] == [(0, 1, 7, 131072), (0, 2, 8, 32768), (0, 3, 6, 0)]
    assert knn.digest(df.where("false")).count() == 0


# Tokens and packing


def test_cached_ids_are_the_library_s():
    random.seed(1)
    alphabet = "ab ßéÀ'sS\t\n\r  .,!?09²½_-–“”…€ªº\xa0İıǅΣσ漢𝟘'll' re’s·×÷ñ"
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> x", "don't  stop\n\n now", "a" * 3000]
    for kind, name in ((fasttok.ByteBpe, "byte_bpe_50k.json"), (fasttok.WordBpe, "word_bpe_49k.json")):
        enc = fasttok.encoder(kind, fasttok.vocabulary(name))
        assert [t for t in made if enc.ids(t) != enc.slow(t)] == []


def test_token_files_round_trip(spark, docs, none, tmp_path):
    vocab = fasttok.vocabulary("byte_bpe_50k.json")
    manifest = tokenfile.write(docs, f"file://{tmp_path}", vocab, shard_bytes=200)
    enc, start, got = fasttok.encoder(fasttok.ByteBpe, vocab), 0, sorted(tokenfile.read(spark, manifest).collect(), key=lambda r: r["start"])
    want = collections.Counter((d, zlib.crc32(enc.slow(t or "") + b"\x02\0\0\0")) for d, t, *_ in ROWS)
    assert collections.Counter((r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    shard = next(m["path"] for m in manifest if m["n_docs"] and any(True for _ in [0]))
    ids = {r["doc_id"] for r in got}
    found = [d for d in ids if d is not None for m in manifest if _has(m["path"], d)]
    assert set(found) == ids - {None} and shard
    assert not [p for p in tmp_path.iterdir() if ".tmp-" in p.name]
    assert tokenfile.digest(none, vocab).count() == 0


def _has(path, d):
    try:
        return len(tokenfile.read_one(path, d)) > 0
    except KeyError:
        return False


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_best_fit_on_runs(spark):
    random.seed(2)
    for opens in [True] * 60 + [False] * 2:
        lengths = [random.randint(1, 64) if random.random() < 0.5 else random.choice((1, 3, 64, 33)) for _ in range(random.randint(0, 400))]
        counts = collections.Counter(lengths)
        if opens:  # one sweep over everything
            steps, left, _, used = packing.sweep([(k, 0, n) for k, n in counts.items()], [], 64, 0)
            steps = np.array(steps, np.int64).reshape(-1, 5)
            assert not left
        else:  # supersteps over ranges
            steps, used = packing.best_fit(spark.createDataFrame(list(counts.items()), "length int, n long"), 64, bands=3, width=8)
        bins, left = collections.defaultdict(int), collections.Counter()
        rank = {s: sorted((x for x in steps.tolist() if x[0] == s), key=lambda x: x[1]) for s in counts}
        for s in lengths:
            r, left[s] = left[s], left[s] + 1
            row = [x for x in rank[s] if x[1] <= r][-1]
            q = r - row[1]
            bins[row[3] + q % row[2]] += s
        assert len(bins) == used and all(v <= 64 for v in bins.values())
        greedy = []
        for s in sorted(lengths, reverse=True):
            fits = [i for i, v in enumerate(greedy) if v + s <= 64]
            if fits:
                greedy[max(fits, key=lambda i: greedy[i])] += s
            else:
                greedy.append(s)
        assert used <= (len(greedy) + 1 if opens else len(greedy) * 1.05 + 1)


def test_packing_rows(docs, none, texts, spark):
    vocab = fasttok.vocabulary("word_bpe_49k.json")
    got = packing.digest(docs, vocab).collect()
    enc = fasttok.encoder(fasttok.WordBpe, vocab)
    want = collections.Counter()
    for d, t, *_ in ROWS:
        ids = enc.slow(t or "") + b"\x01\0\0\0"
        for i in range(0, len(ids), 4 * 4096):
            part = ids[i : i + 4 * 4096]
            want[d, i // (4 * 4096), i // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    check_packed(got, 4096)
    assert packing.digest(none, vocab).count() == 0
    big = packing.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), vocab).collect()
    assert check_packed(big, 4096) <= math.ceil(sum(r["length"] for r in big) / 4096) + 1


# WARC


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "é" * 200
    rows = [(3, "http://a", body), (1, "http://b c\r\nX: y", body), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (7, "u", "x" * 300_000), (8, "u", body), (8, "u", body), (1 << 60, "u", body)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write(df, f"file://{tmp_path}", roll_bytes=2000)
    again = warc.write(df.repartition(1), f"file://{tmp_path}/again", roll_bytes=2000)
    assert [m["sha256"] for m in manifest] == [m["sha256"] for m in again]
    for m in manifest:
        assert hashlib.sha256(open(m["path"].removeprefix("file://"), "rb").read()).hexdigest() == m["sha256"]
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, manifest).collect())
    want = collections.Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        later = p is not None and p > 1 and h == body
        want[p, "revisit" if later else "response", 1 if later else None, len(raw), hashlib.sha256(raw).hexdigest()] += 1
    assert got == want
    assert warc.digest(df.where("false")).count() == 0


# Fingerprints


def test_fingerprints_estimate_generalised_jaccard():
    random.seed(7)
    s, errors = fingerprint.Sampler(512), []
    for _ in range(60):
        a = {w: random.randint(1, 5) for w in random.sample("abcdefghijklmnopqrstuvwxyz", 14)}
        b = {w: random.randint(1, 5) if random.random() < 0.5 else a.get(w, 1) for w in random.sample("abcdefghijklmnopqrstuvwxyz", 14)}
        true = sum(min(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}) / sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
        errors.append(fingerprint.likeness(s.bag(a), s.bag(b)) - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_a_small_table_changes_nothing(texts):
    big, small = fingerprint.Sampler(32), fingerprint.Sampler(32, 40)
    for t in list(texts.values())[:40]:
        assert fingerprint.hexed(big.text(t)) == fingerprint.hexed(small.text(t))


def test_fingerprint_rows(spark, docs, none, sf, texts):
    got = fingerprint.digest(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    order = sorted(texts, reverse=True)
    nexts = dict(zip(order, [*order[1:], order[0]], strict=True))
    assert len(got) == len(texts)
    for r in got:
        t, n = texts[r["doc_id"]], texts[nexts[r["doc_id"]]]
        new = fingerprint.edited(t, n)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
    awkward = fingerprint.digest(docs).collect()
    assert collections.Counter(r["doc_id"] for r in awkward) == collections.Counter(r[0] for r in ROWS)
    same = {r["fingerprint"] for r in awkward if r["doc_id"] == 1}
    assert len(same) == 1 and sum(r["fingerprint"] in same for r in awkward) == 3
    assert fingerprint.digest(none).count() == 0
    one = fingerprint.digest(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


# HTML


def test_article_text():
    page = (
        "<html><head><title>no</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li>no</li></ul></nav><div class='ad top'>no</div><article><header>no</header><h1>T &amp; t</h1><p>a<b> b</b>\n c<br>d<p>e"
        "<ul><li>f<li>g</ul><form><p>no</form><div class='comments'><p>no</div><aside>no</aside><!-- no --><table><tr><td>h<td>i</table></article><footer>no</footer>"
    )
    assert extract.main_text(page, 0) == "T & t\na b c d\ne\nf\ng\nh\ni"
    assert extract.main_text(None, 0) == "" and extract.main_text("", 0) == "" and extract.main_text("<nav>a</nav>", 0) == "" and extract.main_text("<p>open <b", 0) in ("open", "open <b")


def test_template_finds_the_slot(spark):
    page = "<body><div class='menu'>m{0}</div><div class='box'>side {0}</div><div class='q7'><p>text of page {0} which is long enough</p><p>common line</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(20)] + [(30, "http://h.org/x", "<article>other</article>"), (None, None, None), (31, "http://h.org/y", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract.extract(df).collect()}
    assert got[3] == "text of page 3 which is long enough\ncommon line" and got[30] == "other" and got[31] == "" and got[None] == ""
    assert extract.extract(df.where("false")).count() == 0


def hosts(spark, pages):
    """The texts of pages (by host, each 8 times with its number in place of {0})."""
    rows = [(i, f"http://{h}/{i}", p.replace("{0}", str(i))) for h, p in pages.items() for i in range(8)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id = 3").collect()
    return {r["url"].split("/")[2]: r["text"] for r in got}


def test_text_of_the_whole_subtree_decides(spark):
    long = "a long text of page {0} with many words in it"
    pages = {"a": f"<body><article class=post><p>{long}</p></article><article class=teaser>short {{0}}</article>", "b": f"<body><div id=content><p>{long}</p><div class=text>note {{0}}</div></div>"}
    want = {"a": long.replace("{0}", "3"), "b": long.replace("{0}", "3") + "\nnote 3"}
    assert hosts(spark, pages) == want
    assert {h: extract.main_text(p.replace("{0}", "3"), 0) for h, p in pages.items()} == want


def test_classes_decide_the_slot(spark):
    """Whole slots on hosts without marks; a box that only a class tells from a paragraph; a list that repeats."""
    long = "a long text of page {0} with many words in it"
    pages = {
        "plain": f"<body><div class=q7><h1>title {{0}}</h1><p>{long}</p><ul><li>one {{0}}<li>two</ul><p>{long}, more</p></div><div class=box>side {{0}}</div></body>",
        "heading": f"<div class=x><div class=t><h1>title {{0}}</h1></div><div class=u><p>{long}</p></div></div>",
        "repeated": f"<div class=x><div class=u><p>{long}</p></div><div class=u><p>{long}, more</p></div><div class=v>end {{0}}</div></div>",
        "constant": f"<div class=x><div class=u><p>{long}</p><p>same</p></div><div class=v>{'the same on every page ' * 9}</div></div>",
        "loose": f"<p>{long}</p><div class=x>short {{0}}</div>",
    }
    text = long.replace("{0}", "3")
    got = hosts(spark, pages)
    assert got["plain"] == f"title 3\n{text}\none 3\ntwo\n{text}, more"
    assert got["heading"] == f"title 3\n{text}"
    assert got["repeated"] == f"{text}\n{text}, more\nend 3"
    assert got["constant"] == f"{text}\nsame"
    assert got["loose"] == f"{text}\nshort 3"


def test_class_words_alone_leave_nothing_out(spark):
    long = "a long text of page {0} with many words in it"
    body = f"<h1>title {{0}}</h1><p>{long}</p>"
    pages = {
        "body": f"<html class=no-sidebar><body class=has-sidebar><div class=x>{body}</div></body></html>",
        "main": f"<main class=content-with-sidebar>{body}</main><div class=x>side {{0}}</div>",
        "article": f"<article class='post comments-open'>{body}</article><div class=comments><p>{long * 3}</p></div>",
        "wrapper": f"<body><div class=has-sidebar><div class=x>{body}<div class=share>no {{0}}</div></div><div class=sidebar>no {{0}}</div></div><div class=y>side {{0}}</div></body>",
        "beside": f"<body><div class=x><p>{long}</p></div><div class=comments><p>{long * 3}</p></div></body>",
        "menu": "<body><div class=ad>no {0}</div></body>",
    }
    text = long.replace("{0}", "3")
    want = dict.fromkeys(pages, f"title 3\n{text}") | {"beside": text, "menu": ""}
    assert hosts(spark, pages) == want
    assert {h: extract.main_text(p.replace("{0}", "3"), 0) for h, p in pages.items()} == want
    once = "<article><p>text {0}</p>%s</article>"
    rows = [(i, "http://h/", (once % ("<div class=notice>read</div>" if i == 5 else "<div class=share>no</div>")).replace("{0}", str(i))) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "text 5\nread" and got[4] == "text 4"


def test_classes_against_plain_vectors(spark, sf):
    """The vectors, supports and classes of templates(), and its choice, from vectors that are built page by page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = "<body><div class=a>menu {0}</div><div class=b><div class=c><h1>title {0}</h1><p>the text of page {0} goes on</p>%s</div></div><div class=d>foot</div></body>"
    rows = [(10_000 + i, f"http://made/{i}", (made % ("<p>more</p>" * (i % 3))).replace("{0}", str(i))) for i in range(12)]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = collections.defaultdict(list)
    for r in pages.collect():
        by[re.match(r"[a-z]+://([^/?#]*)", r["url"]).group(1).lower()].append((r["page_id"], extract.tokens(r["html"])))
    got = {r["host"]: (r["content"], sorted(r["shut"])) for r in extract.templates(pages).collect()}
    assert set(got) == set(by)
    for host, found in by.items():
        vectors, total = {}, {}
        for i, (_, tokens) in enumerate(found):
            for t, x in tokens.items():
                vectors.setdefault(t, [0] * len(found))[i] = x.count
                y = total.get(t)
                if y is None:
                    total[t] = x
                else:
                    y.count, y.chars, y.own, y.low, y.high = y.count + x.count, y.chars + x.chars, y.own + x.own, min(y.low, x.low), max(y.high, x.high)
        for t, x in total.items():
            x.pages, x.vector = sum(n > 0 for n in vectors[t]), hash(tuple(vectors[t]))
        kept = {t: x for t, x in total.items() if x.pages >= extract.AGREED * len(found)}
        content, shut = extract.choose(kept, len(found))
        assert got[host] == (content, sorted(shut)), host


def test_without_the_template_results_differ(spark):
    """On a page of its own the longest box wins; only the other pages tell that it is the same everywhere."""
    page = "<div class=q><p>{0} own words of the page {0}</p></div><div class=z>%s</div>" % ("a note that all pages share " * 9)
    rows = [(i, f"http://h/{i}", page.replace("{0}", f"w{i}")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"w{i} own words of the page w{i}" for i in range(6)}
    assert extract.main_text(rows[3][2], 0) != got[3]


def test_hosts_dealt_by_salts(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    monkeypatch.setattr(extract, "BROADCAST_BYTES", 0)
    assert {r["page_id"]: r["text"] for r in extract.extract(pages).collect()} == want


# Jaccard join


def brute_components(rows):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in where[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    comp = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            comp[find(i)].append(d)
    return collections.Counter((d, len(s), d if not s else min(comp[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(n, seed):
    """Chains of edits, copies, common passages, short texts."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(random.choices(vocabulary, k=30))
    out = []
    for i in range(n):
        kind = random.random()
        if kind < 0.5 and out:
            w = random.choice(out)[1].split()
            for _ in range(random.choice((0, 1, 1, 2, 3))):
                if w:
                    w[random.randrange(len(w))] = random.choice(vocabulary)
            text = " ".join(w).upper() if random.random() < 0.1 else " ".join(w)
        elif kind < 0.7:
            text = common + " " + " ".join(random.choices(vocabulary, k=random.randint(5, 60)))
        else:
            text = " ".join(random.choices(vocabulary, k=random.choice((1, 2, 4, 5, 6, 8, 9, 12, 40, 200))))
        out.append((i, text))
    return out


@pytest.mark.parametrize(("n", "seed", "limit", "rounds"), [(500, 1, 10**7, 3), (300, 2, 0, 2), (300, 3, 10**7, 1)])
def test_components_are_exact(spark, monkeypatch, n, seed, limit, rounds):
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", limit)
    rows = near_copies(n, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, rounds).collect())
    assert got == brute_components(rows)


def test_large_runs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rows = near_copies(300, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, rounds=1).collect())
    assert got == brute_components(rows)


def test_linked_sets_share_a_signature():
    random.seed(9)
    for _ in range(1500):
        n = random.choice((4, 5, 6, 9, 13, 30, 100, 400))
        a = set(random.sample(range(10**9), n))
        b = set(a)
        for x in random.sample(sorted(a), random.randint(0, max(1, n // 9))):
            b.discard(x)
        b |= set(random.sample(range(10**9), random.randint(0, max(1, n // 9))))
        s, t = (jaccard._mix(np.array(sorted(x), np.uint64)) for x in (a, b))
        s.sort(), t.sort()
        if s.tobytes() != t.tobytes() and jaccard.linked(len(a & b), len(a), len(b)):
            assert np.intersect1d(jaccard.signatures(s), jaccard.signatures(t)).size


def test_the_trees_lose_no_pair_and_prune():
    rng = np.random.default_rng(3)
    p = rng.poisson(3, (300, jaccard.DIMS)).astype(np.uint16)
    p[150:] = np.maximum(0, p[:150].astype(int) + (rng.random((150, jaccard.DIMS)) < 0.1))
    labels, size = rng.integers(0, 200, 300), p.sum(1, dtype=np.int64)
    runs = [rng.choice(300, k, replace=False) for k in (2, 3, 8, 9, 65, 150, 300)] + [np.array([i, i + 150]) for i in range(150)]
    at, tree = np.concatenate(runs), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    want = {(max(i, j), min(i, j)) for r in runs for i in r.tolist() for j in r.tolist() if i != j and labels[i] != labels[j] and jaccard.linked(np.minimum(p[i], p[j]).sum(), size[i], size[j])}
    trees = jaccard.Trees(p, labels, at, tree)
    found = [(max(a, b), min(a, b)) for x, y in trees.pairs(most=5000) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert want and want <= set(found)
    assert len(trees.levels) == 3 and all((labels[a] != labels[b]) for a, b in found)
    every = sum(len(r) * (len(r) - 1) // 2 for r in runs)
    assert len(found) < every
    far = p.copy()
    far[::2] = np.roll(far[::2], 128, axis=1) * (np.arange(jaccard.DIMS) < 128)  # two halves that share little
    far[1::2] *= np.arange(jaccard.DIMS) >= 128
    split = jaccard.Trees(far, np.arange(300) % 2 * 1000 + np.arange(300), np.arange(300), np.zeros(300, np.int64))
    crossing = [a % 2 != b % 2 for x, y in split.pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert sum(crossing) < len(crossing) / 10  # only those of the one leaf that has both


def test_trees_give_the_candidates_of_documents(spark, sf, monkeypatch):
    """Every pair after the first round comes out of a tree's leaves: without trees, links are lost."""
    built = spark.sparkContext.accumulator(0)
    old = jaccard._run_pairs

    def counted(pdf, forest):
        built.add(pdf["run"].nunique())
        yield from old(pdf, forest)

    monkeypatch.setattr(jaccard, "_run_pairs", counted)
    jaccard.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert built.value > 0


def test_jaccard_rows(docs, none):
    rows = [r[:2] for r in ROWS]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect())
    assert got == brute_components(rows)
    assert jaccard.join(none).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 7, 9, 1 << 60, None], key=str)


def test_rows_without_id_keep_one_of_a_component(spark):
    a, b = "one two three four five six seven", "other words are in this text here"
    rows = [(None, a, 1), (None, a, 2), (1, b, 3), (None, b, 4), (None, None, 5), (None, " ", 6), (None, None, 7)]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter([(None, a), (1, b), (None, None), (None, None), (None, " ")])


def test_components_of_edges(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (9, 3), (20, 10), (30, 20), (10, 30)], "a long, b long")
    assert sorted(map(tuple, jaccard.components(e).collect())) == [(2, 1), (3, 1), (9, 1), (20, 10), (30, 10)]


# Language


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_rows(docs, none, spark):
    model = langid.fit(spark.createDataFrame([("the cat and the dog of the house " * 9, "en"), ("le chat et le chien de la maison " * 9, "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert set(model) == {"en", "fr"}
    got = langid.identify(docs, model)
    assert got.count() == len(ROWS) and set(docs.columns) - {"score", "rejected"} <= set(got.columns)
    told = {r["doc_id"]: r for r in got.where("doc_id IN (2, 3, 4)").collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0.0 and r["rejected"] for r in told.values())
    assert langid.Classifier(model).predict("the dog and the cat")[0] == "en" and langid.Classifier(model).predict("123 ++")[0] == "und"
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.digest(none).count() == 0


# Sampled segmentations


@pytest.fixture(scope="module")
def sp():
    return subword.model(fasttok.vocabulary("piece_bpe_32k.model"))


def segmentations(m, text):
    count, start, end, ids, log, _ = m.lattices([subword.MARK + text])

    def go(at, path, total):
        if at == len(text) + 1:
            yield tuple(path), total
        for a in np.flatnonzero(start == at):
            yield from go(end[a], [*path, int(ids[a])], total + log[a])

    return list(go(0, [], 0.0))


def test_the_draw_is_without_replacement(sp):
    every = segmentations(sp, "theon")
    p = {k: math.exp(v) for k, v in every}
    assert math.isclose(sum(p.values()), 1.0)
    first, second, n = collections.Counter(), collections.Counter(), 3000
    for key in range(n):
        got = sp.sampled("theon", key, 3)
        assert len({x[0].tobytes() for x in got}) == min(3, len(every)) and got == sorted(got, key=lambda x: -x[2])
        first[tuple(got[0][0].tolist())] += 1
        second[tuple(got[1][0].tolist())] += 1
    for k in sorted(p, key=lambda k: -p[k])[:4]:
        assert abs(first[k] / n - p[k]) < 0.04
        assert abs(second[k] / n - sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)) < 0.04


def test_inclusion_scores_are_unbiased(sp):
    total = np.mean([sum(math.exp(lp) / q for _, lp, _, q in sp.sampled("ingtheon", key, 3)) for key in range(1500)])
    assert abs(total - 1) < 0.05
    assert [x[3] for x in sp.sampled("a", 1, 50)] == [1.0] * len(segmentations(sp, "a"))


def test_samples_decode_and_do_not_depend_on_the_batch(sp, texts):
    some = [*list(texts.values())[:30], "", "  a  b\tc\n漢字 𝟘 ", "x" * 3000]
    keys = list(range(len(some)))
    together, small = list(sp.batch(some, keys, 3)), subword.Model(fasttok.vocabulary("piece_bpe_32k.model"), 2000)
    for t, k, found in zip(some, keys, together, strict=True):
        alone = small.sampled(t, k, 3)
        assert [x[0].tobytes() for x in found] == [x[0].tobytes() for x in alone] and [x[1:] for x in found] == [x[1:] for x in alone]
        for ids, *_ in found:
            assert sp.decode(ids.tolist()) == t == sp.sp.decode(ids.tolist()) and sp.decodes(ids, t)


def test_subword_rows(docs, none):
    path = fasttok.vocabulary("piece_bpe_32k.model")
    got = subword.samples(docs, path).collect()
    assert len(got) == 2 * (len(ROWS) - 2) + 2 and all(r["decodes"] for r in got) and len({(r["doc_id"], r["ids_crc32"]) for r in got if r["doc_id"] == 1}) == 2
    assert subword.samples(none, path).count() == 0
    back = subword.decode(subword.encode(docs.select("text"), path), path, out="again")
    assert back.where("coalesce(text, '') <> again").count() == 0


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, kept = d, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == d.columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    before = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(kept[0]) > 0.95 * len(before) and all(before[k] == v for k, v in kept[0].items())
    comps = brute_components(list(kept[0].items()))
    assert set(kept[1]) == {x[0] for x in comps if x[0] == x[2]}
    assert kept[2] == {k: pii.redacted(v) for k, v in kept[1].items()} and docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(kept[2])
    check_packed(packed, 4096)
    assert len(corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) == len(packed)


def test_shared_folder(spark):
    assert "://" in fresh_dir(spark, "x") or fresh_dir(spark, "x").startswith("/")
