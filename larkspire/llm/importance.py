"""Importance resampling towards a target: hashed n-gram counts of corpus and target, gains by bucket, Gumbel top-k.

Words are put in a position table by posexplode; lead() over a document's positions sets the following words beside each,
so an n-gram of each order is a row. A feature's bucket is the CRC-32 of its UTF-8 bytes modulo buckets. Counts by bucket
are aggregated before they are shuffled (buckets rows a task at most), gains are a table of buckets rows that is joined
back by broadcast, and a document's weight is the floored mean over its features. Gumbel noise seeded by the row's key
makes the highest scores a draw without replacement in proportion to exp(weight / 1000).

Orders above 1 need the window, and so a shuffle of the words by document; order 1 alone shuffles no word.

Rows are keyed by key and two hashes of the text. Repeated rows are one key with its number of copies: counts are taken of
all copies, each copy comes out, and copies are neighbours in rank. Null and empty texts and those without a word have no
feature, weight 0 and are never drawn; rows without key are drawn like an empty one. Without a target text every gain
follows from the corpus alone, and an empty corpus gives an empty table. A text of any length is read whole. Extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.llm.common import discard, stored

SEED, BUCKETS, SHARE, LEAST_WORDS = 2024, 10_000, 10, 20
MOST_BUCKETS = 1 << 20  # what is joined by broadcast is at most so many rows of two numbers
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["key", "k1", "k2"]


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, runs of ASCII letters, digits and everything beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), t.alias("text"))


def position_table(rows: DataFrame) -> DataFrame:
    """A row for each word: key, k1, k2, pos, word. A row without words has one with a null word."""
    return rows.select(*_KEY, F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))


def features(rows: DataFrame, order: int = 1) -> DataFrame:
    """The n-grams of 1 to order consecutive words: key, k1, k2, pos, feature, copies. Copies of a row are counted, not repeated, in orders above 1."""
    table = position_table(rows)
    if order == 1:
        return table.select(*_KEY, F.coalesce("pos", F.lit(0)).alias("pos"), F.col("word").alias("feature"), F.lit(1).cast("long").alias("copies"))
    once = table.repartition(*_KEY).groupBy(*_KEY, F.coalesce("pos", F.lit(0)).alias("pos")).agg(F.first("word").alias("word"), F.count("*").alias("copies"))
    w = Window.partitionBy(*_KEY).orderBy("pos")
    grams = [F.when(F.lead("word", n - 1).over(w).isNotNull() if n > 1 else F.lit(True), F.concat_ws(" ", *[F.lead("word", i).over(w) if i else F.col("word") for i in range(n)])) for n in range(1, order + 1)]
    wide = once.select(*_KEY, "pos", "copies", F.col("word").isNull().alias("bare"), F.array(*grams).alias("grams"))
    long = wide.select(*_KEY, "pos", "copies", "bare", F.explode("grams").alias("feature"))
    # A row without a word keeps the one feature that is null.
    return long.where("feature IS NOT NULL").select(*_KEY, "pos", F.when(~F.col("bare"), F.col("feature")).alias("feature"), "copies")


def counts(rows: DataFrame, order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all rows fall into each bucket."""
    f = features(rows, order).where("feature IS NOT NULL")
    return f.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("copies").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that the corpus has, from two tables of counts(): a thousand log-ratios with one added to each bucket."""
    if buckets > MOST_BUCKETS:
        raise ValueError(f"at most {MOST_BUCKETS} buckets")
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]  # noqa: E731  (one row)
    of_corpus, of_target = total(corpus), total(target)
    s, t = F.col("n").cast("double"), F.coalesce(F.col("t"), F.lit(0)).cast("double")
    ratio = ((t + 1) * (of_corpus + buckets)) / ((s + 1) * (of_target + buckets))
    return corpus.join(F.broadcast(target.select("bucket", F.col("n").alias("t"))), "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, k1, k2, n_features, n_words, weight, copies): a row for each distinct row of docs."""
    rows = keyed(docs, key, text)
    passages = target.select(F.lit(None).cast("long").alias("key"), F.xxhash64(F.col(f"`{target_text}`")).alias("k1"), F.lit(0).cast("long").alias("k2"), F.col(f"`{target_text}`").alias("text"))
    mine, theirs = stored(counts(rows, order, buckets), "importance-counts"), stored(counts(passages, order, buckets), "importance-target")
    gain = stored(gains(mine, theirs, buckets), "importance-gains", (mine, theirs))  # buckets rows at most
    f = features(rows, order).withColumn("bucket", bucket(F.col("feature"), buckets))
    first = (F.col("pos") == 0) & (F.instr(F.coalesce("feature", F.lit("")), " ") == 0)  # the first word, or the row without any
    per = (
        f.join(F.broadcast(gain), "bucket", "left")
        .groupBy(*_KEY)
        .agg(
            F.sum(F.when(F.col("feature").isNotNull(), F.col("copies")).otherwise(0)).alias("features"),
            F.sum(F.when(F.col("feature").isNotNull() & (F.instr("feature", " ") == 0), F.col("copies")).otherwise(0)).alias("n_words"),
            F.sum(F.coalesce(F.col("gain") * F.col("copies"), F.lit(0))).alias("gains"),
            F.sum(F.when(first, F.col("copies")).otherwise(0)).alias("copies"),
        )
    )
    n = F.greatest(F.col("features"), F.lit(1))
    floored = F.expr("(gains - pmod(gains, greatest(features, 1))) div greatest(features, 1)")
    out = per.select(*_KEY, F.expr("features div copies").alias("n_features"), F.expr("n_words div copies").alias("n_words"), F.when(n > 0, floored).alias("weight"), "copies")
    out = stored(out, "importance-weights")
    discard(gain)
    return out


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with score: the weight and a thousand Gumbel draws seeded by the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", order: int = 1, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank): rank from 1 for the share (percent) of highest scores among rows of at least least_words words, null for the rest. Ties to the smaller key."""
    weights = weighted(docs, target, key, text, target_text, order, buckets)
    able = F.col("n_words") >= least_words
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    order_by = [F.desc("able"), F.desc("score"), F.asc_nulls_last("key"), F.asc("k1"), F.asc("k2"), F.asc("copy")]
    rows = scored(weights, seed).withColumn("able", able).select(*_KEY, "n_features", "weight", "score", "able", F.explode(copies).alias("copy"))
    # Ranges of the total order are numbered on their own and shifted by the counts of those before them.
    dealt = stored(rows.repartitionByRange(*order_by).withColumn("part", F.spark_partition_id()), "importance-ranked", (weights,))
    per = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("able").cast("long")).alias("able")).orderBy("part").collect()  # a row a range
    draw, before, shifts = sum(r["able"] for r in per) * share // 100, 0, []
    for r in per:
        shifts.append((r["part"], before))
        before += r["n"]
    shifts = docs.sparkSession.createDataFrame(shifts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order_by)) + F.col("before")
    ranked = dealt.join(F.broadcast(shifts), "part").withColumn("rank", place)
    return ranked.select("key", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= draw), F.col("rank")).cast("long").alias("rank"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark).withColumnRenamed("key", "doc_id")


_FEATURES = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
#: CRC-32 by its table of 256 remainders, which eight steps of the polynomial make; only distinct words are hashed.
ORACLE = f"""WITH RECURSIVE steps(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS r FROM steps WHERE k = 8),
d AS (SELECT doc_id, {_FEATURES} AS w FROM documents), b AS (SELECT {_FEATURES} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
known AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT), lambda a, x: xor(a // 256, r[(xor(a, x) % 256 + 1)::BIGINT]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM known, remainders),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN crc USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (w) GROUP BY ALL),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor({SHARE} * (SELECT count(*) FROM r) / 100) THEN rank END::BIGINT AS rank FROM e LEFT JOIN r USING (doc_id)"""
