"""A stored inverted index over chunks, which a batch of queries reads by its words alone.

Layout. The texts of a segment are dealt out by id; each task counts them and cuts what it has counted, BUFFER postings at a
time and in order of length, to shards of SHARD chunks at most. For every word of a shard there is one row (a block): the
places of its chunks in the shard, its counts there, and the largest score that it gives any of them (count over the root
of the length). Only texts are shuffled, and those that lie in files of the engine's own not even once: each task writes its
blocks, sorted, into folders by a hash of the word, so a query opens those of its words. A shard has one row of its own with
the ids and lengths of its chunks, in a folder of such rows.

Search. The blocks of the batch's words are joined by word (the words are a stated batch, broadcast), dealt by shard and
scored there, best shards first, by MaxScore: words in order of their largest score, a shard or the rest of a query's words
is passed over once what they can still add can't reach the k-th score found so far. Ties go to the smaller id, so bounds
are only used where they are strictly below. A task returns k rows a query at most. No text is read.

Maintenance. update() writes chunks that were written as a new segment and marks those that were replaced or became stale
as dead in theirs (place by place); nothing else is rewritten. merge() puts all segments into one without reading texts:
blocks are dealt by shard, and the shards of a task are put together and cut anew, without what is dead.
All changes are commits of a CommitLog.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.functions.text import CJK
from larkspire.operators.log import CommitLog
from larkspire.operators.retrieval import MAX_QUERIES, _sliced, counted_terms, top
from larkspire.session import bounded, kept

SHARD, FOLDERS = 4096, 32
#: Postings (a word in a chunk) that a task holds before it writes shards of them, and rows of a batch that it gives back.
BUFFER, ROWS = 2_000_000, 20_000
_WRITTEN = "shard long, term string, most double, places array<int>, counts array<int>, ids array<{0}>, lengths array<int>, cjk array<boolean>"
_BLOCK = "shard long, term string, n int, most double, places array<int>, counts array<int>, folder int"
_SHARD = "shard long, ids array<{0}>, lengths array<int>, cjk array<boolean>, folder int"
#: The folder of the rows of shards; those of blocks are numbered from 0.
SHARDS = -1
_DEAD = "shard long, place int"
_POINT = "shard long, place int, chunk_id {0}, vector array<double>"
_HITS = "query_id long, chunk_id {0}, score double, matched array<string>, cjk boolean"


def folder_of(term: str, folders: int = FOLDERS) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % folders


def _fold(state: dict, commit: dict) -> dict:
    return {"segments": commit["only"], "source": commit["source"] if "source" in commit else state.get("source"), "note": commit.get("note", state.get("note")), "kind": commit.get("kind", state.get("kind"))}


def kind_of(chunks: DataFrame) -> str:
    """Ids are whole numbers or texts."""
    return "string" if chunks.schema["chunk_id"].dataType.simpleString() == "string" else "bigint"


class _Writer:
    """Chunks and their words as rows of shards and blocks (_WRITTEN), in one task. The rows of blocks have a term."""

    def __init__(self, shard: int, kind: str):
        self.shard, self.kind = shard, pa.string() if kind == "string" else pa.int64()
        self.next = TaskContext.get().partitionId() << 32
        self._clear()

    def _clear(self) -> None:
        self.ids, self.lengths, self.cjk, self.postings, self.n = [], [], [], [], 0
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, docs: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        """Postings: chunks by their place in ids, words by their number in words."""
        self.postings.append((docs, words, counts))
        self.n += len(docs)

    def chunk(self, item, length: int, cjk: bool) -> None:
        self.ids.append(item)
        self.lengths.append(length)
        self.cjk.append(cjk)
        self.n += 1

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of chunks (chunk_id, text)."""
        cjk = re.compile(CJK)
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, n = counted_terms(text or "")
                if found:
                    self.add(np.full(len(found), len(self.ids), np.int32), np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found)))
                self.chunk(item, n, bool(cjk.search(text or "")))
                if self.n >= BUFFER:
                    yield from self.flush()
        yield from self.flush()

    def stored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of stored segments (LexicalIndex._lines) in order of segment, shard and kind; chunks that are dead go."""
        held, dead, place = None, (), None
        for b in batches:
            segment, shard, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "shard", "kind"))
            begins = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])
            for a, z in zip(begins.tolist(), [*begins[1:].tolist(), b.num_rows], strict=True):
                rows = b.slice(a, z - a)
                if kind[a] == 0:  # one row a shard
                    if held is not None:  # a shard without words
                        self._kept(held, dead)
                    if self.n >= BUFFER:
                        yield from self.flush()
                    held, dead = {c: rows.column(c)[0].as_py() for c in ("ids", "counts", "cjk")}, ()
                elif kind[a] == 1:
                    dead = rows.column("places")[0].as_py()
                else:
                    if held is not None:
                        place, held = self._kept(held, dead), None
                    lists = rows.column("places")
                    docs = place[lists.flatten().to_numpy()]
                    words = np.fromiter(map(self.words.__getitem__, rows.column("term").to_pylist()), np.int32, z - a)
                    words = np.repeat(words, pc.list_value_length(lists).to_numpy())
                    live = docs >= 0
                    self.add(docs[live], words[live], rows.column("counts").flatten().to_numpy()[live])
        if held is not None:
            self._kept(held, dead)
        yield from self.flush()

    def _kept(self, held: dict, dead) -> np.ndarray:
        """Takes over the live chunks of a shard; their places in ids, -1 for dead ones."""
        live = np.ones(len(held["ids"]), bool)
        live[np.asarray(dead, int)] = False
        place = np.where(live, len(self.ids) + np.cumsum(live) - 1, -1).astype(np.int32)
        for i in np.flatnonzero(live):
            self.chunk(held["ids"][i], held["counts"][i], held["cjk"][i])
        return place

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            lengths = np.asarray(self.lengths, np.int64)
            order = np.argsort(lengths, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            yield from self._shards(order, lengths)
            if self.postings:
                yield from self._blocks(rank, lengths)
            self.next += -(-len(order) // self.shard)
        self._clear()

    def _rows(self, n: int, **columns) -> pa.RecordBatch:
        kinds = {"shard": pa.int64(), "term": pa.string(), "most": pa.float64(), "places": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "ids": pa.list_(self.kind), "lengths": pa.list_(pa.int32()), "cjk": pa.list_(pa.bool_())}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], schema=pa.schema(list(kinds.items())))

    def _shards(self, order: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, a in enumerate(range(0, len(order), self.shard)):
            mine = order[a : a + self.shard]
            of = lambda values, kind: pa.array([values], pa.list_(kind))
            yield self._rows(1, shard=pa.array([self.next + i], pa.int64()), ids=of([self.ids[j] for j in mine], self.kind), lengths=of(lengths[mine].tolist(), pa.int32()), cjk=of([self.cjk[j] for j in mine], pa.bool_()))

    def _blocks(self, rank: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, word, count = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        self.postings = []
        if not len(doc):
            return
        shard, place = np.divmod(rank[doc], self.shard)
        block = shard * len(self.words) + word
        by = np.argsort(block * self.shard + place)
        block, place, score, count = block[by], place[by].astype(np.int32), (count / np.sqrt(np.maximum(lengths[doc], 1)))[by], count[by]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[first, len(block)]
        shard, word = np.divmod(block[first], len(self.words))
        terms, most = pa.array(list(self.words), pa.string()), np.maximum.reduceat(score, first)
        for a in range(0, len(first), ROWS):
            z = min(a + ROWS, len(first))
            lists = lambda x: pa.ListArray.from_arrays(pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), pa.array(x[ends[a] : ends[z]]))  # noqa: E731, B023
            yield self._rows(z - a, shard=pa.array(self.next + shard[a:z]), term=terms.take(pa.array(word[a:z])), most=pa.array(most[a:z]), places=lists(place), counts=lists(count))


class LexicalIndex:
    """The index below a folder."""

    def __init__(self, spark: SparkSession, root: str, shard: int = SHARD, folders: int = FOLDERS):
        self.spark, self.root, self.shard, self.folders = spark, root.rstrip("/"), shard, folders
        self.log = CommitLog(spark, self.root, _fold)

    # Writing

    def _segment(self, rows: DataFrame, kind: str, points: DataFrame | None = None) -> dict:
        """A segment of a _Writer's rows and the vectors of their chunks, under a new name."""
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        folder = F.coalesce(F.crc32(F.col("term").cast("binary")) % self.folders, F.lit(SHARDS)).cast("int")
        rows = rows.select("shard", "term", F.when(F.col("term").isNotNull(), F.size("places")).alias("n"), "most", "places", "counts", "ids", "lengths", "cjk", folder.alias("folder"))
        rows.sortWithinPartitions("folder", "term", "shard").write.option("compression", "zstd").partitionBy("folder").parquet(path)
        shards = self._shards({"path": path}, kind)
        n = shards.agg(F.sum(F.size("lengths"))).first()[0]
        if points is not None:
            placed = shards.select("shard", F.posexplode("ids").alias("place", "chunk_id")).withColumn("place", F.col("place").cast("int"))
            placed.join(points.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")), "chunk_id").select("shard", "place", "chunk_id", "vector").write.parquet(f"{path}-points")
        return {"path": path, "chunks": int(n or 0), "dead": [], "n_dead": 0, "points": points is not None}

    def _partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _counted(self, chunks: DataFrame, points: DataFrame | None = None, dealt: bool = False) -> dict:
        """A segment of chunks (chunk_id, text), in one pass over the texts; dealt out by id, however few files hold them, if they aren't dealt already."""
        kind, shard = kind_of(chunks), self.shard
        rows = chunks.select(F.col("chunk_id").cast(kind).alias("chunk_id"), F.col("text").cast("string").alias("text"))
        return self._segment(bounded(rows if dealt else rows.repartition("chunk_id")).mapInArrow(lambda batches: _Writer(shard, kind).texts(batches), _WRITTEN.format(kind)), kind, points)

    def build(self, chunks: DataFrame, note: str | None = None, points: DataFrame | None = None, source: str | None = None) -> int:
        """The index of chunks (chunk_id, text) alone, with their points (chunk_id, vector) where these are given, in place of what was there. source: the folder of the engine's own files that chunks are; these are read as they lie, without dealing texts out."""
        version, _ = self.log.state()
        return self.log.commit({"only": [self._counted(chunks, points, source is not None)], "source": source, "note": note, "kind": kind_of(chunks)}, version)

    def update(self, written: DataFrame | None, stale: DataFrame | None = None, points: DataFrame | None = None, note: str | None = None) -> int:
        """written (chunk_id, text) are new or replace what is there, stale (chunk_id) go; sparse and dense vectors of what was written become visible with one commit. Only what was written is read."""
        gone = [df.select("chunk_id") for df in (written, stale) if df is not None]
        return self._updated(written, gone[0].unionByName(gone[1]) if len(gone) > 1 else gone[0] if gone else None, points, note)

    def _updated(self, written: DataFrame | None, gone: DataFrame | None, points: DataFrame | None, note: str | None, source: str | None = None) -> int:
        version, state = self.log.state()
        segments = list(state.get("segments", []))
        if gone is not None and segments:
            lost = kept(gone.distinct(), "lost")
            segments = [self._marked(s, lost) for s in segments]
        if written is not None:
            segments.append(self._counted(written, points, source is not None))
        kind = state.get("kind") or kind_of(written)
        return self.log.commit({"only": segments, "kind": kind, "source": source} | ({"note": note} if note else {}), version)

    def ids(self) -> DataFrame:
        """chunk_id of every live chunk."""
        _, state = self.log.state()
        out = self.spark.createDataFrame([], f"chunk_id {state.get('kind') or 'bigint'}")
        for s in state.get("segments", []):
            rows = self._shards(s).select("shard", F.posexplode("ids").alias("place", "chunk_id"))
            if s["dead"]:
                rows = rows.join(self._dead(s), ["shard", "place"], "left_anti")
            out = out.unionByName(rows.select("chunk_id"))
        return out

    def sync(self, chunks: DataFrame, note: str | None = None, points: DataFrame | None = None, fresh: DataFrame | None = None, source: str | None = None) -> int:
        """Brings the index to chunks whose ids say their content: ids that it lacks are written, those that are gone die. Can be repeated after a crash. fresh: those of chunks that it may lack, where the others are known to be there, so that no other text is read."""
        if not self.log.version():
            return self.build(chunks, note, points, source)
        known = self.ids()
        new = (chunks if fresh is None else fresh).join(known, "chunk_id", "left_anti")
        return self._updated(new, known.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), points and points.join(new.select("chunk_id"), "chunk_id", "left_semi"), note, source)

    def _marked(self, segment: dict, lost: DataFrame) -> dict:
        """The segment with the chunks in lost dead."""
        path = f"{self.root}/dead/{uuid.uuid4().hex}"
        where = self._shards(segment).select("shard", F.posexplode("ids").alias("place", "chunk_id"))
        found = where.join(lost, "chunk_id", "left_semi").select("shard", F.col("place").cast("int").alias("place"))
        if segment["dead"]:
            found = found.join(self._dead(segment), ["shard", "place"], "left_anti")
        found.write.parquet(path)
        n = self.spark.read.schema(_DEAD).parquet(path).count()
        return segment | {"dead": segment["dead"] + [path], "n_dead": segment["n_dead"] + n} if n else segment

    def merge(self) -> int:
        """One segment of all that is alive, made of the blocks."""
        version, state = self.log.state()
        kind, shard, points = state.get("kind") or "bigint", self.shard, None
        for s in state.get("segments", []):
            if s.get("points"):
                mine = self._points(s).select("chunk_id", "vector")
                points = mine if points is None else points.unionByName(mine)
        if not state.get("segments"):
            return self.log.commit({"only": []}, version)
        rows = self._dealt(state, lambda s: self._blocks(s), "term string", fixed=False)
        merged = bounded(rows).mapInArrow(lambda batches: _Writer(shard, kind).stored(batches), _WRITTEN.format(kind))
        return self.log.commit({"only": [self._segment(merged, kind, points)]}, version)

    def _dealt(self, state: dict, blocks, word: str, fixed: bool = True) -> DataFrame:
        """All shards (kind 0), their dead places (1) and the blocks that blocks(segment) gives (2) as rows of one form, dealt by shard and in this order; not fixed: into no more tasks than their size asks for, since each writes to every folder."""
        kind_id, rows = state.get("kind") or "bigint", None
        name, of = word.split()
        columns = ((name, of), ("most", "double"), ("places", "array<int>"), ("counts", "array<int>"), ("ids", f"array<{kind_id}>"), ("cjk", "array<boolean>"))
        for i, s in enumerate(state["segments"]):
            line = lambda df, order, **c: df.select(F.lit(i).alias("segment"), "shard", F.lit(order).alias("kind"), *[F.col(c[n]).alias(n) if n in c else F.lit(None).cast(t).alias(n) for n, t in columns])  # noqa: E731, B023
            parts = [line(self._shards(s), 0, counts="lengths", ids="ids", cjk="cjk"), line(blocks(s), 2, most="most", places="places", counts="counts", **{name: name})]
            if s["dead"]:
                parts.append(line(self._dead(s).groupBy("shard").agg(F.collect_list("place").alias("places")), 1, places="places"))  # SHARD places at most
            for p in parts:
                rows = p if rows is None else rows.unionByName(p)
        return rows.repartition(*[self._partitions()][: int(fixed)], "segment", "shard").sortWithinPartitions("shard", "segment", "kind")

    # Reading

    def _shards(self, s: dict, kind: str | None = None) -> DataFrame:
        kind = kind or self.log.state()[1].get("kind") or "bigint"
        return self.spark.read.schema(_SHARD.format(kind)).parquet(s["path"]).where(F.col("folder") == SHARDS).drop("folder")

    def _blocks(self, s: dict) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(s["path"]).where(F.col("folder") != SHARDS)

    def _dead(self, s: dict) -> DataFrame:
        return self.spark.read.schema(_DEAD).parquet(*s["dead"])

    def _points(self, s: dict) -> DataFrame:
        """Live vectors of a segment."""
        rows = self.spark.read.schema(_POINT.format(self.log.state()[1].get("kind") or "bigint")).parquet(f"{s['path']}-points")
        return rows.join(self._dead(s), ["shard", "place"], "left_anti") if s["dead"] else rows

    def points(self) -> DataFrame:
        """(chunk_id, vector) of every live chunk that has one."""
        _, state = self.log.state()
        out = self.spark.createDataFrame([], f"chunk_id {state.get('kind') or 'bigint'}, vector array<double>")
        for s in state.get("segments", []):
            if s.get("points"):
                out = out.unionByName(self._points(s).select("chunk_id", "vector"))
        return out

    def words_of(self, terms: DataFrame, folders: list[int], s: dict) -> DataFrame:
        """The blocks of a batch's words (word int, term) in a segment."""
        return self._blocks(s).where(F.col("folder").isin(folders)).join(F.broadcast(terms), "term")

    def frequencies(self, terms: DataFrame, folders: list[int], state: dict) -> dict[int, int]:
        """In how many live chunks each word stands; blocks of shards with dead chunks are counted place by place."""
        out: Counter = Counter()
        for s in state["segments"]:
            b = self.words_of(terms, folders, s)
            n = F.col("n")
            if s["dead"]:
                dead = self._dead(s).groupBy("shard").agg(F.collect_list("place").alias("gone"))  # SHARD places at most
                b = b.join(dead, "shard", "left")
                n = F.when(F.col("gone").isNull(), F.col("n")).otherwise(F.size(F.array_except("places", F.coalesce("gone", F.array().cast("array<int>")))))
            for r in b.groupBy("word").agg(F.sum(n).alias("n")).collect():  # a row a word of the batch
                out[r["word"]] += r["n"]
        return out

    def search(self, queries: DataFrame, k: int, every: bool = False, idf: bool = False) -> DataFrame:
        """The k best chunks of each query (query_id, query), with the query's words that each holds (matched) and whether its text has CJK.

        Scores are those of retrieval.lexical(); with every only chunks that hold all words of the query, with idf those
        of retrieval.sparse(). Queries are a stated batch of at most MAX_QUERIES; more go through in slices.
        """
        asked = queries.select("query_id", "query").limit(MAX_QUERIES + 1).toPandas()
        if len(asked) > MAX_QUERIES:
            return _sliced(queries, lambda q: self.search(q, k, every, idf))
        _, state = self.log.state()
        words: dict[str, int] = {}
        batch = []
        for i, b in zip(asked["query_id"].tolist(), asked["query"].tolist(), strict=True):
            c, _ = counted_terms(b or "")
            batch.append((i, [(words.setdefault(w, len(words)), n) for w, n in c.items()]))
        hits = _HITS.format(state.get("kind") or "bigint")
        schema = hits + ", rank int"
        if not words or not state.get("segments"):
            return self.spark.createDataFrame([], schema)
        terms = self.spark.createDataFrame(pd.DataFrame({"term": list(words), "word": np.arange(len(words), dtype=np.int32)}), "term string, word int")
        folders = sorted({folder_of(w, self.folders) for w in words})
        weights = np.ones(len(words))
        if idf:
            n = sum(s["chunks"] - s["n_dead"] for s in state["segments"])
            df = self.frequencies(terms, folders, state)
            weights = np.array([np.log((n + 1) / (df[j] + 1)) + 1 for j in range(len(words))])
        dealt = self._dealt(state, lambda s: self.words_of(terms, folders, s), "word int")
        scored = bounded(dealt).mapInPandas(_Search(batch, list(words), weights, k, every, idf).run, hits)
        return top(scored, k)


class _Search:
    """The batch, and MaxScore over the shards of a task."""

    def __init__(self, batch: list, words: list[str], weights: np.ndarray, k: int, every: bool, idf: bool):
        self.batch, self.words, self.weights, self.k, self.every, self.idf = batch, words, weights, k, every, idf

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = defaultdict(list)  # of each query the k best hits of the shards so far
        at, held = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.segment, r.shard) != at:
                    self._shard(held, best)
                    at, held = (r.segment, r.shard), []
                held.append(r)
        self._shard(held, best)
        rows = [(self.batch[q][0], item, score, [self.words[w] for w, x in zip(words, row.tolist(), strict=True) if x], cjk) for q, hits in best.items() for score, item, words, row, cjk in hits]
        names = ["query_id", "chunk_id", "score", "matched", "cjk"]
        for i in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[i : i + 10_000], columns=names)

    def _shard(self, held: list, best: dict) -> None:
        if not held or held[0].kind != 0 or held[-1].kind != 2:
            return
        ids, lengths, cjk = np.asarray(held[0].ids), np.asarray(held[0].counts, float), np.asarray(held[0].cjk, bool)
        root = np.sqrt(np.maximum(lengths, 1.0))
        alive = np.ones(len(ids), bool)
        blocks = {}
        for r in held[1:]:
            if r.kind == 1:
                alive[np.asarray(r.places, int)] = False
            else:
                counts = np.asarray(r.counts, float)
                blocks[int(r.word)] = (np.asarray(r.places, int), counts, float(counts.max()) if self.idf else r.most)
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # ties go to the smaller id
        for q, (_, asked) in enumerate(self.batch):
            mine = [(n * self.weights[w] * blocks[w][2], n * self.weights[w], w) for w, n in asked if w in blocks]
            if not mine or (self.every and len(mine) < len(asked)):
                continue
            mine.sort(reverse=True)
            left = sum(b for b, _, _ in mine) * (1 + 1e-9)
            have = best.get(q, ())
            least = have[-1][0] if len(have) == self.k else 0.0
            if left < least - 1e-6:
                continue
            total, seen, open_ = np.zeros(len(ids)), np.zeros(len(ids), np.int32), True
            for bound, n, w in mine:
                places, counts, _ = blocks[w]
                if open_ and left < least - 1e-6:  # what has none of the words so far can't reach the k best any more
                    open_, candidates = False, np.flatnonzero(seen)
                if not open_ and len(candidates) * 8 < len(places):
                    x = np.searchsorted(places, candidates)
                    hit = (x < len(places)) & (places[np.minimum(x, len(places) - 1)] == candidates)
                    total[candidates[hit]] += n * counts[x[hit]]
                    seen[candidates[hit]] += 1
                else:
                    total[places] += n * counts
                    seen[places] += 1
                left -= bound
            score = np.round(total, 6) if self.idf else total / root
            able = alive & (seen == len(asked) if self.every else seen > 0) & (score >= least) & (score > 0)
            found = np.flatnonzero(able)
            if len(found) > self.k:
                cut = np.partition(score[found], len(found) - self.k)[len(found) - self.k]
                found = found[score[found] >= cut]
            found = found[np.lexsort((rank[found], -score[found]))][: self.k]
            if not len(found):
                continue
            holds = np.zeros((len(found), len(mine)), bool)  # which words of the query stand in which hit
            for i, (_, _, w) in enumerate(mine):
                p = blocks[w][0]
                holds[:, i] = p[np.minimum(np.searchsorted(p, found), len(p) - 1)] == found
            words = [w for _, _, w in mine]
            new = [(s, item, words, row, c) for s, item, row, c in zip(score[found].tolist(), ids[found].tolist(), holds, cjk[found].tolist(), strict=True)]
            best[q] = sorted([*have, *new], key=lambda h: (-h[0], h[1]))[: self.k]


def fingerprint(df: DataFrame) -> str:
    """What the files under a table are: paths, lengths and times of change. Another one means that a stored index is out of date."""
    spark = df.sparkSession
    path, out = spark._jvm.org.apache.hadoop.fs.Path, []
    for name in sorted(df.inputFiles()):
        p = path(name)
        st = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append(f"{name}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def stored_index(chunks: DataFrame, root: str) -> LexicalIndex:
    """The index of a table of files, built where there is none for these files."""
    note = fingerprint(chunks)
    index = LexicalIndex(chunks.sparkSession, f"{root.rstrip('/')}/lexical2-{note[:32]}")
    if index.log.state()[1].get("note") != note:
        index.build(chunks, note)
    return index

