"""Token ids in sharded binary files: each document is a zstandard frame of its own under one shared dictionary.

A shard holds frames, then an index (doc ids, offsets, lengths in tokens) and a footer with the dictionary's hash, the
width of an id and the place of the index, so that one short document can be read without the others. Documents are
range-partitioned by doc_id, so shards follow each other in ascending order. A shard is written under a temporary name
and renamed when whole; its name depends on the partition alone, so a task that runs again replaces it. manifest.json
is written last.

Null texts are empty: a document with the end id alone. Rows with the same doc_id stand next to each other in order of a
hash of the text; rows without doc_id come first, dealt by that hash. Texts of any length are one frame each. Extra columns
are ignored. No rows: no shards and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.llm import fasttok
from larkspire.llm.common import commit_bytes, discard, filesystem, fresh_dir, mapped_arrow, shuffle_partitions, stored

MAGIC = b"LSTOKENS"
END_ID = 2
#: The dictionary is trained on so many documents of least hash, so many characters from a hashed place in each, and has so many bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 600, 4000, 64 * 1024
SHARD_BYTES = 64 << 20
LEVEL = 3
#: Bytes of ids in a batch that is read, and of texts that are encoded together (one longer text is encoded alone).
BATCH_BYTES, GATHERED_BYTES = 4 << 20, 8 << 20

_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


def train(docs: DataFrame, vocab: str, end_id: int = END_ID, text: str = "text") -> bytes:
    """A dictionary trained on id arrays of a bounded sample; where there is too little to train on, the sample itself is the dictionary (raw content)."""
    n, h = F.length(text), F.xxhash64(F.lit(7), text)
    place = (F.pmod(h, F.greatest(n - SAMPLE_CHARS, F.lit(0)) + 1) + 1).cast("int")
    least = F.min(F.struct(h.alias("h"), F.substr(F.col(text), place, F.lit(SAMPLE_CHARS)).alias("t"))).alias("least")
    # A row for each hash bucket: tasks send what is left of their partial aggregates, the driver gets SAMPLE_DOCS rows.
    rows = docs.where(F.length(text) > 0).groupBy(F.pmod(F.xxhash64(text), F.lit(SAMPLE_DOCS))).agg(least).select("least.*").orderBy("h", "t").collect()
    enc = fasttok.ByteBpe(vocab)  # not one that is kept: what the driver keeps would go along with every task
    samples = [_pack(enc.ids(r["t"]) + struct.pack("<I", end_id), 2) for r in rows]
    samples = [s[i : i + 2048] for s in samples for i in range(0, len(s), 2048)]
    if sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    return raw + _pack(struct.pack("<I", end_id), 2) * 8


def _pack(ids: bytes | np.ndarray, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together while they are small: the more texts, the more of what they hold is the same."""
    some, size = [], 0
    for b in batches:
        if some and size + b.nbytes > GATHERED_BYTES:
            yield pa.Table.from_batches(some)
            some, size = [], 0
        some.append(b)
        size += b.nbytes
    if some:
        yield pa.Table.from_batches(some)


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


class _Shard:
    """A shard being written: bytes go out as they come, the index stays in memory (24 bytes a document)."""

    def __init__(self, uri: str):
        self.uri, (self.fs, self.path) = uri, filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.tmp-{np.random.SeedSequence().entropy:x}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(MAGIC)
        self.at, self.index, self.tokens = len(MAGIC), [], 0

    def add(self, doc_id, frame: bytes, n: int) -> None:
        self.index.append((0 if doc_id is None else int(doc_id), doc_id is None, self.at, n))
        self.out.write(frame)
        self.at += len(frame)
        self.tokens += n

    def close(self, dictionary_hash: str, width: int) -> tuple:
        ids, none, offsets, lengths = (np.array(x, t) for x, t in zip(zip(*self.index, strict=True), ("<i8", "u1", "<u8", "<u8"), strict=True))
        index = zstandard.compress(ids.tobytes() + offsets.tobytes() + lengths.tobytes() + none.tobytes())
        footer = json.dumps({"dictionary": dictionary_hash, "width": width, "docs": len(ids), "tokens": self.tokens, "index_at": self.at, "index_bytes": len(index)}).encode()
        self.out.write(index + footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.uri, len(ids), self.tokens, self.at


def write(docs: DataFrame, out_dir: str, vocab: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Writes all documents and returns the manifest: one entry a shard, in order, with the ids before it (start)."""
    spark = docs.sparkSession
    raw = train(docs, vocab, end_id, text)
    digest = hashlib.sha256(raw).hexdigest()
    commit_bytes(f"{out_dir}/dictionary-{digest[:16]}.zdict", [raw])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), fasttok.encoder(fasttok.ByteBpe, vocab)
        width = 2 if enc.whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(raw), write_checksum=False)
        end, shard, made = _pack(struct.pack("<I", end_id), width), None, []
        for some in _gathered(batches):
            for d, ids in zip(some["d"].to_pylist(), enc.all_ids(some["t"].combine_chunks()), strict=True):
                shard = shard or _Shard(f"{out_dir}/part-{part:06d}-{len(made):04d}.tok")
                shard.add(d, packer.compress(_pack(ids, width) + end), len(ids) + 1)
                if shard.at >= shard_bytes:
                    made.append(shard.close(digest, width))
                    shard = None
        if shard:
            made.append(shard.close(digest, width))
        for i, (path, n_docs, n_tokens, n_bytes) in enumerate(made):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([i], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [n_bytes]})

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    # Ranges are cut by (id, hash), so that a third of all rows may lack an id or share one.
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(shuffle_partitions(spark), "d", "h").sortWithinPartitions("d", "h", "t").drop("h")
    manifest, start = [], 0
    shards = stored(mapped_arrow(ordered, run, _MANIFEST, "fasttok"), "token-manifest")
    for r in shards.orderBy("part", "seq").collect():  # one short row a shard
        manifest.append(r.asDict() | {"start": start})
        start += r["n_tokens"]
    discard(shards)
    commit_bytes(f"{out_dir}/manifest.json", [json.dumps({"dictionary": digest, "end_id": end_id, "shards": manifest}).encode()])
    return manifest


def _open(uri: str):
    where, path = filesystem(uri)
    f = where.open_input_file(path)
    size = f.size()
    f.seek(size - 12)
    tail = f.read(12)
    if tail[4:] != MAGIC:
        raise ValueError(f"{uri} is no whole token file")
    n = struct.unpack("<I", tail[:4])[0]
    f.seek(size - 12 - n)
    return f, json.loads(f.read(n))


def _index(f, foot: dict):
    f.seek(foot["index_at"])
    raw, n = zstandard.decompress(f.read(foot["index_bytes"])), foot["docs"]
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, "<u8", n, 16 * n), np.frombuffer(raw, "u1", n, 24 * n)


def _dictionary(uri: str, digest: str) -> bytes:
    where, path = filesystem(f"{uri.rpartition('/')[0]}/dictionary-{digest[:16]}.zdict")
    with where.open_input_file(path) as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("the dictionary isn't the one that the shard was written with")
    return raw


def _unpack(frame: bytes, unpacker, width: int) -> bytes:
    raw = unpacker.decompress(frame)
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw


def read_one(uri: str, doc_id: int) -> np.ndarray:
    """One document's ids: reads the footer, the index and that document's frame alone."""
    f, foot = _open(uri)
    with f:
        ids, offsets, _, none = _index(f, foot)
        hits = np.flatnonzero((ids == doc_id) & (none == 0))
        if not len(hits):
            raise KeyError(doc_id)
        i = int(hits[0])
        f.seek(int(offsets[i]))
        end = int(offsets[i + 1]) if i + 1 < len(offsets) else foot["index_at"]
        unpacker = zstandard.ZstdDecompressor(dict_data=_dict(_dictionary(uri, foot["dictionary"])))
        return np.frombuffer(_unpack(f.read(end - int(offsets[i])), unpacker, foot["width"]), "<u4")


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpackers: dict[str, zstandard.ZstdDecompressor] = {}
        for b in batches:
            for uri, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                f, foot = _open(uri)
                with f:
                    ids, offsets, lengths, none = _index(f, foot)
                    if foot["dictionary"] not in unpackers:
                        unpackers[foot["dictionary"]] = zstandard.ZstdDecompressor(dict_data=_dict(_dictionary(uri, foot["dictionary"])))
                    bounds = [*offsets.tolist(), foot["index_at"]]
                    ends = np.cumsum(lengths.astype("i8"))
                    starts = int(start) + ends - lengths.astype("i8")
                    f.seek(bounds[0])
                    i = 0
                    while i < len(ids):  # as many documents as a batch has room for, one at least
                        j = max(i + 1, int(np.searchsorted(ends, ends[i] - int(lengths[i]) + BATCH_BYTES // 4, "right")))
                        block, unpack = f.read(bounds[j] - bounds[i]), unpackers[foot["dictionary"]].decompress
                        docs = [unpack(block[bounds[k] - bounds[i] : bounds[k + 1] - bounds[i]]) for k in range(i, j)]
                        sizes = np.array([len(x) for x in docs]) // foot["width"]
                        wrong = np.flatnonzero(sizes != lengths[i:j])
                        if len(wrong):
                            raise ValueError(f"{uri}: document {i + int(wrong[0])} has another length than its index says")
                        data = np.frombuffer(b"".join(docs), f"<u{foot['width']}").astype("<u4")
                        at = np.concatenate([[0], np.cumsum(4 * sizes)]).astype("<i4")
                        binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(data)])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], mask=none[i:j] != 0), pa.array(starts[i:j]), pa.array(sizes.astype("i8")), binary], names=["doc_id", "start", "n_tokens", "ids"])
                        i = j

    return mapped_arrow(shards.repartition(max(1, min(len(manifest), 10_000))), run, schema, "fasttok")


def digest(docs: DataFrame, vocab: str) -> DataFrame:
    spark = docs.sparkSession
    manifest = write(docs, fresh_dir(spark, "tokens"), vocab)
    return read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
