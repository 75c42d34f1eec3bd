"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id, a shard is a run of gzip members (one a record, as the format asks for) and a new
file begins when the compressed size passes roll_bytes. Headers and digests are made anew from the payload; nothing
depends on the clock or on chance. Files are written under temporary names and renamed when whole; manifest.json comes
last and lists the files with their sizes, counts and SHA-256.

Records with equal payloads of at least MIN_REVISIT bytes: those with the smallest page_id are responses, the others
revisits without payload, which name the response's page. A null html is an empty payload, a null url an empty one (with
control characters and spaces percent-encoded). Repeated rows become repeated records with ids of their own. Rows without
page_id are written as responses, after a hash of their content instead of the id. A record is held whole, so a very long
page costs memory in proportion to its length. An empty table gives no files and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.llm.common import commit_bytes, discard, filesystem, fresh_dir, ints, key, keyed, mapped, shuffle_partitions, stored

MIN_REVISIT = 100
ROLL_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
#: The first pages of repeated digests are broadcast up to so many bytes; beyond that each digest is dealt to so many salts.
BROADCAST_BYTES, SALTS = 16 << 20, 64
_SPACE = uuid.UUID("6f1b1c1e-6d1f-5a37-9d0c-4c2a1f7f8a55")
_MANIFEST = "part int, seq int, path string, n_records long, n_bytes long, sha256 string"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")


def _record_id(page_id, digest: str, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}{copy}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, copy: str = "") -> bytes:
    """copy tells further records of one page and payload apart."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    """A member without time or name, so that equal records are equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


class _File:
    def __init__(self, uri: str):
        self.uri, (self.fs, self.path) = uri, filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temp = f"{self.path}.tmp-{uuid.uuid4().hex}"
        self.out, self.at, self.n, self.hash = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        info = b"software: larkspire\r\nformat: WARC File Format 1.1\r\n"
        self.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, uri.rpartition('/')[2])}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")
        self.n = 0

    def add(self, raw: bytes) -> None:
        b = _gzip(raw)
        self.out.write(b)
        self.hash.update(b)
        self.at += len(b)
        self.n += 1

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.uri, self.n, self.at, self.hash.hexdigest()


def write(pages: DataFrame, out_dir: str, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT) -> list[dict]:
    """Writes pages (page_id, url, html) and returns the manifest.

    The html is shuffled once, by range. What makes a record a revisit is worked out on (page_id, digest) alone: a partial
    aggregate finds each repeated digest's smallest page, and the rows that it changes travel beside the html as short
    notes with the same sort key, so no join carries a payload. A digest meets its pages by a broadcast of checked size or
    under salts, so its rows never meet in one task.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("h", F.xxhash64("payload"))  # ranges are cut by (page, hash), so that a third of all rows may lack an id or share one
    slim = rows.where(F.octet_length("payload") >= min_revisit).select("page_id", F.sha2("payload", 256).alias("digest"), "h")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    firsts = stored(firsts, "digests")
    if firsts.count() * 100 <= BROADCAST_BYTES:
        met = slim.join(F.broadcast(firsts), "digest")
    else:
        dealt = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        met = dealt.join(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"])
    notes = met.where("page_id > first").select("page_id", "h", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("first").alias("refers_to"), F.lit(0).alias("kind")).distinct()
    full = rows.select("page_id", "h", "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    ordered = full.unionByName(notes).repartitionByRange(shuffle_partitions(spark), "page_id", "h").sortWithinPartitions("page_id", "h", "kind", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, file, noted, at, copies = TaskContext.get().partitionId(), [], None, {}, None, Counter()
        for pdf in batches:
            for page, h, url, payload, digest, refers_to, kind in zip(map(keyed, pdf["page_id"]), pdf["h"], pdf["url"], pdf["payload"], pdf["digest"], map(keyed, pdf["refers_to"]), pdf["kind"], strict=True):
                if (page, h) != at:  # a range holds all rows of a page and a payload
                    noted, at, copies = {}, (page, h), Counter()
                if kind == 0:
                    noted[digest] = refers_to
                    continue
                file = file or _File(f"{out_dir}/part-{part:06d}-{len(made):04d}.warc.gz")
                payload = bytes(payload)
                own = hashlib.sha256(payload).hexdigest()
                copy = f":{part}:{copies[own]}" if page is None else f":{copies[own]}" * (copies[own] > 0)
                copies[own] += 1
                file.add(record(page, url if isinstance(url, str) else None, payload, noted.get(own), copy))
                if file.at >= roll_bytes:
                    made.append(file.close())
                    file = None
        if file:
            made.append(file.close())
        yield pd.DataFrame([(part, i, *m) for i, m in enumerate(made)], columns=["part", "seq", "path", "n_records", "n_bytes", "sha256"])

    sent = ordered.withColumns({c: key(F.col(c)) for c in ("page_id", "refers_to", "h")})
    files = stored(mapped(sent, run, _MANIFEST), "warc-manifest", (firsts,))
    manifest = [r.asDict() for r in files.orderBy("part", "seq").collect()]  # one short row a file
    discard(files)
    commit_bytes(f"{out_dir}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def members(f) -> Iterator[bytes]:
    """The gzip members of an archive, one record in memory at a time."""
    left = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            chunk = left or f.read(READ_BYTES)
            if not chunk:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(d.decompress(chunk))
            left = d.unused_data if d.eof else b""
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length isn't what its header says")
    return fields, rest[:n]


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes and payload_digest of every record; digests are checked."""
    files = spark.createDataFrame([(m["path"],) for m in manifest], "path string")
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                where, path = filesystem(uri)
                rows, size = [], 0
                with where.open_input_stream(path, compression=None) as f:
                    for raw in members(f):
                        h, block = parse(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != h["WARC-Block-Digest"]:
                            raise ValueError(f"{uri}: a block isn't what its digest says")
                        payload, digest, n = None, h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != n:
                                raise ValueError(f"{uri}: a payload isn't what its digest says")
                        to = h.get("X-Refers-To-Page")
                        rows.append((int(h["X-Page"]) if "X-Page" in h else None, h["WARC-Target-URI"], h["WARC-Type"], int(to) if to is not None else None, payload, n, digest))
                        size += len(block)
                        if size >= 4 * READ_BYTES:
                            yield _frame(rows)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows)

    return mapped(files.repartition(max(1, min(len(manifest), 10_000))), run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])
    return out.assign(page_id=ints(r[0] for r in rows), refers_to=ints(r[3] for r in rows))


def digest(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(pages, fresh_dir(spark, "warc"))).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
