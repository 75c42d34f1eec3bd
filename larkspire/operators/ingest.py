"""Ingestion: parser and chunker contracts, blocks to chunks, metadata, reuse against the last snapshot, publication."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspire.functions.text import epoch, next_version
from larkspire.functions.vector import point_id
from larkspire.operators import chunking, snapshot
from larkspire.session import bounded

LEXICAL_VERSION = "1"
# The strategies of the chunkers and parsers that come with the engine, the first of each the usual one.
CHUNKERS = {"plain": ("fixed", "structural"), "recursive": ("recursive", "code"), "sentence": ("sentence",)}
PARSERS = {"plain": ("text", "html"), "office": ("document",), "pdf": ("pages",)}
# Endings and media types by which a parser is chosen.
OFFICE = (".docx", ".pptx", ".xlsx")
HTML_TYPES = ("text/html", "application/xhtml+xml")


def contract(value: dict) -> str:
    """The first 20 digits of the SHA-256 of a configuration as canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]


@dataclass(frozen=True)
class Chunking:
    provider: str = "plain"
    strategy: str = "fixed"
    version: int = 1
    size: int = chunking.SIZE
    overlap: int = chunking.OVERLAP
    language: str | None = None
    coalesce: bool = False
    target: int = 0
    respect_page: bool = True
    respect_section: bool = True

    @property
    def config_hash(self) -> str:
        return contract(asdict(self))


def chunking_spec(config: dict | None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, language: str | None = None) -> Chunking:
    """A source's chunking configuration with its defaults; what isn't known is an error. Coalescing aims at four times the size."""
    raw = dict(config or {})
    provider = str(raw.get("provider") or "plain").strip().lower()
    if provider not in CHUNKERS:
        raise ValueError(f"no chunker {provider}; there are {sorted(CHUNKERS)}")
    strategy = str(raw.get("strategy") or CHUNKERS[provider][0]).strip().lower()
    if strategy not in CHUNKERS[provider]:
        raise ValueError(f"no strategy {strategy} of {provider}; there are {sorted(CHUNKERS[provider])}")
    n, shared = int(raw.get("chunk_size", size)), int(raw.get("chunk_overlap", overlap))
    if not 0 <= shared < n:
        raise ValueError("chunk_overlap must be less than chunk_size")
    blocks = raw.get("block_coalescing") or {}
    target = int(blocks.get("target_chars", 4 * n))
    if target < 1:
        raise ValueError("target_chars must be positive")
    return Chunking(provider, strategy, int(raw.get("version", 1)), n, shared, language and language.strip().lower(), bool(blocks.get("enabled", False)), target, bool(blocks.get("respect_page", True)), bool(blocks.get("respect_section", True)))


def parser(name: Column, media_type: Column) -> Column:
    """(provider, strategy) of the parser for a name and a media type."""
    suffix = F.lower(F.regexp_extract(name, "(\\.[^./]+)$", 1))
    media = F.lower(F.trim(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1))))
    pick = lambda p, s: F.struct(F.lit(p).alias("provider"), F.lit(s).alias("strategy"))
    office = suffix.isin(*OFFICE) | media.startswith("application/vnd.openxmlformats-officedocument.")
    return F.when((suffix == ".pdf") | (media == "application/pdf"), pick("pdf", "pages")).when(office, pick("office", "document")).when(suffix.isin(".html", ".htm") | media.isin(*HTML_TYPES), pick("plain", "html")).otherwise(pick("plain", "text"))


SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, stripped: bool = True) -> list[str]:
    """Parts of at most size characters, without white space at their ends: at the first separator that the text has, what is too long at the next; neighbours are joined up to size, and overlap characters of whole parts are kept."""

    def cut(s: str, seps: tuple[str, ...]) -> list[str]:
        if len(s) <= size:
            return [s]
        sep = next((x for x in seps if x in s), "")
        rest = seps[seps.index(sep) + 1 :] if sep else ()
        if not sep:
            return [s[i : i + size] for i in range(0, len(s), size)]
        pieces = s.split(sep)
        return [y for i, x in enumerate(pieces) for y in cut(x + sep * (i < len(pieces) - 1), rest)]

    out: list[str] = []
    held: list[str] = []
    n = 0
    for piece in cut(text, separators):
        more = len(piece.rstrip())  # white space at the end of a part doesn't count
        if held and n + more > size:
            out.append("".join(held))
            while held and (n > overlap or n + more > size):
                n -= len(held.pop(0))
        held.append(piece)
        n += len(piece)
    if held:
        out.append("".join(held))
    return [x.strip() for x in out if x.strip()] if stripped else out


_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s|\Z)|[。！？]+|\n+|\Z)\s*", re.S)


def sentence_split(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences up to size characters, with whole sentences of at most overlap characters shared; a longer sentence is cut recursively."""
    out: list[str] = []
    held: list[str] = []
    for sentence in (p for s in _SENTENCE.findall(text) for p in ([s] if len(s.rstrip()) <= size else recursive_split(s, size, 0, stripped=False))):
        more = len(sentence.rstrip())
        if held and sum(map(len, held)) + more > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + more > size):
                held.pop(0)
        held.append(sentence)
    if held:
        out.append("".join(held))
    return [x.strip() for x in out if x.strip()]


def relocated(text: str, parts: list[str]) -> list[tuple[int, int]]:
    """First and last line of each part of a text: found from the end of the one before, or anywhere, or put there."""
    out, at = [], 0
    for p in parts:
        i = text.find(p, at)
        i = i if i >= 0 else text.find(p)
        i = i if i >= 0 else at
        out.append((text.count("\n", 0, i) + 1, text.count("\n", 0, i + len(p)) + 1))
        at = max(at, i + len(p))
    return out


def split(rows: DataFrame, spec: Chunking, body: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row a part of each row's text: the other columns, place (from 0), text, line_start and line_end."""
    rest = [c for c in rows.columns if c != body] if keep is None else keep
    if spec.provider == "plain":
        parts = rows.select(*rest, F.col(body).alias("__body"), F.posexplode(chunking.windows(F.coalesce(body, F.lit("")), spec.size, spec.overlap)).alias("place", "w"))
        before = F.substring("__body", 1, F.col("w.start"))
        lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
        return parts.select(*rest, "place", F.col("w.text").alias("text"), (lines(before) + 1).alias("line_start"), (lines(before) + lines(F.col("w.text")) + 1).alias("line_end"))
    how = recursive_split if spec.provider == "recursive" else sentence_split

    @F.pandas_udf("array<struct<text:string,line_start:int,line_end:int>>")
    def cut(s: pd.Series) -> pd.Series:
        def one(t):
            parts = how(t or "", spec.size, spec.overlap)
            return [{"text": p, "line_start": a, "line_end": b} for p, (a, b) in zip(parts, relocated(t or "", parts), strict=True)]

        return s.map(one)

    return bounded(rows).select(*rest, F.posexplode(cut(F.col(body))).alias("place", "w")).select(*rest, "place", "w.text", "w.line_start", "w.line_end")


def segments(blocks: DataFrame, key: str, spec: Chunking) -> DataFrame:
    """Parser blocks (coalesced first, if the contract says so) to chunks with their block, page, section and contract."""
    blocks = blocks if "page" in blocks.columns else blocks.withColumn("page", F.lit(None).cast("int"))
    if spec.coalesce:
        blocks = chunking.coalesced(blocks, key, spec.target, spec.respect_page, spec.respect_section).drop("sources")
    parts = split(blocks.select(key, "block_index", "kind", "page", "section", "text"), spec).where(F.trim("text") != "")
    order = F.row_number().over(_window(key)) - 1
    return parts.withColumn("chunk_index", order).withColumns({"checksum": F.sha2("text", 256), "chunker_config_hash": F.lit(spec.config_hash)}).drop("place")


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("block_index", "place")


def stamped(chunks: DataFrame, source: dict, now: Column, model: str | None = None, dimension: int | None = None, contract_id: str | None = None) -> DataFrame:
    """Chunks with their source's attributes, versions, embedding identity and times."""
    version = F.coalesce("version", F.lit(source.get("version", "1.0"))) if "version" in chunks.columns else F.lit(source.get("version", "1.0"))
    out = chunks.withColumns({
        "source_id": F.lit(source["source_id"]), "source_type": F.lit(source["source_type"]), "tags": F.array(*map(F.lit, source.get("tags", ()))).cast("array<string>"),
        "acl_hash": F.lit(source.get("acl_hash", "public")), "version": version, "lexical_version": F.lit(LEXICAL_VERSION), "ingested_at": now, "doc_updated_at": now,
    })
    names = {"embedding_model": model, "embedding_dimension": dimension, "embedding_contract_id": contract_id}
    return out.withColumns({k: F.lit(v) for k, v in names.items() if v is not None})


def tagged(chunks: DataFrame, source_id: str, generation_id: str) -> DataFrame:
    return chunks.withColumns({"source_id": F.lit(source_id), "generation_id": F.lit(generation_id)})


# The columns that must all be equal for a chunk to be taken over from the last snapshot.
REUSE = (
    "doc_id chunk_index checksum path url page section source_type tags acl_hash version remote_version lexical_version parser_provider parser_strategy parser_version parser_config_hash "
    "chunker_provider chunker_strategy chunker_version chunker_config_hash embedding_contract_id embedding_model embedding_dimension"
).split()


def complete(chunks: DataFrame) -> DataFrame:
    """chunks with every column of the reuse key; those that it lacks are null, null tags none, a null ACL public."""
    out = chunks.withColumns({c: F.lit(None).cast("string") for c in REUSE if c not in chunks.columns and c != "tags"})
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in chunks.columns else F.array().cast("array<string>")
    return out.withColumns({"tags": tags, "acl_hash": F.coalesce("acl_hash", F.lit("public"))})


#: Where a chunk's text is dealt once for all of an ingestion: a hash of what both its repeats and its predecessor share with it.
AT = "__at"


def _placed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn(AT, F.xxhash64(F.col("doc_id").cast("string"), F.col("checksum").cast("string")))


def reused(candidate: DataFrame, previous: DataFrame, existing: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """candidate with chunk_id, point_id and created_at of the previous chunk that is equal in all columns of REUSE (of several the last by chunk_id), and whether there is one.

    What is looked up is put together by AT without any text, so the candidate's rows, if they are dealt by it, aren't
    shuffled again. With existing (doc_id, version) and pairs (doc_id, AT) of all chunks, document_version is the raised
    version of the chunk's document, null where the document isn't among the existing ones.
    """
    inherited = ["chunk_id", "point_id", "created_at"]
    new, old = (_placed(complete(x)) if AT not in x.columns else complete(x) for x in (candidate, previous))
    key = F.unhex(snapshot.reuse_key([c if c != "tags" else "__tags" for c in REUSE]))
    new, old = (x.withColumn("__tags", F.to_json("tags")).withColumn("__key", key).drop("__tags") for x in (new, old))
    # The first field is the key, the second the chunk's id, so the greatest entry of a key is the last by id.
    known = old.select(AT, F.struct("__key", *inherited).alias("__old"), F.lit(None).cast("struct<d:string,v:string>").alias("__doc"))
    if pairs is not None:
        raised = existing.where("version IS NOT NULL").select("doc_id", next_version(F.col("version")).alias("__v"))
        known = known.unionByName(pairs.join(raised, "doc_id").select(AT, F.lit(None).cast(known.schema["__old"].dataType).alias("__old"), F.struct(F.col("doc_id").cast("string").alias("d"), F.col("__v").alias("v")).alias("__doc")))
    known = known.groupBy(AT).agg(F.collect_list("__old").alias("__olds"), F.collect_set("__doc").alias("__docs"))
    joined = new.join(known, AT, "left").withColumn("__old", F.array_max(F.filter("__olds", lambda x: x["__key"] == F.col("__key"))))
    hit = F.col("__old").isNotNull()
    version = [] if pairs is None else [F.filter("__docs", lambda x: x["d"] == F.col("doc_id").cast("string")).alias("__docs")]
    out = [c for c in new.columns if c not in (*inherited, AT, "__key")]
    return joined.select(*out, *[F.when(hit, F.col("__old")[c]).otherwise(F.col(c) if c in new.columns else F.lit(None)).alias(c) for c in inherited], hit.alias("reused"), *version)


def payload(chunks: DataFrame, model: str = "hash-64") -> DataFrame:
    """The rows of the vector store: point_id and the payload of a chunk; times also in seconds, a null ACL is public."""
    c = complete(chunks)
    ts = lambda name: epoch(F.col(name).cast("string")).alias(f"{name}_ts")
    plain = [F.col(x) if x in c.columns else F.lit(None).cast("string").alias(x) for x in ("chunk_id", "tenant_id", "source_id", "generation_id", "source_type", "doc_id", "chunk_index", "path", "url", "page", "section", "ingested_at", "doc_updated_at", "version", "checksum", "acl_hash", "tags", "block_index", "block_kind", "chunker_config_hash", "parser_config_hash", "embedding_dimension", "embedding_contract_id", "text")]
    times = [ts(x) if x in c.columns else F.lit(None).cast("double").alias(f"{x}_ts") for x in ("ingested_at", "doc_updated_at")]
    stored = F.col("point_id") if "point_id" in c.columns else F.lit(None).cast("string")
    return c.select(point_id(stored, F.col("chunk_id")).alias("point_id"), F.struct(*plain, *times, F.lit(model).alias("embedding_model")).alias("payload"))


def documents(chunks: DataFrame, existing: DataFrame, source: dict) -> DataFrame:
    """A document for each doc_id, from its first chunk: title and place by name or path, the version of one that exists already raised."""
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct("path", "url"), "chunk_index").alias("f"), F.count("*").alias("chunk_count"))
    name = F.nullif(F.regexp_extract(F.coalesce("f.path", "f.url"), "([^/]+)/*$", 1), F.lit(""))
    fallback = F.concat(F.lit(f"source://{source['source_id']}/"), F.col("doc_id").cast("string"))
    old = existing.select("doc_id", F.col("version").alias("__v"))
    version = F.when(F.col("__v").isNotNull(), next_version(F.col("__v"))).otherwise(F.lit(source.get("version", "1.0")))
    return first.join(old, "doc_id", "left").select("doc_id", F.coalesce(name, F.lit(source.get("name"))).alias("title"), F.coalesce("f.url", "f.path", fallback).alias("uri"), version.alias("version"), "chunk_count", F.lit(source["source_id"]).alias("source_id"), F.lit("active").alias("status"))


@dataclass
class Outcome:
    """A run's tables: all chunks of the new generation, and which of them are new, taken over, and gone."""

    current: DataFrame
    written: DataFrame
    stale: DataFrame
    removed_documents: DataFrame
    documents: DataFrame


def ingested(candidate: DataFrame, previous: DataFrame, existing: DataFrame, source: dict, generation_id: str, now: Column, versions: bool = False) -> Outcome:
    """One ingestion against the last snapshot: stamp, drop repeats within a document, reuse, derive documents, find what is gone. candidate: doc_id, chunk_index, text, checksum, path, url. With versions the chunks have the document_version of theirs. Texts are shuffled once."""
    c = _placed(stamped(candidate, source, now))
    pairs = c.select("doc_id", AT) if versions else None
    c = chunking.deduplicated(c.repartition(AT), AT)
    c = c.withColumn("chunk_id", F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "checksum"), 256)).withColumns({"point_id": F.lit(None).cast("string"), "created_at": now})
    found = tagged(reused(c, previous, existing, pairs), source["source_id"], generation_id)
    found = found.withColumn("point_id", point_id(F.col("point_id"), F.col("chunk_id")))
    if versions:
        found = found.withColumn("document_version", F.when(F.size("__docs") > 0, F.col("__docs")[0]["v"]).otherwise(F.lit(source.get("version", "1.0")))).drop("__docs")
    gone = previous.select("doc_id").distinct().join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return Outcome(found, found.where("NOT reused"), snapshot.stale(previous, found), gone, documents(found, existing, source))


def embedded(rows: DataFrame, embed, body: str = "text", out: str = "vector", prefix: str = "") -> DataFrame:
    """rows with the vector of each text, every distinct text embedded once and joined back by its SHA-256. embed is a Column -> Column, as pandas UDFs are; prefix is the instruction of the role."""
    key = F.sha2(F.coalesce(body, F.lit("")), 256)
    once = rows.select(key.alias("__k"), F.coalesce(body, F.lit("")).alias("__t")).dropDuplicates(["__k"])
    made = once.select("__k", embed(F.concat(F.lit(prefix), F.col("__t"))).alias(out))
    return rows.withColumn("__k", key).join(made, "__k").drop("__k")


def batches(rows: Iterator[pd.DataFrame], most_rows: int, most_bytes: int, body: str = "text") -> Iterator[pd.DataFrame]:
    """Slices of at most so many rows and bytes of text; a longer text is a slice of its own."""
    for pdf in rows:
        size = pdf[body].fillna("").map(lambda t: len(t.encode())).tolist()
        a, total = 0, 0
        for i, n in enumerate(size):
            if i > a and (i - a >= most_rows or total + n > most_bytes):
                yield pdf.iloc[a:i]
                a, total = i, 0
            total += n
        if a < len(pdf):
            yield pdf.iloc[a:]


def batch_embedder(encode, dimension: int, most_rows: int = 64, most_bytes: int = 1 << 20):
    """A pandas UDF over encode(list of texts) -> list of vectors, called for slices bounded by rows and bytes; counts and dimensions are checked."""

    @F.pandas_udf("array<double>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out = []
            for part in batches([s.to_frame("text").reset_index(drop=True)], most_rows, most_bytes):
                texts = part["text"].fillna("").tolist()
                vectors = encode(texts)
                if len(vectors) != len(texts) or any(len(v) != dimension for v in vectors):
                    raise ValueError(f"an embedder must give {dimension} numbers for each text")
                out += [list(map(float, v)) for v in vectors]
            yield pd.Series(out, dtype=object)

    return embed
