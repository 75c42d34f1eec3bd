"""File sources: local, HDFS or object-store folders as rows of bytes or text, with suffix, size and place checks."""

from __future__ import annotations

import ipaddress
import posixpath
import socket
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes and folders of a plain-text scan, and of a code checkout.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".csv", ".log")
CODE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".rb", ".sh", ".sql", ".md")
SKIPPED = (".git", ".hg", ".svn", "node_modules", "__pycache__", "dist", "build", ".venv", "venv")
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "rb": "ruby", "md": "markdown", "sql": "sql", "sh": "bash"}
MAX_BYTES = 10 << 20


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, max_bytes: int = MAX_BYTES, max_files: int | None = None) -> DataFrame:
    """path, name, length, modified, content (cut at max_bytes, and whether it was) of the files below a folder; with max_files the first by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    low = F.lower("path")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | low.endswith(s)
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED))
    rows = rows.where(wanted & ~inside)
    if max_files is not None:
        rows = rows.orderBy("path").limit(max_files)
    return rows.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), F.substring("content", 1, max_bytes).alias("content"), (F.col("length") > max_bytes).alias("cut")
    )


def decoded(content: Column) -> Column:
    """UTF-8 text, what can't be decoded replaced, without NUL."""
    return F.replace(F.decode(content, "UTF-8"), F.lit("\x00"), F.lit(""))


def text_documents(spark: SparkSession, folder: str, doc_id: str, **how) -> DataFrame:
    """A document for each file: doc_id:name, its text, its first markdown heading as section."""
    rows = listed(spark, folder, **how)
    body = decoded(F.col("content"))
    return rows.select(F.concat(F.lit(f"{doc_id}:"), "name").alias("doc_id"), "path", body.alias("text"), F.nullif(F.regexp_extract(body, "(?m)^#{1,6}\\s+(.+)$", 1), F.lit("")).alias("section"))


def objects(spark: SparkSession, folder: str, doc_id: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, max_bytes: int = 20 << 20) -> DataFrame:
    """A document for each object of a store's folder: named by a hash of its key, with an etag; those that are too large or empty are left out."""
    rows = listed(spark, folder, suffixes, max_bytes).where(~F.col("cut") & (F.col("length") > 0))
    key = F.regexp_replace("path", "^[A-Za-z0-9]+:/+", "")
    name = F.concat(F.lit(f"{doc_id}:"), F.substring(F.sha2(key, 256), 1, 16))
    return rows.select(name.alias("doc_id"), key.alias("object_key"), F.md5("content").alias("etag"), F.col("path").alias("uri"), "name", decoded(F.col("content")).alias("text"))


def units(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of a corpus, one for each page of a file: pages are parted by form feeds."""
    rows = listed(spark, folder)
    return rows.select("path", F.posexplode(F.split(decoded(F.col("content")), "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1).where(F.trim("text") != "")


def checkout(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, language and text of the source files of a checkout."""
    rows = listed(spark, folder, CODE_SUFFIXES, max_bytes)
    return rows.select("path", language(F.col("path")).alias("language"), decoded(F.col("content")).alias("text"))


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix], F.lit("text"))


def _bound(then, **named: Column) -> Column:
    """then(row) of named expressions that are worked out once a row; as plain columns each would stand in the plan, and be worked out, wherever it is used."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in named.items()])), then)[0]


def _parts(location: Column) -> dict[str, Column]:
    """Trimmed location, its scheme and host in lower case, and its path."""
    value = F.trim(location)
    scheme = F.lower(F.regexp_extract(value, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(value, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))
    path = F.regexp_extract(value, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return {"value": value, "scheme": scheme, "host": host, "path": path}


def source_type(location: Column) -> Column:
    """The kind of source that fits a location best; ties by name."""
    return _bound(_kind, **_parts(location))


def _kind(p: Column) -> Column:
    value, scheme, host, path = p["value"], p["scheme"], p["host"], p["path"]
    http = scheme.isin("http", "https")
    target = F.regexp_replace(F.lower(F.when(http, path).otherwise(value)), "[/\\\\]+$", "")
    folders, spaces = F.contains(F.lower(path), F.lit("/folders/")), F.contains(F.lower(path), F.lit("/spaces/"))
    # Name and score of each kind of source, with the schemes, hosts and endings that it goes by.
    rules = [
        ("gdrive", 110, scheme.isin("gdrive", "googledrive")), ("gdrive", 105, host.isin("drive.google.com", "www.drive.google.com") & folders),
        ("notion", 110, scheme == "notion"), ("notion", 105, host.isin("notion.so", "www.notion.so") | host.endswith(".notion.site")),
        ("confluence", 110, scheme == "confluence"), ("confluence", 105, host.endswith(".atlassian.net") & spaces),
        ("s3", 100, scheme == "s3"), ("pdf", 90, target.endswith(".pdf")), ("repo", 80, target.endswith(".git")),
        ("repo", 75, http & host.isin("github.com", "gitlab.com", "bitbucket.org")), ("web", 50, http), ("local_fs", 1, F.lit(True)),
    ]
    found = F.array(*[F.when(hit, F.struct(F.lit(-score).alias("s"), F.lit(name).alias("n"))) for name, score, hit in rules])
    return F.array_min(F.filter(found, lambda x: x.isNotNull()))["n"]


def canonical(location: Column) -> Column:
    """One form for a source's location: of http without fragment and slash at the end (a root keeps its own), of stores and wikis by their keys, of paths without slashes at the end."""
    return _bound(lambda p: _bound(_canonical, p=p, kind=_kind(p)), **_parts(location))


def _canonical(x: Column) -> Column:
    kind, value, scheme, host, path = x["kind"], x["p"]["value"], x["p"]["scheme"], x["p"]["host"], x["p"]["path"]
    netloc = F.lower(F.regexp_extract(value, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    cut = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(value, "^[^?#]*(\\?[^#]+)", 1)
    web = F.concat(scheme, F.lit("://"), netloc, F.when(cut == "", "/").otherwise(cut), query)
    bare = F.regexp_replace(value, "[/\\\\]+$", "")
    local = F.when(bare == "", value).otherwise(bare)
    inner = F.regexp_replace(path, "^/+|/+$", "")
    s3 = F.concat(F.lit("s3://"), netloc, F.when(inner != "", F.concat(F.lit("/"), inner)).otherwise(F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(value, "^[A-Za-z]+:/*", ""), "/+$", "")
    folder = F.when(scheme.isin("gdrive", "googledrive"), rest).otherwise(F.regexp_extract(path, "(?i)/folders/([^/?#]+)", 1))
    page = F.lower(F.replace(F.when(scheme == "notion", rest).otherwise(F.regexp_extract(F.replace(path, F.lit("-"), F.lit("")), "([0-9a-fA-F]{32})$", 1)), F.lit("-"), F.lit("")))
    space = F.upper(F.when(scheme == "confluence", inner).otherwise(F.regexp_extract(path, "(?i)/spaces/([^/?#]+)", 1)))
    return (
        F.when(kind == "s3", s3)
        .when(kind == "gdrive", F.concat(F.lit("gdrive://"), folder))
        .when(kind == "notion", F.concat(F.lit("notion://"), page))
        .when(kind == "confluence", F.concat(F.lit("confluence://"), host, F.lit("/"), space))
        .when(scheme.isin("http", "https"), web)
        .otherwise(local)
    )


def safe_location(kind: Column, config: Column) -> Column:
    """What a catalog shows of a source's configuration (a JSON text): the place, and nothing that may be secret."""
    get = lambda k: F.nullif(F.get_json_object(config, f"$.{k}"), F.lit(""))
    prefix = F.nullif(F.regexp_replace(get("prefix"), "^/+|/+$", ""), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(get("base_url"), "^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]*)", 1)), F.lit(""))
    return (
        F.when(kind == "web", get("url"))
        .when(kind == "s3", F.concat(F.lit("s3://"), get("bucket"), F.coalesce(F.concat(F.lit("/"), prefix), F.lit(""))))
        .when(kind == "gdrive", F.concat(F.lit("gdrive://"), get("folder_id")))
        .when(kind == "notion", F.concat(F.lit("notion://"), get("page_id")))
        .when(kind == "confluence", F.concat(F.lit("confluence://"), host, F.lit("/"), get("space_key")))
        .otherwise(get("path"))
    )


def check_local(path: str, roots: tuple[str, ...]) -> str:
    """The path with its dots resolved, if it is in one of the roots."""
    found = posixpath.normpath(path)
    if not any(found == r or found.startswith(r.rstrip("/") + "/") for r in map(posixpath.normpath, roots)):
        raise ValueError("a path outside the folders that are allowed")
    return found


def check_remote(url: str, hosts: tuple[str, ...] = (), resolve: bool = False) -> str:
    """Only http(s), no credentials, no private or local address (with resolve neither by name), and a host of the list if there is one."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password:
        raise ValueError("not a plain http(s) address")
    if host == "localhost" or host.endswith((".local", ".internal", ".localhost")):
        raise ValueError("a local host")
    try:
        found = [host] if ipaddress.ip_address(host) else []
    except ValueError:
        found = sorted({x[4][0] for x in socket.getaddrinfo(host, None)}) if resolve else []
    if any(not ipaddress.ip_address(x).is_global for x in found):
        raise ValueError("a private address")
    if hosts and not any(host == h or host.endswith(f".{h}") for h in hosts):
        raise ValueError("a host that isn't allowed")
    return url
