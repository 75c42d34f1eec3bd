"""Connectors of drives, workspaces and wikis over any transport, crawled as a table of places.

A connector says how one place (a folder, a page, a nested block, a space) is opened: each row of its answers becomes an
item, a piece of an item's text, or a further place. crawl() keeps the frontier as a DataFrame: all places of a level are
opened by tasks side by side, an anti-join drops those that have been seen, and the pieces of an item are put together by
an aggregate, so that no task follows a tree on its own. changes() compares a listing with the versions known so far:
new versions are fetched by tasks, ids that a full listing lacks are deletes, and so are items whose text has become empty.

A transport is a function (path, parameters) -> JSON; the one here replays a recording, a deployment gives its own by name.
"""

from __future__ import annotations

import importlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.operators.log import CommitLog
from larkspire.operators.merge import MergeTable
from larkspire.session import bounded, kept

# States that are worth another try, and the media type of a folder of the drive.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
FOLDER = "application/vnd.google-apps.folder"
# How the text of a block of each kind is marked; any other stands as it is.
MARKS = {"heading_1": "# {}", "heading_2": "## {}", "heading_3": "### {}", "bulleted_list_item": "- {}", "numbered_list_item": "- {}", "to_do": "- {}", "code": "```{language}\n{}\n```"}

#: what: item, piece or place. owner: the item of a piece. spot: where a piece stands, numbers from its item down.
CRAWLED = "what string, owner string, id string, version string, spot array<int>, payload string"
CHANGE = "kind string, external_id string, remote_version string, record string"


class ProviderError(RuntimeError):
    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


def retrying(call: Callable, attempts: int = 4, base: float = 0.5, most: float = 30.0, sleep=time.sleep, uniform=random.random) -> Callable:
    """call, tried again after transient states: after what the provider asks for, or a doubled delay of which half is left to chance."""

    def run(*a):
        for n in range(1, attempts + 1):
            try:
                return call(*a)
            except ProviderError as e:
                if e.status not in RETRYABLE or n == attempts:
                    raise
                delay = min(most, base * 2 ** (n - 1))
                sleep(min(most, e.retry_after) if e.retry_after is not None else delay * (0.5 + 0.5 * uniform()))

    return run


def replay(config: dict) -> Callable:
    """A transport over recorded answers, by path and sorted parameters."""
    recording = config["recording"]
    return lambda path, params: recording[path + ("?" + "&".join(f"{k}={v}" for k, v in sorted(params.items())) if params else "")]


def transport(config: dict) -> Callable:
    """The transport that the configuration names as module:function of the configuration; a replay where it names none."""
    module, _, name = config.get("transport", "").partition(":")
    return retrying(getattr(importlib.import_module(module), name)(config) if name else replay(config))


#: How providers go on to the next page: parameters for it, of an answer, its rows and the rows so far; none at the end.
NEXT = {
    "token": lambda answer, rows, so_far: {"page": answer["nextPageToken"]} if answer.get("nextPageToken") else None,
    "cursor": lambda answer, rows, so_far: {"cursor": answer["next_cursor"]} if answer.get("has_more") and answer.get("next_cursor") else None,
    "offset": lambda answer, rows, so_far: {"start": so_far} if rows else None,
}


def listed(get: Callable, path: str, field: str, how: str, **params) -> Iterator[dict]:
    """The rows of all pages of a listing."""
    more, so_far = {}, 0
    while more is not None:
        answer = get(path, params | more)
        rows = answer.get(field) or []
        so_far += len(rows)
        yield from rows
        more = NEXT[how](answer, rows, so_far)


def item(id_, version, payload: dict) -> tuple:
    return "item", None, str(id_), version, None, json.dumps(payload, ensure_ascii=False)


def place(**where) -> tuple:
    return "place", None, json.dumps(where, sort_keys=True), None, None, None


class _Placed:
    """What stands whole in one place can also be read through feed.ChangeFeed as a batch: a split is a place, its changes are its items, fetched by the split's task. The driver lists places only."""

    def splits(self) -> list[str]:
        found = [row[2] for row in self.start()]
        for where in found:
            found += [x for x in dict.fromkeys(row[2] for row in self.opened(**json.loads(where)) if row[0] == "place") if x not in found]
        return found

    def _items(self, split: str) -> list[tuple]:
        return [row for row in self.opened(**json.loads(split)) if row[0] == "item"]

    def latest(self, split: str) -> int:
        return len(self._items(split))

    def between(self, split: str, start: int, end: int) -> Iterator[tuple]:
        for _, _, i, version, _, payload in self._items(split)[start:end]:
            record = self.record(json.loads(payload), None)
            yield ("upsert", i, version, json.dumps(record, ensure_ascii=False)) if record["text"].strip() else ("delete", i, version, None)


class Drive(_Placed):
    """Files below a folder. A place is a folder; version: modified time, version and checksum."""

    def __init__(self, config: dict):
        self.config, self.get = config, transport(config)

    def start(self) -> list[tuple]:
        return [place(folder=str(self.config["folder_id"]))]

    def opened(self, folder: str) -> Iterator[tuple]:
        for x in listed(self.get, "files", "files", "token", parent=folder):
            if x.get("mimeType") != FOLDER:
                yield item(x["id"], ":".join(str(x.get(k) or "") for k in ("modifiedTime", "version", "md5Checksum")), x)
            elif self.config.get("recursive", True):
                yield place(folder=str(x["id"]))

    def record(self, x: dict, pieces: str | None) -> dict:
        return {"title": x["name"], "uri": x.get("webViewLink"), "text": self.get("content", {"id": x["id"]})["text"]}


def marked(block: dict) -> str:
    """The text of a workspace block, marked by its kind; empty where it has none."""
    value = block.get(block.get("type") or "")
    if not isinstance(value, dict):
        return ""
    plain = "".join(str(x.get("plain_text") or "") for x in value.get("rich_text") or [] if isinstance(x, dict))
    return plain and MARKS.get(block["type"], "{}").format(plain, language=value.get("language") or "")


class Workspace:
    """A page and the pages below it. Places are pages and blocks that hold further blocks; the text of a page is its blocks, level after level."""

    def __init__(self, config: dict):
        self.config, self.get = config, transport(config)

    def start(self) -> list[tuple]:
        return [place(page=str(self.config["page_id"]))]

    def opened(self, page: str, block: str | None = None, spot: list[int] | None = None) -> Iterator[tuple]:
        if block is None:
            about = self.get(f"pages/{page}", {})
            yield item(page, str(about.get("last_edited_time") or ""), {"title": about.get("title"), "uri": about.get("url")})
        for n, b in enumerate(listed(self.get, f"blocks/{block or page}", "results", "cursor")):
            here = [*(spot or []), n]
            child = b.get("type") == "child_page"
            text = (b.get("child_page") or {}).get("title") if child else marked(b)
            if text:
                yield "piece", page, None, None, here, text
            if child:
                yield place(page=str(b["id"]))
            elif b.get("has_children"):
                yield place(page=page, block=str(b["id"]), spot=here)

    def record(self, x: dict, pieces: str | None) -> dict:
        return x | {"text": pieces or ""}


class _Plain(HTMLParser):
    """Text of stored markup; blocks end lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)

    def handle_endtag(self, tag):
        if re.fullmatch(r"p|li|tr|div|h[1-6]", tag):
            self.parts.append("\n")


class Wiki(_Placed):
    """The pages of a space, all or those under a root page. Places are spaces."""

    def __init__(self, config: dict):
        self.config, self.get = config, transport(config)

    def start(self) -> list[tuple]:
        return [place(space=self.config["space_key"])]

    def opened(self, space: str) -> Iterator[tuple]:
        root = str(self.config.get("root_page_id") or "")
        for x in listed(self.get, "content", "results", "offset", space=space, start=0):
            if not root or root in {str(x["id"]), *(str(a.get("id")) for a in x.get("ancestors", ()))}:
                yield item(x["id"], str((x.get("version") or {}).get("number") or ""), {"id": x["id"]})

    def record(self, x: dict, pieces: str | None) -> dict:
        full = self.get(f"content/{x['id']}", {})
        plain = _Plain()
        plain.feed(((full.get("body") or {}).get("storage") or {}).get("value") or "")
        plain.close()
        lines = (" ".join(line.split()) for line in "".join(plain.parts).splitlines())
        return {"title": full.get("title"), "uri": (full.get("_links") or {}).get("webui"), "text": "\n".join(filter(None, lines))}


def crawl(spark: SparkSession, connector: type, config: dict) -> DataFrame:
    """external_id, version, payload and pieces (the text that was found beside it) of every item."""

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = connector(config)
        for pdf in batches:
            for where in pdf["id"]:
                yield pd.DataFrame(list(c.opened(**json.loads(where))), columns=["what", "owner", "id", "version", "spot", "payload"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame(connector(config).start(), CRAWLED).select("id")
    seen, levels = frontier, []
    while True:
        level = kept(bounded(frontier.repartition(parts, "id")).mapInPandas(open_, CRAWLED), "level")
        levels.append(level)
        frontier = kept(level.where("what = 'place'").select("id").distinct().join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    found = every.where("what = 'item'").groupBy(F.col("id").alias("external_id")).agg(F.min(F.struct("version", "payload")).alias("i"))
    order = F.struct(F.size("spot").alias("depth"), "spot", "payload")
    text = every.where("what = 'piece'").groupBy(F.col("owner").alias("external_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["payload"]), "\n").alias("pieces"))
    return found.select("external_id", "i.version", "i.payload").join(text, "external_id", "left")


def changes(listing: DataFrame, known: DataFrame, connector: type, config: dict, full_resync: bool = True) -> DataFrame:
    """What has changed against the versions known (external_id, version): CHANGE rows. Only new versions are fetched. Ids that the listing lacks are deletes if it is a full one."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = connector(config)
        for pdf in batches:
            rows = []
            for i, version, payload, pieces, had in zip(pdf["external_id"], pdf["version"], pdf["payload"], pdf["pieces"], pdf["had"], strict=True):
                record = c.record(json.loads(payload), pieces if isinstance(pieces, str) else None)
                if record["text"].strip():
                    rows.append(("upsert", i, version, json.dumps(record, ensure_ascii=False)))
                else:  # an empty text is none: what was there before goes, and the version isn't asked for again
                    rows.append(("delete" if had else "empty", i, version, None))
            yield pd.DataFrame(rows, columns=["kind", "external_id", "remote_version", "record"])

    old = known.select("external_id", F.col("version").alias("__old"))
    new = listing.join(old, "external_id", "left").where(F.col("__old").isNull() | (F.col("__old") != F.col("version")))
    parts = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = bounded(new.withColumn("had", F.col("__old").isNotNull()).repartition(parts, "external_id")).mapInPandas(fetch, CHANGE)
    if not full_resync:
        return out
    none = F.lit(None).cast("string")
    gone = known.join(listing.select("external_id"), "external_id", "left_anti")
    return out.unionByName(gone.select(F.lit("delete").alias("kind"), "external_id", none.alias("remote_version"), none.alias("record")))


class Sync:
    """A connector's checkpoint, the versions known of each id, with changes that are staged first and count once they have been published.

    stage() writes a run's changes and notes the run; until promote() is called for it, stage() gives the same rows again,
    after a crash too. promote() makes the run's versions the known ones; calling it twice does no harm.
    """

    def __init__(self, spark: SparkSession, root: str, connector: type, config: dict):
        self.spark, self.root, self.connector, self.config = spark, root.rstrip("/"), connector, config
        self.log = CommitLog(spark, f"{self.root}/runs")

    def _known(self) -> MergeTable:
        t = MergeTable(self.spark, f"{self.root}/known")
        return t if t.log.version() else MergeTable.create(self.spark, t.root, self.spark.createDataFrame([], "external_id string, version string"), ["external_id"], 8)

    def stage(self, full_resync: bool = True) -> tuple[str, DataFrame]:
        """(run, changes). Changes are of kind upsert or delete."""
        at, state = self.log.state()
        if not state.get("staged"):
            found = changes(crawl(self.spark, self.connector, self.config), self._known().read(), self.connector, self.config, full_resync)
            path = f"{self.root}/changes/{at + 1:08d}"
            found.write.mode("overwrite").parquet(path)
            self.log.commit({"staged": path}, at)
            state = {"staged": path}
        rows = self.spark.read.schema(CHANGE).parquet(state["staged"])
        return state["staged"], rows.where("kind <> 'empty'")

    def promote(self, run: str) -> None:
        at, state = self.log.state()
        if state.get("promoted") == run:
            return
        if state.get("staged") != run:
            raise ValueError("another run is staged")
        rows = self.spark.read.schema(CHANGE).parquet(run)
        known = self._known()
        known.upsert(rows.where("remote_version IS NOT NULL").select("external_id", F.col("remote_version").alias("version")))
        known.delete(rows.where("remote_version IS NULL").select("external_id"))
        self.log.commit({"staged": None, "promoted": run}, at)
