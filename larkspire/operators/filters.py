"""Retrieval filters and scopes. An absent criterion is no criterion; an empty tenant list is no rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    tenant_id: str | None = None
    source_types: tuple[str, ...] = ()
    doc_ids: tuple = ()
    tags: tuple[str, ...] = ()
    path_prefix: str | None = None
    url_prefix: str | None = None
    start: str | None = None
    end: str | None = None
    security_scope: tuple[str, ...] = field(default=())

    def condition(self, prefix: str = "", times: tuple[str, ...] = ("ingested_at", "doc_updated_at", "created_at"), either: bool = False) -> Column:
        """The conjunction of what is set: a null path or url is '', null tags are none, a null time passes, a null ACL is public.

        prefix names a struct that holds the columns. The time is the first of times that isn't null; with either, one of
        them must lie in the range.
        """
        c = lambda name: F.col(prefix + name)
        out: list[Column] = []
        if self.tenant_id:
            out.append(c("tenant_id") == self.tenant_id)
        if self.source_types:
            out.append(c("source_type").isin(*self.source_types))
        if self.doc_ids:
            out.append(c("doc_id").isin(*self.doc_ids))
        if self.tags:
            out.append(F.arrays_overlap(F.coalesce(c("tags"), F.array().cast("array<string>")), F.array(*map(F.lit, self.tags))))
        if self.path_prefix:
            out.append(F.coalesce(c("path"), F.lit("")).startswith(self.path_prefix))
        if self.url_prefix:
            out.append(F.coalesce(c("url"), F.lit("")).startswith(self.url_prefix))
        if self.start or self.end:
            if either:
                out.append(reduce(lambda a, b: a | b, [F.coalesce(self._within(c(t)), F.lit(False)) for t in times]))
            else:
                ts = F.coalesce(*map(c, times))
                out.append(ts.isNull() | self._within(ts))
        if self.security_scope:
            out.append(F.coalesce(c("acl_hash"), F.lit("public")).isin(*self.security_scope))
        return reduce(lambda a, b: a & b, out, F.lit(True))

    def _within(self, ts: Column) -> Column:
        out = F.lit(True)
        if self.start:
            out = out & (ts >= F.lit(self.start).cast("timestamp_ntz"))
        return out & (ts <= F.lit(self.end).cast("timestamp_ntz")) if self.end else out

    def apply(self, df: DataFrame, prefix: str = "", **times) -> DataFrame:
        return df.where(self.condition(prefix, **times))


def tenants(df: DataFrame, ids: list[str] | None) -> DataFrame:
    """None: all tenants; an empty list: none."""
    return df if ids is None else df.where(F.col("tenant_id").isin(*ids) if ids else F.lit(False))


def security_scope(policies: DataFrame, user: str, groups: list[str], roles: list[str]) -> DataFrame:
    """public and the hashes of the policies that let the user in."""
    some = lambda c, xs: F.arrays_overlap(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, xs)).cast("array<string>"))
    let = F.coalesce("allow_all", F.lit(False)) | some(F.col("allow_users"), [user]) | some(F.col("allow_groups"), groups) | some(F.col("allow_roles"), roles)
    public = policies.sparkSession.range(1).select(F.lit("public").alias("acl_hash"))
    return policies.where(let).select("acl_hash").unionByName(public).distinct()


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text, in any case, in one of the columns."""
    return df.where(F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(text.lower())))


def after(ts: str, key: str, last_ts, last_key) -> Column:
    """Rows behind the cursor in falling (ts, key) order; the first conjunct can be pushed into the scan."""
    return (F.col(ts) <= F.lit(last_ts)) & (F.struct(ts, key) < F.struct(F.lit(last_ts).alias(ts), F.lit(last_key).alias(key)))
