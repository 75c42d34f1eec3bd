"""Components by name: embedders, rerankers, parsers, chunkers and connectors, the engine's own and those of other packages."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

KINDS = ("embedder", "reranker", "parser", "chunker", "connector")


class Registry:
    def __init__(self):
        self._made: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, name: str, factory: Callable) -> None:
        """A second component of one name is an error."""
        if kind not in KINDS:
            raise ValueError(f"no kind {kind}")
        if (kind, name) in self._made:
            raise ValueError(f"{kind} {name} is there already")
        self._made[kind, name] = factory

    def load(self, group: str = "larkspire") -> None:
        """Components that installed packages declare as entry points kind.name of the group."""
        for e in entry_points(group=group):
            kind, _, name = e.name.partition(".")
            self.register(kind, name, e.load())

    def create(self, kind: str, name: str, **options):
        if (kind, name) not in self._made:
            raise KeyError(f"no {kind} {name}; there are {sorted(n for k, n in self._made if k == kind)}")
        return self._made[kind, name](**options)


def default() -> Registry:
    from larkspire.engine import overlap_scorer
    from larkspire.functions.vector import hash_embedding, hash_sparse
    from larkspire.operators.ingest import chunking_spec
    from larkspire.sources import html, remote

    r = Registry()
    for kind, name, factory in (
        ("embedder", "hash", hash_embedding), ("embedder", "hash_sparse", hash_sparse), ("reranker", "overlap", lambda: overlap_scorer), ("parser", "html", lambda: html.blocks), ("chunker", "spec", chunking_spec),
        ("connector", "drive", remote.Drive), ("connector", "workspace", remote.Workspace), ("connector", "wiki", remote.Wiki),
    ):
        r.register(kind, name, factory)
    return r
