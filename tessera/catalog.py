"""The session's view of its datasets: registered tables in memory, managed ones and views in the store."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.keys import BUCKETS
from tessera.lang.parser import QueryError
from tessera.lang.tree import Gravity
from tessera.sources.files import VersionedFile
from tessera.sources.managed import new_entry


@dataclass
class External:
    """A read-only table: where it comes from and which of its columns play which role."""

    load: Callable[[], DataFrame]
    id_field: str | None = None
    unique: tuple = ()
    cluster: Gravity | None = None
    vector: str | None = None
    edges: Callable[[], DataFrame] | None = None


@dataclass
class Catalog:
    spark: SparkSession
    root: str | None
    buckets: int = BUCKETS
    external: dict[str, External] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.file = VersionedFile(self.spark, self.root) if self.root else None
        self.version, self.content = self.file.read() if self.file else (0, {})
        self.content.setdefault("datasets", {})
        self.content.setdefault("views", {})

    def refresh(self) -> None:
        """See what other sessions committed."""
        if self.file:
            version, content = self.file.read()
            if version > self.version:
                self.version, self.content = version, {"datasets": {}, "views": {}} | content

    def at(self, version: int) -> dict:
        """What the catalog held at a version."""
        return {"datasets": {}, "views": {}} | self.file.at(version)

    def draft(self, writes: str | None = None) -> dict:
        if writes in self.external:
            raise QueryError(f"dataset {writes} is a registered table and cannot be written")
        if self.file is None:
            raise QueryError("this session has no store; give it a path to write to")
        return copy.deepcopy(self.content)

    def commit(self, content: dict) -> None:
        """All of a statement's changes, to data and views, become visible at once."""
        self.file.commit(self.version + 1, content)
        self.version, self.content = self.version + 1, content

    def has(self, name: str) -> bool:
        return name in self.external or name in self.content["datasets"]

    def entry(self, name: str, content: dict | None = None) -> dict:
        found = (content or self.content)["datasets"].get(name)
        if found is None:
            what = "is a registered table and cannot be written" if name in self.external else "not found"
            raise QueryError(f"dataset {name} {what}")
        return found

    def ensure(self, content: dict, name: str) -> dict:
        if name in self.external:
            raise QueryError(f"dataset {name} is a registered table and cannot be written")
        return content["datasets"].setdefault(name, new_entry(self.buckets))
