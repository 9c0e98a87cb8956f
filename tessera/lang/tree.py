"""Syntax tree. Front ends build it; :mod:`tessera.plans` turns it into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


# --- values and predicates ---


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Stamp:
    """A timestamp literal, ISO text."""

    text: str


@dataclass(frozen=True)
class Ref:
    """NEAREST's "more like this": the record that holds this text."""

    text: str


@dataclass(frozen=True)
class Leaf:
    path: str
    op: str  # = != > >= < <= in contains isnull notnull
    value: Any = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


# --- pipeline steps ---


@dataclass(frozen=True)
class Scan:
    dataset: str
    where: Any = None
    order: str | None = None
    descending: bool = False
    limit: int | None = None
    cursor: str | None = None


@dataclass(frozen=True)
class Find:
    dataset: str
    where: Any = None
    limit: int | None = None
    cursor: str | None = None


@dataclass(frozen=True)
class FindId:
    lid: Any


@dataclass(frozen=True)
class ScanView:
    view: str
    where: Any = None
    limit: int | None = None


@dataclass(frozen=True)
class Pull:
    depth: int = 1
    only: str | None = None
    dataset: str | None = None  # standalone form


@dataclass(frozen=True)
class Follow:
    field: str
    dataset: str
    on: str


@dataclass(frozen=True)
class GroupBy:
    fields: tuple


@dataclass(frozen=True)
class Metric:
    func: str  # count sum avg min max
    field: str | None = None
    alias: str | None = None
    where: Any = None

    @property
    def label(self) -> str:
        return self.alias or self.canonical

    @property
    def canonical(self) -> str:
        return "count" if self.func == "count" else f"{self.func}({self.field})"


@dataclass(frozen=True)
class Aggregate:
    metrics: tuple


@dataclass(frozen=True)
class Take:
    n: int
    by: str | None = None
    descending: bool = True


@dataclass(frozen=True)
class Shape:
    fields: tuple


@dataclass(frozen=True)
class Nearest:
    field: str
    query: Any
    k: Any
    metric: str = "cosine"


@dataclass(frozen=True)
class SetStep:
    values: tuple  # of (name, value)


@dataclass(frozen=True)
class DeleteStep:
    pass


@dataclass(frozen=True)
class Pipeline:
    steps: tuple


# --- statements ---


@dataclass(frozen=True)
class Fetch:
    datasets: tuple
    where: Any
    names: tuple | None = None


@dataclass(frozen=True)
class LinkTo:
    dataset: str
    where: Any
    relation: str


@dataclass(frozen=True)
class Put:
    dataset: str
    records: tuple  # of dicts
    marked: tuple = ()  # per record: names written with *
    batch: bool = False
    link: LinkTo | None = None
    upsert: bool = False


@dataclass(frozen=True)
class SetWhere:
    dataset: str
    values: tuple
    where: Any = None


@dataclass(frozen=True)
class DeleteWhere:
    dataset: str
    where: Any


@dataclass(frozen=True)
class Link:
    source: str
    source_where: Any
    target: str
    target_where: Any
    relation: str


@dataclass(frozen=True)
class Declare:
    """lobe, anchor, autoanchor, gravity, satellite, vector, pin, unpin, purge, incache, outcache, analyze, migrate."""

    kind: str
    dataset: str | None
    detail: Any = None


@dataclass(frozen=True)
class Gravity:
    kind: str  # raw lower trim composite
    fields: tuple


@dataclass(frozen=True)
class Show:
    what: str
    dataset: str | None = None


@dataclass(frozen=True)
class Admin:
    what: str  # compact scrub bulkmode snapshot
    detail: Any = None


@dataclass(frozen=True)
class CreateView:
    name: str
    dataset: str
    where: Any = None
    group: tuple = ()
    metrics: tuple = ()
    order: str | None = None
    descending: bool = False
    embed: tuple = ()


@dataclass(frozen=True)
class ViewAction:
    what: str  # refresh drop
    name: str


@dataclass(frozen=True)
class Batch:
    statements: tuple = field(default_factory=tuple)
