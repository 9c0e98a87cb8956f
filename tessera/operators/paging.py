"""Keyset pages: a token names the last row, the snapshot and the predicate it was made for."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lang.forms import fingerprint
from tessera.lang.parser import QueryError

VERSION = 1


@dataclass(frozen=True)
class Cursor:
    dataset: str
    snapshot: int
    where: str
    last: Any

    def token(self) -> str:
        raw = json.dumps([VERSION, self.dataset, self.snapshot, self.where, self.last]).encode()
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def read_token(token: str, dataset: str, where: Any) -> Cursor:
    try:
        version, name, snapshot, mark, last = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError as e:
        raise QueryError("cursor invalid: not a token of this engine") from e
    if version != VERSION:
        raise QueryError("cursor invalid: made by another version")
    if name != dataset:
        raise QueryError("cursor invalid: made for another dataset")
    if mark != fingerprint(where):
        raise QueryError("cursor invalid: WHERE clause does not match")
    return Cursor(name, snapshot, mark, last)


def page(df: DataFrame, id_field: str, limit: int, after: Any) -> tuple[DataFrame, list]:
    """Rows after the token in order of the id, one more than wanted to learn whether there are more.

    Returns the page and its first ``limit + 1`` ids; the ids are few by the page size.
    """
    key = F.col(f"`{id_field}`")
    rest = df.filter(key > F.lit(after)) if after is not None else df
    ids = [r[0] for r in rest.select(key).orderBy(key.asc()).limit(limit + 1).collect()]
    rows = rest.filter(key <= F.lit(ids[limit - 1])) if limit and len(ids) >= limit else rest
    return rows.orderBy(key.asc()).limit(limit), ids
