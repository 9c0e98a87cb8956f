"""Results as JSON: flat rows, or the records of a PULL as a tree by their links."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lang.parser import QueryError

#: A tree is put together on the driver, so it holds no more records than a statement may return.
TREE_MAX = 10_000


def flat_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each record as an object, fields that it lacks left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def stream_json(df: DataFrame) -> Iterator[str]:
    """Records one by one, a partition at a time on the driver."""
    for row in flat_json(df).toLocalIterator():
        yield row["json"]


def tree_json(df: DataFrame) -> list[dict]:
    """Records nested under the record they link to, as ``children``. Records whose parent is not among them are roots."""
    rows = [json.loads(r["json"]) for r in flat_json(df).limit(TREE_MAX + 1).collect()]
    if len(rows) > TREE_MAX:
        raise QueryError(f"a tree has at most {TREE_MAX} records")
    by_id = {r.get("_lid"): r for r in rows}
    roots = []
    for row in sorted(rows, key=lambda r: str(r.get("_lid"))):
        links = [v for k, v in row.items() if k.startswith("_link_") and v]
        parent = next((by_id[x] for v in links for x in str(v).split(",") if x in by_id and by_id[x] is not row), None)
        seen, at = {id(row)}, parent
        while at is not None and id(at) not in seen:  # a cycle of links has a root all the same
            seen.add(id(at))
            at = at.get("_parent")
        if parent is None or at is not None:
            roots.append(row)
        else:
            row["_parent"] = parent
            parent.setdefault("children", []).append(row)
    for row in rows:
        row.pop("_parent", None)
    return roots
