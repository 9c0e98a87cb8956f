"""Sessions: statements as text or as trees, and a fluent form of the read steps.

    session = Session(spark, "hdfs://.../store")
    session.run('PUT {*rfc: "A", _type: "Credit", amount: 10.0} IN "credits"')
    session.run('SCAN "credits" | GROUP BY rfc | AGGREGATE sum(amount) AS total').df.show()
    session.scan("credits").where("amount > 5").group_by("rfc").aggregate("sum(amount) AS total").df()

Every read is a lazy DataFrame.  A SCAN through the language that ends in records and has no limit of its own gives
``DEFAULT_LIMIT`` of them at most and says in ``has_more`` whether there are more; the fluent form is not capped.
"""

from __future__ import annotations

import copy
import time
import uuid
from collections import Counter, deque
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import views
from tessera.catalog import Catalog, External
from tessera.functions.keys import BUCKETS, bucket_of, cluster_key
from tessera.functions.values import literal
from tessera.lang import forms, parse
from tessera.lang import tree as t
from tessera.lang.parser import QueryError, parse_where
from tessera.operators import expand, nearest, paging
from tessera.plans.aggregates import aggregate, take_groups
from tessera.plans.predicates import Predicates, resolve
from tessera.sources import managed

DEFAULT_LIMIT, HARD_LIMIT = 1000, 10_000
_HIDDEN = ("_nulls", "_key", "_rooted", "_bucket")


@dataclass
class Result:
    """What a statement gives: rows (lazy), facts about a write, or both."""

    kind: str  # records groups aggregation page info ok
    df: DataFrame | None = None
    info: Any = None
    cursor: str | None = None
    has_more: bool = False
    budget_stop: None = None  # a batch plan is never cut by time
    note: Callable[[float], None] | None = None  # is told how long the query took

    def rows(self) -> list[dict]:
        if self.df is None:
            return []
        started = time.perf_counter()
        found = [r.asDict(recursive=True) for r in self.df.collect()]
        if self.note is not None:
            self.note(time.perf_counter() - started)
        return found


def _mean_ms(hits: list[list]) -> float | None:
    timed = [seconds for _, seconds in hits if seconds is not None]
    return sum(timed) / len(timed) * 1000 if timed else None


def _check_names(names: set[str]) -> None:
    taken = {n for n in names if n in managed.SYSTEM and n != "_type"}
    if taken:
        raise QueryError(f"{sorted(taken)[0]} is a name of the engine's own")


@dataclass
class _Flow:
    """A pipeline under way."""

    df: DataFrame
    dataset: str | None
    where: Any = None
    group: tuple = ()
    metrics: tuple = ()
    kind: str = "records"
    limited: bool = False
    plain_scan: bool = False


class Session:
    def __init__(self, spark: SparkSession, path: str | None = None, read_only: bool = False, strict_types: bool = False, clock: Callable[[], float] = time.time, buckets: int = BUCKETS):
        self.spark, self.root = spark, path.rstrip("/") if path else None
        self.catalog = Catalog(spark, self.root, buckets)
        self.read_only, self.strict, self.clock = read_only, strict_types, clock
        self.bulk = False
        self.cached: dict[str, DataFrame] = {}
        self.patterns: dict[tuple, list[list]] = {}  # by pattern: when it was asked, and the seconds that it ran, once known
        self.latest: dict[tuple, Any] = {}
        self._keep: dict[str, DataFrame | None] = {}
        self.used: dict[str, list[float]] = {}  # by adopted view: when it answered
        self.routed: deque[str] = deque(maxlen=100)

    # --- registered tables ---

    def register(
        self, name: str, source: DataFrame | str, id_field: str | None = None, unique: tuple | str = (), cluster: tuple | str | None = None,
        vector: str | None = None, json_fields: dict[str, str] | None = None, edges: DataFrame | None = None,
    ) -> Session:
        """Make a table readable as a dataset. ``json_fields`` gives the schema of JSON text columns, for dotted paths."""
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        for column, schema in (json_fields or {}).items():
            df = df.withColumn(column, F.from_json(column, schema))
        fields = (cluster,) if isinstance(cluster, str) else tuple(cluster or ())
        spec = t.Gravity("composite" if len(fields) > 1 else "raw", fields) if fields else None
        unique = (unique,) if isinstance(unique, str) else tuple(unique)
        self.catalog.external[name] = External(lambda: df, id_field or (unique[0] if unique else None), unique, spec, vector, (lambda: edges) if edges is not None else None)
        return self

    # --- reading ---

    def dataset(self, name: str) -> DataFrame:
        """All records of a dataset, with the engine's own columns."""
        if name in self.cached:
            return self.cached[name]
        if name in self.catalog.external:
            return self.catalog.external[name].load()
        return managed.read(self.spark, self.catalog.entry(name))

    def id_field(self, name: str | None, df: DataFrame) -> str:
        external = self.catalog.external.get(name or "")
        if external and external.id_field:
            return external.id_field
        return "_lid" if "_lid" in df.columns else df.columns[0]

    def cluster(self, name: str) -> t.Gravity | None:
        external = self.catalog.external.get(name)
        return external.cluster if external else managed.gravity_of(self.catalog.entry(name))

    def unique_fields(self, name: str) -> tuple:
        external = self.catalog.external.get(name)
        return external.unique if external else tuple(self.catalog.entry(name)["anchors"])

    def filtered(self, name: str, where: Any, entry: dict | None = None) -> DataFrame:
        """Matching records, of the current version or of the one that ``entry`` is from."""
        df = managed.read(self.spark, entry) if entry is not None else self.dataset(name)
        condition = Predicates(df.schema, self.strict).compile(where)
        bucket = self._bucket_filter(name, df, where, entry)
        if bucket is not None:
            df = df.filter(bucket)
        return df.filter(condition) if where is not None else df

    def _pinned(self, where: Any) -> dict[str, Any]:
        return {c.path: c.value for c in forms.conjuncts(where) if isinstance(c, t.Leaf) and c.op == "=" and c.value is not None}

    def _bucket_filter(self, name: str, df: DataFrame, where: Any, entry: dict | None = None) -> Column | None:
        """A test of the partition column that follows from equality on every field of the cluster key.

        Records that were placed with a parent stand in its bucket, whatever their own key; the catalog lists those buckets.
        """
        if entry is None and (name in self.catalog.external or name in self.cached):
            return None
        entry = entry or self.catalog.entry(name)
        spec = managed.gravity_of(entry)
        pinned = self._pinned(where)
        if spec is None or not all(f in pinned for f in spec.fields):
            return None

        def of(field: str) -> Column:
            found = resolve(df.schema, field)
            return literal(pinned[field], found[1]).cast(found[1]) if found else F.lit(None)

        bucket = bucket_of(cluster_key(spec, of), entry["buckets"])
        return F.col("_bucket").isin(bucket, *entry["rooted"]) if entry["rooted"] else F.col("_bucket") == bucket

    # --- statements ---

    def run(self, query: Any, params: dict | None = None) -> Result:
        """Run a statement (text or tree). Of several, separated by semicolons, the results' infos are listed."""
        tree = parse(query) if isinstance(query, str) else query
        tree = forms.bind(tree, params or {})
        if self.read_only and forms.is_write(tree):
            raise QueryError("this session is read-only")
        if isinstance(tree, t.Batch):
            # Declarations and writes come first, then COMPACT, then views: views see all that was written.
            rank = lambda s: 2 if isinstance(s, t.CreateView) else 1 if isinstance(s, t.Admin) and s.what == "compact" else 0
            ordered = sorted(tree.statements, key=rank)
            with self._shared_scans(ordered):
                results = [self.run(s) for s in ordered]
            return Result("ok", results[-1].df, [r.info for r in results])
        if isinstance(tree, t.Pipeline):
            return self._pipeline(tree)
        if isinstance(tree, t.Fetch):
            sections = [(n, self._visible(self.filtered(d, tree.where))) for n, d in zip(tree.names or tree.datasets, tree.datasets, strict=True)]
            return Result("records", expand.fetch(sections, HARD_LIMIT))
        handlers = {
            t.Put: self._put, t.SetWhere: self._set_where, t.DeleteWhere: self._delete_where, t.Link: self._link, t.Declare: self._declare,
            t.Show: self._show, t.Admin: self._admin, t.CreateView: self._create_view, t.ViewAction: self._view_action,
        }
        handler = handlers.get(type(tree))
        if handler is None:
            raise QueryError(f"cannot run {tree}")
        return handler(tree)

    # --- pipelines ---

    def _pipeline(self, pipe: t.Pipeline) -> Result:
        self._check_order(pipe.steps)
        first, steps = pipe.steps[0], pipe.steps[1:]
        paged = self._paged(first, steps)
        if paged is not None:
            return paged
        flow, steps = self._start(first, steps)
        for step in steps:
            if isinstance(step, (t.SetStep, t.DeleteStep)):
                lids = flow.df.select("_lid") if "_lid" in flow.df.columns else None
                if lids is None or flow.dataset in self.catalog.external:
                    raise QueryError("SET and DELETE need records of a managed dataset")
                if isinstance(step, t.SetStep):
                    return self._change(flow.dataset, None, dict(step.values), lids)
                return self._remove(flow.dataset, None, lids)
            flow = self._step(flow, step)
        note = self._note(first) if isinstance(first, t.Scan) else None
        if flow.kind == "records" and not flow.limited and isinstance(first, (t.Scan, t.ScanView)):
            return self._capped(flow, first, pipe.steps[1:], note)
        df = self._visible(flow.df) if flow.kind == "records" else flow.df
        return Result(flow.kind, df, note=note)

    def _check_order(self, steps: tuple) -> None:
        for i, step in enumerate(steps[1:], 1):
            previous = steps[i - 1]
            if isinstance(previous, (t.SetStep, t.DeleteStep)):
                raise QueryError("nothing can follow SET or DELETE")
            if isinstance(step, t.GroupBy) and not (isinstance(previous, (t.Scan, t.ScanView)) and i == 1):
                raise QueryError("GROUP BY stands between SCAN and AGGREGATE only")
            if isinstance(previous, t.GroupBy) and not isinstance(step, t.Aggregate):
                raise QueryError("GROUP BY must be followed by AGGREGATE")
            if any(isinstance(s, t.Aggregate) for s in steps[:i]) and not isinstance(step, t.Take):
                raise QueryError("only TAKE can follow AGGREGATE")
            if isinstance(step, t.Take) and step.by and not any(isinstance(s, t.Aggregate) for s in steps[:i]):
                raise QueryError("TAKE n BY a metric follows AGGREGATE")
        if isinstance(steps[-1], t.GroupBy):
            raise QueryError("GROUP BY must be followed by AGGREGATE")
        for step in steps:
            limit = getattr(step, "limit", None)
            if limit is not None and limit > HARD_LIMIT:
                raise QueryError(f"LIMIT is at most {HARD_LIMIT}; read further with CURSOR")

    def _start(self, first: Any, steps: tuple) -> tuple[_Flow, tuple]:
        if isinstance(first, t.FindId):
            for name in self.catalog.content["datasets"]:
                df = self.dataset(name)
                if df.filter(F.col("_lid") == first.lid).limit(1).count():
                    return _Flow(df.filter(F.col("_lid") == first.lid), name, limited=True), steps
            raise QueryError(f"no record has id {first.lid}")
        if isinstance(first, t.Pull):
            df = self.dataset(first.dataset)
            return _Flow(expand.only_type(df, first.only), first.dataset, limited=True), steps
        if isinstance(first, t.ScanView):
            return self._scan_view(first), steps
        if isinstance(first, t.Find):
            df = self.filtered(first.dataset, first.where)
            if any(f in self._pinned(first.where) for f in self.unique_fields(first.dataset)):
                return _Flow(df.limit(1), first.dataset, limited=True), steps
            return _Flow(df.limit(first.limit) if first.limit is not None else df, first.dataset, first.where, limited=True), steps
        routed = self._route(first, steps)
        if routed is not None:
            return routed
        df = self.filtered(first.dataset, first.where)
        if first.order:
            df = self._ordered(df, first.dataset, first.order, first.descending).limit(first.limit)
        elif first.limit is not None:
            df = df.limit(first.limit)
        return _Flow(df, first.dataset, first.where, limited=first.limit is not None, plain_scan=True), steps

    def _ordered(self, df: DataFrame, dataset: str | None, path: str, descending: bool) -> DataFrame:
        """By one field, nulls last both ways, ties by id."""
        found = resolve(df.schema, path)
        column = found[0] if found else F.lit(None)
        if found and isinstance(found[1], T.VariantType):
            column = F.try_variant_get(column, "$", "double")
        return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(f"`{self.id_field(dataset, df)}`").asc())

    def _step(self, flow: _Flow, step: Any) -> _Flow:
        df = flow.df
        if isinstance(step, t.GroupBy):
            return _Flow(df, flow.dataset, flow.where, group=step.fields, kind="records", limited=flow.limited)
        if isinstance(step, t.Aggregate):
            out = aggregate(df, step.metrics, flow.group, self.strict)
            return _Flow(out, None, group=flow.group, metrics=step.metrics, kind="groups" if flow.group else "aggregation", limited=True)
        if isinstance(step, t.Take):
            if flow.metrics:
                return _Flow(take_groups(df, step, flow.group, flow.metrics), None, group=flow.group, metrics=flow.metrics, kind=flow.kind, limited=True)
            return _Flow(df.limit(step.n), flow.dataset, limited=True)
        if isinstance(step, t.Shape):
            own = [c for c in ("_lid",) if c in df.columns]
            keep = [f for f in dict.fromkeys(step.fields) if f in df.columns and f not in own]
            external = flow.dataset in self.catalog.external
            return _Flow(df.select(*([] if external else own), *[F.col(f"`{c}`") for c in keep]), flow.dataset, limited=flow.limited)
        if isinstance(step, t.Follow):
            return _Flow(expand.follow(df, step.field, self.dataset(step.dataset), step.on), step.dataset, limited=flow.limited)
        if isinstance(step, t.Pull):
            return _Flow(self._pull(flow, step), flow.dataset, limited=flow.limited)
        if isinstance(step, t.Nearest):
            return _Flow(nearest.nearest(df, step, self.id_field(flow.dataset, df)), flow.dataset, limited=True)
        raise QueryError(f"cannot run {step}")

    def _pull(self, flow: _Flow, step: t.Pull) -> DataFrame:
        if flow.dataset is None:
            raise QueryError("PULL needs records of a dataset")
        base = self.dataset(flow.dataset)
        external = self.catalog.external.get(flow.dataset)
        if external:
            if external.cluster is None:
                raise QueryError("PULL needs a cluster key; register the table with cluster=")
            return expand.pull(flow.df, base, list(external.cluster.fields), step.only)
        out = expand.pull(flow.df, base, ["_key", "_bucket"])
        links = [c for c in base.columns if c.startswith("_link_")]
        if step.depth > 1 and links:
            edges = None
            for c in links:
                hop = base.filter(F.col(c).isNotNull()).select(F.col("_lid").alias("src"), F.explode(F.split(c, ",")).alias("dst"))
                both = hop.unionByName(hop.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                edges = both if edges is None else edges.unionByName(both)
            reached = expand.linked_ids(out, edges, step.depth - 1)
            out = base.join(reached, "_lid", "left_semi").select(*base.columns)
        return expand.only_type(out, step.only)

    def _visible(self, df: DataFrame) -> DataFrame:
        return df.drop(*_HIDDEN, nearest.SCORE)

    def _capped(self, flow: _Flow, first: Any, steps: tuple, note: Callable[[float], None] | None) -> Result:
        """Final records without a limit of their own: all of them up to the default cap, else a first part that says that there
        are more.  A plain SCAN's is a page with a cursor; other forms have no position to go on from."""
        started = time.perf_counter()
        more = flow.df.limit(DEFAULT_LIMIT + 1).count() > DEFAULT_LIMIT
        if note is not None:
            note(time.perf_counter() - started)
        if not more:
            return Result("records", self._visible(flow.df))
        if isinstance(first, t.Scan) and not steps:
            rows, ids = paging.page(flow.df, self.id_field(first.dataset, flow.df), DEFAULT_LIMIT, None)
            token = paging.Cursor(first.dataset, self.catalog.version, forms.fingerprint(first.where), ids[DEFAULT_LIMIT - 1]).token()
            return Result("page", self._visible(rows), cursor=token, has_more=True)
        return Result("records", self._visible(flow.df).limit(DEFAULT_LIMIT), has_more=True)

    def _paged(self, first: Any, steps: tuple) -> Result | None:
        cursor = getattr(first, "cursor", None)
        if isinstance(first, t.Find) and cursor is not None:
            spec = self.cluster(first.dataset)
            if spec is None or not all(f in self._pinned(first.where) for f in spec.fields):
                raise QueryError("FIND takes a CURSOR only where WHERE pins the cluster key; use SCAN")
        bounded = isinstance(first, t.Find) and first.limit is not None and not any(f in self._pinned(first.where) for f in self.unique_fields(first.dataset))
        if cursor is None and not (isinstance(first, t.Scan) and first.limit is not None and not first.order or bounded):
            return None
        if steps:
            if cursor is not None:
                raise QueryError("a page with CURSOR takes no further steps")
            return None
        limit = first.limit if first.limit is not None else DEFAULT_LIMIT
        if limit > HARD_LIMIT:
            raise QueryError(f"LIMIT is at most {HARD_LIMIT}; read further with CURSOR")
        token = paging.read_token(cursor, first.dataset, first.where) if cursor is not None else None
        entry = None
        if token and first.dataset in self.catalog.content["datasets"] and token.snapshot != self.catalog.version:
            entry = self.catalog.at(token.snapshot)["datasets"][first.dataset]  # later writes are not seen between pages
        df = self.filtered(first.dataset, first.where, entry)
        key = self.id_field(first.dataset, df)
        rows, ids = paging.page(df, key, limit, token.last if token else None)
        more = len(ids) > limit
        out = None
        if more and limit:
            snapshot = token.snapshot if token else self.catalog.version
            out = paging.Cursor(first.dataset, snapshot, forms.fingerprint(first.where), ids[limit - 1]).token()
        return Result("page", self._visible(rows), cursor=out, has_more=more)

    # --- views on the read side ---

    def _views(self, content: dict | None = None) -> dict[str, tuple[t.CreateView, dict]]:
        return {n: (views.decode(e["definition"]), e) for n, e in sorted((content or self.catalog.content)["views"].items())}

    def _route(self, scan: t.Scan, steps: tuple) -> tuple[_Flow, tuple] | None:
        """A fresh view that answers SCAN [GROUP BY] AGGREGATE, or holds all records that it asks for: most conditions first, then name."""
        if scan.cursor or scan.dataset in self.catalog.external or not self.catalog.has(scan.dataset):
            return None
        if not any(isinstance(s, t.Aggregate) for s in steps):
            return self._route_records(scan, steps)
        if scan.limit is not None or scan.order:
            return None
        group = steps[0].fields if steps and isinstance(steps[0], t.GroupBy) else ()
        rest = steps[1:] if group else steps
        if not rest or not isinstance(rest[0], t.Aggregate):
            return None
        if any(f in self._pinned(scan.where) for f in self.unique_fields(scan.dataset)):
            return None
        best = None
        for name, (view, entry) in self._views().items():
            if entry["stale"]:
                continue
            left = views.answers_aggregate(view, scan.dataset, scan.where, group, rest[0].metrics)
            if left is not None and (best is None or views.specificity(view) > views.specificity(best[1])):
                best = name, view, entry, left
        if best is None:
            return None
        name, view, entry, left = best
        self._routed(name)
        state = views.read_state(self.spark, view, entry)
        if not left and len(rest) > 1 and isinstance(rest[1], t.Take) and rest[1].by:
            by = next((m.canonical for m in rest[0].metrics if rest[1].by in (m.label, m.canonical)), None)
            state = views.first_groups(view, entry, state, t.Take(rest[1].n, by, rest[1].descending))
        groups = views.state_metrics(view, state, rest[0].metrics)
        for c in left:
            column = F.col(f"`{c.path}`")
            groups = groups.filter(column == literal(c.value, groups.schema[c.path].dataType))
        return _Flow(groups, None, group=group, metrics=rest[0].metrics, kind="groups" if group else "aggregation", limited=True), rest[1:]

    def _routed(self, name: str) -> None:
        self.routed.append(name)
        self.used.setdefault(name, []).append(self.clock())

    def _route_records(self, scan: t.Scan, steps: tuple) -> tuple[_Flow, tuple] | None:
        """A fresh view of whole records that the scan can be read from, unless its key leads to one record or bucket anyway."""
        pinned, spec = self._pinned(scan.where), self.cluster(scan.dataset)
        if any(f in pinned for f in self.unique_fields(scan.dataset)) or (spec is not None and all(f in pinned for f in spec.fields)):
            return None
        if any(isinstance(s, (t.SetStep, t.DeleteStep)) for s in steps) or scan.dataset in self.cached:
            return None
        found = [(view, name, entry) for name, (view, entry) in self._views().items() if not entry["stale"] and views.answers_records(view, scan)]
        if not found:
            return None
        view, name, entry = min(found, key=lambda x: (-views.specificity(x[0]), x[0].order != scan.order, x[1]))
        self._routed(name)
        df = managed.conform(views.read_state(self.spark, view, entry), managed.schema_of(self.catalog.entry(scan.dataset)))
        df = df.filter(Predicates(df.schema, self.strict).compile(scan.where)) if scan.where is not None else df
        if scan.order:
            df = self._ordered(df, scan.dataset, scan.order, scan.descending).limit(scan.limit)
        elif scan.limit is not None:
            df = df.limit(scan.limit)
        return _Flow(df, scan.dataset, scan.where, limited=scan.limit is not None, plain_scan=True), steps

    def _scan_view(self, step: t.ScanView) -> _Flow:
        if step.view not in self.catalog.content["views"]:
            raise QueryError(f"view {step.view} not found")
        view, entry = self._views()[step.view]
        state = views.read_state(self.spark, view, entry)
        if views.is_aggregate(view):
            if step.where is None and step.limit is not None and views.order_metric(view):
                state = views.first_groups(view, entry, state, t.Take(step.limit, views.order_metric(view).label, view.descending))
            df = views.state_metrics(view, state, view.metrics)
            allowed, dataset = set(df.columns), None
        else:
            df, dataset = state, view.dataset
            allowed = set(df.columns)
        unknown = {p.split(".")[0] for p in forms.paths(step.where)} - allowed
        if unknown:
            raise QueryError(f"view {step.view} does not store {sorted(unknown)[0]}")
        df = df.filter(Predicates(df.schema, self.strict).compile(step.where)) if step.where is not None else df
        if view.order:
            by = next((m.label for m in view.metrics if view.order in (m.label, m.canonical)), None)
            column = F.col(f"`{by}`") if by else resolve(df.schema, view.order)[0] if resolve(df.schema, view.order) else F.lit(None)
            ties = [F.col(f"`{g}`").asc_nulls_first() for g in view.group] or ([F.col("_lid")] if "_lid" in df.columns else [])
            df = df.orderBy(column.desc_nulls_last() if view.descending else column.asc_nulls_last(), *ties)
        df = df.limit(step.limit) if step.limit is not None else df
        return _Flow(df, dataset, limited=step.limit is not None, kind="records")

    # --- writes ---

    def _now(self) -> int:
        return int(self.clock() * 1_000_000)

    def _commit(self, content: dict, name: str, came: DataFrame | None, left: DataFrame | None) -> None:
        """Bring the dataset's views up to date with rows that came and left, then commit all at once."""
        for view_name, (view, entry) in self._views(content).items():
            if view.dataset != name:
                continue
            if self.bulk:
                content["views"][view_name] = {**entry, "stale": True}
            elif not entry["stale"]:
                content["views"][view_name] = self._maintain(content, view_name, view, entry, came, left)
        content["datasets"][name] = managed.merge_tail(self.spark, self.root, name, content["datasets"][name])
        self.catalog.commit(content)
        if name in self.cached:  # what is cached follows the write
            self.cached.pop(name).unpersist()
            self.cached[name] = managed.read(self.spark, content["datasets"][name]).persist()

    def _new_part(self, df: DataFrame, name: str, view: t.CreateView | None = None, gone: bool = False, merged: bool = False) -> dict:
        """Write rows of a view. Covering rows stand in the view's order, and so do the groups of a ``merged`` state."""
        path = f"{self.root}/views/{name}/{uuid.uuid4().hex}"
        part = {"path": path, "gone": gone}
        if merged and views.order_metric(view):
            views.with_metric(view, df).write.parquet(path)
            return part | {"ranks": views.rank_values(view, self.spark.read.parquet(path))}
        (views.in_order(view, df) if view is not None and not gone and not views.is_aggregate(view) else df).write.parquet(path)
        return part

    def _maintain(self, content: dict, name: str, view: t.CreateView, entry: dict, came: DataFrame | None, left: DataFrame | None) -> dict:
        parts = list(entry["parts"])
        if not views.is_aggregate(view):
            matches = lambda df: df.filter(Predicates(df.schema).compile(view.where))
            if left is not None:
                parts.append(self._new_part(matches(left).select("_lid"), name, view, gone=True))
            if came is not None:
                fields = views.covering_fields(view, content["datasets"][view.dataset]["pins"], came.columns)
                parts.append(self._new_part(matches(came).select(*[F.col(f"`{c}`") for c in fields]), name, view))
        elif left is not None and views.has_extremes(view):
            # Extremes of the groups that lost a row are computed anew; other groups keep theirs.
            base = managed.read(self.spark, content["datasets"][view.dataset])
            old = self.spark.read.parquet(*[p["path"] for p in parts])
            changed = views.state_rows(view, left, -1)
            if came is not None:
                changed = changed.unionByName(views.state_rows(view, came))
            if view.group:
                keys = [f"`{g}`" for g in view.group]
                touched = changed.select(*keys).distinct()
                on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in view.group]
                rest = views.live_groups(view, views.merge_states(view, old))
                rest = rest.join(touched, on(rest, touched), "left_anti")
                fresh = views.state_rows(view, base)
                fresh = fresh.join(touched, on(fresh, touched), "left_semi")
                state = rest.unionByName(fresh)
            else:
                state = views.state_rows(view, base)
            return {**entry, "parts": [self._new_part(state, name, view, merged=True)]}
        else:
            delta = views.state_rows(view, came) if came is not None else None
            if left is not None:
                gone = views.state_rows(view, left, -1)
                delta = gone if delta is None else delta.unionByName(gone)
            if delta is not None:
                parts.append(self._new_part(views.merge_states(view, delta), name, view))
        entry = {**entry, "parts": parts}
        if len(parts) > views.MERGE_AT:
            entry["parts"] = [self._new_part(views.read_state(self.spark, view, entry), name, view, merged=True)]
        return entry

    def _put(self, put: t.Put) -> Result:
        if len(put.records) > managed.BATCH_MAX:
            raise QueryError(f"a batch has at most {managed.BATCH_MAX} records; this one has {len(put.records)}")
        content = self.catalog.draft(put.dataset)
        entry = self.catalog.ensure(content, put.dataset)
        records = [dict(r) for r in put.records]
        _check_names({n for r in records for n in r})
        for marked in put.marked:
            self._mark(entry, marked)
        parent_key = None
        if put.link is not None:
            parents = self.filtered(put.link.dataset, put.link.where).select("_lid", "_key").orderBy("_lid").limit(1).collect()
            if not parents:
                raise QueryError("LINK TO: no record matches")
            for record in records:
                record[f"_link_{put.link.relation}"] = parents[0]["_lid"]
            if put.link.dataset == put.dataset:
                parent_key = parents[0]["_key"]
        if put.upsert:
            records = self._collapse(records, entry["anchors"])
        if not records:
            return Result("ok", info={"count": 0})
        df = managed.from_records(self.spark, records)
        return self._insert(content, put.dataset, entry, df, put.upsert, parent_key)

    def _mark(self, entry: dict, marked: tuple) -> None:
        if not marked:
            return
        if entry["gravity"] is None:
            if len(marked) > 1:
                raise QueryError("several fields are marked with *; declare GRAVITY BY (a, b) first")
            if entry["parts"]:
                raise QueryError("the cluster key must be declared before the first write; use GRAVITY BY on a new dataset")
            entry["gravity"] = ["raw", list(marked)]
        elif not set(marked) <= set(entry["gravity"][1]):
            raise QueryError(f"marked field {sorted(set(marked) - set(entry['gravity'][1]))[0]} is not in the cluster key")

    @staticmethod
    def _collapse(records: list[dict], anchors: list[str]) -> list[dict]:
        """Records of one batch with an equal unique value become one; later fields win."""
        out: list[dict] = []
        at: dict[tuple, dict] = {}
        for record in records:
            first = next((at[a, record[a]] for a in anchors if record.get(a) is not None and (a, record[a]) in at), None)
            if first is None:
                first = dict(record)
                out.append(first)
            else:
                first.update(record)
            for a in anchors:
                if first.get(a) is not None:
                    at[a, first[a]] = first
        return out

    def append(self, name: str, df: DataFrame, batch: str | None = None, upsert: bool = False, stream: tuple[str, int] | None = None) -> Result:
        """Add the rows of a DataFrame to a managed dataset as one write. A ``batch`` that was written before is not written again;
        of a ``stream`` (its name and the batch's number, which grows) the catalog keeps the last number alone."""
        if self.read_only:
            raise QueryError("this session is read-only")
        content = self.catalog.draft()
        entry = self.catalog.ensure(content, name)
        if batch is not None:
            if batch in entry["batches"]:
                return Result("ok", info={"count": 0, "batch": batch, "repeated": True})
            entry["batches"] = [*entry["batches"], batch]
        if stream is not None:
            source, number = stream
            if number <= entry["streams"].get(source, -1):
                return Result("ok", info={"count": 0, "batch": number, "repeated": True})
            entry["streams"] = {**entry["streams"], source: number}
        return self._insert(content, name, entry, df.drop(*[c for c in managed.SYSTEM if c in df.columns and c not in ("_type", "_nulls")]), upsert, None)

    def _insert(self, content: dict, name: str, entry: dict, df: DataFrame, upsert: bool, parent_key: str | None) -> Result:
        entry["dim"] = managed.check_vectors(df, entry)
        existing = managed.read(self.spark, entry) if entry["parts"] else None
        counts = {anchor: managed.check_unique(df, None if upsert else existing, anchor) for anchor in entry["anchors"]}
        fresh, merged = df, None
        if upsert:
            if not entry["anchors"]:
                raise QueryError("ON CONFLICT UPDATE needs an anchor")
            fresh, merged = self._met(existing, df, entry, counts)
        now = self._now()
        key = F.lit(parent_key) if parent_key is not None else None
        fresh = managed.stamp(fresh, name, entry, now, key)
        if merged is None:
            path_entry = managed.write_part(self.spark, self.root, name, entry, fresh)
            content["datasets"][name] = path_entry
            came = self._last_part(path_entry)
            if parent_key is not None:
                at = {r[0] for r in came.select("_bucket").distinct().collect()}  # one: they share the parent's key
                content["datasets"][name] = {**path_entry, "rooted": sorted({*entry["rooted"], *at})}
            self._commit(content, name, came, None)
            sums = came.agg(F.count(F.lit(1)).alias("n"), F.min("_lid").alias("a"), F.max("_lid").alias("b")).first()
            return Result("ok", info={"count": sums["n"], "first_lid": sums["a"], "last_lid": sums["b"]})
        old, new = merged
        schema = managed.merge_schemas(new.schema, fresh.schema)
        both = managed.conform(new, schema).unionByName(managed.conform(fresh, schema))
        sums = old.groupBy("_lid").count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
        if sums["n"] and sums["most"] > 1:
            raise QueryError("ON CONFLICT UPDATE: two rows of the batch meet the same record")
        rest = existing.join(managed.keyed(old.select("_lid"), sums["n"]), "_lid", "left_anti")
        for anchor in entry["anchors"]:
            managed.check_unique(both, rest, anchor)
        changed, _ = self._replace(content, name, entry, old, both)
        self._commit(content, name, changed, old)
        return Result("ok", info={"count": changed.count(), "first_lid": None, "last_lid": None})

    def _met(self, existing: DataFrame | None, df: DataFrame, entry: dict, counts: dict[str, int]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
        """(rows that meet no record, records that the others meet and the same after it). A row meets a record by the first of the
        anchors, in the order of their declaration, that any record shares with it.  ``counts``: the batch's values of each anchor."""
        fresh, merged = df, None
        for anchor in entry["anchors"]:
            if existing is None or anchor not in df.columns or anchor not in existing.columns:
                continue
            keys = df.filter(F.col(f"`{anchor}`").isNotNull()).select(F.col(f"`{anchor}`").alias("_have"))
            # Records that share the anchor with the batch: the joins below are of these, not of the whole dataset.
            near = existing.join(managed.keyed(keys, counts[anchor]), existing[f"`{anchor}`"] == keys["_have"], "left_semi")
            found = self._merge(near, fresh, anchor, entry)
            if merged is None:
                merged = found
            else:
                merged = tuple(managed.conform(a, b.schema).unionByName(b) for a, b in zip(merged, found, strict=True))
            have = near.select(F.col(f"`{anchor}`").alias("_have")).distinct()
            fresh = fresh.join(managed.keyed(have, counts[anchor]), fresh[f"`{anchor}`"] == have["_have"], "left_anti")
        return fresh, merged

    def _last_part(self, entry: dict) -> DataFrame:
        return managed.conform(managed.read_part(self.spark, entry["parts"][-1]), managed.schema_of(entry))

    def _merge(self, existing: DataFrame, df: DataFrame, anchor: str, entry: dict) -> tuple[DataFrame, DataFrame]:
        """(records that an upsert meets, the same after it): named fields win, others are kept."""
        schema = managed.merge_schemas(managed.schema_of(entry), df.schema)
        left = managed.conform(existing, schema).alias("l")
        given = df if "_nulls" in df.columns else df.withColumn("_nulls", F.lit(None).cast("array<string>"))
        names = [c for c in given.columns if c not in managed.SYSTEM and c != anchor]
        right = managed.conform(given, T.StructType([schema[c] for c in [anchor, "_nulls", *names]]))
        right = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.columns])
        met = left.join(right.hint("merge"), F.col(f"l.`{anchor}`") == F.col(f"`_r_{anchor}`"))
        old = met.select("l.*")
        nulls = F.coalesce(F.col("_r__nulls"), F.array().cast("array<string>"))
        out = []
        for c in schema.names:
            if c in names:
                new = F.col(f"`_r_{c}`")
                out.append(F.when(new.isNotNull() | F.array_contains(nulls, c), new).otherwise(F.col(f"l.`{c}`")).alias(c))
            elif c == "_updated_at":
                out.append(F.timestamp_micros(F.lit(self._now())).alias(c))
            elif c == "_nulls":
                have = F.coalesce(F.col("l._nulls"), F.array().cast("array<string>"))
                filled = F.array_compact(F.array(*[F.when(F.col(f"`_r_{n}`").isNotNull(), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
                out.append(F.array_union(F.array_except(have, filled), nulls).alias(c))
            else:
                out.append(F.col(f"l.`{c}`").alias(c))
        return old, managed.place(met.select(*out), entry)

    def _replace(self, content: dict, name: str, entry: dict, old: DataFrame, new: DataFrame, keep: Column | None = None) -> tuple[DataFrame | None, int]:
        """Rewrite the buckets of ``old`` with ``new`` in their place. Returns the new rows as they were written, and how many
        ``old`` has; nothing is written if it has none.  ``keep`` is true for the records that are not in ``old``."""
        existing = managed.read(self.spark, entry)
        mark = uuid.uuid4().hex
        schema = managed.merge_schemas(existing.schema, new.schema)
        new = managed.conform(new, schema).withColumn(managed.MARK, F.lit(mark))
        # At most one row per bucket of the dataset; each names a directory.
        counts = {r["_bucket"]: r["count"] for r in old.groupBy("_bucket").count().collect()}
        if not counts and keep is not None:
            return None, 0
        touched, kept = [], existing
        if entry["gravity"]:
            touched = sorted(counts)
            kept = existing.filter(F.col("_bucket").isin(touched)) if touched else existing.limit(0)
        kept = kept.filter(keep) if keep is not None else kept.join(managed.keyed(old.select("_lid"), sum(counts.values())), "_lid", "left_anti")
        kept = managed.conform(kept, schema).withColumn(managed.MARK, F.lit(None).cast("string"))
        both = kept.unionByName(new)
        written = managed.write_part(self.spark, self.root, name, {**entry, "schema": None}, both, drop=touched, replace=not entry["gravity"])
        written["schema"] = schema.jsonValue()
        content["datasets"][name] = written
        rows = managed.read_part(self.spark, written["parts"][-1], mark=True)
        return managed.conform(rows.filter(F.col(managed.MARK) == mark), schema), sum(counts.values())

    def _set_where(self, step: t.SetWhere) -> Result:
        return self._change(step.dataset, step.where, dict(step.values), None)

    def _delete_where(self, step: t.DeleteWhere) -> Result:
        return self._remove(step.dataset, step.where, None)

    def _matching(self, entry: dict, name: str, where: Any, lids: DataFrame | None) -> tuple[DataFrame, Column | None]:
        """The records that a change is about, and a test that is true for all others where there is one."""
        df = managed.read(self.spark, entry)
        if lids is not None:
            return df.join(lids.distinct(), "_lid", "left_semi").select(*df.columns), None
        bucket = self._bucket_filter(name, df, where)
        test = Predicates(df.schema, self.strict).compile(where) if where is not None else F.lit(True)
        matching = df.filter(bucket) if bucket is not None else df
        return matching.filter(test), ~F.coalesce(test, F.lit(False))

    def _change(self, name: str, where: Any, values: dict, lids: DataFrame | None) -> Result:
        content = self.catalog.draft()
        entry = self.catalog.entry(name, content)
        _check_names(set(values))
        frozen = set(values) & set(entry["anchors"])
        if frozen:
            raise QueryError(f"anchor {sorted(frozen)[0]} cannot be changed by SET")
        old, keep = self._matching(entry, name, where, lids)
        incoming = managed.from_records(self.spark, [values])
        schema = managed.merge_schemas(managed.schema_of(entry), incoming.drop("_nulls").schema)
        new = managed.conform(old, schema)
        nulls = [n for n, v in values.items() if v is None]
        one = managed.conform(incoming.drop("_nulls"), T.StructType([schema[n] for n in values]))
        one = one.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in one.columns])
        # One row of new values.
        new = new.crossJoin(F.broadcast(one))
        have = F.coalesce(F.col("_nulls"), F.array().cast("array<string>"))
        marks = F.array_union(F.array_except(have, F.array(*[F.lit(n) for n in values])), F.array(*[F.lit(n) for n in nulls]).cast("array<string>"))
        new = new.withColumns({n: F.col(f"`_r_{n}`") for n in values} | {"_updated_at": F.timestamp_micros(F.lit(self._now())), "_nulls": marks})
        new = managed.place(new.select(*schema.names), entry)
        entry["dim"] = managed.check_vectors(new, entry)
        written, count = self._replace(content, name, entry, old, new, keep)
        if count:
            self._commit(content, name, written, old)
        return Result("ok", info={"count": count})

    def _remove(self, name: str, where: Any, lids: DataFrame | None) -> Result:
        content = self.catalog.draft()
        entry = self.catalog.entry(name, content)
        old, keep = self._matching(entry, name, where, lids)
        _, count = self._replace(content, name, entry, old, old.limit(0), keep)
        if count:
            self._commit(content, name, None, old)
        return Result("ok", info={"count": count})

    def _link(self, step: t.Link) -> Result:
        """Write ``_link_<relation>`` on every source: the ids of all targets, joined by commas."""
        found = self.filtered(step.target, step.target_where).select("_lid").limit(HARD_LIMIT + 1).collect()
        if not found:
            raise QueryError("LINK: no target matches")
        if len(found) > HARD_LIMIT:
            raise QueryError(f"LINK: more than {HARD_LIMIT} targets")
        return self._change(step.source, step.source_where, {f"_link_{step.relation}": ",".join(sorted(r["_lid"] for r in found))}, None)

    # --- declarations ---

    def _declare(self, step: t.Declare) -> Result:
        kind, name, detail = step.kind, step.dataset, step.detail
        if kind in ("incache", "outcache", "analyze", "migrate"):
            return getattr(self, f"_{kind}")(name, detail)
        content = self.catalog.draft()
        if kind == "lobe":
            if self.catalog.has(name):
                raise QueryError(f"dataset {name} already exists")
            self.catalog.ensure(content, name)["hint"] = detail
            self.catalog.commit(content)
            return Result("ok", info=f"dataset {name} created")
        entry = self.catalog.entry(name, content)
        if kind == "anchor":
            if detail in entry["anchors"]:
                raise QueryError(f"anchor {detail} is declared already")
            entry["anchors"].append(detail)
        elif kind == "autoanchor":
            return self._autoanchor(content, name, entry, detail)
        elif kind == "gravity":
            spec = [detail.kind, list(detail.fields)]
            if entry["gravity"] not in (None, spec):
                raise QueryError(f"dataset {name} has another cluster key already")
            if entry["gravity"] is None and entry["parts"]:
                raise QueryError("the cluster key must be declared before the first write")
            entry["gravity"] = spec
        elif kind == "satellite":
            if entry["satellite"] not in (None, detail):
                raise QueryError(f"dataset {name} has another sub-key already: {entry['satellite']}")
            if entry["satellite"] is None and entry["parts"]:
                raise QueryError("the sub-key must be declared on an empty dataset")
            entry["satellite"] = detail
        elif kind == "vector":
            if entry["vector"] not in (None, detail):
                raise QueryError(f"dataset {name} has another vector field already: {entry['vector']}")
            entry["vector"] = detail
            if entry["parts"]:
                entry["dim"] = managed.check_vectors(managed.read(self.spark, entry), entry)
        elif kind == "pin":
            entry["pins"] = list(dict.fromkeys([*entry["pins"], *detail]))
        elif kind == "unpin":
            entry["pins"] = [p for p in entry["pins"] if p not in detail]
        elif kind == "purge":
            old = managed.read(self.spark, entry)
            count = old.count() if entry["parts"] else 0
            content["datasets"][name] = {**entry, "parts": [], "rooted": []}
            self._commit(content, name, None, old if count else None)
            return Result("ok", info={"count": count})
        self.catalog.commit(content)
        return Result("ok", info=f"{kind} declared on {name}")

    def _autoanchor(self, content: dict, name: str, entry: dict, field: str) -> Result:
        if field not in entry["anchors"]:
            entry["anchors"].append(field)
            self.catalog.commit(content)
        df = self.dataset(name)
        if field not in df.columns:
            return Result("info", info={"indexed": 0, "duplicates": 0})
        sums = df.filter(F.col(f"`{field}`").isNotNull()).groupBy(F.col(f"`{field}`").alias("k")).count().agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).first()
        return Result("info", info={"indexed": sums["n"], "duplicates": (sums["rows"] or 0) - sums["n"]})

    def _incache(self, name: str, where: Any) -> Result:
        df = self.filtered(name, where).persist()
        count = df.count()
        if where is None:
            self.cached[name] = df
        else:
            self.cached[f"{name} where {forms.canonical(where)}"] = df
        return Result("info", info={"cached": count})

    def _outcache(self, name: str, _: Any) -> Result:
        for key in [k for k in self.cached if k == name or k.startswith(f"{name} where ")]:
            self.cached.pop(key).unpersist()
        return Result("ok", info=f"{name} is no longer cached")

    def _migrate(self, name: str | None, _: Any) -> Result:
        return Result("ok", info="parts are read in any earlier form; there is nothing to migrate")

    def _analyze(self, name: str, _: Any = None) -> Result:
        """Per field: type, exact distinct count, share of distinct values and length range.

        Figures that add up are one aggregation; distinct values are counted field by field, each in two phases over its own
        column, so that no row is repeated for every field.
        """
        df = self._visible(self.dataset(name))
        fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.VariantType, T.MapType))]
        columns, counts = [F.count(F.lit(1)).alias("rows")], []
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            size = F.length(c) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("int")
            columns += [F.count(c).alias(f"n{i}"), F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}")]
            counts.append(df.select(c.alias("v")).distinct().agg(F.lit(i).alias("i"), F.count("v").alias("n")))
        row = df.agg(*columns).first().asDict()
        row |= {f"d{r['i']}": r["n"] for r in reduce(DataFrame.unionAll, counts).collect()} if counts else {}
        out = []
        for i, f in enumerate(fields):
            distinct, some = row[f"d{i}"], row[f"n{i}"]
            share = distinct / some if some else 0.0
            label = "CONSTANT" if distinct <= 1 else "HIGH" if share > 0.99 else "MEDIUM" if share > 0.5 else "LOW"
            hint = {"HIGH": "anchor", "MEDIUM": "cluster key", "LOW": "view condition"}.get(label)
            out.append((f.name, f.dataType.simpleString(), row["rows"], some, distinct, label, row[f"lo{i}"], row[f"hi{i}"], hint))
        schema = "field string, type string, n_rows long, n_present long, n_distinct long, cardinality string, min_length int, max_length int, suggestion string"
        return Result("info", self.spark.createDataFrame(out, schema), out)

    # --- introspection and administration ---

    def _show(self, step: t.Show) -> Result:
        content = self.catalog.content
        if step.what == "lobes":
            names = [*content["datasets"], *self.catalog.external]
            rows = [(n, self.dataset(n).count(), n in content["datasets"]) for n in sorted(names)]
            return Result("info", self.spark.createDataFrame(rows, "name string, n_records long, managed boolean"), rows)
        if step.what == "anchors":
            rows = [(a,) for a in self.unique_fields(step.dataset)]
            return Result("info", self.spark.createDataFrame(rows, "field string"), [r[0] for r in rows])
        if step.what == "ghosts":
            rows = [views.describe(n, e) for n, e in sorted(content["views"].items())]
            df = self.spark.createDataFrame([tuple(r.values()) for r in rows], "name string, dataset string, kind string, order_by string, conditions int, parts int, stale boolean")
            return Result("info", df, rows)
        if step.what == "cache":
            return Result("info", info=sorted(self.cached))
        if step.what == "scan stats":
            rows = [(k[0], k[1], len(v), _mean_ms(v)) for k, v in sorted(self.patterns.items())]
            return Result("info", self.spark.createDataFrame(rows, "dataset string, pattern string, hits int, avg_ms double"), rows)
        if step.what == "profile":
            return Result("info", info=self._profile(step.dataset))
        return Result("info", info="Healthy; Spark schedules writes, nothing is throttled here")

    def _profile(self, name: str) -> list[str]:
        external = self.catalog.external.get(name)
        entry = None if external else self.catalog.entry(name)
        spec = self.cluster(name)
        lines = [f"Profile for '{name}':", f"  Gravity: {', '.join(spec.fields) if spec else '(none)'}"]
        if entry and entry["pins"]:
            lines.append(f"  Pinned: {', '.join(entry['pins'])}")
        vector = external.vector if external else entry["vector"]
        if vector:
            dim = None if external else entry["dim"]
            lines.append(f"  Vector: {vector} dim {dim or 'unknown'}")
        if entry and entry["satellite"]:
            lines.append(f"  Satellite: {entry['satellite']}")
        learned = [f"    {p} ({len(v)} hits)" for (d, p), v in sorted(self.patterns.items()) if d == name]
        lines += ["  Learned:", *learned] if learned else ["  Learned: (no scan patterns yet)"]
        own = [n for n, (v, _) in self._views().items() if v.dataset == name]
        return lines + ([f"  Ghosts: {', '.join(own)}"] if own else ["  Ghosts: (none)"])

    def _admin(self, step: t.Admin) -> Result:
        if step.what == "bulkmode":
            self.bulk = bool(step.detail)
            stale = [n for n, e in self.catalog.content["views"].items() if e["stale"]] if not self.bulk else []
            for name in stale:
                self._view_action(t.ViewAction("refresh", name))
            return Result("ok", info=f"bulk mode {'on' if self.bulk else 'off'}, {len(stale)} views refreshed")
        if step.what == "scrub":
            broken = []
            for name, entry in self.catalog.content["datasets"].items():
                for part in entry["parts"]:
                    try:
                        managed.read_part(self.spark, part).write.format("noop").mode("overwrite").save()
                    except Exception as e:  # every kind of damage is reported, none repaired
                        broken.append(f"{name}: {part['path']}: {type(e).__name__}")
            return Result("info", info={"broken": broken})
        content = self.catalog.draft()
        if step.what == "snapshot":
            content.setdefault("snapshots", {})[step.detail] = copy.deepcopy({"version": self.catalog.version, "datasets": content["datasets"], "views": content["views"]})
            self.catalog.commit(content)
            return Result("ok", info=f"snapshot {step.detail} of version {self.catalog.version}")
        merged = 0
        for name, entry in content["datasets"].items():
            if len(entry["parts"]) > 1:
                content["datasets"][name] = managed.write_part(self.spark, self.root, name, entry, managed.read(self.spark, entry), replace=True)
                merged += 1
        for name, (view, entry) in self._views(content).items():
            if len(entry["parts"]) > 1:
                content["views"][name] = {**entry, "parts": [self._new_part(views.read_state(self.spark, view, entry), name, view, merged=True)]}
        self.catalog.commit(content)
        return Result("ok", info=f"{merged} datasets compacted")

    # --- views on the write side ---

    def _create_view(self, view: t.CreateView) -> Result:
        content = self.catalog.draft()
        if view.name in content["views"]:
            raise QueryError(f"view {view.name} already exists")
        self.catalog.entry(view.dataset, content)
        if view.metrics and view.order and not any(view.order in (m.label, m.canonical) for m in view.metrics) and view.order not in view.group:
            if "(" in view.order:
                raise QueryError(f"view {view.name} is ordered by {view.order}, which it does not aggregate")
        content["views"][view.name] = self._build(content, view)
        self.catalog.commit(content)
        stored = self.spark.read.parquet(content["views"][view.name]["parts"][0]["path"])
        return Result("ok", info={"view": view.name, "rows": stored.count(), "fields": stored.columns})

    @contextmanager
    def _shared_scans(self, statements: list):
        """While several views of one dataset are made one after the other, its records are read once and kept."""
        counts = Counter(s.dataset for s in statements if isinstance(s, t.CreateView))
        self._keep = {name: None for name, n in counts.items() if n > 1}
        try:
            yield
        finally:
            for df in self._keep.values():
                if df is not None:
                    df.unpersist()
            self._keep = {}

    def _base(self, content: dict, name: str) -> DataFrame:
        """The records that a view of ``name`` is made from."""
        if name not in self._keep:
            return managed.read(self.spark, content["datasets"][name])
        if self._keep[name] is None:  # views come last in a batch, so nothing is written while it is kept
            self._keep[name] = managed.read(self.spark, content["datasets"][name]).persist()
        return self._keep[name]

    def _build(self, content: dict, view: t.CreateView) -> dict:
        base = self._base(content, view.dataset)
        if views.is_aggregate(view):
            df = views.state_rows(view, base)
        else:
            fields = views.covering_fields(view, content["datasets"][view.dataset]["pins"], base.columns)
            df = base.filter(Predicates(base.schema).compile(view.where)).select(*[F.col(f"`{c}`") for c in fields])
        return {"definition": views.encode(view), "parts": [self._new_part(df, view.name, view, merged=views.is_aggregate(view))], "stale": False}

    def _view_action(self, step: t.ViewAction) -> Result:
        content = self.catalog.draft()
        if step.name not in content["views"]:
            raise QueryError(f"view {step.name} not found")
        if step.what == "drop":
            del content["views"][step.name]
        else:
            content["views"][step.name] = self._build(content, views.decode(content["views"][step.name]["definition"]))
        self.catalog.commit(content)
        return Result("ok", info=f"view {step.name}: {step.what}")

    # --- generations ---

    def snapshot(self, name: str) -> Session:
        """A read-only session on the data as they were when the snapshot was made."""
        found = self.catalog.content.get("snapshots", {}).get(name)
        if found is None:
            raise QueryError(f"snapshot {name} not found")
        out = Session(self.spark, self.root, read_only=True, strict_types=self.strict, clock=self.clock)
        out.catalog.content = {"datasets": found["datasets"], "views": found["views"]}
        out.catalog.external = dict(self.catalog.external)
        return out

    def vacuum(self) -> int:
        """Delete parts that neither the current catalog nor a snapshot names. Not to be run while others read older versions."""
        self.catalog.refresh()
        content = self.catalog.content
        alive = set()
        for version in (content, *content.get("snapshots", {}).values()):
            for entry in (*version["datasets"].values(), *version["views"].values()):
                alive |= {p["path"] for p in entry["parts"]}
        gone = [p for kind in ("data", "views") for p in self.catalog.file.folders(f"{self.root}/{kind}") if p not in alive]
        for path in gone:
            self.catalog.file.remove(path)
        return len(gone)

    # --- advice ---

    def _note(self, scan: t.Scan) -> Callable[[float], None] | None:
        """Count a scan's pattern; what is returned takes the seconds that it ran, when the engine itself runs it."""
        if scan.where is None or not all(isinstance(c, t.Leaf) for c in forms.conjuncts(scan.where)):
            return None
        pattern = " AND ".join(sorted(f"{c.path} {c.op}" for c in forms.conjuncts(scan.where)))
        hit = [self.clock(), None]
        self.patterns.setdefault((scan.dataset, pattern), []).append(hit)
        self.latest[scan.dataset, pattern] = scan.where
        return lambda seconds: hit.__setitem__(1, seconds)

    def advise(self, min_hits: int = 5, window_seconds: float = 600, min_ms: float = 20.0) -> list[tuple[str, str, int]]:
        """Patterns that deserve a view: (dataset, pattern, hits within the window), asked often enough and, on the average of
        the runs that were timed, slow enough. Runs of lazy results that the caller executes are not timed."""
        now, found = self.clock(), []
        for (dataset, pattern), hits in sorted(self.patterns.items()):
            recent = [h for h in hits if now - h[0] <= window_seconds]
            if len(recent) >= min_hits and (_mean_ms(recent) is None or _mean_ms(recent) >= min_ms):
                found.append((dataset, pattern, len(recent)))
        return found

    def adopt(
        self, min_hits: int = 5, window_seconds: float = 600, most: int = 20, keep_seconds: float = 86_400, min_ms: float = 20.0, promote_hits: int = 100, promoted_seconds: float = 30 * 86_400
    ) -> list[str]:
        """Create a view of counts and sums for each advised pattern of a managed dataset, as it was last asked.

        Such views last ``keep_seconds``, or ``promoted_seconds`` once they have answered ``promote_hits`` times. There are at most
        ``most`` per dataset: the one that answered longest ago goes first. A pattern has one view at a time.
        """
        self.expire()
        made = []
        self._promote(promote_hits, promoted_seconds)
        for dataset, pattern, _ in self.advise(min_hits, window_seconds, min_ms):
            if dataset not in self.catalog.content["datasets"]:
                continue
            where = self.latest[dataset, pattern]
            name = f"auto-{dataset}-{forms.fingerprint(where)}"
            own = {n: e for n, e in self.catalog.content["views"].items() if e.get("expires") and views.decode(e["definition"]).dataset == dataset}
            if name in own or any(e.get("pattern") == pattern for e in own.values()):
                continue
            if len(own) >= most:
                oldest = min(own, key=lambda n: (self.used.get(n, [own[n]["made"]])[-1], n))
                self._view_action(t.ViewAction("drop", oldest))
            numbers = [f.name for f in self.dataset(dataset).schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in managed.SYSTEM]
            metrics = (t.Metric("count"), *(t.Metric("sum", n) for n in numbers))
            self._create_view(t.CreateView(name, dataset, where, (), metrics, "count", True))
            content = self.catalog.draft()
            content["views"][name] |= {"expires": self.clock() + keep_seconds, "made": self.clock(), "pattern": pattern}
            self.catalog.commit(content)
            made.append(name)
        return made

    def _promote(self, hits: int, seconds: float) -> None:
        """Views that have answered often enough are kept longer."""
        content = self.catalog.draft()
        chosen = [n for n, e in content["views"].items() if e.get("expires") and not e.get("promoted") and len(self.used.get(n, [])) >= hits]
        for name in chosen:
            content["views"][name] |= {"expires": content["views"][name]["made"] + seconds, "promoted": True}
        if chosen:
            self.catalog.commit(content)

    def expire(self) -> list[str]:
        """Drop adopted views that are past their time."""
        gone = [n for n, e in self.catalog.content["views"].items() if e.get("expires") and e["expires"] < self.clock()]
        for name in gone:
            self._view_action(t.ViewAction("drop", name))
        return gone

    # --- fluent form ---

    def scan(self, name: str) -> Query:
        return Query(self, t.Scan(name))

    def find(self, name: str, where: Any = None) -> Query:
        return Query(self, t.Find(name, parse_where(where) if isinstance(where, str) else where))

    def scan_view(self, name: str) -> Query:
        return Query(self, t.ScanView(name))


@dataclass(frozen=True)
class Query:
    """A pipeline being put together; every method gives a new one."""

    session: Session
    source: Any
    steps: tuple = ()

    def _with(self, step: Any) -> Query:
        return Query(self.session, self.source, (*self.steps, step))

    def where(self, predicate: Any) -> Query:
        tree = parse_where(predicate) if isinstance(predicate, str) else predicate
        both = forms.conjoin([c for c in (self.source.where, tree) if c is not None])
        return Query(self.session, type(self.source)(**{**self.source.__dict__, "where": both}), self.steps)

    def order_by(self, field: str, descending: bool = False) -> Query:
        return Query(self.session, type(self.source)(**{**self.source.__dict__, "order": field, "descending": descending}), self.steps)

    def limit(self, n: int) -> Query:
        return Query(self.session, type(self.source)(**{**self.source.__dict__, "limit": n}), self.steps)

    def group_by(self, *fields: str) -> Query:
        return self._with(t.GroupBy(fields))

    def aggregate(self, metrics: str) -> Query:
        return self._with(parse(f'SCAN "x" | AGGREGATE {metrics}').steps[1])

    def take(self, n: int, by: str | None = None, descending: bool = True) -> Query:
        return self._with(t.Take(n, by, descending))

    def shape(self, *fields: str) -> Query:
        return self._with(t.Shape(fields))

    def follow(self, field: str, dataset: str, on: str) -> Query:
        return self._with(t.Follow(field, dataset, on))

    def pull(self, depth: int = 1, only: str | None = None) -> Query:
        return self._with(t.Pull(depth, only))

    def nearest(self, field: str, query: Any, k: int, metric: str = "cosine") -> Query:
        return self._with(t.Nearest(field, query, k, metric))

    def df(self) -> DataFrame:
        """The lazy result, without the language's caps."""
        session = self.session
        session._check_order((self.source, *self.steps))
        flow, steps = session._start(self.source, self.steps)
        for step in steps:
            flow = session._step(flow, step)
        return session._visible(flow.df)
