"""Selections: lazy, immutable, ordered queries over a dataset's version."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DiagnosticError, QueryError, SchemaError, Span, TraversalError
from ..functions.types import NUMERIC, ORDERABLE, from_spark
from ..plans import nodes as P
from ..plans.rewrite import rewrite
from . import frame as X
from . import graph
from .frame import HAS, Frame, Source, col

AGGREGATES = ("count", "sum", "avg", "min", "max", "median", "std")


def located(error: Exception, span: Span | None = None) -> Exception:
    """The diagnostic that a Spark error stands for."""
    if isinstance(error, DiagnosticError):
        return error.at(span)
    m = re.search(r"\[orrery:(\w+)\] ([^\n\"]*)", str(error))
    return QueryError(m[2].strip(), code=m[1]).at(span) if m else error


@dataclass(frozen=True)
class Selection:
    source: Source
    nodes: tuple[P.Node, ...] = ()
    span: Span | None = None

    @property
    def name(self) -> str:
        return self.source.name

    def _add(self, node: P.Node) -> Selection:
        return replace(self, nodes=(*self.nodes, node))

    # -- building ---------------------------------------------------------------------------------------------------------------------------

    def where(self, predicate: Mapping) -> Selection:
        return self._add(P.Filter(dict(predicate)))

    def project(self, *names: str, tree: tuple[P.Field, ...] | None = None) -> Selection:
        fields = tree or tuple(P.Field(n) for n in names)
        if not fields:
            raise QueryError("a projection needs a field", code="invalid_projection")
        return self._add(P.Projection(tuple(fields)))

    def order(self, *by: str | tuple) -> Selection:
        """Names, or (name, "asc" | "desc"). A later order is the primary one, and earlier ones break its ties."""
        keys = []
        for b in by:
            name, way = (b, "asc") if isinstance(b, str) else b
            way = {True: "desc", False: "asc"}.get(way, way)
            if way not in ("asc", "desc"):
                raise QueryError(f"{way!r} is no direction", code="invalid_order")
            keys.append((name, way == "desc"))
        return self._add(P.Order(tuple(keys)))

    def sort(self, *names: str, reverse: bool = False) -> Selection:
        return self._add(P.Order(tuple((n, reverse) for n in names)))

    def reverse(self) -> Selection:
        return self._add(P.Reverse())

    def _count(self, n: Any, what: str) -> int:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise QueryError(f"{what} needs a whole number of 0 or more", code=f"invalid_{what}")
        return n

    def offset(self, count: int) -> Selection:
        return self._add(P.Offset(self._count(count, "offset")))

    def limit(self, count: int) -> Selection:
        return self._add(P.Limit(self._count(count, "limit")))

    def unique(self, *names: str) -> Selection:
        return self._add(P.Unique(names))

    distinct = unique

    def flatten(self, name: str) -> Selection:
        return self._add(P.Flatten(name))

    def expand(self, name: str) -> Selection:
        return self._add(P.Expand(name))

    def similarity(self, name: str, vector: Any, *, metric: str = "cosine") -> Selection:
        values = tuple(vector) if isinstance(vector, (list, tuple)) else ()
        if metric not in ("cosine", "euclidean"):
            raise QueryError(f"unknown metric {metric!r}", code="invalid_metric")
        if not values or any(isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple") for v in values):
            raise QueryError("the query vector needs numbers", code="invalid_vector")
        if metric == "cosine" and not any(values):
            raise QueryError("a zero vector has no direction", code="invalid_vector")
        return self._add(P.Similarity(name, tuple(map(float, values)), metric))

    def distance(self, name: str, vector: Any, *, metric: str = "euclidean") -> Selection:
        return self.similarity(name, vector, metric=metric)

    def traverse(self, label: str, *, depth: int = 1, predicate: Mapping | None = None) -> Selection:
        if isinstance(depth, bool) or not isinstance(depth, int) or depth < 1:
            raise TraversalError("depth needs a positive whole number")
        if any(isinstance(n, P.Algebra) for n in self.nodes) and any(n.other.source.name != self.source.name for n in self.nodes if isinstance(n, P.Algebra)):
            raise TraversalError("a traversal starts from one graph")
        if self.source.kind != "graph":
            raise TraversalError(f"{self.source.name} is no graph")
        return self._add(P.Traversal(label, depth, dict(predicate) if predicate else None))

    def _algebra(self, other: Selection, operation: str, span: Span | None = None) -> Selection:
        if not isinstance(other, Selection):
            raise QueryError("algebra needs two selections", code="invalid_operand").at(span)
        return self._add(P.Algebra(operation, other, span))

    def union(self, other: Selection) -> Selection:
        return self._algebra(other, "union")

    def intersection(self, other: Selection) -> Selection:
        return self._algebra(other, "intersection")

    def difference(self, other: Selection) -> Selection:
        return self._algebra(other, "difference")

    def symmetric_difference(self, other: Selection) -> Selection:
        return self._algebra(other, "symmetric_difference")

    def product(self, other: Selection) -> Selection:
        return self._algebra(other, "product")

    __add__, __and__, __sub__, __xor__, __mul__ = union, intersection, difference, symmetric_difference, product

    def refine(self, query: Mapping) -> Selection | GroupedSelection | Aggregation:
        """The steps of a query mapping. ``filter`` comes first; a ``pipeline`` of {"operation": ...} mappings is followed in its order, and otherwise the keys traverse,
        similarity, select (or projection), order_by, offset and limit are. ``group_by`` and ``aggregate`` end the query."""
        s = self.where(query["filter"]) if query.get("filter") else self
        steps = query.get("pipeline")
        if steps is None:
            steps = [{"operation": k, **query[k]} for k in ("traverse", "similarity") if query.get(k)]
            if query.get("select") or query.get("projection"):
                steps.append({"operation": "project", "fields": query.get("select"), "projection": query.get("projection")})
            if query.get("order_by"):
                steps.append({"operation": "order", "by": query["order_by"]})
            steps += [{"operation": k, "count": query[k]} for k in ("offset", "limit") if query.get(k) is not None]
        for step in steps:
            s = s._mapped(dict(step))
        made: Any = s.group(query["group_by"]) if query.get("group_by") else s
        if query.get("aggregate"):
            made = made.aggregate(query["aggregate"]["operation"], query["aggregate"].get("field"))
        return made

    def _mapped(self, step: dict) -> Selection:
        what = step.pop("operation", None)
        if what == "where":
            return self.where(step["predicate"])
        if what == "project":
            return self.project(tree=tuple(map(_tree, step["projection"]))) if step.get("projection") else self.project(*step["fields"])
        if what == "order":
            if "by" in step:
                return self.order(*[(b["field"], b.get("direction", "asc")) for b in step["by"]])
            return self.order(*[(n, step.get("direction", "asc")) for n in step.get("fields") or [step["field"]]])
        if what in ("limit", "offset"):
            return getattr(self, what)(step["count"])
        if what in ("unique", "distinct"):
            return self.unique(*step.get("fields", ()))
        if what == "reverse":
            return self.reverse()
        if what in ("flatten", "expand"):
            return getattr(self, what)(step["field"])
        if what == "similarity":
            return self.similarity(step["field"], step["vector"], metric=step.get("metric", "cosine"))
        if what == "traverse":
            return self.traverse(step["label"], depth=step.get("depth", 1), predicate=step.get("predicate"))
        raise QueryError(f"unknown operation {what!r}", code="unknown_operation")

    def group(self, name: str) -> GroupedSelection:
        return GroupedSelection(self, name)

    def aggregate(self, operation: str, name: str | None = None) -> Aggregation:
        return Aggregation(self, operation, name)

    def count(self) -> Aggregation:
        return Aggregation(self, "count")

    def sum(self, name: str) -> Aggregation:
        return Aggregation(self, "sum", name)

    def avg(self, name: str) -> Aggregation:
        return Aggregation(self, "avg", name)

    def min(self, name: str) -> Aggregation:
        return Aggregation(self, "min", name)

    def max(self, name: str) -> Aggregation:
        return Aggregation(self, "max", name)

    def median(self, name: str) -> Aggregation:
        return Aggregation(self, "median", name)

    def std(self, name: str) -> Aggregation:
        return Aggregation(self, "std", name)

    # -- running ----------------------------------------------------------------------------------------------------------------------------

    def optimized(self) -> Selection:
        return replace(self, nodes=rewrite(self.nodes, self.source.indexed)[0])

    def explain(self) -> dict:
        """The plan before and after rewriting, and the rules used. Reads no data."""
        after, rules = rewrite(self.nodes, self.source.indexed)
        return {"dataset": self.source.name, "logical": [n.to_dict() for n in self.nodes], "optimized": [n.to_dict() for n in after], "rules": rules}

    def frame(self, ordered: bool = True, optimize: bool = True) -> Frame:
        """The DataFrame of the plan. Where nothing observes the order, it isn't kept: distinct, set operators and joins are then native."""
        plan = self.optimized().nodes if optimize else self.nodes
        observed = []
        need = ordered
        for n in reversed(plan):
            observed.append(need)
            if isinstance(n, (P.Limit, P.Offset)) or isinstance(n, P.Unique) and n.names:
                need = True
        f = self.source.frame()
        for i, (n, seen) in enumerate(zip(plan, reversed(observed))):
            f = self._apply(f, n, seen, plan[i + 1] if i + 1 < len(plan) else None)
        return f

    def _apply(self, f: Frame, n: P.Node, ordered: bool, following: P.Node | None = None) -> Frame:
        s = self.source
        if isinstance(n, (P.Filter, P.IndexLookup)):
            return X.where(f, n.predicate)
        if isinstance(n, P.Projection):
            return X.project(f, n.tree, s)
        if isinstance(n, P.Order):
            return X.order_by(f, n)
        if isinstance(n, P.Reverse):
            return X.reverse(f)
        if isinstance(n, P.Limit):
            return X.limit(f, n.count)
        if isinstance(n, P.Offset):
            return X.offset(f, n.count, isinstance(following, P.Limit))
        if isinstance(n, P.Unique):
            return X.unique(f, n.names, ordered)
        if isinstance(n, P.Flatten):
            return X.flatten(f, n.name)
        if isinstance(n, P.Expand):
            return X.expand(f, n.name)
        if isinstance(n, P.Similarity):
            if not s.schemaless and s.dimensions and n.name not in s.dimensions or s.dimensions.get(n.name) not in (None, len(n.vector)):
                f.need(n.name)
                raise QueryError(f"{n.name} is no vector of {len(n.vector)} numbers", code="invalid_vector", field=n.name)
            if not isinstance(f.df.schema[n.name].dataType if n.name in f.fields else f.need(n.name), T.ArrayType):
                raise QueryError(f"{n.name} is no vector", code="invalid_vector", field=n.name)
            return X.similarity(f, n.name, n.vector, n.metric)
        if isinstance(n, P.Traversal):
            return graph.traverse(f, n.label, n.depth, n.predicate, s, ordered)
        if isinstance(n, P.Algebra):
            try:
                return X.algebra(f, n.other.frame(ordered), n.operation, ordered)
            except SchemaError as e:
                raise e.at(n.span) from None
        raise QueryError(f"unknown plan node {n}")

    def to_df(self, ordered: bool = False) -> DataFrame:
        """Visible columns as a DataFrame; sorted if ``ordered``."""
        try:
            f = self.frame(ordered)
        except Exception as e:
            raise located(e, self.span) from e
        return (f.sorted() if ordered else f.df).select(*[col(n) for n in f.fields])

    def consume(self, *, optimize: bool = True) -> list[dict]:
        try:
            f = self.frame(True, optimize)
            rows = f.sorted().select(*f.visible()).collect()
        except (PySparkException, DiagnosticError) as e:
            raise located(e, self.span) from e
        return [record(r, f) for r in rows]

    def __iter__(self) -> Iterator[dict]:
        return iter(self.consume())

    def __len__(self) -> int:
        return self.count().consume()

    def __getitem__(self, i: Any) -> Any:
        return self.consume()[i]

    def __eq__(self, other: object) -> bool:
        if isinstance(other, Selection):
            return self.source is other.source and self.nodes == other.nodes
        return self.consume() == list(other) if isinstance(other, (list, tuple)) else NotImplemented

    __hash__ = None  # type: ignore[assignment]


def _tree(item: Any) -> P.Field:
    """A projected field given as a name, a Field, or {"name": ..., "children": [...]}."""
    if isinstance(item, P.Field):
        return item
    return P.Field(item) if isinstance(item, str) else P.Field(item["name"], tuple(map(_tree, item.get("children", ()))), item.get("span"))


def record(row: T.Row, f: Frame) -> dict:
    values = row.asDict()
    has = values.pop(HAS, None)
    names = [n for n in f.fields if has is None or n in has]
    return {n: from_spark(values[n], f.fields[n]) for n in names}


@dataclass(frozen=True)
class GroupedSelection:
    selection: Selection
    field: str

    def aggregate(self, operation: str, name: str | None = None) -> Aggregation:
        return Aggregation(self.selection, operation, name, self.field)

    def count(self) -> Aggregation:
        return self.aggregate("count")

    def __getattr__(self, operation: str) -> Any:
        if operation in AGGREGATES:
            return lambda name: self.aggregate(operation, name)
        raise AttributeError(operation)

    def to_df(self, ordered: bool = False) -> DataFrame:
        """(field, records): the groups by first row, each with its records in order. A group is one row, so it has to fit in a task; aggregates don't collect it."""
        f = self.selection.frame(True)
        f.need(self.field)
        # One exchange; records are sorted inside their group's array. A number makes their places differ, so that the records themselves are never compared.
        numbered = f.df.withColumn("__n", F.monotonically_increasing_id())
        place = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(X.rank_keys(f))], "__n").alias("place")
        records = F.array_sort(F.collect_list(F.struct(place, F.struct(*f.visible()).alias("r"))), lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1))
        out = numbered.groupBy(col(self.field)).agg(F.transform(records, lambda x: x["r"]).alias("records"), *_first_keys(f))
        if ordered:
            out = out.orderBy(*_group_order(f))
        return out.select(col(self.field), "records")

    def consume(self) -> list[dict]:
        try:
            f = self.selection.frame(True)
            rows = self.to_df(ordered=True).collect()
        except (PySparkException, DiagnosticError) as e:
            raise located(e, self.selection.span) from e
        return [{self.field: from_spark(r[self.field], f.fields[self.field]), "records": [record(x, f) for x in r["records"]]} for r in rows]

    def __iter__(self) -> Iterator[dict]:
        return iter(self.consume())

    def explain(self) -> dict:
        return self.selection.explain() | {"group": self.field}


_SIGNED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _first_keys(f: Frame) -> list:
    """The least place of each group."""
    parts = [c.alias(f"r{i}") for i, c in enumerate(X.rank_keys(f))]
    return [F.min(F.struct(*parts)).alias("__first")] if parts else [F.lit(0).alias("__first")]


def _group_order(f: Frame) -> list:
    return [F.col("__first").asc()]


@dataclass(frozen=True)
class Aggregation:
    selection: Selection
    operation: str
    field: str | None = None
    by: str | None = None

    def _column(self, f: Frame):
        op, name = self.operation, self.field
        if op == "count":
            return F.count(F.lit(1))
        t = f.need(name)
        kind = f.df.schema[name].dataType
        numeric = t is None and isinstance(kind, _SIGNED) or t is not None and t.bare.kind in NUMERIC
        if op in ("sum", "avg", "median", "std") and not numeric:
            raise QueryError(f"{op} needs numbers; {name} is {t or kind.simpleString()}", code="invalid_aggregation", field=name)
        if op in ("min", "max") and t is not None and t.bare.kind not in ORDERABLE:
            raise QueryError(f"{t} has no order", code="invalid_aggregation", field=name)
        c = col(name)
        return {"sum": lambda: F.coalesce(F.sum(c), F.lit(0).cast(F_SUM.get(type(kind), "double"))), "avg": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "median": lambda: F.median(c), "std": lambda: F.stddev_pop(c)}[op]()

    def to_df(self, ordered: bool = False) -> DataFrame:
        if self.operation not in AGGREGATES:
            raise QueryError(f"unknown aggregate {self.operation!r}", code="invalid_aggregation")
        if self.operation != "count" and not self.field:
            raise QueryError(f"{self.operation} needs a field", code="invalid_aggregation")
        if self.by == self.operation:
            raise SchemaError(f"the group's field is named like the aggregate: {self.by}", code="schema_mismatch")
        f = self.selection.frame(bool(ordered and self.by))
        value = self._column(f).alias(self.operation)
        if self.by is None:
            return f.df.agg(value)
        f.need(self.by)
        if not ordered:
            return f.df.groupBy(col(self.by)).agg(value)
        return f.df.groupBy(col(self.by)).agg(value, *_first_keys(f)).orderBy(*_group_order(f)).select(col(self.by), self.operation)

    def consume(self) -> Any:
        try:
            rows = self.to_df(ordered=True).collect()
            if self.by is None:
                return rows[0][0]
            f = self.selection.frame(False)
        except (PySparkException, DiagnosticError) as e:
            raise located(e, self.selection.span) from e
        return [{self.by: from_spark(r[self.by], f.fields[self.by]), self.operation: r[self.operation]} for r in rows]

    def explain(self) -> dict:
        return self.selection.explain() | {"aggregate": self.operation, "field": self.field} | ({"group": self.by} if self.by else {})


F_SUM = {T.LongType: "bigint", T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint", T.DecimalType: "decimal(38,18)"}
