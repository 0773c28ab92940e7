"""Datasets as immutable versions, transactions as stacks of them, and mutations that make new versions.

A version is a base DataFrame plus a short list of literal rows that were added since (as a log-structured table keeps what isn't flushed); rows go to Parquet when
``FLUSH`` of them have come together. A selection holds the version it was made from, so snapshots cost nothing.
"""

from __future__ import annotations

import itertools
import uuid as uuid_module
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConstraintError, QueryError, ReferenceError_, SchemaError, TransactionError, TypeMismatchError, UnknownDatasetError, UnsupportedError
from ..functions.types import QLType, Reference, cast_value, infer_type, of_spark, spark_type, to_spark
from ..operators import predicates
from ..operators.frame import HAS, Frame, Source, col, encode
from ..operators.selection import Selection, located
from .files import stored
from .schema import MISSING, DatasetSchema

KINDS = {"table": "table", "document": "document", "vector": "vector", "graph": "graph", "kv": "kv", "kvs": "kv"}
ORD = "__ord"
FILE = "__file"  # of rows of files: the path comes first in the order
LAST = "~"  # after every path
FLUSH = 10_000


def with_places(df: DataFrame) -> DataFrame:
    """``df`` with columns that tell the order of its rows. Rows of Parquet files have their file's path and their number in it, which let filters reach the scan;
    others are numbered as their partitions come."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation" and "_metadata" not in df.columns:
        try:
            return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ORD))
        except AnalysisException:  # a format without numbered rows
            pass
    return df.withColumn(ORD, F.monotonically_increasing_id())


def retyped(df: DataFrame, name: str, old: QLType | None, new: QLType | None, kind: T.DataType) -> DataFrame:
    """``df`` with a schemaless field as the type that it and other records have in common."""
    if new is not None and new.kind == "json" and old is not None and old.kind != "json":
        listed = F.to_json(F.array(col(name)))
        return df.withColumn(name, F.when(col(name).isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2)))
    if not isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)) and df.schema[name].dataType != kind:
        return df.withColumn(name, col(name).cast(kind))
    return df


def merge_json(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """The Spark type that both read as; text where they differ."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        own = {x.name: x.dataType for x in a}
        for x in b:
            own[x.name] = merge_json(own.get(x.name), x.dataType)
        return T.StructType([T.StructField(n, t) for n, t in own.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_json(a.elementType, b.elementType))
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    return T.StringType()


def json_type(v: Any) -> T.DataType | None:
    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.LongType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, dict):
        return T.StructType([T.StructField(str(k), json_type(x)) for k, x in v.items()])
    if isinstance(v, (list, tuple, set)):
        inner: T.DataType | None = None
        for x in v:
            inner = merge_json(inner, json_type(x))
        return T.ArrayType(inner or T.NullType())
    return T.StringType()


def readable(t: T.DataType) -> T.DataType:
    """Null types, which from_json doesn't read, as text."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(x.name, readable(x.dataType)) for x in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(readable(t.elementType))
    return T.StringType() if isinstance(t, T.NullType) else t


def loose_type(v: Any) -> QLType | None:
    """The type of a schemaless value; None for null."""
    if v is None:
        return None
    if isinstance(v, str):
        return QLType("text")
    if isinstance(v, (dict, list, tuple, set, frozenset)):
        return QLType("json")
    return infer_type(v)


def loose_merge(a: QLType | None, b: QLType | None) -> QLType | None:
    if a is None or b is None or a == b:
        return b if a is None else a
    return QLType("float") if {a.kind, b.kind} == {"int", "float"} else QLType("json")


@dataclass(frozen=True)
class Version:
    name: str
    kind: str
    schema: DatasetSchema | None = None
    base: DataFrame | None = None
    base_fields: Mapping[str, QLType | None] = field(default_factory=dict)
    rows: tuple[tuple[int, dict], ...] = ()
    next: int = 0
    loose: Mapping[str, QLType | None] = field(default_factory=dict)
    json_types: Mapping[str, T.DataType] = field(default_factory=dict)
    links: tuple[dict, ...] = ()
    link_base: DataFrame | None = None
    link_fields: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # label -> names of its data
    link_types: Mapping[str, QLType | None] = field(default_factory=dict)  # of link_base's data
    next_link: int = 1
    hidden: tuple = ()  # ids or keys of base rows that later ones replace, or that are deleted
    cache: dict = field(default_factory=dict, compare=False)

    @property
    def schemaless(self) -> bool:
        return self.kind in ("graph", "kv")

    @property
    def fields(self) -> dict[str, QLType | None]:
        return dict(self.loose) if self.schema is None else dict(self.schema.types())

    @property
    def identity(self) -> tuple[str, ...]:
        if self.kind == "graph":
            return ("id",)
        return ("key",) if self.kind == "kv" else self.schema.identity if self.schema else ()


class Engine:
    """The catalog of one session's datasets."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.committed: dict[str, Version] = {}
        self.frames: list[tuple[str, dict[str, Version]]] = []
        self.storage = None
        if path is not None:
            from .storage import Storage

            self.storage = Storage(spark, path)
            self.committed = self.storage.load()
            self._check_references(self.committed)

    # -- transactions -----------------------------------------------------------------------------------------------------------------------

    @property
    def current(self) -> dict[str, Version]:
        return self.frames[-1][1] if self.frames else self.committed

    @property
    def datasets(self) -> dict[str, Version]:
        return self.current

    @property
    def active_transaction_id(self) -> str | None:
        return self.frames[-1][0] if self.frames else None

    def begin_transaction(self) -> str:
        ident = uuid_module.uuid4().hex
        self.frames.append((ident, dict(self.current)))
        return ident

    def _innermost(self, ident: str | None) -> tuple[str, dict[str, Version]]:
        if not self.frames:
            raise TransactionError("no transaction is open", code="no_transaction")
        if ident is not None and self.frames[-1][0] != ident:
            raise TransactionError("only the innermost transaction can end", code="transaction_order")
        return self.frames[-1]

    def commit_transaction(self, ident: str | None = None) -> None:
        ident, state = self._innermost(ident)
        if len(self.frames) > 1:
            self.frames.pop()
            self.frames[-1] = (self.frames[-1][0], state)
            return
        if self.storage is not None:
            state = self.storage.persist(state, self.committed, ident)
        self.frames.pop()
        self.committed = state

    def abort_transaction(self, ident: str | None = None) -> None:
        self._innermost(ident)
        self.frames.pop()

    @contextmanager
    def transaction(self) -> Iterator[str]:
        ident = self.begin_transaction()
        try:
            yield ident
            self.commit_transaction(ident)
        except BaseException:
            if any(i == ident for i, _ in self.frames):
                while self.frames and self.frames[-1][0] != ident:
                    self.frames.pop()
                self.frames.pop()
            raise

    def _mutate(self, change: Callable[[], Any]) -> Any:
        """A mutation is a transaction of its own, or part of the open one, which an error ends."""
        if not self.frames:
            with self.transaction():
                return change()
        try:
            return change()
        except BaseException:
            self.frames.pop()
            raise

    def _put(self, v: Version) -> None:
        self.frames[-1][1][v.name] = v

    # -- datasets ---------------------------------------------------------------------------------------------------------------------------

    def version(self, name: str) -> Version:
        if name not in self.current:
            raise UnknownDatasetError(f"dataset {name!r} not found", dataset=name)
        return self.current[name]

    def create_dataset(self, name: str, dtype: str = "graph", schema: Mapping | None = None) -> dict:
        def create() -> dict:
            if name in self.current:
                raise SchemaError(f"dataset {name!r} exists", code="dataset_exists")
            if dtype not in KINDS:
                raise SchemaError(f"{dtype!r} is no kind of dataset", code="invalid_dataset_type")
            kind = KINDS[dtype]
            made = None
            if kind in ("table", "document", "vector"):
                made = DatasetSchema.from_mapping(schema or {})
                for f in made.fields.values():
                    for target in references_in(f.type):
                        if target != name and target not in self.current:
                            raise SchemaError(f"{f.name}: {target!r} is no type and no dataset", field=f.name, code="unknown_type")
                        ident = made.identity if target == name else self.version(target).identity
                        if not ident:
                            raise SchemaError(f"{f.name}: {target} has no identity", field=f.name)
            elif schema:
                raise SchemaError(f"{kind} datasets declare no fields")
            self._put(Version(name, kind, made, loose={"key": QLType("text"), "value": None} if kind == "kv" else {"id": None} if kind == "graph" else {}))
            return {"status": "success", "dataset": name}

        return self._mutate(create)

    def register(self, name: str, df: DataFrame, kind: str = "table", identity: tuple[str, ...] = (), references: Mapping[str, str] | None = None, **json_types: T.DataType) -> Selection:
        """An outside DataFrame as a dataset. Its rows are in the order of the files' paths and of the rows in them. ``references`` names the dataset that a field's values
        (its key, or a struct of it) are records of."""
        for n, target in (references or {}).items():
            ident = self.version(target).identity
            if not ident:
                raise SchemaError(f"{n}: {target} has no identity", field=n)
            if not isinstance(df.schema[n].dataType, T.StructType):
                if len(ident) != 1:
                    raise SchemaError(f"{n}: {target} has a key of several fields", field=n)
                key = self._identities(self.current)[target][ident[0]].dataType
                df = df.withColumn(n, F.when(col(n).isNotNull(), F.struct(col(n).cast(key).alias(ident[0]))))
        shown = lambda c, t: (references or {}).get(c) or ("json" if c in json_types else of_spark(t.dataType))
        spec = {c: {"type": shown(c, t), "constraints": ["pk"] if c in identity else ["nullable"]} for c, t in zip(df.columns, df.schema)}
        schema = DatasetSchema.from_mapping(spec)

        def put() -> None:
            base = with_places(df)
            after = 0 if FILE in base.columns else 1 << 62
            if kind in ("graph", "kv"):
                base = base.withColumn(HAS, F.array(*[F.lit(c) for c in df.columns]))
                loose = {n: t.bare for n, t in schema.types().items()}
                self._put(Version(name, kind, None, base, loose, loose=loose, json_types=json_types, next=after))
            else:
                self._put(Version(name, kind, schema, base, dict(schema.types()), json_types=json_types, next=after))

        self._mutate(put)
        return self.select(name)

    def register_links(self, name: str, df: DataFrame) -> None:
        """Links of a graph from a DataFrame: label, source, target, optional bidir, and columns of data."""

        def put() -> None:
            v = self.version(name)
            data = tuple(c for c in df.columns if c not in ("id", "label", "source", "target", "bidir"))
            out = df if "bidir" in df.columns else df.withColumn("bidir", F.lit(False))
            out = out if "id" in df.columns else out.withColumn("id", F.monotonically_increasing_id())
            labels = [r[0] for r in df.select("label").distinct().collect()]
            self._put(replace(v, link_base=out, link_fields={label: data for label in labels}, next_link=1 << 62, cache={}))

        self._mutate(put)

    def source(self, v: Version, snapshot: dict[str, Version] | None = None) -> Source:
        snapshot = dict(self.current) if snapshot is None else snapshot

        def resolve(name: str) -> Source:
            if name not in snapshot:
                raise UnknownDatasetError(f"dataset {name!r} not found", dataset=name)
            return self.source(snapshot[name], snapshot)

        return Source(
            v.name, v.kind, lambda: self._frame(v, snapshot), v.fields, v.identity, v.schema.indexed if v.schema else frozenset(), v.schema.dimensions if v.schema else {},
            (lambda: self._links(v)) if v.kind == "graph" else None, lambda label: set(v.link_fields.get(label, ())), resolve, v.cache,
        )

    def select(self, name: str) -> Selection:
        return Selection(self.source(self.version(name)))

    def _identities(self, snapshot: Mapping[str, Version]) -> dict[str, T.StructType]:
        out = {}
        for n, v in snapshot.items():
            fields = v.fields
            out[n] = T.StructType([T.StructField(k, spark_type((fields.get(k) or QLType("int")).bare)) for k in v.identity])
        return out

    def _frame(self, v: Version, snapshot: Mapping[str, Version]) -> Frame:
        if "frame" not in v.cache:
            fields = v.fields
            ids = self._identities(snapshot)
            types = {n: spark_type(t, ids) if t is not None else T.StringType() for n, t in fields.items()}
            filed = v.base is not None and FILE in v.base.columns
            places = [T.StructField(FILE, T.StringType()), T.StructField(ORD, T.LongType())][0 if filed else 1 :]
            schema = T.StructType([*places, *[T.StructField(n, t) for n, t in types.items()], *([T.StructField(HAS, T.ArrayType(T.StringType()))] if v.schemaless else [])])
            data = []
            for i, r in v.rows:
                values = [None if r.get(n) is None else encode(r[n]) if t is not None and t.kind == "json" and v.schemaless else float(r[n]) if t == QLType("float") else to_spark(r[n], t) for n, t in fields.items()]
                data.append((*((LAST, i) if filed else (i,)), *values, *([list(r)] if v.schemaless else [])))
            if v.base is None:
                df = self.spark.createDataFrame(data, schema)
            else:
                df = self._shown(v)
                for n, t in fields.items():
                    if n not in df.columns:
                        df = df.withColumn(n, F.lit(None).cast(types[n]))
                    elif v.rows or v.schemaless:
                        df = retyped(df, n, v.base_fields.get(n), t, types[n] if v.rows else df.schema[n].dataType)
                if v.rows:
                    df = df.unionByName(self.spark.createDataFrame(data, schema))
            v.cache["frame"] = Frame(df, tuple((p.name, True) for p in places), fields, {k: readable(t) for k, t in v.json_types.items()}, v.schemaless)
        return v.cache["frame"]

    def _shown(self, v: Version) -> DataFrame:
        """The base without the rows that are replaced or deleted: a short list of their keys is a filter, a longer one (of ``FLUSH`` at most) a join."""
        if not v.hidden:
            return v.base
        key = v.identity[0]
        kind = v.base.schema[key].dataType
        if len(v.hidden) <= 32:
            return v.base.where(~col(key).isin(*v.hidden) | col(key).isNull())
        gone = self.spark.createDataFrame([(k,) for k in v.hidden], T.StructType([T.StructField(key, kind)]))
        return v.base.join(F.broadcast(gone), key, "left_anti").select(*[col(c) for c in v.base.columns])

    def _hide(self, v: Version, keys: list) -> tuple:
        return tuple(dict.fromkeys((*v.hidden, *keys))) if v.base is not None else ()

    def _links(self, v: Version) -> tuple[DataFrame, dict[str, QLType | None]]:
        names = list(dict.fromkeys(n for fields in v.link_fields.values() for n in fields))
        ident = spark_type(v.loose["id"] or QLType("int")) if v.loose.get("id") is None or v.loose["id"].kind != "json" else T.StringType()
        as_id = (lambda x: encode(x)) if v.loose.get("id") is not None and v.loose["id"].kind == "json" else (lambda x: x)
        types: dict[str, QLType | None] = {}
        for n in names:
            t = None
            for link in v.links:
                t = loose_merge(t, loose_type(link["data"].get(n)))
            types[n] = t
        old: dict[str, QLType | None] = {}
        if v.link_base is not None:
            old = {n: v.link_types.get(n) or of_spark(v.link_base.schema[n].dataType) for n in names if n in v.link_base.columns}
            types |= {n: loose_merge(t, types.get(n)) for n, t in old.items()}
        schema = T.StructType(
            [T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("source", ident), T.StructField("target", ident), T.StructField("bidir", T.BooleanType())]
            + [T.StructField(n, spark_type(t) if t is not None else T.StringType()) for n, t in types.items()]
        )
        rows = [
            (x["id"], x["label"], as_id(x["source"]), as_id(x["target"]), x["bidir"], *[None if x["data"].get(n) is None else encode(x["data"][n]) if t is not None and t.kind == "json" else float(x["data"][n]) if t == QLType("float") else to_spark(x["data"][n], t) for n, t in types.items()])
            for x in v.links
        ]
        df = self.spark.createDataFrame(rows, schema)
        if v.link_base is not None:
            base = v.link_base
            for n, t in old.items():
                if rows and types[n] is not None:
                    base = retyped(base, n, t, types[n], spark_type(types[n]))
            df = base if not rows else base.unionByName(df, allowMissingColumns=True)
        return df, types

    # -- queries as mappings ----------------------------------------------------------------------------------------------------------------

    def execute_query(self, query: Mapping) -> Any:
        """A query as a mapping with ``action``: create_dataset, insert, insert_selection, add_link, select, update, delete, batch (or transaction)."""
        q, action = query, query.get("action")
        chosen = lambda x: x if isinstance(x, Selection) else self.execute_query(x)
        if action == "create_dataset":
            return self.create_dataset(q.get("name") or q["dataset"], q.get("type", "graph"), q.get("schema"))
        if action == "insert":
            return self.insert(q["dataset"], q["objects"])
        if action == "insert_selection":
            return self.insert_selection(q["dataset"], chosen(q["source"]))
        if action == "add_link":
            p = q["properties"]
            return self.add_link(chosen(q["source"]), chosen(q["target"]), label=p["label"], bidir=p.get("bidir", False), data=p.get("data"))
        if action == "update":
            return self.update(q["dataset"], q["values"], q.get("filter"))
        if action == "delete":
            return self.delete(q["dataset"], q.get("filter"))
        if action in ("batch", "transaction"):
            with self.transaction():
                return [self.execute_query(x) for x in q.get("queries", ())]
        if action != "select":
            raise QueryError(f"unknown action {action!r}", code="unknown_action")
        s = self.select(q["dataset"]).refine(q)
        return s.explain() if q.get("explain") else s

    # -- mutations --------------------------------------------------------------------------------------------------------------------------

    def insert(self, name: str, records: Any) -> dict:
        records = [records] if isinstance(records, Mapping) else list(records)

        def change() -> dict:
            seen: set[int] = set()
            idents = self._insert(name, records, seen)
            v = self.version(name)
            return {"status": "success", "inserted": len(records)} | ({"ids": idents} if v.kind == "graph" else {})

        return self._mutate(change)

    def _insert(self, name: str, records: list, seen: set[int]) -> list:
        v = self.version(name)
        if v.kind == "kv":
            return self._insert_pairs(v, records)
        if v.kind == "graph":
            return self._insert_nodes(v, records)
        made = []
        for r in records:
            for n in r:
                if n not in v.schema.fields:
                    raise ConstraintError(f"there is no field {n!r}", code="unknown_field", field=n)
            resolved = {n: self._resolve(v.schema.fields[n].cast_type, x, seen) if n in v.schema.fields else x for n, x in r.items()}
            made.append(v.schema.insert(resolved))
        v = self.version(name)  # resolving may have added rows to this very dataset
        self._check_new(v, made)
        types = dict(v.json_types)
        for r in made:
            for n, f in v.schema.fields.items():
                if f.type.bare.kind == "json" and r[n] is not None:
                    types[n] = merge_json(types.get(n), json_type(r[n]))
        rows = (*v.rows, *[(v.next + i, r) for i, r in enumerate(made)])
        self._put(self._flushed(replace(v, rows=rows, next=v.next + len(made), json_types=types, cache={})))
        return [tuple(r[k] for k in v.identity) for r in made]

    def _flushed(self, v: Version) -> Version:
        if len(v.rows) < FLUSH and len(v.hidden) < FLUSH:
            return v
        f = self._frame(v, self.current)
        return replace(v, base=stored(f.df), base_fields=v.fields, rows=(), hidden=(), cache={})

    def _insert_nodes(self, v: Version, records: list) -> list:
        loose, types, rows = dict(v.loose), dict(v.json_types), dict((r["id"] if _hashable(r["id"]) else encode(r["id"]), (i, r)) for i, r in v.rows)
        at, replaced = v.next, []
        for r in records:
            if r.get("id") is None:
                raise ConstraintError("a node needs an id", code="required", field="id")
            r = {n: self._plain(x) for n, x in r.items()}
            key = r["id"] if _hashable(r["id"]) else encode(r["id"])
            for n, x in r.items():
                loose[n] = loose_merge(loose.get(n), loose_type(x))
                if isinstance(x, (dict, list, tuple)):
                    types[n] = merge_json(types.get(n), json_type(x))
            if key in rows:
                rows[key] = (rows[key][0], r)
            else:
                rows[key] = (at, r)
                at += 1
            replaced.append(r["id"])
        hidden = self._hide(v, [x if _hashable(x) else encode(x) for x in replaced])
        self._put(self._flushed(replace(v, hidden=hidden, rows=tuple(rows.values()), next=at, loose=loose, json_types=types, cache={})))
        return replaced

    def _insert_pairs(self, v: Version, records: list) -> list:
        for r in records:
            if set(r) != {"key", "value"}:
                raise ConstraintError("a pair has a key and a value", code="invalid_record")
            if not _hashable(r["key"]) or r["key"] is None:
                raise ConstraintError("a key must be a scalar", code="invalid_key")
        rows = {r["key"]: (i, r) for i, r in v.rows}
        loose, types, at = dict(v.loose), dict(v.json_types), v.next
        if not rows and v.base is None:
            loose["key"] = None
        for r in records:
            r = {n: self._plain(x) for n, x in r.items()}
            for n, x in r.items():
                loose[n] = loose_merge(loose.get(n), loose_type(x))
                if isinstance(x, (dict, list, tuple)):
                    types[n] = merge_json(types.get(n), json_type(x))
            rows[r["key"]] = (rows[r["key"]][0] if r["key"] in rows else at, r)
            at += 1
        hidden = self._hide(v, [r["key"] for r in records])
        self._put(self._flushed(replace(v, hidden=hidden, rows=tuple(rows.values()), next=at, loose=loose, json_types=types, cache={})))
        return [r["key"] for r in records]

    def _plain(self, x: Any) -> Any:
        if isinstance(x, Selection):
            return [self._plain(r) for r in x.consume()]
        return x

    def _check_new(self, v: Version, made: list[dict]) -> None:
        """Primary keys and unique fields over the rows that exist and the new ones."""
        keys = ([v.schema.key] if v.schema.key else []) + [(n,) for n in v.schema.uniques]
        for names in keys:
            code = "primary_key" if names == v.schema.key else "unique"
            ident = lambda r: tuple(repr(r[n]) for n in names)  # noqa: B023,E731
            known = {ident(r) for _, r in v.rows if all(r[n] is not None for n in names)}
            fresh = []
            for r in made:
                if any(r[n] is None for n in names):
                    continue
                if ident(r) in known:
                    raise ConstraintError(f"{', '.join(names)} must be unique", code=code, fields=list(names))
                known.add(ident(r))
                fresh.append(r)
            if v.base is not None and fresh:
                schema = T.StructType([v.base.schema[n] for n in names])
                new = self.spark.createDataFrame([tuple(to_spark(r[n], v.fields[n]) for n in names) for r in fresh], schema)
                if v.base.select(*names).join(new, list(names), "left_semi").limit(1).count():
                    raise ConstraintError(f"{', '.join(names)} must be unique", code=code, fields=list(names))

    def insert_selection(self, name: str, selection: Selection) -> dict:
        """The rows of a selection, as they are before the insert. Where its fields suit the schema, rows go from one DataFrame to the other and the constraints are
        checked by queries; else (references to resolve, values to convert one by one) they pass through the driver like literals."""

        def change() -> dict:
            v = self.version(name)
            moved = None if v.schemaless else self._suited(v, selection)
            if v.schemaless and (merged := self._merged(v, selection)) is not None:
                self._put(merged[0])
                return {"status": "success", "inserted": merged[1]}
            if moved is None:
                return self.insert(name, selection.consume())
            new, types = moved
            new = stored(new)
            n = new.count()
            if n:
                self._check_moved(v, new)
                own = self._frame(v, self.current).df
                last = new.agg(F.max(ORD)).first()[0]
                new = new.withColumn(FILE, F.lit(LAST)) if FILE in own.columns else new
                self._put(replace(v, base=stored(own.unionByName(new.select(*own.columns))), base_fields=v.fields, rows=(), next=last + 1, json_types=types, cache={}))
            return {"status": "success", "inserted": n}

        return self._located(change)

    def _merged(self, v: Version, selection: Selection) -> tuple[Version, int] | None:
        """A graph or key/value dataset with the selection's records as nodes or pairs, by joins, and their number. None for at most ``FLUSH`` records, and where values
        have to be brought to a common type one by one."""
        f, key = selection.frame(True), v.identity[0]
        simple = {n: QLType("text") if t is not None and t.bare.kind in ("char", "str") else t.bare if t is not None else None for n, t in f.fields.items()}
        empty = v.base is None and not v.rows
        if f.schemaless or key not in simple or v.kind == "kv" and set(simple) != {"key", "value"} or any(t is None or t.kind not in ("int", "float", "bool", "text", "date", "datetime") for t in simple.values()):
            return None
        if not empty and any(n in v.loose and v.loose[n] != t for n, t in simple.items()):
            return None
        names = [n for n in simple if n != key]
        new = stored(f.sorted().select(*[col(n).cast(spark_type(t)).alias(n) for n, t in simple.items()], (F.monotonically_increasing_id() + v.next).alias(ORD)))
        n = new.count()
        if n <= FLUSH:
            return None
        if new.where(col(key).isNull()).limit(1).count():
            raise ConstraintError(f"a record needs a {key}", code="required" if v.kind == "graph" else "invalid_key", field=key)
        after = new.agg(F.max(ORD)).first()[0] + 1
        # Of records with one key the last stays, at the place of the first; one that the dataset has already keeps its place there.
        last = new.groupBy(col(key)).agg(F.min(ORD).alias(ORD), F.max_by(F.struct(F.lit(0).alias("__"), *map(col, names)), ORD).alias("__r"))
        one = last.select(col(key), ORD, *[F.col("__r")[n].alias(n) for n in names], F.array(*[F.lit(n) for n in simple]).alias(HAS))
        if not empty:
            own = self._frame(v, self.current).df
            places = [c for c in (FILE, ORD) if c in own.columns]
            placed = one.withColumn(FILE, F.lit(LAST)) if FILE in places else one
            placed = placed.join(own.select(col(key), *[col(c).alias(f"{c}0") for c in places]), key, "left").withColumns({c: F.when(F.col(f"{ORD}0").isNotNull(), F.col(f"{c}0")).otherwise(F.col(c)) for c in places}).drop(*[f"{c}0" for c in places])
            one = own.join(one.select(col(key)), key, "left_anti").unionByName(placed, allowMissingColumns=True)
        loose = {**({} if empty else v.loose), **simple}
        return replace(v, base=stored(one), base_fields=loose, loose=loose, rows=(), hidden=(), next=after, cache={}), n

    def _suited(self, v: Version, selection: Selection) -> tuple[DataFrame, dict] | None:
        """The rows as columns of v's schema, in order, or None where single values must be converted."""
        f = selection.frame(True)
        unknown = [n for n in f.fields if n not in v.schema.fields]
        if unknown:
            raise ConstraintError(f"there is no field {unknown[0]!r}", code="unknown_field", field=unknown[0])
        types, out = dict(v.json_types), []
        ids = self._identities(self.current)
        for n, s in v.schema.fields.items():
            want = s.type.bare
            spark_kind = spark_type(want, ids)
            if n not in f.fields:
                if s.default is MISSING and not s.cast_type.kind == "nullable":
                    raise ConstraintError(f"{n} is required", code="required", field=n)
                if s.default is not MISSING and not _scalar(s.default):
                    return None
                out.append((F.lit(None) if s.default is MISSING else F.lit(to_spark(s.default, s.cast_type))).cast(spark_kind).alias(n))
                continue
            have = f.fields[n].bare if f.fields[n] is not None else None
            if want.kind == "reference" and have is not None and have.kind != "reference" and not f.schemaless:
                ident = ids[want.args[0]]
                if len(ident) != 1 or not isinstance(f.df.schema[n].dataType, type(ident[0].dataType)):
                    return None
                out.append(F.when(col(n).isNotNull(), F.struct(col(n).cast(ident[0].dataType).alias(ident[0].name))).cast(spark_kind).alias(n))  # a key stands for its record
                continue
            alike = have is not None and (have == want or {have.kind, want.kind} <= {"char", "str", "text"} or (have.kind, want.kind) == ("int", "float"))
            if not alike or f.schemaless or references_in(want) and f.df.schema[n].dataType != spark_kind:
                return None
            if want.kind == "json":
                if not isinstance(f.df.schema[n].dataType, T.StringType):
                    return None
                if n in f.json_types:
                    types[n] = merge_json(types.get(n), f.json_types[n])
            out.append(col(n).cast(spark_kind).alias(n))
        df = f.sorted().select(*out)
        return df.withColumn(ORD, F.monotonically_increasing_id() + F.lit(v.next)), types

    def _check_moved(self, v: Version, new: DataFrame) -> None:
        tests = []
        for n, s in v.schema.fields.items():
            c, want = col(n), s.type.bare
            if s.cast_type.kind != "nullable":
                tests.append((n, "primary_key_null" if s.pk else "null", c.isNull()))
            if want.kind == "str":
                tests.append((n, "type", F.length(c) > want.args[0]))
            elif want.kind == "char":
                tests.append((n, "type", F.length(c) != 1))
            elif want.kind == "enum":
                tests.append((n, "type", ~c.isin(*want.args)))
            if s.vector and s.dimension:
                tests.append((n, "vector_dimension", F.size(c) != s.dimension))
        if tests:
            found = new.agg(*[F.count(F.when(t, 1)).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)]).first()
            for i, (n, code, _) in enumerate(tests):
                if found[i]:
                    raise ConstraintError(f"{n}: {found[i]} values don't fit {v.schema.fields[n].type}", code=code, field=n)
        for n, s in v.schema.fields.items():
            for target in references_in(s.type):
                t = self.version(target)
                ident = self._frame(t, self.current).df.select(*[col(k).alias(f"__i{i}") for i, k in enumerate(t.identity)])
                for refs in reference_columns(new, n, s.type, target):
                    if refs.where("__ref is not null").join(ident, [F.col("__ref")[k] == F.col(f"__i{i}") for i, k in enumerate(t.identity)], "left_anti").limit(1).count():
                        raise ReferenceError_(f"{n} leads to no record of {target}", code="missing_reference", dataset=target)
        own = self._frame(v, self.current).df
        for names, code in ([(v.schema.key, "primary_key")] if v.schema.key else []) + [((u,), "unique") for u in v.schema.uniques]:
            keys = new.dropna(subset=list(names)).select(*names)
            if keys.groupBy(*names).count().where("count > 1").limit(1).count() or keys.join(own.select(*names), list(names), "left_semi").limit(1).count():
                raise ConstraintError(f"{', '.join(names)} must be unique", code=code, fields=list(names))

    def violations(self, name: str, selection: Selection) -> DataFrame:
        """What an insert of the selection would be refused for: (code, fields, row), a row per record that repeats a key or a unique value of another one or of the
        dataset, or that refers to no record. Reads the selection as a whole; changes nothing."""
        v = self.version(name)
        moved = None if v.schemaless else self._suited(v, selection)
        if moved is None:
            raise UnsupportedError(f"the fields don't suit {name}", dataset=name)
        new, own = moved[0], self._frame(v, self.current).df
        shown = F.struct(*[col(n) for n in v.schema.fields])
        found = [new.where("false").select(F.lit("").alias("code"), F.array().cast("array<string>").alias("fields"), shown.alias("row"))]
        tell = lambda df, code, names: found.append(df.select(F.lit(code).alias("code"), F.array(*map(F.lit, names)).alias("fields"), shown.alias("row")))
        for names, code in ([(v.schema.key, "primary_key")] if v.schema.key else []) + [((u,), "unique") for u in v.schema.uniques]:
            keys = new.select(*map(col, names)).dropna()
            twice = keys.groupBy(*names).count().where("count > 1").select(*names)
            tell(new.join(twice.unionByName(own.select(*map(col, names)).dropna().distinct()).distinct(), list(names), "left_semi"), code, names)
        for n, s in v.schema.fields.items():
            if s.type.bare.kind == "reference":
                t = self.version(s.type.bare.args[0])
                ident = self._frame(t, self.current).df.select(*[col(k).alias(f"__i{i}") for i, k in enumerate(t.identity)])
                tell(new.where(col(n).isNotNull()).join(ident, [col(n)[k] == F.col(f"__i{i}") for i, k in enumerate(t.identity)], "left_anti"), "missing_reference", (n,))
        return reduce(DataFrame.unionByName, found)

    def vacuum(self) -> None:
        """Remove the stored versions that the newest commit doesn't need, and what torn commits left. No one may read older versions, or commit, meanwhile."""
        if self.storage is not None:
            self.storage.vacuum()

    def update(self, name: str, values: Mapping, predicate: Mapping | None = None) -> dict:
        def change() -> dict:
            v = self.version(name)
            if v.schemaless:
                raise UnsupportedError(f"{v.kind} datasets can't be updated", dataset=name)
            if not values:
                raise QueryError("an update needs values", code="invalid_update")
            for n in values:
                if n not in v.schema.fields:
                    raise ConstraintError(f"there is no field {n!r}", code="unknown_field", field=n)
            done = v.schema.changes({n: self._resolve(v.schema.fields[n].cast_type, x, set()) for n, x in values.items()})
            v = self.version(name)
            f = self._frame(v, self.current)
            predicates.validate(predicate, f.fields)
            hit = predicates.as_column(predicate, f.fields)
            marked = f.df.withColumn("__hit", hit)
            n = marked.where("__hit").count()
            if not n:
                return {"status": "success", "updated": 0}
            ids = self._identities(self.current)
            new = {k: F.lit(None).cast(f.df.schema[k].dataType) if x is None else _typed(to_spark(x, v.fields[k]), spark_type(v.fields[k], ids), self.spark) for k, x in done.items()}
            for k in done:
                if v.schema.fields[k].readonly and marked.where(F.col("__hit") & ~col(k).eqNullSafe(new[k])).limit(1).count():
                    raise ConstraintError(f"{k} is read-only", code="readonly", field=k)
            if set(done) & ({*v.schema.key, *v.schema.uniques}):
                changed = F.lit(False)
                for k in v.identity:
                    changed = changed | (~col(k).eqNullSafe(new[k]) if k in new else F.lit(False))
                self._guard(v, marked.where(F.col("__hit") & changed), exclude=None)
            types = dict(v.json_types)
            for k, x in done.items():
                if v.schema.fields[k].type.bare.kind == "json" and x is not None:
                    types[k] = merge_json(types.get(k), json_type(x))
            out = marked.withColumns({k: F.when(F.col("__hit"), c).otherwise(col(k)) for k, c in new.items()}).drop("__hit")
            base = stored(out)
            for names, code in [(v.schema.key, "primary_key")] + [((u,), "unique") for u in v.schema.uniques]:
                if names and set(names) & set(done) and base.dropna(subset=list(names)).groupBy(*names).count().where("count > 1").limit(1).count():
                    raise ConstraintError(f"{', '.join(names)} must be unique", code=code, fields=list(names))
            self._put(replace(v, base=base, base_fields=v.fields, rows=(), json_types=types, cache={}))
            return {"status": "success", "updated": n}

        return self._located(change)

    def delete(self, name: str, predicate: Mapping | None = None) -> dict:
        def change() -> dict:
            v = self.version(name)
            if v.schemaless:
                raise UnsupportedError(f"rows of {v.kind} datasets can't be deleted by a query", dataset=name)
            f = self._frame(v, self.current)
            predicates.validate(predicate, f.fields)
            marked = f.df.withColumn("__hit", predicates.as_column(predicate, f.fields))
            n = marked.where("__hit").count()
            if n:
                self._guard(v, marked.where("__hit"), exclude=~predicates.as_column(predicate, f.fields))
                self._put(replace(v, base=stored(marked.where("not __hit").drop("__hit")), base_fields=v.fields, rows=(), cache={}))
            return {"status": "success", "deleted": n}

        return self._located(change)

    def _located(self, change: Callable[[], Any]) -> Any:
        try:
            return self._mutate(change)
        except Exception as e:
            raise located(e) from e

    def _guard(self, v: Version, affected: DataFrame, exclude: Column | None) -> None:
        """No row may still be referenced; references among the deleted rows don't count."""
        ident = affected.select(*[col(k).alias(f"__i{i}") for i, k in enumerate(v.identity)])
        for other in self.current.values():
            if other.schema is None:
                continue
            for n, f in other.schema.fields.items():
                if v.name not in references_in(f.type):
                    continue
                df = self._frame(other, self.current).df
                if other.name == v.name and exclude is not None:
                    df = df.where(exclude)
                for refs in reference_columns(df, n, f.type, v.name):
                    on = [F.col("__ref")[k] == F.col(f"__i{i}") for i, k in enumerate(v.identity)]
                    if refs.join(ident, on, "left_semi").limit(1).count():
                        raise ReferenceError_(f"{v.name} is referenced by {other.name}.{n}", code="reference_in_use", dataset=v.name)

    def _check_references(self, state: dict[str, Version]) -> None:
        """After a restart: no reference leads nowhere."""
        for v in state.values():
            if v.schema is None:
                continue
            for n, f in v.schema.fields.items():
                for target in references_in(f.type):
                    t = state[target]
                    ident = self._frame(t, state).df.select(*[col(k).alias(f"__i{i}") for i, k in enumerate(t.identity)])
                    for refs in reference_columns(self._frame(v, state).df, n, f.type, target):
                        on = [F.col("__ref")[k] == F.col(f"__i{i}") for i, k in enumerate(t.identity)]
                        if refs.where("__ref is not null").join(ident, on, "left_anti").limit(1).count():
                            raise ReferenceError_(f"{v.name}.{n} leads to no record", code="storage_corruption", dataset=v.name)

    # -- references -------------------------------------------------------------------------------------------------------------------------

    def _resolve(self, t: QLType, value: Any, seen: set[int]) -> Any:
        """Selections, keys and inline objects below a typed value become references."""
        kind = t.kind
        if value is None or not references_in(t):
            if isinstance(value, Selection):
                raise TypeMismatchError(f"a selection is no {t}")
            return value
        if kind == "nullable":
            return self._resolve(t.args[0], value, seen)
        if kind in ("list", "set"):
            items = value if isinstance(value, (list, tuple, set, frozenset)) else [value]
            out = []
            for x in items:
                if isinstance(x, Selection) and t.args[0].bare.kind == "reference":
                    out += self._all(x, t.args[0].bare.args[0])
                else:
                    out.append(self._resolve(t.args[0], x, seen))
            return out
        if kind == "tuple" and isinstance(value, (list, tuple)):
            return tuple(self._resolve(a, x, seen) for a, x in itertools.zip_longest(t.args, value))
        if kind == "map" and isinstance(value, Mapping):
            return {self._resolve(t.args[0], k, seen): self._resolve(t.args[1], x, seen) for k, x in value.items()}
        if kind != "reference":
            return value
        target = self.version(t.args[0])
        if isinstance(value, Reference):
            if value.dataset != target.name:
                raise ReferenceError_(f"a record of {value.dataset} is none of {target.name}", code="reference_conflict")
            self._exactly_one(target, dict(value.identity))
            return value
        if isinstance(value, Selection):
            found = self._all(value, target.name, 2)
            if len(found) != 1:
                raise ReferenceError_("the selection holds no record" if not found else "the selection holds several records", code="ambiguous_reference" if found else "missing_reference")
            return found[0]
        if isinstance(value, Mapping):
            return self._object(target, value, seen)
        if len(target.identity) != 1 or (target.schema and not target.schema.key):
            raise ReferenceError_(f"{target.name} has no single primary key", code="ambiguous_reference")
        return self._exactly_one(target, {target.identity[0]: value})

    def _all(self, s: Selection, target: str, most: int | None = None) -> list[Reference]:
        if s.source.name != target:
            raise ReferenceError_(f"records of {s.source.name} are none of {target}", code="reference_conflict")
        ident = self.version(target).identity
        rows = (s.limit(most) if most else s).consume()
        return [Reference(target, tuple((k, r[k]) for k in ident)) for r in rows]

    def _lookup(self, v: Version, match: Mapping) -> list[dict]:
        if v.base is None:  # literal rows only
            return [r for _, r in v.rows if all(n in r and r[n] == x for n, x in match.items())][:2]
        tests = [{"field": n, "op": "=", "value": x} for n, x in match.items()]
        return Selection(self.source(v)).where({"and": tests}).limit(2).consume()

    def _exactly_one(self, v: Version, match: Mapping) -> Reference:
        match = {n: cast_value(x, v.fields[n].bare) if v.fields.get(n) is not None else x for n, x in match.items()}
        found = self._lookup(v, match)
        if len(found) != 1:
            raise ReferenceError_(f"{v.name} has {'no' if not found else 'several'} records {dict(match)}", code="missing_reference" if not found else "ambiguous_reference", dataset=v.name)
        return Reference(v.name, tuple((k, found[0][k]) for k in v.identity))

    def _object(self, v: Version, value: Mapping, seen: set[int]) -> Reference:
        if id(value) in seen:
            raise ReferenceError_("the object holds itself", code="reference_cycle")
        seen.add(id(value))
        try:
            keys = ([v.schema.key] if v.schema and v.schema.key else []) + [(n,) for n in v.schema.uniques] if v.schema else [v.identity]
            complete = [k for k in keys if all(value.get(n) is not None for n in k)]
            found: list[dict] = []
            for k in complete:
                for r in self._lookup(v, {n: cast_value(value[n], v.fields[n].bare) if v.fields.get(n) is not None else value[n] for n in k}):
                    if r not in found:
                        found.append(r)
            if len(found) > 1:
                raise ReferenceError_(f"the object matches several records of {v.name}", code="ambiguous_reference")
            if found:
                if any(n in found[0] and _scalar(x) and _scalar(found[0][n]) and str(found[0][n]) != str(x) for n, x in value.items()):
                    raise ReferenceError_(f"the object differs from the record of {v.name} with its identity", code="reference_conflict")
                return Reference(v.name, tuple((k, found[0][k]) for k in v.identity))
            ident = self._insert(v.name, [value], seen)[0]
            return Reference(v.name, tuple(zip(v.identity, ident if isinstance(ident, tuple) else (ident,))))
        finally:
            seen.discard(id(value))

    # -- graph and key/value ----------------------------------------------------------------------------------------------------------------

    def add_link(self, source: Selection, target: Selection, *, label: str, bidir: bool = False, data: Mapping | None = None) -> dict:
        def change() -> dict:
            if source.source.name != target.source.name or source.source.kind != "graph":
                raise QueryError("a link joins two nodes of one graph", code="invalid_link")
            v = self.version(source.source.name)
            ends = []
            for s in (source, target):
                rows = s.limit(2).consume()
                if len(rows) != 1:
                    raise QueryError(f"an end of a link must be one node, not {'none' if not rows else 'several'}", code="invalid_link")
                ends.append(rows[0]["id"])
            link = {"id": v.next_link, "label": label, "source": ends[0], "target": ends[1], "bidir": bool(bidir), "data": dict(data or {})}
            fields = dict(v.link_fields)
            fields[label] = tuple(dict.fromkeys((*fields.get(label, ()), *link["data"])))
            self._put(replace(v, links=(*v.links, link), link_fields=fields, next_link=v.next_link + 1, cache={}))
            return {"status": "success", "link": link}

        return self._mutate(change)

    def kv(self, name: str) -> KeyValue:
        return KeyValue(self, name)


class KeyValue:
    """get, set, delete and keys of a key/value dataset."""

    def __init__(self, engine: Engine, name: str) -> None:
        if engine.version(name).kind != "kv":
            raise QueryError(f"{name} is no key/value dataset", code="invalid_dataset_type")
        self.engine, self.name = engine, name

    def set(self, key: Any, value: Any) -> None:
        self.engine.insert(self.name, {"key": key, "value": value})

    def get(self, key: Any, default: Any = None) -> Any:
        rows = self.engine.select(self.name).where({"field": "key", "op": "=", "value": key}).limit(1).consume()
        return rows[0].get("value") if rows else default

    def delete(self, key: Any) -> bool:
        def change() -> bool:
            v = self.engine.version(self.name)
            rows = tuple(x for x in v.rows if x[1]["key"] != key)
            there = len(rows) != len(v.rows) or v.base is not None and key not in v.hidden and v.base.where(col("key") == key).limit(1).count() > 0
            self.engine._put(self.engine._flushed(replace(v, rows=rows, hidden=self.engine._hide(v, [key]), cache={})))
            return there

        return self.engine._mutate(change)

    def keys(self) -> list:
        return [r["key"] for r in self.engine.select(self.name).project("key")]


def references_in(t: Any) -> set[str]:
    if not isinstance(t, QLType):
        return set()
    if t.kind == "reference":
        return {t.args[0]}
    return set().union(*map(references_in, t.args)) if t.args else set()


def reference_columns(df: DataFrame, name: str, t: QLType, target: str) -> list[DataFrame]:
    """One-column DataFrames (__ref) of all references to ``target`` below a field."""
    out: list[DataFrame] = []

    def walk(d: DataFrame, c: Column, t: QLType) -> None:
        t = t.bare
        if t.kind == "reference" and t.args[0] == target:
            out.append(d.select(c.alias("__ref")))
        elif t.kind in ("list", "set") and target in references_in(t):
            walk(d.select(F.explode(c).alias("__e")), F.col("__e"), t.args[0])
        elif t.kind == "map":
            for part, inner in ((F.map_keys(c), t.args[0]), (F.map_values(c), t.args[1])):
                if target in references_in(inner):
                    walk(d.select(F.explode(part).alias("__e")), F.col("__e"), inner)
        elif t.kind == "tuple":
            for i, inner in enumerate(t.args):
                if target in references_in(inner):
                    walk(d, c[f"_{i + 1}"], inner)

    walk(df, col(name), t)
    return out


def _typed(value: Any, t: T.DataType, spark: SparkSession) -> Column:
    """A literal of a type that may be nested."""
    if isinstance(t, T.ArrayType):
        return F.array(*[_typed(x, t.elementType, spark) for x in value]).cast(t)
    if isinstance(t, T.StructType):
        items = [value[x.name] for x in t] if isinstance(value, Mapping) else list(value)
        return F.struct(*[_typed(v, x.dataType, spark).alias(x.name) for v, x in zip(items, t)])
    if isinstance(t, T.MapType):
        return F.create_map(*[_typed(x, k, spark) for kv in value.items() for x, k in zip(kv, (t.keyType, t.valueType))]).cast(t)
    return F.lit(value).cast(t)


def _hashable(x: Any) -> bool:
    return isinstance(x, (str, int, float, bool, bytes)) or x is None or not isinstance(x, (dict, list, set))


def _scalar(x: Any) -> bool:
    return not isinstance(x, (dict, list, tuple, set, Reference, Selection))
