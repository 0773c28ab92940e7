"""A DataFrame with the order of its rows, the unit that operators turn into another."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, SchemaError, TypeMismatchError, UnknownFieldError
from ..functions.types import QLType
from ..plans.nodes import Field, Order
from ..sources.files import stored
from . import predicates, vector

HAS = "__has"  # of schemaless records: the names that the record has
MAP_FIELDS = 1000  # a map with more different keys is not expanded into fields


@dataclass(frozen=True)
class Source:
    """A dataset at one version."""

    name: str
    kind: str
    frame: Callable[[], Frame]
    fields: dict[str, QLType | None]
    identity: tuple[str, ...] = ()
    indexed: frozenset[str] = frozenset()
    dimensions: dict[str, int | None] = field(default_factory=dict)  # of vector fields
    edges: Callable[[], Any] | None = None
    edge_fields: Callable[[str], set[str]] | None = None
    resolve: Callable[[str], Source] | None = None
    cache: dict = field(default_factory=dict, compare=False)  # what has been computed for this version

    @property
    def schemaless(self) -> bool:
        return self.kind in ("graph", "kv")


@dataclass(frozen=True)
class Frame:
    """Visible columns are those in ``fields``; ``keys`` name hidden columns that order the rows (name, ascending)."""

    df: DataFrame
    keys: tuple[tuple[str, bool], ...]
    fields: dict[str, QLType | None]
    json_types: dict[str, T.DataType] = field(default_factory=dict)
    schemaless: bool = False
    is_sorted: bool = False  # the DataFrame's rows are in order already

    def order(self) -> list[Column]:
        return [F.col(k).asc_nulls_first() if asc else F.col(k).desc_nulls_last() for k, asc in self.keys]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.order()) if self.keys and not self.is_sorted else self.df

    def visible(self) -> list[Column]:
        return [col(n) for n in self.fields] + ([F.col(HAS)] if self.schemaless else [])

    def with_df(self, df: DataFrame, **changes: Any) -> Frame:
        return replace(self, df=df, **{"is_sorted": False, **changes})

    def need(self, name: str, span=None) -> QLType | None:
        if name not in self.fields:
            raise UnknownFieldError(f"there is no field {name!r}", field=name).at(span)
        return self.fields[name]

    def hidden(self) -> list[str]:
        return [k for k, _ in self.keys] + ([HAS] if self.schemaless else [])

    def unordered(self) -> Frame:
        return replace(self, df=self.df.select(*self.visible()), keys=())


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def fresh(frame: Frame, stem: str) -> str:
    used = set(frame.df.columns)
    i = 0
    while f"__{stem}{i}" in used:
        i += 1
    return f"__{stem}{i}"


def raise_(code: str, message: str) -> Column:
    return F.raise_error(F.lit(f"[orrery:{code}] {message}"))


def where(f: Frame, predicate: Any) -> Frame:
    predicates.validate(predicate, f.fields)
    df = f.df
    if f.schemaless:
        # A field that a record lacks is an error; one that it has as null isn't.
        for name in sorted(predicates.fields_of(predicate)):
            df = df.where(F.when(~F.array_contains(HAS, name), raise_("missing_field", f"a record has no field {name}").cast("boolean")).otherwise(True))
    return f.with_df(df.where(predicates.lower(predicate, f.fields)))


def order_by(f: Frame, node: Order) -> Frame:
    keys, df = [], f.df
    for name, descending in node.by:
        f.need(name)
        key = fresh(f.with_df(df), "k")
        df = df.withColumn(key, col(name))
        keys.append((key, not descending))
    return f.with_df(df, keys=(*keys, *f.keys))


def reverse(f: Frame) -> Frame:
    return replace(f, keys=tuple((k, not asc) for k, asc in f.keys))


def limit(f: Frame, n: int) -> Frame:
    return f.with_df(f.sorted().limit(n), is_sorted=True)


def offset(f: Frame, n: int, then_limit: bool = False) -> Frame:
    """Without the first n rows. Before a limit this is a part of the top-k node; alone it numbers rows by ranges of the order, so no task gets the whole table."""
    if then_limit or not f.keys:
        return f.with_df(f.sorted().offset(n), is_sorted=True)
    # Stored, so that the ranges can't change between counting and dropping.
    ranged = stored(f.df.repartitionByRange(*f.order()).sortWithinPartitions(*f.order()).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    left, first = n, 0
    for r in sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a partition
        if left < r["n"]:
            first = (r["part"] << 33) + left
            break
        left -= r["n"]
        first = (r["part"] + 1) << 33
    return f.with_df(ranged.where(F.col("__at") >= first).drop("__at"))


def canonical(f: Frame, names: list[str]) -> list[Column]:
    """Columns that are equal where the values are; maps become sorted entries, sets sorted arrays."""
    out = []
    for n in names:
        t, kind = f.fields[n], f.df.schema[n].dataType
        c = col(n)
        if isinstance(kind, T.MapType):
            c = F.array_sort(F.map_entries(c))
        elif t is not None and t.bare.kind == "set":
            c = F.array_sort(c)
        elif isinstance(kind, (T.VariantType,)):
            c = F.to_json(c)
        out.append(c)
    if f.schemaless:
        out.append(F.array_sort(F.col(HAS)))
    return out


def downward(c: Column, kind: T.DataType) -> list[Column]:
    """Columns whose ascending order is the descending one of c, which isn't null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [~F.isnan(c), -F.nanvl(c, F.lit(0.0))]  # NaN is the largest number
    if isinstance(kind, T.DecimalType):
        return [-c]
    if isinstance(kind, T.IntegralType):
        return [F.bitwise_not(c)]
    if isinstance(kind, T.TimestampType):
        return [-F.unix_micros(c)]
    if isinstance(kind, T.TimestampNTZType):
        return [-F.unix_micros(c.cast("timestamp"))]
    if isinstance(kind, T.DateType):
        return [-F.unix_date(c)]
    if isinstance(kind, T.BooleanType):
        return [~c]
    if isinstance(kind, T.ArrayType):
        items, element = c, kind.elementType
    else:  # by code points
        items, element = F.transform(F.split(c.cast("string"), ""), lambda x: F.when(x != "", F.ascii(x)).otherwise(-1)), T.IntegerType()

    def item(x: Column) -> Column:  # what is shorter comes after all that goes on; nulls come last
        keys = [x.isNull(), *[F.when(x.isNotNull(), k) for k in downward(x, element)]]
        return F.struct(F.lit(False).alias("end"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])

    return [F.concat(F.transform(items, item), F.array(item(F.lit(None).cast(element)).withField("end", F.lit(True))))]


def rank_keys(f: Frame) -> list[Column]:
    """Columns whose ascending order is the frame's: minima over them find first rows, with sums in each task before a shuffle."""
    out: list[Column] = []
    for k, asc in f.keys:
        c = F.col(k)
        out += [c] if asc else [c.isNull(), *downward(c, f.df.schema[k].dataType)]  # nulls come last downwards
    return out


def unique(f: Frame, names: tuple[str, ...], ordered: bool) -> Frame:
    for n in names:
        f.need(n)
    if not names and not ordered:
        plain = not any(isinstance(x.dataType, (T.MapType, T.VariantType)) for x in f.df.schema) and not any(t is not None and t.bare.kind == "set" for t in f.fields.values())
        if plain:
            return f.unordered().with_df(f.unordered().df.distinct(), keys=())
    # The first row of each group is a minimum, taken in every task before the exchange: a value that fills a third of the rows is no burden.
    groups = [c.alias(f"__g{i}") for i, c in enumerate(canonical(f, list(names or f.fields)))]
    ranks = rank_keys(f) or [F.lit(0)]
    row = F.struct(*[col(c).alias(c) for c in f.df.columns])
    df = f.df.groupBy(*groups).agg(F.min_by(row, F.struct(*[c.alias(f"r{i}") for i, c in enumerate(ranks)])).alias("__row"))
    return f.with_df(df.select("__row.*"))


def flatten(f: Frame, name: str) -> Frame:
    t = f.need(name)
    kind = f.df.schema[name].dataType
    c = col(name)
    if isinstance(kind, T.StringType) and t is not None and t.bare.kind == "json":
        inner = f.json_types.get(name)
        if not isinstance(inner, T.ArrayType):
            raise TypeMismatchError(f"{name} is no collection")
        c, kind = F.from_json(c, inner), inner
    if not isinstance(kind, T.ArrayType):
        raise TypeMismatchError(f"{name} is no collection", field=name)
    c = F.when(c.isNull(), raise_("type_mismatch", f"{name} is null").cast(kind)).otherwise(c)
    pos = fresh(f, "k")
    others = [x for x in f.df.columns if x != name]
    df = f.df.select(*[col(x) for x in others], F.posexplode(c).alias(pos, name))
    inner_type = t.bare.args[0] if t is not None and t.bare.kind in ("list", "set") else None
    return f.with_df(df, keys=(*f.keys, (pos, True)), fields=f.fields | {name: inner_type})


def object_fields(f: Frame, name: str) -> tuple[Column, dict[str, T.DataType]]:
    """A struct Column of an object field, and its members."""
    t, kind = f.need(name), f.df.schema[name].dataType
    if isinstance(kind, T.StructType):
        return col(name), {x.name: x.dataType for x in kind}
    if isinstance(kind, T.StringType) and (t is None or t.bare.kind == "json"):
        inner = f.json_types.get(name)
        if isinstance(inner, T.StructType):
            return F.from_json(col(name), inner), {x.name: x.dataType for x in inner}
    raise TypeMismatchError(f"{name} is no object", field=name)


def expand(f: Frame, name: str) -> Frame:
    t = f.need(name)
    if t is not None and t.bare.kind not in ("json", "map"):
        raise TypeMismatchError(f"{name} is no object", field=name)
    kind = f.df.schema[name].dataType
    if isinstance(kind, T.MapType):
        keys = [r[0] for r in f.df.select(F.explode(F.map_keys(col(name))).alias("k")).distinct().limit(MAP_FIELDS + 1).collect()]
        if len(keys) > MAP_FIELDS:
            raise SchemaError(f"{name} has more than {MAP_FIELDS} different keys, too many to expand into fields", code="schema_mismatch", fields=[name])
        value, members = F.struct(*[F.element_at(col(name), k).alias(k) for k in sorted(keys)]), {k: kind.valueType for k in sorted(keys)}
    else:
        value, members = object_fields(f, name)
    clash = [m for m in members if m in f.fields and m != name]
    if clash:
        raise SchemaError(f"{name} and the record share {clash}", code="schema_mismatch", fields=clash)
    tmp = fresh(f, "object")
    df = f.df.withColumn(tmp, F.when(col(name).isNull(), raise_("type_mismatch", f"{name} is null").cast(T.StructType([T.StructField(k, v) for k, v in members.items()]))).otherwise(value))
    others = [x for x in f.df.columns if x != name]
    df = df.select(*[col(x) for x in others], *[F.col(tmp)[m].alias(m) for m in members])
    if f.schemaless:
        df = df.withColumn(HAS, F.concat(F.array_remove(HAS, name), F.array(*[F.lit(m) for m in members])))
    fields = {k: v for k, v in f.fields.items() if k != name} | {m: None for m in members}
    return f.with_df(df, fields=fields)


def similarity(f: Frame, name: str, query: tuple[float, ...], metric: str) -> Frame:
    f.need(name)
    distance, similar = vector.score(col(name), query, metric)
    df = f.df.where(col(name).isNotNull()).withColumn("_distance", distance).withColumn("_similarity", similar)
    key = fresh(f, "k")
    df = df.withColumn(key, F.col("_distance"))
    if f.schemaless:
        df = df.withColumn(HAS, F.concat(HAS, F.array(F.lit("_distance"), F.lit("_similarity"))))
    return f.with_df(df, keys=((key, True), *f.keys), fields=f.fields | {"_distance": QLType("float"), "_similarity": QLType("float")})


def project(f: Frame, tree: tuple[Field, ...], source: Source) -> Frame:
    names = [x.name for x in tree]
    for x in tree:
        f.need(x.name, x.span)
    g = f
    for x in tree:
        if x.children:
            g = nested(g, x, source)
    df = g.df.select(*[F.col(k) for k in g.hidden()], *[col(n) for n in dict.fromkeys(names)])
    if g.schemaless:
        for n in names:
            df = df.where(F.when(~F.array_contains(HAS, n), raise_("unknown_field", f"a record has no field {n}").cast("boolean")).otherwise(True))
        df = df.withColumn(HAS, F.filter(HAS, lambda h: h.isin(*names)))
    return g.with_df(df, fields={n: g.fields[n] for n in dict.fromkeys(names)})


def nested(f: Frame, x: Field, source: Source) -> Frame:
    """Replace field x by an object (or a list of objects) of its wanted members."""
    t = f.fields[x.name]
    bare = t.bare if t is not None else None
    if bare is not None and bare.kind == "reference":
        return _one_reference(f, x, bare.args[0], source)
    if bare is not None and bare.kind in ("list", "set") and bare.args[0].bare.kind == "reference":
        return _many_references(f, x, bare.args[0].bare.args[0], source)
    kind = f.df.schema[x.name].dataType
    value: Column = col(x.name)
    if isinstance(kind, T.StringType) and (bare is None or bare.kind == "json"):
        kind = f.json_types.get(x.name) or T.StringType()
        value = F.from_json(value, kind) if isinstance(kind, (T.StructType, T.ArrayType)) else value
    return f.with_df(f.df.withColumn(x.name, _members(value, kind, x)), fields=f.fields | {x.name: None})


def _members(value: Column, kind: T.DataType, x: Field) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda e: _members(e, kind.elementType, x))
    if not isinstance(kind, T.StructType):
        raise TypeMismatchError(f"{x.name} holds no objects", field=x.name).at(x.span)
    inner = {s.name: s.dataType for s in kind}
    parts = []
    for c in x.children:
        if c.name not in inner:
            raise UnknownFieldError(f"{x.name} has no field {c.name!r}", field=c.name).at(c.span)
        parts.append((_members(value[c.name], inner[c.name], c) if c.children else value[c.name]).alias(c.name))
    return F.when(value.isNotNull(), F.struct(*parts))


def _target(x: Field, dataset: str, source: Source) -> tuple[DataFrame, Column, list[str]]:
    """(identity columns as __i0.., found object) of a referenced dataset, its own nested fields resolved."""
    if source.resolve is None:
        raise QueryError(f"{dataset} can't be resolved here", code="missing_reference")
    target = source.resolve(dataset)
    ident = list(target.identity)
    g = target.frame()
    for c in x.children:
        g.need(c.name, c.span)
    for c in x.children:
        if c.children:
            g = nested(g, c, target)
    found = F.struct(*[col(c.name).alias(c.name) for c in x.children])
    return g.df.select(*[col(n).alias(f"__i{i}") for i, n in enumerate(ident)], found.alias("__found")), found, ident


def _one_reference(f: Frame, x: Field, dataset: str, source: Source) -> Frame:
    target, _, ident = _target(x, dataset, source)
    on = [col(x.name)[n] == F.col(f"__i{i}") for i, n in enumerate(ident)]
    joined = f.df.join(target, on, "left")
    value = F.when(col(x.name).isNotNull() & F.col("__found").isNull(), raise_("missing_reference", f"{x.name} has no record in {dataset}").cast(joined.schema["__found"].dataType)).otherwise(F.col("__found"))
    df = joined.withColumn(x.name, value).drop("__found", *[f"__i{i}" for i in range(len(ident))])
    return f.with_df(df, fields=f.fields | {x.name: None})


def _many_references(f: Frame, x: Field, dataset: str, source: Source) -> Frame:
    target, _, ident = _target(x, dataset, source)
    others = [c for c in f.df.columns if c != x.name]
    rows = f.df.withColumn("__rid", F.monotonically_increasing_id())
    each = rows.select("__rid", *[col(c) for c in others], col(x.name).isNull().alias("__none"), F.posexplode_outer(col(x.name)).alias("__pos", "__ref"))
    joined = each.join(target, [F.col("__ref")[n] == F.col(f"__i{i}") for i, n in enumerate(ident)], "left")
    found = F.when(F.col("__ref").isNotNull() & F.col("__found").isNull(), raise_("missing_reference", f"{x.name} has no record in {dataset}").cast(joined.schema["__found"].dataType)).otherwise(F.col("__found"))
    item = F.when(F.col("__pos").isNotNull(), F.struct(F.col("__pos").alias("p"), found.alias("v")))
    grouped = joined.groupBy("__rid").agg(*[F.first(col(c)).alias(c) for c in others], F.first("__none").alias("__none"), F.array_sort(F.collect_list(item)).alias("__items"))
    value = F.when(~F.col("__none"), F.transform("__items", lambda s: s["v"]))
    return f.with_df(grouped.withColumn(x.name, value).drop("__rid", "__none", "__items"), fields=f.fields | {x.name: None})


def algebra(a: Frame, b: Frame, operation: str, ordered: bool) -> Frame:
    if operation == "product":
        left = a.df.select(*[F.col(k).alias(f"__a{i}") for i, (k, _) in enumerate(a.keys)], F.struct(*[col(n) for n in a.fields]).alias("left"))
        right = b.df.select(*[F.col(k).alias(f"__b{i}") for i, (k, _) in enumerate(b.keys)], F.struct(*[col(n) for n in b.fields]).alias("right"))
        keys = tuple((f"__a{i}", asc) for i, (_, asc) in enumerate(a.keys)) + tuple((f"__b{i}", asc) for i, (_, asc) in enumerate(b.keys))
        return Frame(left.crossJoin(right), keys, {"left": None, "right": None})
    if set(a.fields) != set(b.fields):
        raise SchemaError(f"{sorted(a.fields)} and {sorted(b.fields)} differ", code="schema_mismatch", left=sorted(a.fields), right=sorted(b.fields))
    a, b = align(a, b)
    if operation == "union":
        return unique(stacked(a, b, ordered), (), ordered)
    if operation == "intersection":
        return unique(matching(a, b, "left_semi"), (), ordered)
    if operation == "difference":
        return unique(matching(a, b, "left_anti"), (), ordered)
    return unique(stacked(matching(a, b, "left_anti"), matching(b, a, "left_anti"), ordered), (), ordered)


def align(a: Frame, b: Frame) -> tuple[Frame, Frame]:
    """The same columns, in one order, of one type."""
    b = replace(b, fields={n: b.fields[n] for n in a.fields})
    for n in a.fields:
        x, y = a.df.schema[n].dataType, b.df.schema[n].dataType
        if x != y and not isinstance(x, (T.ArrayType, T.StructType, T.MapType)):
            wide = T.DoubleType() if {type(x), type(y)} <= {T.LongType, T.IntegerType, T.DoubleType, T.FloatType} and {type(x), type(y)} & {T.DoubleType, T.FloatType} else x
            a, b = a.with_df(a.df.withColumn(n, col(n).cast(wide))), b.with_df(b.df.withColumn(n, col(n).cast(wide)))
    return a, b


def stacked(a: Frame, b: Frame, ordered: bool) -> Frame:
    if not ordered:
        return a.with_df(a.df.select(*a.visible()).unionByName(b.df.select(*b.visible())), keys=())
    size = (len(a.keys), len(b.keys))

    def side(f: Frame, which: int) -> DataFrame:
        types = [[f_.df.schema[k].dataType for k, _ in f_.keys] for f_ in (a, b)]
        own = [[F.col(k) if which == s else F.lit(None).cast(types[s][i]) for i, (k, _) in enumerate((a, b)[s].keys)] for s in (0, 1)]
        hidden = [F.lit(which).alias("__side"), *[c.alias(f"__u{i}") for i, c in enumerate([*own[0], *own[1]])]]
        return f.df.select(*hidden, *f.visible())

    keys = (("__side", True), *[(f"__u{i}", asc) for i, (_, asc) in enumerate((*a.keys, *b.keys))])
    assert len(keys) == sum(size) + 1
    return a.with_df(side(a, 0).unionByName(side(b, 1)), keys=keys)


def matching(a: Frame, b: Frame, how: str) -> Frame:
    """Rows of a that b has (left_semi) or lacks (left_anti): an equi-join on null-safe equal columns."""
    names = list(a.fields)
    mine = a.df.select("*", *[c.alias(f"__c{i}") for i, c in enumerate(canonical(a, names))])
    n = len(names) + (1 if a.schemaless else 0)
    other = b.df.select(*[c.alias(f"__d{i}") for i, c in enumerate(canonical(b, names))])
    on = F.lit(True)
    for i in range(n):
        on = on & F.col(f"__c{i}").eqNullSafe(F.col(f"__d{i}"))
    return a.with_df(mine.join(other, on, how).drop(*[f"__c{i}" for i in range(n)]))


def encode(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)
