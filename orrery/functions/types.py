"""The language's types, their values, and how Spark stores them."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import types as T

from ..errors import TypeMismatchError

PRIMITIVES = ("int", "float", "decimal", "bool", "char", "text", "date", "time", "datetime", "timestamp", "duration", "uuid", "bytes", "json")
NUMERIC = {"int", "float", "decimal"}
TEXTUAL = {"char", "str", "text"}
ORDERABLE = NUMERIC | TEXTUAL | {"date", "time", "datetime", "timestamp", "duration"}


@dataclass(frozen=True)
class QLType:
    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.kind == "reference":
            return str(self.args[0])
        return f"{self.kind}({', '.join(json.dumps(a) if isinstance(a, str) else str(a) for a in self.args)})" if self.args else self.kind

    @property
    def bare(self) -> QLType:
        return self.args[0] if self.kind == "nullable" else self


@dataclass(frozen=True)
class Reference:
    """The identity of a record in another dataset."""

    dataset: str
    identity: tuple[tuple[str, Any], ...]

    def to_dict(self) -> dict:
        return {"$ref": self.dataset, "identity": dict(self.identity)}


_TOKEN = re.compile(r"""\s*(?:([A-Za-z_]\w*)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(-?\d+(?:\.\d+)?)|([(),]))""")


def parse_type(source: str | QLType) -> QLType:
    """``list(str(20))``, ``nullable(users)``, ``enum("a", "b")``: a name that is no type is a dataset's."""
    if isinstance(source, QLType):
        return source
    parts, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TypeMismatchError(f"can't read the type {source!r}")
        parts.append(next((i, g) for i, g in enumerate(m.groups()) if g is not None))
        at = m.end()
    parts.append((9, ""))

    def one(i: int) -> tuple[Any, int]:
        kind, word = parts[i]
        if kind == 1:
            return json.loads('"' + word[1:-1].replace('"', '\\"') + '"') if word[0] == "'" else json.loads(word), i + 1
        if kind == 2:
            return (float(word) if "." in word else int(word)), i + 1
        if kind != 0:
            raise TypeMismatchError(f"can't read the type {source!r}")
        args: list = []
        i += 1
        if parts[i] == (3, "("):
            i += 1
            while parts[i] != (3, ")"):
                value, i = one(i)
                args.append(value)
                if parts[i] == (3, ","):
                    i += 1
                elif parts[i] != (3, ")"):
                    raise TypeMismatchError(f"can't read the type {source!r}")
            i += 1
        return make_type(word, args), i

    found, end = one(0)
    if parts[end][0] != 9 or not isinstance(found, QLType):
        raise TypeMismatchError(f"can't read the type {source!r}")
    return found


def make_type(name: str, args: list) -> QLType:
    low = name.lower()
    bad = lambda why: TypeMismatchError(f"{name}: {why}")
    if low in PRIMITIVES:
        if args:
            raise bad("takes no arguments")
        return QLType(low)
    if low == "str":
        if len(args) != 1 or not isinstance(args[0], int) or args[0] <= 0:
            raise bad("needs a positive length")
        return QLType("str", (args[0],))
    if low in ("list", "set", "nullable"):
        if len(args) != 1 or not isinstance(args[0], QLType):
            raise bad("needs one type")
        if low == "nullable" and args[0].kind == "nullable":
            raise bad("can't hold another nullable")
        return QLType(low, tuple(args))
    if low == "map":
        if len(args) != 2 or not all(isinstance(a, QLType) for a in args):
            raise bad("needs a key and a value type")
        return QLType(low, tuple(args))
    if low == "tuple":
        if not args or not all(isinstance(a, QLType) for a in args):
            raise bad("needs at least one type")
        return QLType(low, tuple(args))
    if low == "enum":
        values = [a.args[0] if isinstance(a, QLType) and a.kind == "reference" else a for a in args]
        if not values or any(isinstance(v, QLType) for v in values) or len(set(map(repr, values))) != len(values):
            raise bad("needs different literals")
        return QLType(low, tuple(values))
    if args:
        raise bad("is no type that takes arguments")
    return QLType("reference", (name,))


def infer_type(value: Any) -> QLType:
    if value is None:
        raise TypeMismatchError("the type of null can't be inferred")
    if isinstance(value, bool):
        return QLType("bool")
    if isinstance(value, int):
        return QLType("int")
    if isinstance(value, float):
        return QLType("float")
    if isinstance(value, str):
        return QLType("char") if len(value) == 1 else QLType("str", (max(len(value), 1),))
    for kind, cls in (("decimal", Decimal), ("datetime", dt.datetime), ("date", dt.date), ("time", dt.time), ("duration", dt.timedelta), ("uuid", uuid.UUID), ("bytes", bytes)):
        if isinstance(value, cls):
            return QLType(kind)
    if isinstance(value, Reference):
        return QLType("reference", (value.dataset,))
    if isinstance(value, dict):
        return QLType("json")
    if isinstance(value, tuple):
        return QLType("tuple", tuple(map(infer_type, value)))
    if isinstance(value, (list, set, frozenset)):
        kinds = {infer_type(v) for v in value}
        if len(kinds) != 1:
            raise TypeMismatchError("an empty or mixed collection's type can't be inferred")
        return QLType("list" if isinstance(value, list) else "set", tuple(kinds))
    raise TypeMismatchError(f"{type(value).__name__} has no type here")


def cast_value(value: Any, target: QLType) -> Any:
    """A Python value of the type, or a type_mismatch."""
    kind, args = target.kind, target.args
    if value is None:
        if kind == "nullable":
            return None
        raise TypeMismatchError(f"null is no {target}", code="null")
    if kind == "nullable":
        return cast_value(value, args[0])
    try:
        return _cast(value, kind, args, target)
    except TypeMismatchError:
        raise
    except (ValueError, TypeError, InvalidOperation, OverflowError) as e:
        raise TypeMismatchError(f"{value!r} is no {target}") from e


def _cast(value: Any, kind: str, args: tuple, target: QLType) -> Any:
    wrong = TypeMismatchError(f"{value!r} is no {target}")
    if kind == "int":
        if isinstance(value, bool):
            raise wrong
        n = int(value)
        if not -(1 << 63) <= n < 1 << 63:
            raise TypeMismatchError(f"{value!r} is out of the range of 64 bits")
        return n
    if kind == "float":
        return float(value)
    if kind == "decimal":
        return Decimal(str(value))
    if kind == "bool":
        if isinstance(value, bool):
            return value
        if isinstance(value, int) and value in (0, 1):
            return bool(value)
        if isinstance(value, str) and value.lower() in ("true", "false"):
            return value.lower() == "true"
        raise wrong
    if kind in ("char", "str", "text"):
        text = str(value)
        if (kind == "char" and len(text) != 1) or (kind == "str" and len(text) > args[0]):
            raise TypeMismatchError(f"{text!r} doesn't fit {target}")
        return text
    if kind == "date":
        return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    if kind == "time":
        return value if isinstance(value, dt.time) else dt.time.fromisoformat(value)
    if kind == "datetime":
        return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
    if kind == "timestamp":
        return value if isinstance(value, dt.datetime) else dt.datetime.fromtimestamp(float(value), dt.UTC)
    if kind == "duration":
        return value if isinstance(value, dt.timedelta) else dt.timedelta(seconds=float(value))
    if kind == "uuid":
        return value if isinstance(value, uuid.UUID) else uuid.UUID(str(value))
    if kind == "bytes":
        return value if isinstance(value, bytes) else str(value).encode()
    if kind == "json":
        json.dumps(value)
        return value
    if kind in ("list", "set"):
        if not isinstance(value, (list, tuple, set, frozenset)):
            raise wrong
        items = [cast_value(v, args[0]) for v in value]
        if kind == "set":
            items = list({repr(v): v for v in items}.values())
        return items
    if kind == "map":
        if not isinstance(value, dict):
            raise wrong
        return {cast_value(k, args[0]): cast_value(v, args[1]) for k, v in value.items()}
    if kind == "tuple":
        if not isinstance(value, (list, tuple)) or len(value) != len(args):
            raise wrong
        return tuple(cast_value(v, a) for v, a in zip(value, args))
    if kind == "enum":
        if value not in args:
            raise wrong
        return value
    if kind == "reference":
        if not isinstance(value, Reference):
            raise wrong
        if value.dataset != args[0]:
            raise TypeMismatchError(f"a reference to {value.dataset} is none to {args[0]}", code="reference_conflict")
        return value
    raise wrong


def spark_type(t: QLType, identity: dict[str, T.StructType] | None = None) -> T.DataType:
    """``identity`` gives the identity struct of referenced datasets."""
    kind, args = t.kind, t.args
    plain = {
        "int": T.LongType(), "float": T.DoubleType(), "decimal": T.DecimalType(38, 18), "bool": T.BooleanType(), "char": T.StringType(), "str": T.StringType(), "text": T.StringType(),
        "date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "duration": T.DayTimeIntervalType(), "uuid": T.StringType(), "bytes": T.BinaryType(), "json": T.StringType(),
    }
    if kind in plain:
        return plain[kind]
    if kind == "nullable":
        return spark_type(args[0], identity)
    if kind in ("list", "set"):
        return T.ArrayType(spark_type(args[0], identity))
    if kind == "map":
        return T.MapType(spark_type(args[0], identity), spark_type(args[1], identity))
    if kind == "tuple":
        return T.StructType([T.StructField(f"_{i + 1}", spark_type(a, identity)) for i, a in enumerate(args)])
    if kind == "enum":
        return spark_type(infer_type(args[0]))
    if kind == "reference":
        return (identity or {}).get(args[0]) or T.StructType([T.StructField("id", T.LongType())])
    raise TypeMismatchError(f"{t} isn't stored")


def to_spark(value: Any, t: QLType) -> Any:
    """A cast value as Spark takes it."""
    kind, args = t.kind, t.args
    if value is None:
        return None
    if kind == "nullable":
        return to_spark(value, args[0])
    if kind == "json":
        return json.dumps(value, ensure_ascii=False, default=str)
    if kind == "time":
        return value.isoformat()
    if kind == "uuid":
        return str(value)
    if kind == "datetime" and value.tzinfo is not None:
        return value.astimezone(dt.UTC).replace(tzinfo=None)
    if kind in ("list", "set"):
        return [to_spark(v, args[0]) for v in value]
    if kind == "map":
        return {to_spark(k, args[0]): to_spark(v, args[1]) for k, v in value.items()}
    if kind == "tuple":
        return tuple(to_spark(v, a) for v, a in zip(value, args))
    if kind == "reference":
        return {k: (str(v) if isinstance(v, uuid.UUID) else v) for k, v in value.identity}
    return value


def from_spark(value: Any, t: QLType | None) -> Any:
    """A collected value as the language shows it."""
    if value is None:
        return None
    if t is None:
        if isinstance(value, T.Row):
            return {k: from_spark(v, None) for k, v in value.asDict().items()}
        if isinstance(value, list):
            return [from_spark(v, None) for v in value]
        return bytes(value) if isinstance(value, bytearray) else value
    kind, args = t.kind, t.args
    if kind == "nullable":
        return from_spark(value, args[0])
    if kind == "json":
        return json.loads(value) if isinstance(value, str) else from_spark(value, None)
    if kind == "time":
        return dt.time.fromisoformat(value)
    if kind == "uuid":
        return uuid.UUID(value)
    if kind == "bytes":
        return bytes(value)
    if kind == "decimal":
        return value.normalize() if value == value.to_integral() else Decimal(str(value).rstrip("0"))
    if kind == "list":
        return [from_spark(v, args[0]) for v in value]
    if kind == "set":
        items = [from_spark(v, args[0]) for v in value]
        try:
            return set(items)
        except TypeError:
            return items
    if kind == "map":
        return {from_spark(k, args[0]): from_spark(v, args[1]) for k, v in value.items()}
    if kind == "tuple":
        return tuple(from_spark(v, a) for v, a in zip(value, args))
    if kind == "reference":
        return Reference(args[0], tuple(value.asDict().items()))
    return value


def of_spark(t: T.DataType) -> QLType:
    """The type of an outside table's column."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return QLType("int")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return QLType("float")
    for cls, kind in ((T.DecimalType, "decimal"), (T.BooleanType, "bool"), (T.StringType, "text"), (T.DateType, "date"), (T.TimestampNTZType, "datetime"), (T.TimestampType, "datetime"), (T.BinaryType, "bytes"), (T.DayTimeIntervalType, "duration")):
        if isinstance(t, cls):
            return QLType(kind)
    if isinstance(t, T.ArrayType):
        return QLType("list", (of_spark(t.elementType),))
    if isinstance(t, T.MapType):
        return QLType("map", (of_spark(t.keyType), of_spark(t.valueType)))
    if isinstance(t, T.StructType):
        return QLType("json")
    return QLType("text")
