"""Declared schemas and their constraints."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import ConstraintError, SchemaError, TypeMismatchError
from ..functions.types import NUMERIC, QLType, cast_value, parse_type

MISSING = object()
CONSTRAINTS = ("pk", "unique", "nullable", "default", "index", "vector", "searchable", "readonly")
SCALAR = {"int", "float", "decimal", "bool", "char", "str", "text", "date", "time", "datetime", "timestamp", "duration", "uuid", "bytes", "enum", "reference"}


@dataclass
class FieldSchema:
    name: str
    type: QLType
    pk: bool = False
    unique: bool = False
    nullable: bool = False
    index: bool = False
    searchable: bool = False
    readonly: bool = False
    vector: bool = False
    dimension: int | None = None
    default: Any = MISSING

    @property
    def cast_type(self) -> QLType:
        return QLType("nullable", (self.type,)) if self.nullable and self.type.kind != "nullable" else self.type

    def to_dict(self) -> dict:
        flags = [n for n in ("pk", "unique", "nullable", "index", "searchable", "readonly") if getattr(self, n)]
        return {"type": str(self.type), "constraints": flags + ([{"vector": self.dimension}] if self.vector else []) + ([{"default": self.default}] if self.default is not MISSING else [])}


@dataclass
class DatasetSchema:
    fields: dict[str, FieldSchema] = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, spec: Mapping[str, Any]) -> DatasetSchema:
        """``{name: "int"}`` or ``{name: {"type": "int", "constraints": ["pk", {"default": 3}]}}``."""
        out = {}
        for name, s in spec.items():
            s = {"type": s} if isinstance(s, (str, QLType)) else dict(s)
            f = FieldSchema(name, parse_type(s["type"]))
            for c in s.get("constraints", ()):
                word, value = next(iter(c.items())) if isinstance(c, Mapping) else (c, MISSING)
                if word not in CONSTRAINTS:
                    raise SchemaError(f"{name}: unknown constraint {word!r}", field=name)
                if word == "default":
                    if value is MISSING:
                        raise SchemaError(f"{name}: default needs a value", field=name)
                    f.default = value
                elif word == "vector":
                    f.vector, f.dimension = True, None if value is MISSING else value
                else:
                    setattr(f, word, True)
            out[name] = f
        schema = cls(out)
        schema._check()
        return schema

    def _check(self) -> None:
        for f in self.fields.values():
            bad = lambda why: SchemaError(f"{f.name}: {why}", field=f.name)  # noqa: B023,E731
            if f.pk and (f.nullable or f.type.kind == "nullable"):
                raise bad("a primary key can't be null")
            if (f.pk or f.unique) and f.type.bare.kind not in SCALAR:
                raise bad("only scalars can be keys")
            if f.vector:
                inner = f.type.bare
                if inner.kind != "list" or inner.args[0].kind not in NUMERIC:
                    raise bad("a vector is a list of numbers")
                if f.dimension is not None and (not isinstance(f.dimension, int) or f.dimension < 1):
                    raise bad("a dimension is a positive whole number")
            if f.default is not MISSING:
                try:
                    f.default = cast_value(f.default, f.cast_type)
                except TypeMismatchError as e:
                    raise bad(f"the default is no {f.type}") from e

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(n for n, f in self.fields.items() if f.pk)

    @property
    def uniques(self) -> tuple[str, ...]:
        return tuple(n for n, f in self.fields.items() if f.unique)

    @property
    def identity(self) -> tuple[str, ...]:
        return self.key or self.uniques[:1]

    @property
    def indexed(self) -> frozenset[str]:
        return frozenset(n for n, f in self.fields.items() if (f.pk and len(self.key) == 1) or f.unique or f.index or f.searchable)

    @property
    def dimensions(self) -> dict[str, int | None]:
        return {n: f.dimension for n, f in self.fields.items() if f.vector}

    def types(self) -> dict[str, QLType]:
        return {n: f.cast_type for n, f in self.fields.items()}

    def value(self, f: FieldSchema, v: Any) -> Any:
        if v is None and not (f.nullable or f.type.kind == "nullable"):
            raise ConstraintError(f"{f.name} can't be null", code="primary_key_null" if f.pk else "null", field=f.name)
        try:
            out = cast_value(v, f.cast_type)
        except TypeMismatchError as e:
            if e.code not in ("type_mismatch", "null"):
                raise
            raise ConstraintError(f"{f.name}: {e.message}", code="type" if e.code == "type_mismatch" else "null", field=f.name) from e
        if f.vector and out is not None and f.dimension is not None and len(out) != f.dimension:
            raise ConstraintError(f"{f.name} needs {f.dimension} numbers", code="vector_dimension", field=f.name)
        return out

    def insert(self, record: Mapping[str, Any]) -> dict:
        unknown = [n for n in record if n not in self.fields]
        if unknown:
            raise ConstraintError(f"there is no field {unknown[0]!r}", code="unknown_field", field=unknown[0])
        out = {}
        for n, f in self.fields.items():
            if n in record:
                out[n] = self.value(f, record[n])
            elif f.default is not MISSING:
                out[n] = copy.deepcopy(f.default)
            elif f.nullable or f.type.kind == "nullable":
                out[n] = None
            else:
                raise ConstraintError(f"{n} is required", code="required", field=n)
        return out

    def changes(self, values: Mapping[str, Any]) -> dict:
        for n in values:
            if n not in self.fields:
                raise ConstraintError(f"there is no field {n!r}", code="unknown_field", field=n)
        return {n: self.value(self.fields[n], v) for n, v in values.items()}
