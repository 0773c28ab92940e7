"""Predicates: checked against the fields' types, and lowered to Columns with two-valued null logic.

A predicate is a mapping: ``{"field": f, "op": o, "value": v}``, ``{"and": [...]}``, ``{"or": [...]}`` or ``{"not": ...}``. Negations are pushed to the
comparisons, which come out bare where they are positive (so that the scan can use them) and as *inverse or null* where negated. The result is meant for
filters, which drop what is unknown; ``as_column`` makes it a Boolean.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PredicateError, TypeMismatchError, UnknownFieldError
from ..functions.types import NUMERIC, ORDERABLE, TEXTUAL, QLType, infer_type

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "contains", "startsWith", "endsWith", "matches")
_TIMES = {"datetime", "timestamp", "date"}


def parts(p: Mapping) -> tuple[str, list]:
    for word in ("and", "or"):
        if word in p:
            if not isinstance(p[word], (list, tuple)) or not p[word]:
                raise PredicateError(f"{word} needs a list of predicates", code="invalid_predicate")
            return word, list(p[word])
    if "not" in p:
        if not isinstance(p["not"], Mapping):
            raise PredicateError("not needs one predicate", code="invalid_predicate")
        return "not", [p["not"]]
    if "field" not in p or "op" not in p:
        raise PredicateError("a predicate needs a field and an operator", code="invalid_predicate")
    if p["op"] not in OPERATORS:
        raise PredicateError(f"unknown operator {p['op']!r}", code="unknown_operator")
    return "compare", [p]


def fields_of(p: Mapping | None) -> set[str]:
    if not p:
        return set()
    word, inner = parts(p)
    return {inner[0]["field"]} if word == "compare" else set().union(*map(fields_of, inner))


def compatible(field: QLType, value: QLType) -> bool:
    a, b = field.bare, value.bare
    if a.kind == "json" or b.kind == "json":
        return True
    if a.kind == "enum":
        return compatible(infer_type(a.args[0]), b)
    for family in (NUMERIC, TEXTUAL, _TIMES, {"list", "set", "tuple"}):
        if a.kind in family and b.kind in family:
            return True
    if a.kind in ("uuid", "time") and b.kind in TEXTUAL:
        return True
    return a.kind == b.kind


def _suits(field: QLType, value: Any, name: str, op: str) -> None:
    if value is None:
        return
    bare = field.bare
    if bare.kind == "enum":
        if value not in bare.args:
            raise PredicateError(f"{value!r} is no {bare}", field=name, operator=op)
        return
    try:
        found = infer_type(value)
    except TypeMismatchError as e:
        if isinstance(value, (list, tuple, set, frozenset)) and bare.kind in ("list", "set", "tuple", "json"):
            return
        raise PredicateError(f"{value!r} can't be compared with {field}", field=name, operator=op) from e
    if not compatible(field, found):
        raise PredicateError(f"{field} can't be compared with {found}", field=name, operator=op)


def validate(p: Mapping | None, fields: Mapping[str, QLType | None]) -> None:
    """Unknown fields and unsuitable operands, before any data is read."""
    if not p:
        return
    word, inner = parts(p)
    if word != "compare":
        for x in inner:
            validate(x, fields)
        return
    name, op, value = p["field"], p["op"], p.get("value")
    if name not in fields:
        raise UnknownFieldError(f"there is no field {name!r}", field=name).at(p.get("span"))
    t = fields[name]
    if op == "matches":
        try:
            re.compile(value)
        except (re.error, TypeError) as e:
            raise PredicateError(f"{value!r} is no pattern", code="invalid_pattern", field=name, operator=op) from e
    if op == "in" and not isinstance(value, (list, tuple, set, frozenset)) and (t is not None and t.bare.kind != "json"):
        raise PredicateError("in needs a collection", field=name, operator=op)
    if t is None or t.bare.kind == "json":
        return
    kind = t.bare.kind
    if op in (">", ">=", "<", "<="):
        if kind not in ORDERABLE:
            raise PredicateError(f"{t} has no order", field=name, operator=op)
        _suits(t, value, name, op)
    elif op in ("=", "!="):
        _suits(t, value, name, op)
    elif op == "in":
        for v in value:
            _suits(t, v, name, op)
    elif op in ("startsWith", "endsWith", "matches"):
        if kind not in TEXTUAL or not isinstance(value, str):
            raise PredicateError(f"{op} needs strings", field=name, operator=op)
    elif kind in TEXTUAL:
        if not isinstance(value, str):
            raise PredicateError("a string contains strings only", field=name, operator=op)
    elif kind in ("list", "set", "map"):
        _suits(t.bare.args[0], value, name, op)
    else:
        raise PredicateError(f"{t} contains nothing", field=name, operator=op)


def literal(value: Any, t: QLType | None) -> Column:
    if isinstance(value, (uuid.UUID, dt.time)):
        return F.lit(str(value) if isinstance(value, uuid.UUID) else value.isoformat())
    if isinstance(value, (list, tuple, set, frozenset)):
        inner = t.bare.args[0] if t is not None and t.bare.args and isinstance(t.bare.args[0], QLType) else None
        return F.array(*[literal(v, inner) for v in value])
    if isinstance(value, dict):
        return F.lit(json.dumps(value, ensure_ascii=False))
    if isinstance(value, Decimal):
        return F.lit(value)
    return F.lit(value)


def _compare(p: Mapping, fields: Mapping[str, QLType | None], positive: bool) -> Column:
    name, op, value = p["field"], p["op"], p.get("value")
    t = fields.get(name)
    kind = t.bare.kind if t is not None else ""
    c = F.col(f"`{name}`")
    if kind == "json" and not isinstance(value, dict):
        # Scalars in a JSON field are compared by value.
        c = F.get_json_object(c, "$") if isinstance(value, str) else c
        if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
            c = c.cast("double")
        elif isinstance(value, bool):
            c = c.cast("boolean")
    null = c.isNull()
    flip = lambda test: test if positive else ~test | null
    if op in ("=", "!="):
        same = positive == (op == "=")
        if value is None:
            return null if same else c.isNotNull()
        if kind in ("set",) and isinstance(value, (list, tuple, set, frozenset)):
            c, v = F.array_sort(c), F.array_sort(literal(list(value), t))
        else:
            v = literal(value, t)
        return c == v if same else (c != v) | null
    if op in (">", ">=", "<", "<="):
        if value is None:
            return F.lit(not positive)
        v, nan = literal(value, t), kind == "float"
        inverse = {">": c <= v, ">=": c < v, "<": c >= v, "<=": c > v}
        test = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
        if positive:
            return test & ~F.isnan(c) if nan and op[0] == ">" else test
        return inverse[op] | null | F.isnan(c) if nan else inverse[op] | null
    if op == "in":
        if isinstance(value, str):
            return flip(F.lit(value).contains(c))
        if isinstance(value, dict):
            value = list(value)
        items = [v for v in value if v is not None]
        has_null = len(items) < len(list(value))
        member = c.isin(*[str(v) if isinstance(v, uuid.UUID) else v for v in items]) if items else F.lit(False)
        if positive:
            return member | null if has_null else member
        return ~member & c.isNotNull() if has_null else ~member | null
    if op == "contains":
        if kind in ("list", "set"):
            return flip(F.array_contains(c, literal(value, t.bare.args[0])))
        return flip(F.map_contains_key(c, literal(value, t.bare.args[0])) if kind == "map" else c.contains(F.lit(value)))
    test = c.startswith(value) if op == "startsWith" else c.endswith(value) if op == "endsWith" else c.rlike(value)
    if p.get("strict"):  # null is an error in place of false
        test = F.when(null, F.raise_error(F.lit(f"[orrery:type_mismatch] {name} is null")).cast("boolean")).otherwise(test)
    return flip(test)


def lower(p: Mapping | None, fields: Mapping[str, QLType | None], positive: bool = True) -> Column:
    if not p:
        return F.lit(positive)
    word, inner = parts(p)
    if word == "compare":
        return _compare(p, fields, positive)
    if word == "not":
        return lower(inner[0], fields, not positive)
    columns = [lower(x, fields, positive) for x in inner]
    out = columns[0]
    for c in columns[1:]:
        out = out & c if (word == "and") == positive else out | c
    return out


def as_column(p: Mapping | None, fields: Mapping[str, QLType | None]) -> Column:
    return F.coalesce(lower(p, fields), F.lit(False))
