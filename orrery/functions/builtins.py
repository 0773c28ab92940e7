"""Scalar functions and value constructors of the language, evaluated to constants; ``columns`` has the same over Columns."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FunctionError, TypeMismatchError
from .types import QLType, cast_value


def _kind(name: str, value: Any, kinds: tuple) -> Any:
    if isinstance(value, bool) or not isinstance(value, kinds):
        raise FunctionError(f"{name} doesn't take {type(value).__name__}", function=name)
    return value


def _contains(container: Any, value: Any) -> bool:
    if isinstance(container, (str, bytes)):
        return _kind("contains", value, (type(container),)) in container
    return value in _kind("contains", container, (list, tuple, set, frozenset, dict))


def _round(number: Any, digits: Any = None) -> Any:
    if digits is not None and (isinstance(digits, bool) or not isinstance(digits, int)):
        raise FunctionError("round takes a whole number of digits", function="round")
    return round(_kind("round", number, (int, float, Decimal)), digits)


def _set(*items: Any) -> list | set:
    from ..operators.selection import Selection

    if any(isinstance(x, Selection) for x in items):
        return list(items)
    try:
        return set(items)
    except TypeError as e:
        raise FunctionError("set needs scalar values", function="set") from e


def _map(value: Any) -> dict:
    return dict(_kind("map", value, (dict,)))


class Builtins:
    """clock and ids can be given, so that sessions are reproducible."""

    def __init__(self, clock: Callable[[], dt.datetime] | None = None, ids: Callable[[], uuid.UUID] | None = None) -> None:
        clock, ids = clock or (lambda: dt.datetime.now(dt.UTC)), ids or uuid.uuid4
        self.scalar: dict[str, tuple[Callable, int, int]] = {
            "len": (lambda v: len(_kind("len", v, (str, bytes, list, set, frozenset, tuple, dict))), 1, 1), "abs": (lambda v: abs(_kind("abs", v, (int, float, Decimal))), 1, 1), "round": (_round, 1, 2),
            "lower": (lambda v: _kind("lower", v, (str,)).lower(), 1, 1), "upper": (lambda v: _kind("upper", v, (str,)).upper(), 1, 1), "contains": (_contains, 2, 2),
        }
        self.plain: dict[str, tuple[Callable, int, int]] = {
            "today": (lambda: clock().date(), 0, 0), "now": (clock, 0, 0), "uuid": (ids, 0, 0),
            "list": (lambda *a: list(a), 0, 10**6), "tuple": (lambda *a: tuple(a), 0, 10**6), "set": (_set, 0, 10**6), "map": (_map, 1, 1), "cast": (self._cast, 2, 2),
        }

    @staticmethod
    def _cast(value: Any, target: QLType) -> Any:
        out = cast_value(value, target)
        return set(out) if target.bare.kind == "set" and out is not None and all(not isinstance(x, (list, dict)) for x in out) else out

    def __contains__(self, name: str) -> bool:
        return name.lower() in self.scalar or name.lower() in self.plain

    def call(self, name: str, args: list, span: Any = None) -> Any:
        low = name.lower()
        function, least, most = self.scalar.get(low) or self.plain[low]
        if not least <= len(args) <= most:
            raise FunctionError(f"{low} takes {least if least == most else f'{least} to {most}'} values, not {len(args)}", code="function_arity", span=span, function=low)
        if low in self.scalar and any(a is None for a in args):
            return None
        try:
            return function(*args)
        except (FunctionError, TypeMismatchError) as e:
            raise e.at(span) from None


def columns() -> dict[str, Callable[..., Column]]:
    """The scalar functions over Columns."""
    return {
        "len": lambda c: F.length(c), "size": lambda c: F.size(c), "abs": F.abs, "round": lambda c, d=0: F.bround(c, d), "lower": F.lower, "upper": F.upper,
        "contains": lambda c, v: F.contains(c, v), "today": F.current_date, "now": F.current_timestamp, "uuid": F.uuid, "list": F.array, "tuple": F.struct, "set": lambda *c: F.array_distinct(F.array(*c)), "map": F.create_map,
        "cast": lambda c, t: c.cast(t),
    }
