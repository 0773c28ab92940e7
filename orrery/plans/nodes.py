"""The logical plan: a tuple of these nodes over a source."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from ..errors import Span


@dataclass(frozen=True)
class Field:
    """A projected name with the names wanted below it."""

    name: str
    children: tuple[Field, ...] = ()
    span: Span | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Node:
    def to_dict(self) -> dict:
        out: dict[str, Any] = {"node": type(self).__name__ + "Plan"}
        for f in fields(self):
            if f.name != "span":
                out[f.name] = plain(getattr(self, f.name))
        return out


def plain(v: Any) -> Any:
    if isinstance(v, Span):
        return v.to_dict()
    if isinstance(v, Field):
        return {"name": v.name} | ({"children": [plain(c) for c in v.children]} if v.children else {}) | ({"span": v.span.to_dict()} if v.span else {})
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "nodes"):
        return {"dataset": v.name, "plan": [n.to_dict() for n in v.nodes]}
    return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)


@dataclass(frozen=True)
class Filter(Node):
    predicate: Any


@dataclass(frozen=True)
class IndexLookup(Node):
    predicate: Any


@dataclass(frozen=True)
class Projection(Node):
    tree: tuple[Field, ...]


@dataclass(frozen=True)
class Order(Node):
    by: tuple[tuple[str, bool], ...]  # name, descending


@dataclass(frozen=True)
class Reverse(Node):
    pass


@dataclass(frozen=True)
class Offset(Node):
    count: int


@dataclass(frozen=True)
class Limit(Node):
    count: int


@dataclass(frozen=True)
class Unique(Node):
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Flatten(Node):
    name: str


@dataclass(frozen=True)
class Expand(Node):
    name: str


@dataclass(frozen=True)
class Similarity(Node):
    name: str
    vector: tuple[float, ...]
    metric: str


@dataclass(frozen=True)
class Traversal(Node):
    label: str
    depth: int
    predicate: Any = None


@dataclass(frozen=True)
class Algebra(Node):
    operation: str
    other: Any
    span: Span | None = field(default=None, compare=False)
