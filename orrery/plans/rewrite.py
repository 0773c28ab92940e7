"""Rewriting of node tuples. Catalyst does the rest; these rules keep plans short and show in ``explain``."""

from __future__ import annotations

from ..operators.predicates import fields_of
from .nodes import Algebra, Filter, IndexLookup, Limit, Node, Offset, Projection, Reverse, Similarity, Traversal, Unique


def _empty(selection) -> bool:
    return any(isinstance(n, Limit) and n.count == 0 for n in selection.nodes)


def rewrite(nodes: tuple[Node, ...], indexed: frozenset[str] = frozenset()) -> tuple[tuple[Node, ...], list[str]]:
    rules: list[str] = []
    out: list[Node] = []

    def did(rule: str) -> None:
        if rule not in rules:
            rules.append(rule)

    for node in nodes:
        last = out[-1] if out else None
        if isinstance(node, Offset) and node.count == 0:
            did("remove_zero_offset")
        elif isinstance(node, Offset) and isinstance(last, Offset):
            out[-1] = Offset(last.count + node.count)
            did("merge_offsets")
        elif isinstance(node, Limit) and isinstance(last, Limit):
            out[-1] = Limit(min(last.count, node.count))
            did("merge_limits")
        elif isinstance(node, Reverse) and isinstance(last, Reverse):
            out.pop()
            did("remove_double_reverse")
        elif isinstance(node, Unique) and node == last:
            did("remove_redundant_unique")
        elif isinstance(node, Projection) and isinstance(last, Projection) and not any(f.children for f in (*node.tree, *last.tree)) and {f.name for f in node.tree} <= {f.name for f in last.tree}:
            out[-1] = node
            did("merge_projections")
        elif isinstance(node, Filter) and isinstance(last, Projection) and fields_of(node.predicate) <= {f.name for f in last.tree if not f.children}:
            out[-1:] = [node, last]
            did("predicate_pushdown")
        else:
            out.append(node)
    if out and isinstance(out[0], Filter):
        p = out[0].predicate
        if p.get("op") == "=" and p.get("field") in indexed:
            out[0] = IndexLookup(p)
            did("index_selection")
    for kind, rule in ((Similarity, "vector_limit_pruning"), (Traversal, "graph_limit_pruning")):
        at = next((i for i, n in enumerate(out) if isinstance(n, kind)), None)
        if at is not None and any(isinstance(n, Limit) for n in out[at + 1 :]):
            did(rule)
    for i, n in enumerate(out):
        if isinstance(n, Algebra) and n.operation in ("product", "intersection") and _empty(n.other):
            out = [*out[:i], Limit(0)] if n.operation == "intersection" else [*out[: i + 1], *out[i + 1 :]]
            did("join_elimination")
            break
    return tuple(out), rules
