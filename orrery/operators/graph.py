"""Breadth-first traversal as joins of a frontier with links, level by level."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import TraversalError, UnknownFieldError
from ..sources.files import stored
from . import predicates
from .frame import Frame, Source, raise_


def traverse(start: Frame, label: str, depth: int, predicate: Any, source: Source, ordered: bool = True) -> Frame:
    """Nodes within ``depth`` links of the rows of ``start``, each once, without the starting ones.

    Each level keeps, for every node first reached, the least path of (position, link) steps: paths compare like the visits of a queue. A level is
    stored before the next begins, so plans stay short and an executor's loss costs a level at most.
    """
    if source.kind != "graph" or source.edges is None:
        raise TraversalError(f"{source.name} is no graph")
    if "id" not in start.fields:
        raise TraversalError("traversal needs the nodes' id")
    edges, fields = source.edges()
    known = source.edge_fields(label) if source.edge_fields else set(fields)
    for name in sorted(predicates.fields_of(predicate)):
        if name not in known and known is not None and name not in fields:
            raise UnknownFieldError(f"links {label} have no field {name!r}", field=name)
        if name not in known:
            raise UnknownFieldError(f"links {label} have no field {name!r}", field=name)
    kept = ("steps", label, repr(predicate))
    if kept not in source.cache:  # written once for a version of the graph
        links = edges.where(F.col("label") == label)
        if predicate:
            links = links.where(predicates.lower(predicate, fields))
        forward = links.select(F.col("source").alias("__from"), F.col("target").alias("__to"), F.col("id").alias("__link"))
        back = links.where("bidir").select(F.col("target").alias("__from"), F.col("source").alias("__to"), F.col("id").alias("__link"))
        source.cache[kept] = stored(forward.unionByName(back))
    steps = source.cache[kept]
    nodes = source.frame()

    if ordered:
        # Numbers in the order of the starting rows, by ranges; gaps don't matter.
        ranged = start.df.repartitionByRange(*start.order()).sortWithinPartitions(*start.order())
        numbered = stored(ranged.select(F.col("id").alias("__node"), F.monotonically_increasing_id().alias("__n")))
        first = numbered.groupBy("__node").agg(F.min("__n").alias("__n")).select("__node", F.array("__n").alias("__path"))
    else:
        first = start.df.select(F.col("id").alias("__node")).distinct().withColumn("__path", F.array(F.lit(0).cast("long")))
    frontier = stored(first)
    visited = frontier.select("__node")
    reached: list[DataFrame] = []
    for level in range(1, depth + 1):
        found = frontier.join(steps, F.col("__node") == F.col("__from")).select("__to", F.concat("__path", F.array("__link")).alias("__path"))
        new = found.join(visited, F.col("__to") == F.col("__node"), "left_anti").groupBy("__to").agg(F.min("__path").alias("__path"))
        seen = Observation()
        frontier = stored(new.select(F.col("__to").alias("__node"), "__path").observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            break
        reached.append(frontier.withColumn("__level", F.lit(level)))
        visited = visited.unionByName(frontier.select("__node"))  # tables that are stored already
    if not reached:
        return Frame(nodes.df.limit(0), nodes.keys, nodes.fields, nodes.json_types, nodes.schemaless)
    all_levels = reached[0]
    for r in reached[1:]:
        all_levels = all_levels.unionByName(r)
    df = all_levels.join(nodes.df.drop(*[k for k, _ in nodes.keys]), F.col("id") == F.col("__node"), "left")
    df = df.where(F.when(F.col("id").isNull(), raise_("invalid_traversal", "a link leads to no node").cast("boolean")).otherwise(True)).drop("__node")
    return Frame(df.withColumnsRenamed({"__level": "__t0", "__path": "__t1"}), (("__t0", True), ("__t1", True)), nodes.fields, nodes.json_types, nodes.schemaless)
