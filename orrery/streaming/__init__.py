"""Row-wise operators on streaming DataFrames: filters, projections and expansions lower to plain columns, so they run on streams unchanged.
Operators that observe the order of all rows (order, limit, offset, unique, set algebra) need a bounded table and are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import UnsupportedError
from ..functions.types import of_spark
from ..operators.frame import Frame, Source
from ..operators.selection import Selection
from ..plans import nodes as P

ROW_WISE = (P.Filter, P.IndexLookup, P.Projection, P.Flatten, P.Expand)


def selection(name: str, stream: DataFrame, **json_types) -> Selection:
    """A selection over a streaming DataFrame."""
    fields = {f.name: of_spark(f.dataType) for f in stream.schema}
    return Selection(Source(name, "table", lambda: Frame(stream, (), fields, json_types), fields))


def to_stream(s: Selection) -> DataFrame:
    bad = [type(n).__name__ for n in s.nodes if not isinstance(n, ROW_WISE)]
    if bad:
        raise UnsupportedError(f"a stream has no end: {', '.join(bad)} can't be used on it")
    return s.to_df()
