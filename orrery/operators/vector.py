"""Vector distances over array columns, computed in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean")


def score(v: Column, query: tuple[float, ...], metric: str) -> tuple[Column, Column]:
    """(distance, similarity) of a vector column and a constant vector. Vectors of another length, or zero ones under cosine, are errors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    doubles = F.transform(v, lambda x: x.cast("double"))
    wrong = lambda m: F.raise_error(F.lit(f"[orrery:invalid_vector] {m}")).cast("double")
    fits = F.size(v) == len(query)
    if metric == "euclidean":
        d = F.sqrt(total(F.zip_with(doubles, q, lambda a, b: (a - b) * (a - b))))
        d = F.when(fits, d).otherwise(wrong("the vector has another dimension"))
        return d, 1 / (1 + d)
    norm = F.sqrt(total(F.transform(doubles, lambda a: a * a)))
    dot = total(F.zip_with(doubles, q, lambda a, b: a * b))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    s = F.when(~fits, wrong("the vector has another dimension")).when(norm == 0, wrong("a zero vector has no direction")).otherwise(dot / (norm * F.lit(length)))
    return 1 - s, s
