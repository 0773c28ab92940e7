"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of a whole text (never its labels, language, source or id) are computed by DataFrame functions and stored once. Cosines of ``features``
random projections approximate a Gaussian kernel over the standardised statistics. Each partition of the training
rows sums its part of the normal equations; the sums, whose size depends on ``features`` alone, are added in two levels and solved on the driver. One quarter of the
training rows is left out of the fit and calibrates the scores: counts per score step (at most ``STEPS``) are pooled to a rising step function.

Defined cases: null and blank texts get the statistics of an empty text and are scored like any other; labels that are null or whose document
doesn't exist are left out, repeated labels count each; with labels of one class only, or none, every score is the share of
label 1 (0.5 where there are none). Rows with a null doc_id are scored but never learned from. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, join_small, spill, word_array

STEPS = 1000
SEED = 20240501


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns in ``keep``) and ``stats``, an array of figures of the text. One pass, no exchange."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    a = docs.select(F.struct(*keep).alias("row"), text.alias("text"), word_array(F.col("text")).alias("words"), lines.alias("lines"))
    count = lambda p: F.regexp_count("text", F.lit(p))
    b = a.select(
        "row", F.length("text").alias("chars"), F.size("words").alias("n"), F.size("lines").alias("l"),
        F.size(F.array_distinct("words")).alias("dw"), F.size(F.array_distinct("lines")).alias("dl"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("short"),
        F.size(F.filter("words", lambda w: F.length(w) == 1)).alias("single"),
        count(r"[#*$%&<>{}\[\]=\\^~_]").alias("symbols"), count(r"\|").alias("bars"), count(r"[.!?]").alias("stops"), count(r"[,;:]").alias("commas"),
        count(r"[0-9]").alias("digits"), count(r"[A-ZÀ-Þ]").alias("capitals"), count(r"[.!?](?=\n|$)").alias("ended"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("chars"), F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest(F.col("l"), F.lit(1))
    cols: list[Column] = [
        F.log1p("n"), F.log1p("l"), per_word("chars"), per_word("dw"), per_line("dl"), F.log1p(per_line("n")), per_word("short"), per_word("single"),
        F.sqrt(per_char("symbols")), F.sqrt(per_char("bars")), F.sqrt(per_word("stops")), F.sqrt(per_word("commas")), F.sqrt(per_char("digits")), F.sqrt(per_char("capitals")), per_line("ended"),
    ]
    return b.select("row", F.array(*[c.cast("double") for c in cols]).alias("stats"))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps: np.ndarray
    levels: np.ndarray
    constant: float | None = None  # every score, where nothing could be learned

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = np.clip(self.raw(x), -1.0, 2.0)
        # A thousandth of the raw score keeps apart what one level of the step function would tie.
        return np.clip(0.999 * np.interp(raw, self.steps, self.levels) + 0.001 * (raw + 1) / 3, 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    stats = batch.column("stats")
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))


def normal_equations(rows: DataFrame, model: Model, partitions: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows, added in two levels: a partial sum in each task that has rows, ``partitions`` sums of these, and their sum on the driver."""
    d = model.omega.shape[1] + 1
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment, n = np.zeros((d, d)), np.zeros(d), 0
        for b in batches:
            if len(b):
                z, y = model.features(_matrix(b)), b.column("label").to_numpy(zero_copy_only=False).astype(float)
                gram, moment, n = gram + z.T @ z, moment + z.T @ y, n + len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram[upper], moment, [n]]).tobytes()], pa.binary())], ["cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(upper[0]) + d + 1)
        for b in batches:
            for raw in b.column("cells").to_pylist():
                cells += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], ["cells"])

    sums = rows.select("stats", "label").mapInArrow(partial, "cells binary").repartition(partitions).mapInArrow(added, "cells binary").collect()
    cells = np.sum([np.frombuffer(r["cells"]) for r in sums] or [np.zeros(len(upper[0]) + d + 1)], axis=0)
    gram = np.zeros((d, d))
    gram[upper] = cells[: len(upper[0])]
    return gram + np.triu(gram, 1).T, cells[-d - 1 : -1], int(round(cells[-1]))


def isotonic(at: np.ndarray, weight: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; gives the mean place and the level of each pool."""
    pools: list[list[float]] = []
    for x, w, y in zip(at, weight, ones):
        pools.append([w, y, x * w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(stats: DataFrame, labels: DataFrame, features: int = 200, gamma: float = 0.04, ridge: float = 1e-3, partitions: int = 16) -> Model:
    """labels: doc_id and label (0/1). The fold of a row comes from its id alone."""
    train = stats.join(labels.where("label is not null and doc_id is not null"), "doc_id").select("stats", F.col("label").cast("double").alias("label"), (F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3), F.lit(4)) == 0).alias("calibrates"))
    train = spill(train, "rff-train")
    width = 15
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), *[f(F.col("stats")[i]).alias(f"{g}{i}") for i in range(width) for g, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, ones = sums["n"], sums["ones"] or 0.0
    rng = np.random.default_rng(SEED)
    mean, scale = (np.array([sums[f"{g}{i}"] or 0.0 for i in range(width)]) for g in "ms")
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 * gamma), (width, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not n or ones in (0, n):
        model.constant = ones / n if n else 0.5
        return model
    gram, moment, m = normal_equations(train.where("not calibrates"), model, partitions)
    if not m:
        gram, moment, m = normal_equations(train, model, partitions)
    penalty = ridge * m * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(gram + penalty, moment)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.clip(model.raw(_matrix(b)), -1.0, 2.0) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 1) / 3 * STEPS).astype(np.int32)), b.column("label")], ["step", "label"])

    held = train.where("calibrates")
    held = held if held.limit(50).count() == 50 else train
    pooled = held.select("stats", "label").mapInArrow(step, "step int, label double").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).orderBy("step").toPandas()
    model.steps, model.levels = isotonic(pooled["step"].to_numpy() / STEPS * 3 - 1, pooled["n"].to_numpy(float), pooled["y"].to_numpy(float))
    return model


def apply(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more. Each row is scored in place, so null and repeated ids need no join."""
    used = learnable(labels)
    known = join_small(docs, used.select("doc_id").where("doc_id is not null").distinct(), ["doc_id"], "left_semi")
    model = fit(statistics(known).select("row.doc_id", "stats"), used)

    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_list()).astype(float)) if len(stats) else [], dtype=float)

    scored = statistics(docs, tuple(docs.columns))
    return scored.where(F.pandas_udf(score, "double")("stats") >= 0.5).select("row.*")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Labels of held-out rows are never read into the fit."""
    stats = spill(statistics(docs).select("row.doc_id", "stats"), "rff-stats")
    scored = apply(stats, fit(stats, learnable(labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
