"""Sharding: histogram sort by bytes.

Documents are ordered by a 64-bit key whose high 40 bits hash the text and whose low 24 bits hash the doc_id: equal texts are
neighbours, yet a text that fills a third of the corpus can still be cut. A group of equal texts that a shard's edge would cut stays whole if that moves the edge by
less than ``slack`` of a shard's bytes; so groups smaller than that are in one shard, and only larger ones are cut. Splitters that cut the corpus into ``shards * ranges``
stretches of equal bytes are found by histogramming: in each round every partition counts the exact bytes and rows below a set of
probes, the sums give exact brackets, and the brackets are refined until the byte count below each splitter is within ``tolerance`` of
its goal (or no key lies between). Then the rows are exchanged once, by stretch, and each gets its slot from a local row number plus the
rows of the stretches before it: no task ever sorts a whole shard.

Defined cases: a null text has size 16 (as an empty one), null doc_ids are hashed as such; repeated rows get slots of their own; rows that
tie in the key (equal text and doc_id) stay in one stretch and are ordered by doc_id: the law may be off by their bytes. An empty table gives an empty result. Input columns named like the result's
are replaced; others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spill

LOW_BITS = 24


def sort_key() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    high = F.shiftleft(F.shiftright(F.xxhash64(text), LOW_BITS), LOW_BITS)
    return high.bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << LOW_BITS) - 1)))


def doc_size() -> Column:
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 16


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """For each probe, exactly the bytes and rows of keys <= probe. Each task returns a row per stretch between probes that has rows."""
    at = np.array(sorted(probes), dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, rows = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for b in batches:
            place = np.searchsorted(at, b.column("key").to_numpy(zero_copy_only=False), side="left")
            np.add.at(sizes, place, b.column("size").to_numpy(zero_copy_only=False))
            rows += np.bincount(place, minlength=len(at) + 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sizes[used]), pa.array(rows[used])], ["place", "size", "n"])

    found = keys.select("key", "size").mapInArrow(count, "place int, size long, n long").groupBy("place").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    sizes, rows = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
    for r in found:
        sizes[r["place"]], rows[r["place"]] = r["size"], r["n"]
    size, n = np.cumsum(sizes), np.cumsum(rows)
    return {int(p): (int(size[i]), int(n[i])) for i, p in enumerate(at)}


def splitters(keys: DataFrame, parts: int, tolerance: float = 0.002, probes_each: int = 15, per_shard: int = 1, slack: float = 0.01) -> list[tuple[int, int, int]]:
    """(key, bytes at or below, rows at or below) of the ``parts - 1`` cuts and of the whole (the largest key comes last). Every ``per_shard``-th cut moves to an edge of
    its group of equal texts if that is less than ``slack`` of a shard's bytes away from its goal."""
    low, high = -(1 << 63), (1 << 63) - 1
    total = histogram(keys, [high])[high]
    goals = [total[0] * (i + 1) // parts for i in range(parts - 1)]
    near_enough = max(1, int(tolerance * total[0] / parts * per_shard))
    known = {low: (0, 0), high: total}
    while True:
        order = sorted(known)
        below = np.array([known[k][0] for k in order])
        probes: set[int] = set()
        for g in goals:
            j = int(np.searchsorted(below, g, side="left"))
            a, b = order[max(j - 1, 0)], order[j]
            near = min(abs(known[a][0] - g), abs(known[b][0] - g))
            if near <= near_enough or b - a <= 1 or known[b][1] - known[a][1] <= 1:
                continue
            step = probes_each + 1
            probes |= {a + (b - a) * i // step for i in range(1, step)} - {a, b}
        if not probes:
            break
        known |= histogram(keys, sorted(probes))
    order = sorted(known)
    below = np.array([known[k][0] for k in order])
    cuts = []
    for g in goals:
        j = int(np.searchsorted(below, g, side="left"))
        best = min((order[max(j - 1, 0)], order[j]), key=lambda k: abs(known[k][0] - g))
        cuts.append((best, *known[best]))
    edges = [i for i in range(parts - 1) if i % per_shard == per_shard - 1]
    mask = (1 << LOW_BITS) - 1
    around = {i: [max((cuts[i][0] & ~mask) - 1, low), cuts[i][0] | mask] for i in edges}
    known |= histogram(keys, sorted({k for pair in around.values() for k in pair} - {low})) if edges else {}
    for i in edges:
        best = min(around[i], key=lambda k: abs(known[k][0] - goals[i]))
        if abs(known[best][0] - goals[i]) < slack * total[0] / parts * per_shard:
            cuts[i] = (best, *known[best])
    # A moved edge may pass cuts inside its shards.
    for i in range(1, len(cuts)):
        cuts[i] = max(cuts[i], cuts[i - 1])
    return [*cuts, (high, *total)]


def shard_documents(docs: DataFrame, shards: int = 40, ranges: int = 4) -> DataFrame:
    """Every row of ``docs`` with size, shard and slot. ``ranges`` stretches make up a shard: more for larger shards."""
    docs = docs.drop("key", "size", "shard", "slot", "stretch")
    keyed = docs.select("*", sort_key().alias("key"), doc_size().alias("size"))
    keys = spill(keyed.select("key", "size"), "shard-keys")  # 16 bytes a row, read once a round
    cuts = splitters(keys, shards * ranges, per_shard=ranges)
    at = np.array([c[0] for c in cuts], dtype=np.int64)
    starts = [0, *[c[2] for c in cuts[:-1]]]
    offsets = [(i, i // ranges, starts[i] - starts[i - i % ranges]) for i in range(len(cuts))]

    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(), side="left").astype(np.int32))

    stretch = F.pandas_udf(place, "int")
    moved = keyed.withColumn("stretch", stretch("key")).repartition(shards * ranges, "stretch")
    order = Window.partitionBy("stretch").orderBy("key", "doc_id")
    slots = docs.sparkSession.createDataFrame(offsets, "stretch int, shard int, before long")  # shards * ranges rows
    local = moved.withColumn("local", F.row_number().over(order) - 1)
    return local.join(F.broadcast(slots), "stretch").withColumn("slot", F.col("before") + F.col("local")).drop("stretch", "key", "before", "local")


def sql_columns(placed: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
