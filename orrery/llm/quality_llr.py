"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and the raw corpus. DataFrame functions only.

Unigrams and bigrams of words are hashed (xxhash64) into ``buckets`` classes. Two multinomials with additive smoothing are
counted over *all* documents: one over the trusted target, one over the raw corpus. A document's score is the sum of
``log p_target - log p_raw`` over its n-grams, divided by their number; every document is kept or dropped by comparing it with
one fixed threshold, so a rerun over the same corpus decides alike. The base rules come first.

Defined cases: a null or blank text has no words, score 0, and fails the base rules. Repeated rows are scored each. A null
doc_id is carried through. An empty table gives an empty result. An empty target makes all ratios come from smoothing alone:
the target is then taken as equal to the raw corpus and nothing is dropped by the ratio. Other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, join_small, word_array

BUCKETS = 16_384
THRESHOLD = -0.06
WINDOW = 5


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: Column, n: int) -> Column:
    """64-bit hashes of all n-word windows, by start, from the words' hashes."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)]))


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, hashes of the words, and the base rules' figures. One row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    first = docs.select("doc_id", word_array(F.col("text")).alias("words"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    hashed = first.withColumn("hashes", _word_hashes(F.col("words")))
    second = hashed.select(
        "doc_id", "hashes", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("hashes"), WINDOW).alias("w5"),
    )
    third = second.withColumn(
        "pairs",
        F.when(
            F.size(F.array_distinct("w5")) < F.size("w5"),
            F.array_sort(F.transform("w5", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter("pairs", lambda e, k: (e["h"] == F.get("pairs", k - 1)["h"]) | (e["h"] == F.get("pairs", k + 1)["h"]))
    fourth = third.withColumn("starts", F.when(F.col("pairs").isNotNull(), F.array_sort(F.transform(again, lambda e: e["i"]))))
    seed = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "starts", seed,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    repeated = F.coalesce(covered, F.lit(0).cast("long"))
    return fourth.select(
        "doc_id", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _buckets(hashes: Column, buckets: int) -> Column:
    """Classes of the unigrams and bigrams."""
    place = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.concat(F.transform(hashes, place), F.transform(firsts, lambda h, i: place(F.xxhash64(h, F.get(hashes, i + 1)))))


def ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, alpha: float = 1.0) -> list[float]:
    """The ratio of each bucket; ``buckets`` numbers, whatever the corpus size. Counts of both corpora come from one pass over all documents, summed in
    each task before the shuffle: at most ``buckets`` rows a task."""
    ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    marked = join_small(docs.select("doc_id", "text"), ids, ["doc_id"], "left")
    grams = marked.select("good", _word_hashes(word_array(F.col("text"))).alias("hashes")).select("good", F.explode(_buckets(F.col("hashes"), buckets)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")).collect()
    raw = {r["bucket"]: r["raw"] for r in counted}
    good = {r["bucket"]: r["good"] for r in counted}
    n_raw, n_good = sum(raw.values()), sum(good.values())
    if not n_good:
        good, n_good = raw, n_raw
    return [math.log((good.get(b, 0) + alpha) / (n_good + alpha * buckets)) - math.log((raw.get(b, 0) + alpha) / (n_raw + alpha * buckets)) for b in range(buckets)]


def score_documents(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its base figures, mean ratio and verdict."""
    # One constant array, which the optimiser folds: a document's sum needs neither a join nor an exchange.
    weights = F.split(F.lit(",".join(map(repr, ratios(docs, trusted_ids, buckets)))), ",").cast("array<double>")
    total = F.aggregate(_buckets(F.col("hashes"), buckets), F.lit(0.0), lambda a, b: a + F.get(weights, b))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    score = F.round(total / n, 6)
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scored = base_columns(docs).select(*keep, score.alias("llr"))
    return scored.select(*keep, (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")
