"""Each stage's decisions against brute force; nulls, repeated rows and clashing columns through all of them."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from orrery.llm import queries, rff
from tests.llm import edge
from tests.llm.test_text_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        gone = set(before) - set(after)
        if i == 0:
            assert sum(quality.get(d) == 1 for d in gone) <= 3 and sum(quality.get(d) == 0 for d in after) <= 3
        elif i == 1:
            want = brute_components([{"doc_id": d, "text": t} for d, t in before.items()], 5, 80)
            assert set(after) == {d for d, c in want.items() if d == c}
        elif i == 2:
            assert {d for d, t in before.items() if any(b in t for b in bench)} <= gone and not any(b in t for b in bench for t in after.values())
        else:
            assert not gone and all("@mail" not in t for t in after.values())
        docs = spark.createDataFrame(rows, docs.schema)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x in after.items()}
    got = corpus_pipeline.pack(spark, docs, SF).collect()
    assert all(zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in got)
    assert sum(p["length"] for p in got) == sum(map(len, ids.values()))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_edges(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows and clashing names: which of them each stage keeps, and with what values."""
    docs = edge.documents(spark)
    rows = sorted(map(tuple, docs.collect()), key=str)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = sorted(map(tuple, out.collect()), key=str)
    score = {r["doc_id"]: r["score"] for r in rff.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    none = lambda t: not (t or "").strip()
    assert len({score[r[0]] for r in rows if none(r[1]) and r[0] in (2, 3)}) == 1 and score[5] == score[6] and score[1] == score[7]
    got = collections.Counter(kept["quality"])
    assert all((got[r] > 0) == (score[r[0]] >= 0.5) and got[r] in (0, rows.count(r)) for r in rows)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r[1] or ""].add(r in kept["quality"])
    assert all(len(v) == 1 for v in by_text.values())
    assert kept["near_copies"] == [r for r in rows if r[0] not in (6, 7)]
    assert kept["benchmark"] == kept["personal_data"] == rows
    lengths = collections.Counter()
    for p in corpus_pipeline.pack(spark, docs, SF).collect():
        lengths[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert lengths[2, 1] == lengths[3, 1] == 1 and sum(n for (i, _), n in lengths.items() if i == 7) == 2 * sum(n for (i, _), n in lengths.items() if i == 1) and any(i is None for i, _ in lengths)
    assert sum(n for (i, _), n in lengths.items() if i == 5) > 2048


def test_empty_tables(spark):
    docs = edge.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (stage is corpus_pipeline.pack or out.columns == docs.columns)


def test_rows_through_all_stages(spark):
    docs = edge.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert {r["key"] for r in docs.collect()} <= {"k"} and corpus_pipeline.pack(spark, docs, SF).count() > 0
