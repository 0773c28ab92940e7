"""Brute-force checks of the ratio rules, archives, shards, packing and the quality classifier."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from orrery.llm import packing, quality_llr, queries, rff, shards, warc
from tests.llm import edge

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _word_hash(word):
    return _signed(xxhash.xxh64_intdigest(word.encode(), 42))


def _pair_hash(a, b):
    first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
    return _signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), first))


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def _grams(text, buckets):
    h = [_word_hash(w) for w in WORD.findall(text or "")]
    return [x % buckets for x in h] + [_pair_hash(a, b) % buckets for a, b in zip(h, h[1:])]


@pytest.mark.parametrize("source", ["sf", "edge"])
def test_ratio_rules(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "sf" else edge.documents(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_llr.score_documents(docs, quality_llr.trusted(labels), buckets=1024).collect()
    rows = docs.select("doc_id", "text").collect()
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        g = _grams(r["text"], 1024)
        raw.update(g)
        if r["doc_id"] in good:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    ratio = [math.log((target[b] + 1) / (m + 1024)) - math.log((raw[b] + 1) / (n + 1024)) for b in range(1024)]
    want = []
    for r in rows:
        base, g = _base(r["text"]), _grams(r["text"], 1024)
        s = round(sum(ratio[b] for b in g) / len(g), 5) if g else 0.0
        want.append((str(r["doc_id"]), *base, s))
    have = [(str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], round(r["llr"], 5)) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 2e-5
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality_llr.THRESHOLD) for r in got)


def test_ratio_rules_empty(spark):
    assert quality_llr.score_documents(edge.empty(spark), edge.empty(spark).select("doc_id")).count() == 0


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (3, None, "x" * 999), (4, "http://c", "x" * 999), (5, "u", None), (6, "u v", ""), (None, "n", "é" * 600), (7, "n", "é" * 600), (7, "n", "é" * 600)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.classify(pages), path)
    got = warc.read_archives(manifest, path).collect()
    have = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    want = [("1", 1000, sha("x" * 1000), "revisit", 2), ("2", 1000, sha("x" * 1000), "response", None), ("3", 999, sha("x" * 999), "response", None), ("4", 999, sha("x" * 999), "response", None), ("5", 0, sha(""), "response", None), ("6", 0, sha(""), "response", None), ("7", 1200, sha("é" * 600), "response", None), ("7", 1200, sha("é" * 600), "response", None), ("None", 1200, sha("é" * 600), "revisit", 7)]
    assert have == sorted(want, key=str) or have == sorted(want, key=lambda r: (r[0], r[1]))
    for r in manifest.collect():
        with open(r["path"], "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.MAGIC
    none = warc.write_archives(warc.classify(edge.empty(spark, pages.schema)), f"file://{tmp_path}/none")
    assert warc.read_archives(none, path).count() == 0


@pytest.mark.parametrize("source", ["sf", "edge", "hot"])
def test_shards(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "sf" else edge.documents(spark)
    if source == "hot":
        docs = docs.select("doc_id", "text").unionByName(spark.range(3000).selectExpr("id + 100 as doc_id", "if(id < 1000, 'the same text', concat('own ', id)) as text"))
    got = shards.sql_columns(shards.shard_documents(docs)).collect()
    rows = docs.select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r["doc_id"]), size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(0 <= k < 40 and sorted(r["slot"] for r in v) == list(range(len(v))) for k, v in by.items())
    at = collections.defaultdict(set)
    for r in got:
        at[r["text_crc32"]].add(r["shard"])
    total = sum(r["size"] for r in got)
    weight = collections.Counter()
    for r in got:
        weight[r["text_crc32"]] += r["size"]
    assert source == "edge" or all(len(at[c]) == 1 for c, n in weight.items() if n < 0.01 * total / 40)
    if source == "hot":
        assert len(at[zlib.crc32(b"the same text")]) > 5
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert max(sum(r["size"] for r in v) for v in by.values()) <= total / 40 + 2 * largest
    assert shards.shard_documents(edge.empty(spark)).count() == 0


def test_histogram_is_exact(spark):
    keys = spark.range(1000).selectExpr("(id * 7919) % 1009 - 500 as key", "id as size")
    rows = keys.collect()
    for p, (size, n) in shards.histogram(keys, [-500, -3, 0, 77, 508]).items():
        assert size == sum(r["size"] for r in rows if r["key"] <= p) and n == sum(r["key"] <= p for r in rows)


@pytest.mark.parametrize("source", ["sf", "edge"])
def test_packing(spark, source):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "sf" else edge.documents(spark)
    got = packing.pack_documents(docs, queries.tokenizer_path(), batch=50).collect()
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    ids_of = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        ids_of[r["doc_id"]].append(ids)
        want[(r["doc_id"], len(ids))] += 1
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        assert any(len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in ids_of[p["doc_id"]])
        pieces[(p["doc_id"], p["doc_tokens"])].append((p["start"], p["length"]))
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {k: n * k[1] for k, n in want.items()} == {k: sum(x[1] for x in v) for k, v in pieces.items()}
    for k, v in pieces.items():
        cover = collections.Counter(i for s, n in v for i in range(s, s + n))
        assert cover == {i: want[k] for i in range(k[1])}
    padding = 0
    for v in seqs.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))]
        total = sum(n for _, n in v)
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 2048 * docs.rdd.getNumPartitions()
    assert packing.pack_documents(edge.empty(spark), queries.tokenizer_path()).count() == 0


def test_cached_tokenizer_matches():
    coder = packing.CachedTokenizer(queries.tokenizer_path())
    texts = ["It's ΣΑΣ's 12é é x y\x85z", "<|endoftext|> tail", "a\x1cb", "", "  lead", "don't 'll 's 日本語テキスト ½ ٣", "Á ́x"]
    for t, b in zip(texts, coder.encode(texts)):
        assert list(b) == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rff.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    s, y = np.array(held).T
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95 and ((s >= 0.5) == y).mean() > 0.95, auc


def test_quality_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (7, None), (99, 0), (None, 1)], "doc_id long, quality int")
    for used in (labels, labels.limit(0)):
        got = rff.score_documents(edge.documents(spark), used).collect()
        assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got)
        assert used is labels or all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert rff.score_documents(edge.empty(spark), labels).count() == 0
    # Nothing to learn from: nothing is rejected. One class alone: its share is every score.
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(rff.keep(edge.documents(spark), labels.limit(0))) == rows(edge.documents(spark))
    for q in (0, 1):
        one = spark.createDataFrame([(i, q) for i in range(1, 13)], "doc_id long, quality int")
        assert {r["score"] for r in rff.score_documents(edge.documents(spark), one).collect()} == {float(q)}


def test_quality_classifier_against_numpy(spark):
    """Features, normal equations, pools and scores once more, on the driver."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    stats = rff.statistics(docs).select("row.doc_id", "stats")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    x_of = {r["doc_id"]: np.array(r["stats"]) for r in stats.collect()}
    for i in list(text)[::97]:  # some figures of the texts themselves
        words, lines = WORD.findall(text[i]), [x for x in text[i].split("\n") if WORD.search(x)]
        want = [math.log1p(len(words)), math.log1p(len(lines)), len(text[i]) / max(1, len(words)), len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines)))]
        want += [sum(len(w) <= 3 for w in words) / max(1, len(words)), sum(len(w) == 1 for w in words) / max(1, len(words)), math.sqrt(len(re.findall(r"[#*$%&<>{}\[\]=\\^~_]", text[i])) / max(1, len(text[i])))]
        assert np.allclose(x_of[i][:9], want), i
    crc = lambda i: zlib.crc32(str(i).encode())
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if crc(r["doc_id"]) % 3 != 1 and r["doc_id"] in x_of]
    x, y, side = np.array([x_of[i] for i, _ in known]), np.array([q for _, q in known], float), np.array([crc(i) // 3 % 4 == 0 for i, _ in known])
    model = rff.fit(stats, rff.learnable(labels))
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    f = lambda x: np.hstack([np.sqrt(2 / 200) * np.cos(np.clip((x - x_mean) / x_std, -6, 6) @ model.omega + model.phase), np.ones((len(x), 1))])
    x_mean, x_std = x.mean(axis=0), x.std(axis=0)
    z = f(x[~side])
    beta = np.linalg.solve(z.T @ z + np.diag([1e-3 * len(z)] * 200 + [1e-9]), z.T @ y[~side])
    assert np.allclose(beta, model.beta, atol=1e-6)
    kernel = np.exp(-0.04 * (((x[:40, None] - x[None, :40]) / x_std) ** 2).sum(axis=2))
    assert np.abs(f(x[:40])[:, :-1] @ f(x[:40])[:, :-1].T - kernel).mean() < 0.08  # what the features approximate
    raw = np.clip(f(x[side]) @ beta, -1, 2)
    step = np.round((raw + 1) / 3 * 1000)
    at = np.array(sorted(set(step)))
    n, ones = (np.array([v[step == s].sum() for s in at]) for v in (np.ones(len(raw)), y[side]))
    level = np.array([max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])  # isotonic regression by its max-min formula
    pools = np.interp(at / 1000 * 3 - 1, model.steps, model.levels)
    assert np.abs(pools - level).max() < 0.51 and np.all(np.diff(model.levels) >= 0) and np.isclose((level * n).sum(), ones.sum())
    got = {r["doc_id"]: r["score"] for r in rff.score_documents(docs, labels).collect()}
    every = f(np.array([x_of[i] for i in got])) @ beta
    clipped = np.clip(every, -1, 2)
    assert np.allclose(list(got.values()), np.clip(0.999 * np.interp(clipped, model.steps, model.levels) + 0.001 * (clipped + 1) / 3, 0, 1), atol=1e-5)


def test_isotonic_is_the_max_min_formula():
    rng = np.random.default_rng(4)
    w, y = rng.integers(1, 9, 60).astype(float), rng.uniform(0, 1, 60)
    at, levels = rff.isotonic(np.arange(60.0), w, w * y)
    want = [max(min((w * y)[a : b + 1].sum() / w[a : b + 1].sum() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(want, 9))), levels) and np.all(np.diff(at) > 0)


def test_archives_of_odd_pages(spark, tmp_path):
    """Very long payloads and columns named like the reader's."""
    rows = [(1, "u", "x" * 3_000_000, "d1", 5, "t"), (2, "u", "x" * 3_000_000, "d2", 6, "t"), (3, "v\r\nWARC-Type: x", "\r\n\r\nbody", "d3", 7, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to long, record_type string")
    path = f"file://{tmp_path}/w"
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(warc.classify(pages), path, max_bytes=100), path).collect()}
    assert [(got[i]["payload_bytes"], got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3)] == [(3_000_000, "revisit", 2), (3_000_000, "response", None), (8, "response", None)]


def test_step_groups_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = None
    for rows in ("10000", "37"):  # the result depends on no session setting
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = packing.pack_documents(docs.coalesce(1), queries.tokenizer_path(), batch=300).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert wanted is None or got == wanted
        wanted = got
    load = collections.Counter()
    for p in got:
        load[p["step_group"]] += p["length"]
    most, least = max(load.values()), min(load.values())
    assert most < 16 * 2048 + 2048 and least > 0.9 * most or len(load) < 4, load


def test_deal():
    sizes = [2048] * 40 + [1024] * 9 + [256] * 7
    groups, n = packing.deal(sizes, 32_768)
    load = [sum(s for s, g in zip(sizes, groups) if g == k) for k in range(n)]
    assert n == -(-sum(sizes) // 32_768) and max(load) - min(load) <= 256 and packing.deal([], 5) == ([], 1)


def test_isotonic_rises():
    _, levels = rff.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert list(levels) == [0, 0.5, 1]


def test_packer_fills_windows():
    import random

    rng = random.Random(3)
    for _ in range(60):
        packer, seqs, want = packing.Packer(), [], {}
        for _ in range(rng.randint(1, 5)):
            docs = [(len(want) + i, rng.randint(1, rng.choice([1, 2, 50, 300, 600, 1500, 3000, 9000]))) for i in range(50)]
            want |= dict(docs)
            seqs += packer.pack(docs)
        seqs += packer.pack([], last=True)
        assert sum(sum(p[2] for p in pieces) != cap for cap, pieces in seqs) == 0
        assert sum(cap not in packing.TIERS for cap, _ in seqs) <= 1
        got = collections.Counter((d, i) for _, pieces in seqs for d, s, n in pieces for i in range(s, s + n))
        assert got == collections.Counter((d, i) for d, n in want.items() for i in range(n))
