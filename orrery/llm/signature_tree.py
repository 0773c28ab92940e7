"""N-gram Jaccard join with signature trees.

Two documents link when ``100 * |intersection| >= percent * |union|`` for their sets of distinct word shingles. The result names for every document
the least doc_id it can reach over links. No link is lost:

1. Documents of equal sets are one class, named by its least doc_id.
2. A set's prefix under a global order of shingles holds ``size - ceil(percent * size / 100) + 1`` of them, so linked sets share a prefix shingle. The order is by
   level, then by hash. A shingle's level grows with the number of documents that have it in their first prefix, if those are more than ``HOT``: this keeps common
   passages from meeting, and any order gives the same links. Levels are kept in a table of ``SLOTS`` bytes; shingles that share a slot share the higher level.
3. A bucket has the classes of one prefix shingle, sorted by size. A class stays in it only where another one's size and place of the shingle allow a link. Classes
   that have a shingle more than ``FOLD`` times in a task's chunk, or in buckets of more than ``BLOCK``, aren't tested here: neighbours in the order of sizes become
   candidates, and of a run of them one row goes on, so a shingle of very many documents is no burden for the task that its bucket comes to.
4. In each bucket a signature tree over bitmaps and sizes is joined with itself. Node pairs are dropped whose sizes are too far apart or whose OR-combined bitmaps allow too
   small an overlap. Bitmaps here tell of a fixed part of all shingles (by hash): as a link allows few to be missing, a part decides. What is left are candidate links;
   only those that join what isn't joined yet are kept.
5. Connected candidates form clusters, usually a few documents. Their whole sets come together in blocks, a second tree is joined with itself (or with
   that of each other block of the same cluster), and pairs that the bound leaves are verified exactly. A node pair whose documents are joined already is skipped, so a dense group of n near copies costs
   about n verifications, not n squared.
6. Components of the verified links.

Sets are compared by 64-bit hashes of shingles, classes by 128-bit ones.

Defined cases: null, empty and blank texts have the empty set, size 0, and link with nothing; repeated rows get a row each; rows with a null doc_id have a
null component and are in no class; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, join_small, spill, tidy
from .components import components
from .shingles import mix, shingle_sets

HOT = 64
SLOTS = 1 << 22
FOLD = 64
CHUNK = 1 << 19  # prefix shingles looked at together
BLOCK = 2048
SPREAD = 16
BLOCK_TOKENS = 2_000_000
LEAF = 8
SIGNATURE = "row long, doc_id long, n long, k1 long, k2 long, bits binary, prefix array<long>"


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap at which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit per hash modulo a power of two of at least the set's size (and 64)."""
    width = max(64, 1 << (len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def share(percent: int) -> int:
    """Bitmaps of candidates tell of one in so many shingles: unrelated sets then still lack about 1.4 times as many as a link allows."""
    return next((n for n in (8, 4, 2) if 0.6 / n >= 1.35 * (100 - percent) / (100 + percent)), 1)


def part_bitmap(tokens: np.ndarray, one_in: int) -> bytes:
    """A bit per shingle of the part that hashes choose, modulo a power of two of at least twice the part's expected size (and 64)."""
    width = max(64, 1 << (2 * len(tokens) // one_in).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens[(tokens >> np.uint64(8)) % np.uint64(one_in) == 0] >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Node:
    __slots__ = ("bits", "width", "least", "most", "excess", "children", "docs", "uniform")

    def __init__(self, children: list[Node] | None, docs: list[int]) -> None:
        self.children, self.docs, self.uniform = children, docs, False


class Joiner:
    """Union-find and dual traversal over documents given as (size, bitmap, width)."""

    def __init__(self, percent: int, verify: Callable[[int, int], bool] | None = None) -> None:
        self.percent, self.verify = percent, verify
        self.size: list[int] = []
        self.bits: list[int] = []
        self.width: list[int] = []
        self.up: list[int] = []
        self.links: list[tuple[int, int]] = []

    def add(self, size: int, raw: bytes) -> int:
        self.size.append(size)
        self.bits.append(int.from_bytes(raw, "little"))
        self.width.append(len(raw) * 8)
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def pair(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a == b:
            return
        n, m = self.size[x], self.size[y]
        p = self.percent
        if 100 * min(n, m) < p * max(n, m):
            return
        width = min(self.width[x], self.width[y])
        s, t = fold(self.bits[x], self.width[x], width), fold(self.bits[y], self.width[y], width)
        # Shingles of the one whose bit the other lacks can't be common.
        if min(n - (s & ~t).bit_count(), m - (t & ~s).bit_count()) < needed(n, m, p):
            return
        if self.verify is None or self.verify(x, y):
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def tree(self, docs: list[int]) -> Node:
        docs = sorted(docs, key=lambda d: (self.size[d], self.bits[d] & 0xFFFFFFFF))
        level = []
        for i in range(0, len(docs), LEAF):
            part = docs[i : i + LEAF]
            node = Node(None, part)
            node.width = min(self.width[d] for d in part)
            node.bits = 0
            for d in part:
                node.bits |= fold(self.bits[d], self.width[d], node.width)
            node.least, node.most = self.size[part[0]], self.size[part[-1]]
            node.excess = max(self.size[d] - fold(self.bits[d], self.width[d], node.width).bit_count() for d in part)
            level.append(node)
        while len(level) > 1:
            above = []
            for i in range(0, len(level), LEAF):
                part = level[i : i + LEAF]
                node = Node(part, part[0].docs)
                node.width = min(c.width for c in part)
                node.bits = 0
                for c in part:
                    node.bits |= fold(c.bits, c.width, node.width)
                node.least, node.most = part[0].least, part[-1].most
                # Folding to fewer bits lets more shingles share one: the smaller bitmap's loss is added.
                node.excess = max(c.excess + (0 if c.width == node.width else c.most) for c in part)
                above.append(node)
            level = above
        return level[0]

    def _uniform(self, node: Node) -> bool:
        """Whether all documents below are joined already. Once true it stays so."""
        if not node.uniform:
            if node.children is None:
                first = self.find(node.docs[0])
                node.uniform = all(self.find(d) == first for d in node.docs[1:])
            else:
                node.uniform = all(self._uniform(c) for c in node.children) and len({self.find(c.docs[0]) for c in node.children}) == 1
        return node.uniform

    def possible(self, a: Node, b: Node) -> bool:
        """Whether the maximum possible overlap below a and b reaches the least that a link needs."""
        p = self.percent
        low, high = (a, b) if a.least <= b.least else (b, a)
        if 100 * low.most < p * high.least:
            return False
        width = min(a.width, b.width)
        common = (fold(a.bits, a.width, width) & fold(b.bits, b.width, width)).bit_count()
        extra = min(a.excess if a.width == width else a.most, b.excess if b.width == width else b.most)
        return min(a.most, b.most, common + extra) >= needed(a.least, b.least, p)

    def join(self, a: Node, b: Node) -> None:
        if a is b:
            if self._uniform(a):
                return
            if a.children is None:
                for x, y in combinations(a.docs, 2):
                    self.pair(x, y)
                return
            for c in a.children:
                self.join(c, c)
            for c, d in combinations(a.children, 2):
                self.join(c, d)
            return
        if self._uniform(a) and self._uniform(b) and self.find(a.docs[0]) == self.find(b.docs[0]):
            return
        if not self.possible(a, b):
            return
        if a.children is None and b.children is None:
            for x in a.docs:
                for y in b.docs:
                    self.pair(x, y)
        elif b.children is None or (a.children is not None and a.most - a.least >= b.most - b.least):
            for c in a.children:
                self.join(c, b)
        else:
            for c in b.children:
                self.join(a, c)

    def self_join(self, docs: list[int]) -> None:
        if len(docs) == 2:
            self.pair(*docs)
        elif docs:
            root = self.tree(docs)
            self.join(root, root)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def count_prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, n) over the hash-order prefixes of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s[: prefix_length(len(s), percent)] for s in shingle_sets(b.column("text").to_pylist(), k) if len(s)]
            if got:
                token, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def slots(tokens: np.ndarray, size: int) -> np.ndarray:
    return (mix(tokens) & np.uint64(size - 1)).astype(np.int64)


def levels(counts: DataFrame) -> np.ndarray:
    """Of each slot the highest level of its shingles: 0, and one more for each fourfold count above a bound. The bound is HOT, doubled until
    a quarter of the slots suffices for all shingles above it, so most others keep level 0 in a corpus of any size."""
    often = spill(counts.where(F.col("n") > HOT), "tree-frequent")
    step = F.floor(F.log2((F.col("n") - 1) / HOT)).cast("int")
    left, bound, size = {r["step"]: r["count"] for r in often.groupBy(step.alias("step")).count().collect()}, 0, SLOTS
    while sum(n for i, n in left.items() if i >= bound) > size // 4:
        bound += 1
    piece = 1 << 12

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            slot, level, of = (b.column(c).to_numpy() for c in ("slot", "level", "piece"))
            for i in np.unique(of).tolist():
                np.maximum.at(tables.setdefault(i, np.zeros(piece, np.uint8)), slot[of == i] % piece, level[of == i].astype(np.uint8))
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int64()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], ["piece", "table"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = slots(b.column("token").to_numpy(zero_copy_only=False).view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // piece), b.column("level")], ["slot", "piece", "level"])

    level = F.least(F.floor((step - bound) / 2) + 1, F.lit(60)).cast("int")
    placed = often.where(step >= bound).select("token", level.alias("level")).mapInArrow(place, "slot long, piece long, level int")
    table = np.zeros(size, np.uint8)
    for r in placed.repartition("piece").mapInArrow(fill, "piece long, table binary").collect():  # SLOTS bytes in all
        table[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["table"], np.uint8)
    return table


def signatures(docs: DataFrame, level: np.ndarray, k: int, percent: int) -> DataFrame:
    """level: of each slot. Rows are numbered, so that a repeated one can be told from another."""
    import xxhash

    table = docs.sparkSession.sparkContext.broadcast(level)
    one_in = share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        level = table.value
        for b in batches:
            n, k1, k2, bits, prefix = [], [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), k):
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                p = prefix_length(len(s), percent) if len(s) else 0
                head = s[:p]
                if p and level[slots(head, len(level))].any():
                    head = s[np.argsort(level[slots(s, len(level))], kind="stable")[:p]]
                n.append(len(s))
                k1.append(int(digest[0]))
                k2.append(int(digest[1]))
                bits.append(part_bitmap(s, one_in) if len(s) else None)
                prefix.append(head.view(np.int64))
            row = np.arange(at, at + len(n))
            at += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                ["row", "doc_id", "n", "k1", "k2", "bits", "prefix"],
            )

    return _texts(docs).mapInArrow(tidy(run), SIGNATURE)


def _sweep(token: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Of rows sorted by token and low, whether each meets the ones before it: sizes as near as a link needs lie between them."""
    if not len(token):
        return np.zeros(0, bool)
    group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    reach = np.maximum.accumulate((group << 40) + high) - (group << 40)
    return np.concatenate([[False], (token[1:] == token[:-1]) & (100 * reach[:-1] >= percent * low[1:])])


MEMBER = "token long, low long, high long, late boolean, rid long, other long"
_MEMBER = [x.split()[0] for x in MEMBER.split(", ")]


def prefix_rows(first: DataFrame, percent: int) -> DataFrame:
    """first: (row, n, prefix). A row per class and prefix shingle: its size as low, and whether the shingle comes too late in the prefix for a link with one of
    the same size or a larger one. Shingles frequent in a chunk give candidate links (rid, other) at once, and one row per run of sizes, with its largest size as high."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        n, row = (t.column(c).to_numpy() for c in ("n", "row"))
        lists = t.column("prefix").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        token = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), length)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
        size = n[doc]
        late = pos > size + (-2 * percent * size) // (100 + percent)  # size - needed(size, size)
        _, which, count = np.unique(token, return_inverse=True, return_counts=True)
        often = np.flatnonzero(count[which] > FOLD)
        by = often[np.lexsort((row[doc[often]], size[often], token[often]))]
        met = _sweep(token[by], size[by], size[by], percent)
        rid = row[doc[by]]
        link = np.flatnonzero(met)
        links = np.unique(np.stack([rid[link - 1], rid[link]], axis=1), axis=0) if len(link) else np.zeros((0, 2), np.int64)
        begins = np.flatnonzero(~met)
        ends = np.append(begins[1:], len(by)) - 1
        rest = np.flatnonzero(count[which] <= FOLD)
        parts = [
            (token[rest], size[rest], np.full(len(rest), -1), late[rest], row[doc[rest]]),
            (token[by][begins], size[by][begins], size[by][ends] if len(by) else size[:0], np.zeros(len(begins), bool), rid[begins]),
            (mix(links[:, 1].view(np.uint64)).view(np.int64), np.zeros(len(links), np.int64), np.full(len(links), -1), np.zeros(len(links), bool), links[:, 0]),
        ]
        cols = [np.concatenate(x) for x in zip(*parts)]
        other = pa.array(np.concatenate([np.zeros(len(rest) + len(begins), np.int64), links[:, 1]]), mask=np.arange(len(cols[0])) < len(rest) + len(begins))
        high = pa.array(cols[2], mask=cols[2] < 0)
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), high, pa.array(cols[3]), pa.array(cols[4]), other], _MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for b in batches:
            held.append(b)
            tokens += len(b.column("prefix").flatten())
            if tokens >= CHUNK:
                yield chunk(held)
                held, tokens = [], 0
        if tokens:
            yield chunk(held)

    return first.select("row", "n", "prefix").mapInArrow(tidy(run), MEMBER)


def buckets(rows: DataFrame, percent: int) -> DataFrame:
    """rows: of ``prefix_rows``. Gives the rows of buckets that are worth a test (other is null), and candidate links (rid, other)."""

    def judge(token: np.ndarray, low: np.ndarray, high: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole buckets, sorted. Which rows stay, and which are linked with the row before."""
        new = np.concatenate([[True], token[1:] != token[:-1]])
        which = np.cumsum(new) - 1
        size = np.bincount(which)
        coarse = (np.bincount(which, weights=high >= 0) > 0) | (size > BLOCK)
        reach = np.maximum(low, high)
        met = _sweep(token, low, reach, percent) & coarse[which]
        # The largest size before that is early enough in its prefix, by a running maximum in the bucket: sizes rise there.
        early = np.where(late, -1, low)
        before = np.concatenate([[0], (np.maximum.accumulate((which << 40) + early + 1) - (which << 40) - 1)[:-1]])
        before[new] = -1
        after = np.concatenate([low[1:], [0]])
        last = np.concatenate([new[1:], [True]])
        stay = (before >= 0) & (100 * before >= percent * low) | ~late & ~last & (100 * low >= percent * after)
        return stay & ~coarse[which], met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def out(cols: list[np.ndarray], whole: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
            """The result of all whole buckets, and what is kept of the last one: all its rows, or the one that stands for a big bucket."""
            token = cols[0]
            cut = len(token) if whole else int(np.searchsorted(token, token[-1], side="left"))
            if len(token) - cut > BLOCK:
                cut = len(token)
            if not cut:
                return None, cols
            head, tail = [c[:cut] for c in cols], [c[cut:] for c in cols]
            stay, met = judge(*head[:4])
            if not whole and cut == len(token):
                at = np.flatnonzero(token == token[-1])
                tail = [c[-1:].copy() for c in cols]
                tail[2][0] = max(head[1][at].max(), head[2][at].max())
            link = np.flatnonzero(met)
            n = int(stay.sum())
            other = pa.array(np.concatenate([np.zeros(n, np.int64), head[4][link]]), mask=np.arange(n + len(link)) < n)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([head[0][stay], head[0][link]])), pa.array(np.concatenate([head[4][stay], head[4][link - 1]])), other], ["token", "rid", "other"]), tail

        for b in batches:
            done = b.filter(b.column("other").is_valid())
            if len(done):
                yield done.select(["token", "rid", "other"])
                b = b.filter(b.column("other").is_null())
            if not len(b):
                continue
            held.append([b.column("token").to_numpy(), b.column("low").to_numpy(), b.column("high").fill_null(-1).to_numpy(), b.column("late").to_numpy(zero_copy_only=False), b.column("rid").to_numpy()])
            count += len(b)
            if count >= CHUNK // 8:
                found, tail = out([np.concatenate(x) for x in zip(*held)], False)
                if found is not None:
                    yield found
                held, count = [tail], len(tail[0])
        if count:
            yield out([np.concatenate(x) for x in zip(*held)], True)[0]

    return rows.repartition("token").sortWithinPartitions("token", "low", "late").mapInArrow(tidy(run), "token long, rid long, other long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[list]]]:
    """Rows sorted by their first ``keys`` columns, group by group: (column names, columns)."""
    last, held = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        ident = list(zip(*cols[:keys]))
        i = 0
        while i < len(ident):
            j = i + 1
            while j < len(ident) and ident[j] == ident[i]:
                j += 1
            part = [c[i:j] for c in cols]
            if ident[i] == last:
                held = [h + p for h, p in zip(held, part)]
            else:
                if held is not None:
                    yield held
                last, held = ident[i], part
            i = j
    if held is not None:
        yield held


def candidate_links(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (token, rid, n, bits). Candidate links (a, b) that join what isn't joined yet in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, known, names = Joiner(percent), {}, []
        for _, rids, sizes, raws in _groups(batches, 1):
            if len(rids) < 2:
                continue
            docs = []
            for rid, n, raw in zip(rids, sizes, raws):
                if rid not in known:
                    known[rid] = joiner.add(n, raw)
                    names.append(rid)
                docs.append(known[rid])
            joiner.self_join(docs)
        if joiner.links:
            a, b = zip(*joiner.links)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in a], pa.int64()), pa.array([names[x] for x in b], pa.int64())], ["a", "b"])

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(tidy(run), "a long, b long")


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """Adds ``tokens``, the sorted shingle hashes as bytes, to (rid, cluster, parts, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("parts"), b.column("rid"), pa.array(sets, pa.binary())], ["cluster", "parts", "rid", "tokens"])

    return texts.select("cluster", "parts", "rid", "text").mapInArrow(tidy(run), "cluster long, parts int, rid long, tokens binary")


def verified_links(blocks: DataFrame, percent: int) -> DataFrame:
    """blocks: (cluster, i, j, part, rid, tokens). Exact links (a, b) within (i = j) or across two parts of a cluster, enough to join all that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, part, rids, raws in _groups(batches, 3):
            if len(rids) < 2:
                continue
            sets = [np.frombuffer(raw, np.uint64) for raw in raws]

            def verify(x: int, y: int) -> bool:
                a, b = sets[x], sets[y]
                if len(a) > len(b):
                    a, b = b, a
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                return 100 * common >= percent * (len(a) + len(b) - common)

            joiner = Joiner(percent, verify)
            for s in sets:
                joiner.add(len(s), bitmap(s))
            if i[0] == j[0]:
                joiner.self_join(list(range(len(sets))))
            else:
                left, right = (joiner.tree([d for d in range(len(sets)) if part[d] == p]) if p in part else None for p in (i[0], j[0]))
                if left and right:
                    joiner.join(left, left)
                    joiner.join(right, right)
                    joiner.join(left, right)
            if joiner.links:
                a, b = zip(*joiner.links)
                yield pa.RecordBatch.from_arrays([pa.array([rids[x] for x in a], pa.int64()), pa.array([rids[x] for x in b], pa.int64())], ["a", "b"])

    return blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(tidy(run), "a long, b long")


def group(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    with arrow_batches(docs.sparkSession, 500, 8):
        level = levels(count_prefixes(docs, k, percent))
        sig = spill(signatures(docs, level, k, percent), "tree-signatures")
        return _grouped(docs, sig, k, percent)


def _grouped(docs: DataFrame, sig: DataFrame, k: int, percent: int) -> DataFrame:
    ids = sig.where("n > 0 and doc_id is not null")
    classes = ids.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("k1", "k2", F.col("first.doc_id").alias("rid"), F.col("first.row").alias("row"))
    classes = spill(classes, "tree-classes")
    # One row stands for each class. While classes are few, signatures needn't be exchanged to find these rows.
    first = join_small(sig, classes.select("row"), ["row"], "left_semi")
    shared = spill(buckets(prefix_rows(first, percent), percent), "tree-shared")
    payload = first.select(F.col("row").alias("rid"), "doc_id", "n", "bits")
    bucket = shared.where("other is null").select("rid", "token").join(payload, "rid").select("token", "rid", "n", "bits")
    coarse = shared.where("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b"))
    clusters = spill(components(candidate_links(bucket, percent).unionByName(coarse)), "tree-clusters")

    weights = clusters.join(payload, F.col("node") == F.col("rid")).groupBy("component").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("c"))
    # Up to SPREAD parts clusters are cut small, so that many tasks share them; larger ones into blocks of BLOCK, so that rows are repeated less.
    parts = F.greatest(F.ceil(F.col("w") / BLOCK_TOKENS), F.ceil(F.col("c") / BLOCK), F.least(F.ceil(F.col("c") / (BLOCK // 8)), F.lit(SPREAD))).cast("int")
    members = clusters.join(weights.select("component", parts.alias("parts")), "component").join(payload.select(F.col("rid").alias("node"), "doc_id"), "node")
    # From here on documents go by their ids; one of several texts brings all of them, and a link of any is its own.
    members = spill(members.select(F.col("doc_id").alias("rid"), F.col("component").alias("cluster"), "parts").distinct(), "tree-members")
    texts = join_small(_texts(docs).withColumnRenamed("doc_id", "rid"), members, ["rid"], "inner")
    sets = sets_of(texts, k).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    # A cluster of p parts makes p (p + 1) / 2 tasks; nearly all clusters are one part.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    blocks = sets.select("cluster", "part", "rid", "tokens", other).select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rid", "tokens")
    linked = components(verified_links(blocks, percent))

    named = sig.select("doc_id", "n", "k1", "k2").join(classes.drop("row"), ["k1", "k2"], "left")
    joined = named.join(linked.select(F.col("node").alias("rid"), "component"), "rid", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rid")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document comes first in its component; rows without an id or without words stay."""
    gone = spill(group(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct(), "tree-gone")
    return join_small(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)
