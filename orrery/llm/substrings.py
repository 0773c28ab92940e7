"""Suffix-array dedup: removes every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus.

What is put in suffix order are not all suffixes of the corpus, but the contexts of anchors, by which each repeated string is found:

1. Equal texts are one class; only the row with the least doc_id is searched. Its copies are covered whole (if they reach ``LENGTH`` bytes).
2. Anchors: of the ``GRAM``-byte grams of every window of ``LENGTH`` bytes the one of least hash is an anchor. Equal windows have equal anchors at equal places, so
   an anchor whose hash occurs once in the corpus can't be in a repeated window; all others are kept. One exchange by hash, streamed in sorted order.
3. For the kept anchors, the bytes around them come together by hash. The contexts right of the anchors, and those left of them backwards, are put in suffix
   order by deep-shallow sorting: multikey quicksort (three-way partitions around a pivot symbol of eight bytes, all groups of a depth at a time) to a shallow depth, then a blind trie for
   each group that still shares its prefix. The common-prefix lengths of both orders give, for every offset of the anchor in a window, the classes of equal windows;
   all but the earliest of a class are marked.
4. An anchor with more than ``FREQUENT`` different surroundings isn't brought together: its windows are, each by its own hash of 128 bits, where the earliest is found by streaming. So
   a phrase common to very many documents with different words around it is dealt over all tasks. Such anchors are known by their surroundings in single batches; one
   whose different contexts turn out to be more than ``CHUNK`` all the same hands them on to a second round, by windows.
5. Marked runs return to their documents, overlapping ones are merged, and the rest of the bytes is digested.

Work and traffic follow the corpus and its repeated parts; no task pairs rows with each other, and equal contexts of an anchor (equal windows of a frequent one) are folded into the
earliest before anything is sent or sorted. Texts are read in segments, so long ones need no more memory.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` are kept; a null doc_id sorts last; rows that share doc_id and text are the same
document (all get the same row); different texts under one doc_id are ordered by text hash; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, join_small, spill, tidy

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # bytes of a window that can lie left of its anchor
SEGMENT = 1 << 20
CHUNK = 60_000
FREQUENT = 20_000
SHALLOW = 6  # eight-byte symbols
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte gram, by doubling."""
    h, step, base = _BYTE[data], 1, _BASE
    while step < GRAM:
        h = h[:-step] + h[step:] * np.uint64(base)
        step, base = step * 2, base * base & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width]."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return op(x[:-rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text: at least one in every window, chosen by the window's bytes alone."""
    places, hashes = [], []
    for a in range(0, len(data) - LENGTH + 1, SEGMENT):
        h = gram_hashes(np.frombuffer(data, np.uint8)[a : a + SEGMENT + LENGTH - 1])
        least = _sliding(h, REACH + 1, np.minimum)  # by window start
        pad = np.zeros(REACH, np.uint64)
        best = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)  # over the windows that hold a gram
        found = np.flatnonzero(best == h)
        places.append(found + a)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


class BlindTrie:
    """Orders strings that share a long prefix. Inner nodes hold only the place of their first difference; an insertion reads the
    bytes at those places, compares with one leaf, and branches where the two differ."""

    __slots__ = ("root", "strings", "width")

    def __init__(self, width: int) -> None:
        self.root: list | int | None = None
        self.strings: list[tuple[int, bytes, list[int]]] = []  # leaves: as a number, as bytes, members
        self.width = width

    def insert(self, text: bytes, member: int) -> None:
        number = int.from_bytes(text, "big")
        if self.root is None:
            self.root = self._leaf(number, text, member)
            return
        node = self.root
        while isinstance(node, list):  # [place, {byte: child}]
            node = node[1].get(text[node[0]]) if text[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        differ = number ^ other[0]
        if not differ:
            other[2].append(member)
            return
        place = self.width - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < place:
            parent, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == place:
            node[1][text[place]] = self._leaf(number, text, member)
            return
        split = [place, {other[1][place]: node, text[place]: self._leaf(number, text, member)}]
        if parent is None:
            self.root = split
        else:
            parent[1][text[parent[0]]] = split

    def _leaf(self, number: int, text: bytes, member: int) -> int:
        self.strings.append((number, text, [member]))
        return len(self.strings) - 1

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(member, length of the prefix common with the one before; -1 for the first)."""
        common, stack = -1, [(self.root, -1)]
        while stack:
            node, common = stack.pop()
            if isinstance(node, list):
                kids = sorted(node[1].items())
                stack += [(kid, node[0]) for _, kid in reversed(kids[1:])]
                stack.append((kids[0][1], common))
            else:
                for m in self.strings[node][2]:
                    yield m, common
                    common = self.width


def multikey_quicksort(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows by their first ``depth`` symbols, and the (start, length) of groups that share all of these. Each round splits every open group in
    three around the middle of its first, middle and last row's symbol; the rows equal to it go on with the next symbol."""
    n = len(symbols)
    order = np.arange(n)
    start, length, at_depth = (np.array([x]) for x in (0, n, 0))
    deep: list[tuple[int, int]] = []
    if n < 2:
        return order, deep
    while len(start):
        rows = [symbols[order[start + k], at_depth] for k in (0 * length, length // 2, length - 1)]
        pivot = np.maximum(np.minimum(rows[0], rows[1]), np.minimum(np.maximum(rows[0], rows[1]), rows[2]))
        group = np.repeat(np.arange(len(start)), length)
        begin = np.cumsum(length) - length  # of each group among the open rows
        place = (start - begin)[group] + np.arange(len(group))
        own = order[place]
        key = symbols[own, at_depth[group]]
        less, more = key < pivot[group], key > pivot[group]
        same = ~(less | more)
        after = start[group]
        sizes = []
        target = np.empty(len(group), np.int64)
        for part in (less, same, more):
            count = np.cumsum(part)
            before = np.concatenate([[0], count])[begin]
            size = np.concatenate([[0], count])[begin + length] - before
            target[part] = (after + count - 1 - before[group])[part]
            after = after + size[group]
            sizes.append(size)
        order[target] = own
        starts = (start, start + sizes[0], start + sizes[0] + sizes[1])
        done = at_depth + 1 == depth
        deep += [(a, k) for a, k in zip(starts[1][done].tolist(), sizes[1][done].tolist()) if k > 1]
        open_ = [sizes[0] > 1, (sizes[1] > 1) & ~done, sizes[2] > 1]
        start = np.concatenate([a[o] for a, o in zip(starts, open_)])
        at_depth = np.concatenate([at_depth[open_[0]], at_depth[open_[1]] + 1, at_depth[open_[2]]])
        length = np.concatenate([k[o] for k, o in zip(sizes, open_)])
    return order, deep


def suffix_order(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows and the prefix length each shares with the one before it in that order (0 for the first)."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    symbols = padded.view(">u8").astype(np.uint64)
    depth = min(shallow, symbols.shape[1])
    order, deep = multikey_quicksort(symbols, depth) if depth else (np.arange(n), [(0, n)] if n > 1 else [])
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = symbols[order[1:]] ^ symbols[order[:-1]]
        first = (differ != 0).argmax(axis=1)
        word = differ[np.arange(n - 1), first]
        lcp[1:] = np.where(word == 0, width, np.minimum(first * 8 + _leading_bytes(word), width))
    for a, k in deep if shallow < symbols.shape[1] else []:
        trie = BlindTrie(width)
        for member in order[a : a + k].tolist():
            trie.insert(rows[member].tobytes(), member)
        for i, (member, common) in enumerate(trie.ordered()):
            order[a + i] = member
            if i:
                lcp[a + i] = common
    return order, lcp


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero 64-bit numbers."""
    out = np.zeros(len(differ), np.int64)
    for k in range(1, 8):
        out += differ < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


def mark(context: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """context: REACH bytes before each anchor and LENGTH from it on; left, right: how many of these the text has; rank: places by (document, place).
    Gives [rows, REACH + 1]: whether the window that begins ``offset`` bytes before the anchor occurs at a lower rank."""
    n = len(context)
    out = np.zeros((n, REACH + 1), bool)
    if n < 2:
        return out
    after, after_lcp = suffix_order(np.ascontiguousarray(context[:, REACH:]))
    before, before_lcp = suffix_order(np.ascontiguousarray(context[:, REACH - 1 :: -1]), shallow=3)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(REACH + 1):
        ok = np.flatnonzero((left >= offset) & (right >= LENGTH - offset))
        if len(ok) < 2:
            continue
        a[after] = np.cumsum(after_lcp < LENGTH - offset)
        b[before] = np.cumsum(before_lcp < offset)
        key = a[ok] * (n + 1) + b[ok]
        by = np.lexsort((rank[ok], key))
        again = key[by][1:] == key[by][:-1]
        out[ok[by[1:][again]], offset] = True
    return out


def spans(marked: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that marked windows cover; windows of adjoining offsets make one span."""
    edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return row, place[row] - (past - 1), place[row] - first + LENGTH


def spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly."""
    h = doc.astype(np.uint64) * np.uint64(_BASE) + place.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _class_columns(text: Column) -> list[Column]:
    return [F.xxhash64(text, F.lit(0)).alias("c1"), F.xxhash64(text, F.lit(1)).alias("c2")]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("doc"), text.alias("text"), *_class_columns(text))


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(doc, place, h) of the anchors whose hash occurs more than once, and a row without a place of each that has more than FREQUENT different surroundings.

    A hash that occurs several times in a batch is known to: one of its rows is sent on under the hash, with the number of surroundings that differ, and the others go anywhere."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, places, hashes, datas = [], [], [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                place, h = anchors(data)
                docs.append(np.full(len(place), doc, np.int64))
                places.append(place.astype(np.int64))
                hashes.append(h.view(np.int64))
                datas.append(data)
            if docs:
                h, doc, place = (np.concatenate(x) for x in (hashes, docs, places))
                _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                sure = n[which] > 1
                other = sure.copy()
                other[first] = False
                route = np.where(other, spread(doc, place), h)
                # The far ends of the contexts tell whether the surroundings of a repeated anchor differ.
                at = np.flatnonzero(sure)
                text = np.repeat(np.arange(len(places)), [len(x) for x in places])[at]
                ends = {(w, datas[t][max(0, p - REACH) : max(0, p - REACH + 8)], datas[t][p + LENGTH - 8 : p + LENGTH]) for w, t, p in zip(which[at].tolist(), text.tolist(), place[at].tolist())}
                differ = np.maximum(np.bincount([e[0] for e in ends], minlength=len(n)) - 1, 0) if ends else np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, h, doc, place, sure, np.where(other, 0, differ[which]).astype(np.int32))], ["route", "h", "doc", "place", "sure", "n"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[pa.Table, bool] | None = None  # the last row, which the next one may repeat, and whether it was given out
        key = total = 0  # of the route that the rows have come to
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            route, n = t.column("route").to_numpy(), t.column("n").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
            sums = np.add.reduceat(n.astype(np.int64), begins)
            keys = route[begins]
            if last is not None and keys[0] == key:
                sums[0] += total
            elif last is not None and total > FREQUENT:
                yield frequent([key])
            key, total = int(keys[-1]), int(sums[-1])
            often = keys[:-1][sums[:-1] > FREQUENT]
            if len(often):
                yield frequent(often)
            told = last is not None and last[1]
            if last is not None:
                t = pa.concat_tables([last[0], t])
            route = t.column("route").to_numpy()
            same = route[1:] == route[:-1]
            keep = t.column("sure").to_numpy().copy()
            keep[1:] |= same
            keep[:-1] |= same
            last = (t.slice(len(route) - 1), bool(keep[-1]) or (len(route) == 1 and told))
            if told:
                keep[0] = False
            yield from t.filter(pa.array(keep)).select(["h", "doc", "place"]).combine_chunks().to_batches()
        if total > FREQUENT:
            yield frequent([key])

    def frequent(hashes) -> pa.RecordBatch:
        none = pa.nulls(len(hashes), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), none, none], ["h", "doc", "place"])

    found = texts.select("doc", "text").mapInArrow(tidy(find), "route long, h long, doc long, place long, sure boolean, n int")
    return found.repartition("route").sortWithinPartitions("route").mapInArrow(tidy(again), "h long, doc long, place long")


CONTEXT = "h long, w long, doc long, c1 long, place long, left int, right int, context binary, start long, stop long"
_CONTEXT = [x.split()[0] for x in CONTEXT.split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] + [pa.int64()] * 2


Row = tuple[int, int, int]  # doc, c1, place


class Folded(dict):
    """key -> the earliest row of those that were added; the others' spans are given out as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.spans: list[tuple[int, int, int, int, int]] = []

    def add(self, key, own: Row, span: tuple[int, int] | None) -> None:
        """span: from the row's place on, what the row covers if it isn't the earliest."""
        known = self.setdefault(key, own)
        if known == own:
            return
        if own < known:
            self[key], own = own, known
        if span:
            self.spans.append((*own, own[2] + span[0], own[2] + span[1]))


def _windows(contexts) -> Folded:
    """contexts: ((left, right, context), row). Their windows by hash."""
    import xxhash

    out = Folded()
    for (left, right, context), (doc, c1, place) in contexts:
        for offset in range(max(0, LENGTH - right), left + 1):
            out.add(xxhash.xxh3_128_digest(context[REACH - offset : REACH - offset + LENGTH]), (doc, c1, place - offset), (0, LENGTH))
    return out


def _rows_out(contexts: list[tuple], windows: Folded, spans: list[tuple]) -> pa.RecordBatch:
    rows = contexts + [(int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), *own, None, None, None, None, None) for key, own in windows.items()]
    cols = [list(c) for c in zip(*rows)] or [[] for _ in _CONTEXT]
    spans = spans + windows.spans
    if spans:
        doc, c1, place, start, stop = (list(c) for c in zip(*spans))
        none = [None] * len(spans)
        for c, more in zip(cols, (spread(np.array(doc), np.array(place)).tolist(), none, doc, c1, place, none, none, none, start, stop)):
            c += more
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _CONTEXT)


def contexts(texts: DataFrame) -> DataFrame:
    """texts: (doc, c1, text, at: array of (place, h, often)). A row per kept anchor with the bytes around it. Of equal contexts in a batch only the earliest is
    sent on; the others are repeated whatever else there is, and give their span at once (start, stop; no context). Anchors that occur often give
    a row per window in place of the context: its hash (h, w) and its start as place; equal windows are folded the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded, frequent = Folded(), set()
            for doc, c1, text, at in zip(*[b.column(c).to_pylist() for c in ("doc", "c1", "text", "at")]):
                data = text.encode("utf-8", "surrogatepass")
                padded = bytes(REACH) + data + bytes(LENGTH)
                for p in at:
                    place = p["place"]
                    if place + GRAM > len(data):
                        continue
                    if p["often"]:
                        frequent.add(p["h"])
                    left, right = min(place, REACH), min(len(data) - place, LENGTH)
                    span = (-left, LENGTH - max(0, LENGTH - right)) if left + right >= LENGTH else None
                    folded.add((p["h"], left, right, padded[place : place + REACH + LENGTH]), (doc, c1, place), span)
            rows = [(h, None, *own, left, right, context, None, None) for (h, left, right, context), own in folded.items() if h not in frequent]
            yield _rows_out(rows, _windows((key[1:], own) for key, own in folded.items() if key[0] in frequent), folded.spans)

    return texts.mapInArrow(tidy(run), CONTEXT)


def windows_of(rows: DataFrame) -> DataFrame:
    """A row per window of contexts that were too many for their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, context, doc, c1, place = (b.column(c).to_pylist() for c in ("left", "right", "context", "doc", "c1", "place"))
            yield _rows_out([], _windows(zip(zip(left, right, context), zip(doc, c1, place))), [])

    return rows.mapInArrow(tidy(run), CONTEXT)


def _chunk(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """Spans of a chunk that holds whole groups, and its rows without those folded into an earlier one."""
    h, doc, c1, place, left, right = (t.column(c).to_numpy() for c in ("h", "doc", "c1", "place", "left", "right"))
    width = REACH + LENGTH
    data = t.column("context").combine_chunks()
    context = np.frombuffer(data.buffers()[2], np.uint8, len(t) * width, data.offset * width).reshape(-1, width)
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((place, c1, doc))] = np.arange(len(t))
    # Equal contexts: the earliest stands for all, and the others' windows are all repeated.
    whole = np.ascontiguousarray(np.concatenate([left[:, None].astype(np.uint8), right[:, None].astype(np.uint8), context], axis=1))
    _, which = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((rank, which))
    later = np.zeros(len(t), bool)
    later[by[1:]] = which[by][1:] == which[by][:-1]
    start = np.maximum.accumulate(np.where(later[by], 0, np.arange(len(t))))  # of each group, in this order
    first = np.empty(len(t), np.int64)
    first[by] = by[start]
    itself = (doc == doc[first]) & (c1 == c1[first]) & (place == place[first])  # a row that the input repeats
    copy = np.flatnonzero(later & ~itself & (left + right >= LENGTH))
    starts, stops = [place[copy] - left[copy]], [place[copy] - np.maximum(0, LENGTH - right[copy]) + LENGTH]
    rows = [copy]
    own = np.flatnonzero(~later)
    twice = np.zeros(len(own), bool)
    if len(own) > 1:
        same = h[own][1:] == h[own][:-1]  # own keeps the order by hash
        twice[1:] |= same
        twice[:-1] |= same
    own_many = own[twice]
    if len(own_many):
        row, start, stop = spans(mark(context[own_many], left[own_many], right[own_many], rank[own_many]), place[own_many])
        rows.append(own_many[row])
        starts.append(start)
        stops.append(stop)
    r = np.concatenate(rows)
    out = pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(c1[r]), pa.array(np.concatenate(starts)), pa.array(np.concatenate(stops))], ["doc", "c1", "start", "stop"])
    return out, t.filter(pa.array(~later))


def _later(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """Spans of windows (sorted by hash and rank) that come after the first of their hash, and the first of the last hash."""
    h, w, doc, c1, place = (t.column(c).to_numpy() for c in ("h", "w", "doc", "c1", "place"))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero((doc != doc[first]) | (c1 != c1[first]) | (place != place[first]))
    spans = [pa.array(x[later]) for x in (doc, c1, place, place + LENGTH)]
    return pa.RecordBatch.from_arrays(spans, ["doc", "c1", "start", "stop"]), t.slice(int(first[-1]), 1)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """rows: of ``contexts``. Rows with start and stop are spans; those with a context are of anchors that have too many, for a second round."""

    def spans(b: pa.RecordBatch) -> pa.RecordBatch:
        named = dict(zip(b.schema.names, b.columns))
        return pa.RecordBatch.from_arrays([named.get(c, pa.nulls(len(b), t)) for c, t in zip(_CONTEXT, _TYPES)], _CONTEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        window: pa.Table | None = None
        over: int | None = None  # the anchor whose contexts are handed on
        n = 0
        for b in batches:
            done = b.filter(b.column("start").is_valid())
            if len(done):
                yield spans(done.select(["doc", "c1", "start", "stop"]))
            many = b.filter(b.column("w").is_valid())
            if len(many):
                t = pa.Table.from_batches([many])
                out, window = _later(t if window is None else pa.concat_tables([window, t]).combine_chunks())
                yield spans(out)
            b = b.filter(b.column("context").is_valid())
            if over is not None and len(b):
                same = pc.equal(b.column("h"), over)
                yield b.filter(same)
                b = b.filter(pc.invert(same))
            held.append(b)
            n += len(b)
            if n < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if cut:
                yield spans(_chunk(t.slice(0, cut))[0])
                t = t.slice(cut)
            if len(t) >= CHUNK:  # fold equal contexts before more are read
                out, t = _chunk(t)
                yield spans(out)
                if len(t) > CHUNK // 2:
                    over = int(h[-1])
                    yield from t.combine_chunks().to_batches()
                    t = t.slice(len(t))
            held, n = t.combine_chunks().to_batches(), len(t)
        if n:
            yield spans(_chunk(pa.Table.from_batches(held))[0])

    return rows.repartition("h").sortWithinPartitions("h", "w", "doc", "c1", "place").mapInArrow(tidy(run), CONTEXT)


def merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


CUT = "doc long, c1 long, n_removed long, n_spans long, cut_sha string"


def cut_texts(texts: DataFrame) -> DataFrame:
    """texts: (doc, c1, text, spans). The digest of the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, c1, text, found in zip(*[b.column(c).to_pylist() for c in ("doc", "c1", "text", "spans")]):
                data, at, kept = memoryview(text.encode("utf-8", "surrogatepass")), 0, hashlib.sha256()
                runs = merge([(s["start"], s["stop"]) for s in found])
                for a, z in runs:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                for c, v in zip(cols, (doc, c1, sum(z - a for a, z in runs), len(runs), kept.hexdigest())):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in CUT.split(", ")])

    return texts.mapInArrow(tidy(run), CUT)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    with arrow_batches(docs.sparkSession, 500):
        return _deduped(docs)


def _deduped(docs: DataFrame) -> DataFrame:
    every = _rows(docs)
    # Classes of one text need no name; of the others, while they are few, no row is exchanged to learn its class, and a large one is no task's burden.
    classes = every.groupBy("c1", "c2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    classes = spill(classes, "substrings-classes")
    ident = every.select("doc", "c1", "c2")
    copies = spill(join_small(ident, classes, ["c1", "c2"], "inner").where("doc > first").select("doc", "c1", "c2").distinct(), "substrings-copies")
    texts = join_small(every.where(F.octet_length("text") >= LENGTH), copies, ["doc", "c1", "c2"], "left_anti").select("doc", "c1", "text")

    anchored = spill(repeated_anchors(texts), "substrings-anchors")
    frequent = anchored.where("place is null").select("h", F.lit(True).alias("often"))
    kept = join_small(anchored.where("place is not null"), frequent, ["h"], "left").select("doc", F.struct("place", "h", F.coalesce("often", F.lit(False)).alias("often")).alias("at"))
    places = kept.groupBy("doc").agg(F.collect_set("at").alias("at"))
    some = join_small(texts, anchored.where("place is not null").select("doc").distinct(), ["doc"], "left_semi")
    around = contexts(some.join(places, "doc").select("doc", "c1", "text", "at"))
    found = spill(repeated_spans(around), "substrings-spans")
    over = found.where("context is not null")
    found = found.where("start is not null").select("doc", "c1", "start", "stop")
    if over.limit(1).count():
        more = spill(repeated_spans(windows_of(over)), "substrings-spans")
        found = found.unionByName(more.select("doc", "c1", "start", "stop"))

    lists = found.groupBy("doc", "c1").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    some = join_small(texts, found.select("doc", "c1").distinct(), ["doc", "c1"], "left_semi")
    cut = cut_texts(some.join(lists, ["doc", "c1"]).select("doc", "c1", "text", "spans")).dropDuplicates(["doc", "c1"])
    cut = spill(cut, "substrings-cut")

    base = every.select("doc_id", "doc", "c1", "c2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    joined = join_small(join_small(base, classes, ["c1", "c2"], "left"), cut, ["doc", "c1"], "left")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
