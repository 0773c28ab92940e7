"""Packing: hierarchical multi-length packing of tokenised documents.

Documents are tokenised and routed to context-size tiers (powers of two up to the window). A document longer than the window first
fills whole windows; what is left goes to the smallest tier that holds it. Each tier is packed by itself, its windows filled best-fit by
decreasing length; the gaps that stay in the longer tiers' windows are then filled from shorter tiers' documents, cutting one freely to
close a gap to the last token. What is left over at the end becomes windows of the smaller tiers, so almost nothing is padded. Each round's sequences are then
dealt to as many step groups as ``step_tokens`` asks for, the largest first and always to the lightest group, so that every step costs the same.

Packing is local to a task and needs no exchange: a task packs rounds of ``batch`` documents, however they come in, and carries unfilled documents over to
the next round; ids are made from the partition's number. So the result depends on the partitions' rows alone, and a repeated task gives the same one.

Tokenising is cached by run of non-space characters: the tokenizer's normaliser and pre-tokeniser never look across ASCII white space, so
ids of a text are the ids of its runs joined. Texts that hold a special token's string or the file separators that are
no white space for both sides are encoded whole.

Defined cases: null and empty texts consist of the end id alone; very long texts are cut; repeated rows are packed each; a null doc_id is
carried through; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from types import ModuleType
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_batches, give_back, spill, tidy

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
CACHE = 150_000  # runs; two generations of them are kept, some 60 MB
SLICE = 1 << 22  # characters tokenised at a time
ENCODE = 2000  # runs given to the tokenizer at a time
#: Marks that are no letters, digits or apostrophes, for a regular expression's class.
MARKS = r".,;:!?#*$%&|<>(){}=+_~@/\-"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_SPECIAL_CASE = re.compile("[ΣİϴKÅΩ]")  # lower-cased by context, or to other lengths
_ODD = re.compile("[\x1c-\x1f]|<\\|")


class CachedTokenizer:
    """Ids of a batch of texts. Marks are parted from the letters before them (the pre-tokeniser does the same), and distinct runs are
    looked up once a batch. Runs of letters skip the normaliser and the pre-tokeniser, which would only lower them and map their bytes, and
    go to the model at once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model_only = Tokenizer(self.tokenizer.model)  # one vocabulary in memory
        self.runs: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}  # byte-level alphabets name the other bytes 256, 257, ...
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}

    @classmethod
    def of_process(cls, path: str) -> CachedTokenizer:
        """Spark reuses Python workers: one tokenizer serves all tasks of a process."""
        here = sys.modules.setdefault("_orrery_tokenizers", ModuleType("_orrery_tokenizers")).__dict__
        if path not in here:
            here[path] = cls(path)
        return here[path]

    def forget(self) -> None:
        self.runs, self.old = {}, {}

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(runs)
        letters, others = [], []
        every = " ".join(runs)
        usual = is_normalized("NFC", every) and not _SPECIAL_CASE.search(every)  # nearly always: then no run needs a look of its own
        for i, run in enumerate(runs):
            plain = run.isalpha() and (usual or run.isascii() or (is_normalized("NFC", run) and not _SPECIAL_CASE.search(run)))
            (letters if plain else others).append(i)
        given = [runs[i].lower() for i in letters]
        given = [g if g.isascii() else g.encode().decode("latin-1").translate(self.alphabet) for g in given]
        for tokenizer, places, names in ((self.model_only, letters, given), (self.tokenizer, others, [runs[i] for i in others])):
            for k in range(0, len(places), ENCODE):
                for i, b in zip(places[k : k + ENCODE], self._ids(tokenizer, names[k : k + ENCODE])):
                    out[i] = b
        return out

    def _known(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs."""
        got = list(map(self.runs.get, runs))
        if self.old:
            for i, b in enumerate(got):
                if b is None and (b := self.old.get(runs[i])) is not None:
                    got[i] = self.runs[runs[i]] = b
        new = [i for i, b in enumerate(got) if b is None]
        if new:
            names = [runs[i] for i in new]
            ids = self._new(names)
            if len(self.runs) > CACHE:  # two generations: what is in use comes back from the old one
                self.old, self.runs = self.runs, {}
            self.runs.update(zip(names, ids))
            for i, b in zip(new, ids):
                got[i] = b
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if _ODD.search(t)}
        usual = pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string())
        parted = pc.replace_substring_regex(pc.ascii_lower(usual), r"([\p{L}\p{N}])([" + MARKS + "])", r"\1 \2")
        del usual
        words = pc.ascii_split_whitespace(parted)
        del parted
        coded, offsets = words.flatten().dictionary_encode(), words.offsets.to_numpy()
        del words
        ids = self._known(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        table, begin = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        n = lengths[place]
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        at = np.repeat(begin[place] - ends[:-1], n)
        at += np.arange(ends[-1], dtype=np.int32)
        flat = table[at]
        bounds = ends[offsets]
        out = [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in odd:
            out[i] = np.frombuffer(self._ids(self.tokenizer, [texts[i]])[0], "<u4")
        return out


class Packer:
    """Packs documents that come in batches. A piece is (document, start, length); a sequence is (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.window = tiers[-1]
        self.rest: list[tuple[int, int, int]] = []  # of earlier batches: length, document, start

    def pack(self, docs: list[tuple[int, int]], last: bool = False) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """docs: (document, tokens). Gives full sequences; with ``last`` all that is left."""
        w = self.window
        waiting: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        for doc, n in docs:
            for k in range(n // w):
                yield w, [(doc, k * w, w)]
            if n % w:
                self._route(waiting, n % w, doc, n - n % w)
        for length, doc, start in self.rest:
            self._route(waiting, length, doc, start)
        self.rest = []
        for tier in waiting:
            tier.sort()
        bins: list[list] = []  # of a window: [gap, pieces]
        for tier in reversed(range(len(self.tiers))):  # longest first: best fit decreasing inside the tier
            gaps: list[tuple[int, int]] = []
            cap = self.tiers[tier]
            for length, doc, start in reversed(waiting[tier]):
                i = bisect_right(gaps, (length, -1))
                if i < len(gaps):
                    gap, b = gaps.pop(i)
                else:
                    gap, b = cap, len(bins)
                    bins.append([cap, cap, []])
                bins[b][2].append((doc, start, length))
                bins[b][1] = gap - length
                if gap > length:
                    insort(gaps, (gap - length, b))
        # Gaps of long windows are filled from the shorter tiers' windows, least filled first; a piece is cut to close a gap exactly.
        order = sorted(range(len(bins)), key=lambda b: (-bins[b][0], bins[b][1]))
        donors = sorted((b for b in order if bins[b][1]), key=lambda b: (bins[b][0], -bins[b][1]))
        taken: set[int] = set()  # give their pieces away
        filled: set[int] = set()  # receive them
        d = 0
        for b in order:
            cap, gap, pieces = bins[b]
            if b in taken or not gap:
                continue
            filled.add(b)
            while gap:
                while d < len(donors) and (not bins[donors[d]][2] or donors[d] in filled):
                    d += 1
                if d >= len(donors):
                    break
                doc, start, length = bins[donors[d]][2].pop()
                use = min(gap, length)
                pieces.append((doc, start, use))
                gap -= use
                taken.add(donors[d])
                if use < length:
                    bins[donors[d]][2].append((doc, start + use, length - use))
            bins[b][1] = gap
        for b in order:
            cap, gap, pieces = bins[b]
            if pieces and not gap:
                yield cap, pieces
            elif pieces:
                self.rest += [(length, doc, start) for doc, start, length in pieces]
        if last:
            yield from self._finish()

    def _route(self, waiting: list, length: int, doc: int, start: int) -> None:
        for i, cap in enumerate(self.tiers):
            if length <= cap:
                waiting[i].append((length, doc, start))
                return

    def _finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The last tokens of a task: windows of the largest tier that they fill, and one unfilled sequence at the end."""
        left, self.rest = sorted(self.rest, key=lambda x: (x[1], x[2])), []
        total = sum(x[0] for x in left)
        while total:
            cap = next((t for t in reversed(self.tiers) if t <= total), total)
            pieces, need = [], cap
            while need:
                length, doc, start = left.pop()
                use = min(need, length)
                pieces.append((doc, start, use))
                need -= use
                if use < length:
                    left.append((length - use, doc, start + use))
            total -= cap
            yield cap, pieces


def deal(sizes: list[int], step_tokens: int) -> tuple[list[int], int]:
    """The step group of each sequence, and how many groups there are: the largest sequence first, to the lightest group."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, out[i] = groups[0]
        heapq.heapreplace(groups, (load + sizes[i], out[i]))
    return out, len(groups)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """At most about SLICE characters of texts at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < SLICE):
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, batch: int = 2000, step_tokens: int = 16 * WINDOW) -> DataFrame:
    """A row per piece. step_group: a round's sequences in groups of equal tokens, ``step_tokens`` at most but for less than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        coder, packer = CachedTokenizer.of_process(tokenizer_path), Packer(tiers)
        kept: dict[int, tuple[int | None, np.ndarray]] = {}
        new: list[tuple[int, int]] = []
        n_docs = n_seq = step = 0

        def rows(sequences: list) -> Iterator[pa.RecordBatch]:
            nonlocal n_seq, step
            cols: list[list] = [[] for _ in range(9)]
            groups, used = deal([sum(p[2] for p in pieces) for _, pieces in sequences], step_tokens)
            for group, (tier, pieces) in zip(groups, sequences):
                offset = 0
                for doc, start, length in pieces:
                    name, ids = kept[doc]
                    for c, v in zip(cols, (name, start, length, zlib.crc32(ids[start : start + length]), len(ids), part | n_seq, offset, tier, part | step + group)):
                        c.append(v)
                    offset += length
                n_seq += 1
            step += used
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in OUT.split(", ")])

        def finished(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal new, kept
            yield from rows(list(packer.pack(new, last)))
            need = {doc for _, doc, _ in packer.rest}
            new, kept = [], {k: v for k, v in kept.items() if k in need}
            give_back()

        end = np.array([END], "<u4")
        try:
            for b in batches:
                names, at = b.column("doc_id").to_pylist(), 0
                for texts in _slices([t or "" for t in b.column("text").to_pylist()]):
                    for ids in coder.encode(texts):
                        kept[n_docs] = (names[at], np.concatenate([ids, end]))
                        new.append((n_docs, len(ids) + 1))
                        n_docs, at = n_docs + 1, at + 1
                        if len(new) == batch:
                            yield from finished(False)
            yield from finished(True)
        finally:
            coder.forget()

    with arrow_batches(docs.sparkSession, batch, 8):  # stored, as batches have to be bounded while it runs: pieces are a small part of the texts
        return spill(docs.select("doc_id", "text").mapInArrow(tidy(run), OUT), "packed")
