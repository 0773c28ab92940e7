"""Benchmark decontamination by template canonicalisation.

Texts become token lists, and these three streams:

* exact: all tokens in lower case;
* numbers: numbers (digits, number words of four languages, and runs of these as one) and units are typed placeholders, all else is in lower case;
* names: so are capitalised words, at the beginning of a sentence too, and words that follow each other without a mark between them are one name.

Hashes of all windows of ``WINDOW`` tokens of each stream meet those of the benchmark items. A lower-cased copy thus meets the item in the numbers stream, one with
exchanged names of any number of words in the names stream, and one made of little else than numbers in the exact stream. A document holds an item if in one stream
it has at least half of the item's windows (or ``enough`` of them, if that is less) and the slot values agree: within one occurrence every value that an item repeats
must be filled by one value each time (a share ``agree`` of the matched slots). Documents that have all exact windows are ``verbatim``, ones with exchanged values
``re-parameterised``, others ``partial``.

Documents are read in one pass for each ``BLOCK`` window hashes of the benchmark (32 MB, broadcast sorted); only matched windows go on, with their slot
values, and are joined with the items' by hash.

Defined cases: null texts and texts without tokens match nothing; an item shorter than a window is one window of its own length, exact, and one shorter than
``SHORT`` tokens is held only by documents that consist of it; windows of the numbers and names streams with fewer than ``WINDOW // 2`` literal tokens don't
count; windows that an item repeats count once, with their first place; repeated rows of a document (or item) count once; rows with a null doc_id are not
reported; an empty table on either side gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import arrow_batches, join_small, spill, tidy
from .shingles import mix

WINDOW = 8
SHORT = 4
ENOUGH = 13
AGREE = 0.75
BLOCK = 1 << 22
SLICE = 1 << 19  # characters looked at together
EXACT, NUMBERS, NAMES = 0, 1, 2  # streams; short items have WINDOW plus their length
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?;:,\n]"


def number_words() -> frozenset[str]:
    """Number words of English, French, German and Spanish (but for those that are articles, too), put together from their parts."""
    english = "zero one two three four five six seven eight nine ten eleven twelve hundred hundreds thousand thousands million millions billion billions trillion dozen dozens first third fifth ninth twelfth"
    stems, tens = "thir four fif six seven eigh nine".split(), "twen thir for fif six seven eigh nine".split()
    out = {*english.split(), *(x + "th" for x in "four six seven eigh ten eleven".split()), *(x + e for x in stems for e in ("teen", "teenth")), *(x + e for x in tens for e in ("ty", "tieth"))}
    out |= set("zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante septante huitante octante nonante cent mille milliard milliards".split())
    units, decades = "ein zwei drei vier fünf sechs sieben acht neun".split(), "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
    out |= {*units[1:], "zehn", "elf", "zwölf", *(x + "zehn" for x in "drei vier fünf sech sieb acht neun".split()), *decades, *(f"{u}und{d}" for u in units for d in decades)}
    out |= {*(u + x for u in ("", *units) for x in ("hundert", "tausend")), "millionen", "milliarde", "milliarden"}
    out |= set("cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón".split())
    out |= {*("dieci" + x for x in "séis siete ocho nueve".split()), *("veinti" + x for x in "uno ún una dós trés cuatro cinco séis siete ocho nueve".split()), "quinientos", "quinientas"}
    return frozenset(out | {x + e for x in "doscient trescient cuatrocient seiscient setecient ochocient novecient".split() for e in ("os", "as")})


NUMBER_WORDS = number_words()
#: Common unit names.
UNITS = ("mm", "cm", "m", "km", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "years", "meters", "metres", "meter", "kilometers", "kilometres", "miles", "mile", "feet", "foot", "inches", "inch", "grams", "kilograms", "pounds", "litres", "liters", "gallons", "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh", "w", "kw", "v", "hz")
_UNITS = frozenset(UNITS)

LITERAL, DIGITS, WORD, UNIT, NAME, MARK = range(6)
_HOLD = np.array([0, 2, 2, 3, 5, 0], np.uint64)  # codes of the placeholders
_MULT = np.random.default_rng(23).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HIT = "doc_id long, text_key long, stream int, h long, pos int, kinds array<int>, slots array<int>, values array<string>"
_HIT = [x.split()[0] for x in HIT.split(", ")]
_HIT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]


class Vocabulary(dict):
    """token -> number, with the class and the hash of each number."""

    __slots__ = ("kinds", "hashes")

    def __init__(self) -> None:
        super().__init__()
        self.kinds: list[int] = []
        self.hashes: list[int] = []

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ".!?;:,\n":
            kind = MARK
        elif "0" <= token[0] <= "9":
            kind = DIGITS
        elif low in NUMBER_WORDS:
            kind = WORD
        elif low in _UNITS:
            kind = UNIT
        else:
            kind = NAME if token[0] != low[0] else LITERAL
        self[token] = n = len(self.kinds)
        self.kinds.append(kind)
        self.hashes.append(xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")))
        return n


class Streams:
    """The streams of a list of texts: codes, and the document and first token of each."""

    def __init__(self, texts: list[str], words: Vocabulary) -> None:
        find = re.compile(TOKEN).findall
        per = [find(t if t.isascii() else normalize("NFC", t)) for t in texts]
        count = np.fromiter(map(len, per), np.int64, len(per))
        self.tokens = [t for p in per for t in p]
        number = np.fromiter(map(words.__getitem__, self.tokens), np.int64, len(self.tokens))
        doc = np.repeat(np.arange(len(per)), count)
        self.kind = np.array(words.kinds, np.int8)[number] if len(number) else np.zeros(0, np.int8)
        h = np.array(words.hashes, np.uint64)[number] if len(number) else np.zeros(0, np.uint64)
        prior = np.concatenate([[MARK], self.kind[:-1]])[: len(self.kind)]
        prior[np.concatenate([[True], doc[1:] != doc[:-1]])[: len(prior)]] = MARK
        word = self.kind != MARK
        within = (self.kind == WORD) & ((prior == WORD) | (prior == DIGITS))  # goes on with a number
        named = (self.kind == NAME) & (prior == NAME)
        rank = np.cumsum(word)
        self.first, self.length, self.doc, self.code, self.literal = {}, {}, {}, {}, {}
        for stream, keep, held in ((EXACT, word, ()), (NUMBERS, word & ~within, (DIGITS, WORD, UNIT)), (NAMES, word & ~within & ~named, (DIGITS, WORD, UNIT, NAME))):
            at = np.flatnonzero(keep)
            slot = np.isin(self.kind[at], held)
            self.first[stream], self.doc[stream], self.literal[stream] = at, doc[at], ~slot
            self.length[stream] = np.diff(np.append(rank[at], rank[-1] + 1 if len(rank) else 1))  # with the tokens that go on with it
            self.code[stream] = np.where(slot, _HOLD[self.kind[at]], h[at])

    def windows(self, stream: int, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``size`` that have at least so many literal tokens."""
        code, doc = self.code[stream], self.doc[stream]
        n = len(code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.full(n, (size << 8) + stream, np.uint64)
        for k in range(size):
            h += code[k : n + k] * _MULT[k]
        count = np.concatenate([[0], np.cumsum(self.literal[stream])])
        good = np.flatnonzero((doc[:n] == doc[size - 1 :]) & (count[size:] - count[:n] >= least))
        return good, mix(h[good]).view(np.int64)

    def slots(self, stream: int, start: int, size: int) -> tuple[list[int], list[int], list[str]]:
        """Kinds, places and values of the placeholders in a window; numbers of both kinds are of one."""
        kinds, places, values = [], [], []
        for i in range(start, start + size):
            if not self.literal[stream][i]:
                at = self.first[stream][i]
                kinds.append(max(int(self.kind[at]), WORD))
                places.append(i - start)
                values.append(" ".join(self.tokens[at : at + self.length[stream][i]]).lower())
        return kinds, places, values


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < SLICE):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def window_rows(texts: DataFrame, lengths: list[int], wanted=None) -> DataFrame:
    """texts: (doc_id, text). A row per window of each stream, and per window of a short item's length; with ``wanted``, a broadcast of sorted hashes, of these
    alone. Without it each text gives its own length's window if it is short, as items do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary()
        known = wanted.value if wanted is not None else None
        if known is not None:  # most windows are none of the benchmark's: a table of their last bits tells
            rough = np.zeros(1 << 22, bool)
            rough[known & (len(rough) - 1)] = True
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for i, j in _pieces(texts):
                if len(words) > 100_000:
                    words = Vocabulary()
                s = Streams(texts[i:j], words)
                size = np.bincount(s.doc[EXACT], minlength=j - i)
                keys: dict[int, int] = {}
                rows = []
                for stream, width in [(x, WINDOW) for x in (EXACT, NUMBERS, NAMES)] + [(WINDOW + n, n) for n in lengths]:
                    own = EXACT if stream > NAMES else stream
                    at, h = s.windows(own, width, 0 if own == EXACT else WINDOW // 2)
                    if stream > NAMES and (known is None or width < SHORT):  # whole texts only
                        whole = size[s.doc[own][at]] == width
                        at, h = at[whole], h[whole]
                    if known is not None:
                        hit = rough[h & (len(rough) - 1)]
                        at, h = at[hit], h[hit]
                        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                        at, h = at[hit], h[hit]
                    begin = np.searchsorted(s.doc[own], np.arange(j - i))
                    for a, x in zip(at.tolist(), h.tolist()):
                        d = int(s.doc[own][a])
                        if d not in keys:
                            keys[d] = xxh3_64_intdigest(texts[i + d].encode("utf-8", "surrogatepass")) - (1 << 63)
                        rows.append((ids[i + d], keys[d], stream, x, a - int(begin[d]), *s.slots(own, a, width)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), _HIT_TYPES)], _HIT)

    return texts.mapInArrow(tidy(run), HIT)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, stream, h, item_pos, kinds, slots, values: each of an item's windows once, with its first place."""
    texts = benchmark.select(F.col("item_id").alias("doc_id"), "text").distinct()
    found = window_rows(texts, list(range(1, WINDOW)))
    first = F.min_by(F.struct(F.col("pos").alias("item_pos"), "kinds", "slots", F.col("values").alias("item_values")), "pos").alias("w")
    return found.groupBy(F.col("doc_id").alias("item_id"), "stream", "h").agg(first).select("item_id", "stream", "h", "w.*")


def find(docs: DataFrame, benchmark: DataFrame, enough: int = ENOUGH, agree: float = AGREE) -> DataFrame:
    """A row per document and item that it holds."""
    spark = docs.sparkSession
    with arrow_batches(spark, 2000, 16):
        items = spill(item_windows(benchmark), "template-items")
        sizes = items.groupBy("item_id", "stream").agg(F.count(F.lit(1)).alias("item_windows"))
        lengths = sorted(r["stream"] - WINDOW for r in items.where(F.col("stream") > NAMES).select("stream").distinct().collect())
        blocks = -(-items.count() // BLOCK)
        hits = None
        for i in range(max(1, blocks)):  # nearly every benchmark is one block
            part = items.where(F.pmod("h", F.lit(max(1, blocks))) == i).select("h").distinct().toArrow().column("h").to_numpy()
            wanted = spark.sparkContext.broadcast(np.sort(part) if len(part) else np.zeros(1, np.int64))
            found = window_rows(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), lengths, wanted)
            found = spill(found.drop("kinds", "slots"), "template-hits")
            hits = found if hits is None else hits.unionByName(found)
    pairs = hits.join(items, ["stream", "h"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    occurrence = ["doc_id", "text_key", "item_id", "stream", "shift"]
    # Within one occurrence every value of the item must be filled by one value.
    slots = F.transform("slots", lambda k, i: F.struct(F.get("kinds", i).alias("t"), (F.col("item_pos") + k).alias("slot"), F.get("item_values", i).alias("v"), F.get("values", i).alias("to")))
    filled = pairs.select(*occurrence, F.explode(slots).alias("s")).select(*occurrence, "s.*").distinct()
    voted = filled.groupBy(*occurrence, "t", "v", "to").agg(F.count(F.lit(1)).alias("n"))
    value = voted.groupBy(*occurrence, "t", "v").agg(F.sum("n").alias("n"), F.max(F.struct("n", "to")).alias("best"))
    judged = value.groupBy(*occurrence).agg(F.sum("n").alias("n_slots"), F.sum("best.n").alias("n_agree"), F.sum((F.col("best.to") != F.col("v")).cast("long")).alias("n_changed"))
    runs = pairs.select(*occurrence, "item_pos").distinct().join(judged, occurrence, "left").na.fill(0, ["n_slots", "n_agree", "n_changed"])
    kept = runs.where(F.col("n_agree") >= agree * F.col("n_slots"))
    total = kept.groupBy("doc_id", "item_id", "stream").agg(F.countDistinct("item_pos").alias("windows"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed")).join(sizes, ["item_id", "stream"])
    held = total.where(F.col("windows") >= F.least(F.lit(enough), F.ceil(F.col("item_windows") / 2)))
    whole = F.col("stream").isin(NUMBERS, NAMES) == F.lit(False)
    best = F.max(F.struct("windows", (-F.col("stream")).alias("by"), "item_windows", "n_slots", "n_changed")).alias("b")
    one = held.groupBy("doc_id", "item_id").agg(best, F.max(whole & (F.col("windows") == F.col("item_windows"))).alias("same"), F.max("n_changed").alias("changed"))
    kind = F.when(F.col("same"), "verbatim").when(F.col("changed") > 0, "re-parameterised").otherwise("partial")
    return one.select("doc_id", "item_id", "b.windows", "b.item_windows", "b.n_slots", F.when(F.col("same"), 0).otherwise(F.col("changed")).cast("long").alias("n_changed"), kind.alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document holds no item; rows with a null doc_id stay."""
    found = spill(find(docs, benchmark).select("doc_id").distinct(), "template-found")
    return join_small(docs, found, ["doc_id"], "left_anti").select(*docs.columns)


#: The same over the driver's views. Window tokens are joined as text in place of hashes.
SQL = r"""
    WITH raw AS (
        SELECT side, id, regexp_extract_all(nfc_normalize(text), '[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{Nl}\p{No}]+|[.!?;:,\n]') AS t
        FROM (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION SELECT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL)),
    tok AS (
        SELECT row_number() OVER () AS r, side, id, t, list_transform(t, lambda x: CASE WHEN x IN ('.', '!', '?', ';', ':', ',', chr(10)) THEN 'P' WHEN x[1] BETWEEN '0' AND '9' THEN 'D' WHEN lower(x) IN @NUMBERS THEN 'W' WHEN lower(x) IN @UNITS THEN 'U' WHEN x[1] <> lower(x)[1] THEN 'N' ELSE 'L' END) AS k FROM raw),
    -- Of each stream the first place of every token; what comes up to the next one is its value.
    kept AS (
        SELECT r, side, id, t, k, s, list_filter(range(1, len(t) + 1), lambda i: k[i] <> 'P' AND NOT (s > 0 AND i > 1 AND k[i] = 'W' AND k[i - 1] IN ('W', 'D')) AND NOT (s = 2 AND i > 1 AND k[i] = 'N' AND k[i - 1] = 'N')) AS place
        FROM tok, range(3) x(s)),
    -- The last place of a token's run: the one before the next kept token or mark.
    stream AS (
        SELECT r, side, id, s, place, list_transform(place, lambda i: CASE WHEN s > 0 AND k[i] IN ('D', 'W') THEN 'D' WHEN s > 0 AND k[i] = 'U' THEN 'U' WHEN s = 2 AND k[i] = 'N' THEN 'N' ELSE 'L' END) AS kind,
            list_transform(place, lambda i, j: lower(array_to_string(t[i : i + len(list_filter(range(i + 1, CASE WHEN j < len(place) THEN place[j + 1] ELSE len(t) + 1 END), lambda x: k[x] <> 'P'))], ' '))) AS val FROM kept),
    code AS (SELECT *, list_transform(kind, lambda x, j: CASE WHEN x = 'L' THEN val[j] ELSE chr(1) || x END) AS c FROM stream),
    win AS (
        SELECT r, side, id, s, p AS pos, kind[p : p + 7] AS kinds, val[p : p + 7] AS vals, array_to_string(c[p : p + 7], ' ') AS h
        FROM (SELECT *, unnest(range(1, len(c) - 6)) AS p FROM code) WHERE s = 0 OR len(list_filter(kind[p : p + 7], lambda x: x = 'L')) >= 4
        UNION ALL
        SELECT i.r, 'i', i.id, 8 + len(i.c), 1, i.kind, i.val, array_to_string(i.c, ' ') FROM code i WHERE i.side = 'i' AND i.s = 0 AND len(i.c) BETWEEN 1 AND 7
        UNION ALL
        SELECT r, 'd', id, 8 + n, p, kind[p : p + n - 1], val[p : p + n - 1], array_to_string(c[p : p + n - 1], ' ')
        FROM (SELECT *, unnest(range(1, len(c) - n + 2)) AS p FROM code, (SELECT DISTINCT len(c) AS n FROM code WHERE side = 'i' AND s = 0 AND len(c) BETWEEN 1 AND 7) WHERE side = 'd' AND s = 0) WHERE n >= 4 OR n = len(c)),
    items AS (SELECT id, s, h, min(pos) AS pos, arg_min(kinds, pos) AS kinds, arg_min(vals, pos) AS vals FROM win WHERE side = 'i' GROUP BY id, s, h),
    sizes AS (SELECT id AS item_id, s, count(*) AS item_windows FROM items GROUP BY ALL),
    pairs AS (SELECT d.r, d.id AS doc_id, i.id AS item_id, i.s, d.pos - i.pos AS shift, i.pos AS item_pos, i.kinds, i.vals AS ivals, d.vals FROM win d JOIN items i ON d.h = i.h AND d.s = i.s WHERE d.side = 'd'),
    filled AS (
        SELECT DISTINCT r, doc_id, item_id, s, shift, t, slot, v, w FROM (SELECT r, doc_id, item_id, s, shift, unnest(kinds) AS t, unnest(ivals) AS v, unnest(vals) AS w, unnest(range(item_pos, item_pos + len(kinds))) AS slot FROM pairs) WHERE t <> 'L'),
    voted AS (SELECT r, doc_id, item_id, s, shift, t, v, w, count(*) AS n FROM filled GROUP BY ALL),
    val AS (SELECT r, doc_id, item_id, s, shift, t, v, sum(n) AS n, max(n) AS m, arg_max(w, (n, w)) AS w FROM voted GROUP BY ALL),
    judged AS (SELECT r, doc_id, item_id, s, shift, sum(n) AS n_slots, sum(m) AS n_agree, count(*) FILTER (WHERE w <> v) AS n_changed FROM val GROUP BY ALL),
    kept_runs AS (
        SELECT p.doc_id, p.item_id, p.s, p.item_pos, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed
        FROM (SELECT DISTINCT r, doc_id, item_id, s, shift, item_pos FROM pairs) p LEFT JOIN judged USING (r, doc_id, item_id, s, shift) WHERE coalesce(n_agree, 0) >= 0.75 * coalesce(n_slots, 0)),
    total AS (SELECT doc_id, item_id, s, count(DISTINCT item_pos) AS windows, max(n_slots) AS n_slots, max(n_changed) AS n_changed FROM kept_runs GROUP BY ALL),
    held AS (SELECT * FROM total JOIN sizes USING (item_id, s) WHERE windows >= least(13, ceil(item_windows / 2))),
    one AS (
        SELECT doc_id, item_id, max({'w': windows, 'by': -s, 'i': item_windows, 'n': n_slots}) AS b, bool_or(s NOT IN (1, 2) AND windows = item_windows) AS same, max(n_changed) AS changed
        FROM held GROUP BY ALL)
    SELECT doc_id, item_id, b.w AS windows, b.i AS item_windows, b.n::BIGINT AS n_slots, CASE WHEN same THEN 0 ELSE changed END::BIGINT AS n_changed,
        CASE WHEN same THEN 'verbatim' WHEN changed > 0 THEN 're-parameterised' ELSE 'partial' END AS kind FROM one
""".replace("@NUMBERS", str(tuple(sorted(NUMBER_WORDS)))).replace("@UNITS", str(UNITS))
