"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment.

Texts and benchmark items are compared as letters and digits in lower case, with one space
for everything between. A passage of a text leaks an item if at most budget(m) edits turn it
into the item's m characters. By the q-gram lemma such a passage shares at least
m - q + 1 - q * budget of the item's q-grams, on diagonals (place in the text minus place in
the item) at most budget apart. The diagonals are cut into cells of budget + 1, two adjacent
cells make a band, so bands overlap and each such set of diagonals lies inside one. Bands
with enough shared q-grams are verified in their own text by an alignment of the whole item
that stays within the band and a margin, with free ends in the text; neighbouring bands of an
item are aligned together up to RUN cells. Items are a stated query set: they are
broadcast in blocks of bounded size and each block meets every text.

Cases: null and empty texts have no leaks; null, empty items and those without letters or
digits are never found; items shorter than q are found only unchanged, as whole words.
Repeated rows are judged one by one, repeated items are found each. Places are code points of
the original text, ends are exclusive. A passage that leaks an item is reported once, with
the fewest edits, on a tie the first one. A run of bands is narrower than an item is long, so
passages that do not overlap are all reported; an item that repeats itself may be found at
several overlapping passages. What is found in a text depends on no other text. Texts are
searched whole. An empty table, or no items, gives no leaks. Other columns pass through; an
input column named leaks is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import chunks, tidy

Q, PERCENT = 7, 12
#: Cells that are aligned at once, with the margins.
RUN = 6
#: Characters of items that are broadcast at once.
BLOCK_CHARS = 8 << 20
LEAK = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType()),
])

_word: np.ndarray | None = None


def _is_word(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters or digits."""
    global _word
    if _word is None:
        _word = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _word[codes]


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points to compare and their places in the text; no space at either end."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return codes, np.empty(0, np.int64)
    word = _is_word(codes)
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    out = np.where(word, codes, 32)[at]
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out.astype(np.uint32), at


def budget(m: int, q: int = Q, percent: int = PERCENT) -> int:
    """Edits allowed in m characters: percent of them, but no more than leave a shared q-gram for sure."""
    return max(0, min(m * percent // 100, (m - q) // q))


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.empty(0, np.uint64)
    n = len(codes) - q + 1
    h = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    for i in range(q):
        h *= np.uint64(0x100000001B3)
        h += wide[i : n + i]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


#: Rows of an item that are compared with the text at a time, and diagonals of all bands that are aligned at once.
AT_ONCE, LANES = 16, 1 << 13
ONE, FAR = 1 << 32, 1 << 60

Band = tuple[np.ndarray, np.ndarray, int, int, int]


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between the item and a passage of text, on diagonals lo to hi - 1: (edits, start, end).

    None if there is no passage with at most so many edits. Of the passages with the fewest edits
    the one that ends first counts, of these the one that starts first.
    """
    return align_all([(item, text, lo, hi, most)])[0]


def align_all(bands: Sequence[Band]) -> list[tuple[int, int, int] | None]:
    """What align gives for each band: bands of about the same width go row by row together."""
    out: list[tuple[int, int, int] | None] = [None] * len(bands)
    order = sorted(range(len(bands)), key=lambda k: (bands[k][3] - bands[k][2], len(bands[k][0])), reverse=True)
    while order:
        some = max(1, LANES // (bands[order[0]][3] - bands[order[0]][2]))
        _align_some(bands, order[:some], out)
        order = order[some:]
    return out


def _align_some(bands: Sequence[Band], lanes: list[int], out: list) -> None:
    """Rows after which a band has more edits than it may are left out, and so is the rest of its item."""
    width = max(bands[k][3] - bands[k][2] for k in lanes)
    rows = max(len(bands[k][0]) for k in lanes)
    items = np.zeros((len(lanes), rows), np.uint32)
    padded = np.zeros((len(lanes), rows + width - 1), np.uint32)  # no item holds a zero
    row = np.empty((len(lanes), width), np.int64)  # edits * ONE + start
    least = np.full((len(lanes), width), -FAR)  # diagonals beyond a narrower band are never entered
    for x, k in enumerate(lanes):
        item, text, lo, hi, _ = bands[k]
        m, n = len(item), len(text)
        items[x, :m] = item
        a, b = max(lo, 0), min(hi - 1 + m, n)
        if b > a:
            padded[x, a - lo : b - lo] = text[a:b]
        start = np.arange(lo, lo + width, dtype=np.int64)
        row[x] = np.where((start >= 0) & (start <= n) & (start < hi), start, FAR)
        least[x, hi - lo :] = FAR
    steps = np.arange(width, dtype=np.int64) * ONE
    row -= steps  # a step to the right costs nothing then, one down twice as much
    lane, lengths = np.array(lanes), np.array([len(bands[k][0]) for k in lanes])
    most = np.array([bands[k][4] for k in lanes])
    narrow = bool((least > 0).any())
    for first in range(0, rows, AT_ONCE):
        some = np.lib.stride_tricks.sliding_window_view(padded[:, first : first + AT_ONCE + width - 1], width, axis=1).transpose(1, 0, 2)
        differ = (some != items[:, first : first + AT_ONCE].T[:, :, None]) * np.int64(ONE)
        differ[some == 0] = FAR
        ended: dict[int, list[int]] = {}
        for x in np.flatnonzero(lengths <= first + AT_ONCE).tolist():
            ended.setdefault(int(lengths[x]), []).append(x)
        for i, cost in enumerate(differ, first + 1):
            down = row[:, 1:] + 2 * ONE
            row += cost
            np.minimum(row[:, :-1], down, out=row[:, :-1])
            np.minimum.accumulate(row, axis=1, out=row)
            if narrow:
                np.maximum(row, least, out=row)
            for x in ended.get(i, ()):
                _, _, lo, _, allowed = bands[lane[x]]
                edits = (row[x] + steps) >> 32
                best = int(np.argmin(edits))
                if edits[best] <= allowed:
                    out[lane[x]] = int(edits[best]), int((row[x, best] + steps[best]) & (ONE - 1)), lo + best + i
        going = (lengths > first + AT_ONCE) & ((row + steps).min(axis=1) >> 32 <= most)
        if not going.any():
            return
        if not going.all():
            row, least, items, padded, lane, lengths, most = (z[going] for z in (row, least, items, padded, lane, lengths, most))


class Index:
    """Q-grams of a block of items."""

    def __init__(self, items: Sequence[tuple[int, str | None]], q: int = Q, percent: int = PERCENT):
        self.q = q
        self.items, self.short = [], []
        for item_id, text in items:
            codes, _ = normalised(text)
            if len(codes) >= q:
                self.items.append((item_id, codes))
            elif len(codes):
                self.short.append((item_id, f" {_text(codes)} "))
        self.m = np.array([len(c) for _, c in self.items], dtype=np.int64)
        self.e = np.array([budget(int(m), q, percent) for m in self.m], dtype=np.int64)
        self.need = self.m - q + 1 - q * self.e
        grams = [_grams(c, q) for _, c in self.items]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int32)
        self.width, self.enough, self.mixed = (self.e[self.item] + 1).astype(np.int32), self.need[self.item].astype(np.int32), self.item * 0x9E3779B1
        self.gram, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = np.uint64(64 - max(16, min(24, 5 + int(len(self.gram)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
        self.seen[(self.gram >> self.bits).astype(np.int64)] = True

    def search(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Leaks (item_id, start, end, edits) of each text."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        parts = [normalised(t) for t in texts]
        for i, (codes, at) in enumerate(parts):
            if self.short and len(codes):
                found[i] += self._short(_text(codes), at)
        if len(self.gram):
            ends = np.cumsum([len(c) + 1 for c, _ in parts])
            glued = np.concatenate([x for c, _ in parts for x in (c, np.zeros(1, np.uint32))])
            bands = self._bands(glued, ends)
            matches = align_all([(self.items[i][1], parts[d][0], lo, hi, int(self.e[i])) for d, i, lo, hi in bands])
            for (d, i, _, _), match in zip(bands, matches, strict=True):
                if match:
                    edits, start, end = match
                    at = parts[d][1]
                    found[d].append((self.items[i][0], int(at[start]), int(at[end - 1]) + 1, edits))
        return [sorted(set(x)) for x in found]

    def _short(self, text: str, at: np.ndarray):
        text = f" {text} "
        for item_id, item in self.short:
            i = text.find(item)
            while i >= 0:
                yield item_id, int(at[i]), int(at[i + len(item) - 3]) + 1, 0
                i = text.find(item, i + 1)

    @staticmethod
    def _crowded(cells: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether a cell and one beside it may hold enough; cells that share a counter count together, so none is lost."""
        counters = 1 << max(12, min(20, len(cells).bit_length()))
        at = cells & (counters - 1)
        held = np.bincount(at, minlength=counters).astype(np.int32)
        both = held + np.maximum(np.roll(held, 1), np.roll(held, -1))
        return both[at] >= need

    def _bands(self, glued: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, lowest diagonal, end) where bands share enough q-grams; short runs of such bands are one."""
        grams = _grams(glued, self.q)
        where = np.flatnonzero(self.seen[(grams >> self.bits).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.gram, grams[where]), len(self.gram) - 1)
        hit = self.gram[slot] == grams[where]
        where, slot = where[hit], slot[hit]
        if not len(where):
            return []
        n = self.count[slot]
        total = int(n.sum())
        entry = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        begins = np.concatenate([[0], ends[:-1]])
        doc = np.searchsorted(ends, where, side="right")
        # cells of an item in one text follow each other, those of different texts are apart; diagonals may be negative, by an item's length at most
        under = int(self.m.max()) + 1
        base = begins + (np.arange(len(ends)) + 1) * under
        span = int(base[-1] + ends[-1] - begins[-1]) + under
        narrow = np.int32 if len(glued) < 1 << 30 else np.int64
        cell = np.repeat(base[doc], n)
        cell += (np.repeat((where - begins[doc]).astype(narrow), n) - self.place[entry]) // self.width[entry]
        some = np.flatnonzero(self._crowded(cell + self.mixed[entry], self.enough[entry]))
        keys, counts = np.unique(self.item[entry[some]] * span + cell[some], return_counts=True)
        both = counts.copy()
        beside = np.flatnonzero(keys[1:] == keys[:-1] + 1)
        both[beside] += counts[beside + 1]
        good = keys[both >= self.need[keys // span]]
        out = []
        texts = np.searchsorted(base - under, good % span, side="right") - 1
        for key, d in zip(good.tolist(), texts.tolist(), strict=True):
            i, c = key // span, key % span - int(base[d])
            w = int(self.e[i]) + 1
            lo, hi = c * w - w, (c + 2) * w + w
            if out and out[-1][:2] == (d, i) and out[-1][3] >= lo + 2 * w and hi - out[-1][2] <= RUN * w:
                out[-1] = (d, i, out[-1][2], hi)
            else:
                out.append((d, i, lo, hi))
        return out


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item: str = "text", q: int = Q, percent: int = PERCENT) -> DataFrame:
    """Adds leaks: an array of (item_id, start, end, edits) for each text."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item).alias("item"))
    size = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    docs = docs.drop(*(c for c in docs.columns if c == "leaks")).withColumn("leaks", F.array().cast(T.ArrayType(LEAK)))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).collect()
        docs = _mark(docs, Index([tuple(r) for r in rows], q, percent), text)
    return docs


def _mark(docs: DataFrame, index: Index, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index("leaks")

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text, 2 << 20):
                before = batch.column(place).to_pylist()
                new = [[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in found] for found in shared.value.search(batch.column(text).to_pylist())]
                columns = list(batch.columns)
                columns[place] = pa.array([a + b for a, b in zip(before, new, strict=True)], batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
