"""N-gram Jaccard join: signature trees over the texts that share a rare shingle.

The trees are the method; a prefix filter before them is the candidate step: it deals the
sets to the trees, since trees over all sets would meet pair by pair. It loses no link.

1. Shingles. A text is cut into words, each run of n words is a shingle (64-bit hash), and a
   text's distinct shingles are its set. Texts with equal sets form a class and go on as one.
2. Blocking without loss. All shingles have one order: first those with the rarest word, then
   by hash. Sets that reach the threshold share one of the first p = |x| - ceil(t |x|) + 1
   shingles of that order (the prefix), and l of the first p + l - 1. Ordinary texts fill them
   with shingles of rare words, which nobody shares, so common words and passages make no
   large blocks, and a set with fewer than l shared ones there has no partner. The order rests
   on a bounded table of frequent words; any table gives the same result, a better one is
   faster. For each shared prefix shingle, and each range of sizes that can be linked, the
   smallest set that has it is the hub of a group.
3. Signature trees. A group is dealt out in blocks of at most BLOCK sets, its hub going to
   each of them. In a block the sets are leaves of a binary tree whose nodes hold the OR of
   their token bitmaps, their size range and their largest number of bitmap collisions. A dual
   traversal leaves out pairs of nodes whose largest possible overlap is too small, or whose
   sets are known to be linked already, and counts the overlap of the pairs of sets left.
4. Large groups. Blocks of a group meet in its hub. Only sets that are not yet in the group's
   largest component have to be compared with the other blocks, again by dual traversal.
5. Links of the blocks become components; a component is named by its smallest id.

Cases: null and empty texts, and those without words, have an empty set and link with nothing.
Texts with fewer than n words have one shingle, the whole sequence. Repeated rows, and rows
with the same id, are rows of their own; a null id is never a component's name unless no row
of the component has another. Words are runs of anything but ASCII white space, with A-Z
lower-cased. Texts are read whole, however long. Ties do not occur: a link is decided by whole
numbers, and of repeated smallest ids the name is the same. An empty table gives an empty
table. Columns other than id and text do not matter to the join, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, removed, tidy, written
from .components import components

#: Sets of a block; a task holds the blocks it works on one at a time.
BLOCK = 256
#: A word of at least this share of all words may enter the table of frequent words: a million words at most.
FREQUENT = 1e-6
#: Tables with at most so many rows of three numbers are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
SET_SCHEMA = "doc_id long, text_hash long, size int, s1 long, s2 long, shingles array<long>"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << 16) - 1, _ODD)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of _ODD; those of short texts are at hand."""
    return _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _ODD)]), dtype=np.uint64)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order: polynomial in the word's bytes, then mixed.

    A text is taken in pieces of about PIECE bytes that end at white space; a word's hash does not
    depend on its place.
    """
    if not text:
        return np.empty(0, np.uint64)
    data, start, parts = np.frombuffer(text.encode().translate(_LOWER), dtype=np.uint8), 0, []
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_piece_hashes(data[start:end]))
        start = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power, dtype=np.uint64)])
    # bring each word's sum to the same power: times the power of the distance to the text's end
    sums = (total[ends] - total[starts]) * power[len(data) - 1 - starts]
    return _word(sums, ends - starts, len(data))


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _word(sums: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Takes the text's length out of the sums again, and the word's length in."""
    back = np.uint64(pow(int(_INVERSE), n - 1, 1 << 64))
    return _mix(sums * back + lengths.astype(np.uint64) * _ODD)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return words
    if len(words) < n:
        h = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for w in words:
                h = _mix(np.array([h * _ODD ^ w]))[0]
        return np.array([h])
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = _mix(h * _ODD ^ words[i : len(words) - n + 1 + i])
    return h


def prefix_length(size: Column, percent: int) -> Column:
    """|x| - ceil(t |x|) + 1, of a column of sizes."""
    return size - F.ceil(size * percent / F.lit(100.0) - F.lit(1e-9)).cast("int") + 1


def shared_need(size: Column, percent: int) -> Column:
    """l of a set of this size: half its prefix and one more."""
    return (prefix_length(size, percent) / 2).cast("int") + 1


def _frequent_words(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words, sorted, and their counts.

    A task reports the words that have at least the share FREQUENT of its own words, so no
    word that has it in the corpus is missed and no task reports more than 1 / FREQUENT.
    """

    def run(batches):
        words, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for whole in batches:
            for batch in chunks(whole, text):
                own = np.concatenate([np.empty(0, np.uint64), *(word_hashes(t) for t in batch.column(text).to_pylist())])
                total += len(own)
                new, n = np.unique(own, return_counts=True)
                words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(words)).astype(np.int64)
        some = counts >= max(2, total * FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(counts[some])], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["word", "n"])

    sums = docs.select(text).mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = written(sums, "words")
    total = table.where("word is null").select(F.sum("n")).first()[0] or 0
    head = table.where((F.col("word").isNotNull()) & (F.col("n") >= max(2.0, total * FREQUENT))).toArrow()
    removed(table)
    words = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], head.column("n").to_numpy()[order]


def _sets(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """A row for each document with its set in the order of the blocking, written once."""
    words, counts = _frequent_words(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((words, counts))

    def run(batches):
        known, count = shared.value
        for whole in batches:
            for batch in chunks(whole, "text", 4 << 20):
                sizes, one, two, arrays = [], [], [], []
                for value in batch.column("text").to_pylist():
                    own = word_hashes(value)
                    rank = np.zeros(len(own), np.int64)
                    if len(known) and len(own):
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        rank = np.where(known[at] == own, count[at], 0)
                    shingles = shingle_hashes(own, n)
                    if len(own) >= n:
                        rarest = rank[: len(shingles)]
                        for i in range(1, n):
                            rarest = np.minimum(rarest, rank[i : i + len(shingles)])
                    else:
                        rarest = rank[:1]
                    whole_set, first = np.unique(shingles, return_index=True)
                    size = len(whole_set)
                    order = np.lexsort((whole_set, rarest[first]))
                    sizes.append(size)
                    one.append(int(np.add.reduce(_mix(whole_set)).view(np.int64)) if size else 0)
                    two.append(int(np.add.reduce(_mix(whole_set ^ _ODD)).view(np.int64)) if size else 0)
                    arrays.append(whole_set[order].view(np.int64))
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]))),
                    ],
                    names=["doc_id", "text_hash", "size", "s1", "s2", "shingles"],
                )

    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(tidy(run), SET_SCHEMA)
    return written(cut.withColumn("row", F.monotonically_increasing_id()), "sets")


class Tree:
    """Signature tree over some sets: nodes are halves of the sets sorted by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0))
        self.bits: dict[tuple[int, int], np.ndarray] = {}
        self.span: dict[tuple[int, int], tuple[int, int, int]] = {}

    def sign(self, width: int) -> None:
        """Builds the nodes bottom-up with bitmaps of width bits."""
        excess = {}
        for at, i in enumerate(self.order):
            flags = np.zeros(width, dtype=bool)
            flags[(self.sets[i] % np.uint64(width)).astype(np.int64)] = True
            self.bits[at, at + 1] = np.packbits(flags)
            excess[at] = len(self.sets[i]) - int(flags.sum())
            self.span[at, at + 1] = (len(self.sets[i]), len(self.sets[i]), excess[at])
        if self.order:
            self._join(0, len(self.order))

    def _join(self, lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            self._join(lo, mid)
            self._join(mid, hi)
            self.bits[lo, hi] = self.bits[lo, mid] | self.bits[mid, hi]
            (a, b, c), (d, e, f) = self.span[lo, mid], self.span[mid, hi]
            self.span[lo, hi] = (min(a, d), max(b, e), max(c, f))


class Union:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, labels: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join what is not joined yet, among left or between left and right.

    labels: of left, then right; equal ones are joined already. Yields places in that list.
    """
    a = Tree(left)
    b = a if right is None else Tree(right)
    shift = 0 if right is None else len(left)
    joined = Union(labels)
    width = 1 << max(9, math.ceil(math.log2(max(1, 4 * max([*a.sizes, *b.sizes], default=1)))))
    for tree in {id(a): a, id(b): b}.values():
        tree.sign(width)
    if not left or right is not None and not right:
        return
    stack = [((0, len(left)), (0, len(b.order)))]
    while stack:
        p, q = stack.pop()
        (p_lo, p_hi, p_more), (q_lo, q_hi, q_more) = a.span[p], b.span[q]
        if 100 * p_hi < percent * q_lo or 100 * q_hi < percent * p_lo:
            continue
        if p != q or shift:
            # both sets need (t / (1 + t)) of their sizes together; the least sizes give the least need
            most = min(p_hi, q_hi, int(np.bitwise_count(a.bits[p] & b.bits[q]).sum()) + min(p_more, q_more))
            if (100 + percent) * most < percent * (p_lo + q_lo):
                continue
        roots = {joined.find(a.order[i]) for i in range(*p)} | {joined.find(b.order[i] + shift) for i in range(*q)}
        if len(roots) == 1:
            continue
        if p[1] - p[0] == 1 and q[1] - q[0] == 1:
            i, j = a.order[p[0]], b.order[q[0]]
            if (shift or i != j) and linked(a.sets[i], b.sets[j], percent):
                joined.up[joined.find(i)] = joined.find(j + shift)
                yield i, j + shift
            continue
        halves_p = [p] if p[1] - p[0] == 1 else [(p[0], sum(p) // 2), (sum(p) // 2, p[1])]
        halves_q = [q] if q[1] - q[0] == 1 else [(q[0], sum(q) // 2), (sum(q) // 2, q[1])]
        if p == q and not shift:
            stack += [(halves_p[0], halves_p[1]), (halves_p[1], halves_p[1]), (halves_p[0], halves_p[0])]
        else:
            stack += [(x, y) for x in halves_p for y in halves_q]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
    """(side, node, label, sorted set) of each row of each key, from rows that are sorted by it."""
    now, rows = None, []
    for batch in batches:
        arrays = batch.column("shingles")
        flat = arrays.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(arrays).to_numpy(zero_copy_only=False))])
        plain = zip(*(batch.column(k).to_pylist() for k in ("side", "node", "label")), strict=True)
        for i, (key, row) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), plain, strict=True)):
            if key != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append((*row, np.sort(flat[ends[i] : ends[i + 1]])))
    if rows:
        yield rows


def _linked_in_blocks(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) of each block. rows: keys, node, label, side (0 or 1; 1 only if two sides meet), shingles."""

    def run(batches):
        out_a, out_b = [], []
        for block in _runs(batches, keys):
            every = sorted({r[:2]: r for r in block}.values(), key=lambda r: r[:2])
            cut = sum(r[0] == 0 for r in every)
            if not cut or len(every) < 2:
                continue
            sets = [r[3] for r in every]
            for i, j in tree_links(sets[:cut], sets[cut:] or None, [r[2] for r in every], percent):
                out_a.append(every[i][1])
                out_b.append(every[j][1])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if its counted rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _links(sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the representatives of classes, enough of them to join each component."""
    need, length = shared_need(F.col("size"), percent), prefix_length(F.col("size"), percent)
    # two numbers a row: the shingle, and the set's row with a bit that tells the prefix from what follows it
    first = sets.join(_small(reps.select("row")), "row").select(length.alias("p"), "row", F.posexplode(F.slice("shingles", F.lit(1), length + need - 1)).alias("at", "shingle"))
    first = first.select("shingle", (F.col("row") * 2 + (F.col("at") < F.col("p")).cast("long")).alias("mark"))
    row = F.shiftright("mark", 1)
    shared = first.groupBy("shingle").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).where("lo < hi")
    shared = written(shared.select("shingle"), "shared")
    met = written(first.join(shared, "shingle").select("shingle", row.alias("row"), F.expr("mark % 2 = 1").alias("early")), "met")
    removed(shared)
    # a partner is at least t times as large, so its need is the least that can be asked for
    smallest = F.ceil(F.col("size") * percent / 100.0 - 1e-9).cast("int")
    able = met.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(reps.select("row", "size"), "row").where(F.col("n") >= shared_need(smallest, percent))
    able = written(able.select("row", "size"), "able")
    band = F.floor(F.log(F.col("size").cast("double")) / -math.log(percent / 100) - 1e-9).cast("int") if percent < 100 else F.col("size")
    part = met.where("early").join(_small(able), "row").select("shingle", "row", "size", F.explode(F.array(band, band + 1)).alias("band"))
    part = written(part, "part")
    removed(met)
    hubs = part.groupBy("shingle", "band").agg(F.min(F.struct("size", "row")).alias("hub"), F.max("row").alias("hi"), F.min("row").alias("lo")).where("lo < hi")
    hubs = written(hubs.select("shingle", "band", F.col("hub.row").alias("hub")), "hubs")
    members = written(part.join(hubs, ["shingle", "band"]).select("hub", F.col("row").alias("node")).distinct(), "members")
    for done in (able, part, hubs):
        removed(done)
    counts = written(members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "counts")
    dealt = members.join(_small(counts), "hub").select(
        "hub", "node", "blocks",
        F.explode(F.when(F.col("hub") == F.col("node"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))).alias("block"),
    )
    dealt = written(dealt, "dealt")
    removed(members)
    removed(counts)
    arrays = sets.select(F.col("row").alias("node"), "shingles")
    rows = arrays.join(_small(dealt.select("hub", "node", "block")), "node").withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    links = written(_linked_in_blocks(rows, ["hub", "block"], percent), "links")
    wide = dealt.where("blocks > 1")
    if wide.isEmpty():
        return links
    label = components(links)
    named = wide.join(label.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "named")
    sizes = named.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.max(F.struct("n", "label")).alias("most"))
    rest = named.join(sizes.select("hub", F.col("most.label").alias("most")), "hub").where("label <> most").select("hub", "node", "label", "blocks").distinct()
    rest = written(rest, "rest")
    if rest.isEmpty():
        return links
    groups = written(rest.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("others")), "groups")
    left = rest.join(groups, "hub").select(
        "hub", "node", "label", F.lit(0).alias("side"), F.pmod(F.xxhash64("node"), F.col("others")).cast("int").alias("other"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    right = named.join(groups, "hub").select("hub", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "block")
    pairs = written(left.unionByName(right), "pairs")
    return links.unionByName(_linked_in_blocks(arrays.join(_small(pairs), "node"), ["hub", "block", "other"], percent))


def jaccard_rows(docs: DataFrame, words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, row, component): documents linked where 100 * intersection >= percent * union.

    row tells rows apart, component their components; both are long.
    """
    sets = _sets(docs, doc_id, text, words)
    some = sets.where("size > 0")
    reps = written(some.groupBy("s1", "s2", "size").agg(F.min("row").alias("row"), F.min("doc_id").alias("smallest")), "classes")
    label = components(_links(sets, reps, percent)).select(F.col("node").alias("row"), "component")
    classes = written(reps.select("s1", "s2", "size", "row", "smallest").join(label, "row", "left").withColumn("component", F.coalesce("component", "row")), "labelled")
    names = written(classes.groupBy("component").agg(F.min("smallest").alias("component_id")), "names")
    final = written(classes.join(names, "component").select("s1", "s2", "size", "component_id", "component"), "named")
    out = some.select("doc_id", "text_hash", "size", "s1", "s2", "row").join(final, ["s1", "s2", "size"])
    cols = ("doc_id", "text_hash", F.col("size").cast("long").alias("n_shingles"), "component_id", "row", "component")
    return out.select(*cols).unionByName(sets.where("size = 0").withColumns({"component_id": F.col("doc_id"), "component": F.col("row")}).select(*cols))


def jaccard_components(docs: DataFrame, words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    return jaccard_rows(docs, words, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id, of repeated rows one.

    Documents do not travel for it: ids and text hashes of what goes are taken out of docs.
    """
    rows = written(jaccard_rows(docs, words, percent, doc_id, text).select("doc_id", "text_hash", "row", "component"), "rows")
    first = written(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("kept")), "first")
    judged = written(rows.join(first, "component").select("doc_id", "text_hash", (F.col("row") == F.col("kept.row")).alias("stays")), "judged")
    gone = written(judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "gone")
    keyed = docs.withColumns({"_id": F.col(f"`{doc_id}`").cast("long"), "_hash": F.xxhash64(text)})

    def same(right: DataFrame):
        return keyed["_id"].eqNullSafe(right["doc_id"]) & (keyed["_hash"] == right["text_hash"])

    side = _small(gone.select("doc_id", "text_hash"))
    out = keyed.join(side, same(side), "left_anti")
    repeated = gone.where("stays").select("doc_id", "text_hash")
    if not repeated.isEmpty():  # of rows that repeat the kept one, one comes back
        side = _small(repeated)
        out = out.unionByName(keyed.join(side, same(side), "left_semi").dropDuplicates(["_id", "_hash"]))
    return out.select(*(f"`{c}`" for c in docs.columns))
