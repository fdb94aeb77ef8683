"""Ranked lexical search: exact inner products by sparse ball trees, opened best first.

A document is the sparse vector of what each term it holds would add to a score: weight * share,
both whole numbers (see weight and share). An item is the set of its terms, and a document's score
the sum of its vector over that set. Tasks cut their documents into trees of at most TREE vectors:
a node is halved at the median of the difference of distances to two far vectors, down to LEAF
vectors. Each node has its centroid and its radius. Over the item's terms that occur below a node,
a score is at most the centroid's own plus radius times the length of the item's vector there.
Axes are stretched by one over the root of the terms' weights, which makes both factors of that
bound small. Radii and bounds are rounded up, so floating point never hides a document. An item
opens the node with the highest bound first, adds whole numbers at the leaves, and stops when no
bound reaches the worst of the best documents so far. The best of a task stay the bar for its next
trees. Only the best documents of a task travel.

Terms are counted over all documents. Items are dealt to blocks of about BLOCK_BYTES bytes of
terms, whose terms are broadcast; each further block is another pass over the documents. Between
the passes, a table holds each document's length and the counts of the block's terms.

Cases: null and empty texts hold no term; a document without terms is not counted and never found,
an item without terms, or whose terms no document holds, has no rows. A term counts once for an
item however often the item repeats it. Rows that share an item_id, null included, are one item
with the terms of all. Repeated document rows are documents of their own, with ranks of their own.
Equal scores are ranked by ascending doc_id, null last. Empty tables give an empty result. Only
the named columns are read, so others may have any names. Texts are read whole, in pieces of 4 MB
that end between terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import ascii_lower, chunks, removed, written

#: A term: as many of these characters as follow each other; A-Z are lower-cased before.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Vectors of a tree and of a leaf, entries of a tree.
TREE, LEAF, ENTRIES = 4096, 16, 1_000_000
#: Bytes of terms of the items that are searched in one pass, on average.
BLOCK_BYTES = 4 << 20

_PIECE = 4 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def weight(documents: int, holding: int) -> int:
    """Of a term that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def share(tf: np.ndarray, length: int, documents: int, total: int) -> np.ndarray:
    """Of terms that occur tf times in a document of length terms; all documents hold total terms."""
    m = 50 + 50 * length * documents // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def term_counts(text: str | None, known: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """Number of terms, and the numbers and counts of the known ones."""
    data, start, n, found = (text or "").encode(), 0, 0, Counter()
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and _TABLE[data[end]] != 32:
            end += 1
        words = data[start:end].translate(_TABLE).split()
        n += len(words)
        found.update(known[w] for w in words if w in known)
        start = end
    at = sorted(found)
    return n, at, [found[i] for i in at]


class Tree:
    """A ball tree over sparse vectors: terms and values of row i lie at starts[i] to starts[i + 1]."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.used, terms = np.unique(terms, return_inverse=True)  # the tree's own numbers of terms
        self.mass = np.maximum(weights[self.used], 1).astype(np.float64)
        stretched = values / np.sqrt(self.mass)[terms]
        squares = np.add.reduceat(stretched * stretched, starts[:-1])
        self.order = np.arange(len(starts) - 1)
        self.first, self.last, self.left, self.radius = [], [], [], []
        nodes, axes, centres = [], [], []
        todo = [(0, len(self.order))]
        for number, (low, high) in enumerate(todo):  # grows as nodes are halved
            rows = self.order[low:high]
            sizes = starts[rows + 1] - starts[rows]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - sizes), sizes)
            own, x, cuts = terms[at], stretched[at], ends - sizes
            centre = np.bincount(own, weights=x, minlength=len(self.used)) / len(rows)
            support = np.flatnonzero(centre)

            def away(point: np.ndarray, square: float, own=own, x=x, cuts=cuts, rows=rows) -> np.ndarray:
                """Squared distances of the node's rows from a point."""
                return squares[rows] - 2 * np.add.reduceat(x * point[own], cuts) + square

            size = float(centre @ centre)
            far = away(centre, size)
            self.radius.append(math.sqrt(max(float(far.max()), 0.0) + 1e-9 * (float(squares[rows].max()) + size)))
            self.first.append(low)
            self.last.append(high)
            nodes.append(np.full(len(support), number))
            axes.append(support)
            centres.append(centre[support])
            if high - low <= LEAF:
                self.left.append(-1)
                continue

            def vector(i: int, own=own, x=x, cuts=cuts, sizes=sizes) -> np.ndarray:
                out = np.zeros(len(self.used))
                out[own[cuts[i] : cuts[i] + sizes[i]]] = x[cuts[i] : cuts[i] + sizes[i]]
                return out

            one = int(far.argmax())
            from_one = away(vector(one), squares[rows[one]])
            other = int(from_one.argmax())
            middle = (high - low) // 2
            self.order[low:high] = rows[np.argsort(from_one - away(vector(other), squares[rows[other]]), kind="stable")]
            self.left.append(len(todo))
            todo += [(low, low + middle), (low + middle, high)]
        # the centroids by term: which nodes hold it, and where they lie on its axis
        nodes, axes, centres = np.concatenate(nodes), np.concatenate(axes), np.concatenate(centres)
        by_term = np.argsort(axes, kind="stable")
        self.nodes, self.centres = nodes[by_term], centres[by_term]
        self.postings = np.searchsorted(axes[by_term], np.arange(len(self.used) + 1))
        sizes = (starts[1:] - starts[:-1])[self.order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(self.starts[-1]) + np.repeat(starts[self.order] - self.starts[:-1], sizes)
        self.terms, self.values = terms[at], values[at]

    def bounds(self, own: np.ndarray) -> np.ndarray:
        """Of each node, what a score over the terms own is at most, rounded up."""
        spans = [slice(self.postings[t], self.postings[t + 1]) for t in own]
        nodes = np.concatenate([self.nodes[s] for s in spans])
        mass = np.concatenate([np.full(s.stop - s.start, self.mass[t]) for t, s in zip(own, spans, strict=True)])
        dots = np.bincount(nodes, weights=np.concatenate([self.centres[s] for s in spans]) * np.sqrt(mass), minlength=len(self.radius))
        return (dots + np.sqrt(np.bincount(nodes, weights=mass, minlength=len(self.radius))) * self.radius) * (1 + 1e-9) + 1

    def search(self, asked: np.ndarray, best: Best) -> int:
        """Offers every row that may be among the best for the terms asked, in ascending order; the number of leaves opened."""
        own = np.searchsorted(self.used, asked)
        own = own[(own < len(self.used)) & (self.used[np.minimum(own, len(self.used) - 1)] == asked)]
        if not len(own):
            return 0
        bounds, wanted, opened = self.bounds(own), np.zeros(len(self.used), dtype=bool), 0
        wanted[own] = True
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.bar:
                break
            left = self.left[node]
            if left >= 0:
                for child in (left, left + 1):
                    if bounds[child] >= best.bar and bounds[child] > 1:  # 1 is rounding alone: no term occurs below
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            opened += 1
            low, high = self.first[node], self.last[node]
            part = slice(self.starts[low], self.starts[high])
            scores = np.add.reduceat(np.where(wanted[self.terms[part]], self.values[part], 0), self.starts[low:high] - self.starts[low])
            for i in np.flatnonzero((scores > 0) & (scores >= best.bar)):
                best.offer(int(scores[i]), int(self.order[low + i]))
            best.settle()
        return opened


class Best:
    """The best documents of an item: highest scores first, equal ones by id, null ids last."""

    def __init__(self, top: int):
        self.top, self.rows, self.bar, self.ids = top, [], 1, None

    def offer(self, score: int, row: int) -> None:
        self.rows.append((score, self.ids[row]))

    def settle(self) -> None:
        if len(self.rows) > self.top:
            self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
            del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.bar = min(r[0] for r in self.rows)


@dataclass(frozen=True)
class Block:
    """Items by the numbers of their terms, ascending; weights by the number of a term."""

    items: list[np.ndarray]
    weights: np.ndarray
    documents: int
    total: int


def _counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                n, at, tf = zip(*(term_counts(t, shared.value) for t in batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), (), ())
                numbers = [pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], names=["doc_id", "n", "at", "tf"])

    return docs.mapInArrow(run, schema)


def _trees(batches, block: Block):
    """(ids, Tree) over runs of at most TREE documents and about ENTRIES entries."""
    ids, parts, sizes, lengths, held = [], [], [], [], 0

    def tree():
        at, tf = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        shares = np.concatenate([share(tf[a:b], n, block.documents, block.total) for a, b, n in zip(starts[:-1], starts[1:], lengths, strict=True)])
        return list(ids), Tree(starts, at, block.weights[at] * shares, block.weights)

    for batch in batches:
        at, tf = batch.column("at"), batch.column("tf")
        for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            terms = at[i].values.to_numpy()
            if not len(terms):
                continue
            if ids and (len(ids) == TREE or held + len(terms) > ENTRIES):
                yield tree()
                for kept in (ids, parts, sizes, lengths):
                    kept.clear()
                held = 0
            ids.append(doc_id)
            parts.append((terms, tf[i].values.to_numpy().astype(np.int64)))
            sizes.append(len(terms))
            lengths.append(n)
            held += len(terms)
    if ids:
        yield tree()


def _searched(counted: DataFrame, block: Block, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for each item of the block."""
    shared = counted.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("item", T.IntegerType()), counted.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches):
        block, kind = shared.value, None
        best = [Best(top) for _ in block.items]

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        for ids, tree in _trees(seen(), block):
            for terms, b in zip(block.items, best, strict=True):
                b.ids = ids
                tree.search(terms, b)
        rows = [(i, doc_id, score) for i, b in enumerate(best) for score, doc_id in b.rows]
        if rows:
            items, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, schema)


def _asked(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, terms, block) of each item that has terms, and the number of blocks."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({TERM})")))
    asked = items.select("item_id", F.explode(terms).alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    asked = written(asked, "asked")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    return asked.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks))), blocks


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item, rank from 1."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    asked, blocks = _asked(items)
    found, documents, total = None, 0, 0
    for number in range(blocks):  # one, unless the items' terms take several megabytes
        own = asked.where(F.col("block") == number).select("item_id", "terms").collect()  # about BLOCK_BYTES
        known = {t: i for i, t in enumerate(sorted({t.encode() for r in own for t in r["terms"]}))}
        counted = written(_counted(docs, known), "counted")
        if not number:
            documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.full(len(known), weight(documents, 0), dtype=np.int64)
        for r in counted.select(F.explode("at").alias("term")).groupBy("term").count().collect():  # as many rows as the block has terms
            weights[r["term"]] = weight(documents, r["count"])
        block = Block([np.array(sorted(known[t.encode()] for t in r["terms"]), dtype=np.int64) for r in own], weights, documents, total)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
        best = written(_searched(counted, block, top).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), "best")
        removed(counted)
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the tasks' best meet in parts first, so that no task ranks what all tasks send for an item
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(32))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
