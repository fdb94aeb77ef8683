"""Embedding near-dedup: navigable small-world graphs per shard, every shard searched.

Equal vectors form a class and go on as one. The classes are dealt out by hash to SHARDS
shards, or to more of about SHARD_BYTES where these would be larger; a task builds the
hierarchical graph of a shard. Then each pair of shards meets in a task: the vectors of one
are searched in the graph of the other, and what is found counts for both ends. Rows travel,
not graphs as blocks: a row is a vector with its links, and of each shard goes one copy to
each of its pairs, as one that is searched or one that asks. So searches, and what is
shuffled, are vectors times shards, which is what searching every shard means; while SHARDS
shards suffice both grow as the vectors do. Searches run for many queries in step: the beams
of all of them widen together, as arrays.

A graph's beam width is set by an audit when it is built: sampled vectors of the shard, moved
away to exactly the threshold, have to find the vectors they come from, and the width doubles
until AUDIT_RECALL of them do; at a quarter of the shard the shard is scanned whole instead.
The share found is kept with the result. The same holds for a query whose beam is full of
links: its width doubles until the worst of the beam is no link. Links are verified by cosine
in double precision. Per query the links are counted by the sizes of the classes found; for
the components a task passes on no more edges than its vectors need.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing. Vectors of different length link with nothing. Repeated rows and repeated ids are
vectors of their own; a null id names a component only if no vector in it has another. On a
tie of cosines either vector may come first in a beam, which changes no link. An empty table
gives an empty table. Labels and other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import removed, written
from .components import components

#: Shards at least, and the bytes of vectors in single precision of a larger one.
SHARDS, SHARD_BYTES = 6, 16 << 20
#: Links of a node above the ground and twice as many on it; first beam width; share that audits ask for.
M, BEAM, AUDIT_RECALL, AUDITED = 16, 48, 0.995, 256
#: Queries that are searched in step, and pairs that are verified at once.
STEP, VERIFIED = 512, 1 << 16
#: Queries times vectors of a shard that a search marks at a time; the exact way takes an eighth of it.
CELLS = 32 << 20


class Graph:
    """Unit vectors with their links on each level."""

    def __init__(self, vectors: np.ndarray, threshold: float, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 4)
        order = np.argsort(-level, kind="stable")  # upper nodes first, so that every entry exists
        self.level, self.entry = level, int(order[0]) if n else -1
        self.levels = [np.full((n, 2 * M if l == 0 else M), -1, dtype=np.int32) for l in range(int(level.max(initial=0)) + 1)]
        at = 0
        while at < n:
            size = max(1, min(STEP, at))
            self._insert(order[at : at + size], order[:at], level)
            at += size
        self.beam, self.recall = self._audited(threshold, rng)

    def links(self) -> pa.ListArray:
        """Of each node the links on its levels, from the ground up."""
        starts = np.concatenate([[0], np.cumsum(M * (self.level + 2))]).astype(np.int32)
        flat = np.empty(starts[-1], dtype=np.int32)
        for l, links in enumerate(self.levels):
            own = np.flatnonzero(self.level >= l)
            at = starts[own] + (M * (l + 1) if l else 0)
            flat[at[:, None] + np.arange(links.shape[1])] = links[own]
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))

    @classmethod
    def from_links(cls, vectors: np.ndarray, links: pa.ListArray, beam: int) -> Graph:
        graph = object.__new__(cls)
        flat, starts = links.flatten().to_numpy(), links.offsets.to_numpy() - links.offsets[0].as_py()
        graph.vectors, graph.beam = np.ascontiguousarray(vectors, dtype=np.float32), beam
        graph.level = np.diff(starts) // M - 2
        graph.entry = int(np.argmax(graph.level))
        graph.levels = []
        for l in range(int(graph.level.max()) + 1):
            own, width = np.flatnonzero(graph.level >= l), 2 * M if l == 0 else M
            level = np.full((len(vectors), width), -1, dtype=np.int32)
            level[own] = flat[(starts[own] + (M * (l + 1) if l else 0))[:, None] + np.arange(width)]
            graph.levels.append(level)
        return graph

    def _insert(self, new: np.ndarray, old: np.ndarray, level: np.ndarray) -> None:
        queries = self.vectors[new]
        near = queries @ queries.T
        np.fill_diagonal(near, -2)
        entries = np.full((len(new), 1), self.entry, dtype=np.int32)
        for l in range(len(self.levels) - 1, -1, -1):
            if len(old):
                found, sims = self._layer(queries, entries, l, BEAM)
                entries = found[:, :4]
            else:
                found, sims = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -2.0, np.float32)
            here = np.flatnonzero(level[new] >= l)
            if not len(here):
                continue
            k = min(len(here), 2 * M)
            beside = np.argpartition(-near[np.ix_(here, here)], k - 1, axis=1)[:, :k]
            ids = np.concatenate([found[here], new[here][beside].astype(np.int32)], axis=1)
            s = np.concatenate([sims[here], np.take_along_axis(near[np.ix_(here, here)], beside, 1)], axis=1)
            s = np.where(ids == new[here][:, None], -2, s)
            ids = np.where(s > -1.5, ids, -1)
            self.levels[l][new[here]] = self._diverse(ids, s, self.levels[l].shape[1] // 2 if l == 0 else M, self.levels[l].shape[1])
            self._link_back(new[here], l)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, want: int, width: int) -> np.ndarray:
        """Of each row the nearest ids that are nearer to the node than to one chosen before, then the nearest left."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        repeated = np.zeros(ids.shape, dtype=bool)
        by_id = np.argsort(ids, axis=1, kind="stable")
        ranked = np.take_along_axis(ids, by_id, 1)
        np.put_along_axis(repeated, by_id[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        usable = (ids >= 0) & ~repeated
        vectors = self.vectors[np.maximum(ids, 0)]
        chosen = np.zeros(ids.shape, dtype=bool)
        closest = np.full(ids.shape, -2.0, np.float32)  # to what is chosen
        count = np.zeros(len(ids), dtype=int)
        for c in range(ids.shape[1]):
            take = usable[:, c] & (count < want) & (sims[:, c] > closest[:, c])
            if take.any():
                chosen[:, c] = take
                count += take
                rows = np.flatnonzero(take)
                closest[rows] = np.maximum(closest[rows], np.einsum("ikd,id->ik", vectors[rows], vectors[rows, c]))
        # chosen ones first, then the nearest of the others
        rank = np.where(chosen, 0, np.where(usable, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :width]
        out = np.where(np.take_along_axis(usable, order, 1), np.take_along_axis(ids, order, 1), -1)
        if out.shape[1] < width:
            out = np.concatenate([out, np.full((len(out), width - out.shape[1]), -1, np.int32)], axis=1)
        return out.astype(np.int32)

    def _link_back(self, new: np.ndarray, l: int) -> None:
        links, width = self.levels[l], self.levels[l].shape[1]
        source = np.repeat(new, width)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order].astype(np.int32), target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        if not most:
            return
        added = np.full((len(nodes), most), -1, dtype=np.int32)
        added[np.repeat(np.arange(len(nodes)), count), np.arange(len(source)) - np.repeat(first, count)] = source
        for at in range(0, len(nodes), STEP):
            part = nodes[at : at + STEP]
            ids = np.concatenate([links[part], added[at : at + STEP]], axis=1)
            sims = np.einsum("ikd,id->ik", self.vectors[np.maximum(ids, 0)], self.vectors[part])
            sims = np.where((ids >= 0) & (ids != part[:, None]), sims, -2)
            ids = np.where(sims > -1.5, ids, -1)
            links[part] = self._diverse(ids, sims, width // 2 if l == 0 else width, width)

    def _layer(self, queries: np.ndarray, entries: np.ndarray, l: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best found on a level for each query, best first; -1 fills up."""
        links, n = self.levels[l], len(queries)
        seen = np.zeros((n, len(self.vectors) + 1), dtype=bool)
        seen[:, -1] = True
        rows = np.arange(n)
        ids = np.full((n, beam), -1, dtype=np.int32)
        sims = np.full((n, beam), -3.0, dtype=np.float32)
        done = np.ones((n, beam), dtype=bool)
        fresh = entries
        open_rows = rows
        wide = 4
        while True:
            new = ~seen[open_rows[:, None], fresh]
            fresh = np.where(new, fresh, -1)
            seen[open_rows[:, None], fresh] = True
            s = np.einsum("ikd,id->ik", self.vectors[np.maximum(fresh, 0)], queries[open_rows])
            # one id may come twice in a row
            order = np.argsort(fresh, axis=1, kind="stable")
            ranked = np.take_along_axis(fresh, order, 1)
            twice = np.zeros(fresh.shape, dtype=bool)
            np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            s = np.where((fresh >= 0) & ~twice, s, -3.0)
            all_s = np.concatenate([sims[open_rows], s], axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[open_rows] = np.take_along_axis(all_s, best, 1)
            ids[open_rows] = np.take_along_axis(np.concatenate([ids[open_rows], fresh], axis=1), best, 1)
            done[open_rows] = np.take_along_axis(np.concatenate([done[open_rows], s < -2.5], axis=1), best, 1)
            open_rows = rows[~done.all(axis=1)]
            if not len(open_rows):
                return np.where(sims > -2.5, ids, -1), sims
            pick = np.argsort(done[open_rows], axis=1, kind="stable")[:, :wide]
            real = ~np.take_along_axis(done[open_rows], pick, 1)
            nodes = np.where(real, np.take_along_axis(ids[open_rows], pick, 1), -1)
            done[open_rows[:, None], pick] = True
            fresh = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(open_rows), -1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for l in range(len(self.levels) - 1, 0, -1):
            entries = self._layer(queries, entries, l, 8)[0][:, :4]
        return self._layer(queries, entries, 0, beam)

    def _audited(self, threshold: float, rng) -> tuple[int, float]:
        """Beam width, and the share of the sample that it finds."""
        n, d = self.vectors.shape
        some = rng.choice(n, min(n, AUDITED), replace=False)
        noise = rng.standard_normal((len(some), d)).astype(np.float32)
        own = self.vectors[some]
        noise -= (noise * own).sum(1, keepdims=True) * own
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        moved = (threshold * own + np.sqrt(1 - threshold**2) * noise).astype(np.float32)
        beam = BEAM
        while beam < n // 4:
            found, _ = self.search(moved, beam)
            recall = float((found == some[:, None]).any(1).mean())
            if recall >= AUDIT_RECALL:
                return beam, recall
            beam *= 2
        return n, 1.0

    def near(self, queries: np.ndarray, threshold: float):
        """(query, node) pairs that may reach the threshold; a little below it counts too."""
        least = threshold - 1e-4
        step = max(1, min(STEP, CELLS // len(self.vectors)))
        for at in range(0, len(queries), step):
            part = np.arange(at, min(at + step, len(queries)))
            beam = self.beam
            while len(part):
                if beam >= len(self.vectors) // 4:  # the exact way: all of the shard
                    few = max(1, CELLS // 8 // len(self.vectors))  # each cell may become a pair of numbers
                    for i in range(0, len(part), few):
                        q, node = np.nonzero(queries[part[i : i + few]] @ self.vectors.T >= least)
                        yield part[i : i + few][q], node
                    break
                found, sims = self.search(queries[part], beam)
                full = sims[:, -1] >= least
                q, slot = np.nonzero((sims >= least) & ~full[:, None])
                yield part[q], found[q, slot]
                part, beam = part[full], 2 * beam


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


GRAPHS = "dim int, part int, node long, n long, smallest long, v array<double>, links array<int>, beam int, recall double"


def _graphs(classes: DataFrame, parts: int, threshold: float) -> DataFrame:
    """The classes dealt out by hash to parts, each a row with its links in the part's graph, the beam width and its audited recall."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        graph = Graph(_unit(_matrix(table.column("v"))), threshold)
        return table.append_column("links", graph.links()).append_column("beam", pa.array(np.full(len(table), graph.beam, np.int32))).append_column("recall", pa.array(np.full(len(table), graph.recall)))

    keyed = classes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), "node", "n", "smallest", "v")
    return keyed.repartition(min(2000, 4 * parts), "dim", "part").groupBy("dim", "part").applyInArrow(build, GRAPHS)


def _searched(graphs: DataFrame, parts: int, threshold: float) -> DataFrame:
    """From each pair of parts: rows (a, null, links of a) and edges (a, b, null)."""

    def search(key, shard: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(shard) or not len(asking):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        shard, same = shard.sort_by("node"), key[1].as_py() == key[2].as_py()
        ids, sizes, vectors = shard.column("node").to_numpy(), shard.column("n").to_numpy(), _matrix(shard.column("v"))
        own, own_sizes, queries = asking.column("node").to_numpy(), asking.column("n").to_numpy(), _matrix(asking.column("v"))
        graph = Graph.from_links(_unit(vectors), shard.column("links").combine_chunks(), shard.column("beam")[0].as_py())
        lengths, q_lengths = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
        links, back = np.zeros(len(own), np.int64), np.zeros(len(ids), np.int64)
        edges: dict[int, int] = {}
        for every_q, every_node in graph.near(_unit(queries).astype(np.float32), threshold):
            for at in range(0, len(every_q), VERIFIED):
                q, node = every_q[at : at + VERIFIED], every_node[at : at + VERIFIED]
                cosine = np.einsum("id,id->i", queries[q], vectors[node]) / (q_lengths[q] * lengths[node])
                true = (cosine >= threshold) & (own[q] != ids[node])
                q, node = q[true], node[true]
                np.add.at(links, q, sizes[node])
                if not same:
                    np.add.at(back, node, own_sizes[q])
                _join(edges, own[q].tolist(), ids[node].tolist())
        some, met = np.flatnonzero(links), np.flatnonzero(back)
        counted = len(some) + len(met)
        a = [*own[some].tolist(), *ids[met].tolist(), *edges]
        b = [*[None] * counted, *(_root(edges, x) for x in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*links[some].tolist(), *back[met].tolist(), *[None] * len(edges)], pa.int64())})

    keys, deal = ["dim", "part", "other"], min(4000, 3 * parts * (parts + 1) // 2)
    searched = graphs.select("dim", "part", F.explode(F.sequence("part", F.lit(parts - 1))).alias("other"), "node", "n", "v", "links", "beam")
    asking = graphs.select("dim", F.explode(F.sequence(F.lit(0), "part")).alias("asked"), F.col("part").alias("other"), "node", "n", "v").withColumnRenamed("asked", "part")
    dealt = [x.repartition(deal, *keys).groupBy(*keys) for x in (searched, asking)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(search, "a long, b long, n long")


def _root(up: dict[int, int], x: int) -> int:
    while up.get(x, x) != x:
        x = up[x]
    return x


def _join(up: dict[int, int], a: list[int], b: list[int]) -> None:
    for x, y in zip(a, b, strict=True):
        x, y = _root(up, x), _root(up, y)
        if x != y:
            up[max(x, y)] = min(x, y)


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of each vector; recall is what the audit of its shard found, null if it links with nothing by rule."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = written(embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(fine, v).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    some = rows.where("v is not null")
    classes = written(some.groupBy("v").agg(F.min("row").alias("node"), F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("n")), "classes")
    numbers = classes.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    parts = max(SHARDS, -(-4 * numbers // SHARD_BYTES))
    graphs = written(_graphs(classes, parts, threshold), "graphs")
    removed(classes)
    found = written(_searched(graphs, parts, threshold), "found")
    label = components(found.where("b is not null")).select("node", "component")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    joined = written(graphs.select("v", "node", "n", "smallest", "recall").join(label, "node", "left").join(links, "node", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), "smallest", "recall"), "joined")
    removed(graphs)
    removed(found)
    names = written(joined.groupBy("component").agg(F.min("smallest").alias("component_id")), "names")
    final = written(joined.join(names, "component").select("v", "n_links", "component_id", "recall"), "named")
    removed(joined)
    removed(names)
    out = some.join(final, "v").select("vec_id", "n_links", "component_id", "recall")
    out = out.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")
