"""Conversation structure repair: cheapest edits by dynamic programming, the least of them by prefix-doubling path ranking.

The rows of a conversation, in the order of turn, role and digest of the text, are read by an
automaton whose states are start, after system, after user and after assistant; it accepts nothing,
or an optional system row and then pairs of user and assistant. Each row is kept, given the role
that is due or deleted; empty rows of the role that is due may be inserted between. The costs to
the end give the optimal arcs of the graph of (row, state). Of all cheapest ways the one is taken
whose audit, the initials of its edits, sorts first: arcs are ranked by their initial, then by
pairs of ranks over audits of 2, 4, 8 ... initials, each pair reached by a pointer that doubles;
the least arc of each node is the one with the least rank, and the way is written out by the
doubled pointers.

A conversation of any length is cut into segments of SEGMENT rows. What a segment costs from each
state to each other is a matrix of four by four, and what follows it a vector; where more than one
segment makes a conversation, those are combined by conversation, a row each segment. Rows are put
in order in ranges, so a long conversation spreads over many tasks; texts travel once, to the
digest. A SHA-256 can only be taken in order: one task streams a conversation's repaired lines and
holds a batch of them.

Cases: a null role or text is one space. A null conv_id is a conversation like others; null turns
come first. Rows of equal turn are ordered by role, then by the digest of their text; repeated
rows are rows. A conversation without rows needs no repair. An empty table gives an empty table.
Only the named columns are read, so others may have any names. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.ranges import in_ranges, sum_before, with_earlier, within
from .common import written

#: Rows of a segment.
SEGMENT = 4096
#: Rows times segments that are solved together.
TOGETHER = 100_000

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Per state: the state after the role that is due, and after keeping a row whose initial is s, u, a or another.
DUE = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Per state: what is missing at the end of a conversation.
MISSING = ("", "ua", "a", "")
END = np.array([INSERT * len(m) for m in MISSING], dtype=np.int64)
_FAR = 1 << 40


class Graph:
    """Segments side by side: (row, state) nodes, and the costs from each to the end of its segment and on.

    codes: a letter each row, its initial (s, u, a, o) times its fault (none, cut, must go).
    after: four costs a segment, of what follows it.
    """

    def __init__(self, codes: list[str], after: np.ndarray):
        self.sizes = np.array([len(c) for c in codes])
        self.base = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # a last row each, where a segment ends
        code = np.frombuffer("".join(c + "a" for c in codes).encode(), dtype=np.uint8) - ord("a")
        self.initial, fault = code // 3, code % 3
        self.cut, self.must = np.where(fault == 1, CUT, 0), fault == 2
        self.cost = np.full((len(code), 4), _FAR, dtype=np.int64)
        self.cost[self.base[1:] - 1] = after
        order = np.argsort(-self.sizes, kind="stable")
        ends, sizes = self.base[order + 1] - 1, self.sizes[order]
        for step in range(1, int(self.sizes.max()) + 1):
            rows = ends[: np.searchsorted(-sizes, -step, side="right")] - step
            self.cost[rows] = self._inserted(self._stepped(rows).min(axis=0))

    def _stepped(self, rows: np.ndarray) -> np.ndarray:
        """Costs by letter, row and state of deleting, keeping and giving a role."""
        then, cut, must = self.cost[rows + 1], self.cut[rows, None], self.must[rows, None]
        kept = KEPT[self.initial[rows]]
        keep = np.where((kept < 0) | must, _FAR, KEEP + cut + np.take_along_axis(then, np.maximum(kept, 0), axis=1))
        return np.minimum(np.stack([DELETE + then, keep, np.where(must, _FAR, REROLE + cut + then[:, DUE])]), _FAR)

    @staticmethod
    def _inserted(cost: np.ndarray) -> np.ndarray:
        """Costs where rows may be inserted first."""
        user, assistant = np.minimum(cost[:, USER], INSERT + cost[:, ASSISTANT]), np.minimum(cost[:, ASSISTANT], INSERT + cost[:, USER])
        return np.stack([np.minimum(cost[:, START], INSERT + user), np.minimum(cost[:, SYSTEM], INSERT + user), user, assistant], axis=1)

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letter, node and target of each arc of a cheapest way; a node is four times its row plus its state."""
        rows = np.delete(np.arange(len(self.cost)), self.base[1:] - 1)
        delete, keep, rerole = self._stepped(rows)
        here, state = self.cost[rows], np.arange(4)
        node = 4 * rows[:, None] + state
        targets = (node + 4, 4 * rows[:, None] + DUE, 4 * (rows[:, None] + 1) + KEPT[self.initial[rows]], 4 * (rows[:, None] + 1) + DUE)
        letters, nodes, ends = [], [], []
        for letter, (cost, target) in enumerate(zip((delete, INSERT + here[:, DUE], keep, rerole), targets, strict=True)):
            good = (cost == here) & (here < _FAR)
            letters.append(np.full(int(good.sum()), letter))
            nodes.append(node[good])
            ends.append(np.broadcast_to(target, good.shape)[good])
        return np.concatenate(letters), np.concatenate(nodes), np.concatenate(ends)

    def ways(self, entries: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """The least cheapest way of each segment from its entry state: (letter, row of the segment, state reached)."""
        letter, node, target = self.arcs()
        none = len(letter)  # stands for the end, which sorts before any letter
        ends = np.append(target, 0)

        def least(rank: np.ndarray) -> np.ndarray:
            """Of each node, the arc with the least rank."""
            first = np.full(4 * len(self.cost), none)
            order = np.lexsort((rank[:none], node))
            at, where = np.unique(node[order], return_index=True)
            first[at] = order[where]
            return first

        def follow(first: np.ndarray) -> np.ndarray:
            return np.append(first[target], none)

        rank = np.append(letter + 1, 0)
        pointer = follow(least(rank))
        while (pointer != none).any():  # ranks of audits of a length become ranks of twice the length
            pairs = rank * (none + 2) + rank[pointer]
            rank = np.unique(pairs, return_inverse=True)[1]
            pointer = pointer[pointer]
        first = least(rank)
        pointer, path = follow(first), first[4 * self.base[:-1] + entries][:, None]
        while (path[:, -1] != none).any():  # each round writes as much of a way as there is
            path, pointer = np.concatenate([path, pointer[path]], axis=1), pointer[pointer]
        out = []
        for j, own in enumerate(path):
            own = own[own != none]
            out.append(list(zip(letter[own].tolist(), (node[own] // 4 - self.base[j]).tolist(), (ends[own] % 4).tolist(), strict=True)))
        return out


def _batches(codes: list[str]):
    """Places of codes, like lengths together."""
    order, start = sorted(range(len(codes)), key=lambda i: len(codes[i])), 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * len(codes[order[i]]) > TOGETHER:
            yield order[start:i]
            start = i


def matrices(codes: list[str]) -> list[np.ndarray]:
    """What each segment costs from a state to a state."""
    out = [np.empty(0)] * len(codes)
    for own in _batches(codes):
        columns = []
        for state in range(4):
            after = np.full((len(own), 4), _FAR, dtype=np.int64)
            after[:, state] = 0
            g = Graph([codes[i] for i in own], after)
            columns.append(g.cost[g.base[:-1]])
        for place, m in zip(own, np.minimum(np.stack(columns, axis=2), _FAR), strict=True):
            out[place] = m
    return out


def exits(codes: list[str], after: np.ndarray) -> np.ndarray:
    """The state that each segment leaves in, for each state it is entered in."""
    out = np.zeros((len(codes), 4), dtype=np.int64)
    for own in _batches(codes):
        g = Graph([codes[i] for i in own], after[own])
        for state in range(4):
            out[own, state] = [way[-1][2] for way in g.ways(np.full(len(own), state))]
    return out


def edits(codes: list[str], after: np.ndarray, entries: np.ndarray, last: np.ndarray) -> list[list[str]]:
    """A text each row: initials of rows inserted before it, K, D or R and the new initial, initials of rows inserted after it."""
    out: list[list[str]] = [[]] * len(codes)
    for own in _batches(codes):
        for place, way in zip(own, Graph([codes[i] for i in own], after[own]).ways(entries[own]), strict=True):
            texts = [""] * len(codes[place])
            for letter, row, state in way:
                texts[row] += ("D", "", "K", "R")[letter] + ("", "sua"[state - 1], "", "sua"[state - 1])[letter]
            texts[-1] += MISSING[way[-1][2]] if last[place] else ""
            out[place] = texts
    return out


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, the place of each row in its conversation and its fault: blank, duplicate, truncated or null.

    rows: conv_id, turn, role, text. As a table in the shared folder; its rows have numbers of their own (tie).
    """
    text = F.coalesce("text", F.lit(" "))
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    shown = F.expr(r"trim(TRAILING '\t\n\u000B\f\r ' FROM text)")
    plain = plain.withColumns({"mark": F.sha2("text", 256), "blank": shown == "", "cut": ~F.right(shown, F.lit(1)).isin(".", "!", "?")})
    keys = ["turn", "role", "mark", "tie"]
    return in_ranges(plain, ["conv_id"], keys)


def placed(ordered: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, place from 0 and fault of rows of in_order; texts stay behind."""
    narrow = with_earlier(ordered.drop("text"), ["conv_id"], F.count(F.lit(1)), before=sum_before)
    place = F.col("before") + F.row_number().over(within(["conv_id"]).orderBy("turn", "role", "mark", "tie")) - 1
    narrow = written(narrow.select("conv_id", "turn", "role", "mark", "tie", "blank", "cut", place.alias("place")), "placed")
    first = narrow.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("mark").alias("_m"), "first")
    same = narrow["conv_id"].eqNullSafe(first["_c"]) & (narrow["role"] == first["_r"]) & (narrow["mark"] == first["_m"])
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("place"), "duplicate").when(F.col("cut"), "truncated")
    return narrow.join(first, same, "left").select("conv_id", "turn", "role", "tie", "place", fault.alias("fault"))


def _code(role: Column, fault: Column) -> Column:
    initial = F.coalesce(F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2), F.lit(3))
    return F.substring(F.lit("abcdefghijkl"), initial * 3 + F.when(fault.isin("blank", "duplicate"), 2).when(fault == "truncated", 1).otherwise(0) + 1, F.lit(1))


def _illegal(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = ["suao"[(ord(c) - 97) // 3] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _struct(schema: T.StructType, *more: str) -> T.StructType:
    """The field conv_id of a schema, and more fields."""
    return T.StructType([schema["conv_id"], *T.StructType.fromDDL(", ".join(more)).fields])


def _after(segments: DataFrame) -> DataFrame:
    """Adds, to the segments of conversations that have several, what follows costs (after) and the state of entry (entry)."""
    schema = segments.schema

    def costs(frames):
        for f in frames:
            yield f[["conv_id", "segment"]].assign(matrix=[m.ravel() for m in matrices(list(f["codes"]))])

    def backward(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("segment")
        then, out = END, []
        for m in reversed(list(f["matrix"])):
            out.append(then)
            then = (np.asarray(m).reshape(4, 4) + then).min(axis=1)
        return f[["conv_id", "segment"]].assign(after=out[::-1])

    def leaving(frames):
        for f in frames:
            yield f[["conv_id", "segment"]].assign(leave=list(exits(list(f["codes"]), np.array(list(f["after"]), dtype=np.int64).reshape(-1, 4))))

    def forward(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("segment")
        state, out = START, []
        for leave in f["leave"]:
            out.append(state)
            state = int(leave[state])
        return f[["conv_id", "segment"]].assign(entry=out)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({"conv_id": "_c", "segment": "_s"})
        return a.join(b, a["conv_id"].eqNullSafe(b["_c"]) & (a["segment"] == b["_s"])).drop("_c", "_s")

    made = segments.select("conv_id", "segment", "codes").mapInPandas(costs, _struct(schema, "segment long", "matrix array<long>"))
    after = written(made.groupBy("conv_id").applyInPandas(backward, _struct(schema, "segment long", "after array<long>")), "after")
    known = joined(segments, after)
    left = known.select("conv_id", "segment", "codes", "after").mapInPandas(leaving, _struct(schema, "segment long", "leave array<long>"))
    entry = written(left.groupBy("conv_id").applyInPandas(forward, _struct(schema, "segment long", "entry long")), "entry")
    return joined(known, entry)


def edited(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, last, ties, edits, illegal): what is done to each row of each segment; rows as placed gives them.

    edits has a text each row, see edits(); illegal counts neighbours within the segment and with the row before it.
    """
    code = F.struct("place", _code(F.col("role"), F.col("fault")).alias("code"), "tie")
    cut = rows.groupBy("conv_id", F.expr(f"place div {SEGMENT}").alias("segment")).agg(F.array_sort(F.collect_list(code)).alias("rows"))
    own = W.partitionBy("conv_id")
    cut = cut.select("conv_id", "segment", F.array_join("rows.code", "").alias("codes"), F.col("rows.tie").alias("ties"), F.max("segment").over(own).alias("top"))
    before = F.when(F.col("top") > 0, F.right(F.lag("codes").over(own.orderBy("segment")), F.lit(1)))
    cut = written(cut.withColumn("before", F.coalesce(before, F.lit(""))), "segments")
    single = cut.where("top = 0").withColumns({"after": F.array(*(F.lit(int(c)).cast("long") for c in END)), "entry": F.lit(START).cast("long")})
    every = single.unionByName(_after(cut.where("top > 0")))

    def run(frames):
        for f in frames:
            last = (f["segment"] == f["top"]).to_numpy()
            texts = edits(list(f["codes"]), np.array(list(f["after"]), dtype=np.int64).reshape(-1, 4), f["entry"].to_numpy(), last) if len(f) else []
            illegal = [_illegal(b + c) for b, c in zip(f["before"], f["codes"], strict=True)]
            yield f[["conv_id", "segment", "ties"]].assign(edits=texts, illegal=illegal)

    return written(every.mapInPandas(run, _struct(cut.schema, "segment long", "ties array<long>", "edits array<string>", "illegal long")), "edited")


#: Parts of a row's text of edits.
_PARTS = "^([ua]*)(K|D|R[ua])([ua]*)$"


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations and what was found; rows: conv_id, turn, role, text.

    Lines: conv_id, place, audit (initials of the edits at this row) and lines, the rows that come
    out of it as role and text. Findings: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    """
    ordered = in_order(rows)
    places = written(placed(ordered), "faults")
    done = edited(places)
    each = done.select("conv_id", F.explode(F.arrays_zip("ties", "edits")).alias("x")).select("conv_id", F.col("x.ties").alias("tie"), F.col("x.edits").alias("edit"))

    def inserted(initials: Column) -> Column:
        role = lambda c: F.when(c == "u", "user").otherwise("assistant")
        return F.transform(F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: F.struct(role(c).alias("role"), F.lit("").alias("text")))

    part = lambda i: F.regexp_extract("edit", _PARTS, i)
    own = F.when(part(2) == "K", F.col("role")).when(part(2) == "Ru", "user").when(part(2) == "Ra", "assistant")
    stays = F.when(own.isNotNull(), F.array(F.struct(own.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    audit = F.translate(F.regexp_replace("edit", "R[ua]", "R"), "ua", "II")
    lines = F.concat(inserted(part(1)), stays, inserted(part(3)))
    out = each.join(ordered.select("tie", "role", "text"), "tie").join(places.select("tie", "place"), "tie").select("conv_id", "place", audit.alias("audit"), lines.alias("lines"))

    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    turns = (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long")
    found = places.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    charge = F.length(part(1)) * INSERT + F.length(part(3)) * INSERT + F.when(part(2) == "K", KEEP).when(part(2) == "D", DELETE).otherwise(REROLE)
    charge = charge + F.when((F.col("fault") == "truncated") & (part(2) != "D"), CUT).otherwise(0)
    charged = each.join(places.select("tie", "fault"), "tie").groupBy("conv_id").agg(F.sum(charge).cast("long").alias("cost"))
    odd = done.groupBy("conv_id").agg(F.sum("illegal").cast("long").alias("illegal"))
    for more in (odd, charged):
        more = more.withColumnRenamed("conv_id", "_c")
        found = found.join(more, found["conv_id"].eqNullSafe(more["_c"])).drop("_c")
    return out, found


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the edits' initials, and the digest of role:text of all lines, newline-joined.

    A task streams its conversations in order and holds one audit.
    """
    schema = _struct(lines.schema, "audit string", "repaired_sha256 string")
    texts = lines.select("conv_id", "place", "audit", F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])).alias("lines"))

    def run(batches):
        open_, key, audit, hashed, count, kind = False, None, [], None, 0, None
        for batch in batches:
            kind, rows = batch.schema.field("conv_id").type, []
            for conv_id, piece, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines")), strict=True):
                if not open_ or conv_id != key:
                    if open_:
                        rows.append((key, "".join(audit), hashed.hexdigest()))
                    open_, key, audit, hashed, count = True, conv_id, [], hashlib.sha256(), 0
                audit.append(piece)
                for line in own:
                    hashed.update((b"\n" if count else b"") + line.encode())
                    count += 1
            yield _record(rows, kind)
        if open_:
            yield _record([(key, "".join(audit), hashed.hexdigest())], kind)

    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "audit", "lines").mapInArrow(run, schema)


def _record(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, audits, hashes = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(hashes, pa.string())], names=["conv_id", "audit", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """rows of conv_id, turn, role, text with faults put in by the checksum of conv_id and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return plain.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_digests(rows: DataFrame, original: DataFrame) -> DataFrame:
    """A row for each conv_id of original: COUNTS, audit and repaired_sha256 of the repair of rows."""
    lines, found = repaired(rows)
    made = digests(lines).withColumnRenamed("conv_id", "_d")
    both = found.join(made, found["conv_id"].eqNullSafe(made["_d"])).drop("_d").withColumnRenamed("conv_id", "_c")
    ids = original.select("conv_id").distinct()
    out = ids.join(both, ids["conv_id"].eqNullSafe(both["_c"]), "left")
    zeros = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS)
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
