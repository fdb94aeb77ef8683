import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations as C
from ledgerloom.llm.queries import op13_conversation_repair

SF = "/root/testdata/sf0.01"
SHAPE = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def harm(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def faults(rows):
    """Rows in order, each with its fault."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
    out, seen = [], set()
    for _, _, role, text in rows:
        shown = text.strip("\t\n\v\f\r ")
        out.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return rows, out


def least(rows):
    """(cost, audit, lines) of the least way, one row after the other from the end."""
    due = ("user", "user", "assistant", "user")
    after = {"user": 2, "assistant": 3}
    best = [(0, "", []), (4, "II", ["user:", "assistant:"]), (2, "I", ["assistant:"]), (0, "", [])]

    def add(cost, letter, lines, then):
        return (cost + then[0], letter + then[1], lines + then[2])

    for role, text, fault in reversed(rows):
        now = []
        for s in range(4):
            ways = [add(3, "D", [], best[s])]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                if to:
                    ways.append(add(cut, "K", [f"{role}:{text}"], best[to]))
                ways.append(add(2 + cut, "R", [f"{due[s]}:{text}"], best[after[due[s]]]))
            now.append(min(ways, key=lambda w: w[:2]))
        for _ in range(3):
            now = [min(now[s], add(2, "I", [f"{due[s]}:"], now[after[due[s]]]), key=lambda w: w[:2]) for s in range(4)]
        best = now
    return best[0]


def by_hand(rows, ids):
    out = {}
    for c in ids:
        own, judged = faults([r for r in rows if r[0] == c])
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, lines = least(judged)
        count = [sum(f == x for *_, f in judged) for x in ("blank", "duplicate", "truncated")]
        odd = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, odd, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(df):
    return {r["conv_id"]: (*(r[c] for c in C.COUNTS), r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_query_as_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(op13_conversation_repair(spark, SF))
    assert got == by_hand(harm(rows), {r[0] for r in rows})
    assert {x for v in got.values() for x in v[6]} == set("DIKR")


def test_least_of_all_scripts():
    """Every script of up to two rows inserted anywhere, tried one by one."""
    r = random.Random(11)
    inserts = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    for _ in range(25):
        n = r.randrange(1, 4)
        rows = [(r.choice(["system", "user", "assistant", "tool"]), f"t{i}", r.choice(["", "", "", "truncated", "blank"])) for i in range(n)]
        best = None
        for gaps in itertools.product(inserts, repeat=n + 1):
            for ops in itertools.product(["K", "Ru", "Ra", "D"], repeat=n):
                cost, audit, shape = 2 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
                for (role, _, fault), op, gap in zip(rows, ops, gaps[1:], strict=True):
                    if op != "D" and fault == "blank":
                        cost = 10**6
                    cost += {"K": 0, "R": 2, "D": 3}[op[0]] + (fault == "truncated" and op != "D") + 2 * len(gap)
                    audit += op[0] + "I" * len(gap)
                    shape += {"K": role[0], "D": ""}.get(op, op[-1]) + gap
                if SHAPE.fullmatch(shape) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert least(rows)[:2] == best
        code = "".join("abcdefghijkl"[3 * "sua".find(x[0]) % 12 + {"": 0, "truncated": 1, "blank": 2}[f]] if x[0] in "sua" else "jkl"[{"": 0, "truncated": 1, "blank": 2}[f]] for x, _, f in rows)
        made = C.edits([code], C.END[None], np.array([0]), np.array([True]))[0]
        assert "".join(re.sub("[ua]", "I", re.sub("R[ua]", "R", x)) for x in made) == best[1]


def test_segments_as_whole(spark, monkeypatch):
    """A long conversation in short segments, beside short ones."""
    r = random.Random(5)
    text = lambda: r.choice(["Yes.", "No", "why?", " ", f"w{r.randrange(400)}!", f"x{r.randrange(50)}"])
    rows = [(1, i // 2, r.choice(["user", "assistant", "system", "tool"]), text()) for i in range(300)]
    rows += [(c, t, r.choice(["user", "assistant"]), text()) for c in range(2, 40) for t in range(r.randrange(1, 9))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_hand(rows, {x[0] for x in rows})
    assert rows_of(C.repair_digests(frame, frame)) == want
    monkeypatch.setattr(C, "SEGMENT", 7)
    assert rows_of(C.repair_digests(frame, frame)) == want


def test_cases(spark):
    """Nulls in every column, repeats, one conversation without rows after damage, clashing names, a long text."""
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, None, "user", "Hi."), (5, None, "assistant", None), (5, 2, "", "\t \n"), (5, 2, None, "Ok!"), (6, 1, "user", "a" * 3_000_000)]
    rows += [(7, 1, "user", "Same."), (7, 1, "user", "Same."), (7, 2, "assistant", "\x85"), (8, 9, "system", "S.")]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit("p"), "tie": F.lit(1), "mark": F.lit(2), "fault": F.lit("f"), "k": F.lit(0)})
    assert rows_of(C.repair_digests(extra, extra)) == by_hand([tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows], {r[0] for r in rows})
    gone = spark.createDataFrame([(c, t, "user", "x.") for c in range(30) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0], SCHEMA)
    assert gone.count() and set(rows_of(C.repair_digests(C.damaged(gone), gone)).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair_digests(gone.limit(0), gone.limit(0)).count() == 0
    assert rows_of(C.repair_digests(C.damaged(extra), extra)) == by_hand(harm(rows), {r[0] for r in rows})


@pytest.mark.parametrize("length", [1, 2, 37])
def test_matrix_of_a_segment(length):
    """Costs through a segment equal those of the ways that are followed by each vector."""
    r = np.random.default_rng(length)
    code = "".join("abcdefghijkl"[i] for i in r.integers(0, 12, length))
    m = C.matrices([code])[0]
    for _ in range(5):
        after = r.integers(0, 6, 4)
        after = C.Graph._inserted(after[None])[0]
        assert ((m + after).min(axis=1) == C.Graph([code], after[None]).cost[0]).all()
