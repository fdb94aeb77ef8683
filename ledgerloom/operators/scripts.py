"""User code as script evaluator: called once for each distinct request, answers kept for later rounds."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pinned import pinned

#: What user code gives for a request, in a table keyed by the request's digest.
ANSWERS = "digest string, ok boolean, mem long, steps long, error string"
#: Answers, of some 150 bytes each, up to which they are broadcast.
BROADCAST_ROWS = 50_000


def request_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def evaluate_scripts(requests: DataFrame, columns: Sequence[str], call: Callable[[dict], tuple[int, int]], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """requests with ok, mem, steps and error, and the table of all answers so far.

    call gets the named columns of a request, as decoded JSON, and returns mem and steps; an
    exception is a failure whose message is the error, never the job's. It runs once for each
    distinct request that known, the answers of earlier calls, does not hold; so it must depend on
    the named columns alone. Requests with equal columns share an answer, whichever transaction
    asks. The answers are written; a request is a row of the result once, as often as it is asked.
    """
    asked = requests.withColumn("digest", request_digest(columns))
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    fresh = asked.select("digest", body.alias("body")).distinct()  # a digest has one body; keys alone are hashed, not sorted
    if known is not None:
        fresh = fresh.join(known, "digest", "left_anti")

    def run(batches):
        for batch in batches:
            rows = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    mem, steps = call(json.loads(text))
                    rows.append((digest, True, int(mem), int(steps), None))
                except Exception as e:  # whatever user code raises is a row
                    rows.append((digest, False, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            columns_ = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], names=["digest", "ok", "mem", "steps", "error"])

    answers = pinned(fresh.mapInArrow(run, ANSWERS))
    if known is None:
        every = answers
    else:  # rounds that ask nothing new add no table to read
        every = known if answers.isEmpty() else known.unionByName(answers)
    # the answers, few against what is asked, are the side that a task holds; what is asked streams by, and is not shuffled if they are few
    few = every.count() <= BROADCAST_ROWS
    return asked.join(every.hint("broadcast" if few else "shuffle_hash"), "digest").drop("digest"), every
