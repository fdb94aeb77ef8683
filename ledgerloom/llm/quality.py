"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Features say whether an n-gram occurs in a text: of one to four UTF-8 bytes; of one to six runs
of character classes (capitals, small or non-ASCII letters, digits, white space, each other sign
by itself); and of one to eight words that repeat the word before. They are hashed to BUCKETS
numbers. A feature's log-count ratio compares how many labelled texts of either class hold it,
counted over all training rows, one more each. A text is the vector of the ratios of its features,
scaled to length one, and a constant 1. The hinge loss is minimised by dual coordinate descent:
one dual variable a training text, each step solves for one of them exactly and moves the weights.

The descent sees at most SAMPLE distinct texts of each class, those with the smallest hashes, and
of these no more than hold FEATURES features together; this bound is the only sampling. A fifth
of them is kept out of the descent and turns margins into probabilities by a logistic curve,
each class weighing as many texts as it has rows.

Cases: null counts as an empty text, which has no feature and gets the score of the constant
alone. Training rows whose label is neither 0 nor 1 are left out; repeated ones count as often in
the ratios and once in the sample. Without training rows every score is 0.5; with one class it is
(rows of class 1 + 1) / (rows + 2). An empty table gives an empty table. Other columns pass
through; result columns replace input columns of the same name. Texts are read whole, in pieces
of a megabyte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import chunks

BITS = 18
BUCKETS = 1 << BITS
#: Distinct texts of a class that the descent sees, and features that they may hold together.
SAMPLE, FEATURES = 6000, 12_000_000
#: A score from which a text is predicted to be of class 1.
THRESHOLD = 0.3
#: Upper bound of a dual variable, passes over the sample at most, and the spread of gradients that ends them.
COST, PASSES, SPREAD = 1.0, 40, 0.05

_PIECE = 1 << 20
_CLASSES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else ord(" ") if b <= 32 else b for b in range(256)
)


def _mark(flags: np.ndarray, data: np.ndarray, longest: int, salt: int) -> None:
    """Sets the flags of all n-grams of data of up to longest bytes."""
    for start in range(0, len(data), _PIECE):
        piece = data[start : start + _PIECE + longest - 1].astype(np.uint32)
        fresh = min(_PIECE, len(data) - start)
        code = np.full(len(piece), salt, dtype=np.uint32)
        for n in range(1, longest + 1):
            if len(piece) < n:
                break
            code = code[: len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1 :] + np.uint32(1)
            flags[((code ^ (code >> np.uint32(15))) * np.uint32(2654435761))[:fresh] >> np.uint32(32 - BITS)] = True


def _runs(data: bytes) -> np.ndarray:
    """Character classes, each run of a class once."""
    parts, last = [], -1
    for start in range(0, len(data), _PIECE):
        piece = np.frombuffer(data[start : start + _PIECE].translate(_CLASSES), dtype=np.uint8)
        parts.append(piece[np.concatenate([[piece[0] != last], piece[1:] != piece[:-1]])])
        last = piece[-1]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)


def _longest_repeat(data: bytes) -> int:
    """How often in a row a word repeats the one before, at most."""
    start, before, run, best = 0, None, 0, 0
    while start < len(data):
        end = start + _PIECE
        while end < len(data) and data[end] > 32:
            end += 1
        for word in data[start:end].split():
            run = run + 1 if word == before else 0
            best, before = max(best, run), word
        start = end
    return best


def features(text: str | None) -> np.ndarray:
    """Numbers of the features of a text, ascending."""
    data = (text or "").encode()
    flags = np.zeros(BUCKETS, dtype=bool)
    _mark(flags, np.frombuffer(data, dtype=np.uint8), 4, 1)
    _mark(flags, _runs(data), 6, 2)
    _mark(flags, np.full(min(_longest_repeat(data), 8), ord("="), dtype=np.uint8), 8, 3)
    return np.flatnonzero(flags)


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    constant: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        x = self.ratios[at]
        length = float(np.sqrt(x @ x))
        return self.constant + (float(x @ self.weights[at]) / length if length else 0.0)

    def score(self, text: str | None) -> float:
        """Probability of class 1."""
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and how many of each hold each feature; a task sends a row for each feature at most."""

    def run(batches):
        held, n = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for whole in batches:
            for batch in chunks(whole, "text", 4 << 20):
                for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                    held[label, features(text)] += 1
                    n[label] += 1
        at = np.flatnonzero(held.sum(0))
        columns = [np.append(at, -1).astype(np.int32), *(np.append(held[c, at], n[c]) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "zeros", "ones"])

    sums = train.mapInArrow(run, "feature int, zeros long, ones long").groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    held, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in sums.collect():  # at most BUCKETS + 1 rows
        if r["feature"] < 0:
            n[:] = r["zeros"], r["ones"]
        else:
            held[:, r["feature"]] = r["zeros"], r["ones"]
    return n, held


def log_count_ratios(held: np.ndarray) -> np.ndarray:
    p, q = held[1] + 1, held[0] + 1
    return np.log((p / p.sum()) / (q / q.sum()))


def _sampled(train: DataFrame) -> DataFrame:
    """(label, hash, text) of at most SAMPLE distinct texts of a class, those with the smallest hashes."""
    keyed = train.withColumn("hash", F.xxhash64("text"))
    distinct = {r["label"]: r["n"] for r in keyed.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).collect()}  # two rows at most
    share = F.lit(1.0)
    for label, n in distinct.items():
        share = F.when(F.col("label") == label, 1.5 * SAMPLE / max(n, 1)).otherwise(share)
    few = keyed.where(F.pmod("hash", F.lit(1 << 20)) <= share * (1 << 20)).groupBy("label", "hash").agg(F.min("text").alias("text"))
    return few.withColumn("_n", F.row_number().over(W.partitionBy("label").orderBy("hash"))).where(F.col("_n") <= SAMPLE).drop("_n")


def descend(at: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, constant and dual variables of the hinge-loss model over the rows."""
    weights, constant, duals = np.zeros(BUCKETS), 0.0, np.zeros(len(at))
    rows = []
    for a in at:
        x = ratios[a]
        length = np.sqrt(x @ x)
        rows.append(((x / length if length else x).astype(np.float32), 2.0 if length else 1.0))
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        least, most = np.inf, -np.inf
        for i in order.permutation(len(at)):
            x, square = rows[i]
            gradient = signs[i] * (float(weights[at[i]] @ x) + constant) - 1
            if (duals[i] == 0 and gradient > 0) or (duals[i] == COST and gradient < 0):
                projected = 0.0
            else:
                projected = gradient
            least, most = min(least, projected), max(most, projected)
            if projected:
                new = min(max(duals[i] - gradient / square, 0.0), COST)
                move = (new - duals[i]) * signs[i]
                duals[i] = new
                weights[at[i]] += move * x
                constant += move
        if most - least < SPREAD:
            break
    return weights, constant, duals


def _curve(margins: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the margins best; classes weigh as in n."""
    held = np.array([(labels == c).sum() for c in (0, 1)])
    if held.min() < 5:
        return 2.0, 0.0
    each = (n / n.sum() / held)[labels] * len(labels)
    target = np.where(labels == 1, (held[1] + 1) / (held[1] + 2), 1 / (held[0] + 2))
    x, z = np.stack([margins, np.ones(len(margins))], axis=1), np.array([2.0, 0.0])

    def loss(z: np.ndarray) -> float:
        t = x @ z
        return float(each @ (np.logaddexp(0, t) - target * t)) + 1e-3 * float(z @ z)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -500, 500)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (each * (p - target)) + 2e-3 * z)
        size = 1.0
        while size > 1e-6 and loss(z - size * step) > loss(z):
            size /= 2
        z = z - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(z[0], 1e-3)), float(z[1])


def fit(train: DataFrame, text: str = "text", label: str = "label") -> Model:
    """Learns from rows whose label is 0 or 1."""
    train = train.where(f"`{label}` in (0, 1)").select(F.coalesce(f"`{text}`", F.lit("")).alias("text"), F.col(f"`{label}`").cast("int").alias("label"))
    n, held = _counts(train)
    ratios = log_count_ratios(held)
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(ratios, np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    shared = train.sparkSession.sparkContext.broadcast(ratios)

    def vectors(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                at = [features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("hash"), pa.array(at, pa.list_(pa.int32())), pa.array([len(a) for a in at], pa.int64())], names=["label", "hash", "at", "size"]
                )

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "hash"])
        labels, at = frame["label"].to_numpy(), list(frame["at"])
        place = frame.groupby("label").cumcount().to_numpy()
        out = place % 5 == 4
        weights, constant, _ = descend([a for a, o in zip(at, out, strict=True) if not o], np.where(labels[~out] == 1, 1.0, -1.0), shared.value)
        model = Model(shared.value, weights, constant, 1.0, 0.0)
        slope, shift = _curve(np.array([model.margin(a) for a, o in zip(at, out, strict=True) if o]), labels[out], n)
        return pd.DataFrame({"weights": [weights.tobytes()], "constant": [constant], "slope": [slope], "shift": [shift]})

    rows = _sampled(train).mapInArrow(vectors, "label int, hash long, at array<int>, size long")
    before = F.sum("size").over(W.partitionBy("label").orderBy("hash").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FEATURES // 2).select("label", "hash", "at")
    made = rows.groupBy().applyInPandas(learn, "weights binary, constant double, slope double, shift double").first()  # one group of the bounded sample
    return Model(ratios, np.frombuffer(bytes(made["weights"])), made["constant"], made["slope"], made["shift"])


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text, 4 << 20):
                scores = [shared.value.score(t) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                    names=[*columns, "score", "predicted"],
                )

    return docs.mapInArrow(run, schema)
