"""Language ID: nearest clustered centroid of normalised TF-IDF n-gram vectors.

Features are byte n-grams (one to four bytes) of the lower-cased text, hashed into a fixed
number of buckets; everything that is no letter counts as a space and a run of spaces as one.
Weights are (1 + ln tf) * idf, scaled to length one. Document frequencies come from all
training documents. Each language gets several centroids by spherical k-means over at most
SAMPLE of its distinct training texts, the ones with the smallest hash; this bound is the
only sampling. A document takes the language of its nearest centroid by cosine, which is the
score. It is rejected when it has no letter or when its cosine distance is above that of
nearly all documents of the language that the centroids were not fitted on: a fifth of the
sample is held out for that, and centroids of all of the sample are the ones that stay.

Any number of languages may be learnt. A model takes 200 kB a language; it meets the documents
in blocks of LANGUAGES languages, each of them in a pass of its own.

Cases: a null text, an empty one and one without letters (Unicode category L: digits, numerals
and fractions are none) have language ``und``, score 0 and are rejected. Documents without
language are no training documents. On a tie the language that sorts first wins. Repeated rows
are judged one by one, and fill one place of the sample. Of a language with a single distinct
text nothing is rejected. Without any training document everything is ``und``. An empty table
gives an empty table. Other columns pass through; result columns replace input columns of the
same name. Texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import chunks, tidy, written

BUCKETS = 1 << 14
#: Training documents of a language that k-means sees, and centroids of a language.
SAMPLE, CENTROIDS = 1500, 3
#: Languages whose centroids a task holds at a time.
LANGUAGES = 200
#: A document is rejected below this share of the cosine that the lowest held-out documents reach.
SLACK = 0.6

_LETTER = regex.compile(r"\p{L}")
_JUNK = re.compile(r"[\W\d_]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams."""
    data = np.frombuffer(f" {_JUNK.sub(' ', text.lower()).strip()} ".encode(), dtype=np.uint8).astype(np.uint32)
    grams, counts = [], np.zeros(BUCKETS, dtype=np.int64)
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, 5):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
        grams.append((code * np.uint32(2654435761)) >> np.uint32(32 - 14))
    for g in grams:
        counts += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text)
    weights = (1 + np.log(counts)) * idf[at]
    length = np.linalg.norm(weights)
    return at, weights / length if length else weights


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one a column, so that a text's buckets pick rows
    reach: np.ndarray  # of each centroid: the smallest cosine that is not rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0, True
        at, weights = vector(text, self.idf)
        cosines = weights @ self.centroids[at]
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.reach[best])

    def blocks(self) -> list[Model]:
        """The model in parts of at most LANGUAGES languages, in order; one part at least."""
        names = sorted(set(self.languages))
        parts = [set(names[i : i + LANGUAGES]) for i in range(0, len(names), LANGUAGES)] or [set()]
        out = []
        for part in parts:
            own = [i for i, name in enumerate(self.languages) if name in part]
            out.append(Model(self.idf, [self.languages[i] for i in own], self.centroids[:, own].copy(), self.reach[own]))
        return out


def _document_frequencies(train: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all training documents; each task sends one row for each bucket at most."""

    def run(batches):
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for whole in batches:
            for batch in chunks(whole, text, 4 << 20):
                for value in batch.column(0).to_pylist():
                    if value and _LETTER.search(value):
                        total[features(value)[0]] += 1
                        n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*total[at], n], pa.int64())], names=["bucket", "n"])

    rows = train.select(text).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    held = {r["bucket"]: r["n"] for r in rows}
    df = np.array([held.get(i, 0) for i in range(BUCKETS)], dtype=np.float64)
    n = held.get(-1, 0)
    return np.log((1 + n) / (1 + df)) + 1, n


class Rows:
    """Sparse unit vectors, one after the other."""

    def __init__(self, at: list[np.ndarray], weights: list[np.ndarray]):
        self.n, self.sizes = len(at), np.array([len(x) for x in at])
        self.at, self.weights = np.concatenate(at), np.concatenate(weights)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def cosines(self, centres: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(self.weights * c[self.at], self.starts) for c in centres], axis=1)

    def mean(self, chosen: np.ndarray) -> np.ndarray:
        """Direction of the sum of the chosen rows."""
        some = np.repeat(chosen, self.sizes)
        return _unit(np.bincount(self.at[some], weights=self.weights[some], minlength=BUCKETS))

    def only(self, chosen: np.ndarray) -> Rows:
        cut = np.flatnonzero(chosen)
        ends = self.starts + self.sizes
        return Rows([self.at[self.starts[i] : ends[i]] for i in cut], [self.weights[self.starts[i] : ends[i]] for i in cut])


def _unit(row: np.ndarray) -> np.ndarray:
    return row / max(float(np.linalg.norm(row)), 1e-12)


def _centres(rows: Rows) -> np.ndarray:
    """Centroids by spherical k-means, the first ones far apart."""
    every = np.ones(rows.n, dtype=bool)
    centres = rows.mean(every)[None]
    while len(centres) < min(CENTROIDS, rows.n):  # the row that is farthest from what there is
        far = np.arange(rows.n) == np.argmin(rows.cosines(centres).max(1))
        centres = np.concatenate([centres, rows.mean(far)[None]])
    for _ in range(8):
        own = rows.cosines(centres).argmax(1)
        centres = np.array([rows.mean(own == c) if (own == c).any() else centres[c] for c in range(len(centres))])
    own = rows.cosines(centres).argmax(1)
    return centres[np.unique(own)]


def _clustered(rows: Rows) -> tuple[np.ndarray, float]:
    """Centroids of one language, and the smallest cosine that they accept."""
    held = np.arange(rows.n) % 5 == 4 if rows.n >= 5 else np.arange(rows.n) == rows.n - 1
    if rows.n == 1:
        return _centres(rows), 0.0
    lowest = float(np.quantile(rows.only(held).cosines(_centres(rows.only(~held))).max(1), 0.001))
    return _centres(rows), SLACK * lowest


def _sampled(train: DataFrame) -> DataFrame:
    """(lang, hash, text): at most SAMPLE distinct texts of a language, those with the smallest hashes.

    Languages are counted first, so that of large ones only about as many texts as needed take part.
    """
    keyed = train.withColumn("hash", F.xxhash64("text"))
    share = keyed.groupBy("lang").agg((F.lit(1.5 * SAMPLE) / F.approx_count_distinct("hash")).alias("share"))
    share = written(share, "languages")
    if share.count() <= 10_000:  # rows of a name and a number
        share = F.broadcast(share)
    few = keyed.join(share, "lang").where(F.pmod("hash", F.lit(1 << 20)) <= F.col("share") * (1 << 20))
    few = few.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    return few.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("hash"))).where(F.col("_n") <= SAMPLE).drop("_n")


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from the labelled rows of train; rows without label, or without a letter in their text, are left out."""
    train = train.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text is not null and lang is not null")
    idf, n = _document_frequencies(train, "text")
    if not n:
        return Model(idf, [], np.zeros((BUCKETS, 0)), np.zeros(0))

    def vectors(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                some = [(a, h, *vector(t, idf)) for a, h, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "hash", "text")), strict=True) if _LETTER.search(t)]
                columns = list(zip(*some, strict=True)) or [[], [], [], []]
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["lang", "hash", "at", "weights"])

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("hash")
        centres, reach = _clustered(Rows(list(frame["at"]), list(frame["weights"])))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "reach": reach})

    made = _sampled(train).mapInArrow(tidy(vectors), "lang string, hash long, at array<int>, weights array<float>")
    rows = made.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, reach double").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    matrix = np.array([np.frombuffer(r["centre"], dtype=np.float32) for r in rows]).reshape(len(rows), BUCKETS).T.copy()
    return Model(idf, [r["lang"] for r in rows], matrix, np.array([r["reach"] for r in rows]))


NAMES = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected."""
    out = docs.drop(*(c for c in docs.columns if c in NAMES and c != text))
    for number, part in enumerate(model.blocks()):
        out = _predicted(written(out, "judged") if number else out, part, text, first=number == 0)
    return out


def _predicted(docs: DataFrame, model: Model, text: str, first: bool) -> DataFrame:
    """Adds the result columns, or replaces them where this part of the model has a nearer centroid."""
    columns = [c for c in docs.columns if first or c not in NAMES]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, text, 4 << 20):
                found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
                if not first:
                    before = zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True)
                    found = [b if b[0] == "und" or b[1] >= f[1] else f for b, f in zip(before, found, strict=True)]
                langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*columns, *NAMES],
                )

    return docs.mapInArrow(tidy(run), schema)
