"""LM scoring: marginal probability of texts over all subword segmentations.

A text is its words, lower-cased in A-Z, and one end. The model draws each token: the end, or
a word. A word comes from a lattice whose arcs are the pieces of an existing subword
vocabulary and single bytes, for what no piece spells: its probability is the sum over all
ways through the lattice, found by a forward recursion in log space. So the document's
probability is the marginal over all segmentations of all its words.

    P(word) = (1 - P(end)) * sum over segmentations of the product of p(piece), times p(end of word)

The scores in the vocabulary file are those of a BPE vocabulary, which are ranks of merges and
no log probabilities: as such they cannot weight anything. A piece therefore weighs what the
vocabulary's own segmentation of all training words, each as often as it occurs, counts for it,
plus 0.1. The vocabulary is never trained, only its scores are counted anew. Beside the model
stands the base, a smoothed unigram of whole words.

All training words are counted; nothing is sampled. Words with at least the share FREQUENT of
all tokens, a million at most, are broadcast with their weights. All others, which are rare
and so never skewed, are joined with the table of words by shuffling.

Cases: null texts count as empty, which is one end. Repeated rows are scored one by one and
counted in training each. Null ids count as the empty id when parts are dealt. Without
training texts all pieces weigh the same. Of pieces with equal surface one stays. Arcs are as
long as the longest piece, texts and words are read whole. An empty table gives an empty
table. Other columns do not travel, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import removed, written

FREQUENT = 1e-6
#: Distinct words of a task after which its counts are passed on.
FLUSH = 1_000_000
END = b"\n"  # no word holds it


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _count_words(docs: DataFrame, text: str, train: str) -> DataFrame:
    """(word, c): all words with their training counts, 0 for others; END counts training texts."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for value, learnt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(value)
                if learnt:
                    counts.update(words)
                    counts[END] += 1
                else:
                    for w in words:
                        counts.setdefault(w, 0)
                if len(counts) > FLUSH:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return docs.select(text, train).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, model: bytes) -> dict[bytes, int]:
    """How often the vocabulary's segmentation of all training words uses each piece; END ends each word. words: word, c."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        totals = np.zeros(encoder.get_piece_size(), dtype=np.int64)
        ends = 0
        for batch in batches:
            times = batch.column(1).to_numpy()
            pieces = encoder.encode([w.decode() for w in batch.column(0).to_pylist()], num_threads=1)
            np.add.at(totals, np.concatenate([np.empty(0, np.int64), *pieces]).astype(np.int64), np.repeat(times, [len(x) for x in pieces]))
            ends += int(times.sum())
        used = np.flatnonzero(totals).tolist()
        names = [END, *(surface(encoder.id_to_piece(i)) for i in used)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([ends, *totals[used].tolist()], pa.int64())], names=["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["piece"]): r["n"] for r in rows}


def surface(piece: str) -> bytes:
    """The bytes of a piece inside a word; empty for one that stands for none."""
    if piece.startswith("<0x") and len(piece) == 6:
        return bytes([int(piece[3:5], 16)])
    return b"" if piece.startswith("<") and piece.endswith(">") and len(piece) > 2 else piece.replace("▁", "").encode().lower()


def piece_weights(model: bytes, counts: dict[bytes, int]) -> dict[bytes, float]:
    """Natural logs of the pieces' probabilities; they and the end of a word sum to one."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {surface(vocabulary.id_to_piece(i)) for i in range(vocabulary.get_piece_size())} - {b""}
    pieces |= {bytes([b]) for b in range(256)} | {END}
    total = sum(counts.get(p, 0) + 0.1 for p in pieces)
    return {p: math.log((counts.get(p, 0) + 0.1) / total) for p in pieces}


class Lattice:
    def __init__(self, weights: dict[bytes, float]):
        self.end = weights[END]
        self.byte = [weights[bytes([b])] for b in range(256)]
        self.arcs: dict[str, float] = {}
        for piece, weight in weights.items():
            try:
                self.arcs[piece.decode()] = weight
            except UnicodeDecodeError:
                pass
        for c, weight in list(self.arcs.items()):
            if len(c) == 1 and ord(c) > 127:  # a letter's own arc and the way over its bytes
                self.arcs[c] = np.logaddexp(weight, sum(self.byte[b] for b in c.encode()))
        self.longest = max(map(len, self.arcs), default=1)

    def log_probability(self, word: str) -> float:
        """Log of the sum over all segmentations: the forward recursion in log space."""
        arcs, exp, longest = self.arcs, math.exp, self.longest
        ahead = [0.0]
        for i in range(1, len(word) + 1):
            terms = []
            for j in range(max(0, i - longest), i):
                weight = arcs.get(word[j:i])
                if weight is not None:
                    terms.append(ahead[j] + weight)
                elif j == i - 1:
                    terms.append(ahead[j] + sum(self.byte[b] for b in word[j].encode()))
            top = max(terms)
            ahead.append(top + math.log(sum([exp(t - top) for t in terms])))
        return ahead[-1] + self.end


class Totals:
    """What the training words sum up to."""

    def __init__(self, tokens: int, texts: int, distinct: int):
        self.tokens, self.texts, self.distinct = tokens, texts, distinct  # distinct: words, without the end
        end = (texts + 0.5) / (tokens + 1)
        self.log_end, self.log_word = math.log(end), math.log1p(-end)

    def base(self, c: int) -> float:
        kinds = self.distinct + (self.texts > 0)
        return math.log10((c + 0.5) / (self.tokens + 0.5 * (kinds + 1)))

    def word(self, pieces: float) -> float:
        """log10 of the probability of a word token with this log probability by pieces."""
        return (self.log_word + pieces) / math.log(10)


def _weighed(words: DataFrame, weights: dict[bytes, float], totals: Totals) -> DataFrame:
    """(word, c, base, score) of each distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        lattice = Lattice(shared.value)
        for batch in batches:
            counts = batch.column(1).to_pylist()
            scores = [totals.word(lattice.log_probability(w.decode())) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([totals.base(c) for c in counts]), pa.array(scores, pa.float64())], names=["word", "c", "base", "score"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, base double, score double")


def score_texts(docs: DataFrame, held_out: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that are not held out.

    model: the bytes of a subword vocabulary file.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{held_out}`").alias("held_out"))
    counted = written(_count_words(docs.withColumn("train", ~F.col("held_out")), "text", "train"), "counts")
    words = counted.where(F.col("word") != F.lit(END))
    sums = words.agg(F.sum("c").alias("words"), F.sum((F.col("c") > 0).cast("long")).alias("distinct")).first()
    texts = (counted.where(F.col("word") == F.lit(END)).select("c").first() or [0])[0]
    totals = Totals((sums["words"] or 0) + texts, texts, sums["distinct"] or 0)
    weighed = written(_weighed(words, piece_weights(model, piece_counts(words, model)), totals), "words")
    removed(counted)
    head = weighed.where(F.col("c") >= max(2.0, totals.tokens * FREQUENT)).toArrow().to_pydict()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(head["word"], zip(head["base"], head["score"], strict=True), strict=True)))
    end = (totals.base(texts), totals.log_end / math.log(10), int(texts > 0))

    def run(batches):
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, rest, ends, times = [], [], [0], []
                for value in batch.column(1).to_pylist():
                    base, score, found = end
                    counts = Counter(words_of(value))
                    for word, n in counts.items():
                        weights = known.get(word)
                        if weights:
                            base += n * weights[0]
                            score += n * weights[1]
                            found += n
                        else:
                            rest.append(word)
                            times.append(n)
                    ends.append(len(rest))
                    rows.append((1 + sum(counts.values()), found, base, score))
                tokens, found, base, score = zip(*rows, strict=True) if rows else ((),) * 4
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                        pa.ListArray.from_arrays(offsets, pa.array(rest, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<binary>, times array<int>"
    rows = written(docs.select("doc_id", "text", "held_out").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("n"))
    more = rare.join(weighed, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.col("base")).alias("base_more"), F.sum(F.col("n") * F.col("score")).alias("score_more"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_more"),
    )
    zero = F.lit(0.0)
    return rows.drop("rest", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("score") + F.coalesce("score_more", zero)).alias("score"),
    )
