"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decode.

Encoding. The merges are compiled into a finite-state transducer that reads a piece byte by
byte. A state holds what the bytes read so far leave open: every start of a token that could
still be running, as nodes of the vocabulary's trie. The longest of them tells the others, so
the determinised states are the trie's nodes, and transitions are made when first met. A token
may follow another one only if BPE leaves the pair as it is, which makes the token that ends
at a given byte unique: the first one, from the longest on, that may follow the one before it.
A token is emitted once the chains back from all open starts agree on it, which needs no more
bytes ahead than the longest vocabulary entry has. The tables of transitions, of pairs and of
pieces met before are of bounded size and live as long as a task does.

Decoding. Ids become bytes, and an incremental UTF-8 decoder turns bytes into text chunk by
chunk, holding back incomplete sequences, so a document is never needed as one block of ids.

Cases: a null text counts as empty and has no ids; null ids decode to an empty text. Repeated
rows are encoded one by one. Of two merges with one rank, which no vocabulary file has, the
one further left counts. Texts are read whole, also those without any white space. An empty
table gives an empty table. Every other column passes through; result columns replace input
columns of the same name. An id outside the vocabulary, a negative one too, is an error.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import chunks, tidy

#: Entries of a task's tables. A full table of transitions or pairs is emptied and fills again; of pieces, the last two fillings are kept.
MAX_MOVES, MAX_PAIRS, MAX_PIECES = 150_000, 150_000, 120_000


def read_ranks(text: bytes) -> dict[bytes, int]:
    """The vocabulary of a tiktoken file: base64 token and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, text.splitlines()) if token}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends, self.depth, self.parent = array("i", [-1]), array("i", [0]), array("i", [0])
        last = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.parent.append(node)
                    last.append(b)
                node = nxt
            self.ends[node] = rank
        self.last = bytes(last)
        self.moves: dict[int, int] = {}
        self.next_start = array("i", [-1]) * len(self.ends)
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(self.ends)
        self.pairs: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        known = self.made_of.get(token, 0)
        if known == 0:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side.

        Merges are undone from the latest back, on whichever side made it. Just before each of
        them the two tokens at the border must not have had a merge of their own that comes
        earlier (on equal rank: further left).
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        ranks, tokens = self.ranks, self.tokens
        a, b, before = left, right, 1 << 60
        while True:
            if ranks.get(tokens[a] + tokens[b], 1 << 60) < before:
                known = False
                break
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                known = True
                break
            if of_b is None or of_a is not None and a > b:
                before, a = a, of_a[1]
            else:
                before, b = b + 1, of_b[0]
        self.pairs[key] = known
        return known

    def _shorter(self, node: int) -> int:
        """The longest open start of a state after its first one: the longest suffix of the node's bytes in the trie."""
        known = self.next_start[node]
        if known < 0:
            known = self.next_start[node] = 0 if self.depth[node] < 2 else self._move(self._shorter(self.parent[node]), self.last[node])
        return known

    def _move(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        known = self.moves.get(key)
        if known is None:
            if len(self.moves) >= MAX_MOVES:
                self.moves.clear()
            known = self.child.get(key, -1)
            if known < 0:
                known = self._move(self._shorter(state), byte) if state else 0
            self.moves[key] = known
        return known

    def _ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """Tokens that may end in a state, with their lengths, the longest first."""
        known = self.suffixes[state]
        if not known and state:
            own = ((self.ends[state], self.depth[state]),) if self.ends[state] >= 0 else ()
            known = self.suffixes[state] = own + self._ending(self._shorter(state))
        return known

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        ended: list[int] = []  # by byte, from the last emitted token on
        moves, suffixes, pairs, state, before = self.moves, self.suffixes, self.pairs, 0, -1
        for at, byte in enumerate(piece):
            after = moves.get(state << 8 | byte)
            state = self._move(state, byte) if after is None else after
            for token, size in suffixes[state] or self._ending(state):
                start = len(ended) - size
                left = ended[start] if start >= 0 else before
                if left < 0:
                    break
                known = pairs.get(left << 32 | token)
                if known or known is None and self.stays(left, token):
                    break
            ended.append(token)
            if at & 4095 == 4095:
                before = self._emit(ended, state, out, before)
        out += self._chain(ended, len(ended))
        return out

    def _chain(self, ended: list[int], at: int) -> list[int]:
        """The tokens up to a place, each the one that ends where the next begins."""
        chain, tokens = [], self.tokens
        while at > 0:
            token = ended[at - 1]
            chain.append(token)
            at -= len(tokens[token])
        chain.reverse()
        return chain

    def _emit(self, ended: list[int], state: int, out: list[int], before: int) -> int:
        """Moves to out the tokens on which the chains back from all open starts agree; the last emitted token."""
        sure = None
        while True:
            chain = self._chain(ended, len(ended) - self.depth[state])
            if sure is None:
                sure = chain
            else:
                same = 0
                while same < min(len(sure), len(chain)) and sure[same] == chain[same]:
                    same += 1
                del sure[same:]
            if not state:
                break
            state = self._shorter(state)
        out += sure
        del ended[: sum(len(self.tokens[t]) for t in sure)]
        return sure[-1] if sure else before


class Encoder:
    """Texts to ids, four bytes each; pieces that the task has met before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        found, new = self.known.get, self._new
        return b"".join([found(x) or new(x) for x in self.split(text)])

    def _new(self, piece: str) -> bytes:
        ids = self.older.get(piece) or array("i", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= MAX_PIECES:
                self.older = dict(self.known)
                self.known.clear()
            self.known[piece] = ids
        return ids


def decode(ids: Iterable[int], tokens: list[bytes], step: int = 4096) -> Iterator[tuple[bytes, str]]:
    """Bytes and text of ids, step by step; a sequence cut by a step's end is held back."""
    machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
    for at in range(0, len(ids), step):
        some = ids[at : at + step]
        if min(some) < 0:
            raise ValueError(f"{min(some)} is no id")
        data = b"".join([tokens[i] for i in some])
        yield data, machine.decode(data)
    yield b"", machine.decode(b"", final=True)


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c in names))


def _tokens(vocabulary: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    tokens = [b""] * (1 + max(vocabulary.values(), default=-1))
    for token, rank in vocabulary.items():
        tokens[rank] = token
    return tokens


def _decoded(ids: list[int], tokens: list[bytes], with_text: bool) -> tuple[str, str | None]:
    """Digest of the decoded bytes, and the text if it is wanted."""
    digest, held = hashlib.sha256(), []
    for data, piece in decode(ids, tokens):
        digest.update(data)
        if with_text:
            held.append(piece)
    return digest.hexdigest(), "".join(held) if with_text else None


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ids (array of int) and n_tokens. ranks: the bytes of a tiktoken vocabulary file.

    decoded: ids are decoded again in the same pass, which adds decoded_sha256, the digest of the decoded bytes.
    """
    names = ("ids", "n_tokens", "decoded_sha256") if decoded else ("ids", "n_tokens")
    docs = _without(docs, *names)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())][: len(docs.columns) + len(names)])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        vocabulary = read_ranks(shared.value)
        encoder, tokens = Encoder(vocabulary, pattern), _tokens(vocabulary)
        for whole in batches:
            for batch in chunks(whole, text, 2 << 20):
                rows = [encoder.encode(value) if value else b"" for value in batch.column(text).to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))
                more = [pa.array([_decoded(np.frombuffer(x, dtype=np.int32).tolist(), tokens, False)[0] for x in rows], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(np.diff(offsets).astype(np.int64)), *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tidy(run), schema)


def decode_ids(docs: DataFrame, ranks: bytes, ids: str = "ids", with_text: bool = True) -> DataFrame:
    """Adds decoded_sha256, of the decoded bytes, and decoded, the text, if with_text."""
    docs = _without(docs, "decoded", "decoded_sha256")
    schema = T.StructType([*docs.schema.fields, *([T.StructField("decoded", T.StringType())] if with_text else []), T.StructField("decoded_sha256", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        tokens = _tokens(read_ranks(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [_decoded(value.values.to_numpy().tolist() if value.is_valid else [], tokens, with_text) for value in part.column(ids)]
                more = [pa.array([t for _, t in done], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*part.columns, *more, pa.array([d for d, _ in done], pa.string())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def ids_sha256(ids: str = "ids"):
    """Digest of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
