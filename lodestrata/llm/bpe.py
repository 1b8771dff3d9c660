"""Byte-level BPE by automaton matches and backtracking over compatible neighbours.

A token sequence is the BPE encoding of its bytes exactly when each adjacent pair of tokens is the encoding of the
pair's own bytes.  So a piece is encoded left to right: take the longest token that starts here (all matches of a piece
come from one Aho-Corasick pass, bytes mapped to Latin-1), keep it if it is compatible with the token before it, else
try the next shorter one, and step back when none is left.  Positions from which no continuation exists are marked, so
each is tried once and the time is linear in the piece.  Compatibility of a pair is decided once by the plain merge rule
and memoised; so are whole pieces, in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.shared import pieces, with_text_columns

#: Entries kept by a worker's tables of pieces and of token pairs before they are started anew.
MEMO = 150_000
#: Longest piece (bytes) that is worth remembering.
MEMO_PIECE = 64


class _Memo(dict):
    """A table filled on demand, in two generations: when the young one is full the old one goes, but for what is used again."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        out = self._old.get(key)
        if out is None:
            out = self._make(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        if isinstance(key, int) or len(key) <= MEMO_PIECE:
            self[key] = out
        return out


class Bpe:
    """Encoder and decoder over a rank table {bytes: rank}, splitting texts by ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.trie.add_word(b.decode("latin-1"), i)
        self.trie.make_automaton()
        self.size_of = {i: len(b) for b, i in ranks.items()}
        # the next shorter token that a token starts with
        self.shorter = {i: next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1) for b, i in ranks.items()}
        # keys: left * 2^32 + right, and a token that starts a piece
        self.fits = _Memo(lambda pair: self._fit(pair >> 32, pair & 0xFFFFFFFF))
        self.ends, self.starts = _Memo(lambda one: self._edge(one, 1)), _Memo(lambda one: self._edge(one, 0))
        self.whole = _Memo(lambda one: self._merged(self.bytes_of[one]) == [one])
        self.piece = _Memo(lambda text: tuple(self.encode_piece(text.encode())))

    def _merged(self, data: bytes) -> list[int]:
        """The merge rule itself, for short strings: join the leftmost pair of lowest rank while there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at a token's left (0) or right (1) edge while it is merged: each part, and the rank that takes it up."""
        data, taken, out = self.bytes_of[token], float("inf"), []
        while True:
            out.append((data, taken))
            if len(data) == 1:
                return out
            taken, parts = self.ranks[data], [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            data = parts[side]

    def _fit(self, left: int, right: int) -> bool:
        """Whether two neighbours stay apart: no merge across their border comes before both its parts are taken up.

        Of equal ranks the leftmost is first, so a part of the left token is taken up before, one of the right token after.
        """
        if not (self.whole[left] and self.whole[right]):
            return False
        starts, rank = self.starts[right], self.ranks.get
        for x, taken_x in self.ends[left]:
            for y, taken_y in starts:
                r = rank(x + y)
                if r is not None and r < taken_x and r <= taken_y:
                    return False
        return True

    def encode_piece(self, data: bytes) -> list[int]:
        """Longest matches all along where these fit together, which is the rule; else with steps back."""
        if (one := self.ranks.get(data)) is not None:
            return [one]
        text, fits = data.decode("latin-1"), self.fits
        out = [t for _, t in self.trie.iter_long(text)]
        if out and self.whole[out[0]] and sum(map(self.size_of.__getitem__, out)) == len(data):
            last = out[0]
            for t in out[1:]:
                if not fits[last << 32 | t]:
                    break
                last = t
            else:
                return out
        return self._backtracked(text)

    def _backtracked(self, text: str) -> list[int]:
        size_of, shorter, fits, longest = self.size_of, self.shorter, self.fits, self.trie.iter_long
        out: list[int] = []
        at, end, last, dead = 0, len(text), -1, bytearray(len(text) + 1)
        token = next(longest(text))[1]
        while True:
            while token >= 0 and (dead[at + size_of[token]] or not (self.whole[token] if last < 0 else fits[last << 32 | token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = at + size_of[token], token
                if at == end:
                    return out
                token = next(longest(text, at))[1]
                continue
            if not out:
                raise ValueError("the rank table lacks a single byte")
            dead[at] = 1
            token = out.pop()
            at -= size_of[token]
            token = shorter[token]
            last = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern encoded separately, no special tokens."""
        return list(chain.from_iterable(map(self.piece.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_BUILT: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """The encoder of a rank file (base64 token and rank a line), built once in each worker."""
    if (path, pattern) not in _BUILT:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _BUILT[path, pattern] = Bpe(ranks, pattern)
    return _BUILT[path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with an array<int> column of the token ids of the whole text.

    A null text encodes as an empty one: no tokens.  A column already named ``ids_col`` is replaced.
    """

    def ids(texts: list) -> list[pa.Array]:
        bpe = load(path, pattern)
        each = [np.array(bpe.encode(t) if t else [], np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))]

    return with_text_columns(docs, text_col, ids, f"`{ids_col}` array<int>", keep)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of each whole text and of their decoding.

    One row per row of ``docs``; a null text counts as an empty one.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in pieces(batches):
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text) if text else []
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
