"""Exact byte-pair encoding by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids in each Python worker; the store is emptied when full.
PIECES = 200_000
#: Pairs of tokens kept with their compatibility in each Python worker, likewise.
PAIRS = 500_000
#: A vocabulary file larger than this is no vocabulary; it bounds what is broadcast.
MOST_BYTES = 64 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabularies lie: the folder in LOGFATHOM_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(os.environ.get("LOGFATHOM_TOKENIZERS", "/opt/tokenizers"), name)


class Vocabulary:
    """Tokens by rank with the merge that makes each: all that the dynamic programme needs, and small."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        #: The two ranks that merge into a token; a single byte is (itself, itself).
        self.split: list[tuple[int, int]] = []
        #: Whether merging ever makes the token.
        self.made: list[bool] = []
        for i, token in enumerate(tokens):
            parts = [token] if len(token) == 1 else self._merged(token, rank, i)
            self.made.append(len(parts) <= 2)
            self.split.append((i, i) if len(token) == 1 else (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (-1, -1))
        self.pair = {s: i for i, s in enumerate(self.split) if len(tokens[i]) > 1 and self.made[i]}

    @staticmethod
    def _merged(token: bytes, rank: dict[bytes, int], below: int) -> list[bytes]:
        """The bytes of ``token`` after all merges of a rank under ``below``, lowest rank first."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], below))
            if rank.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        with open(path, "rb") as f:
            ranked = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError(f"{path} has gaps between its ranks")
        return cls([t for _, t in ranked])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.read(path)


class Encoder:
    """Encodes pieces with one vocabulary. The encoding of a prefix ends in exactly one token.

    For every end position an automaton gives the tokens that end there. One of them is the last token of the
    encoded prefix: the one that may follow the last token of the prefix before it, that is, whose pair merging leaves
    alone. So the table of last tokens is filled from left to right and followed back from the end, in time linear in
    the piece, however long it is.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.split, self.pair, self.may = v.split, v.pair, {}
        self.known: dict[str, list[int]] = {}
        self.byte = {t[0]: i for i, t in enumerate(v.tokens) if len(t) == 1}
        names = [(t.decode("latin-1"), i) for i, t in enumerate(v.tokens) if v.made[i]]
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for name, i in names:
                self.automaton.add_word(name, (i, len(name)))
            self.automaton.make_automaton()
            self.ends = self.automaton.iter
        except ImportError:
            self.ids = dict(names)
            self.longest = max(len(n) for n, _ in names)
            self.ends = self._ends

    def _ends(self, s: str) -> Iterator[tuple[int, tuple[int, int]]]:
        for end in range(len(s)):
            for n in range(min(end + 1, self.longest), 0, -1):
                if (i := self.ids.get(s[end + 1 - n : end + 1])) is not None:
                    yield end, (i, n)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side as they are.

        The last merges of both are undone from the latest on. A merge across the boundary that would have come
        before the one just undone spoils the pair; at two single bytes with none found, it holds.
        """
        key = (left, right)
        held = self.may.get(key)
        if held is None:
            split, pair = self.split, self.pair
            a, b, before, held = left, right, len(split), True
            while True:
                across = pair.get((a, b))
                if across is not None and across < before:
                    held = False
                    break
                whole_a, whole_b = split[a][1] == a, split[b][0] == b
                if whole_a and whole_b:
                    break
                # of equal ranks the left one merges first, so the right one is undone first
                if not whole_a and (whole_b or a > b):
                    before, a = a, split[a][1]
                else:
                    before, b = b + 1, split[b][0]
            if len(self.may) >= PAIRS:
                self.may.clear()
            self.may[key] = held
        return held

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        last: list[int] = [-1] * len(raw)
        length: list[int] = [0] * len(raw)
        compatible = self.compatible
        for end, (token, n) in self.ends(raw):
            if last[end] < 0:
                before = end - n
                if before < 0 or (last[before] >= 0 and compatible(last[before], token)):
                    last[end], length[end] = token, n
        out = []
        at = len(raw) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out

    def encode(self, text: str, words=regex.compile(PATTERN).findall) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in words(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) < 100:
                    if len(known) >= PIECES:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(b: Broadcast) -> Encoder:
    """One encoder for each vocabulary in a Python worker, which serves many tasks."""
    v = b.value
    key = hash((len(v.tokens), v.tokens[-1], v.tokens[len(v.tokens) // 2]))
    if key not in _encoders:
        _encoders[key] = Encoder(v)
    return _encoders[key]


def token_ids(texts: DataFrame, doc_id: Column, text: Column, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text by the vocabulary in ``path``, without special tokens.

    One narrow pass without a shuffle; the vocabulary (some MB, its size is checked) is broadcast. Strings that look
    like special tokens are ordinary text. Null and empty texts both give an empty list; every row gives one row,
    repeated rows and null ids too. Texts are encoded whole, in time linear in their length. An empty input gives no
    rows. Only the two columns are read.
    """
    rows = texts.select(doc_id.alias("doc_id"), text.alias("text"))
    b = rows.sparkSession.sparkContext.broadcast(vocabulary(path or vocabulary_path()))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(b).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = pa.array([encode(t) if t else [] for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")
