"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

The distinct pieces of a batch are walked depth first as a trie: sorted, each piece shares with the
one before it the path of their common prefix, and the stack holds for every byte of that path the
last token of the prefix's encoding. A prefix ends in the one token that may follow the last token
of what is left of it, so the encodings of shared prefixes are computed once, and a piece's tokens
are read off by going back through the stack. Two tokens may follow each other when the merges
make exactly these two of their joined bytes; that is looked up once per pair.

Defined cases: null and empty texts have no ids (an empty list). Special tokens are never produced;
their strings are ordinary text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZERS = os.environ.get("FIELDPROOF_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# The pattern that cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 200_000  # encodings a process keeps; the older half goes when there are more
KEPT_PAIRS = 4_000_000


class TrieEncoder:
    """Encodes many pieces at once; keeps the encodings of pieces seen, up to a bound, and of pairs."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(PIECES).findall
        self.backward: dict = {}  # tokens by their bytes from the last to the first; the rank is at -1
        for token, rank in self.ranks.items():
            node = self.backward
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.follows: dict[int, bool] = {}  # by left << 20 | right
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.kept: dict[str, list[int]] = {}

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by merging, lowest rank first and only ranks under `below`; for the few bytes of a token."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, best = min([(ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)])
            if rank >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[x] for x in parts]

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from last; None for a single byte or one that no merge makes."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], token) if len(self.bytes_of[token]) > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as these two.

        Going back through the merges that made them, the later one first, no two neighbours
        across the border may form a token that would have been merged before.
        """
        bytes_of, ranks, limit = self.bytes_of, self.ranks, 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], limit) < limit:
                return False
            # the later of the two merges is undone; where one side is a byte, the other
            first, second = self.half(left), self.half(right)
            if first is None and second is None:
                return True
            if second is None or first is not None and left > right:
                limit, left = left, first[1]
            else:
                limit, right = right + 1, second[0]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct piece, by one depth-first walk over their trie."""
        out: dict[str, list[int]] = {}
        follows, backward = self.follows, self.backward
        if len(follows) > KEPT_PAIRS:
            follows.clear()
        last = [-1]  # last[i]: the last token of the encoding of the first i bytes of the path
        size = [0]  # size[i]: the bytes of that token
        before = b""
        for data, piece in sorted((p.encode("utf-8", "replace"), p) for p in pieces):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for i in range(shared, len(data)):
                node, found, at = backward, [], i
                while at >= 0 and (node := node.get(data[at])) is not None:
                    if -1 in node:
                        found.append((node[-1], at))
                    at -= 1
                for rank, at in reversed(found):  # the longest first; only one fits
                    if at:
                        pair = last[at] << 20 | rank
                        fits = follows.get(pair)
                        if fits is None:
                            fits = follows[pair] = self.may_follow(last[at], rank)
                    else:
                        fits = len(found) == 1 or self.merged(self.bytes_of[rank]) == [rank]
                    if fits:
                        last.append(rank)
                        size.append(i + 1 - at)
                        break
            ids, at = [], len(data)
            while at > 0:
                ids.append(last[at])
                at -= size[at]
            out[piece] = ids[::-1]
            before = data
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for null and empty texts."""
        cut = [self.split(t) if t else [] for t in texts]
        new = {p for pieces in cut for p in pieces if p not in self.kept}
        if len(self.kept) + len(new) > KEPT_PIECES:
            for old in list(islice(self.kept, KEPT_PIECES // 2)):
                del self.kept[old]
            new = {p for pieces in cut for p in pieces if p not in self.kept}
        self.kept.update(self.encode_pieces(new))
        of = self.kept.__getitem__
        return [list(chain.from_iterable(map(of, pieces))) for pieces in cut]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> TrieEncoder:
    """The encoder of a vocabulary file, made once per process."""
    path = os.path.join(folder, vocabulary)
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; rows are encoded where they are read, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = own.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def count_tokens(df: DataFrame, columns: list[str], text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """`columns` and n_tokens of every row; the text isn't carried on."""
    from pyspark.sql import types as T

    picked = df.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes = [len(x) for x in own.encode(part.column(len(columns)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(sizes, pa.int64())], names=[*columns, "n_tokens"])

    return picked.mapInArrow(run, schema)
