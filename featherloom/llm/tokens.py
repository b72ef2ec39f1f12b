"""Token ids of texts under a public byte-level BPE vocabulary (problem 7)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.llm.texts import ident

#: Fixed value: the pattern that splits a text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encoder and decoder of a rank file (lines of base64 token and rank).

    The encoding of a piece is the one sequence of tokens of which every neighbouring pair is compatible: merging the bytes
    of the two by rank gives the two again. encode_piece takes the longest token at each place, found for all places
    by one Aho-Corasick pass, and goes back to a shorter one, or to an earlier place, where a pair isn't compatible. A
    place that can't be the end of a compatible prefix is noted, so that none is tried twice: the time is linear in
    the piece. Pairs are checked once and kept.
    """

    def __init__(self, rank_file: bytes, kept_pieces: int = 200_000, kept_pairs: int = 2_000_000):
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.split = regex.compile(PATTERN).findall
        count = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * count
        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.matches = automaton.iter
        # the next shorter token that begins like this one, or -1
        self.shorter = [-1] * count
        for token, rank in self.ranks.items():
            for end in range(len(token) - 1, 0, -1):
                if (prefix := self.ranks.get(token[:end])) is not None:
                    self.shorter[rank] = prefix
                    break
        self.length = [len(t) for t in self.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.kept_pieces, self.kept_pairs = kept_pieces, kept_pairs
        # decoding: all tokens in one buffer, token k from offsets[k] to offsets[k + 1]
        self.buffer = b"".join(self.tokens)
        self.offsets = [0] * (count + 1)
        for k, size in enumerate(self.length):
            self.offsets[k + 1] = self.offsets[k] + size

    def merged(self, raw: bytes) -> list[int]:
        """The merges by rank, done plainly: of the neighbours whose union has the least rank, the leftmost first."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.tokens)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.tokens):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.kept_pairs:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None and self.merged_whole(raw, whole):
            return [whole]
        longest = [-1] * len(raw)
        length = self.length
        for last, rank in self.matches(raw.decode("latin-1")):
            at = last + 1 - length[rank]
            if longest[at] < 0 or length[rank] > length[longest[at]]:
                longest[at] = rank
        open_ends = [True] * (len(raw) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(raw):
            end = at + length[token]
            if open_ends[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(raw) else -1
                continue
            while (token := self.shorter[token]) < 0:
                open_ends[at] = False
                token = out.pop()
                at -= length[token]
        return out

    def merged_whole(self, raw: bytes, rank: int) -> bool:
        """Whether merging gives the token as a whole; kept with the pairs."""
        found = self.pairs.get((-1, rank))
        if found is None:
            found = self.pairs[-1, rank] = self.merged(raw) == [rank]
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in self.split(text or ""):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:  # longer ones don't come again
                    if len(pieces) >= self.kept_pieces:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        offsets, buffer = self.offsets, self.buffer
        return b"".join(buffer[offsets[k] : offsets[k + 1]] for k in ids).decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = {}


def _codec(file) -> Codec:
    """One codec per Python worker and vocabulary."""
    if file.id not in _codecs:
        _codecs[file.id] = Codec(file.value)
    return _codecs[file.id]


class _File:
    """The rank file in a broadcast, under a key of its content."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.id, self._sent = ident(raw), spark.sparkContext.broadcast(raw)

    @property
    def value(self) -> bytes:
        return self._sent.value

    def __getstate__(self):
        return {"id": self.id, "_sent": self._sent}


def _encode(file: _File):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _codec(file).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def encode_texts(df: DataFrame, id_col: str, text: str, rank_file: str) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens; their strings are ordinary text.

    rank_file is the path of a public rank file; the driver reads it and sends it to the tasks (a file of fixed size). Null
    and empty texts give an empty list. Each row is encoded by itself: no shuffle, and rows with equal ids stay apart.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_encode(_File(df.sparkSession, rank_file)), "id long, ids array<int>")


def decode_ids(df: DataFrame, ids: str, rank_file: str) -> Column:
    """The texts of a column of ids; null ids give null."""
    file = _File(df.sparkSession, rank_file)

    @F.pandas_udf("string")
    def decode(column):
        back = _codec(file).decode
        return column.map(lambda x: None if x is None else back(list(x)))

    return decode(F.col(f"`{ids}`"))
