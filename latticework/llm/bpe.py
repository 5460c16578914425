"""Byte-level BPE encoding and decoding by backtracking (operator 3).

A text is cut by the tokenizer's pattern and each piece encoded alone. The bytes of a piece are mapped to Latin-1
characters, so one pass of an Aho-Corasick automaton of the vocabulary finds every token that starts at each byte.
Starting from the longest match, a token is accepted if it is compatible with the token before it (merging the bytes
of the two by rank gives those two again; remembered by pair); else a shorter match is tried, and where none is left the
position is marked as dead and the token before is given up. A sequence whose neighbours are all compatible is the
one that merging by rank gives, so the ids are those of the exact merges; dead positions make the work linear. Of a piece of any
length only some blocks of matches are held, besides a few bytes for each of its own.

A null text counts as empty: no ids. Every row is encoded whole; rows that repeat get the same result.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, small_batches

MEMO = 300_000
#: Bytes of a long piece whose matches are held at once.
BLOCK = 1 << 16
_CODECS: dict[tuple[str, str], Codec] = {}


class Codec(dict):
    """Maps a piece (str) to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        super().__init__()
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.vocab = {i: t for t, i in self.ranks.items()}
        self.lone = {bytes([b]): i for b in range(256) if (i := self.ranks.get(bytes([b]))) is not None}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.pieces = regex.compile(pattern).findall

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the neighbours of lowest rank, leftmost first, one by one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 2 * MEMO:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.vocab[a] + self.vocab[b]) == [a, b]
        return ok

    def block(self, text: str, begin: int, size: int) -> list[list[tuple[int, int]]]:
        """For each of ``size`` places from ``begin`` on the tokens (length, id) that begin there, shortest first."""
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (n, i) in self.automaton.iter(text, begin, min(len(text), begin + size + self.longest)):
            if (at := end - n + 1 - begin) < size:
                starts[at].append((n, i))
        return starts

    def backtrack(self, data: bytes) -> list[int]:
        text, size = data.decode("latin-1"), len(data)
        if size <= BLOCK:
            starts: list[list[tuple[int, int]]] | _Blocks = [[] for _ in data]
            for end, (n, i) in self.automaton.iter(text):
                starts[end - n + 1].append((n, i))
            option: list[int] | array = [0] * size
        else:
            starts, option = _Blocks(self, text), array("h", bytes(2 * size))
        alive, chosen, lengths = bytearray(b"\x01") * (size + 1), [], []
        at, k = 0, len(starts[0]) - 1 if size else -1
        while at < size:
            here = starts[at]
            while k >= 0:
                n, i = here[k]
                if alive[at + n] and (not chosen or self.compatible(chosen[-1], i)):
                    break
                k -= 1
            if k >= 0:
                option[at] = k
                chosen.append(i)
                lengths.append(n)
                at += n
                if at < size:
                    k = len(starts[at]) - 1
            else:
                if not chosen:
                    return self.merged(data)  # a vocabulary without some byte
                alive[at] = 0
                chosen.pop()
                at -= lengths.pop()
                k = option[at]
        return chosen

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = np.array([whole] if whole is not None else self.backtrack(data), "<u4").tobytes()
        if len(piece) <= 40:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, self.pieces(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Blocks:
    """Matches by place of a long piece, of which some blocks are held at once."""

    def __init__(self, codec: Codec, text: str) -> None:
        self.codec, self.text = codec, text
        self.held: dict[int, list[list[tuple[int, int]]]] = {}

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        b = at // BLOCK
        if b not in self.held:
            if len(self.held) > 3:
                self.held.pop(next(iter(self.held)))
            self.held[b] = self.codec.block(self.text, b * BLOCK, min(BLOCK, len(self.text) - b * BLOCK))
        return self.held[b][at % BLOCK]


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_path, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out``: ids of the whole text as little-endian unsigned 32-bit binary."""
    small_batches(docs.sparkSession)

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        c = codec(ranks_path, pattern)
        return {out: pa.array([c.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.binary())}

    return add_columns(docs, make, f"`{out}` binary")


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the column ``out``: the bytes that the ids stand for; null ids give null."""
    small_batches(rows.sparkSession)

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        c = codec(ranks_path, pattern)
        return {out: pa.array([None if x is None else c.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.binary())}

    return add_columns(rows, make, f"`{out}` binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: ids of every document and the text decoded from them, as digests."""
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, pattern).drop("text")
    rows = decode(rows, path, pattern)
    return rows.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
