"""Packing of documents into sequences by sum of squares (operator 10).

Each partition packs its own documents as they come; nothing is shuffled. A document's full windows are sequences of
their own. What is left of it goes where the sum of squared counts of partially filled windows, by fill level, comes
out smallest: into a window of some level, or into a new one. The counts are one array of levels. When ``OPEN`` windows
are partially filled, and at the end of the partition, the emptiest windows' pieces are cut to fill the gaps of the
fullest, which leaves one window; at the end its ids become sequences whose lengths are powers of two, so there is
no padding at all and at most one sequence of each power for a partition.

A null text counts as empty (the end id alone). Rows that repeat are documents of their own. Null doc_ids stay null.
The result depends on the input's partitions, never on the order in which tasks run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .word_tokens import encoder

LENGTH, OPEN = 2048, 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: A piece: doc_id, ids before it in its document, its ids as bytes, ids of its document.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Packs the documents of one partition; ``add`` and ``finish`` yield finished sequences, each a list of pieces."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN) -> None:
        self.length, self.most_open, self.open = length, most_open, 0
        self.count = np.zeros(length + 1, np.int64)  # windows by fill level; full ones are not counted
        self.windows: list[list[list[Piece]]] = [[] for _ in range(length)]

    def _put(self, pieces: list[Piece], level: int) -> None:
        self.windows[level].append(pieces)
        self.count[level] += 1
        self.open += 1

    def _take(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        size, n = self.length, len(ids) // 4
        for at in range(0, n - n % size, size):
            yield [(doc_id, at, ids[4 * at : 4 * (at + size)], n)]
        rest = n % size
        if not rest:
            return
        piece = (doc_id, n - rest, ids[4 * (n - rest) :], n)
        # change of the sum of squares for each level h that the piece fits in (h = 0: a new window)
        change = 1 + 2 * self.count[rest : size + 1]
        change[-1] = 0
        change[1:] += 1 - 2 * self.count[1 : size - rest + 1]
        change[1:][self.count[1 : size - rest + 1] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(change[::-1].argmin())  # ties: the fullest
        pieces = [*self._take(level), piece] if level else [piece]
        if level + rest == size:
            yield pieces
        else:
            self._put(pieces, level + rest)
            if self.open > self.most_open:
                yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Fill the fullest windows with cut pieces of the emptiest; at most one window stays open."""
        left = [(level, w) for level in range(1, self.length) for w in self.windows[level]]
        self.count[:], self.open, self.windows = 0, 0, [[] for _ in range(self.length)]
        loose: list[Piece] = []  # what is to be dealt, emptiest window last taken first
        low, high = 0, len(left)
        while low < high or loose:
            if low == high:  # only loose pieces are left: they make windows of their own
                pieces, fill = [], 0
            else:
                high -= 1
                fill, pieces = left[high]
            while fill < self.length:
                if not loose:
                    if low >= high:
                        break
                    loose = left[low][1][::-1]
                    low += 1
                doc, at, ids, n = loose.pop()
                room = 4 * (self.length - fill)
                pieces = [*pieces, (doc, at, ids[:room], n)]
                fill += len(ids[:room]) // 4
                if len(ids) > room:
                    loose.append((doc, at + room // 4, ids[room:], n))
            if fill == self.length:
                yield pieces
            else:
                self._put(pieces, fill)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.settle()
        rest = [p for level in range(1, self.length) for w in self.windows[level] for p in w]
        total = sum(len(p[2]) // 4 for p in rest)
        rest.reverse()
        while total:
            room = size = 1 << (total.bit_length() - 1)
            out = []
            while room:
                doc, at, ids, n = rest.pop()
                out.append((doc, at, ids[: 4 * room], n))
                if len(ids) > 4 * room:
                    rest.append((doc, at + room, ids[4 * room :], n))
                room -= len(ids[: 4 * room]) // 4
            total -= size
            yield out


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, packer = encoder(tokenizer), Packer(length)
        base, done = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def keep(sequences: Iterator[list[Piece]]) -> None:
            nonlocal done
            for s in sequences:
                at = 0
                for doc, start, ids, n in s:
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, base + done, at))
                    at += len(ids) // 4
                done += 1

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keep(packer.add(doc, e.encode(text, end)))
            if rows:
                yield flush()
        keep(packer.finish())
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, end id 1, sequences of 2048."""
    import public_tokenizers as public

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public.path("word_bpe_49k.json"), 1)
