"""Spelling variants by Bloom-guided neighbourhoods (operator 13).

Words are counted over all texts in the JVM. Two words are near if they differ by one inserted, deleted or replaced code point. The
vocabulary's words set bits in blocked Bloom filters, one for each length (a block is one cache line, a word's bits lie in one
block). Each word then generates its edits and probes the filter of the edit's length; only those found there are shuffled, to an exact join with the
vocabulary that removes what a filter let through. A pair is generated once: deletions from the longer word, replacements
from the smaller one.

An edit is not spelled out to be probed: a word's hash is a sum of numbers drawn for (place, code point), so an edit's hash is the word's with
a few numbers exchanged. Replacements take code points from the vocabulary's own alphabet, which is gathered with it.

Filters are broadcast in passes of at most ``FILTER_BYTES``: blocks of all lengths are numbered through, and a pass holds a range of them, so the
broadcast does not grow with the vocabulary, only the number of passes does. Nothing else is broadcast by this code; groups of a join key are
at most the edits of one word. Roots are found by following forms; counts grow at least ``factor``-fold from word to form, so
there are few steps, each with the words that have not arrived.

Null texts have no words; rows that repeat count each. A null id counts as an empty string where an id matters (``planted``). Runs
of letters of any length are whole words; an edit of a long word is probed in slices. An empty table, or one without words that
are frequent enough, gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, remove, stored

#: What is a letter, and upper-case letters that are lowered.
LETTERS, UPPER = "[A-Za-z\\u00C0-\\u00FF]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits a word in a filter, bits it sets, 64-bit cells of a block, blocks that one task builds, bytes of filters broadcast at once, lengths from
#: which on words share a filter, edits probed at once, words that a task probes with, about.
BITS, HASHES, CELLS, CHUNK, FILTER_BYTES, LONGEST, SLICE, TASK = 12, 6, 8, 1 << 14, 32 << 20, 64, 1 << 18, 8192


def planted(run: Column, doc_id: Column, every: int = 199) -> Column:
    """A run, or, where ``every`` divides the crc32 of "<doc_id>:<run>", the run without the code point that this number names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, shortest: int = 6, least: int = 5, misspell: bool = False, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, of at least ``shortest`` code points that occur at least ``least`` times; ``misspell``: after ``planted``."""
    runs = docs.select(F.col(ident).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS + f"{{{shortest},}}"), F.lit(0))).alias("r"))
    low = F.translate("r", UPPER, UPPER.lower())
    counted = runs.select((planted(low, F.col("d")) if misspell else low).alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers scattered."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The number drawn for a code point at a place."""
    return mixed((place.astype(np.uint64) * np.uint64(0x110000) + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def block_of(sums: np.ndarray, blocks: int) -> np.ndarray:
    """A word's block in its length's filter; sums of drawn numbers are as good as drawn."""
    return ((sums >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bit_of(sums: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the mask of the ``i``-th bit: the first one from the sum itself, so that most edits are settled by it."""
    b = (sums if i == 0 else mixed(sums + np.uint64(1)) >> np.uint64(9 * i)) & np.uint64(511)
    return (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63))


def shard(length: int) -> int:
    return min(length, LONGEST)


def code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


def deletions(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length (rows of code points): rows and places whose code point may go (one of each run of equal ones), and the sums of what is left."""
    at = np.arange(c.shape[1])
    here, back = drawn(at, c), drawn(at - (at > 0), c)  # back: where a code point stands once one before it went
    before, after = np.cumsum(here, 1) - here, np.cumsum(back[:, ::-1], 1)[:, ::-1] - back
    row, place = np.nonzero(np.hstack([np.ones((len(c), 1), bool), c[:, 1:] != c[:, :-1]]))
    return row, place, (before + after)[row, place]


class Filters:
    """A pass of filters: blocks ``begin`` and on of all, numbered through by length (``bases`` and ``blocks`` by shard)."""

    def __init__(self, cells: bytes, begin: int, bases: dict[int, int], blocks: dict[int, int]) -> None:
        self.cells, self.begin, self.bases, self.blocks = np.frombuffer(cells, np.uint64).reshape(-1, CELLS), begin, bases, blocks

    def probe(self, length: int, sums: np.ndarray) -> np.ndarray:
        """Indexes of sums that this pass may hold words for."""
        s = shard(length)
        if s not in self.blocks:
            return np.zeros(0, np.int64)
        block = block_of(sums, self.blocks[s]) + (self.bases[s] - self.begin)
        live = np.arange(len(sums))
        if self.begin or sum(self.blocks.values()) > len(self.cells):
            live = np.flatnonzero((block >= 0) & (block < len(self.cells)))
        for i in range(HASHES):
            cell, mask = bit_of(sums[live], i)
            live = live[(self.cells[block[live], cell] & mask) != 0]
        return live

    def near(self, words: list[str], alphabet: np.ndarray) -> list[list[str]]:
        """For each word its edits that a filter of this pass lets through. Words of one length are taken together, some at a time."""
        out: list[list[str]] = [[] for _ in words]
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            step = max(1, SLICE // max(int(n), len(alphabet), 1))
            for lo in range(0, len(which), step):
                self._near(words, which[lo : lo + step], alphabet, out)
        return out

    def _near(self, words: list[str], which: np.ndarray, alphabet: np.ndarray, out: list[list[str]]) -> None:
        c = np.stack([code_points(words[i]) for i in which])
        row, place, sums = deletions(c)
        for j in self.probe(c.shape[1] - 1, sums):
            w = words[which[row[j]]]
            out[which[row[j]]].append(w[: place[j]] + w[place[j] + 1 :])
        rest = drawn(np.arange(c.shape[1]), c)
        rest = rest.sum(1)[:, None] - rest
        for at in range(c.shape[1]):
            row, new = np.nonzero(alphabet[None, :] > c[:, at, None])
            sums = rest[row, at] + drawn(np.array(at), alphabet)[new]
            for j in self.probe(c.shape[1], sums):
                w = words[which[row[j]]]
                out[which[row[j]]].append(w[:at] + chr(alphabet[new[j]]) + w[at + 1 :])


def _chunks(vocabulary: DataFrame, bases: dict[int, int], blocks: dict[int, int]) -> DataFrame:
    """(chunk, cells): ``CHUNK`` blocks of the filters each; a chunk holds about CHUNK * 512 / BITS words, whatever the vocabulary."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, hs = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64)
            for i, word in enumerate(b.column(0).to_pylist()):
                c = code_points(word)
                hs[i] = drawn(np.arange(len(c)), c).sum()
                g[i] = block_of(hs[i : i + 1], blocks[shard(len(c))])[0] + bases[shard(len(c))]
            yield pa.RecordBatch.from_arrays([pa.array((g // CHUNK).astype(np.int32)), pa.array((g % CHUNK).astype(np.int32)), pa.array(hs.view(np.int64))], names=["chunk", "block", "h"])

    def build(t: pa.Table) -> pa.Table:
        cells = np.zeros((CHUNK, CELLS), np.uint64)
        block, h = t.column("block").to_numpy(), t.column("h").to_numpy().view(np.uint64)
        for i in range(HASHES):
            cell, mask = bit_of(h, i)
            np.bitwise_or.at(cells, (block, cell), mask)
        return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    return vocabulary.select("word").mapInArrow(place, "chunk int, block int, h bigint").groupBy("chunk").applyInArrow(build, "chunk int, cells binary")


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Pairs (word, n, near, near_n) of a stored ``vocabulary`` (word, n) that differ by one code point, each once."""
    spark = vocabulary.sparkSession
    sizes = {r.s: r.rows for r in vocabulary.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("s")).agg(F.count("*").alias("rows")).collect()}  # at most LONGEST rows
    blocks = {s: -(-rows * BITS // (64 * CELLS)) for s, rows in sorted(sizes.items())}
    bases, total = {}, 0
    for s, n in blocks.items():
        bases[s], total = total, total + n
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint32)  # no more than there are letters
    chunks = stored(_chunks(vocabulary, bases, blocks), "filters")
    per_pass, found = max(1, filter_bytes // (CHUNK * CELLS * 8)), None
    for first in range(0, -(-total // CHUNK), per_pass):
        cells = bytearray(min(per_pass * CHUNK, total - first * CHUNK) * CELLS * 8)
        for r in chunks.filter(F.col("chunk").between(first, first + per_pass - 1)).toLocalIterator():  # no more than filter_bytes
            at = (r.chunk - first) * CHUNK * CELLS * 8
            cells[at : at + CHUNK * CELLS * 8] = r.cells[: len(cells) - at]
        sent = spark.sparkContext.broadcast((bytes(cells), first * CHUNK, bases, blocks))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            filters = Filters(*sent.value)
            for b in batches:
                near = filters.near(b.column(0).to_pylist(), alphabet)
                yield pa.RecordBatch.from_arrays([*b.columns, list_array([x for y in near for x in y], [len(y) for y in near], pa.string())], names=["word", "n", "near"])

        hits = stored(vocabulary.select("word", "n").repartition(-(-sum(sizes.values()) // TASK), "word").mapInArrow(probe, "word string, n bigint, near array<string>").select("word", "n", F.explode("near").alias("near")), "hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; only words that have a form."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    active, done = stored(forms.select("word", F.col("form").alias("root")), "walk"), None
    while True:
        on = active.join(step, "root", "left")
        on = stored(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("last")), "walk")
        remove(active)
        ended = on.filter("last").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        rest = on.filter("not last")
        if rest.isEmpty():
            return done
        active = stored(rest.select("word", "root"), "walk")


def group_variants(counted: DataFrame, factor: int = 5, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word of ``counted`` (word, n): form (the near word of largest n, ties to the smallest, if that n is at least ``factor`` times the
    word's), root (the last form), n, n_near, form_n."""
    vocabulary = stored(counted.select("word", "n"), "vocabulary")
    pairs = near_pairs(vocabulary, filter_bytes)
    side = lambda a, na, b, nb: F.struct(F.col(a).alias("word"), F.col(na).alias("n"), F.struct((-F.col(nb)).alias("least"), F.col(b).alias("near")).alias("x"))
    both = pairs.select(F.inline(F.array(side("word", "n", "near", "near_n"), side("near", "near_n", "word", "n"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"), F.first("n").alias("n"))
    kept = -F.col("x.least") >= factor * F.col("n")
    best = stored(best.select("word", "n_near", F.when(kept, F.col("x.near")).alias("form"), F.when(kept, -F.col("x.least")).alias("form_n")), "near")
    last = roots(best.filter("form is not null").select("word", "form"))
    rows = vocabulary.join(best, "word", "left").join(last, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: variants among all words of the documents, some of which lose a code point by the contract's rule."""
    return group_variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), misspell=True))


ORACLE_SQL = """
with recursive crc0(i, k, c) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc0 where k < 8),
crc as materialized (select list(c order by i) as t from crc0 where k = 8),
runs as materialized (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]{6,}')) as raw from documents),
low as materialized (select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from runs group by all),
bytes as (select *, hex(encode(concat(doc_id, ':', r))) as x from low),
sums as (select r, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda i: (('0x' || x[i:i + 1])::bigint))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::bigint) as h from bytes, crc),
w as materialized (select case when h % 199 = 0 then concat(left(r, (h % length(r))::int), substr(r, (h % length(r))::int + 2)) else r end as word, sum(n)::bigint as n from sums group by 1 having length(word) >= 6 and sum(n) >= 5),
d as materialized (select word, n, i, concat(left(word, (i - 1)::int), substr(word, (i + 1)::int)) as rest from w, unnest(range(1, length(word) + 1)) u(i)),
pairs as materialized (select a.word, a.n, b.word as near, b.n as near_n from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word
 union select d.word, d.n, w.word, w.n from d join w on d.rest = w.word union select w.word, w.n, d.word, d.n from d join w on d.rest = w.word),
best as (select word, n, count(*) as n_near, max(near_n) as most from pairs group by word, n),
f as materialized (select p.word, min(near) as form, any_value(near_n) as form_n from pairs p join best b on p.word = b.word and near_n = most where most >= 5 * b.n group by p.word),
walk(word, here) as (select word, form from f union all select walk.word, f.form from walk join f on walk.here = f.word),
roots as (select word, here as root from walk where here not in (select word from f))
select w.word, form, coalesce(root, w.word) as root, w.n, coalesce(n_near, 0) as n_near, form_n from w left join best using (word) left join f using (word) left join roots using (word)
"""
