"""Token counts by whole tokens first (operator 12).

A byte-level tokenizer cuts a text into pre-tokens and merges each alone. Before any text is read, every string of the vocabulary
is merged alone once, and those that give one token are proven: a pre-token among them is one token, whatever else the
text holds. They are counted by a look-up; only the rest is merged, by the library's model, and remembered. The proof covers
the vocabulary, so its size is the vocabulary's; it is made once in the driver and shipped as one string of flags.

Pre-tokens are cut by the fixed pattern. The library's tables of characters can be older than those of the pattern's engine, so a text with
a character that Unicode 15.1 has not assigned is cut by the library itself. The string of an added token inside a
text is that token, as the library's default has it, and what stands on either side is cut apart.

A null text counts as empty: no bytes, no tokens. Rows are counted one by one, so rows that repeat get the same figures; other columns stay, of
which those named as a result are replaced. Texts of any length are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, small_batches
from .word_tokens import MEMO, SHOWN

#: The pre-tokenizer whose pattern this is, and the pattern.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which all tables of characters agree; others are looked up.
SETTLED = re.compile("[\x00-՗]*").fullmatch
_COUNTERS: dict[str, TokenCounter] = {}


def _library(path: str):
    """The tokenizer of a file, its added tokens' strings; files that this counting does not fit are refused."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    told = json.loads(tokenizer.to_str())
    model = told["model"]
    odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
    added = told["added_tokens"]
    if told["pre_tokenizer"] != PRE_TOKENIZER or told["normalizer"] or model["type"] != "BPE" or odd or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("only byte-level files without normalization, whose added tokens stand for their plain strings")
    return tokenizer, [t["content"] for t in added]


def prove(path: str) -> str:
    """For each id of the vocabulary a flag: 1 if its string, merged alone, is that one token."""
    tokenizer, _ = _library(path)
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    flags = ["0"] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        if [t.id for t in tokenizer.model.tokenize(token)] == [i]:
            flags[i] = "1"
    return "".join(flags)


class TokenCounter(dict):
    """Maps a pre-token to its number of tokens: proven ones are given, the rest is merged once and remembered."""

    def __init__(self, path: str, proven: str) -> None:
        super().__init__()
        tokenizer, added = _library(path)
        self.model, self.cutter = tokenizer.model, tokenizer.pre_tokenizer
        self.pieces = regex.compile(PATTERN).findall
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))).split if added else None
        byte = {c: b for b, c in SHOWN.items()}
        for shown, i in tokenizer.get_vocab(with_added_tokens=False).items():
            if i < len(proven) and proven[i] == "1":
                try:
                    self[bytes(map(byte.__getitem__, shown)).decode()] = 1
                except (KeyError, UnicodeDecodeError):
                    pass  # a part of a character: never a whole pre-token
        self.merged: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.model.tokenize("".join(map(SHOWN.__getitem__, piece.encode()))))
            if len(piece) <= 40:
                if len(self.merged) >= MEMO:
                    self.merged.clear()
                self.merged[piece] = n
        return n

    def part(self, text: str) -> int:
        if SETTLED(text) or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return sum(map(self.__getitem__, self.pieces(text)))
        return sum(len(self.model.tokenize(shown)) for shown, _ in self.cutter.pre_tokenize_str(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added(text) if self.added else [text]
        return len(parts) - 1 + sum(map(self.part, parts))


def counter(path: str, proven: str) -> TokenCounter:
    """One counter for each file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, proven)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each whole text."""
    small_batches(docs.sparkSession)
    proven = prove(path)

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        c = counter(path, proven)
        col = b.column(b.schema.get_field_index(text))
        return {"n_bytes": pc.fill_null(pc.binary_length(col), 0).cast(pa.int64()), "n_tokens": pa.array([c.count(t) for t in col.to_pylist()], pa.int64())}

    return add_columns(docs, make, "n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: tokens of every document by the vocabulary of 50,257 byte-level tokens."""
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
