"""Token ids by a tokenizer of the ``tokenizers`` library, with a memo of words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

#: A memo that holds so many words is emptied (it is only a cache).
MEMO = 300_000
#: The pre-tokenizer whose pieces can be cut here, and the pattern of these pieces in lower-case text of ``PLAIN`` characters.
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \\t\\n\\r]+").findall
PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ\\t\\n\\r]*").fullmatch
#: Characters that byte-level vocabularies show for bytes: printable ones for themselves, the rest from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(b) for b in _KEPT} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _KEPT)}
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Only for tokenizers that drop white space and treat each word alone (white space neither joins nor changes
    what stands beside it). A text that holds the string of one of the file's added tokens goes to the library whole, which
    gives that token its own id. Other texts are cut at spaces, tabs and line ends, the library encodes each word, and words are
    remembered. Where a text has only printable ASCII, Latin-1 letters and these spaces, on which the tokenizer's
    normalization is lower-casing, its pieces are cut here and go straight to the library's model.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.plain = told["pre_tokenizer"] == PRE_TOKENIZER
        if any(t["normalized"] for t in told["added_tokens"]):
            raise ValueError("added tokens that are looked for in normalized text")
        self.added = [t["content"] for t in told["added_tokens"]]
        self.model, self.pieces = self.tokenizer.model, PieceMemo(self.piece_ids)

    def piece_ids(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(SHOWN.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= 40:
            self[word] = ids
        return ids

    def encode(self, text: str | None, end: int) -> bytes:
        """Ids of a text (null: empty), then ``end``."""
        if len(self) > MEMO:
            self.clear()
        text, last = text or "", end.to_bytes(4, "little")
        if any(token in text for token in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + last
        if self.plain and PLAIN(text):
            return b"".join([*map(self.pieces.__getitem__, PIECES(text.lower())), last])
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join([*map(self.__getitem__, words), last])


class PieceMemo(dict):
    """Ids of pieces of plain texts."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        ids = self.make(piece)
        if len(piece) <= 40:
            self[piece] = ids
        return ids


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
