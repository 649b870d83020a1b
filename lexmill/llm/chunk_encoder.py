"""Encodes texts with a public tokenizer file by white-space chunks, whose ids a bounded cache keeps.

A tokenizer whose pieces never hold white space inside (``words``: white space is dropped; ``spaced``: it leads a piece)
gives the same ids for a text as for its chunks one after another, so each distinct chunk is encoded once. The chunks
are cut only where both conventions of white space agree.
"""

from __future__ import annotations

import os
import re
from array import array

_LATIN, _MARKS, _SPACE = "A-Za-zÀ-ÖØ-öø-įı-ɏ", r".,;:!?%&$#*|", r" \t\n\r"
#: Latin words (without U+0130, whose lower case has a mark) and runs of common marks are chunks of their own where nothing that could join them follows; what else
#: stands between white space stays whole.
CHUNKS = {
    "words": re.compile(rf"[{_LATIN}]++(?=[{_SPACE}\x0b\x0c{_MARKS}]|\Z)|[{_MARKS}]++(?=[{_SPACE}\x0b\x0c{_LATIN}0-9]|\Z)|[^{_SPACE}\x0b\x0c]+"),
    "spaced": re.compile(rf" ?[{_LATIN}]++(?=[{_SPACE}{_MARKS}]|\Z)| ?[{_MARKS}]++(?=[{_SPACE}{_LATIN}0-9]|\Z)|\s*\S+(?:[^\S{_SPACE}]\s*\S*)*|\s+"),
}
#: Distinct chunks kept in each Python worker, and the longest chunk kept; others are encoded each time they occur.
CACHED, LONGEST = {"words": 700_000, "spaced": 350_000}, 48

#: Chunks that are one word of Latin letters to any byte-level tokenizer; its model takes them as they are, byte by byte in
#: the letters that stand for bytes: printable ones for themselves, the others for those from 256 on, in order.
_WORD = re.compile(rf" ?[{_LATIN}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = dict(zip([b for b in range(256) if b not in _PRINTED], map(chr, range(256, 512)), strict=False))
#: Words that tell whether a tokenizer file is of that kind.
_PROBES = ("a", "Apple", "thonaning", "École", "straße", "ñandú", "Ɏx", "ŉ", "Ǆǆ", "Ʊpsilon")

_encoders: dict[tuple[str, str], ChunkEncoder] = {}


class _Cache(dict):
    """The ids of chunks as bytes, found when a chunk is first asked for; ``passing`` has those that are not kept for other calls."""

    def __init__(self, find, most: int):
        self.find, self.most, self.passing = find, most, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.passing.get(chunk)
        if ids is None:
            ids = array("I", self.find(chunk)).tobytes()
            kept = self if len(self) < self.most and len(chunk) <= LONGEST else self.passing
            kept[chunk] = ids
        return ids


class ChunkEncoder:
    def __init__(self, path: str, chunks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.find, self.cache = Tokenizer.from_file(path), CHUNKS[chunks].findall, _Cache(self._ids, CACHED[chunks])
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.encode("APPLE", add_special_tokens=False).ids == self.tokenizer.encode("apple", add_special_tokens=False).ids
        probes = [*_PROBES, *(f" {p}" for p in _PROBES if chunks == "spaced")]
        self.direct = all(self._word(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes)

    @classmethod
    def of(cls, path: str, chunks: str) -> ChunkEncoder:
        """The worker's encoder for a file; it lives as long as the worker."""
        if (path, chunks) not in _encoders:
            _encoders[path, chunks] = cls(path, chunks)
        return _encoders[path, chunks]

    def _word(self, word: str) -> list[int]:
        """The ids of a word by the model alone."""
        word = word.lower() if self.lower else word
        letters = word.replace(" ", _LETTERS[32]) if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.tokenize(letters)]

    def _ids(self, chunk: str) -> list[int]:
        return self._word(chunk) if self.direct and _WORD.fullmatch(chunk) else self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        find, ids = self.find, self.cache.__getitem__
        out = [b"".join(map(ids, find(t))) for t in texts]
        self.cache.passing.clear()
        return out


def slices(texts: list[str], chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about so many characters, so that a batch's chunks stay few in memory."""
    cuts, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            cuts.append((start, i + 1))
            start, held = i + 1, 0
    return [*cuts, (start, len(texts))] if start < len(texts) else cuts
