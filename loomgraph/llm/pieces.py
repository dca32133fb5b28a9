"""Splits texts into the pieces that byte-level BPE merges one by one, as the native tokenizer libraries do.

The native libraries know the letters and digits of one Unicode version, the
``regex`` module those of another.  Characters on which they differ are found
once per process, as they turn up, and stand under a character of the right
class while a text is split; the pieces are cut from the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import public_tokenizers
import regex
import tiktoken

# Longer texts are split a stretch of pieces at a time, so that no list grows with the text.
LONG = 1 << 22
STRETCH = 1 << 18

# Encoded pieces kept per process; the memo is emptied when full.
MEMO = 1 << 18

_CLASSES = ((r"\p{L}", "é"), (r"\p{N}", "1"), (r"\s", " "))
_OTHER = "!"


class Splitter:
    def __init__(self) -> None:
        self._find = regex.compile(public_tokenizers.PATTERN)
        every_byte = {bytes([i]): i for i in range(256)}
        self._classes = [(regex.compile(p), tiktoken.Encoding(p, pat_str=p, mergeable_ranks=every_byte, special_tokens={}), c) for p, c in _CLASSES]
        self._known = set(map(chr, range(128)))
        self._stand_in: dict[int, str] = {}

    def _learn(self, chars: set[str]) -> None:
        for c in chars:
            native = [bool(e.encode_ordinary(c)) for _, e, _ in self._classes]
            if native != [bool(p.match(c)) for p, _, _ in self._classes]:
                self._stand_in[ord(c)] = next((s for (_, _, s), yes in zip(self._classes, native) if yes), _OTHER)
        self._known |= chars

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The pieces of ``text`` in order, in lists of bounded length."""
        shadow = text
        if not text.isascii():
            chars = set(text)
            self._learn(chars - self._known)
            if not self._stand_in.keys().isdisjoint(map(ord, chars)):
                shadow = text.translate(self._stand_in)
        if shadow is text and len(text) < LONG:
            yield self._find.findall(text)
            return
        found = self._find.finditer(shadow)
        while part := [text[m.start() : m.end()] for m in islice(found, STRETCH)]:
            yield part


class PieceEncoder:
    """Encodes texts piece by piece: pieces not met before are encoded together by ``learn``, the others are remembered.

    ``learn`` takes distinct pieces and returns their packed ids; a text's ids are those of its pieces, one after the other.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]]):
        self._learn, self._split = learn, Splitter()
        self._memo: dict[str, bytes] = {}

    def _packed(self, parts: list[list[str]]) -> list[bytes]:
        new = {p for part in parts for p in part if p not in self._memo}
        if len(self._memo) + len(new) > MEMO:
            self._memo.clear()
            new = {p for part in parts for p in part}
        if new:
            names = list(new)
            self._memo.update(zip(names, self._learn(names)))
        get = self._memo.__getitem__
        return [b"".join(map(get, part)) for part in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owners, held = [], [], 0
        for i, text in enumerate(texts):
            for part in self._split(text) if text else ():
                parts.append(part)
                owners.append(i)
                held += len(part)
                if held >= STRETCH:
                    for owner, packed in zip(owners, self._packed(parts)):
                        out[owner].append(packed)
                    parts, owners, held = [], [], 0
        for owner, packed in zip(owners, self._packed(parts)):
            out[owner].append(packed)
        return [b"".join(x) for x in out]
