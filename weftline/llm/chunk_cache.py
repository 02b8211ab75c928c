"""Splits texts into chunks that byte-level BPE encodes independently, and caches their ids.

The pre-tokenizer's pieces never hold a white-space character after another character, so every place
where a run of spaces or newlines begins is also a border between pieces. Texts with other white space
(tabs, no-break spaces) are split by the pre-tokenizer's own pattern instead: exact for any input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import regex

_CHUNKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]").search


class ChunkCache:
    """encode maps a list of distinct chunks to their ids as little-endian unsigned 32-bit bytes.

    At most max_entries chunks are kept; the cache starts anew when it is full, which costs time only.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], pattern: str, max_entries: int = 400_000):
        self._encode, self._pieces, self._max, self._ids = encode, regex.compile(pattern).findall, max_entries, {}

    def encode(self, texts: Iterable[str | None], step: int = 1 << 20) -> Iterator[bytes]:
        """One result per text, in order; about step characters are split at a time."""
        block: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            block.append(self._pieces(text) if _OTHER_SPACE(text) else _CHUNKS(text))
            size += len(text)
            if size >= step:
                yield from self._flush(block)
                block, size = [], 0
        yield from self._flush(block)

    def _flush(self, block: list[list[str]]) -> Iterator[bytes]:
        new = list(set().union(*block).difference(self._ids)) if block else []
        if len(self._ids) + len(new) > self._max:
            self._ids.clear()
            new = list(set().union(*block))
        self._ids.update(zip(new, self._encode(new), strict=True))
        get = self._ids.__getitem__
        for chunks in block:
            yield b"".join(map(get, chunks))
