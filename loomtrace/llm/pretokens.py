"""Fast exact BPE encoding in a worker: bounded tables over the ``tokenizers`` library's model.

A BPE tokenizer encodes each pre-token alone, so a text's ids are its pre-tokens' ids joined, and a
run of pre-tokens between two cuts (a "chunk") always has the same ids. Two tables, chunk -> ids and
pre-token -> ids, answer for what was seen before; the library's model encodes the rest, after each
byte was mapped to its stand-in character. A key enters a table at its second miss, so the many words
that occur once don't fill it. Texts that the given cuts don't fit exactly go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Entries of each of a worker's two tables, and marks of keys missed once.
TABLE, MARKS = 250_000, 1 << 22


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Table(dict):
    """Keys met twice, up to TABLE of them; ``make`` gives the value of any other."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.marks = make, bytearray(MARKS)

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        at = hash(key) % MARKS
        if not self.marks[at]:
            self.marks[at] = 1
        elif len(self) < TABLE:
            self[key] = value
        return value


class PreTokens:
    """``pattern`` finds the pre-tokens of a chunk; ``chunks`` cuts a prepared text, or gives None if it can't be cut exactly."""

    def __init__(self, library, pattern: re.Pattern, chunks: Callable[[str], list[str] | None], prefix: str = ""):
        self.library, self.pattern, self.chunks, self.prefix = library, pattern, chunks, prefix
        self.model = library.model
        #: Little-endian forms of all ids.
        self.packed = [i.to_bytes(4, "little") for i in range(max(library.get_vocab().values(), default=0) + 1)]
        self.stand_in = {b: c for b, c in byte_characters().items() if chr(b) != c}
        self.words = _Table(self._word)
        self.table = _Table(self._chunk)

    def _word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.stand_in)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        return self._joined(self.prefix + chunk)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        look = self.table.__getitem__
        cut = map(self.chunks, texts)
        return [self._whole(t) if x is None else self._joined(x[0]) + b"".join(map(look, x[1:])) for t, x in zip(texts, cut, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
