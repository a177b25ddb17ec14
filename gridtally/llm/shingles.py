"""Sets of word shingles as sorted 64-bit hashes, by array operations over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gridtally.llm.common import mix
from gridtally.llm.features import PIECE, Words


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, sorted.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words is one shingle of all
    of them; a text without words has an empty set.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        size, to = len(raw[at]), at + 1
        while to < len(raw) and size + len(raw[to]) <= PIECE:
            size += len(raw[to])
            to += 1
        words = Words(raw[at:to])
        h = words.whole()
        bounds = np.searchsorted(words.text, np.arange(to - at + 1))
        n = len(h) - width + 1
        code = np.zeros(max(n, 0), np.uint64)
        for i in range(width) if n > 0 else ():
            code = mix(code + np.uint64(0x9E3779B97F4A7C15)) + h[i : n + i]
        code = mix(code)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(code[a : b - width + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for i in range(a, b):
                    one = mix(one + np.uint64(0x632BE59BD9B4E019)) + h[i : i + 1]
                yield mix(one)
            else:
                yield np.zeros(0, np.uint64)
        at = to
