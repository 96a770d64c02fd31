"""Sets of hashed word shingles, from the bytes of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from faultline.llm.common import byte_blocks, mix, word_hashes, words_of

WIDTH = 5
_PLACES = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def block_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words; a text of fewer
    words has its whole sequence as the one shingle, a text without words none."""
    starts, ends, row = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(words)
    places = _PLACES if width == WIDTH else mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    # Words beyond the end add nothing, so the sum at a short text's first word, cut to its
    # own words, is its sequence.
    sums = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        sums[:n - k] += words[k:] * places[k]
    hashes = mix(sums)
    edges = np.searchsorted(row, np.arange(len(offsets)))
    sets = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= width:
            own = np.sort(hashes[a:b - width + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            short = (words[a:b] * places[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(hashes[:0])
    return sets


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of each text of a column, NULL read as empty."""
    for _, _, data, offsets in byte_blocks(texts):
        yield from block_sets(data, offsets, width)
