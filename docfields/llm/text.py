"""Word arithmetic over whole Arrow batches of text.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; they get 64-bit hashes without any Python
loop over words. All functions take a pyarrow string array and work through it in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[list(SPACES)] = 0
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_MARK = _IS_SPACE.copy()
_IS_MARK[[b for b in range(128) if not chr(b).isalnum()]] = True
_BYTE_LETTERS = np.where(_IS_MARK, np.uint64(0), _BYTE_FOLDED)
_PLACE = np.multiply.accumulate(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_ODD = np.uint64(0xD6E8FEB86659FD93)
_ODD_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some documents: document d has words first[d]:first[d+1]."""

    data: np.ndarray  # uint8, the documents' bytes one after another
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray  # uint64
    row: int  # number of the first document in the batch
    prefixes: np.ndarray | None = None  # uint64, hashes of the words' first bytes

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, at: np.ndarray, end: bytes) -> tuple[bytes, np.ndarray]:
        """The words at these places in a row, each followed by ``end``, and where each stops after that."""
        sizes = self.ends[at] - self.starts[at]
        stops = np.cumsum(sizes + len(end))
        out = np.empty(int(stops[-1]) if len(at) else 0, np.uint8)
        inner = np.arange(int(sizes.sum()))
        before = np.cumsum(sizes) - sizes
        out[np.repeat(stops - len(end) - sizes - before, sizes) + inner] = self.data[np.repeat(self.starts[at] - before, sizes) + inner]
        if end:
            out[(stops - len(end))[:, None] + np.arange(len(end))] = np.frombuffer(end, np.uint8)
        return out.tobytes(), stops


def pieces(texts: pa.Array, fold: bool = False, most: int = PIECE_BYTES, prefix: int = 0) -> Iterator[Words]:
    """Cut a string array into pieces of about ``most`` bytes; null counts as the empty text.

    fold: A-Z count as a-z in the hashes. prefix: words end at any ASCII character but letters and digits as
    well, A-Z count as a-z, and the hashes of the words' first ``prefix`` bytes come along."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, fold, prefix)
        i = j


def _words(data: np.ndarray, bounds: np.ndarray, row: int, fold: bool, prefix: int) -> Words:
    filled = ~(_IS_MARK if prefix else _IS_SPACE)[data]
    begins = filled.copy()
    begins[1:] &= ~filled[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begins[inner] = filled[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64), row, np.zeros(0, np.uint64))
    finishes = filled.copy()
    finishes[:-1] &= ~filled[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    finishes[last] = filled[last]
    ends = np.flatnonzero(finishes) + 1
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    weighted = (_BYTE_LETTERS if prefix else _BYTE_FOLDED if fold else _BYTE)[data[starts[0] :]]
    if (ends - starts).max() > len(_PLACE):
        high = mix((place >> 12).astype(np.uint64)) | np.uint64(1)
        weighted *= _PLACE[place & 4095] * np.where(place > 4095, high, np.uint64(1))
    else:
        weighted *= _PLACE[place & 4095]
    hashes = mix(np.add.reduceat(weighted, starts - starts[0]) + (ends - starts).astype(np.uint64))
    prefixes = mix(np.add.reduceat(np.where(place < prefix, weighted, np.uint64(0)), starts - starts[0])) if prefix else None
    return Words(data, starts, ends, np.searchsorted(starts, bounds).astype(np.int64), hashes, row, prefixes)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words, in order; runs may cross documents (see ``inside``)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            out = out * _ODD + hashes[k : len(hashes) - n + 1 + k]
        return mix(out + np.uint64(n))
    powers = np.multiply.accumulate(np.full(len(hashes), _ODD, np.uint64))
    back = np.multiply.accumulate(np.full(len(hashes), _ODD_INVERSE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * back[: len(hashes) - n + 1] + np.uint64(n))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For every start of a run of n words: whether it ends in the document it begins in."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    return np.arange(total - n + 1) + n <= end


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of one sequence of any length."""
    out = np.multiply.accumulate(np.full(len(hashes), _ODD, np.uint64)) * hashes
    return mix(np.array([out.sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0]


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Each document's set of n-word shingles as a sorted array; with fewer words, the whole sequence is the one shingle."""
    runs, first = sequence_hashes(words.hashes, n), words.first
    out = []
    for d in range(words.docs):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(np.array([whole_hash(words.hashes[a:b])] if b > a else [], np.uint64))
    return out
