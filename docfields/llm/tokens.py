"""Token ids of whole Arrow batches of text: every different word of a task is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from docfields.llm import text as T

#: Slots of the table of words that a worker remembers: 12 bytes each, and about 40 bytes for each word in one.
SLOTS = 1 << 22
#: Words that a table holds before it starts anew.
REMEMBERED = 1 << 21

Encode = Callable[[T.Words, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _grown(held: np.ndarray, used: int, more: int) -> np.ndarray:
    """An array with room for ``more`` entries after the used ones; it doubles, so that appending costs what is appended."""
    if used + more <= len(held):
        return held
    out = np.empty(max(2 * len(held), used + more), held.dtype)
    out[:used] = held[:used]
    return out


class WordTable:
    """Encodes texts word by word; right for tokenizers whose tokens never cross ASCII white space.

    encode: (words of a piece, places of some) -> their ids in a row, and how many each has. A word's hash chooses its slot; a word that
    finds another one there is encoded again and takes the slot over, so that all words of a piece are looked up at once."""

    def __init__(self, encode: Encode, slots: int = SLOTS, remembered: int = REMEMBERED):
        self.encode, self.slots, self.remembered = encode, np.uint64(slots - 1), remembered
        self.keys, self.held = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.held.fill(-1)
        self.known = self.used = 0
        self.flat = np.empty(1 << 12, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)

    def numbers(self, words: T.Words) -> np.ndarray:
        """The table's number of every word of a piece; new words are encoded."""
        if self.known > self.remembered:
            self._clear()
        slot = (words.hashes & self.slots).astype(np.int64)
        numbers = np.where(self.keys[slot] == words.hashes, self.held[slot], -1).astype(np.int64)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            different, first, inverse = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
            flat, counts = self.encode(words, missing[first])
            new = np.arange(self.known, self.known + len(different))
            numbers[missing] = new[inverse]
            slot = (different & self.slots).astype(np.int64)
            self.keys[slot] = different
            # where two new words meet in a slot, both arrays must hold the same one
            held = self.keys[slot] == different
            self.held[slot[held]] = new[held]
            self.flat = _grown(self.flat, self.used, len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts = _grown(self.starts, self.known + 1, len(counts))
            self.starts[self.known + 1 : self.known + 1 + len(counts)] = self.used + np.cumsum(counts)
            self.known, self.used = self.known + len(counts), self.used + len(flat)
            self.added(flat, counts)
        return numbers

    def added(self, flat: np.ndarray, counts: np.ndarray) -> None:
        """Called with the ids of words that are new in the table."""

    def ids(self, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece, and where each document's begin (one more than documents)."""
        return self.ids_of(self.numbers(words), words.first)

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.starts[numbers + 1] - self.starts[numbers]

    def ids_of(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts_of(numbers)
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.starts[numbers] - total[:-1], counts) + np.arange(total[-1])
        return self.flat[at], total[first]


_tables: dict[tuple, WordTable] = {}
#: Words that the library encodes in one text, with an added token between two.
JOINED = 500


def _library(path: str) -> Encode:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # a special token is cut out before anything else happens to a text, so its neighbours are encoded as if alone
    special = next(((t.content.encode(), i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip and not t.single_word), None)

    def plain(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def encode(words: T.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined, ends = words.joined(at, special[0] if special else b"")
        if special is None or joined.count(special[0]) != len(at):
            return plain([words.word(i).decode() for i in at.tolist()])
        cuts = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), len(joined)]
        texts = [joined[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        stops = np.flatnonzero(flat == special[1])
        return np.delete(flat, stops), np.diff(np.concatenate([[-1], stops])) - 1

    return encode


def library_table(path: str) -> WordTable:
    """The tokenizers library's ids for a vocabulary file; one table a process."""
    if ("library", path) not in _tables:
        _tables["library", path] = WordTable(_library(path))
    return _tables["library", path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the named public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
