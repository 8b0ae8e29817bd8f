"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every different word. A proposal is the BPE encoding if each token encodes to
itself and each adjacent pair of tokens, put together, encodes to just that pair; all pairs of a batch are tested at
once against a table of known pairs. Only words with a failing pair are merged exactly, by rank.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docfields.llm import text as T
from docfields.llm.tokens import REMEMBERED, SLOTS, WordTable, _tables

END = "</w>"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _stretch_hash(data: bytes, last: bool) -> int:
    """The hash by which ``propose`` looks a stretch of bytes up."""
    total = 0
    for k, b in enumerate(data):
        total += (b + 1) * pow(int(_ODD), k, 1 << 64)
    return int(T.mix(np.array([(total + (2 * len(data) + last) * int(_TAIL)) % (1 << 64)], np.uint64))[0])


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is a visible Latin-1 one, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary file of the tokenizers library with NFC, lower case, a split pattern, bytes as characters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = {i: t for t, i in (self.ids | self.special).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = len(self.words) + 1
        codes = np.array([self.ids[a] * self.width + self.ids[b] for a, b in merges], np.int64)
        by = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[by], by
        self.made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        spaces = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{spaces}"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        characters = byte_characters()
        self.byte_ids = np.array([self.ids[c] for c in characters], np.int64)
        self.end_ids = np.array([self.ids[c + END] for c in characters], np.int64)
        byte_of = {c: b for b, c in enumerate(characters)}
        stretches = []
        for t, i in self.ids.items():
            body = t.removesuffix(END)
            if body:
                stretches.append((bytes(byte_of[c] for c in body), body != t, i))
        self.longest = max(len(b) for b, _, _ in stretches)
        hashes = np.array([_stretch_hash(b, last) for b, last, _ in stretches], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hashed = hashes[order], np.array([i for _, _, i in stretches], np.int64)[order]
        self.texts = np.array([self.words.get(i, "") for i in range(max(self.words) + 1)], object)
        self.pairs = np.zeros(0, np.int64)  # known ones, sorted
        self.fits = np.zeros(0, bool)

    def pieces(self, word: str) -> list[bytes | int]:
        """The pattern's parts of a word as bytes; an added token's text is its id."""
        if word.isalpha() and word.isascii():
            return [word.lower().encode()]
        out: list[bytes | int] = []
        for part in self.split.split(word) if self.split and "<" in word else [word]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out += [part.encode()] if part.isalpha() else [x.encode() for x in self.pattern.findall(part)]
        return out

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for all parts at once: (part, token) of every proposed token, in order.

        A stretch of bytes is looked up by its hash, made from running sums, its length, and whether it ends its part."""
        place = np.multiply.accumulate(np.full(len(data) + 1, _ODD, np.uint64))
        back = np.multiply.accumulate(np.full(len(data) + 1, _ODD_INVERSE, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * place[:-1], dtype=np.uint64)])
        at, part = starts.copy(), np.arange(len(starts))
        parts, tokens = [], []
        while len(at):
            found = np.full(len(at), -1, np.int64)
            step = np.zeros(len(at), np.int64)
            open_ = np.arange(len(at))
            for length in range(min(self.longest, int((ends[part] - at).max())), 0, -1):
                own = open_[at[open_] + length <= ends[part[open_]]]
                i = at[own]
                last = (i + length == ends[part[own]]).astype(np.uint64)
                hashes = T.mix((total[i + length] - total[i]) * back[i] + (np.uint64(2 * length) + last) * _TAIL)
                k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                hit = self.hashes[k] == hashes
                found[own[hit]], step[own[hit]] = self.hashed[k[hit]], length
                open_ = open_[found[open_] < 0]
                if not len(open_):
                    break
            parts.append(part)
            tokens.append(found)
            at = at + step
            go_on = at < ends[part]
            at, part = at[go_on], part[go_on]
        parts, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, tokens))
        by = np.argsort(parts, kind="stable")
        return parts[by], tokens[by]

    def symbols(self, token: int) -> list[int]:
        text = self.words[token]
        body = text.removesuffix(END)
        chars = list(body)
        if body != text:
            chars[-1] += END
        return [self.ids[c] for c in chars]

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many sequences in a row: in each, always the leftmost pair of the least rank. (ids, counts) again."""
        none = np.int64(len(self.pair_codes))
        symbols, owner = symbols.astype(np.int64), np.repeat(np.arange(len(counts)), counts)
        done_ids, done_owner = [], []
        while len(symbols):
            # ranks of the pair that each symbol begins
            rank = np.full(len(symbols), none)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            codes = symbols[inner] * self.width + symbols[inner + 1]
            k = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
            rank[inner] = np.where(self.pair_codes[k] == codes, self.pair_ranks[k], none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == none, np.diff(np.append(first, len(symbols))))
            done_ids.append(symbols[over])
            done_owner.append(owner[over])
            lows = np.flatnonzero(~over & (rank == np.repeat(least, np.diff(np.append(first, len(symbols))))))
            at = lows[np.append(True, owner[lows[1:]] != owner[lows[:-1]])[: len(lows)]]
            symbols[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        ids, owners = np.concatenate(done_ids) if done_ids else symbols, np.concatenate(done_owner) if done_owner else owner
        by = np.argsort(owners, kind="stable")
        return ids[by], np.bincount(owners, minlength=len(counts))

    def _known(self, codes: np.ndarray) -> np.ndarray:
        """Whether the pairs fit; a pair's code is left * width + right, with right = width - 1 for a token alone."""
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            new = np.unique(codes[self.pairs[at] != codes])
        else:
            new = np.unique(codes)
        if len(new):
            own = [[a] if b == self.width - 1 else [a, b] for a, b in zip((new // self.width).tolist(), (new % self.width).tolist())]
            split = [[s for t in o for s in self.symbols(t)] for o in own]
            ids, counts = self.merge(np.array([s for x in split for s in x], np.int64), np.array([len(x) for x in split]))
            ends = np.cumsum(counts)
            size = np.array([len(o) for o in own])
            fits = counts == size
            first = np.minimum(ends - counts, len(ids) - 1)
            fits &= (ids[first] == new // self.width) & ((size == 1) | (ids[np.minimum(first + 1, len(ids) - 1)] == new % self.width))
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, fits)
        return self.fits[np.searchsorted(self.pairs, codes)]

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many parts in a row, and how many each has: proposed, verified, and merged where a check fails."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        owner, tokens = self.propose(data, ends - sizes, ends)
        alone = self._known(tokens * self.width + self.width - 1)
        inner = owner[1:] == owner[:-1]
        pair = self._known((tokens[:-1] * self.width + tokens[1:])[inner])
        failing = np.zeros(len(parts), bool)
        failing[owner[~alone]] = True
        failing[owner[1:][inner][~pair]] = True
        again = np.flatnonzero(failing)
        if len(again):
            kept = ~failing[owner]
            letters = np.repeat(failing, sizes)
            symbols = self.byte_ids[data[letters]]
            symbols[np.cumsum(sizes[again]) - 1] = self.end_ids[data[ends[again] - 1]]
            ids, counts = self.merge(symbols, sizes[again])
            owner = np.concatenate([owner[kept], np.repeat(again, counts)])
            tokens = np.concatenate([tokens[kept], ids])
            by = np.argsort(owner, kind="stable")
            owner, tokens = owner[by], tokens[by]
        return tokens, np.bincount(owner, minlength=len(parts))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in a row, and how many each has."""
        number: dict[bytes, int] = {}
        refs, owner, special = [], [], []
        for k, w in enumerate(words):
            for p in self.pieces(w):
                if isinstance(p, int):
                    refs.append(-1)
                    special.append(p)
                else:
                    refs.append(number.setdefault(p, len(number)))
                owner.append(k)
        refs, owner = np.array(refs, np.int64), np.array(owner, np.int64)
        ids, counts = self.encode_parts(list(number)) if number else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # added tokens stand behind the parts, one each
        base = len(number)
        refs[refs < 0] = base + np.arange(len(special))
        ids, counts = np.concatenate([ids, np.array(special, np.int64)]), np.concatenate([counts, np.ones(len(special), np.int64)])
        starts = np.cumsum(counts) - counts
        sizes = counts[refs]
        total = np.cumsum(sizes) - sizes
        flat = ids[np.repeat(starts[refs] - total, sizes) + np.arange(sizes.sum())]
        return flat.astype(np.int32), np.bincount(owner, sizes, len(words)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file the library joins the tokens' texts by one space."""
        return " ".join([self.words[i] for i in ids])


class _Table(WordTable):
    """Beside a word's ids it keeps their decoded text."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        # their decoded texts are kept too
        super().__init__(lambda words, at: bpe.encode_words([words.word(i).decode() for i in at.tolist()]), SLOTS // 4, REMEMBERED // 8)

    def _clear(self) -> None:
        super()._clear()
        self.decoded: list[str] = []

    def added(self, flat: np.ndarray, counts: np.ndarray) -> None:
        tokens = self.bpe.texts[flat].tolist()
        ends = np.cumsum(counts).tolist()
        self.decoded += [" ".join(tokens[a:b]) for a, b in zip([0, *ends], ends)]


def table(path: str) -> _Table:
    if ("own", path) not in _tables:
        _tables["own", path] = _Table(Bpe(path))
    return _tables["own", path]


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(path)
        for batch in batches:
            for words in T.pieces(batch.column(1)):
                numbers = own.numbers(words)
                ids, bounds = own.ids_of(numbers, words.first)
                decoded = np.array(own.decoded, object)[numbers] if len(numbers) else np.zeros(0, object)
                if len(numbers) and not (own.counts_of(numbers) > 0).all():
                    texts = [" ".join([x for x in decoded[a:b].tolist() if x]) for a, b in zip(words.first[:-1], words.first[1:])]
                else:
                    texts = [" ".join(decoded[a:b].tolist()) for a, b in zip(words.first[:-1], words.first[1:])]
                columns = {"doc_id": batch.column(0).slice(words.row, words.docs), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), "decoded": pa.array(texts, pa.string())}
                for k, name in enumerate(batch.schema.names[2:], 2):
                    columns[name] = batch.column(k).slice(words.row, words.docs)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_and_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array of int), decoded, the text that the ids give, and the columns ``keep`` for every row of docs (doc_id, text).

    path: a vocabulary file that every worker can open. Null and empty texts have no ids and decode to the empty text. Rows come
    back one for one, also repeated ones and those without a doc_id; further columns are ignored. No shuffle.
    """
    kept = {f"keep_{k}": docs[c] for k, c in enumerate(keep)}
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[c.alias(k) for k, c in kept.items()])
    schema = "doc_id long, ids array<int>, decoded string" + "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    return rows.mapInArrow(_round_trip(path), schema).withColumnsRenamed(dict(zip(kept, keep)))
