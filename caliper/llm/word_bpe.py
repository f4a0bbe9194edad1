"""Merge tables of a word-level BPE vocabulary and its way of cutting texts into words.

The vocabulary file is a parameter (a ``tokenizers`` JSON file whose model is BPE with an
end-of-word suffix).  Its pipeline is: special strings are found in the raw text; the
rest is NFC-normalised, white space runs become one space, letters are lower-cased; words
are contractions, letter runs, single digits or symbol runs; a word's UTF-8 bytes are the
first symbols, the last one carrying the suffix.  No word crosses white space, so a text
is the sequence of its white-space-free *chunks* and each distinct chunk is solved once
for a batch.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

# fixed values: white space of the tokenizer's pattern, and its contractions
SPACES = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SUFFIX = "</w>"

_SPLIT = re.compile(f"[{SPACES}]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")  # str.split() takes these for white space, the pattern doesn't
_WORDS = regex.compile("|".join(CONTRACTIONS) + r"|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
_ASCII_WORDS = re.compile("|".join(CONTRACTIONS) + r"|[a-z]+|[0-9]|[^a-z0-9]+")

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def chunks(text: str) -> list[str]:
    """The white-space-free runs of a text, white space as the tokenizer takes it."""
    if any(c in text for c in _ODD):
        return [c for c in _SPLIT.split(text) if c]
    return text.split()


def ends_in_space(text: str) -> bool:
    return bool(_SPLIT.fullmatch(text[-1:]))


def starts_in_space(text: str) -> bool:
    return bool(_SPLIT.fullmatch(text[:1]))


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (no special final sigma).  White space runs
    stay; :func:`chunks` drops them."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def words(chunk: str) -> list[str]:
    """The words of a normalised chunk that isn't all letters; together they are the chunk."""
    return (_ASCII_WORDS if chunk.isascii() else _WORDS).findall(chunk)


class Table:
    """A fixed map from 64-bit keys to non-negative integers, looked up array-wise."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, EMPTY, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        todo = np.arange(len(keys))
        at = ((keys * MULTIPLIER) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[at[todo]] == EMPTY
            first = np.zeros(len(todo), bool)  # one new key a slot and turn
            first[np.unique(at[todo], return_index=True)[1]] = True
            put = free & first
            self.keys[at[todo[put]]] = keys[todo[put]]
            self.values[at[todo[put]]] = values[todo[put]]
            todo = todo[~put]
            at[todo] = (at[todo] + (self.keys[at[todo]] != EMPTY)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        at = ((keys * MULTIPLIER) >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        todo = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != EMPTY)]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Tables of a vocabulary.  Inside, a token is its *order*: first symbols come first,
    then tokens by merge rank; ``ids`` maps orders to the file's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if spec["model"].get("end_of_word_suffix") != SUFFIX:
            raise ValueError(f"{path}: a BPE model with the end-of-word suffix {SUFFIX} is needed")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        alphabet = byte_alphabet()
        self.names = np.array([*alphabet, *(c + SUFFIX for c in alphabet), *(a + b for a, b in merges)], dtype=object)
        order = {name: i for i, name in enumerate(self.names)}
        if len(order) != len(self.names):
            raise ValueError(f"{path}: two merges make the same token")
        self.ids = np.array([vocab[name] for name in self.names], np.int64)
        left = np.array([order[a] for a, _ in merges], np.int64)
        right = np.array([order[b] for _, b in merges], np.int64)
        made = np.arange(512, len(self.names), dtype=np.int64)
        base = np.arange(512, dtype=np.int64)
        self.left, self.right = np.concatenate([base, left]), np.concatenate([base, right])
        self.pairs = Table(self.pair_key(left, right), made)
        self.text_of = {int(i): name for name, i in vocab.items()} | {i: s for s, i in self.specials.items()}

    @staticmethod
    def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two neighbours merge to, -1 if they don't."""
        return self.pairs.find(self.pair_key(a, b))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The tables of a vocabulary file, once a worker."""
    return WordBpe(path)


def by_width(items: list[bytes], least: int = 8) -> list[tuple[int, np.ndarray]]:
    """Indexes of byte strings grouped by their length rounded up to a power of two."""
    lengths = np.array([len(x) for x in items], np.int64)
    width = np.maximum(least, 2 ** np.ceil(np.log2(np.maximum(1, lengths))).astype(np.int64))
    return [(int(w), np.flatnonzero(width == w)) for w in np.unique(width)]


def matrix(items: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix (-1 after their end) and their lengths."""
    lengths = np.array([len(x) for x in items], np.int64)
    rows = np.full((len(items), width), -1, np.int16)
    rows[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(items), np.uint8)
    return rows, lengths


class Chunked:
    """Solves texts chunk by chunk with a bounded memory of solved chunks.

    ``solve(list of words as bytes) -> list`` answers for distinct words in one array
    computation; ``join(words, answers)`` makes the answer of a chunk of several words (or
    of a contraction); ``special(string)`` answers for a special string.  The memory has
    two generations: when the young one has ``room`` chunks it becomes the old one, so
    frequent chunks stay and rare ones go."""

    def __init__(self, model: WordBpe, solve, join, special, room: int = 60_000):
        self.model, self.solve, self.join, self.special, self.room = model, solve, join, special, room
        self.young: dict = {}
        self.old: dict = {}

    def texts(self, texts: list[str]) -> list[list]:
        """For each text the answers of its chunks (specials included), in order."""
        cut = [self.parts(t) for t in texts]
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        new = {c for part in cut for c in part if c not in known}
        for c in new & old.keys():
            known[c] = old[c]
            new.discard(c)
        for c in [c for c in new if type(c) is tuple]:
            known[c] = self.special(c[0])
            new.discard(c)
        if new:
            plain = [c for c in new if c.isalpha()]  # one word each
            mixed = [(c, words(c)) for c in new.difference(plain)]
            more = {w for _, ws in mixed for w in ws}
            distinct = [*plain, *more.difference(plain)]
            answers = self.solve([w.encode() for w in distinct])
            known.update(zip(plain, answers))
            if mixed:
                answer = dict(zip(distinct, answers, strict=True))
                for c, ws in mixed:
                    known[c] = answer[c] if len(ws) == 1 and c[0] != "'" else self.join(ws, [answer[w] for w in ws])
        return [[known[c] for c in part] for part in cut]

    def parts(self, text: str) -> list:
        """Normalised chunks in order; a special string is a one-element tuple."""
        at = self.model.special_at
        if at is None or "<|" not in text or not at.search(text):
            return chunks(normalise(text))
        out, end = [], 0
        for m in at.finditer(text):
            out += chunks(normalise(text[end : m.start()]))
            out.append((m[0],))
            end = m.end()
        return out + chunks(normalise(text[end:]))
