"""Token counts by prefix dynamic programming.

A word's BPE tokens are known from its prefixes: the tokens of a prefix are those of a
shorter prefix plus one last token, and of all vocabulary tokens that end the prefix
exactly one may follow the shorter prefix's last token, namely the one that no earlier
merge across the seam would break.  Going through the prefixes by length therefore stores
the exact token count of *every* prefix, with and without the end-of-word suffix, and no
text is ever encoded again to answer "how many tokens are the first n characters" or
"where must this text be cut to fit a budget".

Prefixes of all distinct words of a batch form a trie; each level of it is one array
computation, so a prefix that many words share is solved once.

Positions are code points of the text as the tokenizer normalises it (NFC, one space for
each white space run, lower case; special strings of the raw text stay as they are and
count once they are complete).

Cases: a null or empty text has no prefixes and 0 tokens; a null id stays null; repeated
rows are counted each for itself; a very long text is solved word by word, its prefix counts
are one array; an empty table gives no rows; other columns of the table are not read and may
have any name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm import store
from caliper.llm.bpe_codec import SegmentTrees
from caliper.llm.word_bpe import (CONTRACTIONS, EMPTY, Chunked, Table, WordBpe, by_width, ends_in_space, load,
                                  matrix, starts_in_space)

SCHEMA = "doc_id long, n_bytes long, prefix_counts array<int>"
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _spelled(items: list[bytes]) -> np.ndarray:
    """64-bit keys of byte strings, read from the last byte to the first."""
    rows, lengths = matrix(items, max(map(len, items)))
    key = np.zeros(len(items), np.uint64)
    for back in range(1, rows.shape[1] + 1):
        live = lengths >= back
        byte = rows[np.flatnonzero(live), lengths[live] - back].astype(np.uint64)
        key[live] = key[live] * _BASE + byte + np.uint64(1)
    return key


class Prefixes:
    """Counts for all prefixes of words, from a vocabulary's merge tables."""

    def __init__(self, model: WordBpe):
        self.model = model
        byte_of = {name: b for b, name in enumerate(model.names[:256])}
        spelled = [bytes(byte_of[c] for c in name.removesuffix("</w>")) if len(name) > 1 else bytes([byte_of[name]]) for name in model.names]
        final = np.array([i >= 256 and (i < 512 or name.endswith("</w>")) for i, name in enumerate(model.names)])
        self.longest = max(map(len, spelled))
        keys = _spelled(spelled)
        every = np.arange(len(spelled))
        whole = self._whole(spelled, final)  # no text has a token that its own bytes don't merge to
        self.inner = Table(keys[~final & whole], every[~final & whole])
        self.final = Table(keys[final & whole], every[final & whole])
        if len(np.unique(keys[~final])) < (~final).sum() or len(np.unique(keys[final])) < final.sum() or (keys == EMPTY).any():
            raise ValueError("two tokens have the same key")

    def _whole(self, spelled: list[bytes], final: np.ndarray) -> np.ndarray:
        """Which tokens their own bytes merge to."""
        whole = np.zeros(len(spelled), bool)
        for width, members in by_width(spelled):
            trees = SegmentTrees(self.model, *matrix([spelled[i] for i in members], width), final[members])
            trees.run()
            whole[members] = trees.token[:, 0] == members
        return whole

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b together would leave just a and b:
        undo the latest merge beside the seam again and again, and see that no pair across
        the seam would have merged before it.  -1 as a: b starts the word, and anything may."""
        m = self.model
        far = np.int64(1 << 40)
        ok = np.zeros(len(a), bool)
        ok[a < 0] = True
        at = np.flatnonzero(a >= 0)
        x, y, limit = a[at].copy(), b[at].copy(), np.full(len(at), far)
        while len(at):
            joint = m.merged(x, y)
            keep = ~((joint >= 0) & (joint < limit))
            at, x, y, limit = at[keep], x[keep], y[keep], limit[keep]
            first = x > y
            opened_x, opened_y = m.right[x], m.left[y]
            whole_x, whole_y = opened_x == x, opened_y == y
            # the later token is opened; if it is a first symbol, the other one; if both are, the seam holds
            open_x = (first & ~whole_x) | (~first & whole_y & ~whole_x)
            open_y = (~first & ~whole_y) | (first & whole_x & ~whole_y)
            done = whole_x & whole_y
            limit = np.where(open_x, x, np.where(open_y, y + 1, limit))
            x, y = np.where(open_x, opened_x, x), np.where(open_y, opened_y, y)
            ok[at[done]] = True
            go = ~done
            at, x, y, limit = at[go], x[go], y[go], limit[go]
        return ok

    def _step(self, table: Table, rows, spot, level, node, last, count):
        """For prefixes (row, length level) the last token and the count."""
        found, counts = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        key = np.zeros(len(rows), np.uint64)
        for back in range(1, min(level, self.longest) + 1):
            at = rows[todo]
            key = key * _BASE + spot[at, level - back].astype(np.uint64) + np.uint64(1)
            token = table.find(key)
            hit = np.flatnonzero(token >= 0)
            if len(hit):
                before = node[at[hit], level - back]
                good = self.may_follow(np.where(level == back, -1, last[before]), token[hit])
                won = hit[good]
                found[todo[won]] = token[won]
                counts[todo[won]] = count[before[good]] + 1
                rest = np.ones(len(todo), bool)
                rest[won] = False
                todo, key = todo[rest], key[rest]
                if not len(todo):
                    break
        return found, counts

    def solve(self, items: list[bytes]) -> list[bytes]:
        """For each distinct word the token counts of its prefixes that end at a code
        point, each prefix taken as a word of its own, and the last count once more for a
        space after the word: little-endian 32-bit integers."""
        out: list = [None] * len(items)
        for width, members in by_width(items):
            members = sorted(members, key=items.__getitem__)
            spot, lengths = matrix([items[i] for i in members], width)
            same = np.logical_and.accumulate(spot[1:] == spot[:-1], axis=1).sum(1)
            shared = np.concatenate([[0], same])  # bytes shared with the word before
            node = np.zeros((len(members), width + 1), np.int64)  # number of each prefix; 0: the empty one
            size = 1 + int(np.maximum(lengths - shared, 0).sum())
            last, count = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            ended = np.full((len(members), width), -1, np.int64)
            n = 1
            for level in range(1, int(lengths.max()) + 1):
                alive = lengths >= level
                fresh = alive & (shared < level)
                rows = np.flatnonzero(fresh)
                here = np.cumsum(fresh) - 1  # number within the level
                node[:, level] = np.where(alive, n + here, 0)
                last[n : n + len(rows)], count[n : n + len(rows)] = self._step(self.inner, rows, spot, level, node, last, count)
                if (last[n : n + len(rows)] < 0).any():
                    raise ValueError("a prefix has no tokens")
                # the prefix counts as a whole word only where a code point ends
                following = spot[:, level] if level < width else np.full(len(members), -1)
                ends = alive & ~((following >= 0x80) & (following < 0xC0))
                whole = np.full(len(rows), -1, np.int64)
                asked = np.flatnonzero(ends[rows])
                whole[asked] = self._step(self.final, rows[asked], spot, level, node, last, count)[1]
                ended[ends, level - 1] = whole[here[ends]]
                n += len(rows)
            tail = ended[np.arange(len(members)), lengths - 1]
            full = np.concatenate([ended, tail[:, None]], axis=1).astype("<i4")
            keep = full >= 0
            keep[:, :-1] &= np.arange(width)[None, :] < lengths[:, None]
            stops = (4 * np.cumsum(keep.sum(1))).tolist()
            flat = full[keep].tobytes()
            for i, start, stop in zip(members, [0, *stops], stops):
                out[i] = flat[start:stop]
        return out


def _join(ws: list[str], answers: list[bytes]) -> bytes:
    """Counts for all prefixes of a chunk, and once more the last for the space after it."""
    flat: list[int] = []
    total = 0
    for w, a in zip(ws, answers, strict=True):
        own = array("i", a)[:-1]
        if w in CONTRACTIONS and len(w) == 3:  # of "'re" the part "'r" is two words
            own = (1, 2, own[-1])
        flat += [total + x for x in own] if total else own
        total = flat[-1]
    flat.append(total)
    return array("i", flat).tobytes()


def _special(name: str) -> bytes:
    """A special string counts when it is complete."""
    return np.array([0] * (len(name) - 1) + [1, 1], "<i4").tobytes()


class Counter:
    """Prefix counts of whole texts."""

    def __init__(self, path: str):
        self.prefixes = Prefixes(load(path))
        self.chunked = Chunked(self.prefixes.model, self.prefixes.solve, _join, _special)

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text, tables in zip(texts, self.chunked.texts(texts), strict=True):
            if not tables:
                out.append(np.zeros(1 if text else 0, np.int32))
                continue
            flat = np.frombuffer(b"".join(tables), "<i4")
            ends = np.cumsum([len(t) >> 2 for t in tables])
            totals = np.cumsum(flat[ends - 1])
            base = np.concatenate([[0], totals[:-1]]).astype(np.int32)
            full = flat + np.repeat(base, np.diff(ends, prepend=0))
            if "<|" in text:
                full = full[self._spaced(text, ends, len(full))]
            elif not ends_in_space(text):
                full = full[:-1]
            if starts_in_space(text):
                full = np.concatenate([np.zeros(1, np.int32), full])
            out.append(full)
        return out

    def _spaced(self, text: str, ends: np.ndarray, n: int) -> np.ndarray:
        """Which entries stay: the one for the space after a chunk only if there is one."""
        at = self.chunked.model.special_at
        keep = np.ones(n, bool)
        last, spaced = -1, False  # the chunk or special string before the cut, and whether a space follows it
        cuts = [0, *(x for m in at.finditer(text) for x in m.span()), len(text)]
        for piece in (text[start:stop] for start, stop in zip(cuts, cuts[1:]) if start < stop):
            if last >= 0:
                keep[ends[last] - 1] = spaced or starts_in_space(piece)
            last += len(self.chunked.parts(piece))
            spaced = ends_in_space(piece)
        keep[ends[-1] - 1] = spaced
        return keep


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def prefix_token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, prefix_counts`` for every row: entry i is the exact token count
    of the normalised text's first i + 1 code points.  Narrow: no shuffle."""
    store.ready(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for part in store.slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts = counter.counts(texts)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(counts), pa.int32()))
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, lists], ["doc_id", "n_bytes", "prefix_counts"])

    return store.as_text(df, id_col, text_col).mapInArrow(count, SCHEMA)


def total_tokens(prefix_counts: Column) -> Column:
    """Tokens of the whole text: the count of its longest prefix."""
    return F.when(F.size(prefix_counts) > 0, F.element_at(prefix_counts, -1)).otherwise(0).cast("long")


def tokens_of_prefix(prefix_counts: Column, n: Column) -> Column:
    """Tokens of the first ``n`` code points of the normalised text (0 for n <= 0, all
    tokens for n beyond the end)."""
    n = F.least(n, F.size(prefix_counts))
    return F.when(n <= 0, F.lit(0)).otherwise(F.get(prefix_counts, n - 1)).cast("long")


def longest_within(prefix_counts: Column, budget: int) -> Column:
    """The length of the longest prefix of at most ``budget`` tokens.  (A longer prefix
    may have fewer tokens, so this is the last fitting entry, not the first misfit.)"""
    fits = F.transform(prefix_counts, lambda c: c <= F.lit(budget))
    return F.when(F.array_contains(fits, True), F.size(fits) - F.array_position(F.reverse(fits), True) + 1).otherwise(0).cast("long")
