"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as a row of first symbols.  Leaf i of its tree holds the merge order of the
pair that starts at symbol i (infinity where the pair doesn't merge); every inner node
holds the smaller of its two children, a tie going left.  The root therefore names the
leftmost pair of lowest rank.  Merging it changes at most three leaves: the pair itself,
the one before it, and the one that vanishes; each is updated along its path to the root,
until the root is infinity.  The trees of all distinct words of a batch that have the same
number of leaves are rows of one array and take their steps together.

Cases: a null or empty text has no ids and decodes to the empty text; a null id stays
null; repeated rows are coded each for itself; pairs of equal rank merge from the left; a very
long text is coded word by word; an empty table gives no rows; other columns of the table are
not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caliper.llm import store
from caliper.llm.word_bpe import Chunked, WordBpe, by_width, load, matrix

_FAR = np.int64(1) << 62
_LOW = np.int64((1 << 32) - 1)


class SegmentTrees:
    """The merge trees of equally wide words."""

    def __init__(self, model: WordBpe, rows: np.ndarray, lengths: np.ndarray, suffix: np.ndarray | bool = True):
        self.model = model
        n, width = rows.shape
        self.width = width
        self.token = rows.astype(np.int64)
        self.token[np.arange(n), lengths - 1] += np.where(suffix, 256, 0)  # the last symbol carries the suffix
        self.next = np.minimum(np.arange(1, width + 1)[None, :], lengths[:, None])  # the word's length: none
        self.before = np.tile(np.arange(-1, width - 1), (n, 1))
        self.lengths = lengths
        self.alive = np.arange(width)[None, :] < lengths[:, None]
        self.tree = np.full((n, 2 * width), _FAR)
        pair_row, pair_at = np.nonzero(np.arange(width)[None, :] < lengths[:, None] - 1)
        self._leaf(pair_row, pair_at, pair_at + 1)
        for first in (1 << k for k in reversed(range(width.bit_length() - 1))):
            level = self.tree[:, 2 * first : 4 * first]
            self.tree[:, first : 2 * first] = np.minimum(level[:, 0::2], level[:, 1::2])

    def _leaf(self, row: np.ndarray, at: np.ndarray, following: np.ndarray) -> None:
        made = self.model.merged(self.token[row, at], self.token[row, following])
        self.tree[row, self.width + at] = np.where(made >= 0, (made << 32) | at, _FAR)

    def _climb(self, row: np.ndarray, at: np.ndarray) -> None:
        node = (self.width + at) >> 1
        while len(node) and node[0]:
            self.tree[row, node] = np.minimum(self.tree[row, 2 * node], self.tree[row, 2 * node + 1])
            node >>= 1

    def run(self) -> None:
        """Merge until no word has a mergeable pair."""
        row = np.flatnonzero(self.tree[:, 1] < _FAR)
        while len(row):
            root = self.tree[row, 1]
            at, made = root & _LOW, root >> 32
            gone = self.next[row, at]
            after = self.next[row, gone]
            self.token[row, at] = made
            self.next[row, at] = after
            self.alive[row, gone] = False
            self.tree[row, self.width + gone] = _FAR
            self.tree[row, self.width + at] = _FAR
            more = after < self.lengths[row]
            self.before[row[more], after[more]] = at[more]
            self._leaf(row[more], at[more], after[more])
            earlier = self.before[row, at]
            has = earlier >= 0
            self._leaf(row[has], earlier[has], at[has])
            self._climb(row, gone)
            self._climb(row, at)
            self._climb(row[has], earlier[has])
            row = row[self.tree[row, 1] < _FAR]


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, path: str):
        self.model = load(path)
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.model.specials.items()}
        self.chunked = Chunked(self.model, self.solve, lambda _, ids: b"".join(ids), special.__getitem__)

    def solve(self, items: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(items)
        for width, members in by_width(items):
            for some in np.array_split(members, max(1, len(members) * width // (1 << 20))):
                trees = SegmentTrees(self.model, *matrix([items[i] for i in some], width))
                trees.run()
                ids = self.model.ids[trees.token[trees.alive]].astype("<u4").tobytes()
                ends = 4 * np.cumsum(trees.alive.sum(1))
                for i, start, end in zip(some.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    out[i] = ids[start:end]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(parts) for parts in self.chunked.texts(texts)]

    def decode(self, ids: bytes) -> str:
        """The token strings one space apart: the vocabulary file names no decoder, and
        that is what its library makes of it then.  Special strings are kept."""
        return " ".join(map(self.model.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: every whole text's ids as little-endian unsigned 32-bit integers
    in one binary value.  Narrow: no shuffle."""
    return _run(store.as_text(df, id_col, text_col), vocabulary, decoded=False)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: every whole text encoded, and its ids decoded again, in one
    pass and one Python worker a task."""
    return _run(store.as_text(df, id_col, text_col), vocabulary, decoded=True)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded`` from :func:`encode`'s rows."""
    return _run(encoded.select("doc_id", "ids"), vocabulary, decoded=True)


def _run(df: DataFrame, vocabulary: str, decoded: bool) -> DataFrame:
    store.ready(df.sparkSession)
    source = df.columns[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in store.slices(batches, source):
            given = part.column(source).to_pylist()
            ids = [x or b"" for x in given] if source == "ids" else own.encode([t or "" for t in given])
            columns = {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([own.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return df.mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)
