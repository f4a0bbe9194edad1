"""Packing of documents into token windows by multiway differencing.

A document is its ids and an end id.  What fills whole windows is cut off as such; what is
left over, and short documents, wait in a pool.  A full pool goes into k windows by the
differencing method of Karmarkar and Karp: every piece is a partial partition with one sum
in k slots; the two partial partitions with the largest imbalance are merged, the largest
slot of the one with the smallest of the other, until one is left, whose k sums are nearly
equal.  k is the least number that could hold all ids; when a window exceeds its capacity,
k rises.  Where over one window in ``SPARE`` would be added that way, the pieces are too
coarse: those longer than half the present limit are cut there, and k starts anew, so
documents are cut no finer than little padding asks for.

A pool holds at most ``POOL_IDS`` ids and ``POOL_PIECES`` pieces, so a task's memory hangs
on them and on the longest single text.  Nothing is shuffled; a task's windows are numbered
within it, and the written result keeps these numbers whatever later jobs do.

Ids are those of the tokenizers library.  Where a vocabulary file is a byte-level BPE whose
merges are in id order, texts are encoded by tiktoken with the same ranks, which gives the
same ids in less time (tests compare them); texts with special strings or very long runs
without white space, and other vocabularies, go to the library itself.

Cases: a null or empty text is its end id alone; a null doc_id stays null; rows that repeat
an id are documents of their own; other columns aren't read; an empty table has no windows.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm import store
from caliper.llm.token_store import SPACE

POOL_IDS = 512 * 1024
POOL_PIECES = 4096
SPARE = 128
FINEST = 32
LONG_RUN = 2000
_SCHEMA = "sequence_id long, ids binary, pieces array<struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long>>"
# fixed value: how byte-level BPE cuts a text into words
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SINGLE = _PATTERN.replace(r"|\s+(?!\S)", "")  # cuts the same way where white space is single characters


class Encoder:
    """Ids of whole texts as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick, self.single = _same_ranks(path) or (None, None)

    def encode(self, text: str, long_runs: bool, spaces: bool = True) -> np.ndarray:
        """``long_runs``: the text may have very long runs without white space; ``spaces``: it
        may have white space next to white space, which alone needs a look ahead."""
        if self.quick is None or any(s in text for s in self.specials) or (long_runs and _longest_run(text.encode()) >= LONG_RUN):
            return np.array(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids), np.uint32)
        return (self.quick if spaces else self.single).encode_to_numpy(text, disallowed_special=())


def _longest_run(data: bytes) -> int:
    space = np.flatnonzero(np.frombuffer(data, np.uint8) <= 32)
    return int(np.diff(space, prepend=-1, append=len(data)).max()) - 1


def _same_ranks(path: str):
    """Two tiktoken encodings with a vocabulary file's ranks, for all texts and for those
    without white space next to white space, or None where the file is more than a
    byte-level BPE with merges in id order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    if told["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if any((model.get(k) or False) != (v or False) for k, v in plain.items()):
        return None
    ids = {}
    byte_of = _byte_letters()
    added = {t["content"] for t in told["added_tokens"]}
    for token, i in model["vocab"].items():
        if token not in added:
            if not set(token) <= byte_of.keys():
                return None
            ids[bytes(byte_of[c] for c in token)] = i
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or sorted(ids.values()) != list(range(256 + len(merged))):
        return None
    return tuple(tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ids, special_tokens={}) for p in (_PATTERN, _SINGLE))


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes: printable Latin-1 ones for themselves, the
    other bytes in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each piece by multiway differencing.

    A partial partition is the falling sums of its filled slots (further ones are empty)
    and, for each, the first piece of the slot's chain of pieces."""
    n = len(sizes)
    after, last = np.full(n, -1), np.arange(n)
    if k == 1:
        return np.zeros(n, np.int64)
    sizes = np.asarray(sizes, np.int64)
    heap = [(-s, i, None, None) for i, s in enumerate(sizes.tolist())]  # pieces by themselves
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        key, at, a, a_first = heapq.heappop(heap)
        if at < n:
            a, a_first = sizes[at : at + 1], np.array([at])
        _, at, b, b_first = heapq.heappop(heap)
        if at < n:
            # while a has empty slots and the largest imbalance, it takes one piece after the other: all at a time
            more = [at]
            while heap and len(a) + len(more) < k and heap[0][1] < n and heap[0][0] > key:
                more.append(heapq.heappop(heap)[1])
            b, b_first = sizes[more], np.array(more)
            turn += len(more) - 1
        over = len(a) + len(b) - k
        if over == 1 and min(len(a), len(b)) == 1:  # one piece meets the smallest slot, whose sum moves up
            full, firsts = (b, b_first) if len(a) == 1 else (a, a_first)
            x, y = a_first[-1], b_first[-1]
            after[last[x]] = y
            last[x] = last[y]
            total = a[-1] + b[-1]
            spot = k - 1 - int(full[-2::-1].searchsorted(total, "right" if len(a) == 1 else "left"))  # among equal sums a's come first
            full[spot + 1 :], firsts[spot + 1 :] = full[spot:-1], firsts[spot:-1]
            full[spot], firsts[spot] = total, x
            heapq.heappush(heap, (int(full[-1] - full[0]), turn, full, firsts))
            turn += 1
            continue
        if over > 0:  # the smallest slots of either meet the other's, largest with smallest
            x, y = a_first[len(a) - over :], b_first[::-1][:over]
            after[last[x]] = y
            last[x] = last[y]
            a = np.concatenate([a[: len(a) - over], a[len(a) - over :] + b[::-1][:over]])
            b, b_first = b[: len(b) - over], b_first[: len(b_first) - over]
        sums, firsts = np.concatenate([a, b]), np.concatenate([a_first, b_first])
        order = np.argsort(-sums, kind="stable")
        sums, firsts = sums[order], firsts[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), turn, sums, firsts))
        turn += 1
    window = np.empty(n, np.int64)
    firsts = heap[0][3] if n > 1 else np.arange(n)
    at, here = np.arange(len(firsts)), firsts
    while len(here):
        window[here] = at
        here = after[here]
        at, here = at[here >= 0], here[here >= 0]
    return window


def cut(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, length) of pieces cut after every ``limit`` ids."""
    parts = -(-sizes // limit)
    piece = np.repeat(np.arange(len(sizes)), parts)
    start = (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)) * limit
    return piece, start, np.minimum(limit, sizes[piece] - start)


def windows_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, length, window) for pieces of at most ``capacity`` ids."""
    least = -(-int(sizes.sum()) // capacity)
    limit = capacity
    while True:
        piece, start, length = cut(sizes, limit)
        k, step = least, 1
        while k <= least + least // SPARE or limit <= FINEST:
            window = differencing(length, k)
            if np.bincount(window, length).max() <= capacity:
                return piece, start, length, window
            k, step = k + step, 2 * step
        limit //= 2


class Pool:
    """Documents of a task on their way into windows."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self._clear()

    def _clear(self) -> None:
        self.rest: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = len(ids) // self.capacity
        for at in range(0, whole, 256):
            n = min(256, whole - at)
            starts = np.arange(at, at + n) * self.capacity
            lengths = np.full(n, self.capacity)
            yield self._rows(ids[at * self.capacity : (at + n) * self.capacity], lengths, [doc_id] * n, starts, lengths, np.zeros(n, np.int64), [len(ids)] * n, np.ones(n, np.int64))
        if len(ids) > whole * self.capacity:
            self.rest.append(ids[whole * self.capacity :].copy())
            self.docs.append((doc_id, whole * self.capacity, len(ids)))
            self.held += len(self.rest[-1])
            if self.held >= POOL_IDS or len(self.docs) >= POOL_PIECES:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        sizes = np.array([len(r) for r in self.rest], np.int64)
        piece, start, length, window = windows_of(sizes, self.capacity)
        order = np.argsort(window, kind="stable")
        piece, start, length, window = piece[order], start[order], length[order], window[order]
        flat = np.concatenate(self.rest)
        begins = (np.cumsum(sizes) - sizes)[piece] + start
        ends = np.cumsum(length)
        ids = flat[np.repeat(begins - (ends - length), length) + np.arange(int(ends[-1]))]
        parts = np.bincount(window)
        parts = parts[parts > 0]
        first = np.cumsum(parts) - parts
        filled = np.add.reduceat(length, first)
        offset = ends - length - np.repeat(np.cumsum(filled) - filled, parts)
        docs = [self.docs[p] for p in piece]
        out = self._rows(ids, filled, [d[0] for d in docs], np.array([d[1] for d in docs], np.int64) + start, length, offset, [d[2] for d in docs], parts)
        self._clear()
        return out

    def _rows(self, ids, filled, doc_ids, start, length, offset, doc_tokens, parts) -> pa.RecordBatch:
        """Windows of ``filled`` ids each, of ``parts`` pieces each."""
        n = len(filled)
        numbers = pa.array(np.arange(self.sequence, self.sequence + n))
        self.sequence += n
        bounds = np.concatenate([[0], 4 * np.cumsum(filled)]).astype(np.int32)
        told = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
        names = ["doc_id", "start", "length", "offset", "doc_tokens"]
        pieces = pa.StructArray.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(np.asarray(x, np.int64)) for x in (start, length, offset, doc_tokens))], names)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(parts)]), pa.int32()), pieces)
        return pa.RecordBatch.from_arrays([numbers, told, lists], ["sequence_id", "ids", "pieces"])


_ENCODERS: dict[str, Encoder] = {}


def pack(df: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sequence_id, ids, pieces``: windows of at most ``capacity`` ids (little-endian, 32
    bits) and the pieces of documents in them, in order; each id of a document lies in one
    piece.  The windows are a written table."""
    store.ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        own = _ENCODERS[vocabulary]
        pool = Pool(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)
        for part in store.slices(batches, "text"):
            texts = part.column("text").fill_null("")
            buffer = texts.buffers()[2]
            long_runs = buffer is not None and _longest_run(memoryview(buffer)) >= LONG_RUN
            spaces = pc.match_substring_regex(texts, f"{SPACE}{SPACE}").to_pylist()
            for doc_id, text, several in zip(part.column("doc_id").to_pylist(), texts, spaces, strict=True):
                yield from pool.add(doc_id, np.concatenate([own.encode(text.as_py(), long_runs, several), end]))
        if pool.docs:
            yield pool.flush()

    return store.written(store.as_text(df, id_col, text_col).mapInArrow(run, _SCHEMA), "packed-windows")


def pieces(windows: DataFrame) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, a row for each piece."""
    each = windows.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return each.select("p.doc_id", "p.start", "p.length", ids.alias("ids"), "p.doc_tokens", "sequence_id", "p.offset")
