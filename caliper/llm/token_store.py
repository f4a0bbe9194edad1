"""Token ids in binary files under a canonical, length-limited Huffman code.

The ids' counts over all documents give code lengths of at most ``LONGEST`` bits (package
merge); codes are canonical, so the lengths alone are stored.  A shard file holds a range
of documents in ascending id order:

    magic, payload bits, checkpoints, documents, sizes of these, magic

The payload is one run of bits.  A document's ids are cut into blocks of ``BLOCK``, and for
each block a checkpoint names the bit at which it begins, so every document and every block
can be decoded by itself; a reader decodes many blocks in step with one table look-up an id.
``codes.bin`` beside the shards has the code lengths.

Texts are encoded once, into a written table of ids; the range shuffle moves ids, and
shards are coded as they are written, slice by slice.  Shards are written whole under their final names by whichever attempt
ends; the list of shards is a written table with a row for each.

The number of shards follows the coded size, ``SHARD_BYTES`` each, so what a task holds
(checkpoints and the document table of its shard) doesn't grow with the table.

Cases: a null or empty text has the end id alone; a null doc_id sorts first; rows that
repeat an id are stored one after the other, ordered by a hash of their ids, then the ids'
bytes; other columns aren't read; an empty table makes no shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm import store

MAGIC = b"HUFFIDS1"
LONGEST = 18
BLOCK = 1024
JOINED = 50
AT_ONCE = 200
RUN = 1 << 15  # values at a time, so that arrays stay in a core's cache
SHARD_BYTES = 24 << 20
TABLE = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("start", "<u8"), ("n", "<u8")])
_TAIL = np.dtype([("payload_bits", "<u8"), ("ids", "<u8"), ("documents", "<u8"), ("magic", "S8")])


class Words:
    """Words and the ids of each, one after the other."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 where it isn't known."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember words that aren't known yet; their numbers."""
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words))))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return np.arange(first, first + len(words))

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, and how many each has."""
        return _gathered(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, places), self.sizes[places]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The values of entries, each ``sizes`` values from ``starts`` on in ``flat``."""
    parts = [flat[:0]]
    for at in range(0, len(entries), RUN):
        own = entries[at : at + RUN]
        length = sizes[own]
        until = np.cumsum(length)
        parts.append(flat[np.repeat(starts[own] - (until - length), length) + np.arange(int(until[-1]))])
    return np.concatenate(parts)


class Encoder:
    """Ids of whole texts by the tokenizers library.  No token spans a space but as its
    first character, so a text whose white space is all single characters is the sequence
    of its space-led words.  Of a run of texts each distinct word that is new is given to
    the library once, joined to texts of ``JOINED`` words; the tokens that begin with a space
    cut their ids into words again.  A text with other white space goes to the library whole."""

    def __init__(self, path: str, room: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of all tasks get in each other's way
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]  # the character that stands for a space
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)])
        self.room = room
        self.young, self.old = Words(), Words()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), AT_ONCE):  # what the library and Python hold of each id is many times its size
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(each), "<u4"))
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with a space before it, and how many each has."""
        ids, _ = self._whole([" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        cuts = np.append(np.flatnonzero(self.leads[ids]), len(ids))
        if len(cuts) != len(words) + 1:
            raise ValueError("words and their tokens don't fit")
        return ids, np.diff(cuts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's end."""
        parts = pc.split_pattern(texts.fill_null(""), " ")
        ends = parts.value_lengths().to_numpy().cumsum()
        firsts = np.concatenate([[0], ends[:-1]])
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
        plain = np.add.reduceat(odd[at].astype(np.int64), firsts) == 0
        own, own_sizes = self._whole([words[k] if ok else texts[i].as_py() or "" for i, (k, ok) in enumerate(zip(at[firsts].tolist(), plain.tolist(), strict=True))])
        if len(self.young.place) > self.room:
            self.old, self.young = self.young, Words()
        known = self.young
        place = known.places(words)
        new = np.flatnonzero((place < 0) & ~odd)
        if len(new):
            was = self.old.places([words[i] for i in new.tolist()])
            again, new = new[was >= 0], new[was < 0]
            place[again] = known.add([words[i] for i in again.tolist()], *self.old.ids_of(was[was >= 0]))
            if len(new):
                some = [words[i] for i in new.tolist()]
                place[new] = known.add(some, *self._learned(some))
        sizes = np.concatenate([known.sizes, own_sizes, [0]])
        entry = np.where(np.repeat(plain, np.diff(ends, prepend=0)), place[at], len(sizes) - 1)  # a text taken whole has one entry
        entry[firsts] = len(known.sizes) + np.arange(len(own_sizes))
        until = np.cumsum(sizes[entry])
        return _gathered(np.concatenate([known.ids, own]), np.cumsum(sizes) - sizes, sizes, entry), until[ends - 1]


# fixed value: the characters that str.isspace() names
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"^$|^{SPACE}|{SPACE}$|{SPACE}{SPACE}"
_ENCODERS: dict[str, Encoder] = {}


def encoded(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, width``: each whole text's ids and the end id, two bytes an id where
    all ids fit in two, else four.  A task's last row has no ids: its ``counted`` and
    ``counts`` say how often each id came up in the task."""
    store.ready(df.sparkSession)
    names = ["doc_id", "ids", "width", "counted", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        own = _ENCODERS[vocabulary]
        size = max(own.tokenizer.get_vocab_size(), end_id + 1)
        kind = _id_type(size)
        total = np.zeros(size, np.int64)
        lists = pa.list_(pa.int64())
        for part in store.slices(batches, "text", 8 << 20):
            ids, ends = own.encode(part.column("text"))
            flat = np.insert(ids, ends, end_id).astype(kind)
            total += np.bincount(flat, minlength=size)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * kind.itemsize
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            none = pa.nulls(len(ends), lists)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, pa.array([kind.itemsize] * len(ends), pa.int32()), none, none], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([at.tolist()], lists), pa.array([total[at].tolist()], lists)], names)

    return store.as_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, width int, counted array<long>, counts array<long>")


def _id_type(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def id_counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs, over all documents: a row for each id reaches the driver."""
    each = ids.where("ids is null").select(F.explode(F.arrays_zip("counted", "counts")).alias("c"))
    rows = each.groupBy(F.col("c.counted").alias("id")).agg(F.sum("c.counts").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of the best prefix code with none over ``longest`` bits: on each level the
    symbols are merged in order of weight with the pairs of the level before; a symbol's
    length is the number of levels on which it is among the chosen."""
    ids = np.array(sorted(counts, key=lambda i: (counts[i], i)), np.int64)
    n = len(ids)
    if n <= 1:
        return {int(i): 1 for i in ids}
    if n > 1 << longest:
        raise ValueError(f"{n} symbols don't fit in codes of {longest} bits")
    weight = np.array([counts[int(i)] for i in ids], np.int64)
    level, is_symbol = weight, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[0 : len(level) // 2 * 2 : 2] + level[1 : len(level) // 2 * 2 : 2]
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_symbol.append(order < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for symbols in reversed(is_symbol):
        chosen = int(symbols[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    return dict(zip(ids.tolist(), lengths.tolist(), strict=True))


class Code:
    """A canonical code: codes ascend with (length, id)."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        size = max(order, default=0) + 1
        self.length = np.zeros(size, np.uint8)
        self.code = np.zeros(size, np.uint32)
        self.table_id = np.zeros(1 << LONGEST, np.uint32)
        self.table_length = np.zeros(1 << LONGEST, np.uint8)
        code = last = 0
        for i in order:
            n = lengths[i]
            code <<= n - last
            last = n
            self.length[i], self.code[i] = n, code
            start = code << (LONGEST - n)
            self.table_id[start : start + (1 << (LONGEST - n))] = i
            self.table_length[start : start + (1 << (LONGEST - n))] = n
            code += 1

    def to_bytes(self) -> bytes:
        ids = np.flatnonzero(self.length).astype("<u4")
        return MAGIC + zlib.compress(len(ids).to_bytes(8, "little") + ids.tobytes() + self.length[ids].tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Code:
        if data[:8] != MAGIC:
            raise ValueError("not a code file")
        raw = zlib.decompress(data[8:])
        n = int.from_bytes(raw[:8], "little")
        ids, lengths = np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n)
        return cls(dict(zip(ids.tolist(), lengths.tolist(), strict=True)))

    def bits(self, ids: np.ndarray) -> np.ndarray:
        """The code bits of ids, one to an element."""
        data, rest, after = self.packed(ids)
        return np.unpackbits(np.frombuffer(data + bytes([rest << (8 - after)] if after else []), np.uint8))[: 8 * len(data) + after]

    def packed(self, ids: np.ndarray, rest: int = 0, before: int = 0) -> tuple[bytes, int, int]:
        """Whole bytes of the ``before`` (under eight) bits ``rest`` and the code bits of ids,
        then the bits that fill no byte and their number.  Codes are added up in 32-bit words,
        of which each touches two at most."""
        n = self.length[ids].astype(np.int64)
        ends = before + np.cumsum(n)
        bits = int(ends[-1]) if len(ends) else before
        word, at = np.divmod(ends - n, 32)
        wide = self.code[ids].astype(np.uint64) << (64 - at - n).astype(np.uint64)
        size = (bits >> 5) + 2
        words = np.bincount(word, wide >> np.uint64(32), size) + np.bincount(word + 1, wide & np.uint64(0xFFFFFFFF), size)
        data = bytearray(words.astype(">u4").tobytes())
        data[0] |= rest << (8 - before)
        whole, after = divmod(bits, 8)
        return bytes(data[:whole]), data[whole] >> (8 - after), after

    def decode(self, payload: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at the bits ``starts`` and have ``sizes`` ids, all
        blocks in step.  ``payload`` needs four bytes beyond its last bit."""
        order = np.argsort(-sizes, kind="stable")  # blocks that end are the last ones of those in step
        at, falling = starts[order].astype(np.int64), sizes[order]
        steps = int(falling[0]) if len(falling) else 0
        live = len(falling) - np.searchsorted(falling[::-1], np.arange(steps), "right")
        out = np.zeros((steps, len(falling)), np.uint32)
        wide = payload.astype(np.uint32)
        word = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
        for k, m in enumerate(live.tolist()):
            here = at[:m]
            look = (word[here >> 3] >> (32 - LONGEST - (here & 7)).astype(np.uint32)) & np.uint32((1 << LONGEST) - 1)
            out[k, :m] = self.table_id[look]
            here += self.table_length[look]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return np.ascontiguousarray(out.T)[place][np.arange(steps)[None, :] < sizes[:, None]]


def _inside(blocks: np.ndarray) -> np.ndarray:
    """The number of each block in its document, from the documents' numbers of blocks."""
    return np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)


def write(ids: DataFrame, code: Code, folder: str, shards: int) -> DataFrame:
    """Write :func:`encoded`'s rows to shards in ascending doc_id order; the written list
    ``shard, file, documents, ids`` of the shards."""
    spark = store.ready(ids.sparkSession)
    store.put_file(f"{folder}/codes.bin", lambda out: out.write(code.to_bytes()))
    shared = spark.sparkContext.broadcast(code.to_bytes())  # a length for each id of the vocabulary

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own = Code.from_bytes(shared.value)
        tables: list[np.ndarray] = []
        total = [0]

        def parts(out) -> None:
            out.write(MAGIC)
            rest, before, checkpoints = 0, 0, []
            bits = 0
            for part in store.slices(batches, "ids"):
                rows = part.column("ids").to_pylist()
                width = part.column("width")[0].as_py()
                flat = np.frombuffer(b"".join(rows), f"<u{width}")
                n = np.array([len(r) // width for r in rows], np.int64)
                first = np.cumsum(n) - n
                blocks = -(-n // BLOCK)
                length = own.length[flat].astype(np.int64)
                begins = np.cumsum(length) - length
                checkpoints.append((bits + begins[np.repeat(first, blocks) + BLOCK * _inside(blocks)]).astype("<u8"))
                table = np.zeros(len(rows), TABLE)
                names = part.column("doc_id")
                table["null"], table["doc_id"] = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
                table["start"], table["n"] = total[0] + first, n
                tables.append(table)
                total[0] += len(flat)
                bits += int(length.sum())
                for at in range(0, len(flat), RUN):
                    data, rest, before = own.packed(flat[at : at + RUN], rest, before)
                    out.write(data)
            out.write(bytes([rest << (8 - before)] if before else []))
            for x in (*checkpoints, *tables):
                out.write(x.tobytes())
            out.write(np.array([(bits, total[0], sum(map(len, tables)), MAGIC)], _TAIL).tobytes())

        name = f"part-{shard:06d}.huf"
        store.put_file(f"{folder}/{name}", parts)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([sum(map(len, tables))], pa.int64()), pa.array(total, pa.int64())], ["shard", "file", "documents", "ids"])

    order = ["doc_id", F.xxhash64("ids")]  # an id that many rows share is dealt to many shards
    ranged = ids.where("ids is not null").select("doc_id", "ids", "width").repartitionByRange(shards, *order).sortWithinPartitions(*order, "ids")
    return store.written(ranged.mapInArrow(fill, "shard long, file string, documents long, ids long"), "token-shards")


def read(spark: SparkSession, shards: DataFrame, folder: str, group: int = 1 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents from the shard files: ``start``
    counts the ids of all documents before it, ``ids`` are little-endian 32-bit.  About
    ``group`` ids are decoded at a time (one document at least)."""
    store.ready(spark)
    listed = sorted((r["shard"], r["file"], r["ids"]) for r in shards.where("documents > 0").collect())  # a row for each file
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in listed])]).astype(np.int64)
    files = spark.createDataFrame([(f, int(s)) for (_, f, _), s in zip(listed, starts)], "file string, base long").repartition(max(1, len(listed)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, path = store.filesystem(f"{folder}/{file}")
                if code is None:
                    with system.open_input_file(path.rpartition("/")[0] + "/codes.bin") as f:
                        code = Code.from_bytes(f.read())
                with system.open_input_file(path) as f:
                    yield from _shard(f, code, base, group)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _shard(f, code: Code, base: int, group: int) -> Iterator[pa.RecordBatch]:
    size = f.size()
    tail = np.frombuffer(f.read_at(_TAIL.itemsize, size - _TAIL.itemsize), _TAIL)[0]
    if tail["magic"] != MAGIC or f.read_at(8, 0) != MAGIC:
        raise ValueError("not a shard file")
    bits, documents = int(tail["payload_bits"]), int(tail["documents"])
    payload_end = 8 + -(-bits // 8)
    table = np.frombuffer(f.read_at(TABLE.itemsize * documents, size - _TAIL.itemsize - TABLE.itemsize * documents), TABLE)
    blocks = -(-table["n"].astype(np.int64) // BLOCK)  # of each document
    until = np.cumsum(blocks)
    checkpoints = np.frombuffer(f.read_at(8 * int(until[-1]), payload_end), "<u8").astype(np.int64)
    first = 0
    while first < documents:
        last = max(first + 1, int(np.searchsorted(table["start"], table["start"][first] + group)))
        part, some = table[first:last], blocks[first:last]
        begin, end = int(until[first] - blocks[first]), int(until[last - 1])
        marks = checkpoints[begin:end]
        stop = int(checkpoints[end]) if end < len(checkpoints) else bits
        start = int(marks[0]) // 8 if len(marks) else stop // 8
        data = f.read_at(-(-stop // 8) - start, 8 + start)
        payload = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
        sizes = np.minimum(BLOCK, np.repeat(part["n"].astype(np.int64), some) - BLOCK * _inside(some))
        flat = code.decode(payload, marks - 8 * start, sizes).astype("<u4").tobytes()
        at = (4 * np.concatenate([[0], np.cumsum(part["n"].astype(np.int64))])).tolist()
        rows = [flat[a:b] for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)), pa.array(part["start"].astype(np.int64) + base), pa.array(part["n"].astype(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
        first = last


def store_ids(df: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode, count, code and write all documents; the folder and the list of shards."""
    spark = df.sparkSession
    folder = folder or store.new_folder(spark, "token-ids")
    ids = store.written(encoded(df, vocabulary, end_id, id_col, text_col), "token-encoded")
    counts = id_counts(ids)
    lengths = code_lengths(counts)
    coded = sum(n * lengths[i] for i, n in counts.items()) // 8
    return folder, write(ids, Code(lengths), folder, 1 + coded // SHARD_BYTES)
