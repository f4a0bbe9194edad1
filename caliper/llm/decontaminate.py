"""Benchmark decontamination with spaced seeds.

A mask over consecutive words names the positions that count; the others may differ.  The
masks here have six counting positions each, and together they hit every run of twelve
aligned words with at most two substitutions.  Seeds of benchmark items and of documents
are joined by hash; each hit names an item, a document and a shift between them, and along
that shift the words are compared: an overlap is a run of ``WINDOW`` aligned words of
which at most ``SLACK`` differ.  An item of six to eleven words must occur whole, with one
substitution at most: it is found by three words in a row, one of which is left on either
side.  Fewer words say little inside a text; such an item must be the document's whole text.
The masks for short items are only laid over documents where there are such items.

Before the join a bitmap of the benchmark's seed hashes (its size follows their number, up
to 32 MB) drops most seeds that hit nothing, in the task that makes them.  It only spares
rows: what passes is joined exactly.

Cases: a null or empty text or item has no seeds; a very long text is taken whole, its words
as one array of hashes; a null id is never reported and never
dropped; rows that repeat an id are reported under it if any of them overlaps; equal items
are reported each; other columns aren't read; without items nothing is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm import hashing, store

MASKS = ("111111", "11101011", "101100111", "111")
WINDOW, SLACK = 12, 2
LEAST = 6
LONG, SHORT, WHOLE = (0, 1, 2), (3,), len(MASKS)  # numbers of masks; WHOLE stands for a whole text


def masks_for(n: int) -> tuple[int, ...]:
    """The masks that find an item of n words."""
    return LONG if n >= WINDOW else SHORT if n >= LEAST else (WHOLE,) if n else ()


def whole(words: np.ndarray) -> np.ndarray:
    """The one seed of a text of fewer than ``LEAST`` words."""
    total = np.full(1, WHOLE + 1, np.uint64)
    for w in words:
        total = total * np.uint64(0xD6E8FEB86659FD93) + w
    return hashing.mix(total)


def seeds(words: np.ndarray, masks: tuple[int, ...] = LONG) -> Iterator[tuple[np.ndarray, int]]:
    """For each of the masks (by number) the seed hashes at all positions, and its number."""
    for number in masks:
        if number == WHOLE:
            yield whole(words), number
            continue
        mask = MASKS[number]
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, number + 1, np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
        yield hashing.mix(total), number


def item_seeds(items: DataFrame) -> DataFrame:
    """``hash, item, at, mask`` of all seeds from ``item, text``."""
    store.ready(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in store.slices(batches, "text"):
            words, ends = hashing.word_hashes(*hashing.texts_buffer(part.column("text")))
            for i, item in enumerate(part.column("item").to_pylist()):
                own = words[ends[i] : ends[i + 1]]
                for h, number in seeds(own, masks_for(len(own))):
                    same = [pa.array(np.full(len(h), v)) for v in (item, number)]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), same[0], pa.array(np.arange(len(h))), same[1]], ["hash", "item", "at", "mask"])

    return items.mapInArrow(run, "hash long, item long, at long, mask long")


def bitmap(seeds_of_items: DataFrame, n: int) -> np.ndarray:
    """Bits set where a seed hash falls; at most 32 MB."""
    bits = int(np.clip(np.ceil(np.log2(512 * max(1, n))), 16, 28))
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = seeds_of_items.select(F.shiftright(place, 6).alias("w"), place.bitwiseAND(F.lit(63)).alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("v"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("v").to_numpy().view(np.uint64)
    return out


def marked_by(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places are marked."""
    return np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))


def document_seeds(texts: DataFrame, marked: np.ndarray, masks: tuple[int, ...] = LONG) -> DataFrame:
    """``hash, doc_id, at`` of the masks' seeds that fall on a marked bit, from ``doc_id,
    text``."""
    spark = store.ready(texts.sparkSession)
    shared = spark.sparkContext.broadcast(marked)
    shift = np.uint64(64 - 6 - int(np.log2(len(marked))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in store.slices(batches, "text"):
            words, ends = hashing.word_hashes(*hashing.texts_buffer(part.column("text")))
            hashes, places = [], []
            if WHOLE in masks:
                few = np.flatnonzero((np.diff(ends) > 0) & (np.diff(ends) < LEAST))
                h = np.concatenate([np.zeros(0, np.uint64), *(whole(words[ends[i] : ends[i + 1]]) for i in few)])
                ok = marked_by(bits, h >> shift)
                hashes.append(h[ok])
                places.append((few[ok], np.zeros(len(ok), np.int64)))
            for h, number in seeds(words, tuple(m for m in masks if m != WHOLE)):  # over all texts at once; seeds that cross an end are dropped below
                at = marked_by(bits, h >> shift)
                row = np.searchsorted(ends, at, "right") - 1
                at, row = (x[at + len(MASKS[number]) <= ends[row + 1]] for x in (at, row))
                hashes.append(h[at])
                places.append((row, at - ends[row]))
            if hashes:
                rows, at = (np.concatenate([p[k] for p in places]) for k in (0, 1))
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), part.column("doc_id").take(pa.array(rows)), pa.array(at)], ["hash", "doc_id", "at"])
                if out.num_rows:
                    yield out

    return texts.mapInArrow(run, "hash long, doc_id long, at long")


def aligned(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Of the item's word i beside the document's word i + shift: how many words match in
    all overlapping windows, how many the windows span, and where they begin in the
    document.  None without such a window."""
    start, stop = max(0, -shift), min(len(item), len(doc) - shift)
    width, slack = (WINDOW, SLACK) if len(item) >= WINDOW else (len(item), int(len(item) >= LEAST))
    if stop - start < width or len(item) < LEAST and len(doc) != len(item):
        return None
    same = doc[start + shift : stop + shift] == item[start:stop]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[width:] - total[:-width] >= width - slack)
    if not len(good):
        return None
    inside = np.zeros(len(same) + 1, np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + width, -1)
    inside = np.cumsum(inside)[:-1] > 0
    return int(same[inside].sum()), int(inside.sum()), int(good[0] + start + shift)


def overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, spanned, first_word`` of every document and benchmark
    item that overlap: the shift with most matching words, then the earliest."""
    spark = df.sparkSession
    texts = store.as_text(df, id_col, text_col).where("doc_id is not null")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item is not null")
    marks = store.written(item_seeds(items), "decontaminate-items")
    n = marks.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, item_id long, matched long, spanned long, first_word long")
    masks = tuple(sorted(r["mask"] for r in marks.select("mask").distinct().collect()))  # five at most
    found = store.written(document_seeds(texts, bitmap(marks, n), masks), "decontaminate-seeds")
    hits = found.join(marks.drop("mask").withColumnRenamed("at", "item_at"), "hash").select("doc_id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = store.written(hits, "decontaminate-hits")

    def tokens(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in store.slices(batches, "text"):
                words, ends = hashing.word_hashes(*hashing.texts_buffer(part.column("text")))
                own = [words[ends[i] : ends[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(own, pa.binary())], [key, f"{key}_words"])

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, item, shift, x, y in zip(*(batch.column(c) for c in ("doc_id", "item", "shift", "doc_id_words", "item_words")), strict=True):
                got = aligned(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), shift.as_py())
                if got:
                    rows.append((doc_id.as_py(), item.as_py(), *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "matched", "spanned", "first_word"])

    involved = hits.select("doc_id").distinct()
    docs = store.written(texts.join(involved, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tokens("doc_id"), "doc_id long, doc_id_words binary"), "decontaminate-texts")
    whole = store.written(items.mapInArrow(tokens("item"), "item long, item_words binary"), "decontaminate-words")
    met = hits.join(whole, "item").join(docs, "doc_id").select("doc_id", "item", "shift", "doc_id_words", "item_words")
    real = met.mapInArrow(verify, "doc_id long, item_id long, matched long, spanned long, first_word long")
    best = F.max(F.struct("matched", (-F.col("first_word")).alias("back"), "spanned")).alias("m")
    return real.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.matched", "m.spanned", (-F.col("m.back")).alias("first_word"))
