"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams of its letters (lower-cased; what isn't a
letter is one word boundary), weighted by 1 + log count and inverse document frequency,
of length one.  Each language has several centroids, found by clustering a bounded sample
of its labelled texts by cosine; a text gets the language of the nearest centroid, and the
cosine as score.  A text is rejected if its cosine is under a quarter of what 99 in 100 labelled texts reach;
short texts and texts full of numbers stay far above that, other scripts far below.  There
are enough buckets that a long text has few n-grams in common with a language by collision;
vectors are held sparse, or dense over the buckets that a sample has.

Document frequencies are counted over all labelled texts; only the clustering uses the
sample (the ``per_language`` distinct texts of smallest hash of each language; however
many copies there are, a language with a labelled text that has letters has centroids).

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; a null
``lang`` or null id teaches nothing; without labelled texts everything is ``und``; equal
cosines go to the language that sorts first; repeated rows count each for itself; a very long
text is one vector; an empty table gives no rows; all columns pass, but those that have the
names of the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caliper.llm import store

UNKNOWN = "und"
PARTS = 64
MAX_LANGUAGES = 200  # a megabyte each
BITS = 16
_ALPHA: list[np.ndarray] = []
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _is_letter() -> np.ndarray:
    """Which code points are letters."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def counts(text: str, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None without a letter.  A very long text is taken
    in pieces that overlap by the n-grams that cross a cut."""
    total, tail = None, np.full(1, 32, np.uint64)
    letter = _is_letter()
    for start in range(0, len(text), 1 << 20):
        c = np.frombuffer(text[start : start + (1 << 20)].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ok = letter[c.astype(np.int64)]
        if not ok.any():
            continue
        c = np.concatenate([tail, np.where(ok, c, np.uint64(32)), np.full(1, 32, np.uint64)])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        grams = [c * np.uint64(3), ((c[:-1] << np.uint64(21)) | c[1:]) * np.uint64(5), ((((c[:-2] << np.uint64(21)) | c[1:-1]) << np.uint64(21)) | c[2:]) * np.uint64(7)]
        h = np.concatenate([(g * _MIX) >> np.uint64(64 - bits) for g in grams]).astype(np.int64)
        own = np.bincount(h, minlength=1 << bits)
        total = own if total is None else total + own
    return total


Sparse = tuple[np.ndarray, np.ndarray]  # buckets, and a value for each


def sparse(text: str, bits: int = BITS) -> Sparse | None:
    """The buckets that a text has, with their counts; None without a letter."""
    total = counts(text, bits)
    return None if total is None else ((at := np.flatnonzero(total)), total[at])


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit length
    weights: np.ndarray  # inverse document frequencies
    farthest: float  # cosine below which a text is rejected

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def nearest(self, rows: list[Sparse]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid and the cosine of each row of counts."""
        by_bucket = self.by_bucket
        cosine = np.array([x @ by_bucket[at] for at, x in (weighted(r, self.weights) for r in rows)])
        best = cosine.argmax(1)
        return best, np.clip(cosine[np.arange(len(rows)), best].astype(np.float64), 0.0, 1.0)

    @cached_property
    def by_bucket(self) -> np.ndarray:
        return np.ascontiguousarray(self.centroids.T)


def weighted(row: Sparse, weights: np.ndarray) -> Sparse:
    at, n = row
    x = ((1 + np.log(n)) * weights[at]).astype(np.float32)
    return at, x / max(np.linalg.norm(x), 1e-12)


def vectors(rows: list[Sparse], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that any row has, and the rows' vectors over these."""
    used = np.unique(np.concatenate([at for at, _ in rows]))
    out = np.zeros((len(rows), len(used)), np.float32)
    for i, row in enumerate(rows):
        at, x = weighted(row, weights)
        out[i, np.searchsorted(used, at)] = x
    return used, out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine: the first is the mean, each further start is the row farthest
    from those before; then the usual rounds."""
    mean = x.mean(0)
    starts = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(starts) < min(k, len(x)):
        starts.append(x[(x @ np.array(starts).T).max(1).argmin()])
    centers = np.array(starts)
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.array([x[own == j].sum(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        fresh = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(fresh, centers, atol=1e-5):
            break
        centers = fresh
    return centers


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """Of all texts (one column ``text``): how many have letters, and for each n-gram
    bucket in how many it occurs.  One row for each bucket reaches the driver."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for part in store.slices(batches, "text"):
            for text in part.column("text").to_pylist():
                if text and (c := sparse(text, bits)) is not None:
                    total[c[0]] += 1
                    total[size] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    store.ready(texts.sparkSession)
    out = np.zeros(size + 1, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return int(out[size]), out[:size]


def fit(labelled: DataFrame, clusters: int = 4, per_language: int = 400, bits: int = BITS) -> Model | None:
    """A model from ``text`` and ``lang`` of all rows; None if no labelled text has a letter."""
    labelled = labelled.select("text", "lang").where("lang is not null and text is not null")
    n, df = document_frequencies(labelled, bits)
    if not n:
        return None
    weights = np.log((1 + n) / (1 + df)) + 1
    place = F.struct((~F.col("text").rlike(r"\p{L}")).alias("bare"), F.xxhash64("text").alias("hash"))  # texts with letters first
    placed = labelled.withColumn("place", place)
    # the smallest hashes of each language: first in each of ``PARTS`` parts of it, then among
    # these, so that no task orders a language's texts, whatever share it has
    part = F.pmod(F.shiftright("place.hash", 20), F.lit(PARTS))
    few = placed.select("lang", "place").distinct().withColumn("part", part)
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        few = few.withColumn("rank", rank).where(F.col("rank") <= per_language)
    last = store.written(few.groupBy("lang").agg(F.max("place").alias("last")), "language-samples")
    if (languages := last.count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages are labelled; a model is held whole by every task, so it has {MAX_LANGUAGES} at most")
    sample = placed.join(F.broadcast(last), "lang").where("place <= last").select("text", "lang").distinct()  # MAX_LANGUAGES rows at most are broadcast

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [c for t in sorted(pdf["text"].unique()) if (c := sparse(t, bits)) is not None]
        if not rows:
            return pd.DataFrame({"lang": pd.Series(dtype=object), "centre": pd.Series(dtype=object), "low": pd.Series(dtype=float)})
        used, x = vectors(rows, weights)
        found = cluster(x, clusters)
        low = float(np.quantile((x @ found.T).max(1), 0.01))
        whole = np.zeros((len(found), 1 << bits), np.float32)
        whole[:, used] = found
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.tobytes() for c in whole], "low": low})

    rows = sorted(sample.groupBy("lang").applyInPandas(centres, "lang string, centre binary, low double").collect(), key=lambda r: (r["lang"], bytes(r["centre"])))
    if not rows:
        return None
    return Model([r["lang"] for r in rows], np.array([np.frombuffer(r["centre"], np.float32) for r in rows]), weights, 0.25 * min(r["low"] for r in rows))


def identify(df: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", rejected_out: str = "rejected") -> DataFrame:
    """All rows and columns of ``df`` with the predicted language, its cosine and whether
    the text is rejected.  Columns of ``df`` that have these names are replaced."""
    spark = store.ready(df.sparkSession)
    names = [lang_out, score_out, rejected_out]
    df = df.drop(*names)
    own = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), T.StructField(rejected_out, T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *own])
    shared = spark.sparkContext.broadcast(model)  # languages x clusters vectors of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in store.slices(batches, text_col, 1 << 20):
            texts = part.column(text_col).to_pylist()
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for k in range(0, len(texts) if m else 0, 256):  # so many vectors at a time
                rows = {i: c for i in range(k, min(k + 256, len(texts))) if texts[i] and (c := sparse(texts[i], m.bits)) is not None}
                if rows:
                    at = list(rows)
                    best, cosine = m.nearest(list(rows.values()))
                    langs[at] = [m.languages[b] for b in best]
                    scores[at] = cosine
            rejected = (langs == UNKNOWN) | (scores < (m.farthest if m else 2.0))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs.tolist(), pa.string()), pa.array(scores), pa.array(rejected.astype(bool))], [*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5; the held-out fold is 0."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5
