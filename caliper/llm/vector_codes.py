"""Codes for vectors from codebooks of their parts, fitted by k-means with norm-of-sum bounds.

A vector's components become whole numbers floor(scale x) and the vector is cut into
``parts`` consecutive parts.  Each part position has a codebook of ``entries`` entries, at
first that part of the vectors of the smallest ids.  A round assigns every part to the
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry
by its parts' componentwise floor(sum / count).

Bounds spare most distances.  Each part keeps an upper bound of the distance to its own entry
and a lower bound of the distance to the nearest other one, each with the round in which it
was exact.  All earlier codebooks are retained (a few kilobytes), so a bound of round s is
worth, in round r, what it was less (or more) the *net* displacement between the codebooks of
s and r: the norm of the summed moves, never over, and mostly far under, the sum of their
norms.  Where the bounds overlap the own distance is taken first; where that doesn't settle
it, all entries are rescanned, in whole numbers.  Bounds are rounded outwards.

A round reads the written table of the round before, writes parts, codes and bounds, and
leaves one row of sums a task; the sums of all tasks, a row for each (part, entry), go to the
driver.  A lost executor costs its running tasks.  Tables of earlier rounds are deleted.

Cases: a vector that is null, or holds a null or a non-finite component, is dropped, so is
one without components or of another length than the longest; a length that ``parts`` doesn't
divide gives parts of nearly equal length; fewer vectors than entries give fewer entries; a
null id sorts last; repeated ids are rows of their own, smaller vectors first; other columns
aren't read; an empty table gives no rows.  Distances are 64-bit numbers: a component beyond
+-2^27 after scaling is refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm import store

LARGEST = 1 << 27
_SLACK = 1e-9  # relative; doubles of sums below 2^62 are good to 2^-52
_STATE = ["vec_id", "label", "x", "code", "upper", "lower", "stamps"]
_STATE_SCHEMA = "vec_id long, label int, x binary, code binary, upper binary, lower binary, stamps binary, counts array<long>, sums array<long>"


@dataclass
class Codebooks:
    """The codebooks of all rounds: ``history[r][p]`` is an (entries, length) array."""

    cuts: list[int]
    history: list[list[np.ndarray]]

    @property
    def parts(self) -> int:
        return len(self.cuts) - 1

    def digest(self) -> str:
        """SHA-256 of all final components in decimal by part, entry and position."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.history[-1] for v in book.reshape(-1)).encode()).hexdigest()


def whole_vectors(df: DataFrame, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v``: the vectors kept, in whole numbers."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    told = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"), v.alias("v"))

    def finite(x: F.Column) -> F.Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    told = told.where(F.col("v").isNotNull() & F.forall("v", finite))
    # the planner may ask this of rows that are dropped, too
    limit = F.assert_true(F.coalesce(F.forall("v", lambda x: ~finite(x) | (F.abs(x * scale) < LARGEST)), F.lit(True)), F.lit(f"a component beyond {LARGEST} after scaling"))
    return told.select("vec_id", "label", F.when(limit.isNull(), F.transform("v", lambda x: F.floor(x * scale).try_cast("int"))).alias("v"))


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("ij,ij->i", d, d)


def net_moves(books: Codebooks) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part two (round, entry) tables: how far the entry now is from where it was
    in that round, and the farthest any *other* entry is."""
    out = []
    for p in range(books.parts):
        now = books.history[-1][p].astype(np.float64)
        own = np.array([np.sqrt(((now - then[p]) ** 2).sum(1)) for then in books.history])
        others = np.zeros_like(own)
        for j in range(own.shape[1]):
            others[:, j] = np.delete(own, j, 1).max(1, initial=0.0)
        out.append((own * (1 + _SLACK), others * (1 + _SLACK)))
    return out


def assign_part(x: np.ndarray, book: np.ndarray, now: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, stamps: np.ndarray, moves: tuple[np.ndarray, np.ndarray] | None) -> int:
    """Bring one part position's codes and bounds up to round ``now``, in place; ``stamps``
    are the rounds of the upper and of the lower bounds.  Without ``moves`` (the first
    round) all are scanned.  Returns how many parts were scanned over all entries."""
    if moves is None:
        open_ = np.arange(len(x))
    else:
        up = upper + moves[0][stamps[:, 0], code]
        low = lower - moves[1][stamps[:, 1], code]
        open_ = np.flatnonzero(up >= low)
        if len(open_):
            upper[open_] = np.sqrt(_squares(x[open_], book[code[open_]]).astype(np.float64)) * (1 + _SLACK)
            stamps[open_, 0] = now
            open_ = open_[upper[open_] >= low[open_]]
    for at in range(0, len(open_), 1 << 14):
        rows = open_[at : at + (1 << 14)]
        d = np.stack([_squares(x[rows], e) for e in book], 1)
        best = d.argmin(1)  # the lowest index of equal ones
        line = np.arange(len(rows))
        upper[rows] = np.sqrt(d[line, best].astype(np.float64)) * (1 + _SLACK)
        d[line, best] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK) if len(book) > 1 else np.inf
        code[rows], stamps[rows] = best, now
    return len(open_)


def _flat(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    """A column of equally long binaries as a writable (rows, width) array."""
    column = batch.column(name)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, batch.num_rows * width, int(start)).reshape(batch.num_rows, width).copy()


def _binaries(values: np.ndarray) -> pa.Array:
    n, size = len(values), values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(values))])


def _round(state: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """One assignment: the state's rows with new codes and bounds, and a task's last row
    with its counts and sums of each (part, entry).  ``last`` gives the final errors."""
    now = len(books.history) - 1
    moves = net_moves(books) if now else None
    width, parts = books.cuts[-1], books.parts
    book = [b.astype(np.int64) for b in books.history[-1]]
    entries = len(book[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = [np.zeros(b.shape, np.int64) for b in book]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _flat(batch, "x", "<i4", width) if now else np.asarray(batch.column("v").flatten().to_numpy(), np.int32).reshape(n, width)
            if now:
                code, upper, lower, stamps = (_flat(batch, *told) for told in (("code", "u1", parts), ("upper", "<f8", parts), ("lower", "<f8", parts), ("stamps", "u1", 2 * parts)))
            else:
                code, upper, lower, stamps = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros((n, 2 * parts), np.uint8)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                own = x[:, books.cuts[p] : books.cuts[p + 1]].astype(np.int64)
                c, u, w, s = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy(), stamps[:, 2 * p : 2 * p + 2].copy()
                assign_part(own, book[p], now, c, u, w, s, moves[p] if moves else None)
                code[:, p], upper[:, p], lower[:, p], stamps[:, 2 * p : 2 * p + 2] = c, u, w, s
                if last:
                    error += _squares(own, book[p][c])
                else:
                    counts[p] += np.bincount(c, minlength=entries)
                    np.add.at(sums[p], c, own)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binaries(code), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *map(_binaries, (x, code, upper, lower, stamps)), none, none], [*_STATE, "counts", "sums"])
        if not last:
            lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (counts.reshape(-1), np.concatenate([s.reshape(-1) for s in sums]) if sums else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(5)), *lists], [*_STATE, "counts", "sums"])

    source = state if not now else state.where("counts is null").select(*_STATE)
    return source.mapInArrow(run, "vec_id long, label int, code binary, error long" if last else _STATE_SCHEMA)


def _totals(state: DataFrame, column: str) -> list[int]:
    """The elementwise sums of the tasks' lists: a row for each place reaches the driver."""
    each = state.where("counts is not null").select(F.posexplode(column).alias("at", "n"))
    rows = each.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    return [int(r["n"]) for r in sorted(rows, key=lambda r: r["at"])]


def _moved(state: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """The next codebooks: floor of mean, unused entries stay."""
    counts, sums = _totals(state, "counts"), _totals(state, "sums")
    at, out = 0, []
    for p, book in enumerate(books.history[-1]):
        own = book.copy()
        for e in range(len(book)):
            n = counts[p * len(book) + e]
            if n:
                own[e] = [s // n for s in sums[at : at + book.shape[1]]]
            at += book.shape[1]
        out.append(own)
    return out


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of all vectors kept (``code``: an index byte for each
    part), a written table, and the codebooks of all rounds."""
    if not 1 <= entries <= 256 or not 1 <= rounds < 255:
        raise ValueError("codes and stamps are single bytes")
    spark = store.ready(df.sparkSession)
    kept = whole_vectors(df, scale, id_col, vector_col, label_col)
    width = kept.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    kept = kept.where((F.size("v") == width) & (F.size("v") > 0))
    cuts = [i * width // parts for i in range(parts + 1)]
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()] if width else []
    if not first:
        return spark.createDataFrame([], "vec_id long, label int, code binary, error long"), Codebooks(cuts, [[np.zeros((0, 0), np.int64)] * parts])
    start = np.array(first, np.int64)
    books = Codebooks(cuts, [[start[:, a:b] for a, b in zip(cuts, cuts[1:])]])
    state, address = kept, None
    for _ in range(rounds):
        after = store.new_folder(spark, "vector-state")
        _round(state, books, False).write.option("compression", "zstd").parquet(after)
        if address:
            store.delete(spark, address)
        state, address = spark.read.schema(_STATE_SCHEMA).parquet(after), after
        books.history.append(_moved(state, books))
    coded = store.written(_round(state, books, True), "vector-codes")
    if address:
        store.delete(spark, address)
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over equal labels, nulls together."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
