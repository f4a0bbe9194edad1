"""Audit of how sources of one language differ in their words, priced exactly.

A term's count in a (language, source) group is one of few *levels*: most terms of a group
share a handful of small counts.  With one indicator column for each (group, level) and a
row for each term, the product of the transposed matrix with itself holds every joint
table: how many terms have level a in group g and level b in group h.  A divergence is a
price of the two levels' probabilities, so a joint table prices a pair of groups without
going back to the terms.

* Terms are counted in the tasks that read the texts, texts whole, then summed.
* The products are taken in blocks of terms, in order of their total count, so that a block
  has few levels; wide blocks are halved, and a single term's columns are sliced.  They are
  sums of at most ``BLOCK`` ones, hence exact in single precision.
* Level 0 (terms a group lacks) has no column: what is missing in a joint table follows from
  the groups' own level counts and the number of terms.
* Prices are whole numbers: p = 1 + floor(1e9 (count + 2) / (N + 2 V)) and
  f(p, q) = floor((p - q)^2 / (p + q)).

Cases: a null text, language or source counts as ''; a text without terms adds its group;
repeated rows count each; a language without kept terms gives each pair the value 0; ties
rank by the item's UTF-8 bytes; other columns aren't read; an empty table gives no rows.
Very long texts are split into terms piece by piece (pieces end where a term ends).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliper.llm import store

SCALE = 1_000_000_000
BLOCK = 4096  # terms of a block
WIDE = 1024  # columns of a product
_PIECE = 4 << 20
_ROOM = 400_000  # counts held in a task before they are passed on

#: Bytes of terms: ASCII letters, A-Z as a-z, and all of UTF-8 beyond ASCII; others cut.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in runs of about ``_PIECE`` bytes that end where a term ends."""
    at = 0
    while len(text) - at > _PIECE:
        stop = at + _PIECE
        while stop < len(text) and _TERMS[text[stop]] != 32:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs`` summed over all rows: how often a term occurs in the
    group and in how many of its rows.  Each group also has one row whose term is null."""
    store.ready(df.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            values = [0, *n.values()], [0, *(docs[t] for t in n)]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                                              *(pa.array(v, pa.int64()) for v in values)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source")), strict=True):
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for piece in _pieces(text.as_buffer().to_pybytes()):
                    terms = piece.translate(_TERMS).split()
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n)
                if size > _ROOM:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    texts = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counted = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, total, entries``: the terms in at least ``least_docs`` rows of their
    language, with the (source, n) of the groups that have them."""
    per = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return per.where(F.col("docs") >= least_docs).select("lang", "term", "total", "entries")


def probability(count: str, total: str) -> F.Column:
    """1 + floor(SCALE (count + 2) / total) of two columns, in exact decimals."""
    return F.expr(f"1 + (CAST({count} + 2 AS DECIMAL(20, 0)) * {SCALE}) div CAST({total} AS DECIMAL(20, 0))")


def price(p: str, q: str) -> F.Column:
    """f(p, q) of two columns; (p - q)^2 is at most SCALE^2, within a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def group_table(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, n, v, m, zero, lang_m``: each occurring group's sum over kept terms,
    its language's number of kept terms, N + 2 V, the p of a term it lacks, and N + 2 V of
    the language.  p is null where a language keeps no term."""
    own = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n", "v", "lang_n"]).withColumns({"m": F.expr("n + 2 * v"), "lang_m": F.expr("lang_n + 2 * v")})
    return groups.withColumn("zero", F.when(F.col("v") > 0, probability("0", "m")))


def joint_tables(terms: DataFrame) -> DataFrame:
    """``lang, left, left_n, right, right_n, terms``: for each two groups of a language, left
    before right, and each two counts above 0, how many terms have the one count in the one
    and the other in the other group."""
    store.ready(terms.sparkSession)
    names = ["lang", "left", "left_n", "right", "right_n", "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, waiting = None, []
        for batch in batches:
            for own, entries in zip(batch.column("lang").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if waiting and (own != lang or len(waiting) == BLOCK):
                    yield from _products(lang, waiting, names)
                    waiting = []
                lang = own
                waiting.append(entries)
        if waiting:
            yield from _products(lang, waiting, names)

    ordered = terms.select("lang", "total", "entries").sortWithinPartitions("lang", "total").select("lang", "entries")
    told = ordered.mapInArrow(run, "lang string, left string, left_n long, right string, right_n long, terms long")
    return told.groupBy("lang", "left", "left_n", "right", "right_n").agg(F.sum("terms").alias("terms"))


def _products(lang: str, block: list[list[dict]], names: list[str]) -> Iterator[pa.RecordBatch]:
    sources = sorted({e["source"] for row in block for e in row}, key=lambda s: s.encode())
    code = {s: i for i, s in enumerate(sources)}
    term = np.repeat(np.arange(len(block)), [len(row) for row in block])
    group = np.array([code[e["source"]] for row in block for e in row], np.int64)
    count = np.array([e["n"] for row in block for e in row], np.int64)
    for left, left_n, right, right_n, both in level_products(term, group, count):
        words = pa.array(sources)
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(both)), words.take(pa.array(left)), pa.array(left_n), words.take(pa.array(right)), pa.array(right_n), pa.array(both)], names)


def level_products(term: np.ndarray, group: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Non-zero entries (group, count, group, count, terms) above the diagonal of the one-hot
    level matrix' product with itself, from its ones' (term, group, count), ordered by term.
    A block with over ``WIDE`` columns is halved by terms; a single term's are sliced."""
    columns, at = np.unique(np.stack([group, count]), axis=1, return_inverse=True)
    at = at.reshape(-1)
    rows = int(term[-1] - term[0]) + 1
    if columns.shape[1] > WIDE and rows > 1:
        cut = np.searchsorted(term, term[0] + rows // 2)
        for part in (slice(None, cut), slice(cut, None)):
            if len(term[part]):
                yield from level_products(term[part], group[part], count[part])
        return
    starts = range(0, columns.shape[1], WIDE)
    slabs = []
    for s in starts:
        mine = (at >= s) & (at < s + WIDE)
        x = np.zeros((rows, min(WIDE, columns.shape[1] - s)), np.float32)
        x[term[mine] - term[0], at[mine] - s] = 1
        slabs.append(x)
    for i, s in enumerate(starts):
        for j in range(i, len(slabs)):
            both = slabs[i].T @ slabs[j]
            a, b = np.nonzero(both)
            n = both[a, b].astype(np.int64)
            a, b = a + s, b + starts[j]
            keep = columns[0, a] < columns[0, b]
            a, b = a[keep], b[keep]
            if len(a):
                yield columns[0, a], columns[1, a], columns[0, b], columns[1, b], n[keep]


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each ordered pair of groups of a language the sum
    of f over all kept terms.  With J the joint table, n the groups' own level counts and 0
    for the level of terms that a group lacks, that is the sum of
    J(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)) over a, b > 0, of
    n(a) (f(a, 0) - f(0, 0)) over the levels a of either group, and of V f(0, 0)."""
    entries = terms.select("lang", F.explode("entries").alias("e")).select("lang", "e.source", "e.n")
    of = {side: groups.select("lang", F.col("source").alias(side), F.col("m").alias(f"{side}_m"), F.col("zero").alias(f"{side}_zero")) for side in ("left", "right")}
    joint = joint_tables(terms).join(of["left"], ["lang", "left"]).join(of["right"], ["lang", "right"])
    joint = joint.withColumns({"p": probability("left_n", "left_m"), "q": probability("right_n", "right_m")})
    gain = price("p", "q") - price("p", "right_zero") - price("left_zero", "q") + price("left_zero", "right_zero")
    joint = joint.groupBy("lang", "left", "right").agg(F.sum(F.col("terms") * gain).alias("value"))
    both = joint.unionByName(joint.select("lang", F.col("right").alias("left"), F.col("left").alias("right"), "value"))

    levels = entries.groupBy("lang", F.col("source").alias("left"), F.col("n").alias("left_n")).agg(F.count("*").alias("terms"))
    levels = levels.join(of["left"], ["lang", "left"]).withColumn("p", probability("left_n", "left_m"))
    levels = levels.groupBy("lang", "left", "p", "left_zero").agg(F.sum("terms").alias("terms"))
    alone = levels.join(of["right"], "lang").where("left != right")
    alone = alone.groupBy("lang", "left", "right").agg(F.sum(F.col("terms") * (price("p", "right_zero") - price("left_zero", "right_zero"))).alias("value"))
    alone = alone.unionByName(alone.select("lang", F.col("right").alias("left"), F.col("left").alias("right"), "value"))

    every = of["left"].join(groups.select("lang", F.col("source").alias("right"), "v", F.col("zero").alias("right_zero")), "lang").where("left != right")
    every = every.select("lang", "left", "right", F.coalesce(F.col("v") * price("left_zero", "right_zero"), F.lit(0)).alias("value"))
    summed = every.unionByName(both).unionByName(alone).groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.col("left").alias("source"), F.col("right").alias("item"), "value")


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the terms that a group has and that are likelier in it
    than in its language."""
    entries = terms.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    priced = entries.join(groups.select("lang", "source", "m", "lang_m"), ["lang", "source"]).withColumns({"p": probability("n", "m"), "q": probability("total", "lang_m")})
    return priced.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), price("p", "q").alias("value"))


def audit(df: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks all other sources of the
    language by divergence, part ``term`` the ``top`` terms that set a group off."""
    counts = store.written(term_counts(df, text_col, lang_col, source_col), "audit-counts")
    terms = store.written(kept_terms(counts, least_docs), "audit-terms")
    groups = store.written(group_table(counts, terms), "audit-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(terms, groups).withColumn("rank", F.row_number().over(order))
    best = term_values(terms, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(best.withColumn("part", F.lit("term")).select(columns))
