"""Near-duplicate documents by min-max hashing.

A document is its set of distinct k-word shingles.  Under each of ``permutations``
permutations of the 64-bit shingle hashes both the smallest and the largest value are
kept, so half the hash evaluations give a signature of a given length, and one of lower
variance.  Each band of ``rows`` signature values is a bucket key; two documents of
similarity s miss each other in all bands with probability (1 - s^rows)^bands, 5e-8 at 0.8
with 64 permutations and bands of 4.

Exact copies (equal sets) become one node first.  In a bucket each node is compared with
the bucket's hub, its smallest node, so near-copy groups cost one comparison a node and
bucket.  What the hub doesn't link may still link with another node x of the hub's group;
such pairs are found by what they have in common *against* the hub, see :func:`traces_of`:
nodes meet on samples of these differences, some seventeen times for a link, whatever the
texts' length.  What grows faster than a group is the number of its nodes that neither the
hub nor the smallest holder of a difference links, paired where they share differences and
their sizes and outlines don't rule a link out.  Links are confirmed on the full sets.

The rounds of the search for components grow with the longest chain of links, not with rows.

Cases: a null or empty text (no words) has the empty set and links with nothing; fewer
than k words are one shingle; rows with a null id are in no component (component_id null,
kept); rows that repeat an id each get the component of their own text; other columns
aren't read; a very long text is one set; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm import hashing, store

THRESHOLD = 80  # per cent


def _shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    words, at = hashing.word_hashes(*hashing.texts_buffer(column))
    return [np.unique(hashing.runs(words[at[i] : at[i + 1]], k)) for i in range(len(column))]


def signature(sets: list[np.ndarray], permutations: int, seed: int = 1) -> np.ndarray:
    """For non-empty sets a row each: the minima, then the maxima, of all permutations."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, permutations, np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for p in range(permutations):
        value = flat * a[p] + b[p]
        value ^= value >> np.uint64(32)  # so that order hangs on all bits; still a permutation
        value *= a[p]
        out[:, p] = np.minimum.reduceat(value, starts)
        out[:, permutations + p] = np.maximum.reduceat(value, starts)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; a band's number is part of its key."""
    n, width = signatures.shape
    keys = np.repeat(np.arange(1, width // rows + 1, dtype=np.uint64)[None, :], n, 0)
    for j in range(rows):
        keys = hashing.mix(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, j::rows][:, : width // rows])
    return keys


def signatures(df: DataFrame, k: int, permutations: int = 64, rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` from ``doc_id, text``: the set's size, a
    128-bit digest of the set (null if empty) and the band keys.  Narrow."""
    store.ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in store.slices(batches, "text"):
            sets = _shingle_sets(part.column("text"), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signature(full, permutations), rows).view(np.int64)) if full else iter(())
            bands = pa.array([next(keys) if n else None for n in sizes], pa.list_(pa.int64()))
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), digests, bands], ["doc_id", "n_shingles", "digest", "bands"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _similar_sizes(a: str, b: str) -> F.Column:
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def set_table(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``node, members``: the full sets (sorted 64-bit hashes) of the nodes' texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in store.slices(batches, "text"):
            sets = [s.tobytes() for s in _shingle_sets(part.column("text"), k)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["node", "members"])

    wanted = texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return store.written(wanted.select("doc_id", "text").mapInArrow(make, "node long, members binary"), "dedup-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(y, "b").join(x, "a")


def _common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which elements of the sorted set p are in the sorted set q."""
    if not len(q):
        return np.zeros(len(p), bool)
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return q[at] == p


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, linked`` of pairs ``a, b`` on their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(_common(p, q).sum())
                ok.append(100 * both >= THRESHOLD * (len(p) + len(q) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    told = _with_sets(pairs, sets).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")
    return told.groupBy("a", "b").agg(F.max("linked").alias("linked"))


ABOUT, SAME, FAR, NEAR = -1, 0, 2, 4  # kinds of traces; NEAR + i for the i-th class of sizes
MEETINGS = 17  # expected number of shared traces of a link: none with probability e^-17


def sampled(hashes: np.ndarray, common: float) -> np.ndarray:
    """The elements that a hash of their own picks, so many that of ``common`` shared ones
    about ``MEETINGS`` are among them; all if there are fewer."""
    if common <= MEETINGS:
        return hashes
    return hashes[hashing.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) < np.uint64(int(MEETINGS / common * 2.0**64))]


def size_class(d: int) -> int:
    """Sizes of differences from 2^(i + 8) to twice that are class i + 1, smaller ones 0."""
    return max(0, int(d).bit_length() - 8)


def traces_of(p: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bool, np.ndarray]]]:
    """What a node's set p and its hub's set h differ in, and (kind, asks, hashes) traces.

    Let D(x, y) be the number of shingles that are in one set only; a link is
    9 D(x, y) <= |x| + |y|.  With d_x = what x and the hub differ in, D(x, y) is
    D_x + D_y - 2 |d_x & d_y|, so a link of x, which the hub doesn't link, bounds
    c = |d_x & d_y| from below; with the excess e_x = 9 D_x - |x| - |h| > 0:

    * y linked with the hub: c > 4/9 D_y, and c >= e_x / 10;
    * y not linked with the hub: c > (e_x + 2 |h|) / 18.

    Two sets that share c elements share j of them among the first |d| - c + j of each in
    any common order.  The order is: what the hub lacks, then what it has, by hash; so the
    rare additions come first, and few of the removals that many copies have in common.
    Where c is large, j is, too, and of these prefixes a sample by the elements' hashes will
    do: it keeps ``MEETINGS`` of the j shared ones on average, and a link goes unseen with
    probability e^-17 = 4e-8, like the one that two texts share no bucket.

    * A node with over 3/10 of own shingles asks by its own set in the same order: a link
      shares four fifths of it, hence at least a tenth lies outside the hub and is shared,
      among the first 13/40 of either set (sizes of links differ by a quarter at most).
    * Nodes linked with the hub are in classes by D_y, for j follows it; who asks has a
      sample for each class.
    * Of two nodes not linked with the hub, their bounds of c differ by a factor of 9/4 at
      most, which the samples allow for."""
    inside = _common(p, h)
    own, lost = p[~inside], h[~_common(h, p)]
    n, size, d = len(p), len(h), len(own) + len(lost)
    excess = 9 * d - n - size
    order = np.concatenate([own, lost])
    asks = excess > 0 and 10 * len(own) > 3 * n
    out = [(SAME, asks, sampled(own[: 13 * n // 40 + 2], 2 * n / 25 - 1))]
    if asks:
        return order, out
    if excess <= 0:
        i = size_class(d)
        if not i:
            return order, [*out, (NEAR, False, order[: d - 4 * d // 9])]
        return order, [*out, (NEAR + i, False, sampled(order[: d - 4 * d // 9 + d // 9], (128 << i) / 9 - 1))]
    if excess < 2560:  # D_y is at least e_x / 10, and at most a quarter of the hub
        out.append((NEAR, True, order[: d - max(1, -(-excess // 10)) + 1]))
    for i in range(size_class(excess // 10) or 1, size_class(-(-size // 4)) + 1):
        out.append((NEAR + i, True, sampled(order[: max(0, d - (128 << i) // 3 + 1)], (128 << i) / 9 - 1)))
    c = (excess + 2 * size) // 18
    if c <= 72:  # the other's bound is at most 162: neither is sampled, and one shared element will do
        return order, [*out, (FAR, True, order[: max(0, d - c)])]
    return order, [*out, (FAR, True, sampled(order[: max(0, d - c + c // 4)], c / 9 - 1))]


WORDS = 16
_BITS = tuple(f"b{i}" for i in range(WORDS))


def outline(differences: np.ndarray) -> np.ndarray:
    """1,024 bits, one set for each difference by its hash.  A bit that x has and y lacks is
    a difference of x alone, so |d_x & d_y| is at most D_x less the number of such bits."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(hashing.mix(differences) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def traces(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, kind, trace, asks, node, d, outline`` from ``a`` (hub) and ``b`` (node), see
    :func:`traces_of`: pairs of nodes that may link share hub, kind and trace, and one of the
    two asks.  Each hub and node have one more row, of kind ``ABOUT``, with the number of
    differences and their :func:`outline`; both are null elsewhere."""
    names = ["hub", "kind", "trace", "asks", "node", "d", "outline"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True):
                order, kinds = traces_of(np.frombuffer(y.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64))
                sizes = [1, *(len(found) for _, _, found in kinds)]
                n = sum(sizes)
                kind = np.repeat(np.array([ABOUT, *(k for k, _, _ in kinds)], np.int32), sizes)
                asks = np.repeat(np.array([False, *(asking for _, asking, _ in kinds)]), sizes)
                told = np.concatenate([np.zeros(1, np.uint64), *(found for _, _, found in kinds)]).view(np.int64)
                first = pa.array(np.arange(n) > 0)  # null but in the first row
                d = pa.array(np.full(n, len(order)), mask=first.to_numpy(zero_copy_only=False))
                outlines = pa.array([outline(order).tolist(), *[None] * (n - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.repeat(a, n), pa.array(kind), pa.array(told), pa.array(asks), pa.repeat(b, n), d, outlines], names)

    return _with_sets(grouped, sets).select("a", "b", "x", "y").mapInArrow(
        run, "hub long, kind int, trace long, asks boolean, node long, d long, outline array<long>")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest reachable node) for all nodes of links ``a, b``: the
    smallest label among neighbours, then the label's own label, until nothing changes."""
    both = store.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "dedup-links")
    labels = store.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("better"))
        step = store.written(step, "dedup-steps")
        jump = step.select(F.col("node").alias("better"), F.col("better").alias("further"))
        nearer = step.join(jump, "better", "left").select("node", "component", F.least("better", "further").alias("next"))
        nearer = store.written(nearer, "dedup-steps")
        if nearer.where("next < component").isEmpty():
            return labels
        labels = nearer.select("node", F.col("next").alias("component"))


_TOLD = ("component", "n", "d", *_BITS)


def _placed(found: DataFrame, labels: DataFrame, column: str = "node") -> DataFrame:
    """``component`` of a column's nodes: their label, else themselves."""
    own = labels.select(F.col("node").alias(column), "component")
    return found.join(own, column, "left").withColumn("component", F.coalesce("component", column))


def _may_link(x: str, y: str) -> F.Column:
    """Whether two nodes (columns with these prefixes) are in different components and may
    link by their sizes and outlines."""

    def alone(p: str, q: str) -> F.Column:
        return sum((F.bit_count(F.col(f"{p}{b}").bitwiseAND(F.bitwise_not(F.col(f"{q}{b}")))) for b in _BITS), F.lit(0))

    common = F.least(F.col(f"{x}d") - alone(x, y), F.col(f"{y}d") - alone(y, x))  # at most
    close = 9 * (F.col(f"{x}d") + F.col(f"{y}d") - 2 * common) <= F.col(f"{x}n") + F.col(f"{y}n")
    return (F.col(f"{x}component") != F.col(f"{y}component")) & _similar_sizes(f"{x}n", f"{y}n") & close


def _pairs(met: DataFrame, name: str) -> DataFrame:
    return store.written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)


def _side(found: DataFrame, about: DataFrame, name: str, *more: str) -> DataFrame:
    """Trace rows as one side of a meeting: the node as ``name`` and what is known of it."""
    return found.join(about, ["hub", "node"]).select("hub", "kind", "trace", F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _TOLD), *more)


def _linked(members: DataFrame, sizes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """All ``node, component`` of more than one node, from ``key, node, n`` of buckets of
    two or more nodes: links with the buckets' hubs; then, among the nodes that share a
    trace, links with the smallest of them; then what may still join two components."""
    hubs = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h")).select("key", F.col("h.node").alias("a"), F.col("h.n").alias("hub_n"))
    hubs = store.written(hubs, "dedup-hubs")
    grouped = members.withColumnRenamed("node", "b").join(hubs, "key").where("a < b").select("a", "b", "n", "hub_n").distinct()
    grouped = store.written(grouped, "dedup-groups")
    involved = grouped.select(F.col("a").alias("node")).unionByName(grouped.select(F.col("b").alias("node"))).distinct()
    sets = set_table(store.written(involved, "dedup-involved"), texts, k)

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        return store.written(compared(pairs, sets), name).where("linked").select("a", "b")

    links = links_of(grouped.where(_similar_sizes("n", "hub_n")).select("a", "b"), "dedup-first")
    labels = components(links)
    placed = _placed(grouped.select("a", "b"), labels, "b")
    placed = _placed(placed.withColumnRenamed("component", "of_node"), labels, "a")
    placed = store.written(placed.withColumnRenamed("component", "of_hub"), "dedup-placed")
    apart = placed.groupBy("a").agg(F.min("of_node").alias("low"), F.max("of_node").alias("high"), F.min("of_hub").alias("own"))
    apart = store.written(apart.where("low != high or low != own").select("a"), "dedup-apart")
    drawn = store.written(traces(placed.join(apart, "a", "left_semi").select("a", "b"), sets), "dedup-traces")
    found = drawn.where(F.col("kind") != ABOUT).select("hub", "kind", "trace", "asks", "node")
    about = drawn.where(F.col("kind") == ABOUT).select("hub", "node", "d", *(F.col("outline")[i].alias(b) for i, b in enumerate(_BITS)))
    about = store.written(about.join(sizes, "node"), "dedup-about")

    now = store.written(_placed(about, labels), "dedup-about")
    least = found.groupBy("hub", "kind", "trace").agg(F.min("node").alias("node"), F.count("*").alias("m")).where("m > 1")
    met = _side(found, now, "x").join(_side(least, now, "y"), ["hub", "kind", "trace"]).where(_may_link("x_", "y_"))
    more = links_of(_pairs(met, "dedup-pairs"), "dedup-more")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
        now = store.written(_placed(about, labels), "dedup-about")
    found_by = f"kind = {SAME} or kind = {FAR} and asks or kind >= {NEAR} and not asks"
    x, y = _side(found.where("asks"), now, "x"), _side(found.where(found_by), now, "y", "asks")
    once = ~F.col("asks") | (F.col("x") < F.col("y"))  # of two that ask, the smaller one
    met = x.join(y, ["hub", "kind", "trace"]).where(once & _may_link("x_", "y_"))
    rest = links_of(_pairs(met, "dedup-pairs"), "dedup-more")
    return labels if rest.isEmpty() else components(links.unionByName(rest))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, permutations: int = 64, rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: links are pairs of sets
    with 100 * intersection >= 80 * union; the component is named by its smallest id."""
    texts = store.as_text(df, id_col, text_col)
    own = store.written(signatures(texts, k, permutations, rows), "dedup-signatures")
    whole = own.where("doc_id is not null and digest is not null")
    classes = whole.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    classes = store.written(classes, "dedup-classes")
    rows_of = store.written(classes.select("node", "n", F.explode("bands").alias("key")), "dedup-bands")
    shared = store.written(rows_of.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "dedup-keys")
    members = store.written(rows_of.join(shared, "key", "left_semi"), "dedup-buckets")
    labels = None if members.isEmpty() else _linked(members, classes.select("node", "n").groupBy("node").agg(F.max("n").alias("n")), texts.where("doc_id is not null"), k)
    to = classes.select("digest", "node", "copies")
    to = to.withColumn("component", F.col("node")) if labels is None else to.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    to = store.written(to.where("copies > 1 or component != node").select("digest", "component"), "dedup-classes")
    out = own.select("doc_id", "n_shingles", "digest").join(to, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
