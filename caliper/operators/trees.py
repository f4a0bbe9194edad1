"""Tree ensembles from binned features: softmax gradient boosting and balanced forests.

Features are binned once, by at most 255 quantile edges of the training rows; a row is then
a string of byte codes, and every fit reads codes.

**Boosting** (M9): each round grows one tree a class on the gradients of the softmax loss,
leaf by leaf in the order of gain.  A tree needs the sums of gradient, hessian and rows by
(node, feature, bin); a leaf's two children are summed together, the smaller from its rows,
the other one by subtraction.  Features of few bins are summed together (:class:`Joint`).
Gradients and hessians are fixed-point numbers, so the sums are exact and trees don't hang
on how rows are partitioned.

* Fits of up to ``LOCAL_ROWS`` training rows are a group each (one task a fit), so folds and
  grid points run side by side.
* Larger fits run as one barrier stage, a task for ``TASK_ROWS`` rows but one a core at most
  (every step waits for the slowest task): each task holds its share of the
  codes with their scores and nodes, sums its histograms, and all tasks read each other's
  sums, a number for each (node, feature, bin), in the shared checkpoint folder and grow the
  same trees from them (``BarrierTaskContext.allGather`` looks for answers once a second only).
* Where that can't run (dynamic allocation, an unknown number of cores, a checkpoint folder
  that isn't mounted), every step is a job: tasks sum histograms while they read the codes, a shuffle adds them up.
  Scores are written anew every few rounds; in between, a task adds the few trees grown
  since.  All ways give the same trees.

**Forests** (M8): a tree grows from a bootstrap sample of all training rows, drawn by hash
(Poisson counts of mean one), with class weights balanced within the sample.  Nodes of over
``NODE_ROWS`` rows are split by counts of draws by (code, class), whole numbers; smaller ones
by sorting their rows.  Splits are looked for in a hashed choice of features
of each node, so a tree cut at a depth is the tree grown to that depth, and the first trees
of a forest are the smaller forest.

* Up to ``TREE_ROWS`` training rows, ``CHUNK`` trees are a group, grown in a task.
* From more rows, tasks add up the counts of nodes of over ``PART_ROWS`` rows, a group a node,
  and each smaller node's part of the tree is grown in a task.  Both ways give the same trees.
* Trees grow with the rows, so a forest stays in files (:class:`Grove`).
"""

from __future__ import annotations

import heapq
import os
import pickle
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.session import cut_lineage, ensure_checkpoint_dir, ship_package

BINS = 256
LOCAL_ROWS = 200_000
TASK_ROWS = 80_000
NODE_ROWS = 20_000
CHUNK = 10
REFRESH = 10
SMALL = 1 << 14
TREE_ROWS = 600_000
PART_ROWS = 300_000
SLICE = 8192
BLOCK = 200_000
KEPT_BYTES = 32 << 20
MASKED = 32
ROOT = np.array([1], np.uint64)


# ------------------------------------------------------------------ bins

def row_key(df: DataFrame) -> F.Column:
    """A number for each row that doesn't hang on its place: from ``row_id`` if there is one."""
    return F.xxhash64("row_id") if "row_id" in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")])


def bin_edges(x: DataFrame) -> dict[int, list[np.ndarray]]:
    """For each fit and feature the thresholds between neighbouring quantiles of the training
    rows (``fit, held, features`` array): one grouped job, a row for each (fit, feature)."""
    each = x.where("not held").select("fit", F.posexplode("features").alias("at", "v"))
    q = F.percentile_approx("v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 10_000)
    rows = each.groupBy("fit", "at").agg(q.alias("q"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        v = np.unique(np.array([r["low"], *r["q"], r["high"]], np.float64))[: BINS]
        out.setdefault(r["fit"], {})[r["at"]] = (v[:-1] + v[1:]) / 2
    return {f: [own[i] for i in range(len(own))] for f, own in out.items()}


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Code c of a value: the number of thresholds below it."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


def coded(x: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """``fit, held, row, label, codes`` written once; all fits read it."""
    ship_package(x.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column("fit").to_numpy()
            for f in np.unique(fits):
                part = batch.filter(pa.array(fits == f))
                values = part.column("features").flatten().to_numpy().reshape(part.num_rows, -1)
                rows = [r.tobytes() for r in codes_of(values, edges[int(f)])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("fit", "held", "row", "label")] + [pa.array(rows, pa.binary())], ["fit", "held", "row", "label", "codes"])

    return cut_lineage(x.select("fit", "held", "row", "label", "features").mapInArrow(run, "fit int, held boolean, row long, label int, codes binary"))


# ------------------------------------------------------------------ ensembles

@dataclass
class Ensemble:
    """Trees as flat arrays (``feature`` is -1 at leaves); tree t adds its leaf's value to
    class ``of[t]``, or its whole row of class shares where ``of[t]`` is -1."""

    classes: int
    roots: list[int] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    base: np.ndarray | None = None
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray | None = None

    def add(self, trees: list[dict], of: list[int]) -> None:
        at = len(self.feature)
        parts: dict[str, list] = {k: [getattr(self, k)] for k in ("feature", "cut", "left", "right", "gain")}
        values = [] if self.value is None else [self.value]
        for tree, k in zip(trees, of, strict=True):
            self.roots.append(at)
            self.of.append(k)
            for name in ("feature", "cut", "gain"):
                parts[name].append(tree[name])
            for name in ("left", "right"):
                parts[name].append(np.where(tree["feature"] < 0, 0, tree[name] + at))
            values.append(tree["value"])
            at += len(tree["feature"])
        for name, arrays in parts.items():
            setattr(self, name, np.concatenate(arrays).astype(getattr(self, name).dtype))
        self.value = np.concatenate(values)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # what is remembered for scoring isn't passed on

    def leaves(self, x: np.ndarray, tree: int, limits: list[np.ndarray] | None = None, depth: int | None = None) -> np.ndarray:
        """The leaf of each row of codes, or of values by ``limits``, the thresholds."""
        return self._found(*self._columns(x, limits), tree, depth)

    def _columns(self, x: np.ndarray, limits) -> tuple[np.ndarray, np.ndarray]:
        """Codes, a line a feature, and the code up to which each node's rows go left.  A value's
        code is the number of the ensemble's thresholds of that feature below it."""
        if limits is None:
            return np.ascontiguousarray(x.T), self.cut
        known = self.__dict__.get("_known")
        if known is None or len(known[1]) != len(self.feature):
            steps, cut = [], np.zeros(len(self.feature), np.int64)
            for f in range(int(self.feature.max(initial=-1)) + 1):
                mine = np.flatnonzero(self.feature == f)
                own, cut[mine] = np.unique(np.asarray(self.threshold)[mine], return_inverse=True)
                steps.append(own)
            known = self._known = steps, cut
        steps, cut = known
        kind = np.uint8 if max(map(len, steps), default=0) < BINS else np.int64
        codes = [np.searchsorted(own, x[:, f], "left") for f, own in enumerate(steps)]
        return np.array(codes, kind).reshape(len(steps), len(x)), cut

    def _found(self, columns: np.ndarray, cut: np.ndarray, tree: int, depth: int | None) -> np.ndarray:
        first, stop = self.roots[tree], self.roots[tree + 1] if tree + 1 < len(self.roots) else len(self.feature)
        count = columns.shape[1]
        if depth is None and stop - first <= 2 * MASKED - 1 and columns.dtype == np.uint8:
            return first + self._by_masks(columns, cut, tree, first, stop)
        feature, kids = self.feature[first:stop].astype(np.int64), np.stack([self.left[first:stop], self.right[first:stop]], 1).ravel().astype(np.int64) - first
        cut, flat = cut[first:stop], columns.ravel()
        out, rows, node = np.zeros(count, np.int64), np.arange(count), np.zeros(count, np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.all():  # go on with the rows that aren't at a leaf
                out[rows[~inner]] = node[~inner]
                rows, node, f = rows[inner], node[inner], f[inner]
            if not len(rows) or depth == 0:
                break
            node = kids[2 * node + (flat[f * count + rows] > cut[node])]
            depth = None if depth is None else depth - 1
        out[rows] = node
        return first + out

    def _by_masks(self, columns: np.ndarray, cut: np.ndarray, tree: int, first: int, stop: int) -> np.ndarray:
        """The leaves of a small tree: a bit a leaf from left to right.  A node whose rows go
        right takes the bits of its left leaves away; the lowest bit that stays is the leaf.
        What all nodes of a feature take away is a table by code."""
        masks = self.__dict__.setdefault("_masks", {})
        key = (tree, cut is self.cut)
        if key not in masks:
            order, tables, todo = [], {}, [(first, None)]
            while todo:  # left subtrees first, so leaves come from left to right
                x, mine = todo.pop()
                if mine is not None:
                    f, c = int(self.feature[x]), int(cut[x])
                    away = ((1 << len(order)) - 1) ^ ((1 << mine) - 1)
                    tables.setdefault(f, np.full(BINS, (1 << MASKED) - 1, np.uint32))[c + 1 :] &= np.uint32(~away & ((1 << MASKED) - 1))
                elif self.feature[x] < 0:
                    order.append(x - first)
                else:
                    todo += [(int(self.right[x]), None), (x, len(order)), (int(self.left[x]), None)]
            masks[key] = list(tables.items()), np.array(order, np.int64)
        tables, order = masks[key]
        left = np.full(columns.shape[1], (1 << MASKED) - 1, np.uint32)
        for f, table in tables:
            left &= table[columns[f]]
        low = left & (~left + np.uint32(1))
        return order[np.frexp(low.astype(np.float64))[1] - 1]

    def with_thresholds(self, edges: list[np.ndarray]) -> Ensemble:
        self.__dict__.pop("_known", None), self.__dict__.pop("_masks", None)
        self.threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(self.feature.tolist(), self.cut.tolist())])
        return self

    def scores(self, x: np.ndarray, limits=None, trees: range | None = None, depth: int | None = None) -> np.ndarray:
        """Sums over trees: raw scores of boosting, shares of a forest."""
        out = np.zeros((len(x), self.classes))
        columns, cut = self._columns(x, limits)
        for t in trees if trees is not None else range(len(self.roots)):
            found = self.value[self._found(columns, cut, t, depth)]
            if self.of[t] < 0:
                out += found
            else:
                out[:, self.of[t]] += found[:, 0]
        return out

    def probabilities(self, x: np.ndarray, limits=None) -> np.ndarray:
        s = self.scores(x, limits)
        return softmax(s + self.base) if self.base is not None else s / max(1, len(self.roots))

    def importances(self, features: int) -> np.ndarray:
        """Gains by feature: each tree's add up to one, then the mean over trees."""
        out = np.zeros(features)
        for start, stop in zip(self.roots, [*self.roots[1:], len(self.feature)]):
            inner = self.feature[start:stop] >= 0
            own = np.bincount(self.feature[start:stop][inner], self.gain[start:stop][inner], features)
            if own.sum() > 0:
                out += own / own.sum()
        return out / out.sum() if out.sum() > 0 else out


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


# ------------------------------------------------------------------ one boosted tree

class Sapling:
    """A regression tree grown leaf by leaf, best gain first, to ``leaves`` leaves.

    ``wanted`` opens the leaves that may be split next and names the nodes whose histograms
    are needed; :func:`tell` gives these.  Which splits count is decided by gains alone, so
    opening several leaves at a time changes no tree."""

    def __init__(self, bins: np.ndarray, leaves: int, depth: int | None, min_leaf: int, min_hessian: float):
        self.bins, self.first = bins, np.cumsum(bins) - bins
        self.leaves, self.depth_limit, self.min_leaf, self.min_hessian = leaves, depth, min_leaf, min_hessian
        self.feature, self.cut, self.left, self.right, self.depth, self.gain, self.sums = [-1], [0], [0], [0], [0], [0.0], [None]
        self.hist: dict[int, np.ndarray] = {}
        self.low: dict[int, np.ndarray] = {}
        self.asked, self.other = [0], {}
        last = np.zeros(int(bins.sum()), bool)
        last[self.first + bins - 1] = True
        self.last = last
        self.feature_of = np.repeat(np.arange(len(bins)), bins)

    def wanted(self) -> list[int]:
        """Nodes to sum, or an empty list when the tree is complete."""
        if self.asked:
            return self.asked
        heap = [(-self.gain[0], 0)] if self.gain[0] > 0 else []
        count, self.chosen, closed = 1, set(), []
        while heap and count < self.leaves:  # as if nothing under closed leaves were worth a split
            _, x = heapq.heappop(heap)
            count += 1
            if not self.left[x]:
                closed.append(x)
                continue
            self.chosen.add(x)
            for c in (self.left[x], self.right[x]):
                if self.gain[c] > 0:
                    heapq.heappush(heap, (-self.gain[c], c))
        return self._open(closed) if closed else []

    def _open(self, nodes: list[int]) -> list[int]:
        for x in nodes:
            at = len(self.feature)
            self.left[x], self.right[x] = at, at + 1
            for _ in range(2):
                self.feature.append(-1), self.cut.append(0), self.left.append(0), self.right.append(0)
                self.depth.append(self.depth[x] + 1), self.gain.append(0.0), self.sums.append(None)
            small = at if self.low[x][2] <= self.sums[x][2] - self.low[x][2] else at + 1
            self.asked.append(small)
            self.other[small] = (x, at + 1 if small == at else at)
        return self.asked

    def opened(self) -> list[int]:
        """The nodes whose smaller children are asked for."""
        return [self.other[x][0] for x in self.asked if x in self.other]

    def deal(self, columns: np.ndarray, members: dict[int, np.ndarray]) -> None:
        """Pass the rows of newly opened nodes on to their children; ``columns`` are the codes,
        a line a feature, ``members`` the rows of each node without children."""
        for x in self.opened():
            rows = members.pop(x)
            low = columns[self.feature[x]][rows] <= self.cut[x]
            members[self.left[x]], members[self.right[x]] = rows[low], rows[~low]

    def tree(self, rate: float) -> tuple[dict, np.ndarray]:
        """The chosen splits as arrays, and for each node the final leaf that its rows are in."""
        order, place = [0], {0: 0}
        for x in order:
            if x in self.chosen:
                for c in (self.left[x], self.right[x]):
                    place[c] = len(order)
                    order.append(c)
        inner = np.array([x in self.chosen for x in order])
        out = {"feature": np.where(inner, [self.feature[x] for x in order], -1), "cut": np.array([self.cut[x] for x in order]),
               "left": np.array([place.get(self.left[x], 0) for x in order]), "right": np.array([place.get(self.right[x], 0) for x in order]),
               "gain": np.where(inner, [self.gain[x] for x in order], 0.0)}
        out["value"] = np.array([[-rate * self.sums[x][0] / self.sums[x][1] if self.sums[x][1] else 0.0] for x in order])
        leaf = np.zeros(len(self.feature), np.int64)
        for x in range(len(self.feature)):  # parents come before children
            leaf[x] = place.get(x, leaf[x])
            if self.left[x]:
                leaf[self.left[x]] = leaf[self.right[x]] = leaf[x]
        return out, leaf


def tell(saplings: list[Sapling], hists: list[np.ndarray]) -> None:
    """Give every sapling what it asked for, (3, asked nodes, bins of all features) whole
    numbers: the best splits of all new nodes are looked for at a time."""
    nodes, whole = [], []
    for own, mine in zip(saplings, hists):
        for small, h in zip(own.asked, mine.transpose(1, 0, 2)):
            nodes.append((own, small))
            whole.append(h)
            if small in own.other:
                parent, other = own.other[small]
                nodes.append((own, other))
                whole.append(own.hist.pop(parent) - h)
        own.asked = []
    one = saplings[0]  # bins and limits are the same for all
    low = np.stack(whole, 1)
    all_ = low[:, :, : one.bins[0]].sum(2)
    np.cumsum(low, 2, out=low)
    ends = low[:, :, one.first + one.bins - 1]
    low -= np.concatenate([np.zeros((3, len(nodes), 1)), ends[:, :, :-1]], 2)[:, :, one.feature_of]
    rows, at = np.nonzero((low[2] >= one.min_leaf) & (all_[2][:, None] - low[2] >= one.min_leaf) & ~one.last)
    g, w = low[0][rows, at], low[1][rows, at]
    other_g, other_w = all_[0][rows] - g, all_[1][rows] - w
    ok = (w >= one.min_hessian) & (other_w >= one.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.where(ok, g * g / w + other_g * other_g / other_w - (all_[0] * all_[0] / all_[1])[rows], 0.0)
    gain = np.zeros(low.shape[1:])
    gain[rows, at] = found
    best = gain.argmax(1)
    for i, (own, x) in enumerate(nodes):
        own.sums[x] = all_[:, i]
        top = float(gain[i, best[i]])
        if top > 0 and (own.depth_limit is None or own.depth[x] < own.depth_limit):
            f = int(own.feature_of[best[i]])
            own.feature[x], own.cut[x], own.gain[x] = f, int(best[i] - own.first[f]), top
            own.hist[x], own.low[x] = whole[i], low[:, i, best[i]]


class Joint:
    """Features taken together, in groups with at most ``BINS`` combinations of codes: rows are
    summed once a group, and a feature's sums are those of the combinations that hold its code.
    All sums are of whole numbers that a double holds, so they are the same ones."""

    def __init__(self, bins: np.ndarray):
        self.groups: list[list[tuple[int, int]]] = []  # (feature, step of its code in the group's)
        self.widths: list[int] = []
        for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
            fit = [g for g, w in enumerate(self.widths) if w * bins[f] <= BINS]
            if not fit:
                self.groups.append([])
                self.widths.append(1)
            g = max(fit, key=lambda g: self.widths[g], default=len(self.groups) - 1)
            self.groups[g].append((f, self.widths[g]))
            self.widths[g] *= int(bins[f])
        first = np.cumsum(bins) - bins
        self.total, self.start = int(bins.sum()), np.cumsum([0, *self.widths])
        self.places, self.parts = [], []
        for group, width in zip(self.groups, self.widths):
            code = np.arange(width)
            self.places.append(np.concatenate([first[f] + np.arange(bins[f]) for f, _ in group]))
            self.parts.append(np.concatenate([code[:, None] // step % bins[f] == np.arange(bins[f]) for f, step in group], 1).astype(np.float64))

    def of(self, columns: np.ndarray) -> np.ndarray:
        """The rows' codes in each group, a line a group, from their codes, a line a feature."""
        out = np.zeros((len(self.groups), columns.shape[1]), np.uint8)
        for line, group in zip(out, self.groups):
            for f, step in group:
                line += columns[f] * np.uint8(step if step < BINS else 0)  # after that many codes only one is left
        return out

    def sums(self, joint: np.ndarray, rows: np.ndarray, own: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(3, nodes, bins of all features) sums of ``g``, ``h`` and rows: ``rows`` are places in
        ``joint``, and ``own`` the node, ``g`` and ``h`` the gradient and hessian of each."""
        weights = (g, h, None)
        if len(rows) * len(self.groups) <= SMALL:  # few rows: one pass for all groups
            wide = int(self.start[-1])
            at = (joint[:, rows] + (own * wide + self.start[:-1, None])).ravel()
            told = [np.bincount(at, None if w is None else np.tile(w, len(self.groups)), nodes * wide).reshape(nodes, wide) for w in weights]
            each = [np.stack([t[:, a:b] for t in told]) for a, b in zip(self.start, self.start[1:])]
        else:
            each = []
            for line, width in zip(joint, self.widths):
                at = own * width + line[rows]
                each.append(np.stack([np.bincount(at, w, nodes * width).reshape(nodes, width) for w in weights]))
        out = np.empty((3, nodes, self.total))
        for found, place, part in zip(each, self.places, self.parts):
            out[:, :, place] = found @ part
        return out


def fixed_point(rows: int, heaviest: float) -> float:
    """The power of two by which gradients are scaled so that all sums stay exact."""
    return 2.0 ** (51 - int(np.ceil(np.log2(max(2.0, rows * max(1.0, heaviest))))))


def derivatives(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, scale: float) -> np.ndarray:
    """(rows, classes, 2) whole-number gradients and hessians of the softmax loss."""
    p = softmax(raw)
    hit = label[:, None] == np.arange(raw.shape[1])
    w = (weight * scale)[:, None]
    return np.stack([np.rint(w * (p - hit)), np.rint(w * p * (1 - p))], 2)


def balanced(counts: np.ndarray) -> np.ndarray:
    """n / (K n_c) for the K classes that occur."""
    some = counts > 0
    return np.where(some, counts.sum() / (max(1, some.sum()) * np.maximum(counts, 1)), 0.0)


def prior(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    share = np.clip(counts * weight / max(1e-300, float((counts * weight).sum())), np.finfo(np.float32).eps, 1)
    return np.log(share) - np.log(share).mean()


def stops(scores: list[float], patience: int, tolerance: float) -> bool:
    """No score of the last ``patience`` ones beats the one before them."""
    return len(scores) > patience and not any(s > scores[-patience - 1] + tolerance for s in scores[-patience:])


@dataclass
class Boosting:
    """Settings of a boosted ensemble.  ``early_stop`` None: with over 10,000 rows."""

    rounds: int = 180
    rate: float = 0.08
    depth: int | None = None
    leaves: int = 31
    min_leaf: int = 20
    min_hessian: float = 1e-3
    early_stop: bool | None = None
    patience: int = 10
    tolerance: float = 1e-7
    held_share: int = 10  # one row in so many, by hash, judges when to stop

    def stopping(self, rows: int) -> bool:
        return rows > 10_000 if self.early_stop is None else self.early_stop

    def judges(self, key: np.ndarray) -> np.ndarray:
        return spread(key, 0x51) % np.uint64(self.held_share) == 0


def spread(key: np.ndarray, salt) -> np.ndarray:
    """Well mixed 64-bit hashes of whole numbers."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(salt).astype(np.uint64) + np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def loss_of(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(weighted loss, weight) of each row, in fixed point, so that sums don't hang on order."""
    p = softmax(raw)[np.arange(len(raw)), label]
    return np.rint(np.stack([-np.log(np.maximum(p, 1e-300)) * weight, weight], 1) * 2.0**20)


def boost_rows(codes: np.ndarray, label: np.ndarray, key: np.ndarray, bins: np.ndarray, classes: int, how: Boosting,
               together: Callable[[np.ndarray], np.ndarray] = lambda own: own) -> Iterator[Ensemble]:
    """Fit on rows held in one task; the growing ensemble after each round.  Tasks that hold
    a part of the rows each grow the same ensemble if ``together`` adds up their numbers."""
    counts = together(np.bincount(label, minlength=classes).astype(np.float64))
    rows = int(counts.sum())
    judge = how.judges(key) if how.stopping(rows) else np.zeros(len(label), bool)
    judges = together(np.array([judge.sum()], np.float64))[0]
    balance = balanced(counts)
    weight = balance[label]
    base = prior(counts, balance)
    scale = fixed_point(rows, float(balance.max(initial=1.0)))
    held_codes, held_label, held_weight = codes[judge], label[judge], weight[judge]
    columns, label, weight = np.ascontiguousarray(codes[~judge].T), label[~judge], weight[~judge]
    del codes
    groups = Joint(bins)
    joint, everyone = groups.of(columns), np.arange(len(label))
    raw = np.tile(base, (len(label), 1))
    held_raw = np.tile(base, (len(held_label), 1))
    out, scores = Ensemble(classes, base=base), []

    def judged() -> bool:
        if not judges:
            return False
        loss = together(loss_of(held_raw, held_label, held_weight).sum(0))
        scores.append(-float(loss[0] / loss[1]))
        return stops(scores, how.patience, how.tolerance)

    judged()
    for _ in range(how.rounds):
        stats = np.ascontiguousarray(derivatives(raw, label, weight, scale).transpose(2, 1, 0))  # gradients and hessians, a line a class
        saplings = [Sapling(bins, how.leaves, how.depth, how.min_leaf, how.min_hessian * scale) for _ in range(classes)]
        members = [{0: everyone} for _ in range(classes)]
        while any(asked := [own.wanted() for own in saplings]):
            rows = []
            for k, own in enumerate(saplings):
                own.deal(columns, members[k])
                rows.append([members[k][x] for x in asked[k]])
            sizes = [len(r) for some in rows for r in some]
            g, h = (np.concatenate([stats[c, k][r] for k, some in enumerate(rows) for r in some]) for c in (0, 1))
            flat = np.concatenate([r for some in rows for r in some])
            whole = together(groups.sums(joint, flat, np.repeat(np.arange(len(sizes)), sizes), len(sizes), g, h))
            at = np.cumsum([0, *map(len, asked)])
            tell(saplings, [whole[:, a:b] for a, b in zip(at, at[1:])])
        trees = []
        for k, own in enumerate(saplings):
            tree, leaf = own.tree(how.rate)
            for x, rows in members[k].items():
                raw[rows, k] += tree["value"][leaf[x], 0]
            trees.append(tree)
        out.add(trees, list(range(classes)))
        if len(held_label):
            held_raw += out.scores(held_codes, trees=range(len(out.roots) - classes, len(out.roots)))
        done = judged()
        yield out
        if done:
            return


def cores(spark: SparkSession) -> int:
    """Tasks that surely run at the same time; 0 where that isn't known or may change."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    found = spark.sparkContext.defaultParallelism
    if conf.get("spark.default.parallelism", None):  # then it says nothing about cores
        each = re.fullmatch(r"local-cluster\[\s*(\d+)\s*,\s*(\d+)\s*,.*\]", spark.sparkContext.master)
        each = each.groups() if each else (conf.get("spark.executor.instances", "0"), conf.get("spark.executor.cores", "0"))
        found = min(found, int(each[0]) * int(each[1]))
    return found // int(conf.get("spark.task.cpus", "1"))


def meeting(folder: str, context: BarrierTaskContext) -> Callable[[np.ndarray], np.ndarray]:
    """For a task of a barrier stage: a function that adds up whole numbers over all tasks,
    each of which leaves its own in a file of the shared folder."""
    names = context.allGather(str(context.taskAttemptId()))  # a repeated stage has other names
    step = 0

    def together(own: np.ndarray) -> np.ndarray:
        nonlocal step
        mine = f"{folder}/{names[context.partitionId()]}-"
        flat = own.astype(np.int64).ravel()
        some = np.flatnonzero(flat)
        data = [some.astype("<i4"), flat[some]] if 3 * len(some) < 2 * len(flat) else [flat]  # with places where that is shorter
        with open(f"{mine}{step}.part", "wb") as f:
            f.write(b"".join(x.tobytes() for x in data))
        os.rename(f"{mine}{step}.part", f"{mine}{step}")
        total = flat
        for name in names:
            if name == names[context.partitionId()]:
                continue
            pause = 0.0002
            while True:
                try:
                    with open(f"{folder}/{name}-{step}", "rb") as f:
                        got = f.read()
                    break
                except FileNotFoundError:
                    time.sleep(pause)
                    pause = min(0.02, 1.3 * pause)
            if len(got) == 8 * len(flat):
                total += np.frombuffer(got, "<i8")
            else:
                n = len(got) // 12
                total[np.frombuffer(got, "<i4", n)] += np.frombuffer(got, "<i8", n, 4 * n)
        if step:
            os.remove(f"{mine}{step - 1}")  # who wrote this step has read the last one
        step += 1
        return total.reshape(own.shape).astype(np.float64)

    return together


def boost_table(table: DataFrame, bins: np.ndarray, classes: int, how: Boosting) -> Ensemble:
    """The same fit over a written table of ``row, label, codes``: a barrier stage whose tasks
    hold the rows between them."""
    spark = ship_package(table.sparkSession)
    most, shared = cores(spark), re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", ensure_checkpoint_dir(spark))
    if not most or not shared:
        return boost_steps(table, bins, classes, how)
    tasks = max(1, min(most, -(-table.count() // TASK_ROWS)))
    folder = f"{shared[1]}/caliper-sums/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        codes, label, key = [np.zeros((0, len(bins)), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            codes.append(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, len(bins)))
            label.append(batch.column("label").to_numpy().astype(np.int64))
            key.append(batch.column("row").to_numpy().copy())
        *_, whole = boost_rows(np.concatenate(codes), np.concatenate(label), np.concatenate(key), bins, classes, how, meeting(folder, context))
        if context.partitionId() == 0:  # all tasks have the same trees
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], ["trees"])

    os.makedirs(folder)
    try:
        parts = table.select("row", "label", "codes").repartition(tasks, "row")
        # one row, shuffled: Spark begins a barrier stage anew after a lost executor unless it is the job's last stage
        fitted = parts.mapInArrow(run, "trees binary", barrier=True).repartition(1)
        return pickle.loads(fitted.collect()[0]["trees"])
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def boost_steps(table: DataFrame, bins: np.ndarray, classes: int, how: Boosting) -> Ensemble:
    """The same fit, a job for each step."""
    counts = np.zeros(classes, np.int64)
    for r in table.groupBy("label").count().collect():  # a row for each class
        counts[r["label"]] = r["count"]
    rows = int(counts.sum())
    balance = balanced(counts)
    base, scale = prior(counts, balance), fixed_point(rows, float(balance.max(initial=1.0)))
    total, groups = int(bins.sum()), Joint(bins)
    stopping = how.stopping(rows)
    out, scores, done_rounds = Ensemble(classes, base=base), [], 0

    def batches_of(batches, since: Ensemble | None):
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                raw = np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.float64).reshape(-1, classes).copy() if "raw" in batch.schema.names else np.tile(base, (batch.num_rows, 1))
                for t in range(0, len(since.roots) if since else 0, classes):  # round by round, as scores were added before
                    raw += since.scores(codes, trees=range(t, t + classes))
                yield batch, codes, raw

    def sums(state: DataFrame, since: Ensemble | None, saplings: list[Sapling], asked: list[list[int]]) -> tuple[list[np.ndarray], np.ndarray]:
        routes = [(own.feature, own.cut, own.left, own.right) for own in saplings]
        sizes = [len(a) for a in asked]
        begin = np.cumsum([0, *sizes]) * total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((3, int(begin[-1])))
            loss = np.zeros(2)
            for batch, codes, raw in batches_of(batches, since):
                label, key = batch.column("label").to_numpy().astype(np.int64), batch.column("row").to_numpy()
                weight = balance[label]
                judge = how.judges(key) if stopping else np.zeros(len(label), bool)
                loss += loss_of(raw[judge], label[judge], weight[judge]).sum(0)
                codes, raw, label, weight = codes[~judge], raw[~judge], label[~judge], weight[~judge]
                stats = derivatives(raw, label, weight, scale)
                joint = groups.of(np.ascontiguousarray(codes.T))
                line = np.arange(len(label))
                for k, (feature, cut, left, right) in enumerate(routes):
                    if asked[k]:
                        f, c, l, r = map(np.array, (feature, cut, left, right))
                        node = np.zeros(len(label), np.int64)
                        while (inner := l[node] > 0).any():
                            down = np.where(codes[line, np.where(inner, f[node], 0)] <= c[node], l[node], r[node])
                            node = np.where(inner, down, node)
                        rank = np.full(len(f), -1)
                        rank[asked[k]] = np.arange(len(asked[k]))
                        rows = np.flatnonzero(rank[node] >= 0)
                        acc[:, begin[k] : begin[k + 1]] += groups.sums(joint, rows, rank[node[rows]], len(asked[k]), stats[rows, k, 0], stats[rows, k, 1]).reshape(3, -1)
            some = np.flatnonzero(acc[2])
            at = np.concatenate([[-1], some])
            values = [np.concatenate([[loss[c] if c < 2 else 0.0], acc[c, some]]).astype(np.int64) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, values)], ["slot", "g", "h", "n"])

        told = state.mapInArrow(run, "slot long, g long, h long, n long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        slot = told.column("slot").to_numpy()
        values = np.stack([told.column(c).to_numpy() for c in ("g", "h", "n")]).astype(np.float64)
        whole = np.zeros((3, int(begin[-1])))
        whole[:, slot[slot >= 0]] = values[:, slot >= 0]
        return [whole[:, a:b].reshape(3, -1, total) for a, b in zip(begin, begin[1:])], values[:, slot < 0].sum(1)

    state, since = table, None
    for done_rounds in range(how.rounds):
        if since is not None and len(since.roots) >= REFRESH * classes:
            trees = since

            def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch, _, raw in batches_of(batches, trees):
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "label", "codes")] + [pa.array([r.tobytes() for r in raw], pa.binary())], ["row", "label", "codes", "raw"])

            state, since = cut_lineage(state.mapInArrow(rescore, "row long, label int, codes binary, raw binary")), None
        saplings = [Sapling(bins, how.leaves, how.depth, how.min_leaf, how.min_hessian * scale) for _ in range(classes)]
        first_step = True
        while any(asked := [own.wanted() for own in saplings]):
            hists, loss = sums(state, since, saplings, asked)
            if first_step and stopping:
                scores.append(-float(loss[0] / loss[1]))
                if stops(scores, how.patience, how.tolerance):
                    return out
            first_step = False
            tell(saplings, hists)
        trees = [own.tree(how.rate)[0] for own in saplings]
        out.add(trees, list(range(classes)))
        since = since or Ensemble(classes, base=np.zeros(classes))
        since.add(trees, list(range(classes)))
    return out


# ------------------------------------------------------------------ one forest tree

@dataclass
class Forest:
    """Settings of a forest.  ``features`` 0: the square root of their number.  ``rows``: how many
    rows a tree draws on average, 0 for as many as there are."""

    trees: int = 220
    depth: int | None = None
    min_leaf: int = 2
    features: int = 0
    rows: int = 0
    seed: int = 42

    def rate(self, rows: int) -> float:
        """How often a row is drawn on average."""
        return min(1.0, self.rows / max(1, rows)) if self.rows else 1.0


def bootstrap(key: np.ndarray, tree: int, rate: float, seed: int) -> np.ndarray:
    """How often each row is drawn: a Poisson count of mean ``rate`` from its hash."""
    u = spread(key, (seed << 20) + tree).astype(np.float64) / 2.0**64
    count, below, term = np.zeros(len(key), np.int64), np.exp(-rate), np.exp(-rate)
    top = below
    for k in range(1, 40):
        over = u >= top
        if not over.any():
            break
        count += over
        term *= rate / k
        top = top + term
    return count


def _named(path: np.ndarray, features: int, tree: int, how: Forest) -> np.ndarray:
    """For each node, by its name, all features in the order in which they are tried."""
    return np.argsort(spread(np.arange(features)[None, :] + 0 * path[:, None].astype(np.int64), path[:, None] + np.uint64(how.seed + 7919 * tree)), 1, kind="stable")


def _children(path: np.ndarray) -> np.ndarray:
    """The names of two children of each node."""
    return spread(np.repeat(path, 2).view(np.int64), np.tile([1, 2], len(path)))


def _tried(features: int, how: Forest) -> int:
    return min(features, how.features or max(1, int(np.sqrt(features))))


def forest_tree(codes: np.ndarray, label: np.ndarray, drawn: np.ndarray, classes: int, tree: int, how: Forest) -> dict:
    """A tree of Gini splits from the rows drawn (``drawn`` times each)."""
    rows = np.flatnonzero(drawn)
    codes, label, drawn = codes[rows], label[rows], drawn[rows].astype(np.int64)
    balance = balanced(np.bincount(label, drawn, classes))
    return branch(codes, label, drawn, balance, tree, how, ROOT, 0, max(1e-300, float((drawn * balance[label]).sum())))


def branch(codes: np.ndarray, label: np.ndarray, drawn: np.ndarray, balance: np.ndarray, tree: int, how: Forest, path: np.ndarray, depth: int, whole: float) -> dict:
    """The part of a tree under the node ``path`` at ``depth``, from the node's rows; ``whole``
    is the mass of all the tree's rows.  Nodes of over ``NODE_ROWS`` rows are split by counts."""
    classes, features = len(balance), codes.shape[1]
    top, parts, todo = Top(path, depth, len(label)), {}, [(0, np.arange(len(label)))]
    while todo:
        x, rows = todo.pop()
        if len(rows) <= NODE_ROWS:
            parts[x] = _leafward(codes[rows], label[rows], drawn[rows] * balance[label[rows]], classes, tree, how, top.path[x], top.depth[x], whole)
            continue
        while (asked := top.asked(x, features, tree, how)) is not None:
            counts = np.stack([_counts(codes[rows, f], label[rows], drawn[rows], 1, classes)[0] for f in asked])
            top.told(x, len(asked), split_of(asked, counts, balance, how, top.depth[x]), whole)
        if top.left[x]:
            low = codes[rows, top.feature[x]] <= top.cut[x]
            todo += [(top.left[x] + 1, rows[~low]), (top.left[x], rows[low])]
    if list(parts) == [0]:
        return parts[0]
    out = top.arrays(classes)
    pieces, at = {k: [v] for k, v in out.items()}, len(out["feature"])
    for x, part in parts.items():  # a part's first node takes the place of x
        for k, v in part.items():
            v = np.where(part["feature"] >= 0, v + at - 1, 0) if k in ("left", "right") else v
            out[k][x] = v[0]
            pieces[k].append(v[1:])
        at += len(part["feature"]) - 1
    return {k: np.concatenate(v) for k, v in pieces.items()}


def _counts(code: np.ndarray, label: np.ndarray, drawn: np.ndarray, nodes: int, classes: int, rank: np.ndarray | int = 0) -> np.ndarray:
    """(nodes, BINS, classes + 1): how often rows of each code and class were drawn, and rows."""
    out = np.empty((nodes, BINS, classes + 1), np.int64)
    at = rank * BINS + code.astype(np.int64)
    out[:, :, :classes] = np.bincount(at * classes + label, drawn, nodes * BINS * classes).reshape(nodes, BINS, classes)
    out[:, :, classes] = np.bincount(at, minlength=nodes * BINS).reshape(nodes, BINS)
    return out


def split_of(asked: np.ndarray, counts: np.ndarray, balance: np.ndarray, how: Forest, depth: int) -> tuple[int, int, float, int, bool, np.ndarray]:
    """From a node's counts over the ``asked`` features: the feature (-1: none), code and gain of
    its best split, the rows on its low side, whether other features may still be tried, and the
    node's mass by class.  Counts are whole numbers, so a split doesn't hang on where and in what
    order rows are counted."""
    total = counts[0, :, :-1].sum(0) * balance
    members, mass = int(counts[0, :, -1].sum()), max(1e-300, float(total.sum()))
    impurity = mass - float((total**2).sum()) / mass
    if (how.depth is not None and depth >= how.depth) or members < 2 * how.min_leaf or impurity <= 1e-9 * mass:
        return -1, 0, 0.0, 0, False, total
    best, feature, cut, rows = 0.0, -1, 0, 0
    for f, own in zip(asked.tolist(), counts):
        low = np.cumsum(own, 0)
        can = np.flatnonzero((own[:, -1] > 0) & (low[:, -1] >= how.min_leaf) & (members - low[:, -1] >= how.min_leaf))
        if not len(can):
            continue
        a, b = low[can, :-1] * balance, (low[-1, :-1] - low[can, :-1]) * balance
        am, bm = np.maximum(a.sum(1), 1e-300), np.maximum(b.sum(1), 1e-300)
        gain = impurity - (am - (a**2).sum(1) / am) - (bm - (b**2).sum(1) / bm)
        top = int(gain.argmax())
        if feature < 0 or gain[top] > best + 1e-12 * mass:
            best, feature, cut, rows = float(gain[top]), f, int(can[top]), int(low[can[top], -1])
    return feature, cut, best, rows, True, total


class Top:
    """The upper part of a tree, whose nodes are split by counts."""

    def __init__(self, path: np.ndarray, depth: int, rows: int):
        self.path, self.depth, self.rows = [path], [depth], [rows]
        self.feature, self.cut, self.left, self.gain, self.value, self.seen, self.open = [-1], [0], [0], [0.0], [None], [0], [True]

    def asked(self, x: int, features: int, tree: int, how: Forest) -> np.ndarray | None:
        """The features whose counts are needed next to split a node; None if it needs none."""
        if not self.open[x] or self.seen[x] >= features:
            return None
        return _named(self.path[x], features, tree, how)[0][self.seen[x] : self.seen[x] + _tried(features, how)]

    def told(self, x: int, asked: int, found: tuple, whole: float) -> None:
        """What :func:`split_of` found with so many features."""
        feature, cut, gain, low, more, self.value[x] = found
        self.seen[x] += asked
        self.open[x] = more and feature < 0
        if feature >= 0:
            self.feature[x], self.cut[x], self.gain[x], self.left[x] = feature, cut, gain / whole, len(self.feature)
            for path, rows in zip(_children(self.path[x]), (low, self.rows[x] - low)):
                for store, own in ((self.path, path[None]), (self.depth, self.depth[x] + 1), (self.rows, rows), (self.feature, -1), (self.cut, 0), (self.left, 0), (self.gain, 0.0), (self.value, None), (self.seen, 0), (self.open, True)):
                    store.append(own)

    def arrays(self, classes: int) -> dict:
        left = np.array(self.left)
        value = np.array([np.zeros(classes) if v is None else v / max(1e-300, float(v.sum())) for v in self.value])
        return {"feature": np.array(self.feature), "cut": np.array(self.cut), "left": left, "right": np.where(left > 0, left + 1, 0), "gain": np.array(self.gain), "value": value}


def _news(own: np.ndarray) -> np.ndarray:
    """Where another number begins."""
    out = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=out[1:])
    return out


def _leafward(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, tree: int, how: Forest, path: np.ndarray, depth: int, whole: float) -> dict:
    """A part of a tree, level by level.

    In a level, rows stand in the order of nodes and are sorted by (node, code) for each of a
    node's chosen features; class weights accumulate along that order, and every step between
    two codes is a split."""
    d = codes.shape[1]
    chosen = _tried(d, how)
    feature, cut, left, right, gains, values = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([0])], [np.array([0.0])], []
    hot = np.zeros((classes, len(label)))
    hot[label, np.arange(len(label))] = weight
    values.append(np.bincount(label, weight, classes)[None])
    node, size, count = np.zeros(len(label), np.int64), 1, 1
    while len(node) and (how.depth is None or depth < how.depth):
        total = np.stack([np.bincount(node, own, size) for own in hot], 1)
        members = np.bincount(node, minlength=size)
        mass = total.sum(1)
        impurity = mass - (total**2).sum(1) / np.maximum(mass, 1e-300)
        open_ = (members >= 2 * how.min_leaf) & (impurity > 1e-9 * mass)
        best_gain, best_f, best_c = np.zeros(size), np.full(size, -1), np.zeros(size, np.int64)
        order, sums = _named(path, d, tree, how), np.ascontiguousarray(total.T)
        flat, tried = codes.ravel(), 0
        while tried < d:
            # the chosen features first; nodes that find no split go on with the others
            todo = open_ & (best_f < 0) if tried else open_
            live = np.flatnonzero(todo[node])
            if not len(live):
                break
            width = chosen if tried == 0 else min(chosen, d - tried)
            own, base, mine = node[live], live * d, hot[:, live]
            narrow = own.astype(np.uint16) if size <= 1 << 16 else own
            news = _news(own)
            begins, segment = news.nonzero()[0], news.cumsum() - 1
            seen = np.arange(1, len(own) + 1) - begins[segment]
            can = ~news[1:] & (seen[:-1] >= how.min_leaf) & (members[own[:-1]] - seen[:-1] >= how.min_leaf)
            for j in range(tried, tried + width):
                code = flat[base + order[own, j]]
                at = np.argsort(code, kind="stable")
                at = at[np.argsort(narrow[at], kind="stable")]
                code = code[at]
                step = (can & (code[:-1] != code[1:])).nonzero()[0]
                if not len(step):
                    continue
                run = mine[:, at].cumsum(1)
                before = np.zeros((classes, len(begins)))
                before[:, 1:] = run[:, begins[1:] - 1]
                who = own[step]
                a = run[:, step] - before[:, segment[step]]
                b = sums[:, who] - a
                am, bm = a.sum(0), b.sum(0)
                gain = impurity[who] - (am - (a**2).sum(0) / np.maximum(am, 1e-300)) - (bm - (b**2).sum(0) / np.maximum(bm, 1e-300))
                new = _news(who)
                top = (gain == np.maximum.reduceat(gain, new.nonzero()[0])[new.cumsum() - 1]).nonzero()[0]
                lead = top[_news(who[top])]
                better = (gain[lead] > best_gain[who[lead]] + 1e-12 * mass[who[lead]]) | (best_f[who[lead]] < 0)
                lead = lead[better]
                best_gain[who[lead]], best_c[who[lead]] = gain[lead], code[step[lead]]
                best_f[who[lead]] = order[who[lead], j]
            tried += width
        split = np.flatnonzero(best_f >= 0)
        if not len(split):
            break
        kids = count + 2 * np.arange(len(split))
        feature[-1][split], cut[-1][split], left[-1][split], right[-1][split] = best_f[split], best_c[split], kids, kids + 1
        gains[-1][split] = best_gain[split] / whole
        rank = np.full(size, -1)
        rank[split] = np.arange(len(split))
        rows_in = np.flatnonzero(rank[node] >= 0)
        old = node[rows_in]
        node = 2 * rank[old] + (flat[rows_in * d + best_f[old]] > best_c[old])
        size, count, depth = 2 * len(split), count + 2 * len(split), depth + 1
        to = np.argsort(node.astype(np.uint16) if size <= 1 << 16 else node, kind="stable")
        node, rows_in = node[to], rows_in[to]
        codes, hot = codes[rows_in], hot[:, rows_in]
        path = _children(path[split])
        for store, fill in ((feature, -1), (cut, 0), (left, 0), (right, 0)):
            store.append(np.full(size, fill))
        gains.append(np.zeros(size))
        values.append(np.stack([np.bincount(node, own, size) for own in hot], 1))
    share = np.concatenate(values)
    share = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
    return {"feature": np.concatenate(feature), "cut": np.concatenate(cut), "left": np.concatenate(left), "right": np.concatenate(right), "gain": np.concatenate(gains), "value": share}


# ------------------------------------------------------------------ fits as grouped jobs

def _wide(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A binary column whose values are of one length, as an array of bytes with a line a row."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)
            data = c.buffers()[2]
            parts.append(np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]].reshape(len(c), -1) if ends[-1] > ends[0] else np.zeros((len(c), 0), np.uint8))
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.uint8)


def _rows_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    """codes, label, row, held (and drawn, if there) of a group, in the order of the row keys."""
    bytes_ = [_wide(table.column(c)) for c in ("codes", "drawn") if c in table.column_names]
    label, row, held = (table.column(c).to_numpy() for c in ("label", "row", "held"))
    order = np.lexsort((label, row))
    return bytes_[0][order], label[order].astype(np.int64), row[order], held[order].astype(bool), *(b[order] for b in bytes_[1:])


_FITTED = "fit int, chunk int, trees binary"
_GROWN = "fit int, chunk int, tree int, part int, at long, depth int, slice int, size int, last boolean, gains array<double>, nodes binary"
_JUDGED = "fit int, stage int, depth int, chunk int, row long, label int, shares array<double>"


def _judged(fit: int, chunk: int, stage: int, depth: int | None, row: np.ndarray, label: np.ndarray, shares: np.ndarray) -> pa.Table:
    n = len(row)
    same = [pa.array(np.full(n, v, np.int32)) for v in (fit, stage, depth or 0, chunk)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * shares.shape[1]), pa.array(np.ascontiguousarray(shares).ravel()))
    return pa.Table.from_arrays([*same, pa.array(row), pa.array(label.astype(np.int32)), lists], ["fit", "stage", "depth", "chunk", "row", "label", "shares"])


def boost_groups(table: DataFrame, edges: dict[int, list[np.ndarray]], classes: int, settings: dict[int, Boosting], source: dict[int, int], stages: list[int] | None = None) -> DataFrame:
    """Fits side by side, a task each.  ``source`` names for each fit the table's ``fit``
    whose rows it reads.  Without ``stages``: ``fit, chunk, trees``.  With them: the class
    shares of held rows after so many rounds, as :data:`_JUDGED`."""
    bins = {f: np.array([len(e) + 1 for e in own], np.int64) for f, own in edges.items()}

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        fit = group[0].as_py()
        codes, label, row, held = _rows_of(rows)
        train = ~held
        last, parts = None, []
        for n, last in enumerate(boost_rows(codes[train], label[train], row[train], bins[source[fit]], classes, settings[fit]), 1):
            if stages and n in stages:
                parts.append(_judged(fit, 0, n, None, row[held], label[held], last.probabilities(codes[held])))
        if not stages:
            return pa.Table.from_arrays([pa.array([fit], pa.int32()), pa.array([0], pa.int32()), pa.array([pickle.dumps(last)], pa.binary())], ["fit", "chunk", "trees"])
        done = len(last.roots) // classes
        for n in stages:  # a fit that stopped early is all later stages
            if n > done:
                parts.append(_judged(fit, 0, n, None, row[held], label[held], last.probabilities(codes[held])))
        return pa.concat_tables(parts)

    return _grouped(table, source).applyInArrow(run, _JUDGED if stages else _FITTED)


def _node(classes: int) -> np.dtype:
    """A node of a stored forest tree; its right child follows the left one.  ``feature`` is -1
    at a leaf and -2 where another part of the tree goes on."""
    return np.dtype([("feature", "<i4"), ("cut", "u1"), ("left", "<i4"), ("gain", "<f8"), ("value", "<f8", (classes,))])


def _sliced(fit: int, chunk: int, tree: int, part: int, at: int, depth: int, nodes: dict, features: int) -> pa.Table:
    """A part of a tree, the one under node ``at`` of part 0 (part 0: the whole tree, or its top),
    as rows of at most ``SLICE`` nodes; the first has the part's sum of gains for each feature."""
    own = np.empty(len(nodes["feature"]), _node(nodes["value"].shape[1]))
    for name in own.dtype.names:
        own[name] = nodes[name]
    inner = nodes["feature"] >= 0
    gains = np.bincount(nodes["feature"][inner], nodes["gain"][inner], features).astype(np.float64)
    slices = [own[i : i + SLICE] for i in range(0, len(own), SLICE)]
    n = len(slices)
    same = [pa.array(np.full(n, v), t) for v, t in zip((fit, chunk, tree, part, at, depth), (pa.int32(),) * 4 + (pa.int64(), pa.int32()))]
    return pa.Table.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([len(x) for x in slices], pa.int32()), pa.array([i == n - 1 for i in range(n)]),
                                 pa.array([gains.tolist() if not i else None for i in range(n)], pa.list_(pa.float64())), pa.array([x.tobytes() for x in slices], pa.binary())],
                                ["fit", "chunk", "tree", "part", "at", "depth", "slice", "size", "last", "gains", "nodes"])


def forest_groups(table: DataFrame, edges: dict[int, list[np.ndarray]], classes: int, settings: dict[int, Forest], source: dict[int, int], rows: dict[int, int], points: list[tuple[int, int | None]] | None = None) -> DataFrame:
    """Forests in groups of ``CHUNK`` trees.  ``rows``: the training rows of each of the
    table's fits.  Without ``points``: the trees, as :data:`_GROWN`.  With (trees, depth) points:
    held rows' sums of class shares over the group's trees, as :data:`_JUDGED`."""
    def run(group: tuple, part: pa.Table) -> pa.Table:
        fit, chunk = group[0].as_py(), group[1].as_py()
        codes, label, row, held, drawn = _rows_of(part)
        how, train = settings[fit], ~held
        numbers = range(chunk * CHUNK, min((chunk + 1) * CHUNK, how.trees))
        if not train.all():
            train_codes, train_label, train_drawn = codes[train], label[train], drawn[train]
        else:
            train_codes, train_label, train_drawn = codes, label, drawn
        trees = (forest_tree(train_codes, train_label, train_drawn[:, i], classes, t, how) for i, t in enumerate(numbers))
        if points is None:
            return pa.concat_tables([_sliced(fit, chunk, t, 0, 0, 0, tree, codes.shape[1]) for t, tree in zip(numbers, trees)])
        own = Ensemble(classes)
        own.add(list(trees), [-1] * len(numbers))
        tables = [_judged(fit, chunk, n, depth, row[held], label[held], own.scores(codes[held], trees=range(min(len(numbers), n - numbers[0])), depth=depth)) for n, depth in points if n > numbers[0]]
        return pa.concat_tables(tables)

    chunks = {f: -(-how.trees // CHUNK) for f, how in settings.items()}
    each = _drawn(table, settings, source, rows, chunks, points is not None)
    return each.repartitionByRange(sum(chunks.values()), "fit", "chunk").groupBy("fit", "chunk").applyInArrow(run, _JUDGED if points is not None else _GROWN)


def _drawn(table: DataFrame, settings: dict[int, Forest], source: dict[int, int], rows: dict[int, int], chunks: dict[int, int], judged: bool) -> DataFrame:
    """``fit, chunk, held, row, label, codes, drawn``: the rows that a chunk's trees draw,
    with a byte a tree, and if they are judged the held rows.  A batch's first row goes to
    each chunk, drawn or not, so that none is missing."""
    ship_package(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, held, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fit", "held", "row"))
            for f, s in source.items():
                mine = np.flatnonzero(fits == s)
                if not len(mine):
                    continue
                how, rate = settings[f], settings[f].rate(rows.get(s, 0))
                train = ~held[mine].astype(bool)
                for chunk in range(chunks[f]):
                    drawn = np.zeros((len(mine), CHUNK), np.uint8)
                    for i, t in enumerate(range(chunk * CHUNK, min((chunk + 1) * CHUNK, how.trees))):
                        drawn[train, i] = bootstrap(key[mine[train]], t, rate, how.seed)
                    some = drawn.any(1) | (~train if judged else False)
                    some[0] = True
                    part = batch.take(pa.array(mine[some]))
                    same = [pa.array(np.full(part.num_rows, v, np.int32)) for v in (f, chunk)]
                    yield pa.RecordBatch.from_arrays([*same, *(part.column(c) for c in ("held", "row", "label", "codes")), pa.array([r.tobytes() for r in drawn[some]], pa.binary())],
                                                     ["fit", "chunk", "held", "row", "label", "codes", "drawn"])

    return table.select("fit", "held", "row", "label", "codes").mapInArrow(run, "fit int, chunk int, held boolean, row long, label int, codes binary, drawn binary")


def _grouped(table: DataFrame, source: dict[int, int]):
    """The rows of each fit: a group of bounded size a task."""
    jobs = [F.struct(F.lit(f).alias("own"), F.lit(s).alias("of")) for f, s in source.items()]
    each = table.withColumn("job", F.explode(F.filter(F.array(*jobs), lambda j: j["of"] == F.col("fit"))))
    each = each.select(F.col("job.own").cast("int").alias("fit"), F.lit(0).alias("chunk"), "held", "row", "label", "codes")
    return each.repartitionByRange(len(jobs), "fit").groupBy("fit", "chunk")  # ranges: a job a task


def merged(parts: DataFrame) -> dict[int, Ensemble]:
    """The ensembles of :func:`boost_groups`, whose trees are of bounded size, on the driver; or
    those of :func:`forest_groups` where these are small (see :class:`Grove`)."""
    out: dict[int, Ensemble] = {}
    if "nodes" in parts.columns:
        trees: dict[tuple[int, int], list] = {}
        for r in sorted(parts.collect(), key=lambda r: (r["fit"], r["tree"], r["slice"])):
            trees.setdefault((r["fit"], r["tree"]), []).append(r)
        for (fit, _), slices in trees.items():
            kind = _node((len(slices[0]["nodes"]) // slices[0]["size"] - _node(0).itemsize) // 8)
            nodes = np.concatenate([np.frombuffer(r["nodes"], kind) for r in slices])
            tree = {k: nodes[k] for k in ("feature", "cut", "left", "gain", "value")}
            out.setdefault(fit, Ensemble(kind["value"].shape[0])).add([tree | {"right": np.where(tree["feature"] < 0, 0, tree["left"] + 1)}], [-1])
        return out
    for r in sorted(parts.collect(), key=lambda r: (r["fit"], r["chunk"])):
        own = pickle.loads(r["trees"])
        whole = out.get(r["fit"])
        if whole is None:
            out[r["fit"]] = own
            continue
        at = len(whole.feature)
        whole.roots += [x + at for x in own.roots]
        whole.of += own.of
        inner = own.feature >= 0
        whole.left = np.concatenate([whole.left, np.where(inner, own.left + at, 0)])
        whole.right = np.concatenate([whole.right, np.where(inner, own.right + at, 0)])
        for name in ("feature", "cut", "gain", "value"):
            setattr(whole, name, np.concatenate([getattr(whole, name), getattr(own, name)]))
    return out


# ------------------------------------------------------------------ forests in files

def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    local = re.fullmatch(r"(?:file:(?://)?)?(/[^/].*)", path)
    return (pa.fs.LocalFileSystem(), local[1]) if local else pa.fs.FileSystem.from_uri(path)


def _walk(packed: np.ndarray, codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The node each row of codes ends at: a leaf, or where so many steps lead."""
    out, d = np.zeros(len(codes), np.int64), codes.shape[1]
    for a in range(0, len(codes) if d else 0, SMALL):
        flat = codes[a : a + SMALL].ravel()
        rows = np.arange(len(flat) // d)
        base, node, step = rows * d, np.zeros(len(rows), np.int64), 0
        while len(rows) and (depth is None or step < depth):
            p = packed[node]
            new = (p >> 32) + (flat[base + (p >> 8 & 0xFFFFFF)] > (p & 0xFF))  # a leaf leads to itself
            step += 1
            if step % 4 == 0 and depth is None:
                on = new != node
                out[a + rows[~on]] = node[~on]
                rows, base, new = rows[on], base[on], new[on]
            node = new
        out[a + rows] = node
    return out


def _packed(nodes: np.ndarray) -> np.ndarray:
    inner, left = nodes["feature"] >= 0, nodes["left"].astype(np.int64)
    return np.where(inner, left << 32 | nodes["feature"].astype(np.int64) << 8 | nodes["cut"], np.arange(len(nodes)) << 32 | 0xFF)


_kept: dict[tuple, list] = {}


@dataclass
class Grove:
    """A forest whose trees stay in files of the shared checkpoint folder: they grow with the rows,
    so neither the driver nor a task holds more than a part of one (a small forest is kept by the
    process that scores with it).  Whoever scores reads the files, tree by tree, once a block of rows."""

    path: str
    classes: int
    trees: int
    edges: list[np.ndarray]

    def _read(self) -> Iterator[tuple]:
        """tree, part, the node of part 0 that it hangs on, that node's depth, its own nodes packed,
        their values, and which of them other parts go on from."""
        fs, root = _files(self.path)
        found = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet")]
        first = {}
        for f in found:
            with fs.open_input_file(f) as source:
                for batch in pq.ParquetFile(source).iter_batches(1, columns=["tree"]):
                    first[f] = batch.column(0)[0].as_py()
                    break
        before, slices = (-1, 0), []
        for f in sorted(first, key=first.get):
            with fs.open_input_file(f) as source:
                for batch in pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(16, columns=["tree", "part", "at", "depth", "last", "nodes"]):
                    for r in batch.to_pylist():
                        slices.append(r["nodes"])
                        if r["last"]:
                            if (r["tree"], r["part"]) <= before:
                                raise ValueError(f"parts of trees out of order in {self.path}")
                            before, nodes = (r["tree"], r["part"]), np.frombuffer(b"".join(slices), _node(self.classes))
                            yield r["tree"], r["part"], r["at"], r["depth"], _packed(nodes), np.ascontiguousarray(nodes["value"]), np.flatnonzero(nodes["feature"] == -2)
                            slices = []

    def _parts(self) -> Iterator[tuple]:
        fs, root = _files(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        key = (self.path, *sorted(f.path for f in found))  # a forest written anew has other files
        if key not in _kept:
            if sum(f.size or 0 for f in found) > KEPT_BYTES:
                return self._read()
            while len(_kept) > 1:
                _kept.pop(next(iter(_kept)))
            _kept[key] = list(self._read())
        return iter(_kept[key])

    def sums(self, codes: np.ndarray, points: list[tuple[int, int | None]]) -> list[np.ndarray]:
        """Sums of class shares, for each point over its first trees cut at its depth."""
        codes = np.ascontiguousarray(codes)
        out = [np.zeros((len(codes), self.classes)) for _ in points]
        waiting: dict = {}  # rows to go on with in other parts of a tree
        for tree, part, at, depth, packed, value, further in self._parts():
            for cut in {d for n, d in points if n > tree}:
                if not part:
                    rows, node = None, _walk(packed, codes, cut)
                    waiting[cut] = {}
                    if len(further):
                        order = np.argsort(node, kind="stable")
                        a, b = (np.searchsorted(node[order], further, side) for side in ("left", "right"))
                        waiting[cut] = {int(x): order[i:j] for x, i, j in zip(further, a, b)}
                        rows = np.ones(len(codes), bool)
                        for some in waiting[cut].values():
                            rows[some] = False
                        rows = np.flatnonzero(rows)
                        node = node[rows]
                else:
                    rows = waiting[cut].pop(at)
                    node = _walk(packed, codes[rows], None if cut is None else cut - depth)
                for sums, (n, d) in zip(out, points):
                    if d == cut and n > tree:
                        if rows is None:
                            sums += value[node]
                        else:
                            sums[rows] += value[node]
        return out

    def shares(self, codes: np.ndarray) -> np.ndarray:
        return self.sums(codes, [(self.trees, None)])[0] / max(1, self.trees)

    def probabilities(self, x: np.ndarray, limits=True) -> np.ndarray:
        """Class shares of rows of values."""
        return self.shares(codes_of(x, self.edges))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").parquet(self.path)

    def importances(self, features: int) -> np.ndarray:
        """Gains by feature: each tree's add up to one, then the mean over trees."""
        each = self.table(SparkSession.active()).where("slice = 0").select("tree", F.posexplode("gains").alias("f", "g"))
        out, own = np.zeros(features), np.zeros((self.trees, features))
        for r in each.groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():  # trees x features rows
            own[r["tree"], r["f"]] = r["g"]
        for one in own:
            if one.sum() > 0:
                out += one / one.sum()
        return out / out.sum() if out.sum() > 0 else out

    def save(self, path: str, spark: SparkSession) -> None:
        _in_order(self.table(spark), self.trees).write.mode("overwrite").parquet(path)


def _in_order(parts: DataFrame, trees: int) -> DataFrame:
    return parts.repartitionByRange(max(1, trees), "tree").sortWithinPartitions("tree", "part", "slice")


def planted(table: DataFrame, edges: list[np.ndarray], classes: int, how: Forest, fit: int, rows: int) -> Grove:
    """A forest of the training rows of one of the table's fits, ``rows`` in number."""
    spark = table.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/caliper-forests/{uuid.uuid4().hex}"
    if rows * how.rate(rows) <= TREE_ROWS:
        forest_groups(table, {fit: edges}, classes, {fit: how}, {fit: fit}, {fit: rows}).write.parquet(path)
    else:
        _planted_by_counts(table.where((F.col("fit") == fit) & ~F.col("held")), edges, classes, how, rows, path)
    return Grove(path, classes, how.trees, edges)


def _planted_by_counts(table: DataFrame, edges: list[np.ndarray], classes: int, how: Forest, rows: int, path: str) -> None:
    """The same trees, ``CHUNK`` at a time, from more rows than a task holds: nodes of over
    ``PART_ROWS`` rows are split by counts that all tasks add up; the rows of each smaller one are
    a group of their own."""
    spark, rate, features = ship_package(table.sparkSession), how.rate(rows), len(edges)

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((how.trees, classes, 2), np.int64)
        for batch in batches:
            key, label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            for t in range(how.trees):
                drawn = bootstrap(key, t, rate, how.seed)
                found[t, :, 0] += np.bincount(label, drawn, classes).astype(np.int64)
                found[t, :, 1] += np.bincount(label, drawn > 0, classes).astype(np.int64)
        at = np.arange(how.trees * classes)
        yield pa.RecordBatch.from_arrays([pa.array(at // classes), pa.array(at % classes), *(pa.array(found[:, :, i].ravel()) for i in (0, 1))], ["tree", "label", "n", "r"])

    counts = np.zeros((how.trees, classes, 2), np.int64)  # draws and rows of each tree by class
    for r in table.select("row", "label").mapInArrow(draws, "tree long, label long, n long, r long").groupBy("tree", "label").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).collect():
        counts[r["tree"], r["label"]] = r["n"], r["r"]
    balance = {t: balanced(counts[t, :, 0].astype(np.float64)) for t in range(how.trees)}
    whole = {t: max(1e-300, float((counts[t, :, 0] * balance[t]).sum())) for t in range(how.trees)}
    table = table.select("row", "label", "codes")
    for wave in range(0, how.trees, CHUNK):
        tops = {t: Top(ROOT, 0, int(counts[t, :, 1].sum())) for t in range(wave, min(wave + CHUNK, how.trees))}
        while True:
            asked = {t: {x: a for x in range(len(top.path)) if top.rows[x] > PART_ROWS and (a := top.asked(x, features, t, how)) is not None} for t, top in tops.items()}
            if not any(asked.values()):
                break
            for r in _splits(table, tops, asked, classes, how, rate, balance).collect():  # a row for each node
                tops[r["tree"]].told(r["node"], len(asked[r["tree"]][r["node"]]), (r["feature"], r["cut"], r["gain"], r["low"], r["more"], np.array(r["total"])), whole[r["tree"]])
        jobs = [(t, x) for t, top in tops.items() for x in range(len(top.path)) if not top.left[x] and top.rows[x] <= PART_ROWS]
        below = [_sliced(0, 0, t, 0, 0, 0, top.arrays(classes) | {"feature": np.array([-2 if not top.left[x] and top.rows[x] <= PART_ROWS else top.feature[x] for x in range(len(top.path))])}, features) for t, top in tops.items()]
        parts = _below(table, tops, jobs, classes, how, rate, balance, whole).unionByName(spark.createDataFrame(pa.concat_tables(below)))
        _in_order(cut_lineage(parts), len(tops)).write.parquet(f"{path}/{wave:06d}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """codes, label, row of many batches at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield _block(held)
            held = []
    if held:
        yield _block(held)


def _block(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    whole = pa.Table.from_batches(batches)
    return _wide(whole.column("codes")), whole.column("label").to_numpy().astype(np.int64), whole.column("row").to_numpy()


def _tops_packed(tops: dict[int, Top], classes: int) -> dict[int, np.ndarray]:
    out = {}
    for t, top in tops.items():
        own = np.zeros(len(top.path), _node(classes))
        for name in ("feature", "cut", "left"):
            own[name] = getattr(top, name)
        out[t] = _packed(own)
    return out


def _splits(table: DataFrame, tops: dict[int, Top], asked: dict[int, dict[int, np.ndarray]], classes: int, how: Forest, rate: float, balance: dict[int, np.ndarray]) -> DataFrame:
    """What :func:`split_of` finds for every asked node; counts are added up a node a group."""
    routes = _tops_packed(tops, classes)
    depth = {t: {x: tops[t].depth[x] for x in own} for t, own in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for codes, label, key in _blocks(batches):
            for t, own in asked.items():
                if not own:
                    continue
                drawn = bootstrap(key, t, rate, how.seed)
                rows = np.flatnonzero(drawn)
                rank = np.full(len(routes[t]), -1)
                rank[list(own)] = np.arange(len(own))
                rank = rank[_walk(routes[t], codes[rows])]
                rows, rank = rows[rank >= 0], rank[rank >= 0]
                width = max(map(len, own.values()))
                features = np.array([np.resize(a, width) for a in own.values()])
                flat, base = codes.ravel(), rows * codes.shape[1]
                got = np.stack([_counts(flat[base + features[rank, j]], label[rows], drawn[rows], len(own), classes, rank) for j in range(width)], 1)
                acc[t] = acc[t] + got if t in acc else got
        for t, got in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(got), pa.int32()), pa.array(list(asked[t]), pa.int32()), pa.array([g.tobytes() for g in got], pa.binary())], ["tree", "node", "counts"])

    def split(group: tuple, parts: pa.Table) -> pa.Table:
        t, x = (g.as_py() for g in group)
        features = asked[t][x]
        total = sum(np.frombuffer(c, np.int64) for c in parts.column("counts").to_pylist()).reshape(-1, BINS, classes + 1)
        f, cut, gain, low, more, mass = split_of(features, total[: len(features)], balance[t], how, depth[t][x])
        return pa.Table.from_pylist([{"tree": t, "node": x, "feature": f, "cut": cut, "gain": gain, "low": low, "more": more, "total": mass.tolist()}],
                                    pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("low", pa.int64()), ("more", pa.bool_()), ("total", pa.list_(pa.float64()))]))

    told = table.mapInArrow(run, "tree int, node int, counts binary")
    return told.groupBy("tree", "node").applyInArrow(split, "tree int, node int, feature int, cut int, gain double, low long, more boolean, total array<double>")


def _below(table: DataFrame, tops: dict[int, Top], jobs: list[tuple[int, int]], classes: int, how: Forest, rate: float, balance: dict[int, np.ndarray], whole: dict[int, float]) -> DataFrame:
    """The parts of trees under the nodes ``jobs`` (tree, node), a group each."""
    routes = _tops_packed(tops, classes)
    number = {t: np.full(len(route), -1) for t, route in routes.items()}
    for i, (t, x) in enumerate(jobs):
        number[t][x] = i
    roots = [(tops[t].path[x], tops[t].depth[x]) for t, x in jobs]
    first = {t: min(i for i, (own, _) in enumerate(jobs) if own == t) for t in dict(jobs)}

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, key = _wide(batch.column("codes")), batch.column("row").to_numpy()
            for t, route in routes.items():
                drawn = bootstrap(key, t, rate, how.seed)
                rows = np.flatnonzero(drawn)
                job = number[t][_walk(route, codes[rows])]
                rows, job = rows[job >= 0], job[job >= 0]
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(job, pa.int32()), *(part.column(c) for c in ("row", "label", "codes")), pa.array(drawn[rows], pa.int32())], ["job", "row", "label", "codes", "drawn"])

    def grow(group: tuple, part: pa.Table) -> pa.Table:
        job = group[0].as_py()
        (t, x), (path, depth) = jobs[job], roots[job]
        codes, label, row, drawn = _wide(part.column("codes")), *(part.column(c).to_numpy().astype(np.int64) for c in ("label", "row", "drawn"))
        order = np.lexsort((label, row))
        tree = branch(codes[order], label[order], drawn[order], balance[t], t, how, path, depth, whole[t])
        return _sliced(0, 0, t, job - first[t] + 1, x, depth, tree, codes.shape[1])

    each = table.mapInArrow(pass_on, "job int, row long, label int, codes binary, drawn int")
    return each.repartition(max(1, len(jobs)), "job").groupBy("job").applyInArrow(grow, _GROWN)


def predicted(df: DataFrame, model: Ensemble | Grove, features: str = "features") -> DataFrame:
    """``probability`` (vector) and ``prediction`` from a vector column, in Arrow batches."""
    spark = ship_package(df.sparkSession)
    if isinstance(model, Grove):
        @F.pandas_udf("array<double>")
        def shares(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sizes, codes = [], []

            def told() -> Iterator[pd.Series]:
                found, at = model.shares(np.concatenate(codes)), 0
                for n in sizes:
                    yield pd.Series(list(found[at : at + n]), dtype=object)
                    at += n
                sizes.clear(), codes.clear()

            for column in columns:
                sizes.append(len(column))
                codes.append(codes_of(np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(model.edges))), model.edges))
                if sum(sizes) >= BLOCK:
                    yield from told()
            if sizes:
                yield from told()
    else:
        shared = spark.sparkContext.broadcast(model)  # boosting: of bounded size

        @F.pandas_udf("array<double>")
        def shares(column: pd.Series) -> pd.Series:
            own = shared.value
            if not len(column):
                return pd.Series([], dtype=object)
            return pd.Series(list(own.probabilities(np.stack(column.to_numpy()), limits=True)))

    out = df.withColumn("__shares", shares(vector_to_array(F.col(features))))
    best = (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")
    return out.withColumn("probability", array_to_vector(F.col("__shares"))).withColumn("prediction", best).drop("__shares")
