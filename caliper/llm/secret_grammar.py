"""Secret scans with inferred grammars.

Fixed patterns find the plain cases.  What they find is also the labelled material: for
each kind, the credentials make a prefix tree with counts, whose compatible states are merged
into a probabilistic automaton of the kind's format, in two steps.  States of one depth are
merged first, by the likelihood-ratio test on next symbols and endings, each new state against
the pooled counts of those merged before; a single string says little, all strings at a place
say much.  Then states of different depths are merged where they and all that follows them are
alike; so a format of one length stays a chain, and one of any length gets a loop.

All runs of a kind's alphabet that have a length seen in it are scored, whole, with their
ending.  A run is a secret if it is as likely as nearly all of the labelled ones, and likelier
than ordinary text by a margin that grows with its length.  A run that ends where no labelled
one does is none.

The fit uses at most ``per_kind`` distinct credentials a kind (those of smallest hash);
ordinary text is what all whole texts have, and the scan covers all of them.

Cases: a null or empty text has no spans; without labelled credentials of a kind that
kind has no automaton; equal spans of one kind count once; repeated rows are scanned each
for itself; offsets are code points, ends exclusive; other columns aren't read and may have
any name; a very long text is searched in place, run by run; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caliper.llm import store

# fixed values: the base patterns, the least lengths, and the order of kinds
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # longest runs: shorter ones would be dropped
_KEYS = ("passw", "secret", "token", "api")

END = ""


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns: leftmost, non-overlapping per
    kind, failing matches dropped; by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Automaton:
    """States 0.. with next states and counts by symbol, and counts of endings."""

    step: list[dict[str, int]] = field(default_factory=list)
    seen: list[Counter] = field(default_factory=list)
    least: float = 0.0  # log-likelihood per symbol from which a string has the format
    lengths: tuple[int, int] = (0, 0)  # least and most symbols of a labelled string

    def __post_init__(self):
        self.symbols = sum((Counter({s: n for s, n in c.items() if s != END}) for c in self.seen), Counter())
        self.usual = [max(to, key=lambda s: (c[s], s)) if to else END for to, c in zip(self.step, self.seen)]

    def whole(self, s: str, known: bool = False) -> float:
        """Log-likelihood of the string and its ending; -inf off the automaton.  A symbol
        that was never seen at a place, but elsewhere, has the weight of a part of one
        sighting, and leads where most others do.  Of a ``known`` string, one of those that
        the counts are made of, its own sightings don't count."""
        total, at, all_ = 0.0, 0, self.symbols.total()
        for symbol in s:
            if symbol not in self.symbols or not self.step[at]:
                return -math.inf
            own = self.seen[at]
            total += math.log((max(0, own[symbol] - known) + self.symbols[symbol] / all_) / (max(1, own.total() - known) + 1))
            at = self.step[at].get(symbol, self.step[at][self.usual[at]])
        ends = self.seen[at][END]
        return total + math.log(ends / self.seen[at].total()) if ends else -math.inf

    def score(self, s: str, known: bool = False) -> float:
        """Log-likelihood per symbol, the end counted."""
        return self.whole(s, known) / (len(s) + 1)


def _alike(p: Counter, q: Counter, z: float) -> bool:
    """Whether two states' counts may come from one distribution: the likelihood ratio
    against its chi-squared bound at the normal quantile ``z``."""
    n, m = p.total(), q.total()
    both = p.keys() | q.keys()
    if not n or not m or len(both) < 2:
        return True
    ratio = 0.0
    for s in both:
        t = p[s] + q[s]
        for own, size in ((p[s], n), (q[s], m)):
            if own:
                ratio += 2 * own * math.log(own * (n + m) / (t * size))
    d = len(both) - 1
    return ratio <= d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


#: Normal quantiles of the tests within a depth (one in 1,000) and across depths (one in 20).
WITHIN, ACROSS = 3.09, 1.645


def layers(strings: list[str]) -> tuple[list[dict[str, int]], list[Counter]]:
    """The prefix tree with alike states of each depth merged: next states and counts."""
    step: list[dict[str, int]] = [{}]
    seen = [Counter(s[:1] or END for s in strings)]
    level = [(0, sorted(strings))]
    depth = 0
    while level:
        children = []
        for state, own in level:
            below: dict[str, list[str]] = {}
            for s in own:
                if len(s) > depth:
                    below.setdefault(s[depth], []).append(s)
            children += [(state, symbol, mine) for symbol, mine in below.items()]
        depth += 1
        level = []
        for state, symbol, mine in sorted(children, key=lambda c: (-len(c[2]), c[0], c[1])):
            counts = Counter(s[depth : depth + 1] or END for s in mine)
            for at, own in level:
                if _alike(seen[at], counts, WITHIN):
                    seen[at] += counts
                    own += mine
                    step[state][symbol] = at
                    break
            else:
                step[state][symbol] = len(step)
                level.append((len(step), mine))
                step.append({})
                seen.append(counts)
    return step, seen


def infer(strings: list[str]) -> Automaton:
    """The automaton of labelled strings; the same for any order of them."""
    step, seen = layers(strings)
    name = list(range(len(step)))  # what a state was merged into

    def find(x: int) -> int:
        while name[x] != x:
            x = name[x]
        return x

    def alike_below(p: int, q: int) -> bool:
        todo, met = [(p, q)], set()
        while todo:
            x, y = (find(v) for v in todo.pop())
            if x == y or (x, y) in met:
                continue
            met.add((x, y))
            if not _alike(seen[x], seen[y], ACROSS):
                return False
            todo += [(step[x][s], step[y][s]) for s in step[x].keys() & step[y].keys()]
        return True

    def merge(p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            x, y = sorted(find(v) for v in todo.pop())
            if x != y:
                name[y] = x
                seen[x] = seen[x] + seen[y]
                todo += [(step[x][s], step[y][s]) for s in step[x].keys() & step[y].keys()]
                step[x] = step[y] | step[x]

    kept: list[int] = []
    for state in range(len(step)):
        if find(state) == state:
            like = next((k for k in kept if find(k) == k and alike_below(k, state)), None)
            if like is None:
                kept.append(state)
            else:
                merge(like, state)
    left = sorted({find(x) for x in range(len(step))})
    number = {state: i for i, state in enumerate(left)}
    sizes = [len(s) for s in strings]
    out = Automaton([{s: number[find(t)] for s, t in step[k].items()} for k in left], [seen[k] for k in left], lengths=(min(sizes), max(sizes)))
    scores = sorted(out.score(s, known=True) for s in strings)  # as of strings that the fit has not seen
    out.least = scores[len(scores) // 100] - 1e-9
    return out


#: By how much a secret is likelier than ordinary text: so many nats, and so many a symbol.
MARGIN, MARGIN_PER_SYMBOL = 3.0, 0.25


@dataclass
class Model:
    automata: dict[str, Automaton]
    plain: dict[str, float]  # log-probability of characters in ordinary text

    def __post_init__(self):
        self.runs = {}
        for kind, a in self.automata.items():
            letters = "".join(re.escape(s) for s in sorted(a.symbols))
            if letters:
                self.runs[kind] = re.compile(f"[{letters}]{{{max(1, a.lengths[0])},}}")

    def has_format(self, kind: str, s: str) -> bool:
        a = self.automata[kind]
        if a.score(s) < a.least:
            return False
        usual = sum(self.plain.get(c, self.plain[END]) for c in s)
        return a.whole(s) - usual > MARGIN + MARGIN_PER_SYMBOL * len(s)

    def secret(self, s: str) -> bool:
        return any(self.has_format(kind, s) for kind in self.automata)

    def formats(self, text: str) -> set[tuple[int, int]]:
        """(start, end) of all runs of a kind's alphabet with a length seen in it that have
        its format; a full stop at a run's end may be the sentence's."""
        out = set()
        for kind, runs in self.runs.items():
            low, high = self.automata[kind].lengths
            for m in runs.finditer(text):
                start, end = m.span()
                for stop in (end, end - 1) if text[end - 1] == "." else (end,):
                    if low <= stop - start <= high and self.has_format(kind, text[start:stop]):
                        out.add((start, stop))
                        break
        return out


def spans_of(text: str, model: Model) -> list[tuple[str, int, int]]:
    """All spans of a text: base ones and those the automata add beside them."""
    base = base_spans(text)
    more = [("format", start, end) for start, end in model.formats(text) if not any(s < end and start < e for _, s, e, _ in base)]
    return sorted({*((k, s, e) for k, s, e, _ in base), *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: base spans with their credentials.  Narrow: no shuffle."""
    store.ready(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in store.slices(batches, "text"):
            base = [[dict(kind=k, start=s, end=e, value=v) for k, s, e, v in base_spans(text or "")] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, kind)], ["doc_id", "spans"])

    return store.as_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, spans {_SPAN}")


def plain_symbols(df: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Log-probabilities of characters in ordinary text, from all whole texts (repeated
    rows count each for itself).  Each task counts; a row for each character reaches the driver."""
    store.ready(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for part in store.slices(batches, "text"):
            for text in part.column("text").to_pylist():
                for start in range(0, len(text or ""), 1 << 20):
                    n = np.bincount(np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
                    total[: len(n)] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["c", "n"])

    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = {chr(r["c"]): r["n"] for r in texts.mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values()) + 256
    return {c: math.log((n + 1) / total) for c, n in seen.items()} | {END: math.log(1 / total)}


def learn(scanned: DataFrame, texts: DataFrame, text_col: str = "text", per_kind: int = 400) -> Model:
    """Automata from the scan's labelled credentials, one task for each kind's bounded
    sample."""
    one = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value").distinct()
    parts = [one.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(per_kind) for k in KINDS[:3]]
    few = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = infer(sorted(pdf["value"]))
        rows = [(pdf["kind"].iloc[0], i, s, a.step[i].get(s, -1), n, a.least, *a.lengths) for i in range(len(a.step)) for s, n in a.seen[i].items()]
        return pd.DataFrame(rows, columns=["kind", "state", "symbol", "next", "n", "least", "shortest", "longest"])

    automata: dict[str, Automaton] = {}
    for r in few.groupBy("kind").applyInPandas(fit, "kind string, state long, symbol string, next long, n long, least double, shortest long, longest long").collect():
        a = automata.setdefault(r["kind"], Automaton(least=r["least"], lengths=(r["shortest"], r["longest"])))
        while len(a.step) <= max(r["state"], r["next"]):
            a.step.append({})
            a.seen.append(Counter())
        a.seen[r["state"]][r["symbol"]] = r["n"]
        if r["next"] >= 0:
            a.step[r["state"]][r["symbol"]] = r["next"]
    for a in automata.values():
        a.__post_init__()  # the totals of what was filled in
    return Model(automata, plain_symbols(texts, text_col))


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (kind, start, end) of every row, base spans and those that the
    automata add, by start, then kind."""
    spark = store.ready(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # states of a bounded sample
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in store.slices(batches, "text"):
            found = [[dict(kind=k, start=s, end=e) for k, s, e in spans_of(text or "", shared.value)] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return store.as_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def held_out(scanned: DataFrame, texts: DataFrame, parts: int = 3) -> DataFrame:
    """``kind, labelled, caught``: distinct credentials of each kind, and how many have a
    format that a model learned from the other parts (by hash of the credential)."""
    one = store.written(scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value").distinct().withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts))), "secret-labels")
    plain = plain_symbols(texts)
    told = []
    for p in range(parts):
        rest = one.where(F.col("part") != p).groupBy(F.lit(0).alias("doc_id"), F.xxhash64("value")).agg(F.collect_list(F.struct("kind", F.lit(0).alias("start"), F.lit(0).alias("end"), "value")).alias("spans"))
        model = Model(learn(rest, texts.limit(0)).automata, plain)
        caught = F.udf(model.secret, "boolean")  # a few labelled strings
        told.append(one.where(F.col("part") == p).select("kind", caught("value").alias("caught")))
    whole = told[0]
    for t in told[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("kind").agg(F.count("*").alias("labelled"), F.count_if("caught").alias("caught"))


def redact(df: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``df``, each run of touching spans in the text replaced by
    ``mark``; ``length_col`` (code points of the text) follows where a text changed."""
    spark = store.ready(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType(df.schema.fields)

    def clean(text: str | None) -> str | None:
        spans = spans_of(text, shared.value) if text else []
        out, end = [], 0
        for _, start, stop in spans:
            if start > end or not out:
                out += [text[end:start], mark]
            end = max(end, stop)
        return "".join(out) + text[end:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in store.slices(batches, text_col):
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            before = columns[text_col].to_pylist()
            after = [clean(t) for t in before]
            columns[text_col] = pa.array(after, columns[text_col].type)
            if length_col and length_col in columns:
                old = columns[length_col].to_pylist()
                columns[length_col] = pa.array([n if a == b else len(a) for n, a, b in zip(old, after, before, strict=True)], columns[length_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return df.mapInArrow(run, schema)
