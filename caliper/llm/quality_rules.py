"""Quality rules: a learned decision list over text statistics.

Statistics of whole texts come from DataFrame expressions alone.  Sequential covering
learns the list from labelled documents: a rule for low quality grows condition by
condition (statistic <= or > threshold, chosen by information gain), is pruned to the
beginning that shortens the description of the labels most, is kept if it does and is
precise enough, and takes the documents it covers out of what the next rule learns from.  The list comes
out as one ordered conditional expression.

A learning step is one grouped count of (statistic, threshold bin): the driver sees a row
for each bin, whatever the number of labels.

Cases: a null or empty text has no words and fails the base rules; a document without a
label, or whose labels differ, teaches nothing; without labels (or of one kind only) the
list is empty and keeps what the base rules keep; repeated rows are judged each for
itself; of conditions with equal gain the narrower one on the same statistic, else the first
in the order of statistics is taken; a very long text is one row of statistics; other columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm import store

# fixed values: white space between words, and the symbols that are counted
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

#: What rules may ask about, from the counted columns.
RATIOS = {
    "words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over every whole text: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_marks, n_capitals, n_digits``.

    Words in repeated three-word windows are found by sorting the windows' 64-bit hashes
    with their positions within the row; a text whose windows all differ is not sorted."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACE_CHARS, "")

    def count(chars: str) -> Column:
        return (F.length("bare") - F.length(F.translate("bare", chars, ""))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = store.as_text(df, id_col, text_col).select("doc_id", bare.alias("bare"), F.array_remove(F.split(text, SPACE + "+"), "").alias("words"), lines.alias("lines"))
    n = F.greatest(F.size("words") - 2, F.lit(0))
    windows = F.zip_with(F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                         F.slice("words", 3, n), lambda p, z: F.xxhash64(p["x"], p["y"], z))
    b = a.select("doc_id", F.size("words").cast("long").alias("n_words"), F.length("bare").cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
                 count("!?.,;:").alias("n_marks"), count(CAPITALS).alias("n_capitals"), count(DIGITS).alias("n_digits"), windows.alias("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    follows = F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1)))
    near = F.zip_with("placed", follows, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    spots = F.sort_array(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))
    d = c.withColumn("spots", spots).drop("placed")
    reach = F.zip_with("spots", F.slice("spots", 2, F.greatest(F.size("spots"), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(reach, F.lit(0), lambda s, x: s + x), F.lit(0))
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("spots")


def base_failed() -> Column:
    """The fixed rules: fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``statistic > threshold`` or ``statistic <= threshold``."""

    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.expr(RATIOS[self.statistic]).cast("double")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def as_expression(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: false where a rule fires, else true."""
    out = None
    for rule in rules:
        out = F.when(covers(rule), False) if out is None else out.when(covers(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _gain(before: tuple[int, int], low: int, high: int) -> float:
    """Information gained on the low-quality rows that a condition keeps."""
    if not low:
        return 0.0
    return low * (math.log2(low / (low + high)) - math.log2(before[0] / sum(before)))


def _bits(low: int, high: int) -> float:
    """Length of a code for which of ``low + high`` labels are low: their number, then which."""
    n = low + high
    return math.log2(n + 1) + (math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(high + 1)) / math.log(2)


def saving(left: tuple[int, int], low: int, high: int, conditions: int, choices: int) -> float:
    """Bits that a rule saves on the labels (low, high) that are left: coding those that it
    covers apart from the others, less what it takes to name its conditions out of
    ``choices`` each.  What chance finds among so many conditions saves nothing."""
    apart = _bits(low, high) + _bits(left[0] - low, left[1] - high)
    return _bits(*left) - apart - conditions * math.log2(2 * max(1, choices))


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 24, min_precision: float = 0.9) -> list[Rule]:
    """A decision list from statistics with ``low`` (boolean).  A rule grows on the labels
    that earlier ones left; of its beginnings the one that saves most bits is kept, if at
    least ``min_precision`` of what it covers is low and it saves any.  So the evidence asked
    for follows the labels at hand: a handful of hits that nothing of high quality shares is
    enough among few labels, and many hits of a common condition are not."""
    names = list(RATIOS)
    rows = labelled.select("low", *(F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()))
    rows = store.written(rows, "quality-labels")
    shares = [k / bins for k in range(1, bins)]
    found = rows.where("low").agg(*(F.percentile_approx(n, shares, 2000).alias(n) for n in names)).unionByName(
        rows.where("not low").agg(*(F.percentile_approx(n, shares, 2000).alias(n) for n in names))).collect()
    cuts = {n: sorted({float(x) for r in found for x in (r[n] or [])}) for n in names}
    names = [n for n in names if cuts[n]]
    choices = sum(map(len, cuts.values()))
    binned = rows.select("*", F.array(*(F.struct(F.lit(n).alias("name"), _bin(F.col(n), cuts[n]).alias("bin")) for n in names)).alias("at")) if names else rows
    rules: list[Rule] = []
    left = F.lit(True)

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & ((F.col(c.statistic) > c.threshold) if c.above else (F.col(c.statistic) <= c.threshold))
        return out

    while names and len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = binned.where(left & holds(rule)).select("low", F.explode("at").alias("at")).groupBy("at.name", "at.bin").agg(
                F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("high")).collect()
            best = _best(counts, cuts)
            if best is None:
                break
            rule = (*rule, best[0])
            if best[1] == 0:  # nothing of high quality is left to exclude
                break
        if not rule:
            break
        judged = binned.where(left).agg(*(F.count_if(holds(rule[:k]) & (F.col("low") if want else ~F.col("low"))).alias(f"{want}{k}") for k in range(len(rule) + 1) for want in (1, 0))).first()
        here = {k: (judged[f"1{k}"], judged[f"0{k}"]) for k in range(len(rule) + 1)}
        worth = {k: saving(here[0], *here[k], k, choices) for k in range(1, len(rule) + 1) if here[k][0] >= min_precision * sum(here[k])}
        if not worth or max(worth.values()) <= 0:
            break
        k = max(worth, key=lambda k: (worth[k], -k))  # the shortest of those that save most
        rules.append(rule[:k])
        left = left & ~holds(rule[:k])
    return rules


def held_out(df: DataFrame, labels: DataFrame, parts: int = 3, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", **fit) -> DataFrame:
    """One row with ``low, caught, called, right``: over all labelled documents that pass the
    base rules, each judged by a list learned without its part (by hash of the id), how many
    are low, how many of these the list calls low, how many it calls low, and the share of
    those that are."""
    taught = _taught(store.written(statistics(df, id_col, text_col), "quality-statistics"), labels, id_col, quality_col)
    taught = store.written(taught.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))), "quality-parts")
    told = [taught.where(F.col("part") == p).select("low", (~as_expression(learn(taught.where(F.col("part") != p), **fit))).alias("called")) for p in range(parts)]
    whole = told[0]
    for t in told[1:]:
        whole = whole.unionByName(t)
    sums = whole.agg(F.count_if("low").alias("low"), F.count_if(F.col("low") & F.col("called")).alias("caught"), F.count_if("called").alias("called"))
    return sums.withColumn("right", F.try_divide("caught", "called"))


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    table = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    return F.aggregate(table, F.lit(0), lambda n, c: n + F.when(value > c, 1).otherwise(0))


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition of most gain, and how many high-quality rows it keeps."""
    best, gained = None, 1e-9
    for name, thresholds in cuts.items():
        own = {r["bin"]: (r["low"], r["high"]) for r in counts if r["name"] == name}
        total = (sum(v[0] for v in own.values()), sum(v[1] for v in own.values()))
        if not total[0] or not total[1]:
            continue
        low = high = 0
        for k, threshold in enumerate(thresholds):
            low, high = low + own.get(k, (0, 0))[0], high + own.get(k, (0, 0))[1]
            for above, kept in ((False, (low, high)), (True, (total[0] - low, total[1] - high))):
                g = _gain(total, *kept)
                # of equally good conditions the one that covers less of what was never seen
                narrower = best is not None and g == gained and above and best[0].above and best[0].statistic == name
                if g > gained or narrower:
                    best, gained = (Condition(name, above, threshold), kept[1]), g
    return best


def _taught(stats: DataFrame, labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{quality_col}`").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    return stats.where(~base_failed()).join(known, "doc_id").withColumn("low", F.col("quality") == 0)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", **fit) -> tuple[DataFrame, list[Rule]]:
    """Statistics, ``base_failed`` and ``kept`` for every row, and the learned list."""
    stats = store.written(statistics(df, id_col, text_col), "quality-statistics")
    taught = _taught(stats, labels, id_col, quality_col)
    rules = learn(taught, **fit)
    return stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & as_expression(rules)}), rules
