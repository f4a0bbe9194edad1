"""URL filter: allow and block rules by host and path, and for all other URLs a logistic
regression on hashed character n-grams of host and path.

Everything is DataFrame expressions.  A URL's n-grams are hashed into a fixed number of
weights; a row's score is the sum of its weights over the root of their number.  The model
is trained by gradient steps, each one a grouped sum over a small labelled URL table (at
most ``max_labelled`` distinct URLs, those of smallest hash; the bound is for the fit
alone).  The labels are the rules' own verdicts, so the model carries what the rules say
about hosts and paths over to URLs that no rule fits.

Cases: a null URL or one without ``://`` has an empty host and path, which fit no rule;
without labelled URLs of both verdicts the model's verdict is the one verdict that was
seen, or ``allow``; repeated rows are judged each for itself; a very long URL is one row of
n-grams; of equally long rules the first one given wins; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm import store

# fixed values: the capital letters that a host lower-cases
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALLOW, BLOCK = "allow", "block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, CAPITALS, CAPITALS.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits.  ``rules`` are
    (verdict, host, path); a rule fits its host and the host's subdomains and all paths
    that start with its path.  Of equally long rules the first one given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # tried last to first
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(tag: str, text: Column, sizes: Sequence[int], buckets: int) -> list[Column]:
    """Hashed n-grams of a text between two markers (linear in the text's length)."""
    chars = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")
    out = []
    for n in sizes:
        parts = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        for k in range(1, n):  # zip on the k-th character after
            later = F.slice(chars, k + 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
            parts = F.zip_with(parts, later, lambda a, b: F.concat(a, b))
        kind = F.lit(f"{tag}{n}")
        out.append(F.transform(parts, lambda g: F.pmod(F.xxhash64(kind, g), F.lit(buckets)).cast("int")))  # noqa: B023  called at once
    return out


def features(host: Column, path: Column, sizes: Sequence[int] = (2, 3, 4), buckets: int = 1 << 12) -> Column:
    """Bucket numbers of all n-grams of host and path; the last number, ``buckets``, is
    the constant's."""
    return F.concat(*_grams("h", host, sizes, buckets), *_grams("p", path, sizes, buckets), F.array(F.lit(buckets)))


def _score(grams: Column, weights: Sequence[float]) -> Column:
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
    return total / F.sqrt(F.size(grams).cast("double"))


def train(labelled: DataFrame, buckets: int = 1 << 12, sizes: Sequence[int] = (2, 3, 4), rounds: int = 25, rate: float = 0.5,
          decay: float = 1e-4, max_labelled: int = 4096) -> list[float] | None:
    """Weights of the logistic regression from ``host, path, blocked``; None if only one
    verdict was seen.  Adaptive gradient steps over all kept rows at once."""
    few = labelled.where("blocked is not null").groupBy("host", "path").agg(F.max("blocked").alias("blocked"))
    few = few.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled)
    rows = store.written(few.select(F.col("blocked").cast("double").alias("y"), features(F.col("host"), F.col("path"), sizes, buckets).alias("grams")).coalesce(1), "url-labels")
    n, blocked = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or blocked in (0, n):
        return None
    weights, seen = [0.0] * (buckets + 1), [1e-8] * (buckets + 1)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_score(F.col("grams"), weights)))
        slope = (F.col("y") - p) / F.sqrt(F.size("grams").cast("double"))
        steps = rows.select(slope.alias("d"), F.explode("grams").alias("g")).groupBy("g").agg(F.sum("d").alias("d"))
        for g, d in steps.collect():  # a row for each weight at most
            d = d / n - decay * weights[g]
            seen[g] += d * d
            weights[g] += rate * d / math.sqrt(seen[g])
    return weights


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", **fit) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; score is the model's
    (above 0 it blocks; null where one verdict only was seen)."""
    host, path = split_url(F.col("url"))
    split = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    split = split.select("*", rule.alias("rule"), ruled.alias("ruled"))
    labelled = split.where("ruled is not null").select("host", "path", (F.col("ruled") == BLOCK).alias("blocked"))
    weights = train(labelled, **fit)
    if weights is None:
        seen = labelled.select("blocked").limit(1).collect()
        own, score = F.lit(BLOCK if seen and seen[0][0] else ALLOW), F.lit(None).cast("double")
        return split.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), score.alias("score"))
    known = {k: v for k, v in fit.items() if k in ("sizes", "buckets")}
    score = _score(features(F.col("host"), F.col("path"), **known), weights)
    scored = split.select("*", score.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
