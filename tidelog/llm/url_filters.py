"""URL filters: explicit rules, and gradient-boosted trees on lexical features for the rest.

Labelled URLs train the trees: those that a rule decides. Features are the lengths of the URL, host and path, depth,
digit ratio, entropy of the characters, parameters, hyphens and labels of the host, and suffix statistics: the smoothed
share of blocked ones among labelled URLs of the same last host label. Statistics and bin edges are aggregated over all
labelled rows; a bounded sample of distinct binned rows (SAMPLE) comes to the driver, where the trees are grown on
histograms. A fitted model is a column expression, so judging is one scan of built-in functions: no Python runs on the
executors.

Defined results: a null URL, or one without "://", has an empty host and path, no rule, and the trees' verdict on its
features; with no labelled URLs of both kinds the verdict is the only kind that there is, or allow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import table

#: (action, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000
TREES = 24
DEPTH = 3
BINS = 12
RATE = 0.3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits; null if none does. Of equally long ones the first wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, action = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
    return rule, action


FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "suffix_rate")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL by itself; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    query = F.when(url.contains("?"), F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
        "entropy": F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))),
        "parameters": query + count(url, "&"),
        "hyphens": count(host, "-"),
        "labels": count(host, ".") + 1,
    }


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _grow(rows: list[tuple[tuple[int, ...], float, float]], g: list[float], h: list[float], depth: int):
    """A tree over binned rows: a leaf's value, or (feature, bin, left of it, right of it)."""
    total_g, total_h = sum(g), sum(h)
    leaf = -total_g / (total_h + 1.0)
    if depth == 0:
        return leaf
    best, gain = None, 1e-6
    for f in range(len(FEATURES)):
        sums = [[0.0, 0.0] for _ in range(BINS + 1)]
        for (bins, _, _), a, b in zip(rows, g, h, strict=True):
            cell = sums[bins[f]]
            cell[0] += a
            cell[1] += b
        left_g = left_h = 0.0
        for k in range(BINS):
            left_g += sums[k][0]
            left_h += sums[k][1]
            right_g, right_h = total_g - left_g, total_h - left_h
            if left_h < 1e-3 or right_h < 1e-3:
                continue
            found = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
            if found > gain:
                best, gain = (f, k), found
    if best is None:
        return leaf
    f, k = best
    left = [i for i, r in enumerate(rows) if r[0][f] <= k]
    right = [i for i, r in enumerate(rows) if r[0][f] > k]
    pick = lambda at: ([rows[i] for i in at], [g[i] for i in at], [h[i] for i in at], depth - 1)
    return f, k, _grow(*pick(left)), _grow(*pick(right))


def _value(tree, bins: Sequence[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(rows: list[tuple[tuple[int, ...], float, float]]):
    """(base, trees) for rows of (bins, blocked count, allowed count), by Newton steps on the logistic loss."""
    blocked, allowed = sum(r[1] for r in rows), sum(r[2] for r in rows)
    base = math.log((blocked + 0.5) / (allowed + 0.5))
    score, trees = [base] * len(rows), []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        g = [q * (a + b) - a for q, (_, a, b) in zip(p, rows, strict=True)]
        h = [q * (1 - q) * (a + b) for q, (_, a, b) in zip(p, rows, strict=True)]
        tree = _grow(rows, g, h, DEPTH)
        trees.append(tree)
        if not isinstance(tree, tuple):
            break
        score = [s + RATE * _value(tree, r[0]) for s, r in zip(score, rows, strict=True)]
    return base, trees


def _expression(tree, features: dict[str, Column], edges: list[list[float]]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(RATE * tree)
    f, k, left, right = tree
    if k >= len(edges[f]):
        return _expression(left, features, edges)
    return F.when(features[FEATURES[f]] <= edges[f][k], _expression(left, features, edges)).otherwise(_expression(right, features, edges))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    labelled = rows.where(F.col("action").isNotNull()).withColumn("blocked", (F.col("action") == "block").cast("int"))

    per_suffix = labelled.groupBy(_suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))
    n, blocked = per_suffix.agg(F.sum("n"), F.sum("blocked")).first()
    n, blocked = n or 0, blocked or 0
    if not 0 < blocked < n:
        only = F.lit("block" if n and blocked == n else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("action", only).alias("verdict"), F.lit(float(bool(n and blocked == n))).alias("block_score"))
    prior = blocked / n
    suffixes = per_suffix.collect()  # a rule's host has one, so there are as many as rules at most
    rate = F.lit(prior)
    for s in sorted(suffixes, key=lambda s: s.suffix):
        rate = F.when(_suffix(F.col("host")) == s.suffix, F.lit((s.blocked + 10 * prior) / (s.n + 10))).otherwise(rate)
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_rate": rate}

    cuts = [i / BINS for i in range(1, BINS)]
    found = labelled.select("blocked", *[c.alias(k) for k, c in features.items()])
    edges = [sorted(set(x)) for x in found.agg(*[F.percentile_approx(k, cuts).alias(k) for k in FEATURES]).first()]
    binned = [sum((F.col(k) > e).cast("int") for e in edge[1:]) + (F.col(k) > edge[0]).cast("int") if len(edge) > 1 else (F.col(k) > edge[0]).cast("int") for k, edge in zip(FEATURES, edges, strict=True)]
    vectors = found.select("blocked", *[b.alias(k) for k, b in zip(FEATURES, binned, strict=True)]).groupBy(*FEATURES).agg(F.sum("blocked").alias("blocked"), F.count("*").alias("n"))
    sampled = vectors.orderBy(F.xxhash64(*FEATURES)).limit(SAMPLE).collect()
    base, trees = boost(sorted((tuple(r[k] for k in FEATURES), float(r.blocked), float(r.n - r.blocked)) for r in sampled))

    score = F.lit(base)
    for tree in trees:
        score = score + _expression(tree, {k: F.col(f"f.{k}") for k in FEATURES}, edges)
    shown = rows.withColumn("f", F.struct(*[c.alias(k) for k, c in features.items()])).withColumn("block_score", 1 / (1 + F.exp(-score)))
    return shown.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
