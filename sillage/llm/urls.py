"""URL filters: rules first, gradient-boosted trees on lexical features for what no rule decides.

All of it is DataFrame expressions. The trees are trained on a bounded sample of the URLs that rules have labelled:
features are binned, equal bin vectors are counted once, and these cells, no more than the sample has rows, come to the
driver, which grows the trees; their number is where the loss on a held-out fold is least. How often the sample has a
host's suffix of one, two and three labels, or a path's first part, and how often blocked, are features too; of a URL of
the sample these come from the other folds, so that no label tells of itself. Scoring is a sum of CASE expressions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.common import cut

#: (verdict, rule): a host with a path that starts with "/".
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
#: The bound of the labelled sample that the trees are fit on; trees at most, their depth, the shrinkage, bins of a feature.
SAMPLE, TREES, DEPTH, RATE, BINS, RIDGE = 20_000, 60, 4, 0.2, 16, 1.0
#: Folds of the sample; URLs that a part's share of blocked ones has beforehand, at the sample's own share.
FOLDS, BEFORE = 5, 4.0
#: Steps that a share is told in.
STEPS = 6


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path up to "?", "#" or the end.
    Null and no "://": both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later ones, longer, win
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL, all of them doubles."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    chars = F.filter(F.split(F.lower(url), ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s - (k / n) * F.log2(k / n))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(url, f"[^{pattern}]", "")) / n

    out = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": share("0-9"),
        "symbol_ratio": F.length(F.regexp_replace(url, "[a-zA-Z0-9]", "")) / n,
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "page_suffix": F.length(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1)),
        "https": F.lower(url).startswith("https:").cast("int"),
    }
    out["suffix_length"] = F.length(suffix_of(host))
    return {k: c.cast("double") for k, c in out.items()}


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.?([^.]*)$", 1)


def parts(host: Column, path: Column) -> dict[str, Column]:
    """The parts of a URL whose share of blocked ones the sample tells: suffixes of the host, the path's first part."""
    return {
        "suffix": suffix_of(host), "domain": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1), "site": F.regexp_extract(host, r"([^.]*\.?[^.]*\.?[^.]*)$", 1),
        "first": F.lower(F.regexp_extract(path, r"^/([^/]*)", 1)),
    }


class Model(NamedTuple):
    """base: the log odds before any tree; trees: nested (feature, threshold, below, above) or a leaf's value."""

    base: float
    trees: list

    def score(self, row: dict[str, Column]) -> Column:
        """Log odds of "block"."""
        total = F.lit(self.base)
        for t in self.trees:
            total = total + _case(t, row)
        return total


def _case(tree, row: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, below, above = tree
    return F.when(row[feature] <= threshold, _case(below, row)).otherwise(_case(above, row))


def fit(few: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, fold: str | None = None) -> Model:
    """few, a bounded table: `names` as doubles and y (1 to block, 0 to allow). One class only, or none: a constant
    model. fold: a column that is 0 in rows that are held out first, to find the number of trees up to `trees`."""
    n, blocked, *edges = few.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum("y"), F.lit(0)),
        *[F.array_distinct(F.percentile(c, F.array(*[F.lit(k / BINS) for k in range(1, BINS)]))) for c in names],
    ).first()
    if not n or blocked in (0, n):
        return Model(0.0 if not n else (20.0 if blocked else -20.0), [])
    cuts = {c: sorted(float(x) for x in e) for c, e in zip(names, edges, strict=True)}
    bins = [sum((F.col(c) > x).cast("int") for x in cuts[c]).cast("int").alias(c) if cuts[c] else F.lit(0).alias(c) for c in names]
    held = (F.col(fold) == 0).cast("int") if fold else F.lit(0)
    cells = few.select(*bins, held.alias("__held"), "y").groupBy(*names, "__held").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    found = np.array(sorted(map(tuple, cells.collect())), np.int64)  # as many rows as few has, at most
    x, out, total, pos = found[:, : len(names)], found[:, -3] == 1, found[:, -2].astype(float), found[:, -1].astype(float)
    if out.any() and pos[~out].sum() not in (0, total[~out].sum()):
        _, _, loss = _boosted(x[~out], total[~out], pos[~out], trees, depth, (x[out], total[out], pos[out]))
        trees = int(np.argmin(loss))
    base, grown, _ = _boosted(x, total, pos, trees, depth)

    def named(t):
        return t if not isinstance(t, tuple) else (names[t[0]], cuts[names[t[0]]][t[1]], named(t[2]), named(t[3]))

    return Model(base, [named(t) for t in grown])


def _boosted(x: np.ndarray, total: np.ndarray, pos: np.ndarray, trees: int, depth: int, held=None) -> tuple[float, list, list[float]]:
    """The base, trees over bin vectors x with their counts, and the loss on held-out cells with 0, 1, ... of them."""
    base = math.log(pos.sum() / (total.sum() - pos.sum()))
    odds, grown, losses = np.full(len(x), base), [], []
    told = np.full(len(held[0]), base) if held else None

    def loss() -> float:
        return float((held[1] * np.logaddexp(0, told) - held[2] * told).sum())

    if held:
        losses.append(loss())
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        grown.append(_grow(x, pos - total * p, total * p * (1 - p), np.arange(len(x)), depth, odds))
        if held:
            told += np.array([_leaf(grown[-1], row) for row in held[0]])
            losses.append(loss())
    return base, grown, losses


def _leaf(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, odds: np.ndarray):
    """A tree for the cells `at`: split at "bin <= k" where the gain is largest, first by feature and k on ties. Adds
    the leaves' values to odds."""
    g_all, h_all = g[at].sum(), h[at].sum()
    best = (1e-3, None, None)
    for f in range(x.shape[1] if depth else 0):
        g_in, h_in = (np.bincount(x[at, f], v[at]).cumsum()[:-1] for v in (g, h))
        gains = g_in**2 / (h_in + RIDGE) + (g_all - g_in) ** 2 / (h_all - h_in + RIDGE) - g_all**2 / (h_all + RIDGE)
        if len(gains) and gains.max() > best[0] + 1e-9:
            best = (gains.max(), f, int(gains.argmax()))
    if best[1] is None:
        value = float(RATE * g_all / (h_all + RIDGE))
        odds[at] += value
        return value
    _, f, k = best
    below = x[at, f] <= k
    return (f, k, _grow(x, g, h, at[below], depth - 1, odds), _grow(x, g, h, at[~below], depth - 1, odds))


def described(pages: DataFrame, rules=RULES) -> tuple[DataFrame, list[str]]:
    """(page_id, url) with host, path, rule, said (the rule's verdict), the lexical features and the parts; the names of the
    features."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    lexical = features(F.col("url"), F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "said": said} | parts(F.col("host"), F.col("path")) | lexical), list(lexical)


def learn(labelled: DataFrame, lexical: list[str], sample: int = SAMPLE):
    """From described URLs with `said`, no more than `sample` of them, a function that adds `score` to described URLs."""
    told = list(parts(F.lit(""), F.lit("")))
    few = labelled.withColumn("y", (F.col("said") == "block").cast("int")).orderBy(F.xxhash64("url"), "url").limit(sample)
    few = cut(few.select(*told, "y", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).alias("fold"), *lexical))
    blocked = few.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]

    def stats(n: dict[str, Column], bad: dict[str, Column]) -> dict[str, Column]:
        """In steps: the folds' figures of one part differ a little, and these differences tell of the labels left out."""
        out = {f"{c}_seen": F.round(F.log1p(n[c])) for c in told}
        return out | {f"{c}_blocked": F.round(STEPS * (bad[c] + BEFORE * blocked) / (n[c] + BEFORE)) / STEPS for c in told}

    def others(x: Column, c: str) -> Column:  # over the folds that are not a row's own; `sample` rows in all
        return F.sum(x).over(Window.partitionBy(c)) - F.sum(x).over(Window.partitionBy(c, "fold"))

    one, y = F.lit(1), F.col("y")
    out_of_fold = few.withColumns(stats({c: others(one, c) for c in told}, {c: others(y, c) for c in told}))
    names = [*lexical, *(f"{c}_{x}" for x in ("seen", "blocked") for c in told)]
    model = fit(out_of_fold, names, fold="fold")

    def score(df: DataFrame) -> DataFrame:
        for c in told:
            seen = few.groupBy(c).agg(F.count(one).alias(f"{c}_n"), F.sum("y").alias(f"{c}_bad"))  # `sample` rows at most
            df = df.join(F.broadcast(seen), c, "left")
        count = lambda x: {c: F.coalesce(f"{c}_{x}", F.lit(0)) for c in told}
        return df.withColumns(stats(count("n"), count("bad"))).withColumn("score", model.score({k: F.col(k) for k in names}))

    return score


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url) to page_id, host, path, rule, verdict, score (log odds of "block" by the trees).

    The rule that fits decides, of several the longest; else the trees, fit on the URLs that rules decide, block where
    score > 0; a score of just 0 allows. Null and malformed URLs have empty host and path and are judged by the trees like
    others; with no URL under any rule all scores are 0 and all such verdicts allow. URLs are read whole however long, but
    for the entropy, whose time is their length times their distinct characters, in linear time. Repeated rows are judged
    alike; other columns are ignored; an empty table gives no rows.
    """
    whole, lexical = described(pages, rules)
    scored = learn(whole.where("rule IS NOT NULL"), lexical, sample)(whole)
    verdict = F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
