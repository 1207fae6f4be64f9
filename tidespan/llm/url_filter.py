"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Trees are fitted on the driver from a bounded sample of labelled URLs (max_rows, the lowest hashes) and turned into one
SQL expression, so every URL is judged by built-in functions in the scan's own stage, with no shuffle.

Defined results: a null URL, or one with no "://", has an empty host and path, fits no rule and is scored on what text
it has (null: empty); empty tables give empty results; repeated rows are judged alike; columns of the input that clash
with added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_hyphens", "f_digit_ratio", "f_entropy",
    "f_parameters", "f_longest_label", "f_vowel_ratio", "f_suffix_rate", "f_suffix_count",
)
FOLDS = 5
#: Words that, as a hyphenated part of a host, label a URL as unwanted in the default training labels.
SEED_WORDS = ["adult", "bets", "casino", "porn", "spam", "warez"]


@dataclass(frozen=True)
class Rule:
    """verdict is block or allow; pattern is host and path in one string, as in "example.com/en/7"."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


@dataclass(frozen=True)
class BoostedTrees:
    """trees: nested (feature, threshold, left, right) or a leaf's value; a URL goes left where the feature is at most the threshold."""

    bias: float
    trees: tuple
    suffixes: DataFrame  # (suffix, f_suffix_rate, f_suffix_count) of all labelled URLs
    prior: float


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumn("_rest", rest).withColumns(
        {
            "host": F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1),
        }
    )


def matching_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule string or null, its verdict) of the longest rule that fits host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.pattern)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features but those of the suffix, and suffix itself (the host's last two labels)."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract("_rest", "^[^?#]*\\?([^#]*)", 1)
    df = df.withColumns({"_u": u, "_labels": F.split("host", "\\."), "_chars": F.split(u, "")})
    n = F.greatest(F.length("_u"), F.lit(1))

    def share(c: Column) -> Column:
        return (F.size("_chars") - F.size(F.array_remove("_chars", c))) / F.size("_chars")

    entropy = F.aggregate(
        F.transform(F.array_distinct("_chars"), share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    return df.withColumns(
        {
            "f_length": F.length("_u"),
            "f_host_length": F.length("host"),
            "f_path_length": F.length("path"),
            "f_depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
            "f_labels": F.size("_labels"),
            "f_hyphens": F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit(""))),
            "f_digit_ratio": F.length(F.regexp_replace("_u", "[^0-9]+", "")) / n,
            "f_entropy": entropy,
            "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
            "f_longest_label": F.coalesce(F.array_max(F.transform("_labels", lambda x: F.length(x))), F.lit(0)),
            "f_vowel_ratio": F.length(F.regexp_replace("host", "[^aeiou]+", "")) / F.greatest(F.length("host"), F.lit(1)),
            "suffix": F.concat_ws(".", F.slice("_labels", F.greatest(F.size("_labels") - 1, F.lit(1)), F.lit(2))),
        }
    )


def suffix_sums(labelled: DataFrame, url: str, label: str) -> DataFrame:
    """(suffix, fold, s, n) over all labelled URLs: their labels' sum and number."""
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).where("y is not null")
    return with_features(with_parts(known)).groupBy("suffix", fold_of("url")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))


def fold_of(url: str) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(2)), F.lit(FOLDS)).alias("fold")


def sample_labelled(labelled: DataFrame, url: str, label: str, max_rows: int, sums: DataFrame) -> list:
    """The max_rows labelled URLs of the lowest hash: bounded, and the same at every run; with the sums of their suffix over all labelled URLs (s, n) and over those of their own fold (s0, n0)."""
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).where("y is not null")
    # a share of hashes that holds a little over max_rows, so that no task sends more than its part of them
    share = min(1.0, 1.2 * max_rows / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1 << 40)) <= int(share * (1 << 40)))
    df = with_features(with_parts(few))
    lexical = [f for f in FEATURES if not f.startswith("f_suffix")]
    lowest = df.select("url", "y", "suffix", fold_of("url"), *lexical).orderBy(F.xxhash64("url"), "url", "y").limit(max_rows)
    whole = sums.groupBy("suffix").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = sums.select("suffix", "fold", F.col("s").alias("s0"), F.col("n").alias("n0"))
    rows = lowest.join(whole, "suffix").join(own, ["suffix", "fold"]).collect()
    return sorted(rows, key=lambda r: (r["url"] or "", r["y"]))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", *, max_rows: int = 20_000, n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 20.0, ridge: float = 1.0) -> BoostedTrees:
    """Second-order boosting of logistic loss over quantile bins, on a bounded sample; suffix statistics count all labelled URLs. With no labelled rows, or one class only, no trees: the bias decides."""
    sums = suffix_sums(labelled, url, label)
    rows = sample_labelled(labelled, url, label, max_rows, sums)
    y = np.array([r["y"] for r in rows], dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    rate_of = (F.sum("s") + smooth * prior) / (F.sum("n") + smooth)
    table = sums.groupBy("suffix").agg(rate_of.alias("f_suffix_rate"), F.log1p(F.sum("n")).alias("f_suffix_count"))
    if not len(y) or y.min() == y.max():
        return BoostedTrees(-1.0 if not len(y) or y[0] == 0 else 1.0, (), table, prior)
    lexical = [f for f in FEATURES if not f.startswith("f_suffix")]
    x = np.empty((len(rows), len(FEATURES)))
    for i, r in enumerate(rows):
        # suffix statistics come from the other folds: with its own label in them, or it alone left out, a row gives itself away
        x[i] = [*(float(r[f]) for f in lexical), (r["s"] - r["s0"] + smooth * prior) / (r["n"] - r["n0"] + smooth), math.log1p(r["n"])]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    bias = math.log(prior / (1 - prior))
    margin = np.full(len(y), bias)
    trees = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)

        def grow(at: np.ndarray, level: int):
            g, h = grad[at].sum(), hess[at].sum()
            best = (1e-6, None)
            if level < depth:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, j], grad[at], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, j], hess[at], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, k))
            if best[1] is None:
                value = float(-rate * g / (h + ridge))
                margin[at] += value
                return value
            j, k = best[1]
            left = binned[at, j] <= k
            return (FEATURES[j], float(cuts[j][k]), grow(at[left], level + 1), grow(at[~left], level + 1))

        trees.append(grow(np.arange(len(y)), 0))
    return BoostedTrees(bias, tuple(trees), table, prior)


def margin_of(model: BoostedTrees) -> Column:
    def expression(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        f, at, left, right = node
        return F.when(F.col(f) <= at, expression(left)).otherwise(expression(right))

    total = F.lit(model.bias)
    for tree in model.trees:
        total = total + expression(tree)
    return total


def classify(pages: DataFrame, model: BoostedTrees, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule, score (the trees' log odds) and verdict; features are dropped."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    df = with_features(with_parts(pages.select(*own), url), url)
    # as many suffixes as the labelled URLs have: whether they are few enough to be sent is for the planner to measure
    df = df.join(model.suffixes, "suffix", "left").fillna({"f_suffix_rate": model.prior, "f_suffix_count": 0.0})
    rule, verdict = matching_rule(rules)
    df = df.withColumns({"rule": rule, "_by_rule": verdict, "score": margin_of(model)})
    judged = F.coalesce("_by_rule", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return df.select(*own, "host", "path", "rule", "score", judged.alias("verdict"))


def seed_labels(pages: DataFrame, url: str = "url", words: list[str] = SEED_WORDS) -> DataFrame:
    """(url, label): 1 where a hyphen-separated part of a host label is a seed word, else 0; null where there is no host."""
    part = "(^|[.-])(" + "|".join(words) + ")([.-]|$)"
    parts = with_parts(pages.select(F.col(url).alias("url")))
    return parts.select("url", F.when(F.col("host") != "", F.col("host").rlike(part).cast("int")).alias("label"))


RULES = [
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = fit(seed_labels(pages))
    return classify(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
