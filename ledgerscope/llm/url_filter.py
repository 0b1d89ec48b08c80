"""URL filter: rules first, gradient-boosted trees over lexical features for the rest.

A rule names a host with all its subdomains and a path prefix; the longest that fits decides. Other URLs are judged by
boosted trees over lengths, depth, digit share, character entropy, counts of parameters, hyphens and dots, and
statistics of the host's suffix: its share of blocked and number of labelled URLs, smoothed towards the overall share.

Labels come from the URLs themselves: a host with one of ``SEED_TERMS`` is to be blocked, any other allowed; the terms are
not among the features. The trees are trained on a bounded sample, the ``SAMPLE`` labelled URLs with the smallest
hashes, which also has the suffix statistics, so the table of suffixes is no longer than the sample and can be
broadcast. A training row gets the statistics of the other ``FOLDS - 1`` folds of the sample, so its own label is not among its features.
Every URL is judged.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; the trees judge it by
its features. An empty table gives an empty table; when the sample has one class only, the verdict is allow. Repeated rows get
equal verdicts. Input columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import ascii_lower, let, table, without


@dataclass(frozen=True)
class Rule:
    """``name`` is what the verdict cites: the host without the common domain, and the path."""

    verdict: str
    host: str
    path: str
    name: str


#: Production rules.
RULES = (
    Rule("allow", "org", "/", "org/"),
    Rule("block", "example.org", "/es/", "example.org/es/"),
    Rule("block", "example.org", "/en/1", "example.org/en/1"),
    Rule("allow", "com", "/fr/", "com/fr/"),
    Rule("block", "com", "/de/", "com/de/"),
)
SEED_TERMS = ("casino", "pills", "bets", "spam", "porn", "viagra", "lottery", "track")
SAMPLE = 10_000
SMOOTHING = 20.0
FOLDS = 5
#: How many times the sample the rows below the bound are, at the estimated number of different URLs.
SPARE = 3
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digits", "digit_share", "entropy", "host_entropy", "parameters",
    "hyphens", "host_hyphens", "dots", "fragment", "suffix_share", "suffix_count",
)
RESULTS = ("host", "path", "rule", "verdict", "block_score")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as (name, verdict); null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""

    def of(chars: Column) -> Column:
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(chars) - F.size(F.array_remove(chars, c)))
        n = F.size(chars)
        total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double")))
        return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))

    return let(F.split(text, ""), of)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame, url_col: str, host_col: str, path_col: str) -> DataFrame:
    """Add the features that depend on the URL alone."""
    url, host, path = F.coalesce(url_col, F.lit("")), F.col(host_col), F.col(path_col)
    count = lambda text, cls: F.regexp_count(text, F.lit(cls))
    return urls.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host),
            "path_length": F.length(path),
            "depth": count(path, "/+[^/]"),
            "digits": count(url, "[0-9]"),
            "digit_share": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "entropy": entropy(url),
            "host_entropy": entropy(host),
            "parameters": count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[^&;]+"),
            "hyphens": count(url, "-"),
            "host_hyphens": count(host, "-"),
            "dots": count(host, "[.]"),
            "fragment": count(url, "#"),
        }
    )


def label(host: Column) -> Column:
    """1 for hosts with a seed term, else 0."""
    return host.rlike("|".join(SEED_TERMS)).cast("double")


@dataclass(frozen=True)
class UrlModel:
    """Fitted trees, suffix statistics of the sample, and the overall share of blocked URLs."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    share: float


def _with_suffix(features: DataFrame, suffixes: DataFrame, share: float, host_col: str, *also: str) -> DataFrame:
    known = F.broadcast(suffixes)  # as many rows as the sample at most
    return (
        features.withColumn("_uf_suffix", suffix(F.col(host_col)))
        .join(known, ["_uf_suffix", *also], "left")
        .withColumns(
            {
                "suffix_share": (F.coalesce("_uf_blocked", F.lit(0.0)) + F.lit(SMOOTHING * share))
                / (F.coalesce("_uf_seen", F.lit(0)) + F.lit(SMOOTHING)),
                "suffix_count": F.log1p(F.coalesce("_uf_seen", F.lit(0)).cast("double")),
            }
        )
    )


def _out_of_fold(features: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    """Training rows with the suffix statistics of the rows of other folds."""
    by_fold = features.groupBy(suffix(F.col("_uf_host")).alias("_uf_suffix"), "_uf_fold").agg(
        F.sum("label").alias("_uf_own_blocked"), F.count(F.lit(1)).alias("_uf_own_seen")
    )
    others = by_fold.join(suffixes, "_uf_suffix").select(
        "_uf_suffix",
        "_uf_fold",
        (F.col("_uf_blocked") - F.col("_uf_own_blocked")).alias("_uf_blocked"),
        (F.col("_uf_seen") - F.col("_uf_own_seen")).alias("_uf_seen"),
    )
    return _with_suffix(features, others, share, "_uf_host", "_uf_fold")


def fit(urls: DataFrame, url_col: str = "url", sample: int = SAMPLE) -> UrlModel:
    """Train on the ``sample`` distinct labelled URLs with the smallest hashes."""
    host, path = split_url(F.col("_uf_url"))
    known = urls.select(F.col(url_col).alias("_uf_url")).where(F.col("_uf_url").contains("://"))
    # Only hashes below a bound take part in the choice, so that few rows meet in it however many URLs there are.
    different = known.agg(F.approx_count_distinct("_uf_url")).first()[0]
    bound = min(1.0, SPARE * sample / max(different, 1))
    draw = F.shiftrightunsigned(F.xxhash64("_uf_url"), 1)
    labelled = (
        known.where(draw <= F.lit(min(int(bound * (1 << 63)), (1 << 63) - 1)))
        .distinct()
        .orderBy(draw, "_uf_url")
        .limit(sample)
        .select("_uf_url", host.alias("_uf_host"), path.alias("_uf_path"))
    )
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_uf_url"), F.lit(FOLDS))
    labelled = labelled.withColumns({"label": label(F.col("_uf_host")), "_uf_fold": fold}).checkpoint()
    share = labelled.agg(F.avg("label")).first()[0]
    suffixes = (
        labelled.groupBy(suffix(F.col("_uf_host")).alias("_uf_suffix"))
        .agg(F.sum("label").alias("_uf_blocked"), F.count(F.lit(1)).alias("_uf_seen"))
        .checkpoint()
    )
    if share is None or share in (0.0, 1.0):
        return UrlModel(None, suffixes, share or 0.0)
    features = _out_of_fold(lexical(labelled, "_uf_url", "_uf_host", "_uf_path"), suffixes, share)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7, subsamplingRate=1.0)
    return UrlModel(trees.fit(vector.transform(features).select("features", "label").checkpoint()), suffixes, share)


def filter_urls(
    urls: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None
) -> DataFrame:
    """All rows with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``, the trees' probability of block."""
    model = model or fit(urls, url_col)
    own = [F.col(c) for c in without(urls, *RESULTS).columns]
    host, path = split_url(F.col(url_col))
    split = urls.select(F.struct(*own).alias("_uf_row"), F.col(url_col).alias("_uf_url"), host.alias("host"), path.alias("path"))
    split = split.withColumn("_uf_rule", best_rule(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        scored = split.withColumn("block_score", F.lit(0.0))
    else:
        features = _with_suffix(lexical(split, "_uf_url", "host", "path"), model.suffixes, model.share, "host")
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        scored = model.trees.transform(vector.transform(features)).withColumn(
            "block_score", vector_to_array("probability")[1]
        )
    judged = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "_uf_row.*",
        "host",
        "path",
        F.col("_uf_rule.name").alias("rule"),
        F.coalesce("_uf_rule.verdict", judged).alias("verdict"),
        "block_score",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
