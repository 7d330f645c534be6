"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, bounded_sample, fit_trees
from .common import materialise, table

#: (verdict, host, path). A rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Labelled urls that the trees are fitted on at most.
TRAIN_ROWS = 20_000
#: Suffixes with the most urls, whose statistics are broadcast; the others' are joined by shuffles.
MANY = 20_000
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "label_length", "odd_ratio", "fragment", "top_rate", "site_rate", "site_seen"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without :// or url."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule_ (text of the longest rule that fits, else null) and rule_verdict_ to df with host and path."""
    rule = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule_", rule).withColumn("rule_verdict_", verdict)


def with_suffixes(df: DataFrame) -> DataFrame:
    """Adds top_ and site_ to df with host: the top-level label and the last two labels."""
    return df.withColumn("top_", F.substring_index("host", ".", -1)).withColumn("site_", F.substring_index("host", ".", -2))


def suffix_counts(urls: DataFrame) -> DataFrame:
    """suffix, rows, allowed_0, labelled_0, allowed_1, labelled_1: of all urls under each suffix, those labelled and those
    allowed among them, in each half_ of the urls. urls: top_, site_, half_, and allowed, which is null without a label."""
    under = urls.select(F.explode(F.array_distinct(F.array("top_", "site_"))).alias("suffix"), "half_", "allowed")
    sums = [f(F.when(F.col("half_") == k, F.col("allowed").cast("int"))).alias(f"{name}_{k}") for k in (0, 1) for f, name in ((F.sum, "allowed"), (F.count, "labelled"))]
    return under.groupBy("suffix").agg(F.count("*").alias("rows"), *sums).na.fill(0)


def with_counts(urls: DataFrame, counts: DataFrame, of: str) -> DataFrame:
    """Adds to each row of urls the counts of the suffix in column `of`_ (top or site), as a struct named `of`. Suffixes with
    very many urls come by a broadcast of MANY rows, so that none fills one task of the join."""
    packed = counts.select(F.col("suffix").alias(f"{of}_"), "rows", F.struct(*[c for c in counts.columns if c not in ("suffix", "rows")]).alias(of))
    many = packed.orderBy(F.desc("rows"), f"{of}_").limit(MANY).drop("rows")
    few = packed.drop("rows").join(F.broadcast(many.select(f"{of}_")), f"{of}_", "left_anti")
    rest = urls.join(F.broadcast(many.select(f"{of}_")), f"{of}_", "left_anti").join(few, f"{of}_")
    return urls.join(F.broadcast(many), f"{of}_").unionByName(rest)


def features(urls: list[str], hosts: list[str], paths: list[str], seen: np.ndarray, rate: float) -> np.ndarray:
    """FEATURES of each url. seen: of its top-level label and of its site, how many labelled urls are allowed and how many there are, in logs for site_seen."""
    rows = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        n = max(1, len(url))
        counts = np.array(list(Counter(url).values()) or [1])
        digits, odd = sum(map(url.count, "0123456789")), n - sum(x.isalnum() or x in "/.:-" for x in url)
        query = url.partition("#")[0].partition("?")[2]
        labels = host.split(".")
        top_allowed, top_seen, site_allowed, site_seen = seen[i]
        rows[i] = (
            len(url), len(host), len(path), path.count("/"), digits / n, -(counts / n * np.log2(counts / n)).sum(), query.count("&") + 1 if query else 0,
            url.count("-"), len(labels), max(map(len, labels)), odd / n, "#" in url, (top_allowed + 4 * rate) / (top_seen + 4), (site_allowed + 4 * rate) / (site_seen + 4), np.log1p(site_seen),
        )
    return rows


def fit(labelled: DataFrame, counts: DataFrame, rate: float) -> Trees:
    """Trees from url, host, path, allowed, top_, site_, half_: at most TRAIN_ROWS different urls."""
    sample = bounded_sample(labelled, "url", TRAIN_ROWS).select("url", "host", "path", "allowed", "top_", "site_", "half_")
    sample = with_counts(with_counts(sample, counts, "top"), counts, "site")
    # a url's own label must not be in the counts that it learns from: each half takes the other's, twice for the size of both
    other = lambda c: (F.when(F.col("half_") == 0, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")) * 2).alias(c.replace(".", "_"))
    names = ["top.allowed", "top.labelled", "site.allowed", "site.labelled"]
    pdf = sample.select("url", "host", "path", "allowed", *map(other, names)).toPandas().sort_values("url", kind="stable")
    y = pdf["allowed"].to_numpy(dtype=float)
    x = features(pdf["url"].tolist(), pdf["host"].tolist(), pdf["path"].tolist(), pdf[[n.replace(".", "_") for n in names]].to_numpy(dtype=float), rate)
    if not len(pdf):
        x, y = np.zeros((1, len(FEATURES))), np.ones(1)
    return fit_trees(x, y)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages (page_id, url).

    The rule's verdict, or where no rule fits the trees' (allow from 0.5), which learn from the urls that rules label. A
    null url, or one without ://, has an empty host and path. Without labelled urls, or with labels of one kind, the score
    is the smoothed share of allowed ones. Repeated rows stay; other columns are ignored.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = with_rules(rows, rules)
    rows = with_suffixes(rows).withColumn("half_", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2))).withColumn("allowed", F.col("rule_verdict_") == "allow")
    counts = materialise(suffix_counts(rows), "url-suffixes")
    share = rows.agg(F.avg(F.col("allowed").cast("int"))).first()[0]
    rate = 0.5 if share is None else share
    model = fit(rows.filter("rule_ is not null"), counts, rate)

    @F.pandas_udf("double")
    def score(url: pd.Series, host: pd.Series, path: pd.Series, top_allowed: pd.Series, top_seen: pd.Series, site_allowed: pd.Series, site_seen: pd.Series) -> pd.Series:
        seen = np.stack([top_allowed, top_seen, site_allowed, site_seen], 1).astype(float)
        return pd.Series(model.score(features(url.tolist(), host.tolist(), path.tolist(), seen, rate)))

    rows = with_counts(with_counts(rows, counts, "top"), counts, "site")
    both = [F.col(f"{c}_0") + F.col(f"{c}_1") for c in ("top.allowed", "top.labelled", "site.allowed", "site.labelled")]
    rows = rows.withColumn("score", score("url", "host", "path", *both))
    verdict = F.coalesce("rule_verdict_", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", F.col("rule_").alias("rule"), verdict.alias("verdict"), "score")


def op9_url_trees(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
