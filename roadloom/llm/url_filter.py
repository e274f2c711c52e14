"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import lower_ascii

#: Hashed features, lengths of n-grams, and rows of the labelled table that the fit uses at most.
BUCKETS, GRAMS, MAX_LABELLED = 1 << 16, (2, 3, 4, 5, 6), 4096


@dataclass(frozen=True)
class UrlRule:
    """``block`` or ``allow`` for a host with all its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does. Equal lengths: the longer host, then the
    smaller text. The rules are tried longest first in one CASE, so a row stops at its rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    parts = []
    for n in GRAMS:
        last = F.length(framed) - n + 1
        parts.append(F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds ``grams`` and ``features`` to rows with ``host`` and ``path``."""
    rows = urls.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(rows)


def fit_urls(labelled: DataFrame, max_labelled: int = MAX_LABELLED):
    """A model from a small table (host, path, blocked 0/1): at most ``max_labelled`` distinct rows, those of smallest
    hash. None if the table does not have both classes."""
    rows = labelled.select("host", "path", F.col("blocked").cast("double").alias("label")).where("label is not null").distinct()
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_labelled)
    rows = with_features(rows.repartition(4, "host", "path")).select("features", "label").cache()
    try:
        if len(rows.select("label").distinct().take(2)) < 2:
            return None
        return LogisticRegression(maxIter=30, regParam=0.001, aggregationDepth=2).fit(rows)
    finally:
        rows.unpersist()


def url_filter(pages: DataFrame, rules: Sequence[UrlRule], labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of ``pages`` (page_id, url, any others).

    The verdict is the rule's, else ``block`` where the model gives a probability of at least one half; score is that
    probability. Null URLs and such without ``://`` have an empty host and path and are judged by the model. Without a
    model all of those are allowed, with a null score. Repeated rows are judged alike. Nothing is shuffled but the
    bounded labelled table; the model is a fixed 2^16 numbers.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    model = fit_urls(labelled, max_labelled)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    if model is None:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(with_features(rows)).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def rule_labelled(pages: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """A labelled table (host, path, blocked) from the URLs that the rules decide."""
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    _, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("verdict", verdict).where("verdict is not null").select("host", "path", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocked"))
