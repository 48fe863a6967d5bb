"""Quality classifier with hierarchical empirical Bayes priors of sites.

A logistic model over a few text measures gives each document its own evidence. Documents of one
host, and of one path (section) of a host, share a prior: grouped sums of the document probabilities give every
host and path a mean, and means of sparse sites are shrunk, paths toward their host and hosts toward
the corpus. How strongly is estimated from the data (between-site against within-site variance). A document's posterior
odds are its evidence times the prior odds of its path, with the document itself left out of
the sums, so nothing counts twice.

The model is fitted on a sample of labelled rows bounded by ``sample_rows``; site statistics and scores cover all
documents. Only single rows of sums and the bounded sample reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import NOT_SPACE, stored, words

SAMPLE_ROWS = 20_000
RIDGE = 1e-3
LEAST_SCORE = 0.5
_EDGE = 1e-6

_MEASURES = ("length", "word_length", "distinct", "upper", "symbols", "marks", "digits", "echoes", "copied_lines")


def with_measures(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` plus one numeric array ``x``: shares and logarithms of the whole text, all row-local."""
    names = rows.columns
    body = F.coalesce(F.col(text), F.lit(""))
    split = rows.select("*", body.alias("_body")).select("*", words(F.col("_body")).alias("_words"))
    size = lambda pattern: F.length("_body") - F.length(F.regexp_replace("_body", pattern, ""))
    counted = split.select(
        *names,
        F.size("_words").alias("_n"),
        F.greatest(F.length("_body"), F.lit(1)).alias("_chars"),
        F.length(F.array_join("_words", "")).alias("_inside"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        size(r"\p{Lu}+").alias("_upper"),
        size(r"[#*$%&|<>@^~=_\\{}]+").alias("_symbols"),
        size(r"[!?]+").alias("_marks"),
        size(r"\p{Nd}+").alias("_digits"),
        F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).alias("_echoes"),
        F.filter(F.split("_body", "\n"), lambda line: line.rlike(NOT_SPACE)).alias("_lines"),
    )
    n, chars = F.greatest(F.col("_n"), F.lit(1)), F.col("_chars")
    lines = F.greatest(F.size("_lines"), F.lit(1))
    return counted.select(
        *names,
        F.array(
            F.log1p(F.col("_n").cast("double")),
            F.col("_inside") / n,
            F.col("_distinct") / F.sqrt(n),
            F.col("_upper") / chars,
            F.sqrt(F.col("_symbols") / chars),
            F.sqrt(F.col("_marks") / chars),
            F.col("_digits") / chars,
            F.col("_echoes") / n,
            (F.size("_lines") - F.size(F.array_distinct("_lines"))) / lines,
        ).alias("x"),
    )


@dataclass(frozen=True)
class Model:
    """Log odds of quality: ``intercept + weights . x``; ``prior`` is the share of good rows it was fitted at."""

    intercept: float
    weights: tuple[float, ...]
    prior: float

    def log_odds(self, x: str) -> Column:
        total = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            total = total + F.get(x, F.lit(i)) * F.lit(w)
        return total


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge-regularised logistic regression by Newton steps on standardised measures."""
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0, (0.0,) * len(_MEASURES), 0.5)  # nothing to tell apart: every document is neutral
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.c_[np.ones(len(y)), np.clip((x - mean) / scale, -8, 8)]
    beta = np.zeros(z.shape[1])
    ridge = RIDGE * len(y) * np.r_[0, np.ones(z.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - ridge * beta
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[1:] / scale
    return Model(float(beta[0] - weights @ mean), tuple(weights.tolist()), float(y.mean()))


def fit_labels(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled documents whose id's hash falls below the cut that leaves about ``sample_rows``."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    cut = int(1e6 * min(1.0, sample_rows / max(1, known.count())))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # sample_rows ids
    measured = with_measures(rows.select("text", "y").limit(2 * sample_rows), "text").select("x", "y").collect()
    x = np.array([r["x"] for r in measured], dtype=float).reshape(-1, len(_MEASURES))
    return fit(x, np.array([r["y"] >= 0.5 for r in measured], dtype=float))


def _strength(within: float, between: float, groups: int, rows: float, squares: float) -> float:
    """Prior weight, in documents, of a parent's mean (one-way analysis of variance by moments)."""
    if groups < 2 or rows <= groups:
        return 1.0
    spread_within = max(within, 0.0) / (rows - groups)
    typical = (rows - squares / rows) / (groups - 1)
    spread_between = (between / (groups - 1) - spread_within) / max(typical, 1e-9)
    return 1e9 if spread_between <= 1e-12 else min(1e9, max(1.0, spread_within / spread_between))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Sums per (``host``, ``path``) with their host's sums, the corpus mean, and both prior strengths.

    ``scored`` has ``host``, ``path`` and ``p``.
    """
    paths = scored.groupBy("host", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
    )
    hosts = paths.groupBy(F.col("host").alias("of")).agg(
        F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count("*").alias("host_paths")
    )
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["of"])).drop("of", "host_paths")
    sites = stored(sites, "sites")
    mean, mean_host = F.col("s") / F.col("n"), F.col("host_s") / F.col("host_n")
    by_path = sites.agg(
        F.sum("n").alias("rows"),
        F.sum("s").alias("good"),
        F.count("*").alias("paths"),
        F.sum(F.col("q") - F.col("n") * mean * mean).alias("within"),
        F.sum(F.col("n") * (mean - mean_host) * (mean - mean_host)).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not by_path["rows"]:
        return sites, 0.5, 1.0, 1.0
    mu = by_path["good"] / by_path["rows"]
    by_host = (
        sites.groupBy("host", "host_n", "host_s")
        .agg(F.sum("q").alias("q"))
        .agg(
            F.count("*").alias("hosts"),
            F.sum(F.col("q") - F.col("host_n") * mean_host * mean_host).alias("within"),
            F.sum(F.col("host_n") * (mean_host - mu) * (mean_host - mu)).alias("between"),
            F.sum(F.col("host_n") * F.col("host_n")).alias("squares"),
        )
        .first()
    )
    host_strength = _strength(by_host["within"], by_host["between"], by_host["hosts"], by_path["rows"], by_host["squares"])
    path_strength = _strength(by_path["within"], by_path["between"], by_path["paths"], by_path["rows"], by_path["squares"])
    return sites, mu, host_strength, path_strength


def _logit(p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(kept / (1 - kept))


def with_posteriors(scored: DataFrame, prior: float) -> DataFrame:
    """``scored`` (``host``, ``path``, ``z``, ``p`` and more) plus ``host_posterior``, ``path_posterior`` and ``score``."""
    sites, mu, host_strength, path_strength = site_posteriors(scored)
    sites = sites.select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", "s", "host_n", "host_s"
    )
    joined = scored.join(
        sites, scored["host"].eqNullSafe(sites["of_host"]) & scored["path"].eqNullSafe(sites["of_path"])
    )
    host = (F.lit(host_strength * mu) + F.col("host_s") - F.col("p")) / (F.lit(host_strength) + F.col("host_n") - 1)
    path = (F.lit(path_strength) * F.col("host_posterior") + F.col("s") - F.col("p")) / (
        F.lit(path_strength) + F.col("n") - 1
    )
    odds = F.col("z") - _logit(F.lit(prior)) + _logit(F.col("path_posterior"))
    return (
        joined.withColumn("host_posterior", host)
        .withColumn("path_posterior", path)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .select(*scored.columns, "host_posterior", "path_posterior", "score")
    )


def scored_rows(docs: DataFrame, model: Model, carry: Column, text: str, host: str, path: str) -> DataFrame:
    """``row`` (``carry``), ``host``, ``path``, ``z`` and ``p`` of every document, stored."""
    rows = docs.select(
        carry.alias("row"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("_text")
    )
    measured = with_measures(rows, "_text").select("row", "host", "path", model.log_odds("x").alias("z"))
    return stored(measured.withColumn("p", 1 / (1 + F.exp(-F.col("z")))), "document-evidence")


def document_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document with its evidence, site posteriors, score and verdict.

    A null or empty text is measured as zero words; null hosts and paths are sites of their own; repeated rows
    are scored alike; without labels of both kinds every document is neutral and kept; an empty table gives no
    rows. Other columns are not read.
    """
    model = fit_labels(docs, labels, text, sample_rows)
    scored = scored_rows(docs, model, F.struct("doc_id"), text, host, path)
    judged = with_posteriors(scored, model.prior)
    return judged.select(
        "row.doc_id",
        F.col("host").alias("source"),
        F.col("path").alias("lang"),
        F.col("p").alias("evidence"),
        "host_posterior",
        "path_posterior",
        "score",
        (F.col("score") >= LEAST_SCORE).alias("kept"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    model = fit_labels(docs, labels, text)
    scored = scored_rows(docs, model, F.struct("*"), text, host, path)
    return with_posteriors(scored, model.prior).filter(F.col("score") >= LEAST_SCORE).select("row.*")
