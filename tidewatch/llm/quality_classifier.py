"""Quality classifier: document evidence combined with site and path posteriors by hierarchical empirical Bayes.

A logistic model over native text measures gives each document a probability of good quality. Grouped
sums of those probabilities give each site a Beta posterior that is shrunk toward the global rate, and
each path of a site a posterior shrunk toward its site; the strengths of both priors come from the
moments of the groups. A document's final log-odds are its own plus its path's excess over the global
rate, so a sparse site says little and a well-known one more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, text_of, words
from .quality_rules import Measures, repeat_words

FEATURES = ("symbols", "capitals", "exclamations", "repeated_words", "repeated_lines", "word_length", "log_words")


def features(text: Column) -> list[Column]:
    m = Measures(text, ("n_words", "n_repeat_words"))
    share = lambda x, y: F.sqrt(F.least(F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0)), F.lit(1.0)))
    found = (
        share(m["n_symbols"], m["n_words"]),
        share(m["n_upper"], m["word_chars"]),
        share(m["n_exclamations"], m["n_words"]),
        share(m["n_repeat_words"], m["n_words"]),
        share(m["n_dup_lines"], m["n_lines"]),
        F.least(F.coalesce(F.try_divide(m["word_chars"].cast("double"), m["n_words"]), F.lit(0.0)), F.lit(20.0)) / 10,
        F.log1p(m["n_words"].cast("double")) / 10,
    )
    return [c.alias(name) for c, name in zip(found, FEATURES, strict=True)]


def measured(docs: DataFrame, site: Column, path: Column, column: str = "text", carry=()) -> DataFrame:
    """doc_id, site, path, the features and, if ``carry`` holds it, the row as ``_whole``; a null text counts as empty."""
    text = text_of(docs, column)
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return (
        docs.select("doc_id", *carry, F.coalesce(site.cast("string"), F.lit("\0")).alias("_site"), F.coalesce(path.cast("string"), F.lit("\0")).alias("_path"), text.alias("_text"), counted.alias("_counted"))
        .withColumns({"n_words": F.col("_counted.n"), "n_repeat_words": F.col("_counted.r")})
        .select("doc_id", *(["_whole"] if carry else []), "_site", "_path", *features(F.col("_text")))
    )


def fit(rows: DataFrame, labels: DataFrame, sample_rows: int = 5000, penalty: float = 0.5) -> list[float]:
    """Weights (intercept first) of a logistic model, from at most ``sample_rows`` labelled documents, the least by a hash of their id.

    Ids are picked from the labels alone, so no more than those rows travel; of rows that share an id one serves. Without labels of both
    classes all weights are zero but an intercept that keeps every document.
    """
    import numpy as np

    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("f")).orderBy("doc_id").select("quality", *(F.col("f")[c] for c in FEATURES)).collect()
    y = np.array([r[0] for r in sample], float)
    if not len(y) or y.min() == y.max():
        return [4.0, *[0.0] * len(FEATURES)]
    x = np.array([[1.0, *r[1:]] for r in sample])
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([0.0, *[1.0] * len(FEATURES)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]


def _strength(mean: float, groups: int, n: float, squares: float, between: float) -> float:
    """Prior strength of a Beta family by moments: ``between`` is the sum of n (rate - expected rate)^2 over groups."""
    within = mean * (1 - mean)
    spread = n - squares / n if n else 0.0
    excess = (between - (groups - 1) * within) / spread if spread > 0 else 0.0
    return min(max(within / excess - 1, 1.0), 1e6) if excess > 0 else 1e6


@dataclass
class Model:
    """Weights of the document model, and a posterior (site_rate, path_rate) for each of ``n_paths`` (site, path)."""

    weights: list[float]
    posteriors: DataFrame
    n_paths: int
    mean: float


def _odds(weights: list[float]) -> Column:
    odds = sum((F.lit(w) * F.col(name) for w, name in zip(weights[1:], FEATURES, strict=True)), F.lit(weights[0]))
    return F.greatest(F.least(odds, F.lit(12.0)), F.lit(-12.0))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def model(rows: DataFrame, labels: DataFrame, **fitting) -> Model:
    """The model of measured ``rows``. Groups are sums of document probabilities; a row of totals comes to the driver."""
    weights = fit(rows, labels, **fitting)
    scored = rows.select("_site", "_path", _probability(_odds(weights)).alias("_p"))
    paths = stored(scored.groupBy("_site", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("good")), "paths")
    sites = paths.groupBy("_site").agg(F.sum("n").alias("sn"), F.sum("good").alias("sgood"))
    total = sites.agg(F.sum("sn"), F.sum("sgood"), F.count("*"), F.sum(F.col("sn") * F.col("sn"))).first()
    n, mean, groups, squares = total[0] or 0, (total[1] / total[0] if total[0] else 0.5), total[2], total[3] or 0
    between = sites.agg(F.sum(F.col("sn") * F.pow(F.col("sgood") / F.col("sn") - mean, 2))).first()[0] or 0.0
    prior = _strength(mean, groups, n, squares, between)
    rate = (F.col("sgood") + prior * mean) / (F.col("sn") + prior)
    joined = paths.join(sites.select("_site", rate.alias("site_rate")), "_site")
    nested = joined.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("site_rate"), 2)), F.count("*"), F.sum(F.col("n") * F.col("n"))).first()
    inner = _strength(mean, max((nested[1] or 0) - groups + 1, 1), n, nested[2] or 0, nested[0] or 0.0)
    posteriors = joined.select("_site", "_path", "site_rate", ((F.col("good") + inner * F.col("site_rate")) / (F.col("n") + inner)).alias("path_rate"))
    return Model(weights, stored(posteriors, "posteriors"), nested[1] or 0, min(max(mean, 1e-6), 1 - 1e-6))


def score(rows: DataFrame, fitted: Model, threshold: float = 0.5, broadcast_paths: int = 50_000) -> DataFrame:
    """``rows`` (measured, with any other columns) with doc_score, site_rate, path_rate, score and kept.

    Posteriors are broadcast up to ``broadcast_paths`` of them and joined by a shuffle beyond.
    """
    posteriors = F.broadcast(fitted.posteriors) if fitted.n_paths <= broadcast_paths else fitted.posteriors
    path = F.greatest(F.least(F.col("path_rate"), F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = _odds(fitted.weights)
    final = _probability(odds + F.log(path / (1 - path)) - math.log(fitted.mean / (1 - fitted.mean)))
    return rows.join(posteriors, ["_site", "_path"]).withColumns({"doc_score": _probability(odds), "score": final, "kept": final >= threshold})


def classify(docs: DataFrame, labels: DataFrame, site: Column, path: Column, column: str = "text", threshold: float = 0.5, **fitting) -> DataFrame:
    """doc_id, doc_score (of the text alone), site_rate, path_rate, score and kept (score >= threshold).

    Null sites and paths are a group of their own, which they share with a site or path named by the one character U+0000; a null or empty text has no words and no marks, a very long one is measured whole. Labels serve
    the fit alone, in a bounded sample. Repeated rows are scored one by one, an empty table gives no rows, other columns are left out.
    """
    rows = stored(measured(docs, site, path, column), "measured")
    return score(rows, model(rows, labels, **fitting), threshold).select("doc_id", "doc_score", "site_rate", "path_rate", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, site: Column, path: Column, column: str = "text", threshold: float = 0.5, **fitting) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, whatever their names.

    Nulls, empty and very long texts and repeated rows are as in ``classify``; an empty table stays empty.
    Measures are computed again beside the text, which is cheaper than to shuffle texts by row.
    """
    fitted = model(stored(measured(docs, site, path, column), "measured"), labels, **fitting)
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_whole")
    return score(measured(docs, site, path, column, carry=(whole,)), fitted, threshold).where("kept").select("_whole.*")
