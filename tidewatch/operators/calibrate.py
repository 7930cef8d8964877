"""Percentile calibration of detector thresholds, exact at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .once import once

#: Ranks that the sketch tells, to one part in this many.
ACCURACY = 10_000


def percentiles(df: DataFrame, value: Column, probabilities=(0.9, 0.95, 0.99), by=(), accuracy: int = ACCURACY) -> DataFrame:
    """A column pNN per probability (linear interpolation, rounded to 6 places) and n, by the columns ``by``; nulls don't count.

    Exact by range. A mergeable sketch, whose ranks are off by one part in ``accuracy`` at most, brackets each percentile between two
    values; one pass counts the rows below each bracket and, by value, those inside; the wanted ranks are then found among the few values
    inside. No task holds the distinct values of a group.
    """
    by = list(by)
    names = [f"p{int(round(p * 100)):02d}" for p in probabilities]
    rows = once(df.select(*by, value.cast("double").alias("_v")).where("_v is not null"))
    margin = 3.0 / accuracy
    edges = [F.array(*(F.lit(min(max(p + d, 0.0), 1.0)) for p in probabilities)) for d in (-margin, margin)]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), *(F.percentile_approx("_v", e, accuracy).alias(c) for e, c in zip(edges, ("_lows", "_highs"), strict=True))
    )
    brackets = sketch.select(*by, "n", F.posexplode(F.arrays_zip("_lows", "_highs")).alias("_i", "_e"), "_min", "_max")
    p = F.get(F.array(*map(F.lit, probabilities)), F.col("_i"))
    few = F.col("n") <= accuracy  # then the bracket is the whole range
    low = F.when(few | (p <= margin), F.col("_min")).otherwise(F.col("_e")["_lows"])
    high = F.when(few | (p >= 1 - margin), F.col("_max")).otherwise(F.col("_e")["_highs"])
    brackets = brackets.select(*by, "n", "_i", p.alias("_p"), low.alias("_low"), high.alias("_high"))
    # A row per group and percentile: small unless there are many groups, in which case the join shuffles by group.
    met = rows.join(brackets, by) if by else rows.crossJoin(F.broadcast(brackets))
    met = met.where("_v <= _high").groupBy(*by, "_i", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("n").alias("n"), F.first("_p").alias("_p"))
    w = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first())
    met = met.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("_p") * (F.col("n") - 1)
    first, second = F.floor(rank), F.ceil(rank)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.struct(F.col("_upto"), F.col("_v"))))["_v"]
    found = met.groupBy(*by, "_i").agg(F.first("n").alias("n"), at(first).alias("_a"), at(second).alias("_b"), F.first(rank - first).alias("_f"))
    exact = F.when(F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "a percentile lies outside its bracket").isNull(), F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    wide = found.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("_i") == i, exact)).alias(name) for i, name in enumerate(names)))
    if not by:  # a row of nulls where there are no values
        wide = wide.groupBy().agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"), *(F.max(name).alias(name) for name in names))
    return wide.select(*by, *(F.round(name, 6).alias(name) for name in names), "n")
