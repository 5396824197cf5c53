"""How far confidence can be trusted: rates by bins of the score, an increasing fit to them, and its error.

Scores from 0 to 1 fall into equal bins, counted by Spark over all samples; what is
fitted is one row for each bin, whatever the number of samples. Rows with a null score
or label take no part; scores outside 0 to 1 count in the first or last bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 100
MOST_BINS = 10_000


def bin_of(score: Column, bins: int = BINS) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(score * bins), F.lit(bins - 1))).cast("int")


def binned(samples: DataFrame, score: str = "confidence", label: str = "correct", bins: int = BINS) -> DataFrame:
    """(bin, n, right, score): samples, right ones, and mean score of each bin that has samples."""
    if not 1 <= bins <= MOST_BINS:
        raise ValueError(f"bins must lie between 1 and {MOST_BINS}")
    rows = samples.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    right = F.sum(F.col(label).cast("int")).alias("right")
    return rows.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), right, F.avg(F.col(score).cast("double")).alias("score"))


def pooled(right: list[int], n: list[int]) -> list[float]:
    """The increasing rates nearest to right / n by weighted squares: neighbours out of order are pooled until none are."""
    blocks: list[list[int]] = []
    for r, m in zip(right, n):
        blocks.append([r, m, 1])
        # Rates are compared as whole numbers, so equal ones are equal.
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [r / m for r, m, size in blocks for _ in range(size)]


def isotonic(counts: DataFrame) -> DataFrame:
    """``binned`` rows with ``fitted``, by pool adjacent violators. They are at most MOST_BINS rows, and one task fits them."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (held := list(parts)):
            return
        rows = pd.concat(held, ignore_index=True).sort_values("bin")
        rows["fitted"] = pooled([int(r) for r in rows["right"]], [int(n) for n in rows["n"]])
        yield rows

    schema = "bin int, n long, right long, score double"
    typed = counts.select("bin", F.col("n").cast("long"), F.col("right").cast("long"), "score")
    return typed.repartition(1).mapInPandas(fit, f"{schema}, fitted double")


def calibrated(rows: DataFrame, fitted: DataFrame, score: str = "confidence", bins: int = BINS) -> DataFrame:
    """``rows`` with ``probability``: the fitted rate of the score's bin, or of the next lower bin with samples, else the next higher; null without a score."""
    spark = rows.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("_bin"))
    table = every.join(fitted.select(F.col("bin").alias("_bin"), "fitted"), "_bin", "left")
    one = Window.orderBy("_bin")
    lower, higher = F.last("fitted", True).over(one), F.first("fitted", True).over(one.rowsBetween(0, Window.unboundedFollowing))
    table = table.select("_bin", F.coalesce(lower, higher).alias("probability"))
    # One row for each bin, MOST_BINS at most.
    known = F.when(F.col(score).isNotNull() & ~F.isnan(score), bin_of(F.col(score), bins))
    return rows.withColumn("_bin", known).join(F.broadcast(table), "_bin", "left").select(*rows.columns, "probability")


def report(fitted: DataFrame) -> DataFrame:
    """(n, error_before, error_after): the expected calibration error of the mean score, and of the fit, over the bins."""
    share = lambda c: (F.sum(F.col("n") * F.abs(F.col("right") / F.col("n") - F.col(c))) / F.sum("n"))
    return fitted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), share("score").alias("error_before"), share("fitted").alias("error_after"))
