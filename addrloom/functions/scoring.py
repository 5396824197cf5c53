"""Scores, reasons and calibrated confidence of candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dicts


def candidate_score(province: Column, district: Column, ward: Column) -> Column:
    """From the levels' similarities (null where a level is missing), to three places."""
    total = F.coalesce(province * dicts.W_PROVINCE, F.lit(0.0))
    total = total + F.coalesce(district * dicts.W_DISTRICT + dicts.BONUS_DISTRICT, F.lit(0.0))
    return F.bround(total + F.coalesce(ward * dicts.W_WARD + dicts.BONUS_WARD, F.lit(0.0)), 3)


def reason(level: str, name: Column, score: Column) -> Column:
    return F.when(name.isNotNull(), F.concat(F.lit(f"{level}="), name, F.lit(" ("), F.format_string("%.2f", F.bround(score, 2)), F.lit(")")))


def depth(*levels: Column) -> Column:
    out = F.lit(0)
    for x in levels:
        out = out + x.isNotNull().cast("int")
    return out


def confidence(score: Column, runner_up: Column, levels: Column, era: Column) -> Column:
    """Null score: 0. A close runner-up and missing levels lower it."""
    post = era == "post_merger"
    most = F.when(post, dicts.MAX_SCORE["post_merger"]).otherwise(dicts.MAX_SCORE["pre_merger"])
    raw = F.least(score / most, F.lit(1.0))
    raw = raw * F.when(runner_up.isNotNull() & (score - runner_up < dicts.CLOSE_GAP), 0.85).otherwise(1.0)
    raw = raw * F.when(levels == 1, 0.70).when(levels < F.when(post, 2).otherwise(3), 0.88).otherwise(1.0)
    return F.coalesce(F.bround(F.least(raw, F.lit(1.0)), 3), F.lit(0.0))


def action(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "auto_accept").when(confidence >= 0.60, "review").otherwise("low_confidence")


def era_of(as_of: Column) -> Column:
    return F.when(as_of >= F.lit(dicts.MERGER_DATE), "post_merger").otherwise("pre_merger")
