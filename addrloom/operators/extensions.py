"""Planned refinements around the cascade: richer scores, distances, review, accuracy, trained calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.operators import stages

# Weights of the seven terms, and the least confidence of each way of review.
TERMS = {"exact": 10.0, "fuzzy": 8.0, "hierarchy": 12.0, "order": 5.0, "geo": 6.0, "alias": 4.0, "popularity": 2.0}
REVIEW = (("auto_accept", 0.95), ("light_review", 0.80), ("review", 0.60))
EARTH_KM = 6371.0


def seven_terms(**terms: Column) -> Column:
    """The weighted sum of the terms given, each from 0 to 1; a missing or null one counts as 0."""
    if unknown := set(terms) - set(TERMS):
        raise ValueError(f"unknown terms: {sorted(unknown)}")
    out = F.lit(0.0)
    for name, weight in TERMS.items():
        if name in terms:
            out = out + F.coalesce(terms[name], F.lit(0.0)) * weight
    return out


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two places in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geo_penalty(km: Column, full_km: float = 50.0) -> Column:
    """0 at the place itself, 1 from ``full_km`` on; an unknown distance has none."""
    return F.coalesce(F.least(km / full_km, F.lit(1.0)), F.lit(0.0))


def review_route(confidence: Column) -> Column:
    out = None
    for name, least in REVIEW:
        out = F.when(confidence >= least, name) if out is None else out.when(confidence >= least, name)
    return out.otherwise("manual")


def ambiguous(top: Column, runner_up: Column, least_gap: float) -> Column:
    """Whether a case goes to a slower judge: its two best candidates are closer than the gap."""
    return runner_up.isNotNull() & (top - runner_up < least_gap)


def accuracy(results: DataFrame, gold: DataFrame, known: DataFrame) -> DataFrame:
    """One row of rates over the addresses in ``gold`` (addr_id, province_id, district_id, ward_id).

    ``results`` has the same columns with action. exact: all three agree; ward: the
    ward agrees; uncertainty_precision: of those not accepted, the share that is
    wrong; hallucination: the share with a ward that ``known`` (id) lacks.
    """
    pairs = gold.join(results.select("addr_id", "action", *[F.col(c).alias(f"p_{c}") for c in ("province_id", "district_id", "ward_id")]), "addr_id", "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"p_{c}"))
    exact = same("province_id") & same("district_id") & same("ward_id")
    pairs = pairs.join(known.select(F.col("id").alias("p_ward_id"), F.lit(True).alias("_known")).distinct(), "p_ward_id", "left")
    unsure = F.coalesce(F.col("action") != "auto_accept", F.lit(True))
    rate = lambda c: F.avg(c.cast("double"))
    invented = F.col("p_ward_id").isNotNull() & F.col("_known").isNull()
    return pairs.agg(F.count(F.lit(1)).alias("n"), rate(exact).alias("exact"), rate(same("ward_id")).alias("ward"), rate(F.when(unsure, ~exact)).alias("uncertainty_precision"), rate(invented).alias("hallucination"))


def explain(results: DataFrame) -> DataFrame:
    """(addr_id, explanation JSON): the chosen candidate's reasons and how far the next one is."""
    gap = F.col("top.score") - F.try_element_at("candidates", F.lit(2))["score"]
    body = F.struct("normalized", "era", "confidence", "action", F.col("top.reasons").alias("reasons"), F.bround(gap, 3).alias("gap"))
    return results.select("addr_id", F.to_json(body).alias("explanation"))


def to_label(results: DataFrame, n: int, edge: float = REVIEW[2][1]) -> DataFrame:
    """The ``n`` results that a label would teach most: those nearest the edge between review and manual work, the smaller addr_id first on ties."""
    return results.withColumn("distance", F.bround(F.abs(F.col("confidence") - edge), 6)).orderBy("distance", "addr_id").limit(n)


def candidate_graph(results: DataFrame) -> DataFrame:
    """(addr_id, from_id, to_id, level, weight) edges: from the address (null) to its candidates' provinces and on down, with the best score of those that use an edge."""
    each = results.select("addr_id", F.explode("candidates").alias("c"))
    steps, levels = [], ("province", "district", "ward")
    for k, level in enumerate(levels):
        up = F.coalesce(*[F.col(f"c.{x}.id") for x in reversed(levels[:k])], F.lit(None).cast("bigint"))
        steps.append(F.struct(up.alias("from_id"), F.col(f"c.{level}.id").alias("to_id"), F.lit(level).alias("level")))
    edges = each.select("addr_id", F.col("c.score").alias("score"), F.explode(F.array(*steps)).alias("e")).where("e.to_id IS NOT NULL")
    return edges.groupBy("addr_id", "e.from_id", "e.to_id", "e.level").agg(F.max("score").alias("weight"))


def calibrate(samples: DataFrame, features: list[str], label: str = "correct"):  # noqa: ANN201
    """A logistic model of being right by numeric features, fitted over all samples; ``transform`` adds probability.

    The model is read back from the shared folder: a fitted one holds a summary of its
    training, and by it the session, which no task can take once a query was observed.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label, maxIter=50)]).fit(samples)
    path = f"{stages.shared_folder(samples.sparkSession)}/{fitted.uid}"
    fitted.save(path)
    return PipelineModel.load(path)
