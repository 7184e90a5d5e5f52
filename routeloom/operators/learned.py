"""Learned edge scores: matched pairs, a boosted model with a calibration, and its gates."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .corpus import split_groups
from .frontier import seeded

#: A control that must be at chance may stray this far.
TOLERANCE = 0.05


def capped(rows: DataFrame, rule: str, cap: int, seed: int, *ids: str) -> DataFrame:
    """At most ``cap`` uses of each rule, by a seeded order: no use depends on the rows before it."""
    order = Window.partitionBy(rule).orderBy(seeded(seed, rule, *ids), *ids)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def matched_pairs(left: DataFrame, right: DataFrame, on: list[str], one_per: list[str], seed: int = 0, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """One seeded draw of a (left, right) pair that agrees in ``on`` for each group of ``one_per``.

    Each side is drawn before the join, so a large group never meets itself.
    """
    pick = lambda df, c: df.groupBy(*dict.fromkeys(on + one_per)).agg(F.min_by(c, F.struct(seeded(seed, *on, c).alias("k"), F.col(c))).alias(c))
    both = pick(left, left_id).join(pick(right, right_id), list(dict.fromkeys(on + one_per)))
    key = F.struct(seeded(seed, *on, left_id, right_id).alias("k"), *on)
    return both.groupBy(*one_per).agg(F.min_by(F.struct(*(c for c in both.columns if c not in one_per)), key).alias("x")).select(*one_per, "x.*")


def attested_and_others(rows: DataFrame, per_attested: int, seed: int) -> DataFrame:
    """Within each rule, all attested rows and at most ``per_attested`` times as many others (rule, id, attested)."""
    counts = rows.groupBy("rule").agg(F.count_if("attested").alias("n"))
    order = Window.partitionBy("rule", "attested").orderBy(seeded(seed, "rule", "id"), "id")
    ranked = rows.join(counts, "rule").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("attested") | (F.col("place") <= per_attested * F.col("n"))).drop("n", "place")


def difference_features(before: Column, after: Column, size: int) -> Column:
    """The features of an edge: counts of its substrate, of its product, and the second minus the first (3 * size doubles).

    Both are maps of coordinate to count; null if either is, so that such an edge gets the fallback.
    """
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double"))
    change = F.zip_with(dense(after), dense(before), lambda a, b: a - b)
    return F.when(before.isNotNull() & after.isNotNull(), F.concat(dense(before), dense(after), change))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, numBins=0).evaluate(scored)


def gate(controls: dict[str, float], slope: float) -> None:
    """Refuses a model whose controls are off chance or whose calibration turns the order around."""
    off = {k: v for k, v in controls.items() if abs(v - 0.5) > TOLERANCE}
    if off:
        raise ValueError(f"controls are not at chance: {off}")
    if slope <= 0:
        raise ValueError(f"the calibration's slope is {slope}")


def _dealt(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """The rows with their ``_role`` by group: train, platt (a calibration's) or test; written once, as fits and scorings read it."""
    parts = split_groups(rows, group, share, seed).withColumnRenamed("held", "test")
    rest = split_groups(parts.where("not test").drop("test"), group, share, seed + 1)
    role = F.when(F.col("held"), "platt").otherwise("train")
    dealt = rest.withColumn("_role", role).drop("held").unionByName(parts.where("test").drop("test").withColumn("_role", F.lit("test")))
    return cut(dealt, "dealt")


def _boosted(train: DataFrame, names: list[str], trees: int, seed: int) -> PipelineModel:
    vector = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="keep")
    trained = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=3, seed=seed).fit(vector.transform(train))
    return PipelineModel([vector, trained])


def train_model(rows: DataFrame, features: list[str], group: str, share: float = 0.25, seed: int = 0, trees: int = 20) -> PipelineModel:
    """The model of ``fit`` alone, of the same rows, where neither a calibration nor figures are asked for."""
    return _boosted(_dealt(rows, group, share, seed).where("_role = 'train'").drop("_role"), list(features), trees, seed)


def fit(rows: DataFrame, features: list[str], group: str, controls: list[list[str]] = (), share: float = 0.25, seed: int = 0, trees: int = 20, check: bool = True):
    """A boosted model on ``features`` and a logistic calibration, on three disjoint sets of groups.

    Returns (model, calibration, metrics). ``controls`` are feature lists that must do no better than chance.
    """
    dealt = _dealt(rows, group, share, seed)
    train, platt, test = (dealt.where(F.col("_role") == r).drop("_role") for r in ("train", "platt", "test"))
    boosted = lambda names: _boosted(train, names, trees, seed)

    def scores(model, df):
        return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")

    model = boosted(list(features))
    margin = VectorAssembler(inputCols=["score"], outputCol="m")
    calibration = LogisticRegression(featuresCol="m", labelCol="label").fit(margin.transform(scores(model, platt)))
    metrics = {"auc": auc(scores(model, test)), "slope": float(calibration.coefficients[0]), "features": list(features)}
    metrics["controls"] = {"+".join(c): auc(scores(boosted(c), test)) for c in controls}
    if check:
        gate(metrics["controls"], metrics["slope"])
    return model, calibration, metrics


def score(model: PipelineModel, rows: DataFrame, default: float = float("nan")) -> DataFrame:
    """Adds ``score``; rows with a missing feature get the default."""
    names = model.stages[0].getInputCols()
    whole = rows.withColumn("_whole", ~F.greatest(*(F.col(c).isNull() for c in names), F.lit(False)))
    out = model.transform(whole.na.fill(0.0, names)).withColumn("score", F.when(F.col("_whole"), vector_to_array("probability")[1]).otherwise(default))
    return out.drop("x", "rawPrediction", "probability", "prediction", "_whole")


def score_edges(model: PipelineModel, edges: DataFrame, features: DataFrame, fallback: float = 0.5) -> DataFrame:
    """Scores each distinct row of features once and joins it back; what cannot be scored gets the fallback."""
    keys, names = ["parent", "molecules"], model.stages[0].getInputCols()
    own = [f"_f{i}" for i in range(len(names))]
    known = edges.join(features.select(*keys, *(F.col(n).alias(f) for n, f in zip(names, own))), keys, "left")
    # a missing feature equals nothing, so such an edge meets no score
    once = score(model, known.select(*own).distinct().withColumns({n: F.col(f) for n, f in zip(names, own)})).select(*own, "score")
    return known.join(once, own, "left").select(*edges.columns, F.coalesce(F.nanvl("score", F.lit(None)), F.lit(fallback)).alias("score"))


def save(model: PipelineModel, metrics: dict, path: str) -> None:
    """The model and its metrics; refused like a fit whose gates are shut."""
    gate(metrics["controls"], metrics["slope"])
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metrics),)], "metrics string").coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.schema("metrics string").json(f"{path}/metrics").first()[0])


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, predicted, observed, n) by equal-sized bins of ``score``; the first bins are the larger ones.

    Ranks come from bucketed counts, so no task sees all rows.
    """
    edges = rows.agg(F.percentile_approx("score", [i / 64 for i in range(1, 64)]).alias("e")).first()["e"] or []
    bucket = F.size(F.filter(F.array(*(F.lit(float(e)) for e in sorted(set(edges)))), lambda e: e < F.col("score"))) if edges else F.lit(0)
    dealt = rows.withColumn("_b", bucket)
    total = rows.count()
    shift = F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = dealt.groupBy("_b").count().select("_b", shift.alias("before"))  # at most 64 rows
    place = F.row_number().over(Window.partitionBy("_b").orderBy("score", "id")) + F.col("before") - 1
    placed = dealt.join(F.broadcast(before), "_b").withColumn("place", place)
    large, small = total % bins, total // bins
    cutoff = large * (small + 1)
    number = F.when(F.col("place") < cutoff, F.floor(F.col("place") / (small + 1))).otherwise(large + F.floor((F.col("place") - cutoff) / max(1, small)))
    return placed.groupBy(number.cast("int").alias("bin")).agg(F.avg("score").alias("predicted"), F.avg(F.col("label").cast("double")).alias("observed"), F.count("*").alias("n"))
