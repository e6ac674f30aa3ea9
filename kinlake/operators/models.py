"""Stacked gradient-boosted models over pair features, cross-fitted by anchor, and isotonic calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.sources.scratch import materialise


def fold(key: str, folds: int, seed: int = 42) -> Column:
    """The anchor's fold: a hash, the same under any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def cross_fit(pairs: DataFrame, label: str, features: Sequence[str], out: str, folds: int = 3, depth: int = 4, rounds: int = 10, seed: int = 42, report: dict | None = None, folder: str | None = None) -> DataFrame:
    """Add `out`: probability by a model that saw no pair of the row's anchor. One model per fold; with one class only, the rate.

    A sixth of a fold's training anchors tells when to stop: rounds end once they gain nothing there. `report` gets, under `out`, the
    folds' trees and the features' importances, summed; `folder` the models, as <out>-<fold>."""
    base = pairs.withColumn("_fold", fold("i", folds, seed)).withColumn("_stop", fold("i", 6, seed + 1000) == 0)
    table = materialise(VectorAssembler(inputCols=list(features), outputCol="_x").transform(base), "model-input")
    done, facts = None, {"trees": [], "importance": dict.fromkeys(features, 0.0)}
    for k in range(folds):
        train, test = table.filter(F.col("_fold") != k), table.filter(F.col("_fold") == k)
        n, pos = train.agg(F.count("*"), F.sum(label)).first()
        if not n or pos in (0, n, None):
            part = test.withColumn(out, F.lit((pos or 0) / n if n else 0.0))
        else:
            both = train.filter("NOT _stop").agg(F.countDistinct(label)).first()[0] == 2 and train.filter("_stop").limit(1).count()
            learner = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=0.3, seed=seed)
            learner = learner.setParams(validationIndicatorCol="_stop", validationTol=0.001) if both else learner
            model = learner.fit(train.withColumn(label, F.col(label).cast("double")))
            facts["trees"].append(model.getNumTrees)
            for name, gain in zip(features, model.featureImportances.toArray(), strict=True):
                facts["importance"][name] += float(gain)
            if folder:
                model.write().overwrite().save(f"{folder}/{out}-{k}")
            part = model.transform(test).withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        done = part if done is None else done.unionByName(part)
    if report is not None:
        report[out] = facts
    return done.drop("_x", "_fold", "_stop")


def train_all(pairs: DataFrame, label: str, features: Sequence[str], out: str, folds: int = 5, depth: int = 4, rounds: int = 20, seed: int = 42):
    """(pairs with the out-of-fold probability `out`, the model of all pairs): rounds of the latter are 1.1 times the folds' mean."""
    facts: dict = {}
    scored = materialise(cross_fit(pairs, label, features, out, folds, depth, rounds, seed, facts), "out-of-fold")
    trees = facts[out]["trees"] or [rounds]
    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(pairs).withColumn(label, F.col(label).cast("double"))
    return scored, GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=max(1, int(1.1 * sum(trees) / len(trees))), stepSize=0.3, seed=seed).fit(x)


def importance(report: dict, stage: str) -> list[tuple[str, float]]:
    """(feature, gain summed over the folds), greatest first, names in order among equals."""
    return sorted(report[stage]["importance"].items(), key=lambda x: (-x[1], x[0]))


def calibrate(pairs: DataFrame, score: str, label: str, out: str, held: Column | None = None) -> DataFrame:
    """Isotonic regression of the label on the score, clipped to [0, 1], fitted on the `held` rows (all by default); without any, or
    with one class there, the score itself."""
    known = pairs if held is None else pairs.filter(held)
    if known.agg(F.countDistinct(label)).first()[0] < 2:
        return pairs.withColumn(out, F.col(score))
    model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol=out).fit(known.select(F.col(score), F.col(label).cast("double").alias(label)))
    return model.transform(pairs).withColumn(out, F.greatest(F.least(F.col(out), F.lit(1.0)), F.lit(0.0)))
