"""Scoring: scaler, logistic regression, isotonic calibration, isolation forest; segmentation measures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scorer(labelled: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Scaler, logistic regression and isotonic calibration on labelled rows."""
    stages = [VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol=label, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")]
    model = Pipeline(stages=stages).fit(labelled)
    # its training summary holds the session, which no task can be sent once an Observation was used (session.cut)
    model.stages[-1]._java_obj.setSummary(labelled.sparkSession._jvm.scala.Option.empty())
    scored = model.transform(labelled).withColumn("__s", vector_to_array("__p")[1]).select("__s", F.col(label).cast("double").alias("__y"))
    calibrated = IsotonicRegression(featuresCol="__s", labelCol="__y", predictionCol="probability").fit(scored)
    return PipelineModel(stages=[*model.stages, calibrated])


def score(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    """Add probability and the two-way decision at the threshold."""
    out = df
    for stage in model.stages[:-1]:
        out = stage.transform(out)
    out = model.stages[-1].transform(out.withColumn("__s", vector_to_array("__p")[1]))
    return out.withColumn("decision", F.when(F.col("probability") >= threshold, "match").otherwise("no_match")).drop("__x", "__z", "__p", "__r", "__c", "__s")


@dataclass(frozen=True)
class IsolationForest:
    """Random split trees on a bounded sample; a short mean path to a leaf marks an unusual row."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    sample: int

    @staticmethod
    def fit(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 17) -> IsolationForest:
        """At most ``trees`` times ``sample`` rows are drawn (a documented bound); every row can be scored."""
        bound = trees * sample
        count = max(1, df.count())
        x = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).sample(min(1.0, 1.2 * bound / count), seed=seed).limit(bound).toPandas().to_numpy(float)
        rng = np.random.default_rng(seed)
        depth = int(np.ceil(np.log2(max(2, sample))))
        out = []
        for _ in range(trees):
            rows = x[rng.integers(0, len(x), min(sample, len(x)))] if len(x) else np.zeros((0, len(features)))
            size = 2 ** (depth + 1)
            axis, cut_, left, grown = np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(size)
            stack = [(0, rows, 0)]
            while stack:
                node, own, d = stack.pop()
                left[node], grown[node] = len(own), d
                span = np.ptp(own, axis=0) if len(own) else np.zeros(len(features))
                if d >= depth or len(own) <= 1 or not (span > 0).any():
                    continue
                f = rng.choice(np.nonzero(span > 0)[0])
                v = rng.uniform(own[:, f].min(), own[:, f].max())
                axis[node], cut_[node] = f, v
                stack += [(2 * node + 1, own[own[:, f] < v], d + 1), (2 * node + 2, own[own[:, f] >= v], d + 1)]
            out.append((axis, cut_, left, grown))
        return IsolationForest(tuple(out), min(sample, max(2, len(x))))

    def score(self, df: DataFrame, features: list[str], out: str = "isolation") -> DataFrame:
        """Add the anomaly score in (0, 1)."""
        forest = self

        def path(n: np.ndarray) -> np.ndarray:
            return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = np.stack([c.fillna(0).to_numpy(float) for c in columns], axis=1)
                total = np.zeros(len(x))
                for axis, cut_, left, grown in forest.trees:
                    node = np.zeros(len(x), dtype=int)
                    while (inner := axis[node] >= 0).any():
                        at = np.nonzero(inner)[0]
                        f = axis[node[at]]
                        node[at] = 2 * node[at] + np.where(x[at, f] < cut_[node[at]], 1, 2)
                    total += grown[node] + path(left[node])
                yield pd.Series(2 ** (-total / len(forest.trees) / path(np.array([forest.sample]))[0]))

        return df.withColumn(out, run(*[F.col(f).cast("double") for f in features]))


def segmentation_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts and the measures derived from them, with 1e-9 in every denominator."""
    n = df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    e = 1e-9
    n = n.withColumns({"precision": tp / (tp + fp + e), "recall": tp / (tp + fn + e), "iou": tp / (tp + fp + fn + e), "accuracy": (tp + tn) / (tp + fp + fn + tn + e), "dice": 2 * tp / (2 * tp + fp + fn + e)})
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + e))


def mask_statistics(df: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """Range, mean and population deviation of a mask, share and mean of its positive part."""
    p = F.col(value)
    return df.agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.count_if(p >= threshold).alias("positive_count"), (100.0 * F.count_if(p >= threshold) / F.count(F.lit(1))).alias("positive_percent"), F.avg(F.when(p >= threshold, p)).alias("mean_positive"))
