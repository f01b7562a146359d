"""Learned filters over feature rows: grouped cross-validation and a temporal holdout with MLlib models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight: half of the rows by the rows of the own label."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    return rows.join(F.broadcast(sizes), label).crossJoin(F.broadcast(total)).withColumn(
        "weight", F.col("__total") / (2 * F.col("__n"))
    ).drop("__n", "__total")


def pipeline(features: list[str], label: str, kind: str = "logistic", seed: int = 0) -> Pipeline:
    gather = VectorAssembler(inputCols=features, outputCol="__raw")
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True)
    if kind == "logistic":
        model = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", regParam=0.01, maxIter=100)
    else:
        model = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=20, seed=seed)
    return Pipeline(stages=[gather, scale, model])


def _scored(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(rows).select(*keep, F.get(vector_to_array("probability"), 1).alias("score"))


def grouped_cv(rows: DataFrame, features: list[str], label: str, group: str, folds: int = 5, kind: str = "logistic") -> DataFrame:
    """key columns and score: each row scored by a model that saw no row of its group. Groups are dealt to folds by their
    hash, so folds need no order of rows."""
    keep = [c for c in rows.columns if c not in features]
    dealt = rows.withColumn("__fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    out = None
    for k in range(folds):
        train, test = dealt.where(F.col("__fold") != k), dealt.where(F.col("__fold") == k)
        if train.select(label).distinct().count() < 2:
            continue
        model = pipeline(features, label, kind).fit(balanced(train, label))
        part = _scored(model, test, keep)
        out = part if out is None else out.unionAll(part)
    return out


def temporal_holdout(rows: DataFrame, features: list[str], label: str, when: str, first_test, kind: str = "logistic") -> DataFrame:
    """Scores of rows from ``first_test`` on, by a model of the rows before."""
    keep = [c for c in rows.columns if c not in features]
    model = pipeline(features, label, kind).fit(balanced(rows.where(F.col(when) < first_test), label))
    return _scored(model, rows.where(F.col(when) >= first_test), keep)
