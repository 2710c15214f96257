"""Learned correctors: character n-gram features and classifiers of Spark ML, and two of our own.

``svm`` is a radial-basis machine with probabilities (a linear one over random waves), ``gradient_boosting`` grows the trees of all
labels in the same jobs (``machines``).
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwright.functions.expr import char_ngrams
from mendwright.operators.machines import FourierFeatures, SoftmaxBoosting


def classifier(kind: str):
    return {
        "random_forest": lambda: RandomForestClassifier(labelCol="label_index", numTrees=100, seed=42),
        "gradient_boosting": lambda: SoftmaxBoosting(labelCol="label_index"),
        "svm": lambda: LogisticRegression(labelCol="label_index", featuresCol="waves", maxIter=30),
        "logistic": lambda: LogisticRegression(labelCol="label_index", maxIter=20),
        "naive_bayes": lambda: NaiveBayes(labelCol="label_index", modelType="multinomial"),
    }[kind]()


def featured(df: DataFrame, kind: str, text: str = "input_text") -> DataFrame:
    """Adds the text's n-grams: of two to four characters, for the radial-basis machine of two and three."""
    return df.withColumn("grams", char_ngrams(F.lower(F.col(text)), 2, 3 if kind == "svm" else 4))


def pipeline(kind: str, features: int = 5000) -> Pipeline:
    """Indexed labels, counts (weighted by rarity and normalised, but for naive Bayes) and the classifier."""
    steps = [StringIndexer(inputCol="correct_text", outputCol="label_index", handleInvalid="skip"), CountVectorizer(inputCol="grams", outputCol="features" if kind == "naive_bayes" else "counts", vocabSize=features)]
    if kind != "naive_bayes":
        steps += [IDF(inputCol="counts", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features")]
    if kind == "svm":
        steps.append(FourierFeatures(inputCol="features", outputCol="waves", size=features))
    return Pipeline(stages=[*steps, classifier(kind)])


def fit(train: DataFrame, kind: str, features: int = 5000) -> PipelineModel:
    return pipeline(kind, features).fit(featured(train, kind))


def predict(model: PipelineModel, df: DataFrame, threshold: float | None = None, kind: str = "naive_bayes") -> DataFrame:
    """(row_id, input_text, correct_text, predicted, confidence); below the threshold predicted is null. Labels are decoded by name."""
    labels = model.stages[0].labels
    out = PipelineModel(model.stages[1:]).transform(featured(df, kind))  # rows need no known label
    names = F.array(*[F.lit(x) for x in labels])
    confidence = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(1.0)
    predicted = F.element_at(names, F.col("prediction").cast("int") + 1)
    if threshold is not None:
        predicted = F.when(confidence >= threshold, predicted)
    return out.select("row_id", "input_text", "correct_text", predicted.alias("predicted"), confidence.alias("confidence"))


def cross_validated(train: DataFrame, kind: str, folds: int = 5, features: int = 1000) -> tuple[float, float]:
    """(mean, standard deviation) of accuracy over the folds."""
    held = featured(train, kind).persist()
    try:
        found = CrossValidator(estimator=pipeline(kind, features), estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy"), numFolds=folds, seed=42).fit(held)
    finally:
        held.unpersist()
    return found.avgMetrics[0], found.stdMetrics[0]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def metadata(kind: str, mean: float, deviation: float, features: int, labels: int, trained_at: str) -> str:
    """The record that goes with a saved model, as JSON."""
    return json.dumps({"model_type": kind, "accuracy": {"mean": mean, "std": deviation}, "features": features, "labels": labels, "trained_at": trained_at})
