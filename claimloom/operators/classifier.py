"""HAM/SMISH text classifier on spark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_SPACE
from ..session import stage
from .evaluate import binary_report
from .sampling import stratified_split


def pipeline(features: int = 4096, iterations: int = 10) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=f"{NOT_SPACE}+", gaps=False),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(maxIter=iterations, regParam=0.1),
        ]
    )


def with_target(messages: DataFrame) -> DataFrame:
    ham = F.col("class") == "HAM"
    return messages.withColumn("label", F.when(ham, 0.0).otherwise(1.0))


def classify(model: PipelineModel, messages: DataFrame) -> DataFrame:
    """Class, confidence and both probabilities per message."""
    p = vector_to_array("probability")
    return model.transform(messages).select(
        "message_id",
        *[c for c in ("class",) if c in messages.columns],
        F.when(F.col("prediction") == 1.0, "SMISH").otherwise("HAM").alias("predicted"),
        F.greatest(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("confidence"),
        F.get(p, F.lit(0)).alias("p_ham"),
        F.get(p, F.lit(1)).alias("p_smish"),
    )


def ham_smish_classifier(messages: DataFrame) -> DataFrame:
    """Train on 80 % (stratified by class), report on the rest.

    The split is staged: term weights, regression and report read the same rows.
    """
    named = messages.withColumn("label", F.when(F.col("class") == "HAM", "ham").otherwise("smish"))
    split = stage(with_target(stratified_split(named)).select("message_id", "text", "class", "label", "split"), "split")
    model = pipeline().fit(split.where("split = 'train'"))
    return binary_report(classify(model, split.where("split = 'test'")), "class", "predicted")
