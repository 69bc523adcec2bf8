"""Training a distributed tree or linear classifier on the 77 features, with row weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.schema import FEATURE_COLUMNS, N_CLASSES


def train_classifier(
    train: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    label: str = "label",
    weight: str | None = None,
    kind: str = "forest",
    **params,
):
    """Fitted Spark ML model: features + label (+ weight) -> class probabilities."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    maker = {"forest": RandomForestClassifier, "logistic": LogisticRegression}[kind]
    if kind == "forest":
        params = {"numTrees": 50, "maxDepth": 10, "seed": 42, **params}
    classifier = maker(featuresCol="_features", labelCol=label, **params)
    if weight:
        classifier = classifier.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_features")
    return Pipeline(stages=[assembler, classifier]).fit(train)


def with_class_weight(train: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Attach the per-class weight to each row; a label outside the weight table keeps its row at weight 1."""
    side = F.broadcast(weights.selectExpr(f"label as `{label}`", "weight"))
    return train.join(side, label, "left").fillna({"weight": 1.0})


def predict(model, df: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """Add ``probabilities`` of fixed length; classes the model never saw get 0."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    fixed = f"transform(sequence(0, {n_classes - 1}), i -> coalesce(get(_p, i), 0.0D))"
    return scored.selectExpr(*df.columns, f"{fixed} as probabilities")
