"""Feature baselines trained on hashed structure fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgraph.operators.similarity import shingle_bits


def _vectors(rows: DataFrame, text: str, bits: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF

    words = rows.withColumn("words", F.transform(shingle_bits(F.col(text), bits=bits), lambda b: b.cast("string")))
    return HashingTF(inputCol="words", outputCol="features", numFeatures=bits, binary=True).transform(words).drop("words")


def score(rows: DataFrame, model: str = "rf", text: str = "text", bits: int = 2048, cap: int = 50_000, seed: int = 42) -> DataFrame:
    """(node_id, label, fold, score) for all rows (node_id, text, label, fold). The model is fitted on at most ``cap``
    labelled train rows, the first in hash order; every row is scored. One class only gives 0.5 throughout."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    x = _vectors(rows.where(F.col(text).isNotNull()), text, bits)
    train = x.where("fold = 'train' and label in (0, 1)").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "node_id"))).limit(cap)
    classes = train.agg(F.countDistinct("label")).first()[0]
    if classes < 2:
        return x.select("node_id", "label", "fold", F.lit(0.5).alias("score"))
    est = (
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=20, maxDepth=6, seed=seed)
        if model == "rf"
        else LogisticRegression(labelCol="label", featuresCol="features", maxIter=20, regParam=0.01)
    )
    fitted = est.fit(train.withColumn("label", F.col("label").cast("double")))
    return fitted.transform(x).select("node_id", "label", "fold", vector_to_array("probability")[1].alias("score"))
