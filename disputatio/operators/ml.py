"""Feature vectors and a trained stance classifier on Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.functions.text import WORD

# Called once per task; returns the function that encodes a batch of texts as a matrix.
EncoderFactory = Callable[[], Callable[[pd.Series], np.ndarray]]


def _text_stages(text: str, features: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD, gaps=False, toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]


def embed_hashed(df: DataFrame, text: str, features: int = 256, output: str = "embedding") -> DataFrame:
    """Unit vectors of hashed word weights: an encoder without a model file."""
    fitted = Pipeline(stages=_text_stages(text, features)).fit(df)
    rows = fitted.transform(df)
    return rows.withColumn(output, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


def embed_with(df: DataFrame, key: list[str], text: str, encoder: EncoderFactory, output: str = "embedding") -> DataFrame:
    """Vectors from a user-supplied encoder, loaded once per task and fed with Arrow batches."""
    rows = df.select(*key, text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = encoder()
        for batch in batches:
            yield batch[key].assign(**{output: list(np.asarray(run(batch[text]), dtype=np.float32))})

    return rows.mapInPandas(encode, f"{types}, `{output}` array<float>")


def train_stance_classifier(
    train: DataFrame, text: str = "input_text", label: str = "label", features: int = 1 << 14, rounds: int = 10
) -> PipelineModel:
    """Two-class classifier on hashed words; training is distributed by MLlib."""
    stages = _text_stages(text, features)
    learner = LogisticRegression(featuresCol="_unit", labelCol=label, maxIter=rounds, regParam=0.01)
    return Pipeline(stages=[*stages, learner]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted label and its two-decimal score."""
    rows = model.transform(df)
    scores = vector_to_array("probability")
    return rows.withColumns(
        {
            "predicted_label": F.col("prediction").cast("int"),
            "score": F.round(F.array_max(scores), 2),
        }
    ).drop("_words", "_tf", "_idf", "_unit", "rawPrediction", "probability", "prediction")


def assign_set(key: Column, parts: tuple[tuple[str, int], ...] = (("train", 70), ("dev", 15), ("test", 15))) -> Column:
    """Repeatable split into named parts by a hash of the key, in percent."""
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("int") % 100
    out, upper = F, 0
    for name, percent in parts:
        upper += percent
        out = out.when(bucket < upper, name)
    return out
