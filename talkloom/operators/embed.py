"""Sentence vectors from a pluggable model, keyed by row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.tfidf import raw_words, tfidf_projection

Encoder = Callable[[list[str]], np.ndarray]


def embed_with_model(
    df: DataFrame, text: str, key: str, load: Callable[[], Encoder], batch_size: int = 64
) -> DataFrame:
    """`(key, vec)` for rows with a text. `load` runs once per task and returns a function from texts to a matrix;
    whole texts are passed, in batches, and the model is part of neither the plan nor the driver."""

    def encode(batches):
        import pandas as pd

        model = None
        for batch in batches:
            model = model or load()
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                vectors = model(part[text].tolist())
                yield pd.DataFrame({key: part[key].to_numpy(), "vec": [v.astype("float32") for v in vectors]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).na.drop(subset=[text]).mapInPandas(encode, f"`{key}` {kind}, vec array<float>")


def embed_by_projection(df: DataFrame, text: str, key: str, dim: int = 384, seed: int = 42) -> DataFrame:
    """Vectors without a model file: TF-IDF of the raw words, projected on random signs, unit length. A text without
    words has the zero vector."""
    words = df.na.drop(subset=[text]).select(F.col(key).alias("doc_id"), raw_words(text).alias("tokens"))
    return tfidf_projection(words, dim, seed).select(F.col("doc_id").alias(key), "vec")
