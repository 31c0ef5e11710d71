"""Texts to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
Encoder = Callable[[list[str]], np.ndarray]


def words(text: Column) -> Column:
    """Lower-case words of a text: the runs between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def hashed_words(df: DataFrame, text: str = "body", out: str = "vector") -> DataFrame:
    """The default encoder: counts of words hashed to 256 codes, scaled to length one.

    Map-only and JVM-side. A word's code is the first two digits of its MD5. Whole
    texts are read; a text without words gets a zero vector.
    """
    codes = [f"{code:02x}" for code in range(DIMENSIONS)]
    counter = CountVectorizerModel.from_vocabulary(codes, inputCol="_codes", outputCol="_counts")
    scaler = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit")
    coded = df.withColumn(
        "_codes", F.transform(words(F.col(text)), lambda w: F.substring(F.md5(w), 1, 2))
    )
    unit = scaler.transform(counter.transform(coded))
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_codes", "_counts", "_unit")


def encoded(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    text: str = "body",
    out: str = "vector",
    batch_size: int = 4,
) -> DataFrame:
    """Encode with a model of your own, loaded once per task and called in batches.

    ``make_encoder`` runs in the worker and returns a function from a list of texts to
    a matrix with one row each.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                part = list(texts.iloc[start : start + batch_size])
                rows += list(np.asarray(encoder(part), dtype=np.float32))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean vector per key with its number of rows; all rows count, padding included.

    Partial means are kept per task and merged, so a hot key moves one row per task.
    """
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    return (
        tokens.where(F.col(vector).isNotNull())
        .groupBy(key)
        .agg(Summarizer.mean(dense).alias("m"), F.count("*").alias("n"))
        .select(key, "n", vector_to_array("m").alias("mean"))
    )


def shape(embeddings: DataFrame, vector: str = "vector") -> DataFrame:
    """Number of vectors and their dimensions."""
    return embeddings.agg(
        F.count("*").alias("n"), F.max(F.size(vector)).cast("long").alias("dimensions")
    )
