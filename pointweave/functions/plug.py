"""Where outside models plug in: encoders, mask generators, codecs. They deliver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.operators.consensus import vector_sum


def encode_with(model: Callable[[list[str]], np.ndarray]):
    """A vectorised text encoder from a function of a list of texts."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model(texts.fillna("").tolist()), float)))

    return run


def prompts(concepts: DataFrame, templates: list[str]) -> DataFrame:
    """(concept, prompt): every concept in every template (with one %s)."""
    return concepts.select("concept", F.explode(F.array(*[F.format_string(t, "concept") for t in templates])).alias("prompt"))


def generate_masks(images: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Masks and vectors from a per-batch model."""
    return images.mapInPandas(model, schema)


class LinearCodec:
    """Encode by a matrix with orthonormal columns, decode by its transpose."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.asarray(matrix, float)

    @classmethod
    def fit(cls, points: DataFrame, width: int, vec: str = "vec") -> LinearCodec:
        """Leading directions of the uncentred second moments; a task makes
        one matrix of the vectors' width, and so does the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram = None
            for batch in batches:
                if batch.num_rows:
                    a = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                    gram = a.T @ a if gram is None else gram + a.T @ a
            if gram is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gram), dtype=np.int32)), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "row"])

        rows = vector_sum(points.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "i int, row array<double>"), ["i"], "row")
        gram = np.array([r["s"] for r in rows.orderBy("i").collect()])
        _, vectors = np.linalg.eigh(gram)
        return cls(vectors[:, ::-1][:, :width])

    @classmethod
    def random(cls, n: int, width: int, seed: int = 0) -> LinearCodec:
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
        return cls(q)

    def _apply(self, df: DataFrame, m: np.ndarray, vec: str, out: str) -> DataFrame:
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ m)) if len(v) else pd.Series([], dtype=object)

        return df.withColumn(out, run(vec))

    def encode(self, df: DataFrame, vec: str = "vec", out: str = "code") -> DataFrame:
        return self._apply(df, self.matrix, vec, out)

    def decode(self, df: DataFrame, vec: str = "code", out: str = "vec") -> DataFrame:
        return self._apply(df, self.matrix.T, vec, out)
