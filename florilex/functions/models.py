"""Vectors by a model that workers load once, on the device that their task was given.

    vector = embedding(load, "path/of/a/model")(F.col("sentence"))

load(device, *args) gives a model: a function from texts to vectors, or a
TokenModel, whose token vectors are pooled by their mean. It is called once in
each worker process; texts reach it in batches (`predict_batch_udf`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import mean_pool

BATCH, WINDOW = 256, 128
VECTOR = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class TokenModel:
    """encode: (ids, mask), both texts x tokens, to token vectors, texts x tokens x size. tokenize: texts to (ids, mask); not needed where tokens are columns."""

    encode: Callable[[np.ndarray, np.ndarray], np.ndarray]
    tokenize: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None


def device(wanted: str | None = None) -> str:
    """What was asked for; else the first GPU that Spark has given the task (spark.task.resource.gpu.amount), else the CPU."""
    if wanted:
        return wanted
    task = TaskContext.get()
    gpu = task.resources().get("gpu") if task else None
    return f"cuda:{gpu.addresses[0]}" if gpu and gpu.addresses else "cpu"


def embedding(load: Callable, *args, batch: int = BATCH, on: str | None = None) -> Callable[[Column], Column]:
    """A function of a text column: its vectors. A null text counts as empty."""

    def make():
        model = load(device(on), *args)

        def predict(texts: np.ndarray) -> np.ndarray:
            if not isinstance(model, TokenModel):
                return np.asarray(model(texts.tolist()), float)
            ids, mask = model.tokenize(texts.tolist())
            return mean_pool(model.encode(ids, mask), mask)

        return predict

    work = predict_batch_udf(make, return_type=VECTOR, batch_size=batch)
    return lambda text: work(F.coalesce(text, F.lit("")))


def token_embedding(load: Callable, *args, width: int = WINDOW, batch: int = BATCH, on: str | None = None) -> Callable[[Column], Column]:
    """A function of a column of token ids (whole numbers above 0): the mean of their vectors. Ids reach the model as one tensor, width wide, filled up with 0."""

    def make():
        model = load(device(on), *args)

        def predict(ids: np.ndarray) -> np.ndarray:
            ids = ids.astype(np.int64)
            mask = (ids > 0).astype(np.int64)
            return mean_pool(model.encode(ids, mask), mask)

        return predict

    work = predict_batch_udf(make, return_type=VECTOR, batch_size=batch, input_tensor_shapes=[[width]])
    return lambda ids: work(F.slice(F.concat(ids, F.array_repeat(F.lit(0), width)), 1, width))


def embed_whole(df: DataFrame, ids: str, load: Callable, *args, keys: list[str], width: int = WINDOW, batch: int = BATCH, on: str | None = None) -> DataFrame:
    """keys and vector: the mean over all tokens of rows of any length, by windows of width tokens.

    Each window's mean counts by its tokens, so that the whole is the mean over all of them, and nothing is cut off. Rows without tokens have no vector.
    """
    ends = F.sequence(F.lit(0), F.size(ids) - 1, F.lit(width))
    windows = df.where(F.size(ids) > 0).select(*keys, F.explode(F.transform(ends, lambda at: F.slice(ids, at + 1, F.least(F.lit(width), F.size(ids) - at)))).alias("window"))
    found = windows.select(*keys, F.size("window").alias("n"), token_embedding(load, *args, width=width, batch=batch, on=on)(F.col("window")).alias("v"))
    places = found.select(*keys, "n", F.posexplode("v").alias("place", "x")).groupBy(*keys, "place").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("vector"))
