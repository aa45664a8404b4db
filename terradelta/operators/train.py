"""A trainable pixel scorer: logistic regression on the scaled channels of both months, with weight on change."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.raster import z_score


def features(pixels: DataFrame, channels: list[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``features``: the change of each scaled channel."""
    step = lambda c: z_score(F.col(f"{c}_2"), *map(F.lit, stats[c])) - z_score(F.col(f"{c}_1"), *map(F.lit, stats[c]))
    return pixels.withColumn("features", array_to_vector(F.array(*(step(c).cast("double") for c in channels))))


def train_scorer(pixels: DataFrame, channels: list[str], stats: dict[str, tuple[float, float]], pos_weight: float = 1.0, max_iter: int = 50) -> LogisticRegressionModel:
    """Fits on labelled pixels (``<channel>_1``, ``<channel>_2``, ``label``); a pixel with change weighs ``pos_weight``."""
    rows = features(pixels, channels, stats).select("features", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, pos_weight).otherwise(1.0).alias("weight"))
    return LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=1e-4, standardization=False).fit(rows)


def tile_scorer(model: LogisticRegressionModel) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The model as a scorer of tiles."""
    weights, bias = np.array(model.coefficients.toArray()), float(model.intercept)
    return lambda t1, t2: np.tensordot(t2 - t1, weights, axes=(1, 0)) + bias


def best_epoch(scores: dict[str, float], last: str | None = None, top: int = 3) -> list[str]:
    """The checkpoints that stay: the ``top`` of highest score, then the last; without scores, the last alone."""
    kept = sorted(scores, key=lambda k: (-scores[k], k))[:top]
    return kept + ([last] if last and last not in kept else [])


def checkpoint_to_load(best: str | None, last: str | None, others: list[str]) -> str:
    """The best, else the last, else any."""
    for found in (best, last, *sorted(others)):
        if found:
            return found
    raise RuntimeError("training left no checkpoint")


def save_checkpoint(model: LogisticRegressionModel, folder: str, epoch: int, score: float, top: int = 3) -> list[str]:
    """Writes the model as ``last`` and, if it is among the ``top`` of highest score so far, under its epoch and score;
    the others go. Gives the names that stay."""
    store, path = _store(folder)
    name = f"change-epoch={epoch:03d}-score={score:.4f}"
    scores = {n: float(n.rsplit("=", 1)[1]) for n in _names(store, path) if n.startswith("change-")} | {name: score}
    kept = best_epoch(scores, "last", top)
    for n in {name, "last"} & set(kept):
        model.write().overwrite().save(f"{folder}/{n}")
    for n in set(scores) - set(kept) - {name}:
        store.delete(path.suffix(f"/{n}"), True)
    return kept


def load_checkpoint(folder: str) -> LogisticRegressionModel:
    """The checkpoint of highest score, else the last one."""
    names = _names(*_store(folder))
    scored = sorted((n for n in names if n.startswith("change-")), key=lambda n: (-float(n.rsplit("=", 1)[1]), n))
    return LogisticRegressionModel.load(f"{folder}/{checkpoint_to_load(scored[0] if scored else None, 'last' if 'last' in names else None, names)}")


def _store(folder: str) -> tuple:
    spark = SparkSession.getActiveSession()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(store, path) -> list[str]:
    return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []


def training_splits(train: DataFrame, val: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All patches for both if there are none to train on."""
    return (every, every) if train.isEmpty() else (train, val)
