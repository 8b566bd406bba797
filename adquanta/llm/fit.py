"""Bounded labelled samples and small models fitted on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column,
                    per_class: int, class_bytes: int, id_col: str = "doc_id",
                    text_col: str = "text") -> pd.DataFrame:
    """Whole labelled texts of each class in an order drawn from the ids: at most ``per_class``
    of together at most ``class_bytes`` bytes.

    Ids are chosen on the label table, then on the sizes of their texts; a text
    that would pass the total is left out whole. So only chosen texts leave
    their tasks, none is cut, and both bounds hold however often a table repeats
    an id: of several texts of an id the smallest in order counts. Ids with null
    or contradicting labels and null texts are left out. Columns: id, text, y;
    ``attrs["share"]`` is the share of label 1 among all ids that may be learnt from.
    """
    known = (
        labels.where(learn & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("_y"))
        .where("y = _y").drop("_y").withColumn("draw", F.xxhash64("id"))
    )
    n, ones = known.agg(F.count("*"), F.sum("y")).first()
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("draw", "id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # 2 * per_class rows of three numbers are the bound of both broadcasts and of the collected sizes.
    sizes = texts.select("id", F.octet_length("text").alias("size")).join(F.broadcast(ids), "id") \
        .groupBy("id", "y", "draw").agg(F.max("size").alias("size")).toPandas()
    chosen, left = [], {0: class_bytes, 1: class_bytes}
    for row in sizes.sort_values(["draw", "id"]).itertuples():
        if row.size <= left[row.y]:
            left[row.y] -= row.size
            chosen.append((row.id, int(row.y), int(row.draw)))
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(chosen, f"id {kind}, y int, draw bigint")
    found = texts.join(F.broadcast(wanted), "id").groupBy("id", "y", "draw").agg(F.min("text").alias("text")).toPandas()
    found = found.sort_values(["draw", "id"])[["id", "text", "y"]].reset_index(drop=True)
    found.attrs["share"] = ones / n if n else 0.5
    return found


@dataclass
class Logistic:
    """Ridge-penalised logistic regression on standardised inputs, by damped Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        w = np.zeros(z.shape[1])
        w[0] = np.log(rate / (1 - rate))
        penalty = np.r_[1e-3, np.full(x.shape[1], ridge)]

        def loss(w):
            m = z @ w
            return (np.logaddexp(0, m) - y * m).sum() + 0.5 * (penalty * w * w).sum()

        now = loss(w)
        for _ in range(steps):
            p = sigmoid(z @ w)
            slope = z.T @ (p - y) + penalty * w
            bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step, size = np.linalg.solve(bend, slope), 1.0
            while size > 1e-4 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            before, now = now, loss(w)
            if before - now < 1e-9 * max(1.0, abs(now)):
                break
        return cls(mean, scale, w)

    def for_share(self, share: float, fitted: float) -> Logistic:
        """The same model where label 1 has another share than in the sample it was fitted on."""
        odds = [np.log(p / (1 - p)) for p in np.clip((share, fitted), 1e-3, 1 - 1e-3)]
        return Logistic(self.mean, self.scale, np.r_[self.weights[0] + odds[0] - odds[1], self.weights[1:]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:])


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))
