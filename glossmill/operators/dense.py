"""Brute-force cosine search of a stated query set against all vectors, in blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries, and rows, that meet in one task; the table is dealt out once for each block of queries.
QUERY_BLOCK, ROW_BLOCK = 8192, 50_000
#: Queries compared with the rows at a time.
STEP = 256


def dense_topk(queries: DataFrame, vectors: DataFrame, *, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, rank, other, cosine): the k most similar rows of each query, without itself; equal ones by id.

    Null vectors, and those of another length than the query's, aren't compared; an
    all-zero vector has the cosine 0 with all. Only the best of a block leave a task.
    """
    n = max(1, ceil(queries.count() / QUERY_BLOCK))
    parts = max(1, ceil(vectors.count() / ROW_BLOCK))
    left = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"), F.size(vector).alias("dim"))
    left = left.withColumn("block", F.pmod(F.hash("q"), F.lit(n))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim"))
    right = right.withColumn("part", F.pmod(F.hash("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": [], "id": [], "cosine": []})
        ids, rows = b["id"].to_numpy(), _unit(b["v"])
        parts = []
        for first in range(0, len(a), STEP):
            asked = a["q"].iloc[first : first + STEP].to_numpy()
            close = np.round(_unit(a["v"].iloc[first : first + STEP]) @ rows.T, 12)
            close[asked[:, None] == ids[None, :]] = -3
            least = np.partition(np.round(close, 6), max(0, close.shape[1] - k), axis=1)[:, max(0, close.shape[1] - k)]
            for q, values, last in zip(asked.tolist(), close, least, strict=True):
                top = np.flatnonzero(np.round(values, 6) >= last)  # all that are as similar as the last
                top = top[np.lexsort((ids[top], -np.round(values[top], 6)))][:k]
                parts.append(pd.DataFrame({"q": q, "id": ids[top], "cosine": values[top]}))
        out = pd.concat(parts)
        return out[out["cosine"] > -2]

    kind = queries.schema[key].dataType.simpleString()
    found = left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part")).applyInPandas(run, f"q {kind}, id {kind}, cosine double")
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 6)).alias("far"), "id", "cosine"))), 1, k)
    listed = found.groupBy("q").agg(nearest.alias("near"))
    return listed.select(F.col("q").alias(key), F.posexplode("near").alias("at", "n")).select(key, (F.col("at") + 1).alias("rank"), F.col("n.id").alias("other"), F.col("n.cosine").alias("cosine"))


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_list()).astype(np.float64)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)
