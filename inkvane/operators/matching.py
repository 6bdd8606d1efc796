"""All pairs of texts within a model, in blocks: bounded memory in a task, and only a row for each text, or block pair, leaves it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a block, and rows of it that meet the other block at once.
BLOCK, ROWS = 4096, 32
PARTITIONS = 2000


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once: in the shared checkpoint folder where there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def view(df: DataFrame) -> str:
    """The name of a temporary view of the rows."""
    name = f"rows_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean absolute difference of each row of a to each of b, over the columns that both have (not NaN)."""
    total = np.zeros((len(a), len(b)))
    if not (np.isnan(a).any() or np.isnan(b).any()):
        for c in range(a.shape[1]):
            total += np.abs(a[:, c, None] - b[None, :, c])
        return total / a.shape[1]
    both = np.zeros_like(total)
    for c in range(a.shape[1]):
        d = np.abs(a[:, c, None] - b[None, :, c])
        both += ~np.isnan(d)
        total += np.nan_to_num(d, copy=False)
    with np.errstate(invalid="ignore"):
        return total / both


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of the rows, by id."""
    ids, cells = t["id"].to_numpy(), t["v"].combine_chunks()
    v = cells.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def nearest(t: pa.Table) -> pa.Table:
    """For each text of side a the least distance, rounded half up, to those of side b, and the smallest id there."""
    (ids, a), (others, b) = (_matrix(t.filter(pc.equal(t["side"], s))) for s in "ab")
    best, at = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for k in range(0, len(ids) if len(others) else 0, ROWS):
        d = distances(a[k : k + ROWS], b)
        d = np.floor(d * 1e8 + 0.5) / 1e8
        j = np.argmin(np.where(np.isnan(d), np.inf, d), 1)  # the first of equals
        best[k : k + ROWS], at[k : k + ROWS] = d[np.arange(len(j)), j], others[j]
    n = len(ids) if len(others) else 0
    return pa.table({"model": pa.array([t["model"][0].as_py()] * n, pa.string()), "id": ids[:n], "d": best[:n], "other": at[:n]})


def moments(t: pa.Table) -> pa.Table:
    """Number, mean, sum of squares about it, least and largest of the distances of a block pair, each pair of texts once."""
    (ids, a), (others, b) = (_matrix(t.filter(pc.equal(t["side"], s))) for s in "ab")
    same, rows = t["i"][0].as_py() == t["j"][0].as_py(), []
    for k in range(0, len(ids) if len(others) else 0, ROWS):
        d = distances(a[k : k + ROWS], b)
        d = d[ids[k : k + ROWS, None] < others[None, :]] if same else d.ravel()
        d = d[~np.isnan(d)]
        if len(d):
            rows.append((len(d), d.mean(), ((d - d.mean()) ** 2).sum(), d.min(), d.max()))
    cols = [np.array(c, float) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 5
    return pa.table({"model": pa.array([t["model"][0].as_py()] * len(rows), pa.string())} | dict(zip(("n", "mean", "m2", "least", "most"), cols, strict=True)))


def by_blocks(texts: DataFrame, a: str, b: str, f: Callable[[pa.Table], pa.Table], returns: str, ordered: bool = False) -> DataFrame:
    """``f`` over each pair of blocks of a model's texts of (model, id, vectors); ``ordered``: only pairs i <= j."""
    sizes = [r["count"] for r in texts.groupBy("model").count().collect()]  # a row for each model
    n = max(1, -(-max(sizes, default=0) // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = F.sequence(F.lit(0), F.lit(n - 1))
    first = texts.select("model", block.alias("i"), F.explode(F.sequence(block, F.lit(n - 1)) if ordered else every).alias("j"), F.lit("a").alias("side"), "id", F.col(a).alias("v"))
    second = texts.select("model", F.explode(F.sequence(F.lit(0), block) if ordered else every).alias("i"), block.alias("j"), F.lit("b").alias("side"), "id", F.col(b).alias("v"))
    groups = len(sizes) * n * n
    return first.union(second).repartition(max(1, min(groups, PARTITIONS)), "model", "i", "j").groupBy("model", "i", "j").applyInArrow(f, returns)


def matched(texts: DataFrame) -> DataFrame:
    """(model, n, accuracy, chance) of (model, id, o, w): how many originals' nearest rewrite is their own."""
    found = by_blocks(texts, "o", "w", nearest, "model string, id long, d double, other long")
    best = found.groupBy("model", "id").agg(F.min(F.struct("d", "other")).alias("b"))
    n = F.count("*")
    return best.groupBy("model").agg(n.alias("n"), F.round(100.0 * F.count_if(F.col("id") == F.col("b.other")) / n, 4).alias("accuracy"), F.round(F.lit(100.0) / n, 4).alias("chance"))


def pairwise(texts: DataFrame) -> DataFrame:
    """(model, n_pairs, mean, std, min, max) of the distances between the vectors w of a model's texts."""
    part = by_blocks(texts, "w", "w", moments, "model string, n double, mean double, m2 double, least double, most double", ordered=True)
    total = part.groupBy("model").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("s2"), F.min("least").alias("least"), F.max("most").alias("most"))
    std = F.sqrt(F.greatest(F.col("s2") / F.col("n") - F.col("mu") * F.col("mu"), F.lit(0.0)))
    return total.select("model", F.col("n").cast("long").alias("n_pairs"), F.round("mu", 5).alias("mean"), F.round(std, 5).alias("std"), F.round("least", 5).alias("min"), F.round("most", 5).alias("max"))
