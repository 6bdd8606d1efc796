"""Paired statistics over long tables (id, marker, o, w), as DataFrame operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("paired", "stance", "pooled", "temperature")


def cohens_d(kind: str = "paired", o: str = "o", w: str = "w"):
    """An aggregate column; paired and stance run from original to rewrite, pooled and temperature the other way."""
    diff = F.col(o) - F.col(w)
    if kind == "paired":
        d = F.avg(diff) / F.nullif(F.stddev_samp(diff), F.lit(0.0))
    elif kind == "stance":
        d = F.avg(diff) / F.nullif(F.sqrt((F.var_pop(o) + F.var_pop(w)) / 2), F.lit(0.0))
    elif kind == "pooled":
        n1, n2 = F.count(o), F.count(w)
        pooled = F.sqrt(((n1 - 1) * F.var_samp(o) + (n2 - 1) * F.var_samp(w)) / F.nullif(n1 + n2 - 2, F.lit(0)))
        d = (F.avg(w) - F.avg(o)) / F.nullif(pooled, F.lit(0.0))
    elif kind == "temperature":
        d = -F.avg(diff) / F.nullif(F.stddev_samp(diff), F.lit(0.0))
    else:
        raise ValueError(f"kind is one of {KINDS}")
    return F.coalesce(d, F.lit(0.0))


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds q and reject; the family is each group of ``by``. Families are as long as the marker list."""
    groups = by or []
    order = W.partitionBy(*groups).orderBy(F.col(p).desc())
    family = F.count("*").over(W.partitionBy(*groups))
    ranked = df.withColumn("_m", family).withColumn("_k", family - F.row_number().over(order) + 1)
    q = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(W.partitionBy(*groups).orderBy(F.col("_k").desc()).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("q", F.least(F.lit(1.0), q)).withColumn("reject", F.col("q") < alpha).drop("_m", "_k")


def exact_wilcoxon_p(n: int, w: float) -> float:
    """Two-sided exact p of the smaller rank sum w of n differences without ties."""
    ways = [1]
    for k in range(1, n + 1):
        new = ways + [0] * k
        for s, c in enumerate(ways):
            new[s + k] += c
        ways = new
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, nonzero, w, z, p): exact up to 50 differences without ties or zeros, else normal with tie correction.

    Ranks are windows over each group; only one row for each group reaches Python.
    """
    d = pairs.withColumn("_d", F.round(F.col("o") - F.col("w"), 9)).filter("_d is not null")
    rank = W.partitionBy(*by).orderBy(F.abs("_d"))
    same = W.partitionBy(*by, F.abs("_d"))
    nz = d.filter("_d <> 0").withColumn("_t", F.count("*").over(same)).withColumn("_r", F.rank().over(rank) + (F.col("_t") - 1) / 2)
    stats = nz.groupBy(*by).agg(F.count("*").alias("nonzero"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("_m"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties"))
    rows = d.groupBy(*by).agg(F.count("*").alias("n")).join(stats, by, "left")
    rows = rows.select(*by, "n", F.coalesce("nonzero", F.lit(0)).alias("nonzero"), F.coalesce(F.least("_p", "_m"), F.lit(0.0)).alias("w"), F.coalesce("ties", F.lit(0.0)).alias("ties"))

    @F.pandas_udf("struct<z:double,p:double>")
    def test(n: pd.Series, m: pd.Series, w: pd.Series, ties: pd.Series) -> pd.DataFrame:
        out = []
        for total, k, stat, t in zip(n, m, w, ties, strict=True):
            if not k:
                out.append((0.0, 1.0))
                continue
            z = (stat - k * (k + 1) / 4) / math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - t / 48)
            exact = total <= 50 and k == total and t == 0
            out.append((z, exact_wilcoxon_p(int(k), stat) if exact else math.erfc(abs(z) / math.sqrt(2))))
        return pd.DataFrame(out, columns=["z", "p"])

    return rows.withColumn("t", test("n", "nonzero", "w", "ties")).select(*by, "n", "nonzero", "w", "t.z", "t.p")


def student_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, pearson_r, pearson_p, spearman_r, spearman_p); null where a side does not vary."""

    def rank(c: str):
        return F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2

    def r(a: str, b: str):
        cov = F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)
        spread = F.sqrt(F.greatest(F.avg(F.col(a) * F.col(a)) - F.avg(a) * F.avg(a), F.lit(0.0))) * F.sqrt(F.greatest(F.avg(F.col(b) * F.col(b)) - F.avg(b) * F.avg(b), F.lit(0.0)))
        return F.try_divide(cov, spread)

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v or k < 3 else 0.0 if abs(v) >= 1 else student_tail(v * math.sqrt((k - 2) / (1 - v * v)), k - 2) for v, k in zip(r, n, strict=True)], dtype="float64")

    ranked = pairs.filter("o is not null and w is not null").withColumn("_ro", rank("o").cast("double")).withColumn("_rw", rank("w").cast("double"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), r("o", "w").alias("pearson_r"), r("_ro", "_rw").alias("spearman_r"))
    return out.select(*by, "n", "pearson_r", p("pearson_r", "n").alias("pearson_p"), "spearman_r", p("spearman_r", "n").alias("spearman_p"))
