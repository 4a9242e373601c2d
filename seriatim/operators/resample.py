"""Bootstrap of clusters from their additive sums, with weights that every engine can repeat.

In a replicate each cluster counts as often as a Poisson number of mean one says, which a hash of
the cluster's key and the replicate gives; this is drawing with replacement but for the total
number of clusters, which then varies too. Means, slopes and their ratios are functions of sums
per cluster, so a replicate is a weighted sum of cluster rows: a task adds up its own clusters
for all replicates as one matrix product, and only one row per task and replicate is moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters weighed at once.
AT_ONCE = 512
#: Odd multipliers of the hash, and the 32-bit bounds at which the Poisson number grows by one.
FACTORS = (0x9E3779B1, 0x85EBCA6B, 0x7FEB352D, 0x846CA68B)
BOUNDS = [int(2**32 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(9)]


def weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson numbers (keys, replicates) of mean one."""
    low = np.uint64(0xFFFFFFFF)
    a, b, c, d = (np.uint64(f) for f in FACTORS)
    x = ((keys.astype(np.uint64) & low)[:, None] * a + replicates.astype(np.uint64)[None, :] * b) & low
    x ^= x >> np.uint64(16)
    x = (x * c) & low
    x ^= x >> np.uint64(15)
    x = (x * d) & low
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(BOUNDS, np.uint64), x, side="right")


def numbered_clusters(df: DataFrame, cluster: str, sums: Sequence[Column]) -> DataFrame:
    """Sums per cluster with k, the key that its weights follow from: the cluster's own where it is a whole number, else a hash."""
    per = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*sums)
    whole = dict(per.dtypes)[cluster] in ("bigint", "int", "smallint", "tinyint")
    return per.withColumn("k", F.col(cluster).cast("bigint") if whole else F.xxhash64(cluster))


def _weighted(columns: list[str], replicates: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = np.arange(replicates)
        total = np.zeros((replicates, len(columns)))
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                w = np.ascontiguousarray(weights(part.column("k").to_numpy(), rep).T, float)
                for i, c in enumerate(columns):  # one by one, so that equal columns have equal sums to the last bit
                    total[:, i] += w @ np.nan_to_num(part.column(c).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int64)), *(pa.array(total[:, i]) for i in range(len(columns)))], ["rep", *columns])

    return of


def replicate(per: DataFrame, replicates: int, key: str = "") -> DataFrame:
    """Every replicate's weighted sums of the cluster columns (key, the cluster itself, apart): rep and the columns; nulls add nothing."""
    columns = [c for c, t in per.dtypes if c not in ("k", key) and t in ("bigint", "double", "int")]
    sums = per.select("k", *columns).mapInArrow(_weighted(columns, replicates), "rep bigint, " + ", ".join(f"`{c}` double" for c in columns))
    return sums.groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def slope_of(prefix_y: str, n: str = "n", sx: str = "sx", sxx: str = "sxx") -> Column:
    """Slope of y on x from sums: columns n, sx, sxx, sy_<y>, sxy_<y>."""
    xx = F.col(sxx) - F.col(sx) * F.col(sx) / F.col(n)
    return (F.col(f"sxy_{prefix_y}") - F.col(sx) * F.col(f"sy_{prefix_y}") / F.col(n)) / F.nullif(xx, F.lit(0.0))


def sums_for(x: str, ys: Sequence[str]) -> list[Column]:
    """Cluster sums that slopes of several outcomes on one regressor need; paired, as rows are the same."""
    X = F.col(x).cast("double")
    out = [F.count("*").alias("n"), F.sum(X).alias("sx"), F.sum(X * X).alias("sxx")]
    for y in ys:
        out += [F.sum(F.col(y).cast("double")).alias(f"sy_{y}"), F.sum(X * F.col(y).cast("double")).alias(f"sxy_{y}")]
    return out


def interval(reps: DataFrame, value: Column, name: str, point: float | None = None) -> DataFrame:
    """Percentile interval, bootstrap SD and P (twice the smaller tail, at least 1/B, at most 1).

    One value per replicate, a bounded number, so the percentile buffer is bounded too.
    """
    v = reps.select(value.alias("v")).where("v is not null")
    tail = F.least(F.avg((F.col("v") <= 0).cast("double")), F.avg((F.col("v") >= 0).cast("double")))
    a = v.agg(F.count("*").alias("b"), F.expr("percentile(v, 0.025)").alias("lo"), F.expr("percentile(v, 0.975)").alias("hi"), F.stddev_samp("v").alias("sd"), F.least(F.lit(1.0), F.greatest(2 * tail, 1 / F.count("*"))).alias("p"))
    return a.select(F.lit(name).alias("contrast"), F.lit(point).cast("double").alias("point"), "b", "lo", "hi", "sd", "p")


def paired_slopes(df: DataFrame, x: str, a: str, b: str, cluster: str, replicates: int = 2000) -> DataFrame:
    """The difference of two outcomes' slopes on the same rows, absolute and relative to the outcome's mean at x = 1.

    Rows with a null in any column are left out, so both slopes see the same rows in each replicate.
    """
    rows = df.select(x, a, b, cluster).dropna()
    at1 = [F.sum(F.when(F.col(x) == 1, F.col(y).cast("double")).otherwise(0.0)).alias(f"s1_{y}") for y in (a, b)] + [F.sum((F.col(x) == 1).cast("bigint")).alias("n1")]
    per = numbered_clusters(rows, cluster, [*sums_for(x, [a, b]), *at1])
    reps = replicate(per, replicates, cluster)
    rel = lambda y: slope_of(y) / F.nullif(F.col(f"s1_{y}") / F.nullif(F.col("n1"), F.lit(0)), F.lit(0.0))
    absolute, relative = slope_of(b) - slope_of(a), rel(b) - rel(a)
    whole = per.agg(*[F.sum(c).alias(c) for c, t in per.dtypes if c not in ("k", cluster)]).select(absolute.alias("abs"), relative.alias("rel")).first()
    return interval(reps, absolute, "absolute", whole["abs"]).unionByName(interval(reps, relative, "relative", whole["rel"]))


def cluster_mean(df: DataFrame, y: str, cluster: str, replicates: int = 2000) -> DataFrame:
    """Mean with its cluster-bootstrap interval."""
    rows = df.select(y, cluster).dropna()
    per = numbered_clusters(rows, cluster, [F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("sy")])
    whole = per.agg(F.sum("sy") / F.sum("n")).first()[0]
    return interval(replicate(per, replicates, cluster), F.col("sy") / F.col("n"), "mean", whole)
