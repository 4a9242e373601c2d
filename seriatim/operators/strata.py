"""Strata by value and by rank, matching and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.operators.ranking import quantiles, ranked, ranked_within


def bins_by_value(df: DataFrame, value: str, k: int = 4, name: str = "bin") -> DataFrame:
    """Quantile bins by value: equal edges are one edge, bins are closed on the right, the lowest value is in bin 1.

    Null values have no bin.
    """
    edges = sorted(set(quantiles(df, value, [i / k for i in range(k + 1)])))
    inner = edges[1:-1]
    b = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in inner), F.lit(1))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), b))


def bins_by_rank(df: DataFrame, value: str, key: str, k: int = 4, name: str = "bin") -> DataFrame:
    """Quantile bins of the rank, ties in order of the key: bin sizes differ by one at most."""
    known = df.where(F.col(value).isNotNull())
    n = known.count()
    r = ranked(known, [value, key], "_r")
    b = F.greatest(F.lit(1), F.ceil(F.lit(k) * (F.col("_r") - 1) / F.lit(max(1, n - 1))))
    return r.withColumn(name, b.cast("int")).drop("_r")


def lottery(seed: str, key: str) -> Column:
    """A reproducible order that every engine can make: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def equal_n(df: DataFrame, stratum: str | list[str], key: str, n: int | None = None, seed: str = "s") -> DataFrame:
    """The same number of rows of every stratum (the smallest stratum's, or n), drawn without replacement.

    Rows without a stratum belong to none and are left out.
    """
    by = [stratum] if isinstance(stratum, str) else stratum
    if n is None:
        n = df.dropna(subset=by).groupBy(*by).count().agg(F.min("count")).first()[0] or 0
    known = df.dropna(subset=by).withColumn("_l", lottery(seed, key))
    return ranked_within(known, by, ["_l", key], "_k").where(F.col("_k") <= n).drop("_l", "_k")


def matched(df: DataFrame, stratum: str, covariate: str, key: str, k: int = 10, seed: str = "s") -> DataFrame:
    """Coarsened exact matching: in every quantile bin of the covariate that holds all strata, equally many of each stratum."""
    binned = bins_by_value(df, covariate, k, "_bin").where(F.col("_bin").isNotNull() & F.col(stratum).isNotNull())
    strata = df.select(stratum).dropna().distinct().count()
    cells = binned.groupBy("_bin", stratum).count()
    take = cells.groupBy("_bin").agg(F.min("count").alias("_take"), F.count("*").alias("_has")).where(F.col("_has") == strata).select("_bin", "_take")
    drawn = ranked_within(binned.withColumn("_l", lottery(seed, key)), ["_bin", stratum], ["_l", key], "_k").join(F.broadcast(take), "_bin").where("_k <= _take")  # k rows of take
    return drawn.withColumnRenamed("_bin", "bin").drop("_take", "_l", "_k")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Crosstab of two binnings with the share of rows on which they agree."""
    total = F.sum("n").over(Window.partitionBy())
    same = F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).over(Window.partitionBy())
    return df.groupBy(a, b).agg(F.count("*").alias("n")).withColumn("agree", same / total)
