"""Analyses over stored outcomes: summaries, conditioning, contrasts, sensitivity and decision rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.functions.stats import normal_p
from seriatim.operators import infer, relational, resample, strata
from seriatim.session import partitions


def series(df: DataFrame, y: str, stratum: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: q1..q4 means, decline (q4 - q1) / q1, slope with CR1 error, relative slope (slope / q1 mean)."""
    key = list(by)
    means = df.groupBy(*key).agg(*[F.avg(F.when(F.col(stratum) == q, F.col(y).cast("double"))).alias(f"q{q}") for q in (1, 2, 3, 4)])
    s = infer.slope(df, y, stratum, cluster, key)
    j = means.join(s, key) if key else means.crossJoin(s)  # one row each
    q1 = F.nullif("q1", F.lit(0.0))
    return j.select(*key, "n", "clusters", "q1", "q2", "q3", "q4", ((F.col("q4") - F.col("q1")) / q1).alias("decline"), "beta", "se", "z", (F.col("beta") / q1).alias("relative"))


def reference(mean: float, pool: int, cutoff: int = 10) -> dict:
    """A mean reciprocal rank against random ranking, H(cutoff) / pool: its multiple, and whether it is on the floor (<2) or weak (<10)."""
    random = sum(1 / i for i in range(1, min(cutoff, pool) + 1)) / pool
    times = mean / random
    return {"random": random, "multiple": times, "flag": relational.verdict(times, [(2, "floor"), (10, "weak")], "ok")}


def mediation(df: DataFrame, y: str, stratum: str, mediator: str, cluster: str, collinear: float = 0.8) -> dict:
    """The stratum's slope alone, the mediator's alone, and both together, with their correlation."""
    rows = df.select(y, stratum, mediator, cluster).dropna()
    facts = rows.agg(F.avg(mediator).alias("m"), F.stddev_pop(mediator).alias("s"), F.corr(stratum, mediator).alias("r")).first()
    if not facts["s"]:
        return {"stratum": None, "mediator": None, "joint": None, "attenuation": None, "correlation": None, "collinear": None}
    z = rows.withColumn("_z", (F.col(mediator) - facts["m"]) / facts["s"])
    alone, other, both = (infer.ols(z, y, x, cluster) for x in ([stratum], ["_z"], [stratum, "_z"]))
    return {"stratum": float(alone.beta[1]), "mediator": float(other.beta[1]), "joint": [float(b) for b in both.beta[1:]], "attenuation": infer.attenuation(alone.beta[1], both.beta[1]), "correlation": facts["r"], "collinear": abs(facts["r"]) > collinear}


def adjusted(df: DataFrame, y: str, stratum: str, cluster: str, flags: Sequence[str] = (), durations: Sequence[str] = (), category: str | None = None) -> dict:
    """The stratum's slope before and after terms that follow from it (mediators): flags, log durations, and a category.

    A missing duration is filled with the median before log(1 + x); a category becomes dummies
    but for its first value. attenuation is signed, in percent.
    """
    middle = df.agg(*[F.median(c).alias(c) for c in durations]).first() if durations else {}
    columns = {f"_f{i}": F.col(c).cast("double") for i, c in enumerate(flags)} | {f"_d{i}": F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(middle[c]))) for i, c in enumerate(durations)}
    if category:
        names = sorted(r[0] for r in df.select(category).dropna().distinct().collect())  # a handful of groups
        columns |= {f"_c{i}": F.coalesce((F.col(category) == n).cast("double"), F.lit(0.0)) for i, n in enumerate(names[1:])}
    rows = df.select(y, stratum, cluster, *[c.alias(n) for n, c in columns.items()])
    before, after = infer.ols(rows, y, [stratum], cluster), infer.ols(rows, y, [stratum, *columns], cluster)
    share = infer.attenuation(before.beta[1], after.beta[1], signed=True)
    return {"before": float(before.beta[1]), "after": float(after.beta[1]), "se": float(np.sqrt(after.cov[1, 1])), "attenuation": None if share is None else 100 * share, "n": after.n}


def by_condition(outcomes, sets: dict[str, DataFrame], name: str = "condition") -> DataFrame:
    """The outcomes of several query sets on one fixed index, labelled; outcomes takes a query set."""
    parts = [outcomes(q).withColumn(name, F.lit(label)) for label, q in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reading(rho: float | None) -> str:
    """How an activity correlation is read."""
    return relational.verdict(None if rho is None else abs(rho), [(0.20, "weak"), (0.45, "moderate")], "strong")


def retrievers(outcomes: DataFrame, y: str, model: str, stratum: str, cluster: str, categorical: bool = False) -> tuple[infer.Fit, tuple[float, int, float]]:
    """Stacked outcomes with fixed effects of the models and their interaction with the stratum; the Wald test of all interactions."""
    names = sorted(r[0] for r in outcomes.select(model).distinct().collect())  # the models: a handful
    levels = (2, 3, 4) if categorical else (None,)
    x = {(q or 1): (F.col(stratum) == q).cast("double") if q else F.col(stratum).cast("double") for q in levels}
    columns = {f"x{q}": c for q, c in x.items()}
    for i, n in enumerate(names[1:]):
        own = (F.col(model) == n).cast("double")
        columns[f"m{i}"] = own
        columns |= {f"m{i}x{q}": own * c for q, c in x.items()}
    fit = infer.ols(outcomes.select(y, cluster, *[c.alias(n) for n, c in columns.items()]), y, list(columns), cluster)
    inter = [k for k, n in enumerate(fit.names) if n.startswith("m") and "x" in n]
    r = np.zeros((len(inter), len(fit.names)))
    r[range(len(inter)), inter] = 1
    return fit, infer.wald(fit, r)


def exposures_compared(df: DataFrame, y: str, a: str, b: str, cluster: str, replicates: int = 2000) -> DataFrame:
    """The difference of the slopes on two exposures over identical rows, by cluster bootstrap."""
    Y, A, B = (F.col(c).cast("double") for c in (y, a, b))
    rows = df.select(y, a, b, cluster).dropna()
    sums = [F.count("*").alias("n"), F.sum(Y).alias("sy"), *[f for n, x in (("a", A), ("b", B)) for f in (F.sum(x).alias(f"sx_{n}"), F.sum(x * x).alias(f"sxx_{n}"), F.sum(x * Y).alias(f"sxy_{n}"))]]
    per = resample.numbered_clusters(rows, cluster, sums)
    slope = lambda n: (F.col(f"sxy_{n}") - F.col(f"sx_{n}") * F.col("sy") / F.col("n")) / F.nullif(F.col(f"sxx_{n}") - F.col(f"sx_{n}") * F.col(f"sx_{n}") / F.col("n"), F.lit(0.0))
    point = per.agg(*[F.sum(c).alias(c) for c, t in per.dtypes if c not in ("k", cluster)]).select((slope("b") - slope("a")).alias("d")).first()["d"]
    return resample.interval(resample.replicate(per, replicates, cluster), slope("b") - slope("a"), "b - a", point)


def best_in_replicate(df: DataFrame, reference_y: str, others: Sequence[str], cluster: str, replicates: int = 2000) -> DataFrame:
    """A mean against the best of several others, the best chosen anew in each replicate."""
    rows = df.select(reference_y, *others, cluster).dropna()
    per = resample.numbered_clusters(rows, cluster, [F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in (reference_y, *others)]])
    best = F.greatest(*[F.col(f"s_{c}") for c in others]) if len(others) > 1 else F.col(f"s_{others[0]}")
    value = (F.col(f"s_{reference_y}") - best) / F.col("n")
    point = per.agg(*[F.sum(c).alias(c) for c, t in per.dtypes if c not in ("k", cluster)]).select(value.alias("v")).first()["v"]
    return resample.interval(resample.replicate(per, replicates, cluster), value, "reference - best", point)


def _weighted_pairs(replicates: int):
    """Rows (part, key, y, x) in order of x -> for each replicate the weighted pairs in which a positive row ranks over a negative one of the part, and the part's weights."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = np.arange(replicates)
        won, pos, neg, own_pos, own_neg = (np.zeros(replicates) for _ in range(5))
        now, part = None, None

        def close() -> None:  # the rows of one score tie with each other
            nonlocal won, pos, neg, own_pos, own_neg
            won += own_pos * (neg + own_neg / 2)
            pos, neg = pos + own_pos, neg + own_neg
            own_pos, own_neg = np.zeros(replicates), np.zeros(replicates)

        for b in batches:
            x, y, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "k"))
            edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
            for lo, hi in zip(edge, [*edge[1:], len(x)]):
                if x[lo] != now:
                    close()
                now, part = x[lo], b.column("part")[0].as_py()
                for at in range(lo, hi, resample.AT_ONCE):
                    z = slice(at, min(hi, at + resample.AT_ONCE))
                    w = resample.weights(key[z], rep)
                    own_pos += y[z] @ w
                    own_neg += (1 - y[z]) @ w
        if part is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, part, np.int32)), pa.array(rep), pa.array(won), pa.array(pos), pa.array(neg)], ["part", "rep", "won", "pos", "neg"])

    return of


def auroc_interval(df: DataFrame, label: str, score: str, key: str, replicates: int = 2000) -> DataFrame:
    """AUROC with an interval by drawing rows, each by a weight from its key.

    Rows are range-partitioned by score. A part adds up its own pairs for all replicates; the
    pairs between parts follow from the parts' weights, one row per part and replicate.
    """
    rows = df.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("x")).dropna()
    placed = rows.repartitionByRange(partitions(df), "x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id())
    sums = placed.mapInArrow(_weighted_pairs(replicates), "part int, rep bigint, won double, pos double, neg double")
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    reps = sums.withColumn("won", F.col("won") + F.col("pos") * before).groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("won", "pos", "neg")])
    a = F.col("won") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0))
    return resample.interval(reps, a, "auroc", infer.auroc(rows, "y", "x").first()["auroc"])


def coverage(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Of each score part: how many rows have it, its share, and its mean points."""
    rows = ", ".join(f"'{p}', `{p}`" for p in parts)
    long = df.selectExpr(f"stack({len(parts)}, {rows}) as (part, v)")
    return long.groupBy("part").agg(F.count("v").alias("n"), F.avg(F.col("v").isNotNull().cast("double")).alias("share"), F.avg("v").alias("mean"))


def endpoints(df: DataFrame, quartile: str, event: str, duration: str) -> DataFrame:
    """Event share and duration median with quartiles, by quartile, and whether the share rises at each step."""
    e = df.where(F.col(quartile).isNotNull()).groupBy(F.col(quartile).alias("quartile")).agg(F.count("*").alias("n"), F.avg(F.col(event).cast("double")).alias("share"), *[F.percentile(duration, F.lit(p)).alias(c) for c, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))])
    return e.withColumn("rises", F.col("share") >= F.lag("share").over(Window.orderBy("quartile")))  # four rows


def without_part(df: DataFrame, key: str, score: str, part: str, k: int = 4) -> DataFrame:
    """Quartiles of a score and of the score without one part, by value, crosstabbed with their agreement."""
    a = strata.bins_by_value(df, score, k, "whole")
    b = strata.bins_by_value(a.withColumn("_rest", F.col(score) - F.coalesce(part, F.lit(0))), "_rest", k, "rest")
    return strata.agreement(b, "whole", "rest")


def draws_summary(slopes: Sequence[float]) -> dict:
    """Alternative draws: how many slopes are negative, their range, and the verdict."""
    share = sum(s < 0 for s in slopes) / len(slopes) if slopes else None
    return {"n": len(slopes), "negative": sum(s < 0 for s in slopes), "lo": min(slopes, default=None), "hi": max(slopes, default=None), "verdict": relational.verdict(None if share is None else -share, [(-0.9, "robust"), (-0.75, "mostly")], "fragile")}


def activity(df: DataFrame, pairs: Sequence[tuple[str, str]], least: int = 10) -> list[tuple[str, str, int, float | None]]:
    """Spearman correlations of column pairs; with ten pairs or fewer there is none."""
    out = []
    for a, b in pairs:
        r = infer.spearman(df, a, b).first()
        out.append((a, b, r["n"], r["rho"] if r["n"] > least else None))
    return out


def slope_p(beta: float, se: float) -> float | None:
    return normal_p(beta / se) if se else None
