"""Cluster-robust inference from additive sums per cluster.

Everything here is one aggregation per cluster and algebra on matrices of a few columns: with
X'X and X'y of each cluster, the coefficients are (sum X'X)^-1 sum X'y and a cluster's score is
X'y - X'X b, so no second pass over rows is needed for the sandwich. Cluster sums are reduced
again on the cluster side (sum of outer products of scores), so the driver sees k x k numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.functions.stats import Z95, chi2_sf, normal_p
from seriatim.operators.ranking import cumulative
from seriatim.session import cut


#: Most different values of a logistic regressor.
CELLS = 100_000


@dataclass
class Fit:
    """Coefficients with their cluster-robust (CR1) covariance."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int

    def table(self, z: float = Z95) -> list[tuple]:
        """(name, beta, se, z, p, lo, hi) of each coefficient."""
        out = []
        for i, name in enumerate(self.names):
            se = float(np.sqrt(max(self.cov[i, i], 0)))
            t = float(self.beta[i]) / se if se > 0 else None
            out.append((name, float(self.beta[i]), se, t, normal_p(t), float(self.beta[i]) - z * se, float(self.beta[i]) + z * se))
        return out


def _product_sums(xs: Sequence[Column], y: Column) -> list[Column]:
    k = len(xs)
    return [F.sum(xs[i] * xs[j]).alias(f"xx{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(xs[i] * y).alias(f"xy{i}") for i in range(k)] + [F.count("*").alias("n")]


def ols(df: DataFrame, y: str, regressors: Sequence[str], cluster: str, intercept: bool = True) -> Fit:
    """Least squares with CR1 covariance, factor G/(G-1) * (n-1)/(n-k); rows with a null are left out."""
    names = (["const"] if intercept else []) + list(regressors)
    rows = df.select(F.col(y).cast("double").alias("_y"), F.col(cluster).alias("_c"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(regressors)]).dropna()
    xs = ([F.lit(1.0)] if intercept else []) + [F.col(f"_x{i}") for i in range(len(regressors))]
    k = len(xs)
    per = rows.groupBy("_c").agg(*_product_sums(xs, F.col("_y"))).cache()
    total = per.agg(*[F.sum(c).alias(c) for c in per.columns if c != "_c"], F.count("*").alias("g")).first()
    if not total["n"]:
        per.unpersist()
        return Fit(names, np.full(k, np.nan), np.full((k, k), np.nan), 0, 0)
    xx = np.array([[total[f"xx{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(xx)
    beta = inverse @ np.array([total[f"xy{i}"] for i in range(k)])
    score = [F.col(f"xy{i}") - sum((F.col(f"xx{min(i, j)}_{max(i, j)}") * float(beta[j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
    sums = per.select(*[s.alias(f"u{i}") for i, s in enumerate(score)]).agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    per.unpersist()
    meat = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n, g = int(total["n"]), int(total["g"])
    factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else float("nan")
    return Fit(names, beta, factor * inverse @ meat @ inverse, n, g)


def dummies(df: DataFrame, stratum: str, levels: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """Indicator columns of the levels."""
    names = [f"{stratum}_{v}" for v in levels]
    return df.select("*", *[(F.col(stratum) == v).cast("int").alias(c) for v, c in zip(levels, names)]), names


def wald(fit: Fit, restrictions: np.ndarray) -> tuple[float, int, float]:
    """Wald statistic of R b = 0, its degrees of freedom and P."""
    r = restrictions @ fit.beta
    m = restrictions @ fit.cov @ restrictions.T
    w = max(float(r @ np.linalg.pinv(m) @ r), 0.0)
    return w, len(restrictions), chi2_sf(w, len(restrictions))


def linearity(df: DataFrame, y: str, stratum: str, cluster: str) -> tuple[float, int, float]:
    """Whether four stratum means lie on a line: b3 = 2 b2 and b4 = 3 b2."""
    d, names = dummies(df, stratum, (2, 3, 4))
    fit = ols(d, y, names, cluster)
    return wald(fit, np.array([[0, -2.0, 1, 0], [0, -3.0, 0, 1]]))


def contrasts(df: DataFrame, y: str, stratum: str, cluster: str, levels: Sequence[int] = (2, 3, 4)) -> list[tuple]:
    """Difference of each level's mean from the first stratum's, from one model with a dummy for each: (level, beta, se, z)."""
    d, names = dummies(df.where(F.col(stratum).isin(1, *levels)), stratum, levels)
    return [(level, beta, se, z) for level, (_, beta, se, z, *_) in zip(levels, ols(d, y, names, cluster).table()[1:])]


def slope(df: DataFrame, y: str, x: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Univariate slope with CR1 standard error, all in SQL: by columns, n, clusters, beta, se, z.

    The regressor is centred in every group first, so one more aggregation per cluster gives the score.
    """
    key = list(by)
    rows = df.select(*key, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"), F.col(cluster).alias("_c")).dropna(subset=["_y", "_x", "_c"])
    per = rows.groupBy(*key, "_c").agg(F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"))
    t = per.groupBy(*key).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")], F.count("*").alias("g"))
    mean_x, mean_y = F.col("t_sx") / F.col("t_n"), F.col("t_sy") / F.col("t_n")
    t = t.withColumn("xx", F.col("t_sxx") - F.col("t_sx") * mean_x).withColumn("beta", (F.col("t_sxy") - F.col("t_sx") * mean_y) / F.nullif("xx", F.lit(0.0)))
    t = t.withColumn("mx", mean_x).withColumn("alpha", mean_y - F.col("beta") * mean_x)
    joined = per.join(t, key) if key else per.crossJoin(F.broadcast(t))  # without groups one row of totals
    score = F.col("sxy") - F.col("alpha") * F.col("sx") - F.col("beta") * F.col("sxx") - F.col("mx") * (F.col("sy") - F.col("alpha") * F.col("n") - F.col("beta") * F.col("sx"))
    out = joined.withColumn("u", score).groupBy(*key, "t_n", "g", "xx", "beta").agg(F.sum(F.col("u") * F.col("u")).alias("meat"))
    factor = F.col("g") / F.nullif(F.col("g") - 1, F.lit(0)) * (F.col("t_n") - 1) / F.nullif(F.col("t_n") - 2, F.lit(0))
    se = F.sqrt(factor * F.col("meat")) / F.col("xx")
    return out.select(*key, F.col("t_n").alias("n"), F.col("g").alias("clusters"), "beta", se.alias("se"), (F.col("beta") / F.nullif(se, F.lit(0.0))).alias("z"))


def stratum_means(df: DataFrame, y: str, stratum: str, cluster: str, within: bool = True, strata: int = 4) -> DataFrame:
    """Mean of each stratum with CR1 standard error: stratum, n, clusters, mean, se.

    within: the small-sample factor uses the stratum's own clusters and (n-1)/(n-2); else the
    clusters and rows of all strata and (n-1)/(n-k) with k strata.
    """
    rows = df.select(F.col(stratum).alias("stratum"), F.col(y).cast("double").alias("_y"), F.col(cluster).alias("_c")).dropna()
    per = rows.groupBy("stratum", "_c").agg(F.count("*").alias("n"), F.sum("_y").alias("sy"))
    t = per.groupBy("stratum").agg(F.sum("n").alias("tn"), F.sum("sy").alias("tsy"), F.count("*").alias("g"))
    u = F.col("sy") - F.col("n") * F.col("tsy") / F.col("tn")
    m = per.join(t, "stratum").groupBy("stratum", "tn", "tsy", "g").agg(F.sum(u * u).alias("meat"))
    if within:
        factor = F.col("g") / F.nullif(F.col("g") - 1, F.lit(0)) * (F.col("tn") - 1) / F.nullif(F.col("tn") - 2, F.lit(0))
    else:
        every = rows.agg(F.count("*").alias("N"), F.count_distinct("_c").alias("G")).first()
        factor = F.lit(every["G"] / (every["G"] - 1) * (every["N"] - 1) / (every["N"] - strata))
    return m.select("stratum", F.col("tn").alias("n"), F.col("g").alias("clusters"), (F.col("tsy") / F.col("tn")).alias("mean"), (F.sqrt(factor * F.col("meat")) / F.col("tn")).alias("se"))


def holm(df: DataFrame, p: str, family: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Holm-adjusted P within each family (one row per test, so a family is small); null P are left as null."""
    whole = Window.partitionBy(*family)
    order = whole.orderBy(F.col(p).asc_nulls_last())
    step = (F.count(p).over(whole) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_s", F.when(F.col(p).isNotNull(), step)).withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_s").over(order)))).drop("_s")


def _logrank_sums(df: DataFrame, time: str, group: str) -> tuple[list, dict]:
    """Groups, and the sums over distinct times: totals, expected counts and covariances."""
    rows = df.select(F.col(time).alias("t"), F.col(group).alias("g")).dropna()
    groups = sorted(r["g"] for r in rows.select("g").distinct().collect())  # the strata: a handful
    k = range(len(groups))
    d = [F.sum(F.when(F.col("g") == v, 1).otherwise(0)).alias(f"d{i}") for i, v in zip(k, groups)]
    c = cut(cumulative(rows, "t", *d, running=[f"d{i}" for i in k]))
    total = c.agg(F.sum("n").alias("N"), *[F.sum(f"d{i}").alias(f"N{i}") for i in k]).first().asDict()
    risk = F.lit(total["N"] or 0) - F.col("below")
    own = [F.lit(total[f"N{i}"]) - F.col(f"below_d{i}") for i in k]
    f = F.when(risk > 1, F.col("n") * (risk - F.col("n")) / (risk - 1) / (risk * risk)).otherwise(0.0)
    e = [F.sum(F.col("n") * own[i] / risk).alias(f"e{i}") for i in k]
    v = [F.sum(f * own[i] * (risk - own[i] if i == j else -own[j])).alias(f"v{i}_{j}") for i in k for j in k if i <= j]
    return groups, total | (c.agg(*e, *v).first().asDict() if groups else {})


def logrank_table(df: DataFrame, time: str, group: str) -> DataFrame:
    """Mantel-Cox sums of uncensored times: stratum, n, observed, expected, variance (own diagonal entry).

    Times are reduced to counts per distinct time and group; the at-risk numbers are running sums
    over distinct times in range partitions.
    """
    groups, s = _logrank_sums(df, time, group)
    rows = [(g, int(s[f"N{i}"]), float(s[f"N{i}"]), float(s[f"e{i}"]), float(s[f"v{i}_{i}"])) for i, g in enumerate(groups)]
    return df.sparkSession.createDataFrame(rows, "stratum int, n bigint, observed double, expected double, variance double")


def logrank(df: DataFrame, time: str, group: str, scores: Sequence[float] | None = None) -> dict:
    """k-sample log-rank: x2, df, p, and with scores the trend z and its P."""
    groups, s = _logrank_sums(df, time, group)
    k = len(groups)
    gap = np.array([s[f"N{i}"] - s[f"e{i}"] for i in range(k)], float)
    v = np.array([[s[f"v{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    x2 = float(gap[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ gap[:-1])
    out = {"x2": x2, "df": k - 1, "p": chi2_sf(x2, k - 1), "z": None, "p_trend": None}
    if scores is not None:
        w = np.asarray(scores, float)
        spread = float(w @ v @ w)
        if spread > 0:
            out["z"] = float(w @ gap) / spread**0.5
            out["p_trend"] = normal_p(out["z"])
    return out


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with mid-ranks: n1, n0, auroc (null if a class is empty)."""
    known = df.where(F.col(label).isNotNull())
    c = cumulative(known, score, F.sum(F.col(label).cast("int")).alias("pos"))
    rank = F.col("below") + (F.col("n") + 1) / 2
    t = c.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0"))
    return t.select("n1", "n0", ((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auroc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's correlation: Pearson's of mid-ranks; rows with a null are left out."""
    from seriatim.operators.ranking import mid_ranks

    both = df.select(a, b).dropna()
    r = mid_ranks(mid_ranks(both, a, "_ra"), b, "_rb")
    return r.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def kendall(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Kendall's tau-b over a table of a few rows (models, items), by its pairs; needs three rows."""
    x = df.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    y = x.select(F.col("k").alias("k2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    p = x.join(y, F.col("k") < F.col("k2"))
    s, t = F.signum(F.col("a") - F.col("a2")), F.signum(F.col("b") - F.col("b2"))
    return p.agg(F.count("*").alias("pairs"), F.when(F.count("*") >= 3, F.sum(s * t) / F.nullif(F.sqrt(F.sum(s * s) * F.sum(t * t)), F.lit(0.0))).alias("tau"))


def logit(df: DataFrame, y: str, x: str, cluster: str, rounds: int = 100) -> Fit:
    """Logistic regression on one regressor by reweighted least squares, with CR1 covariance.

    The likelihood needs only (x, n, sum y), so rows collapse to distinct x first: at most CELLS,
    as a stratum or a score has; more are an error.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(cluster).alias("c")).dropna()
    cells = rows.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("s")).limit(CELLS + 1).toPandas()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} different values of {x}: bin it first")
    X = np.column_stack([np.ones(len(cells)), cells["x"]])
    n, s = cells["n"].to_numpy(float), cells["s"].to_numpy(float)
    b = np.zeros(2)
    for _ in range(rounds):
        eta = np.clip(X @ b, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = n * np.maximum(p * (1 - p), 1e-10)
        new = np.linalg.pinv(X.T @ (X * w[:, None])) @ (X.T @ (w * eta + s - n * p))
        done, b = np.max(np.abs(new - b)) < 1e-11, new
        if done:
            break
    p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
    bread = np.linalg.pinv(X.T @ (X * (n * p * (1 - p))[:, None]))
    prob = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(b[0])) + F.col("x") * float(b[1])))))
    per = rows.withColumn("e", F.col("y") - prob).groupBy("c").agg(F.sum("e").alias("u0"), F.sum(F.col("e") * F.col("x")).alias("u1"), F.count("*").alias("n"))
    m = per.agg(F.sum(F.col("u0") * F.col("u0")).alias("a"), F.sum(F.col("u0") * F.col("u1")).alias("b"), F.sum(F.col("u1") * F.col("u1")).alias("d"), F.sum("n").alias("n"), F.count("*").alias("g")).first()
    factor = m["g"] / (m["g"] - 1) * (m["n"] - 1) / (m["n"] - 2)
    return Fit(["const", x], b, factor * bread @ np.array([[m["a"], m["b"]], [m["b"], m["d"]]]) @ bread, int(m["n"]), int(m["g"]))


def eta2(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Shares of the variance of cell means by three crossed factors: effect, share; the shares add up to 1.

    Cells are the combinations of the factors; every cell counts once.
    """
    a, b, c = factors
    cells = df.groupBy(a, b, c).agg(F.avg(y).alias("_m"))
    sets = cells.groupingSets([[], [a], [b], [c], [a, b], [a, c], [b, c], [a, b, c]], a, b, c).agg(F.grouping_id().alias("_g"), F.avg("_m").alias("_v"), F.count("*").alias("_n"))
    between = sets.groupBy("_g").agg(F.sum(F.col("_n") * F.col("_v") * F.col("_v")).alias("_q"))
    q = between.agg(*[F.sum(F.when(F.col("_g") == g, F.col("_q"))).alias(n) for n, g in (("q0", 7), ("qa", 3), ("qb", 5), ("qc", 6), ("qab", 1), ("qac", 2), ("qbc", 4), ("qabc", 0))])
    ss = {a: "qa - q0", b: "qb - q0", c: "qc - q0", f"{a}:{b}": "qab - qa - qb + q0", f"{a}:{c}": "qac - qa - qc + q0", f"{b}:{c}": "qbc - qb - qc + q0", f"{a}:{b}:{c}": "qabc - qab - qac - qbc + qa + qb + qc - q0"}
    rows = ", ".join(f"'{k}', ({v}) / nullif(qabc - q0, 0)" for k, v in ss.items())
    return q.select(F.expr(f"stack({len(ss)}, {rows}) as (effect, share)"))


def inflation(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    k = len(columns)
    got = rows.agg(*[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i in range(k) for j in range(i + 1, k)]).first()
    r = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            r[i, j] = r[j, i] = got[f"r{i}_{j}"]
    return list(zip(columns, np.diag(np.linalg.inv(r)).tolist()))


def attenuation(raw: float, adjusted: float, signed: bool = False) -> float | None:
    """Share of a slope that a covariate takes away: 1 - |adjusted| / |raw|, or signed."""
    if not raw:
        return None
    return float(1 - (adjusted / raw if signed else abs(adjusted) / abs(raw)))


def conditioned(df: DataFrame, y: str, x: str, covariates: Sequence[str], cluster: str, least: int = 200, sample_sd: bool = False) -> list[dict]:
    """The slope of x alone and given each covariate and all of them, on complete cases of standardised covariates.

    Covariates with fewer than `least` values or without spread are left out and reported as such.
    """
    sd = F.stddev_samp if sample_sd else F.stddev_pop
    facts = df.agg(*[f(c).alias(f"{n}_{c}") for c in covariates for n, f in (("n", F.count), ("m", F.avg), ("s", sd))]).first()
    usable = [c for c in covariates if facts[f"n_{c}"] > least and facts[f"s_{c}"]]
    rows = df.select(y, x, cluster, *[((F.col(c) - facts[f"m_{c}"]) / facts[f"s_{c}"]).alias(c) for c in usable]).dropna()
    base = ols(rows, y, [x], cluster)
    out = [{"given": "none", "beta": float(base.beta[1]), "se": float(np.sqrt(base.cov[1, 1])), "n": base.n, "attenuation": 0.0}]
    for name, given in [*[(c, [c]) for c in usable], *([("all", usable)] if len(usable) > 1 else [])]:
        f = ols(rows, y, [x, *given], cluster)
        out.append({"given": name, "beta": float(f.beta[1]), "se": float(np.sqrt(f.cov[1, 1])), "n": f.n, "attenuation": attenuation(base.beta[1], f.beta[1])})
    return out + [{"given": c, "beta": None, "se": None, "n": int(facts[f"n_{c}"]), "attenuation": None} for c in covariates if c not in usable]
