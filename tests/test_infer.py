"""Statistics against numpy and planted effects."""

import math

import numpy as np
import pytest

from seriatim.functions.stats import adjusted_skew, chi2_sf, normal_p
from seriatim.operators import infer, ranking, resample, strata, studies


@pytest.mark.parametrize(("df", "x"), [(1, 3.8415), (2, 5.9915), (3, 7.8147), (4, 9.4877), (7, 14.0671)])
def test_chi_square_tail(df, x):
    assert chi2_sf(x, df) == pytest.approx(0.05, abs=2e-4)


def test_tails():
    assert normal_p(1.959963985) == pytest.approx(0.05) and normal_p(None) is None and chi2_sf(0, 3) == 1
    assert adjusted_skew(1.0, 10) == pytest.approx(math.sqrt(90) / 8)


def cr1(y, X, c):
    inv = np.linalg.pinv(X.T @ X)
    b = inv @ X.T @ y
    u = X * (y - X @ b)[:, None]
    S = np.array([u[c == g].sum(axis=0) for g in np.unique(c)])
    G, n, k = len(S), *X.shape
    return b, G / (G - 1) * (n - 1) / (n - k) * inv @ (S.T @ S) @ inv


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 600
    c = rng.integers(0, 90, n)
    x, z = rng.integers(1, 5, n).astype(float), rng.normal(size=n)
    y = 2 - 0.25 * x + 0.5 * z + rng.normal(size=90)[c] * 0.3 + rng.normal(size=n)
    hit = (rng.random(n) < 1 / (1 + np.exp(0.5 - 0.8 * (x - 2)))).astype(float)
    rows = [(*map(float, r), int(k)) for r, k in zip(zip(y, x, z, hit), c)] + [(None, 1.0, 1.0, 0.0, 1), (1.0, None, 1.0, 0.0, 2)]
    return spark.createDataFrame(rows, "y double, x double, z double, hit double, c bigint"), y, x, z, hit, c


def test_ols_and_slope(data):
    df, y, x, z, _, c = data
    b, v = cr1(y, np.column_stack([np.ones_like(x), x, z]), c)
    fit = infer.ols(df, "y", ["x", "z"], "c")
    assert fit.beta == pytest.approx(b) and fit.cov == pytest.approx(v)
    b, v = cr1(y, np.column_stack([np.ones_like(x), x]), c)
    s = infer.slope(df, "y", "x", "c").first()
    assert (s["beta"], s["se"]) == pytest.approx((b[1], math.sqrt(v[1, 1])))


def test_stratum_means(data):
    df, y, x, _, _, c = data
    got = {r["stratum"]: r for r in infer.stratum_means(df, "y", "x", "c").collect()}
    for q in (1, 2, 3, 4):
        m = x == q
        S = np.array([(y[m & (c == g)] - y[m].mean()).sum() for g in np.unique(c[m])])
        G, n = len(S), m.sum()
        assert (got[q]["mean"], got[q]["se"]) == pytest.approx((y[m].mean(), math.sqrt(G / (G - 1) * (n - 1) / (n - 2) * (S**2).sum()) / n))


def test_singleton_clusters_and_exact_fit(spark):
    rows = [(float(2 * i + 1), float(i % 4), i) for i in range(20)]
    df = spark.createDataFrame([(2 * b + 1.0, b, k) for _, b, k in rows], "y double, x double, c bigint")
    s = infer.slope(df, "y", "x", "c").first()
    assert s["beta"] == pytest.approx(2) and s["se"] == pytest.approx(0, abs=1e-9)
    twice = infer.slope(df.withColumn("y", df.y + (df.c % 3)).unionByName(df.withColumn("y", df.y + (df.c % 3))), "y", "x", "c").first()
    once = infer.slope(df.withColumn("y", df.y + (df.c % 3)), "y", "x", "c").first()
    assert twice["se"] > 0.95 * once["se"]


def _strata(spark, means, n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(float(m + rng.normal() * 0.1), q + 1, q * n + i) for q, m in enumerate(means) for i in range(n)]
    return spark.createDataFrame(rows, "y double, q int, c bigint")


def test_linearity(spark):
    assert infer.linearity(_strata(spark, [0.2, 0.15, 0.1, 0.05]), "y", "q", "c")[2] > 0.05
    assert infer.linearity(_strata(spark, [0.2, 0.1, 0.1, 0.1]), "y", "q", "c")[2] < 0.001


def test_series(spark):
    df = spark.createDataFrame([(m, q + 1, q * 50 + i) for q, m in enumerate([0.4, 0.35, 0.34, 0.33]) for i in range(50)], "y double, q int, c bigint")
    s = studies.series(df, "y", "q", "c").first()
    assert s["decline"] == pytest.approx(-0.175) and s["beta"] < 0


@pytest.mark.parametrize("ps", [[0.001, 0.02, 0.5], [0.003, 0.04, 0.5], [1e-4, 0.03, 0.9]])
def test_holm(spark, ps):
    df = spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double")
    got = [r["p_holm"] for r in infer.holm(df, "p").orderBy("p").collect() if r["p"] is not None]
    assert got == sorted(got) and max(got) <= 1
    assert got == pytest.approx(np.minimum(1, np.maximum.accumulate(np.sort(ps) * np.array([3, 2, 1]))))


def _logrank(spark, times):
    df = spark.createDataFrame([(float(t), g + 1) for g, ts in enumerate(times) for t in ts], "t double, g int")
    return infer.logrank(df, "t", "g", (1, 2, 3, 4)), infer.logrank_table(df, "t", "g").collect()


def test_logrank(spark):
    rng = np.random.default_rng(3)
    same = rng.integers(1, 500, 800)
    got, rows = _logrank(spark, [same] * 4)
    assert got["p"] > 0.05 and got["df"] == 3
    assert sum(r["expected"] for r in rows) == pytest.approx(3200) and sum(r["observed"] for r in rows) == 3200
    got, _ = _logrank(spark, [rng.integers(1, 500, 400) + 30 * g for g in range(4)])
    assert got["z"] < -3


def test_logit(data):
    df, _, x, _, hit, _ = data
    fit = infer.logit(df, "hit", "x", "c")
    p = 1 / (1 + np.exp(-(fit.beta[0] + fit.beta[1] * x)))
    assert abs((hit - p).sum()) < 2.5 and abs(((hit - p) * x).sum()) < 5 and fit.beta[1] > 0.4


def test_auroc(spark):
    a = lambda rows: infer.auroc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auroc"]
    assert a([(1, 2.0), (1, 3.0), (0, 1.0)]) == 1 and a([(1, 1.0), (0, 1.0), (0, 1.0)]) == 0.5 and a([(1, 1.0)]) is None


def test_eta2_sums_to_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(a, b, c, float(rng.normal() + a)) for a in range(3) for b in range(2) for c in range(4)], "a int, b int, c int, y double")
    assert sum(r["share"] for r in infer.eta2(df, "y", ["a", "b", "c"]).collect()) == pytest.approx(1)


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    rows = [(int(q), float(y), float(y), float(y - 0.04 * q), int(i // 2)) for i, (q, y) in enumerate(zip(rng.integers(1, 5, 800), rng.normal(1, 0.1, 800)))]
    df = spark.createDataFrame(rows, "q int, a double, same double, planted double, c bigint")
    same = resample.paired_slopes(df, "q", "a", "same", "c", 100).collect()
    assert all(r["point"] == 0 and r["lo"] == 0 and r["hi"] == 0 and r["p"] == 1 for r in same)
    planted = resample.paired_slopes(df, "q", "a", "planted", "c", 200).where("contrast = 'absolute'").first()
    assert planted["point"] == pytest.approx(-0.04) and planted["p"] <= 0.01


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(900, None)], "k int, v double")
    assert ranking.quantiles(df, "v", [0, 0.1, 0.25, 0.5, 0.99, 1]) == pytest.approx(np.quantile(v, [0, 0.1, 0.25, 0.5, 0.99, 1]).tolist())
    import pandas as pd

    want = pd.Series(v).rank()
    got = {r["k"]: r["midrank"] for r in ranking.mid_ranks(df, "v").collect()}
    assert got[900] is None and all(got[i] == want[i] for i in range(500))
    r = {x["k"]: x["rank"] for x in ranking.ranked(df, ["v", "k"]).collect()}
    assert sorted(r.values()) == list(range(1, 502))


@pytest.mark.parametrize("n", [4, 5, 6, 7, 97, 98, 99])
def test_rank_bins_equal_qcut(spark, n):
    import pandas as pd

    want = pd.qcut(pd.Series(range(n)).rank(method="first"), 4, labels=False) + 1
    df = spark.createDataFrame([(i, float(i // 3)) for i in range(n)], "k int, v double")
    got = {r["k"]: r["bin"] for r in strata.bins_by_rank(df, "v", "k").collect()}
    assert [got[i] for i in range(n)] == want.tolist()


def test_value_bins_equal_qcut(spark):
    import pandas as pd

    v = np.round(np.random.default_rng(7).exponential(size=300), 0)
    want = pd.qcut(pd.Series(v), 4, labels=False, duplicates="drop") + 1
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k int, v double")
    got = {r["k"]: r["bin"] for r in strata.bins_by_value(df, "v").collect()}
    assert [got[i] for i in range(300)] == want.tolist()


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(100)], "k int, s int, v double")
    n = strata.equal_n(df, "s", "k").groupBy("s").count().collect()
    assert {r["count"] for r in n} == {33}
    m = strata.matched(df.where("s < 2 or v < 50"), "s", "v", "k", 5)
    assert all(r["lo"] == r["hi"] for r in m.groupBy("bin", "s").count().groupBy("bin").agg({"count": "min", "s": "count"}).withColumnRenamed("min(count)", "lo").withColumn("hi", __import__("pyspark").sql.functions.col("lo")).collect())
    assert m.groupBy("bin").agg({"s": "max"}).count() < 5


def test_studies(data):
    df = data[0]
    m = studies.mediation(df, "y", "x", "z", "c")
    assert m["stratum"] == pytest.approx(-0.25, abs=0.15) and not m["collinear"]
    assert studies.reference(0.5, 100)["flag"] == "ok" and studies.reference(0.03, 100)["flag"] == "floor"
    assert studies.draws_summary([-1, -2, -3, 4] * 5)["verdict"] == "fragile" and studies.draws_summary([-1] * 20)["verdict"] == "robust"
    fits = infer.conditioned(df, "y", "x", ["z"], "c")
    assert [f["given"] for f in fits] == ["none", "z"]
    assert infer.conditioned(df, "y", "x", ["z"], "c", least=10_000)[1]["beta"] is None
    assert dict(infer.inflation(df, ["x", "z"]))["x"] == pytest.approx(1, abs=0.05)


def test_poisson_weights_draw_with_replacement():
    import numpy as np

    w = resample.weights(np.arange(3000), np.arange(400))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 5
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_adjusted_for_a_category(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(900):
        q, c = 1 + i % 4, rng.choice("abc")
        rows.append((2.0 * q + {"a": 0, "b": 5, "c": -3}[c] + rng.random(), q, i // 2, c, int(rng.random() < 0.3), None if i % 7 == 0 else float(i % 11)))
    from seriatim.operators import studies

    df = spark.createDataFrame(rows, "y double, q int, p int, c string, died int, los double")
    got = studies.adjusted(df, "y", "q", "p", ["died"], ["los"], "c")
    assert got["n"] == 900 and abs(got["after"] - 2) < 0.05 and got["se"] < 0.05
    assert studies.reading(0.1) == "weak" and studies.reading(-0.3) == "moderate" and studies.reading(0.9) == "strong" and studies.reading(None) == "not available"
