"""Lexical and dense ranks: hand values, tie rules, windows, self-retrieval."""

import math

import numpy as np
import pytest

from seriatim.operators import dense, lexical


def _docs(spark, docs):
    return spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "doc bigint, tokens array<string>")


def _asked(spark, rows):
    return spark.createDataFrame([(q, t, w.split()) for q, t, w in rows], "query bigint, target bigint, tokens array<string>")


def _one(spark, docs, query, **how):
    return lexical.outcomes(_docs(spark, docs), _asked(spark, [(7, *query)]), **how).first()


def test_hand_value(spark):
    docs = ["alpha x1", "alpha x2"] + [f"y{i} z{i}" for i in range(8)]
    r = _one(spark, docs, (0, "alpha"))
    assert r["target_score"] == pytest.approx(math.log(3.4)) and (r["n_above"], r["n_equal"]) == (0, 1)
    assert _one(spark, docs, (5, "alpha"))["target_score"] == 0 and _one(spark, docs, (5, "alpha"))["n_above"] == 2


def test_negative_idf_is_floored(spark):
    """x stands in nine of ten, q in all: both get one floor, above their raw value."""
    docs = [f"x q u{i}" for i in range(9)] + ["y q u9"]
    df, n, mean, average = lexical.statistics(_docs(spark, docs))
    a, b = _one(spark, docs, (0, "x"))["target_score"], _one(spark, docs, (0, "q"))["target_score"]
    assert a == pytest.approx(b) and a == pytest.approx(0.25 * average, abs=1e-8)


def test_repeated_terms(spark):
    docs = ["a b", "a c"] + [f"u{i} v{i}" for i in range(6)]
    twice, once = _one(spark, docs, (0, "a a"))["target_score"], _one(spark, docs, (0, "a a"), once=True)["target_score"]
    assert twice == pytest.approx(2 * once)


def test_tie_rules(spark):
    o = spark.createDataFrame([(1, 2, 5.0, 0, 1, 5.0), (2, 2, 5.0, 2, 0, 9.0), (3, 2, 1.0, 12, 0, 9.0)], "query bigint, target bigint, target_score double, n_above bigint, n_equal bigint, best_other double")
    rr = lambda ties: [r["rr"] for r in lexical.ranked(o, ties).orderBy("query").collect()]
    assert rr("optimistic") == pytest.approx([1, 1 / 3, 0]) and rr("pessimistic") == pytest.approx([1 / 2, 1 / 3, 0])


def test_window_of_the_whole_document(spark):
    docs = ["a b c d e", "b c d f g h", "a a k l"]
    for q in ((0, "a b"), (1, "b h"), (2, "l a")):
        assert _one(spark, docs, q) == _one(spark, docs, q, window=(10_000, 5_000), document_idf=True)


def test_empty_and_unknown(spark):
    docs = ["", "a b", "c d e"]
    r = _one(spark, docs, (0, "zzz"))
    assert r["target_score"] == 0 and r["n_equal"] == 2
    assert lexical.outcomes(_docs(spark, docs), _asked(spark, [(1, 99, "a")])).count() == 0


def test_windowed_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [" ".join(f"w{k}" for k in rng.integers(0, 40, rng.integers(1, 60))) for _ in range(30)]
    asked = [(i, i, " ".join(docs[i].split()[:6])) for i in range(30)]
    got = {r["query"]: r for r in lexical.outcomes(_docs(spark, docs), _asked(spark, asked), window=(16, 12)).collect()}
    from seriatim.operators.lexical import word_windows

    units = [(i, u) for i, d in enumerate(docs) for u in word_windows(d.split(), 16, 12)]
    n, mean = len(units), np.mean([len(u) for _, u in units])
    df = {t: sum(t in u for _, u in units) for _, x in units for t in x}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * np.mean(list(raw.values()))
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    for q, t, words in asked:
        best = {}
        for i, u in units:
            s = sum(idf[w] * u.count(w) * 2.5 / (u.count(w) + 1.5 * (0.25 + 0.75 * len(u) / mean)) for w in words.split() if w in idf)
            best[i] = max(best.get(i, -1e9), round(s, 9))
        assert got[q]["target_score"] == pytest.approx(best[t], abs=2e-9)
        assert abs(got[q]["n_above"] - sum(s > best[t] + 2e-9 for s in best.values())) <= sum(abs(s - best[t]) <= 4e-9 for s in best.values()) - 1


def _chunks(spark, v, doc, grp=None):
    return spark.createDataFrame([(int(d), None if grp is None else float(grp[i]), [float(x) for x in r]) for i, (d, r) in enumerate(zip(doc, v))], "doc bigint, grp double, v array<float>")


def _queries(spark, v, targets, grp=None):
    return spark.createDataFrame([(i, int(t), None if grp is None else float(grp[i]), [float(x) for x in r]) for i, (t, r) in enumerate(zip(targets, v))], "query bigint, target bigint, grp double, v array<float>")


def test_self_retrieval(spark):
    v = np.random.default_rng(1).normal(size=(50, 16))
    o = lexical.ranked(dense.outcomes(_chunks(spark, v, range(50)), _queries(spark, v, range(50)))).collect()
    assert all(r["rank"] == 1 and r["rr"] == 1 for r in o) and len(o) == 50
    back = lexical.ranked(dense.outcomes(_chunks(spark, v, range(50)), _queries(spark, v[::-1].copy(), range(50)))).collect()
    assert sum(r["rr"] for r in back) < 50


def test_best_chunk_and_masks(spark):
    v = np.array([[1.0, 0], [0, 1], [0.9, 0.1], [0, 1], [1, 0.05]])
    chunks = _chunks(spark, v, [1, 1, 2, 2, 3], [7, 7, 8, 8, 7])
    q = _queries(spark, np.array([[0.9, 0.1]]), [1], [7.0])
    free, masked = dense.outcomes(chunks, q).first(), dense.outcomes(chunks, q, masked=True).first()
    assert (free["n_above"], masked["n_above"]) == (2, 1)
    assert dense.outcomes(chunks.limit(0), q).count() == 0


def test_a_query_never_meets_its_own_chunk(spark):
    v = np.array([[1.0, 0], [0.8, 0.6], [0.9, 0.1], [0.5, 0.5]])
    chunks = spark.createDataFrame([(i, d, None, [float(x) for x in r]) for i, (d, r) in enumerate(zip([1, 1, 2, 3], v))], "chunk bigint, doc bigint, grp double, v array<float>")
    asked = spark.createDataFrame([(0, 1, None, [1.0, 0.0]), (3, 3, None, [0.5, 0.5])], "query bigint, target bigint, grp double, v array<float>")
    got = dense.outcomes(chunks, asked).collect()
    assert [(r["query"], r["target_score"], r["n_above"]) for r in got] == [(0, pytest.approx(0.8, abs=1e-6), 1)]
    pooled = dense.outcomes(dense.summed(chunks, 2), asked, pooled=True).collect()
    assert [(r["query"], r["target_score"]) for r in pooled] == [(0, pytest.approx(0.8, abs=1e-6))]


def test_dispersion_equals_the_gram_matrix(spark):
    v = np.random.default_rng(2).normal(size=(12, 64))
    doc = [1] * 5 + [2] * 6 + [3]
    got = {r["doc"]: r for r in dense.dispersion(_chunks(spark, v, doc)).collect()}
    for d, sl in ((1, slice(0, 5)), (2, slice(5, 11))):
        u = v[sl].astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        g, k = u @ u.T, len(u)
        e = np.linalg.eigvalsh(g)
        assert got[d]["pair_cosine"] == pytest.approx((g.sum() - k) / (k * (k - 1)))
        assert got[d]["centroid_cosine"] == pytest.approx(np.linalg.norm(u.mean(axis=0)))
        assert got[d]["effective_rank"] == pytest.approx(e.sum() ** 2 / (e**2).sum())
    assert got[3]["n"] == 1 and got[3]["pair_cosine"] is None
