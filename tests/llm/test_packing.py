"""Containers: nothing lost, nothing over capacity, nothing split without need, little waste."""

import random
from collections import Counter, defaultdict

import pytest

from seriatim.llm import packing


def check(sizes, rows, capacity):
    fill, parts = defaultdict(int), defaultdict(list)
    for i, part, start, n, c in rows:
        fill[c] += n
        parts[i].append((part, start, n))
    assert all(0 < v <= capacity for v in fill.values())
    want = {i: n for i, n in sizes if i is not None and n}
    assert set(parts) == set(want)
    for i, ps in parts.items():
        ps.sort()
        assert sum(n for *_, n in ps) == want[i]
        assert [p for p, *_ in ps] == list(range(len(ps))) and [s for _, s, _ in ps] == [p * capacity for p, *_ in ps]
        assert len(ps) == -(-want[i] // capacity)
    assert sorted(fill) == list(range(len(fill)))
    return len(fill)


@pytest.mark.parametrize("seed", range(3))
def test_containers(spark, seed):
    rng = random.Random(seed)
    sizes = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 300), 7])) for i in range(700)] + [(9000, 0), (9001, None), (None, 5), (9002, 640)]
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id bigint, n_tokens bigint, size string")
    rows = [tuple(r) for r in packing.packed(df, "doc_id", "n_tokens", 256).collect()]
    used = check([s for s in sizes if s[0] is not None], rows, 256)
    assert used <= -(-sum(n or 0 for i, n in sizes if i is not None) // 256) + 2


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), "doc_id", "n_tokens").count() == 0


def test_plan_holds_the_histogram():
    rng = random.Random(4)
    h = dict(Counter(rng.randint(1, 100) for _ in range(5000)))
    plan = packing.plan(h, 100)
    got = Counter()
    for config, n in plan:
        assert sum(s * m for s, m in config.items()) <= 100 and n > 0
        for s, m in config.items():
            got[s] += m * n
    assert got == h
    assert sum(n for _, n in plan) <= 1.025 * sum(s * n for s, n in h.items()) / 100  # few small items: no packing is without waste


def test_hard_sizes_need_their_own_containers():
    assert sum(n for _, n in packing.plan({60: 10, 61: 5}, 100)) == 15
    assert sum(n for _, n in packing.plan({50: 10}, 100)) == 5
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def _histogram(kind, rng):
    if kind == "uniform":
        return Counter(rng.randint(1, 2048) for _ in range(20000))
    if kind == "two sizes":
        return Counter(rng.choice([700, 648]) for _ in range(9001))
    if kind == "thirds":
        return Counter(rng.randint(500, 900) for _ in range(20000))
    return Counter(min(2048, max(1, int(rng.paretovariate(0.9) * 30))) for _ in range(20000))


@pytest.mark.parametrize("kind", ["uniform", "two sizes", "thirds", "heavy tail"])
def test_never_worse_than_largest_first(kind):
    import numpy as np

    h = _histogram(kind, random.Random(11))
    left = np.zeros(2049, np.int64)
    for s, n in h.items():
        left[s] = n
    greedy = sum(n for _, n in packing._finished(left, 2048, []))
    used = sum(n for _, n in packing.plan(h))
    bound = -(-sum(s * n for s, n in h.items()) // 2048)
    assert bound <= used <= greedy
    got = Counter()
    for config, n in packing.plan(h):
        for s, m in config.items():
            got[s] += m * n
    assert got == h
