"""Similar vectors against brute force; Hilbert keys; copies, nulls and ties."""

import numpy as np

from seriatim.llm import knn


def brute(ids, did, v, k=5):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    s[did[:, None] == did[None, :]] = -9
    out = set()
    for i in range(len(ids)):
        for j in np.lexsort((ids, -s[i]))[:k]:
            if s[i, j] > -9:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id bigint, did bigint, chunk_no int, dv array<float>, key string, curve string")


def _rows(ids, did, v):
    return [(int(i), int(d), 0, [float(x) for x in r], "k", "c") for i, d, r in zip(ids, did, v)]


def test_hilbert_is_a_path():
    """Every cell once, and neighbours along the curve are neighbours in space."""
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
        key = knn.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_all_in_one_window(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 64)).astype(np.float32)
    did, ids = rng.integers(0, 80, 300), rng.permutation(1000)[:300]
    bad = [(5000, 1, 0, None, "", ""), (5001, 1, 0, [0.0] * 64, "", ""), (5002, 1, 0, [1.0] * 3, "", ""), (5003, None, 0, [1.0] * 64, "", ""), (None, 1, 0, [1.0] * 64, "", ""), (5004, 1, 0, [float("nan")] * 64, "", ""), (5005, 1, 0, [], "", "")]
    got = [tuple(r) for r in knn.found(_frame(spark, _rows(ids, did, v) + bad)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ids, did, v.astype(float))


def test_copies(spark):
    """A third of all rows is one vector, partly of one document: ties go to the smallest chunk of another document."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 64)).astype(np.float32)
    v[:50] = v[0]
    did = np.r_[np.repeat(7, 20), np.arange(100, 130), rng.integers(200, 230, 100)]
    ids = rng.permutation(500)[:150]
    got = {tuple(r) for r in knn.found(_frame(spark, _rows(ids, did, v))).collect()}
    assert got == brute(ids, did, v.astype(float))


def test_few_and_none(spark):
    assert knn.found(_frame(spark, [])).count() == 0
    one = _rows([3], [1], np.ones((1, 64)))
    assert knn.found(_frame(spark, one)).count() == 0
    two = one + _rows([9], [2], np.ones((1, 64)) * 2) + _rows([4], [1], np.ones((1, 64)))
    assert {tuple(r) for r in knn.found(_frame(spark, two)).collect()} == {(3, 9), (4, 9)}


def test_recall_with_small_windows(spark):
    """Windows far smaller than the table, as at scale: recall against brute force stays over 0.9."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 64))
    v = (centre[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 64)) * 0.6).astype(np.float32)
    did, ids = np.arange(4000) // 2, np.arange(4000)
    n = knn.nearest(_frame(spark, _rows(ids, did, v)), block=256)
    from pyspark.sql import functions as F

    got = {tuple(r) for r in n.select(F.least("chunk_id", "near"), F.greatest("chunk_id", "near")).distinct().collect()}
    want = brute(ids, did, v.astype(float))
    assert len(got & want) / len(want) >= 0.9
    assert n.groupBy("chunk_id").count().where("count <> 5").count() == 0


def test_top_columns():
    rng = np.random.default_rng(4)
    for w in (3, 24, 100, 3000, 3333):
        s = rng.normal(size=(7, w)).astype(np.float32)
        got = np.sort(np.take_along_axis(s, knn.top_columns(s, 24), axis=1), axis=1)
        assert np.array_equal(got, np.sort(s, axis=1)[:, -24:])


def test_recall_does_not_fall_with_size(spark):
    """Windows of a tenth of the table on a curve: further curves are added until the recall is reached."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 64)).astype(np.float32)
    did, ids = np.arange(4000) // 2, np.arange(4000)
    from pyspark.sql import functions as F

    n = knn.nearest(_frame(spark, _rows(ids, did, v)), block=128)
    got = {tuple(r) for r in n.select(F.least("chunk_id", "near"), F.greatest("chunk_id", "near")).distinct().collect()}
    want = brute(ids, did, v.astype(float))
    assert len(got & want) / len(want) >= 0.9


def test_shuffle_width_changes_nothing(spark):
    """More partitions than blocks: no window is cut, and the result is that of a few partitions."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    df = _frame(spark, _rows(np.arange(3000), np.arange(3000) // 2, v))
    got, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("3", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got.append({tuple(r) for r in knn.nearest(df, block=64, curves=3, target=0.0).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]


def test_parts_hold_their_borders(spark):
    """Parts hold at most their rows, a hot stretch is shared out, and borders of a block are copied both ways."""
    rng = np.random.default_rng(7)
    counts = np.r_[rng.integers(0, 30, 60), 1000, rng.integers(0, 30, 60)]
    parts = knn.Parts(counts, 4, 200, 50)
    held = np.bincount(parts.part, weights=np.where(parts.shares > 1, 0, counts))
    assert held.max() <= 200 and parts.shares.max() == 5 and (np.diff(parts.part) >= 0).all()
    for b in np.flatnonzero(np.diff(parts.part)) + 1:
        if parts.shares[b] > 1 or parts.shares[b - 1] > 1:
            continue
        left = np.flatnonzero((parts.part == parts.part[b - 1]) & (parts.after == parts.part[b]))
        assert left.max() == b - 1 and (counts[left].sum() >= 50 or left.min() == np.flatnonzero(parts.part == parts.part[b - 1]).min())
    key = np.repeat(np.arange(121), counts) << 4
    chunk = rng.permutation(len(key))
    own, before, after = parts.of(key, chunk)
    assert np.bincount(own).max() <= 300 and own.max() < parts.total and (own[key >> 4 == 60] >= 0).all()
    v = rng.normal(size=(900, 64)).astype(np.float32)
    df = _frame(spark, _rows(np.arange(900), np.arange(900), v))
    whole, knn.PART = knn.PART, 200
    try:
        cut = {tuple(r) for r in knn.nearest(df, block=60, curves=8, target=0.0).collect()}
    finally:
        knn.PART = whole
    plain = {tuple(r) for r in knn.nearest(df, block=60, curves=8, target=0.0).collect()}
    assert len(cut & plain) / len(plain) > 0.9


def test_scaled_copies(spark):
    """A third of all rows has one direction and norms of its own, more than a window or KEPT hold: ties go to the smaller chunk."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 64)).astype(np.float32)
    v[:300] = v[0] * rng.uniform(0.2, 5, 300).astype(np.float32)[:, None]
    did, ids = np.r_[np.repeat(7, 12), np.arange(1000, 1888)], rng.permutation(4000)[:900]
    got = {tuple(r) for r in knn.nearest(_frame(spark, _rows(ids, did, v)), block=32, target=0.0).select("chunk_id", "near").collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for i in range(300):
        s = np.round(u @ u[i], 9)
        s[did == did[i]] = -9
        assert {b for a, b in got if a == ids[i]} == {ids[j] for j in np.lexsort((ids, -s))[:5]}


def test_ties_beyond_the_kept(spark):
    """Forty scaled copies in one window: rows beside them rank all of them."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(200, 64)).astype(np.float32)
    v[:40] = v[0] * rng.uniform(0.2, 5, 40).astype(np.float32)[:, None]
    v[40:60] = v[0] + rng.normal(size=(20, 64)).astype(np.float32) * 0.2
    did, ids = np.arange(200), rng.permutation(1000)[:200]
    assert {tuple(r) for r in knn.found(_frame(spark, _rows(ids, did, v))).collect()} == brute(ids, did, v.astype(float))


def test_one_document_fills_the_windows(spark):
    """A third of all rows is one document in one region: its rows still get five of other documents."""
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(12, 64))
    v = (centre[rng.integers(0, 12, 1800)] + rng.normal(size=(1800, 64)) * 0.5).astype(np.float32)
    v[:600] = centre[0] + rng.normal(size=(600, 64)) * 0.1
    did, ids = np.r_[np.repeat(7, 600), np.arange(100, 1300)], rng.permutation(5000)[:1800]
    df = _frame(spark, _rows(ids, did, v))
    one_round = knn.nearest(df, block=64, target=0.0)
    assert one_round.groupBy("chunk_id").count().where("count = 5").count() == 1800
    got = {tuple(r) for r in one_round.select("chunk_id", "near").collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hits = 0
    for i in range(600):
        s = np.round(u @ u[i], 9)
        s[did == did[i]] = -9
        hits += sum((ids[i], ids[j]) in got for j in np.lexsort((ids, -s))[:5])
    assert hits / 3000 >= 0.8


def test_vectors_are_shipped_once(spark, tmp_path):
    """What is shuffled and cut stays under four times the vectors, with cells far smaller than the table and several parts."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(60, 64))
    v = (centre[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 64)) * 0.6).astype(np.float32)
    v[:40] = v[40:80]
    did, ids = np.arange(6000) // 2, np.arange(6000)
    df, sc = _frame(spark, _rows(ids, did, v)), spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (sc.statusStore().executorList(False).apply(i) for i in range(sc.statusStore().executorList(False).size())))

    was, before = sc.getCheckpointDir(), shuffled()
    part, fit, knn.PART, knn.FIT_ROWS = knn.PART, knn.FIT_ROWS, 1000, 600
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        got = {tuple(r) for r in knn.found(df).collect()}
    finally:
        knn.PART, knn.FIT_ROWS = part, fit
        if was.isDefined():
            spark.sparkContext.setCheckpointDir(was.get())
    cuts = sum(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert shuffled() - before + cuts < 4 * v.nbytes
    want = brute(ids, did, v.astype(float))
    assert len(got & want) / len(want) >= 0.96


def test_every_vector_has_copies(spark):
    """Each vector in three documents: every class ranks for several documents, over several parts."""
    rng = np.random.default_rng(12)
    v = np.tile(rng.normal(size=(150, 64)).astype(np.float32), (3, 1))
    did, ids = np.arange(450) // 2, rng.permutation(2000)[:450]
    part, knn.PART = knn.PART, 100
    try:
        got = {tuple(r) for r in knn.found(_frame(spark, _rows(ids, did, v))).collect()}
    finally:
        knn.PART = part
    assert got == brute(ids, did, v.astype(float))


def test_reach_counts_other_documents():
    """A document that fills the nearest cells does not use up the reach of its rows."""
    rows = np.array([100, 100, 10, 10])
    reach = knn.Reach(rows, {7: (np.array([0, 1]), np.array([95, 100]))})
    reach.least = 15
    sims = np.array([[0.9, 0.8, 0.7, 0.6]] * 3, np.float32)
    far = reach.of(sims, np.array([3, 7, 3]), np.array([False, False, True]))
    assert [int((s >= f).sum()) for s, f in zip(sims, far)] == [1, 3, 3]
