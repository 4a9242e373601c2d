"""Shared spans against all windows by brute force."""

import random

from seriatim.llm import spans


def brute(texts: dict, n: int):
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for group in where.values():
        g = sorted(group)
        out |= {(a, b) for i, a in enumerate(g) for b in g[i + 1 :]}
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "note_id string, text string, doc bigint, h1 string")


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é😀\n") for _ in range(n))
    shared = [noise(n) for n in (40, 41, 60, 200, 39)]
    texts = {f"n{i}": noise(rng.randint(0, 150)) + "".join(rng.choice(shared) + noise(rng.randint(0, 30)) for _ in range(rng.randint(0, 3))) for i in range(60)}
    texts["copy"] = texts["n7"]
    texts["period1"], texts["period2"], texts["period3"] = "ab" * 100, "xab" + "ab" * 60, "ab" * 19
    rows = [(i, t, 1, "x") for i, t in texts.items()]
    got = spans.found(_frame(spark, rows + rows[:5] + [("null", None, 1, "x"), (None, "z" * 300, 1, "x"), ("empty", "", 1, "x")]), length=40)
    assert got.columns == ["note_id_a", "note_id_b"]
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(texts, 40)


def test_exact_length(spark):
    span = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(240))
    rows = [("a", "1" * 100 + span + "2" * 50, 1, ""), ("b", "3" * 7 + span + "4", 1, ""), ("c", "5" + span[1:] + "6" * 90, 1, "")]
    assert {tuple(r) for r in spans.found(_frame(spark, rows)).collect()} == {("a", "b")}


def test_coverage(spark):
    span = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [("a", "1" * 100 + span, 1, ""), ("b", span + "4", 1, ""), ("c", "6" * 90, 1, ""), ("d", None, 1, ""), ("e", "", 1, "")]
    got = {r["note_id"]: tuple(r)[1:] for r in spans.coverage(_frame(spark, rows)).collect()}
    assert got == {"a": (400, 300, 1), "b": (301, 300, 1), "c": (90, 0, 0), "d": (None, 0, 0), "e": (0, 0, 0)}


def test_empty(spark):
    assert spans.found(_frame(spark, [])).count() == 0 and spans.coverage(_frame(spark, [])).count() == 0


def test_hot_window(spark):
    """A passage below the length in every record makes no pair; one above it makes all."""
    rows = [(f"n{i}", f"{i:05d}" * 30 + "s" * 200 + f"{i:05d}" * 10, 1, "") for i in range(40)]
    assert spans.found(_frame(spark, rows)).count() == 0
    assert spans.found(_frame(spark, rows), length=150).count() == 40 * 39 // 2


def test_several_texts_of_one_id(spark):
    """Each text of an id is searched, and no window of one is taken for the other's."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one, two = noise(500), noise(500)
    rows = [("a", noise(30) + one, 1, ""), ("a", noise(60) + two, 1, ""), ("b", one + noise(9), 1, ""), ("c", noise(44) + two[100:], 1, ""), ("d", two[:200] + noise(300), 1, "")]
    assert {tuple(r) for r in spans.found(_frame(spark, rows)).collect()} == {("a", "b"), ("a", "c")}


def test_blocks_are_few(spark):
    """A long copy is carried in blocks, not start by start."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij klm") for _ in range(20000))
    docs, _ = spans.records(_frame(spark, [(f"n{i}", long, 1, "") for i in range(20)]), "note_id", "text")
    found, classes, windows = spans.blocks(docs)
    assert found.count() < 20 * 20000 / 8 and windows.count() == 20000 - 239
    assert spans.groups(found, classes, windows).count() == 20
