"""Text functions and the extraction pipeline on hand-made notes."""

import pytest
from pyspark.sql import functions as F

from seriatim.functions import text as tx
from seriatim.operators import lexical, text


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return df.select(expression(*[F.col(f"x{i}") for i in range(len(values))]).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('Seen by Dr. Smith on 12/3/2020 at 10:30 AM, ID 123456, "stable" ___', "Seen by Dr Smith on at , ID , stable"),
        ("met July 21 criteria in March 2020, may ambulate", "met criteria in , may ambulate"),
        ("", ""),
    ],
)
def test_scrub(spark, given, want):
    assert one(spark, tx.scrubbed, given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Attending Physician note", True),
        ("Name: x Unit: y", True),
        ("12 34 56 78", True),
        ("SHORT CAPITALS", True),
        ("The patient was seen and is stable today.", False),
        ("", False),
    ],
)
def test_boilerplate(spark, given, want):
    assert one(spark, tx.is_boilerplate, given) == want


def _split(spark, value, step):
    df = spark.createDataFrame([(1, value)], "id int, t string")
    own = df.select("id", tx.lines(F.col("t")).alias("own")).select("id", tx.unwrapped(F.col("own")).alias("w"))
    return own.select((F.col("w") if step == "lines" else tx.sentences(F.col("w"))).alias("y")).first()["y"]


def test_wrapped_lines_are_joined(spark):
    assert _split(spark, "The patient was\nseen today.\nAllergies:\nnone\n\nnext", "lines") == ["The patient was seen today.", "Allergies:", "none", "next"]
    assert _split(spark, "a    b", "lines") == ["a b"]


def test_sentences(spark):
    assert _split(spark, "HOSPITAL COURSE: x\nThe patient was seen. He is well.\n----", "sentences") == ["The patient was seen.", "He is well."]
    assert _split(spark, None, "sentences") == [] and _split(spark, "", "sentences") == []


def _removed(spark, doc, *queries):
    df = spark.createDataFrame([(doc, *queries)], "t string, " + ", ".join(f"q{i} string" for i in range(len(queries))))
    return text.removed(df, "t", [f"q{i}" for i in range(len(queries))]).first()["target"]


def _located(spark, doc, query):
    return text.located(spark.createDataFrame([(doc, query)], "t string, q string"), "t", "q").first()["at"]


def test_remove_and_locate(spark):
    doc = "alpha beta gamma delta epsilon zeta eta theta iota kappa tail words here"
    query = "gamma delta epsilon zeta eta theta"
    assert _removed(spark, doc, query) == "alpha beta iota kappa tail words here"
    assert doc[_located(spark, doc, query) :].startswith("gamma") and _located(spark, "\n  " + doc, query) == 14
    assert _removed(spark, "a  b\nc", "one two") == "a b c" and _located(spark, doc, "one two") == -1 and _located(spark, doc, None) == -1
    assert _removed(spark, "nothing of it here at all", query) == "nothing of it here at all" and _removed(spark, "", query) == ""
    # numbers and marks inside the stretch go with it
    assert _removed(spark, "alpha gamma, 12 delta epsilon; zeta eta 5 theta! end", query) == "alpha end"
    # the beginning of a query whose end is missing: five words go with twice as many
    assert _removed(spark, "gamma delta epsilon zeta eta one two three four five six", query + " omega psi chi phi") == "six"
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    assert _removed(spark, " ".join(words), " ".join(words[2:8]), " ".join(words[10:16])) == " ".join(words[:2] + words[8:10] + words[16:])


def test_windows_and_chunks(spark):
    w = [chr(97 + i) for i in range(10)]
    assert [len(x) for x in lexical.word_windows(w, 5, 5)] == [5, 5]
    cover = lexical.word_windows(w, 4, 3)
    assert {c for x in cover for c in x} == set(w) and all(cover)
    assert lexical.word_windows(w, 100, 3) == [w] and lexical.word_windows([], 4, 3) == [[]]
    df = spark.createDataFrame([(" ".join(["w"] * 1000), 0), (" ".join(["w"] * 1000), 1998), ("", 0)], "t string, o int")
    chunk, chunks = text.chunk_at("t", F.col("o"))
    assert [tuple(r) for r in df.select(chunk, chunks).collect()] == [(0, 3), (2, 3), (-1, 0)]


def test_leaks(spark):
    assert one(spark, text.leaks, "The patient was seen", "xx THE patient, was 12 seen yy")
    assert not one(spark, text.leaks, "123", "anything") and not one(spark, text.leaks, "abc", "")


def test_keys(spark):
    rows = spark.createDataFrame([("Temp 38.5, BP 120/80!",), ("a1b  C",), ("",), ("Évolution ٣",)], "t string")
    got = [tuple(r) for r in rows.select(text.norm_key("t"), text.sentence_key("t")).collect()]
    assert got == [("temp bp", "temp bp"), ("ab c", "a b c"), ("", ""), ("volution", "volution")]


FILL = "{0} was noted with {1} beside it and after {0}{1} the team has found nothing but {1}{0} here."


def test_extraction(spark):
    """The first longest run of rare prose gives the query; frequent sentences break runs; nulls are left out."""
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    own = [FILL.format(names[i], names[i + 1]) for i in range(0, 12)]
    common = "There was no evidence of anything of note in this study at all today."
    rows = [(1, " ".join([own[0], common, own[1], own[2], own[3]])), (2, " ".join([common, own[4]])), (3, common), (4, common), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    q = {r["id"]: r["query"] for r in text.narrative_queries(df, "id", "text").collect()}
    assert q == {1: f"{own[1]} {own[2]}", 2: own[4]}
    p = {r["id"]: r for r in text.pairs(df, "id", "text", text.narrative_queries(df, "id", "text"), least=20).collect()}
    assert p[1]["reason"] == "ok" and p[1]["target"] == _removed(spark, rows[0][1], q[1]) != rows[0][1]
    assert p[3]["reason"] == "no_query" and 5 not in p
    assert p[2]["target"] == common and p[2]["reason"] == "ok"
    w = [(r["id"], r["window"]) for r in text.windows(df, "id", "text").collect()]
    assert w == [(1, 0)]


def test_deduplication(spark):
    rows = [(3, "Same text 12"), (1, "same TEXT 99"), (2, "other"), (4, None), (5, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert sorted(r["id"] for r in text.deduplicated(df, "id", "text", 2).collect()) == [1, 2]
    assert text.deduplicated(df.limit(0), "id", "text").count() == 0
