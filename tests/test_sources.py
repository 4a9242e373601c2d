"""Files, gates, streams and the driver contract."""

import gzip
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriatim.operators import relational
from seriatim.sources import files, tables
from seriatim.streaming import spells


def test_csv(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write('id,text,label,n\n1,"line one\nline ""two""",Trach mask ,5\n2,plain,x,oops\n')
    path = files.find(tmp_path, "x.csv", "x.csv.gz")
    df = files.csv(spark, path, "id int, text string, label string, n int", ["id", "text", "label", "n"], text=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'line one\nline "two"', "Trach mask ", 5), (2, "plain", "x", None)]
    assert files.counted(df, "id") == (2, 2)
    with pytest.raises(FileNotFoundError):
        files.find(tmp_path, "y.csv")
    with pytest.raises(tables.MissingColumns):
        tables.require(df, ["id", "nope"])


def test_rebuilds_compare_as_bags(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    files.write_parquet(df, str(tmp_path / "p"))
    assert files.rebuilt_same(df.orderBy(F.desc("k")), str(tmp_path / "p"))
    assert not files.rebuilt_same(df.distinct(), str(tmp_path / "p"))
    assert not files.rebuilt_same(df.withColumn("w", F.lit(1)), str(tmp_path / "p"))


def test_cells(spark, tmp_path):
    pairs = spark.createDataFrame([("q1", 0, "a", "b"), ("q1", 1, "c", "d"), ("q2", 0, "e", "f")], "cell string, idx int, query string, target string")
    files.write_cells(pairs, str(tmp_path / "cells"))
    back = files.read_cells(spark, str(tmp_path / "cells"), "cell string, idx int, query string, target string")
    assert relational.same_rows(pairs, back.select(*pairs.columns)).first() == (0, 0)
    assert {(r["cell"], r["idx"]): r["doc_pos"] for r in files.pooled(back, ["q1", "q2"]).collect()} == {("q1", 0): 0, ("q1", 1): 1, ("q2", 0): 2}
    (tmp_path / "nested.json").write_text('{"N": 1, "cells": {"A|q1": [{"query": "x", "year": 3}, {"query": "y"}]}}')
    got = files.read_nested_cells(spark, str(tmp_path / "nested.json"), "query string, year int")
    assert sorted(map(tuple, got.collect())) == [("A|q1", 0, "x", 3), ("A|q1", 1, "y", None)]


def test_vector_store(spark, tmp_path):
    root = str(tmp_path / "v")
    one = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [2.0])], "doc_pos int, chunk_no int, v array<float>")
    files.store_vectors(one, root, "m", "q1")
    files.store_vectors(one.limit(0), root, "m", "q1")  # already there
    docs = spark.createDataFrame([("q1", 0), ("q1", 1)], "cell string, doc_pos int")
    assert files.load_vectors(spark, root, "m", ["q1"], docs).count() == 2
    with pytest.raises(ValueError):
        files.load_vectors(spark, root, "m", ["q1"], docs.union(spark.createDataFrame([("q1", 9)], docs.schema)))


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("bm25", 0.39084, None), ("x", 1.0, 2)], "model string, mrr double, n int")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_metrics(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    text = files.report("T", df)
    assert "0.3908" in text and text.splitlines()[0] == "T" and "-" in text
    with pytest.raises(ValueError):
        files.report("T", df, limit=1)
    assert files.run_tag(b"x", datetime(2150, 1, 2, 3, 4)) == "2d7116_21500102T0304Z"
    assert files.versions()["pyspark"] != "absent" and files.versions(["nope"])["nope"] == "absent"
    assert files.figure_table([("a", 1.0, 0.5)], str(tmp_path / "f.json"))[0]["hi"] == pytest.approx(1.98)


def test_gates(spark):
    a = spark.createDataFrame([("q1", 0.5), ("q2", 0.4)], "q string, m double")
    assert relational.gate(a, a.withColumn("m", F.col("m") + 1e-4), ["q"], "m") == pytest.approx(1e-4)
    for b in (a.withColumn("m", F.col("m") + 1e-3), a.limit(1)):
        with pytest.raises(relational.GateFailed):
            relational.gate(a, b, ["q"], "m")
    assert relational.verdict(0.1, [(0.2, "small"), (0.5, "some")], "most") == "small" and relational.verdict(None, [], "x") == "not available"


def test_relations(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7), (None, 1), (3, None)], "k int, v int")
    assert [tuple(r) for r in relational.single_match(df, "k", "v").collect()] == [(1, 5)]
    keys = spark.createDataFrame([(1,), (1,)], "k int")
    assert relational.dropped(df.dropna(), keys, "k").first() == (2, 2)
    first = relational.first_by(df.dropna(), ["k"], [-F.col("v")], ["k", "v"])
    assert sorted(map(tuple, first.collect())) == [(1, 5), (2, 7)]
    items = spark.createDataFrame([(1, "pO2", "Blood", "Blood Gas"), (2, "pO2", "Other", "Blood Gas"), (3, None, None, None)], "itemid int, label string, fluid string, category string")
    assert [r["itemid"] for r in relational.resolve(items, {"pao2": "^po2$"}, {"pao2": ("blood", "blood gas")}).collect()] == [1]
    assert relational.attrition([("all", df), ("known", df.dropna())]).collect()[1]["n"] == 4


def test_streams(spark, tmp_path):
    t0 = datetime(2150, 1, 1)
    rows = [(1, t0 + timedelta(hours=x), "a", float(x)) for x in (0, 1, 3, 30, 31)] + [(2, t0, "b", 1.0), (1, t0 + timedelta(days=30), "z", 0.0)]
    spark.createDataFrame(rows, "k bigint, t timestamp, s string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k bigint, t timestamp, s string, v double").parquet(str(tmp_path / "in"))
    for name, df in (("spells", spells.spells(stream, "k", "t", "s")), ("days", spells.windowed_extremes(stream, "k", "t", "v"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r["k"], r["s"], r["n"]) for r in spark.table("spells").collect())
    assert got == [(1, "a", 2), (1, "a", 3), (2, "b", 1)]
    assert sorted((r["k"], r["n"], r["lo"], r["hi"]) for r in spark.table("days").collect()) == [(1, 2, 30.0, 31.0), (1, 3, 0.0, 3.0), (2, 1, 1.0, 1.0)]


def test_contract(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and {"p2_found", "p3_found", "p5_found"} <= names
    assert e.entry(spark).columns == ["stratum", "n", "geo_mean", "ratio"]


def test_queries_equal_their_sql(spark, root):
    """A few of the registered queries against DuckDB on the smallest tables; the driver compares them all."""
    duckdb = pytest.importorskip("duckdb")
    import os

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(root):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{root}/{f}'")
    for name in ("p2_found", "p3_found", "p3_periods", "slope_cr1", "eta2_cube", "gap_islands_14h", "bm25_windowed", "cem_length_matched", "banded_score"):
        got = e.queries()[name](spark, root)
        cur = con.execute(e.oracle_sql()[name])
        order = [x[0] for x in cur.description]
        assert sorted(order) == sorted(got.columns)
        assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, cur.fetchall())), name


def test_outcomes_have_their_length(spark, tmp_path):
    o = spark.createDataFrame([("a", "q1", 0.5), ("a", "q1", 0.0), ("b", "q1", 1.0)], "model string, cell string, rr double")
    files.write_parquet(o, str(tmp_path / "o"), ["model"])
    want = spark.createDataFrame([("a", "q1", 2), ("b", "q1", 1)], "model string, cell string, n int")
    assert files.load_outcomes(spark, str(tmp_path / "o"), want).count() == 3
    with pytest.raises(ValueError, match="c, q1: 0 rows, 1 expected"):
        files.load_outcomes(spark, str(tmp_path / "o"), want.union(spark.createDataFrame([("c", "q1", 1)], want.schema)))


def test_encoders(spark):
    from seriatim.sources import encoders

    by = {m.key: m for m in encoders.REGISTRY}
    assert by["e5"].route("query") == ("intfloat/e5-base-v2", "mean", "query: ") and by["medcpt"].route("document") == ("ncbi/MedCPT-Article-Encoder", "cls", "")
    assert encoders.windows(0, 2) == [(0, 0)] and encoders.windows(1000, 10) == [(0, 500), (384, 884), (768, 1000)]

    def lengths(texts):
        import numpy as np

        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 600)], "id bigint, text string")
    got = {(r["id"], r["chunk"]): list(r["v"]) for r in encoders.encoded(df, "id", "text", lengths, 2, prefix="q: ").collect()}
    assert set(got) == {(1, 0), (3, 0), (3, 1)} and abs(sum(x * x for x in got[(1, 0)]) - 1) < 1e-6
