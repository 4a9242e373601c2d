"""Files of the pipeline: CSV scans, JSON cells, vector and outcome stores, result sinks, run tags."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Sequence
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriatim.sources.tables import require


def find(root: str | Path, *names: str) -> str:
    """The first of several file names that exists under a folder, such as x.csv.gz before x.csv."""
    for n in names:
        if (Path(root) / n).exists():
            return str(Path(root) / n)
    raise FileNotFoundError(f"none of {', '.join(names)} under {root}")


def csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, text: bool = False) -> DataFrame:
    """A CSV or gzip CSV scan with an explicit schema; blanks at the end of a value are kept.

    text: values may hold line breaks and doubled quotes. A value that does not fit its type is
    null. Gzip files are one task each, so large ones are converted to parquet once.
    """
    r = spark.read.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).option("quote", '"').option("escape", '"').option("enforceSchema", False).option("mode", "PERMISSIVE")
    df = (r.option("multiLine", True) if text else r).schema(schema).csv(path)
    return require(df, columns).select(*columns) if columns else df


def counted(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows and distinct keys, to hold against an independent count."""
    r = df.agg(F.count("*"), F.count_distinct(key)).first()
    return r[0], r[1]


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def rebuilt_same(df: DataFrame, path: str) -> bool:
    """Whether a build equals the one stored before, row for row with repeats, in any order."""
    old = df.sparkSession.read.parquet(path)
    if sorted(old.columns) != sorted(df.columns):
        return False
    old = old.select(*df.columns)
    return df.exceptAll(old).isEmpty() and old.exceptAll(df).isEmpty()


def write_cells(pairs: DataFrame, path: str, keys: Sequence[str] = ("cell",)) -> None:
    """Known-item pairs as JSON lines, one folder per cell; the order inside a cell is the column idx."""
    require(pairs, [*keys, "idx", "query", "target"])
    pairs.write.mode("overwrite").partitionBy(*keys).json(path)


def read_cells(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_nested_cells(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Cells of the nested form {"N": n, "cells": {name: [record, ...]}}: cell, idx and the record's fields."""
    raw = spark.read.option("multiLine", True).schema(f"N bigint, cells map<string, array<struct<{record}>>>").json(path)
    cells = raw.select(F.explode("cells").alias("cell", "records"))
    return cells.select("cell", F.posexplode("records").alias("idx", "r")).select("cell", "idx", "r.*")


def pooled(pairs: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Cells in the given order as one index: doc_pos = offset of the cell + idx."""
    sizes = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}  # a handful of cells
    offset, at = {}, 0
    for c in cells:
        offset[c], at = at, at + sizes.get(c, 0)
    start = F.element_at(F.create_map(*[x for c in cells for x in (F.lit(c), F.lit(offset[c]).cast("bigint"))]), F.col("cell"))
    return pairs.where(F.col("cell").isin(*cells)).withColumn("doc_pos", start + F.col("idx"))


def load_outcomes(spark: SparkSession, path: str, expected: DataFrame, keys: Sequence[str] = ("model", "cell")) -> DataFrame:
    """Stored outcomes per query; ValueError where a model and cell (expected: the keys and n) has another number of rows."""
    o = spark.read.parquet(path)
    held = o.groupBy(*keys).agg(F.count("*").alias("_held"))
    bad = held.join(expected.select(*keys, "n"), list(keys), "full_outer").where("coalesce(_held, 0) <> coalesce(n, 0)")
    first = bad.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{', '.join(str(r[k]) for k in keys)}: {r['_held'] or 0} rows, {r['n'] or 0} expected" for r in first))
    return o


def store_vectors(df: DataFrame, root: str, model: str, cell: str) -> str:
    """Vectors of one model and cell, unless they are stored already: the folder is the memo."""
    path = f"{root}/model={model}/cell={cell}"
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        df.drop("model", "cell").write.mode("overwrite").parquet(path)
    return path


def load_vectors(spark: SparkSession, root: str, model: str, cells: Sequence[str], documents: DataFrame | None = None) -> DataFrame:
    """Stored vectors of a model: cell, doc_pos, chunk_no, v; with documents, every one of them must have a vector."""
    v = spark.read.option("basePath", root).parquet(root).where((F.col("model") == model) & F.col("cell").isin(*cells)).drop("model")
    if documents is not None:
        without = documents.join(v.select("cell", "doc_pos").distinct(), ["cell", "doc_pos"], "left_anti").count()
        if without:
            raise ValueError(f"{without} documents have no vector of {model}")
    return v


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small result as one JSON lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report(title: str, df: DataFrame, limit: int = 1000) -> str:
    """A fixed-width text table of a small result; longer ones are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{title}: more than {limit} rows is no report")
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    table = [df.columns, *[[show(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    lines = ["  ".join(c.rjust(w) for c, w in zip(r, width)) for r in table]
    return "\n".join([title, "-" * len(lines[0]), *lines]) + "\n"


def run_tag(source: bytes, now: datetime | None = None) -> str:
    """Six hex digits of the input's hash and the UTC minute, for every output's name."""
    return f"{hashlib.sha256(source).hexdigest()[:6]}_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%MZ}"


def versions(packages: Sequence[str] = ("pyspark", "pyarrow", "pandas", "numpy", "duckdb")) -> dict[str, str]:
    """Versions of the interpreter and the libraries, for reports."""
    out = {"python": platform.python_version()}
    for p in packages:
        try:
            out[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            out[p] = "absent"
    return out


def figure_table(fits: Sequence[tuple[str, float, float]], path: str | None = None) -> list[dict]:
    """Chart-ready rows (label, y, lo, hi) of estimates with standard errors; written as JSON if a path is given."""
    rows = [{"label": n, "y": b, "lo": b - 1.96 * s, "hi": b + 1.96 * s} for n, b, s in fits]
    if path:
        Path(path).write_text(json.dumps(rows))
    return rows
