"""Okapi BM25 ranks of known targets: a stated query set against all documents, in blocks.

Ranks need no score table: for each query the score of its own document is found first, then
every partition of documents counts how many of its documents score higher or equal, and these
counts add up. What moves is (queries x partitions) rows. Inside a partition a block of documents
meets the query blocks one after the other as matrix products over the terms of a query block;
one pass over the documents serves up to PER_JOB queries, whose terms are what tasks are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.session import cut, partitions

#: Queries of a block and of a pass, documents of a matrix product, decimals of a score before any comparison.
QUERIES, PER_JOB, DOCUMENTS, DIGITS = 512, 51_200, 256, 9
K1, B, FLOOR = 1.5, 0.75, 0.25


def window_tokens(tokens: Column | str, size: int, stride: int) -> Column:
    """Windows of a token array in the JVM: the whole if it is short, else every stride until the end is reached."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(t, i * stride + 1, size))


def statistics(units: DataFrame) -> tuple[DataFrame, int, float, float]:
    """Term frequencies over units (tokens column): (term, df), number of units, mean length, mean raw idf of the vocabulary."""
    n, mean = units.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    df = cut(units.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))  # the vocabulary, read twice
    raw = df.agg(F.avg(raw_idf("df", n))).first()[0]
    return df, n, float(mean or 0.0), float(raw or 0.0)


def raw_idf(df: str, n: int) -> Column:
    return F.log(F.lit(float(n)) - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)


def word_windows(words: list, size: int, stride: int) -> list[list]:
    """Windows of a word list: all of it if it is short, else every stride until the end is reached; never none."""
    return [words[at : at + size] for at in range(0, max(1, stride * -(-(len(words) - size) // stride) + 1), stride)]


class Weights:
    """Term weights of some documents (or their windows) over the vocabulary of a query set."""

    def __init__(self, docs: list[list[str]], vocabulary: dict[str, int], mean: float, window: tuple[int, int] | None):
        parts = [word_windows(d, *window) for d in docs] if window else [[d] for d in docs]
        units = [u for p in parts for u in p]
        self.n = len(units)
        self.first = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]] if window else None
        known = [[vocabulary[t] for t in u if t in vocabulary] for u in units]
        row = np.repeat(np.arange(self.n), [len(k) for k in known])
        width = max(1, len(vocabulary))
        key, tf = np.unique(row * width + np.array([t for k in known for t in k], np.int64), return_counts=True)
        self.row, self.term = key // width, key % width
        size = np.array([len(u) for u in units], float)
        self.weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.row] / mean))


class Block:
    """A block of queries as a matrix over its terms."""

    def __init__(self, queries: list, vocabulary: dict[str, int], idf: dict[str, float], once: bool):
        self.ids = [q for q, _, _ in queries]
        self.targets = np.array([t for _, t, _ in queries], np.int64)
        own = sorted({vocabulary[t] for _, _, ts in queries for t in ts if t in vocabulary})
        self.place = np.full(len(vocabulary) + 1, -1, np.int32)
        self.place[own] = np.arange(len(own))
        self.matrix = np.zeros((len(own), len(queries)))
        for j, (_, _, ts) in enumerate(queries):
            for t in set(ts) if once else ts:
                if t in vocabulary:
                    self.matrix[self.place[vocabulary[t]], j] += idf[t]

    def scores(self, w: Weights) -> np.ndarray:
        """Scores (documents, queries); with windows the best of a document's windows."""
        k = self.place[w.term]
        keep = k >= 0
        dense = np.zeros((w.n, len(self.matrix)))
        dense[w.row[keep], k[keep]] = w.weight[keep]
        s = np.round(dense @ self.matrix, DIGITS)
        return s if w.first is None else np.maximum.reduceat(s, w.first, axis=0)


class QuerySet:
    """Blocks of queries with one vocabulary; a query's number is its place in the set."""

    def __init__(self, queries: list, idf: dict[str, float], mean: float, once: bool, window: tuple[int, int] | None):
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, ts in queries for t in ts} & idf.keys()))}
        self.blocks = [Block(queries[a : a + QUERIES], self.vocabulary, idf, once) for a in range(0, len(queries), QUERIES)]
        self.mean, self.window, self.n = mean, window, len(queries)

    def weights(self, docs: list[list[str]]) -> Weights:
        return Weights(docs, self.vocabulary, self.mean, self.window)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    for b in batches:
        for at in range(0, b.num_rows, DOCUMENTS):
            part = b.slice(at, DOCUMENTS)
            yield part.column(0).to_numpy().astype(np.int64), part.column(1).to_pylist()


def _targets(sent):
    def of(batches):
        asked: QuerySet = sent.value
        for ids, docs in _batches(batches):
            w = asked.weights(docs)
            for k, block in enumerate(asked.blocks):
                at, j = np.nonzero(ids[:, None] == block.targets[None, :])
                if len(at):
                    yield pa.RecordBatch.from_pydict({"j": pa.array(j + k * QUERIES, pa.int32()), "target_score": pa.array(block.scores(w)[at, j], pa.float64())})

    return of


def _counts(sent, target: np.ndarray):
    def of(batches):
        asked: QuerySet = sent.value
        n = len(target)
        above, equal, sooner, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
        for ids, docs in _batches(batches):
            w = asked.weights(docs)
            for k, block in enumerate(asked.blocks):
                z = slice(k * QUERIES, k * QUERIES + len(block.ids))
                s = block.scores(w)
                own = ids[:, None] == block.targets[None, :]
                above[z] += ((s > target[z]) & ~own).sum(axis=0)
                equal[z] += ((s == target[z]) & ~own).sum(axis=0)
                sooner[z] += ((s == target[z]) & (ids[:, None] < block.targets[None, :])).sum(axis=0)
                best[z] = np.maximum(best[z], np.where(own, -np.inf, s).max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(n), pa.int32()), "n_above": above, "n_equal": equal, "n_sooner": sooner, "best_other": pa.array(best, pa.float64())})

    return of


def passes(asked: DataFrame, per: int) -> Iterator[list]:
    """Rows of a query set in parts of `per` at most on average, by hash; each part is what one pass over the documents serves."""
    shares = max(1, -(-asked.count() // per))
    share = asked.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(shares))) if shares > 1 else asked
    for b in range(shares):
        rows = (share.where(F.col("_b") == b) if shares > 1 else share).collect()
        if rows:
            yield rows


def gathered(spark, ids: list, targets: np.ndarray, scores: np.ndarray, counted: DataFrame) -> DataFrame:
    """Queries with a target score beside their added-up counts."""
    head = spark.createDataFrame([(j, int(q), int(t), float(s)) for j, (q, t, s) in enumerate(zip(ids, targets, scores)) if s > -2], "j int, query bigint, target bigint, target_score double")
    total = counted.groupBy("j").agg(F.sum("n_above").alias("n_above"), F.sum("n_equal").alias("n_equal"), F.sum("n_sooner").alias("n_sooner"), F.max("best_other").alias("best_other"))
    return head.join(total, "j").drop("j")


def outcomes(docs: DataFrame, queries: DataFrame, once: bool = False, window: tuple[int, int] | None = None, document_idf: bool = False) -> DataFrame:
    """Each query's target among all documents: query, target, target_score, n_above, n_equal, n_sooner, best_other.

    docs: doc (bigint), tokens; queries: query, target, tokens. once counts a repeated query term
    once. window scores a document by its best word window, with term statistics of windows, or,
    with document_idf, document frequencies and counts of documents. Negative idf become FLOOR
    times the vocabulary's mean. A document that shares no term scores 0. Scores are rounded to
    nine decimals before they are compared. Queries without a target in docs are left out. docs is
    read once for the statistics and twice a pass, so it should be cut before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc").cast("bigint").alias("doc"), "tokens")
    units = docs.select(F.explode(window_tokens("tokens", *window)).alias("tokens")) if window else docs
    df, n, mean, average = statistics(units)
    if window and document_idf:
        df, n, _, average = statistics(docs)
    value = raw_idf("df", n)
    idf = df.select("term", F.when(value < 0, FLOOR * average).otherwise(value).alias("idf"))
    asked = queries.select("query", F.col("target").cast("bigint").alias("target"), "tokens")
    empty = "query bigint, target bigint, target_score double, n_above bigint, n_equal bigint, n_sooner bigint, best_other double"
    out = spark.createDataFrame([], empty)
    for rows in passes(asked, PER_JOB):
        terms = spark.createDataFrame([(t,) for t in {t for r in rows for t in r["tokens"]}], "term string")
        known = {r["term"]: r["idf"] for r in idf.join(F.broadcast(terms), "term").collect()}  # the terms of a pass
        a_set = QuerySet([(r["query"], r["target"], r["tokens"]) for r in rows], known, mean, once, window)
        sent = spark.sparkContext.broadcast(a_set)
        wanted = spark.createDataFrame([(int(t),) for t in {r["target"] for r in rows}], "doc bigint")  # at most PER_JOB rows
        first = {r["j"]: r["target_score"] for r in docs.join(F.broadcast(wanted), "doc", "left_semi").mapInArrow(_targets(sent), "j int, target_score double").collect()}
        scores = np.array([first.get(j, np.nan) for j in range(len(rows))])
        counted = docs.mapInArrow(_counts(sent, scores), "j int, n_above bigint, n_equal bigint, n_sooner bigint, best_other double")
        out = out.unionByName(gathered(spark, [r["query"] for r in rows], [r["target"] for r in rows], scores, counted))
    return out


def ranked(o: DataFrame, ties: str = "optimistic", cutoff: int = 10) -> DataFrame:
    """Outcomes with rank, reciprocal rank, hit and margin.

    optimistic: one more than the documents above; pessimistic: equal ones rank before the
    target; by_id: equal ones of a smaller id do.
    """
    rank = F.col("n_above") + {"optimistic": F.lit(0), "pessimistic": F.col("n_equal"), "by_id": F.col("n_sooner")}[ties] + 1
    o = o.withColumn("rank", rank)
    top = F.col("rank") <= cutoff
    return o.withColumn("rr", F.when(top, 1 / F.col("rank")).otherwise(0.0)).withColumn("hit", top.cast("int")).withColumn("margin", F.col("target_score") - F.col("best_other"))
