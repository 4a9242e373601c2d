"""Dense known-item ranks: best-chunk, mean-pooled, centred and random-chunk scores, and dispersion.

Chunks are partitioned and sorted by document, so a document's score is final inside one task;
a stated query set in blocks meets all chunks as matrix products, and only counts per query
leave a partition. Nothing of size queries x documents exists; one pass over the chunks serves up
to PER_JOB queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.operators.lexical import gathered, passes
from seriatim.session import cut, partitions
from seriatim.sources.tables import require

#: Queries of a block and of a pass, decimals of a score, and rows of a matrix product with one block.
QUERIES, PER_JOB, DIGITS, ROWS = 512, 25_600, 9, 8192


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n > 0, n, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def sound(df: DataFrame, vector: str, dim: int = 64) -> DataFrame:
    """Rows whose vector has the length, no null and no all-zero."""
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()) & F.exists(vector, lambda x: x != 0))


def by_document(chunks: DataFrame) -> DataFrame:
    """Chunks (doc, grp, v and, if there is one, chunk) partitioned and sorted by document."""
    chunk = F.col("chunk").cast("bigint") if "chunk" in chunks.columns else F.lit(None).cast("bigint")
    c = chunks.select(F.col("doc").cast("bigint").alias("doc"), F.col("grp").cast("double").alias("grp"), "v", F.coalesce(chunk, F.lit(-1)).alias("chunk"))
    return c.repartition(partitions(chunks), "doc").sortWithinPartitions("doc")


def _runs(batches: Iterator[pa.RecordBatch], value) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Whole documents' rows reduced by maximum: (doc, grp, reduced values) per batch; a cut document is carried over."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        doc, grp = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        s = value(_matrix(b.column(2)), b.column(3).to_numpy(), doc)
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        best = np.maximum.reduceat(s, edge, axis=0)
        d, g = doc[edge], grp[edge]
        if carry is not None:
            if carry[0][0] == d[0]:
                best[0] = np.maximum(best[0], carry[2][0])
            else:
                d, g, best = np.r_[carry[0], d], np.r_[carry[1], g], np.concatenate([carry[2], best])
        carry = d[-1:], g[-1:], best[-1:]
        if len(d) > 1:
            yield d[:-1], g[:-1], best[:-1]
    if carry is not None:
        yield carry


class Block:
    """A block of queries. A query that is a chunk itself (same id) does not see that chunk.

    pooled: documents come as sums of their unit chunks, and a query's own chunk is taken out of
    its target's sum.
    """

    def __init__(self, rows: list, pooled: bool):
        self.ids = [r["query"] for r in rows]
        self.queries, self.pooled = np.array(self.ids, np.int64), pooled
        self.targets = np.array([r["target"] for r in rows], np.int64)
        self.groups = np.array([np.nan if r["grp"] is None else r["grp"] for r in rows], float)
        self.vectors = unit(np.array([r["v"] for r in rows], np.float64))

    def scores(self, v: np.ndarray, chunk: np.ndarray, doc: np.ndarray) -> np.ndarray:
        s = np.round(unit(v) @ self.vectors.T, DIGITS)
        s[chunk[:, None] == self.queries[None, :]] = -np.inf
        if self.pooled:
            at, j = np.nonzero(doc[:, None] == self.targets[None, :])
            rest = v[at] - self.vectors[j]
            there = np.sqrt((rest * rest).sum(axis=1)) > 1e-6
            s[at, j] = np.where(there, np.round((unit(rest) * self.vectors[j]).sum(axis=1), DIGITS), -np.inf)
        return s


def _targets(sent):
    def of(batches):
        blocks: list[Block] = sent.value
        for b in batches:
            for k, block in enumerate(blocks):
                near = np.flatnonzero(np.isin(b.column(0).to_numpy(), block.targets))
                if not len(near):
                    continue
                for d, _, s in _runs(iter([b.take(pa.array(near))]), block.scores):
                    at, j = np.nonzero(d[:, None] == block.targets[None, :])
                    yield pa.RecordBatch.from_pydict({"j": pa.array(j + k * QUERIES, pa.int32()), "target_score": pa.array(s[at, j], pa.float64())})

    return of


def _counts(sent, target: np.ndarray, masked: bool, within: bool):
    """Counts of all blocks in one pass. The scores of every query are worked out for a batch at once, so that a document cut by a batch is carried over once."""

    def of(batches):
        blocks: list[Block] = sent.value
        n = len(target)
        targets, groups = np.concatenate([x.targets for x in blocks]), np.concatenate([x.groups for x in blocks])
        above, equal, sooner, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
        scores = lambda v, chunk, doc: np.concatenate([x.scores(v, chunk, doc) for x in blocks], axis=1)
        few = max(1, ROWS // max(1, len(blocks)))
        small = (b.slice(at, few) for b in batches for at in range(0, b.num_rows, few))
        for d, g, s in _runs(small, scores):
            out = d[:, None] == targets[None, :]
            if within:
                out = out | (np.asarray(g, float)[:, None] != groups[None, :])
            if masked:
                out = out | (np.asarray(g, float)[:, None] == groups[None, :])
            above += ((s > target) & ~out).sum(axis=0)
            equal += ((s == target) & ~out).sum(axis=0)
            sooner += ((s == target) & ~out & (d[:, None] < targets[None, :])).sum(axis=0)
            best = np.maximum(best, np.where(out, -np.inf, s).max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(n), pa.int32()), "n_above": above, "n_equal": equal, "n_sooner": sooner, "best_other": pa.array(best, pa.float64())})

    return of


def outcomes(chunks: DataFrame, queries: DataFrame, masked: bool = False, pooled: bool = False, within: bool = False) -> DataFrame:
    """Each query's target among all documents, a document scoring as its best chunk.

    chunks: doc (bigint), grp (double, null allowed), v, and chunk where queries may be chunks;
    queries: query, target, grp, v. A query never meets the chunk of its own id, as a known item's
    query is removed from its target. masked leaves out other documents of the query's group,
    within those of any other group (an index per cell).
    pooled: v is the sum of a document's unit chunks. Cosines rounded to nine decimals. Result:
    query, target, target_score, n_above, n_equal, n_sooner, best_other (null if there is none); queries
    whose target has no (other) chunk are left out.
    """
    spark = chunks.sparkSession
    ordered = cut(by_document(chunks))
    out = spark.createDataFrame([], "query bigint, target bigint, target_score double, n_above bigint, n_equal bigint, n_sooner bigint, best_other double")
    for rows in passes(queries, PER_JOB):
        blocks = [Block(rows[a : a + QUERIES], pooled) for a in range(0, len(rows), QUERIES)]
        sent = spark.sparkContext.broadcast(blocks)
        got = ordered.mapInArrow(_targets(sent), "j int, target_score double").groupBy("j").agg(F.max("target_score").alias("s")).collect()  # one row per query of the pass
        first = {r["j"]: r["s"] for r in got}
        scores = np.array([first.get(j, np.nan) for j in range(len(rows))])
        counted = ordered.mapInArrow(_counts(sent, scores, masked, within), "j int, n_above bigint, n_equal bigint, n_sooner bigint, best_other double")
        part = gathered(spark, [r["query"] for r in rows], [r["target"] for r in rows], scores, counted)
        out = out.unionByName(part.withColumn("best_other", F.when(F.col("best_other") > F.lit(float("-inf")), F.col("best_other"))))
    return out


def _sums(dim: int, second: bool):
    def of(batches):
        key, n, total, square = None, 0, np.zeros(dim), np.zeros((dim, dim))

        def row():
            v = {"doc": [key], "n": [n], "s": [total.tolist()]}
            if second:
                v["f"] = [float((square * square).sum())]
            return pa.RecordBatch.from_pydict(v, schema=pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))] + ([("f", pa.float64())] if second else [])))

        for b in batches:
            doc, u = b.column(0).to_numpy(), unit(_matrix(b.column(2)))
            edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
            for a, z in zip(edge, np.r_[edge[1:], len(doc)] if len(doc) else []):
                if key is not None and doc[a] != key:
                    yield row()
                    n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
                key, n = int(doc[a]), n + int(z - a)
                total = total + u[a:z].sum(axis=0)
                if second:
                    square = square + u[a:z].T @ u[a:z]
        if key is not None:
            yield row()

    return of


def summed(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """One vector per document, the sum of its unit chunks (its direction is that of their mean): doc, grp, v."""
    s = by_document(chunks).mapInArrow(_sums(dim, False), "doc bigint, n bigint, s array<double>").select("doc", F.col("s").alias("v"))
    return s.join(chunks.groupBy("doc").agg(F.max("grp").alias("grp")), "doc").select("doc", "grp", "v")


def mean_vector(chunks: DataFrame, dim: int = 64) -> list[float]:
    """Mean of all unit chunks; partitions add up first."""
    whole = chunks.select(F.lit(0).cast("bigint").alias("doc"), F.lit(0.0).alias("grp"), "v").mapInArrow(_sums(dim, False), "doc bigint, n bigint, s array<double>")
    got = whole.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]).first()
    return [(got[f"s{i}"] or 0.0) / max(1, got["n"] or 1) for i in range(dim)]


def centred(v: Column, mean: list[float]) -> Column:
    """A unit vector minus the mean; cosines renormalise it."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.zip_with(F.transform(d, lambda x: x / norm), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)


def random_chunk(chunks: DataFrame, chunk: str, seed: str = "s") -> DataFrame:
    """One chunk of each document, the first by hash: doc, grp, v, chunk."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(chunk).cast("string")))
    return chunks.groupBy("doc").agg(F.min_by(F.struct("grp", "v", F.col(chunk).alias("chunk")), order).alias("x")).select("doc", "x.grp", "x.v", "x.chunk")


def dispersion(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """Spread of a document's unit chunks: doc, n, pair_cosine, centroid_cosine, effective_rank (null for one chunk).

    From the sum of vectors and the sum of outer products, which add up, so no pair is formed.
    """
    require(chunks, ["doc", "v"])
    s = by_document(chunks.select("doc", F.lit(0.0).alias("grp"), "v")).mapInArrow(_sums(dim, True), "doc bigint, n bigint, s array<double>, f double")
    q = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    n = F.col("n")
    many = lambda x: F.when(n > 1, x)
    return s.select("doc", "n", many((q - n) / (n * (n - 1))).alias("pair_cosine"), many(F.sqrt(q) / n).alias("centroid_cosine"), many(n * n / F.col("f")).alias("effective_rank"))
