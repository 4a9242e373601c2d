"""Implausible readings of measured series, by a hidden Markov model per source.

A source is one entity and one kind of reading in order of time. States: normal, spike (a chain
of at most three readings), away (a chain of four or more, no spike), stuck, out of range.
Emissions see how far a reading stands from the running median, in units of the usual change
between neighbouring readings of the source, and whether it equals the reading before it;
hard limits decide what is out of range. Forward-backward probabilities over one half and the
hard bounds on a stuck run assign the flags.

Readings are numbered within their source from counts per day, and a source is cut into chunks
of about CHUNK readings with HALO readings of either neighbour, so a source of any size spreads
over tasks; every source takes this way. What is usual in a source and whether it keeps changing
is of the whole source: where there are several chunks, it is gathered from them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.operators.intervals import _edges
from seriatim.operators.unify import small
from seriatim.session import cut, partitions
from seriatim.sources.tables import micros, require

#: Readings of a chunk and of its overlap on either side; readings of the running median.
CHUNK, HALO, MEDIAN = 4096, 64, 11
#: Usual changes from the running median at which spike and normal are equally likely, and the steepness.
SPIKE, STEEP = 6.6, 3.0
#: Shortest stuck run.
STUCK = 10
#: Shares of changes between neighbours of a source that keeps changing and of one that holds still
#: (a setpoint), and the log likelihood ratio from which the pairs outside its longest run show the first.
MOVES, STILL, EVIDENCE = 0.75, 0.2, 4.0
#: Readings from which the median of all changes tells what is usual; with fewer, down to FEWEST, a
#: spike's own two changes weigh too much, and the two largest are left out.
ENOUGH, FEWEST = 8, 4

N, S1, S2, S3, A1, A2, A3, A4, K, O = range(10)


def _transitions() -> np.ndarray:
    """Prior probabilities of the next state."""
    t = np.zeros((10, 10))
    t[N, [N, S1, A1, K, O]] = 0.93, 0.02, 0.01, 0.02, 0.02
    t[S1, [N, S2, K, O]] = 0.6, 0.36, 0.02, 0.02
    t[S2, [N, S3, K, O]] = 0.6, 0.36, 0.02, 0.02
    t[S3, [N, K, O]] = 0.96, 0.02, 0.02
    t[A1, A2] = t[A2, A3] = t[A3, A4] = 1.0
    t[A4, [N, A4, O]] = 0.3, 0.68, 0.02
    t[K, [N, S1, K, O]] = 0.08, 0.01, 0.9, 0.01
    t[O, [N, S1, A1, K, O]] = 0.9, 0.02, 0.01, 0.02, 0.05
    return t


T = _transitions()
START = np.array([0.95, 0, 0, 0, 0.01, 0, 0, 0, 0.02, 0.02])
END = np.array([1, 0, 0, 0, 0, 0, 0, 1, 1, 1.0])  # a spike has readings after it


def settle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One value per reading of which copies may differ: the one that its neighbour has, else the lower."""
    x = lo.copy()
    for i in np.flatnonzero(lo != hi):
        if i and x[i - 1] in (lo[i], hi[i]):
            x[i] = x[i - 1]
        elif i + 1 < len(x) and hi[i] in (lo[i + 1], hi[i + 1]):
            x[i] = hi[i]
    return x


def run_lengths(x: np.ndarray) -> np.ndarray:
    """For each reading, the length of its run of equal readings."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    n = np.diff(np.r_[edge, len(x)])
    return np.repeat(n, n)


def calm_changes(x: np.ndarray, usual: float) -> np.ndarray:
    """Which pairs of neighbours change, but not beside what may be a spike."""
    far = np.abs(x - running(x)) > 5 * usual  # what may be spikes does not tell what is usual
    return (np.diff(x) != 0) & ~(far[1:] | far[:-1])


def running(x: np.ndarray) -> np.ndarray:
    """The running median; near its ends the series has the window of its first or last readings."""
    n = len(x)
    w = min(MEDIAN, n)
    return np.median(np.lib.stride_tricks.sliding_window_view(x, w), axis=1)[np.clip(np.arange(n) - w // 2, 0, n - w)]


def evidence(x: np.ndarray, source: tuple[int, int, float] | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Log emissions (n, 10) of a series within its limits, its run lengths, and whether its readings keep changing.

    source: changes and pairs outside the longest run, and the usual change, of the whole source
    of which x is a chunk.
    """
    n = len(x)
    e = np.full((n, 10), -60.0)
    e[:, O] = -1e4
    run = run_lengths(x)
    d = np.abs(np.diff(x))
    if source:
        changes, pairs, usual = source
    else:
        longest = int(np.argmax(run))
        outside = np.ones(n - 1, bool)
        outside[longest : longest + run[longest] - 1] = False
        changes, pairs = int((d[outside] > 0).sum()), int(outside.sum())
        moves = np.sort(d[d > 0])
        moves = moves if n >= ENOUGH else moves[:-2]
        usual = np.median(moves) if len(moves) else 0.0
    moving = changes * np.log(MOVES / STILL) + (pairs - changes) * np.log((1 - MOVES) / (1 - STILL)) >= EVIDENCE
    equal = np.r_[False, x[1:] == x[:-1]]
    natural = (pairs - changes + 1) / (pairs + 3)
    e[:, N] = np.where(equal, np.log(natural), np.log1p(-natural))
    if (source or n >= FEWEST) and usual > 0:
        base = running(x)
        if not source and n >= ENOUGH:
            calm = d[calm_changes(x, usual)]
            usual = np.median(calm) if len(calm) >= ENOUGH // 2 else usual
        away = STEEP * (np.abs(x - base) / usual - SPIKE)
        prior = -np.log(T[N, S1] * T[S1, N])  # a lone reading at SPIKE is as likely spike as normal
        e[:, N] -= np.clip(away, 0, 50)
        e[:, S1:K] = (np.where(equal, np.log(natural), np.log1p(-natural)) - np.clip(-away, 0, 50))[:, None]
        e[:, S1] += prior
    e[:, K] = np.where(run < STUCK, -60.0, np.where(equal, -0.01, np.log1p(-natural)))
    if not moving:
        e[:, K] = -60.0
    return e, run, bool(moving)


def posteriors(e: np.ndarray, length: np.ndarray) -> np.ndarray:
    """State probabilities (series, time, state) of padded log emissions by forward-backward."""
    s, t, _ = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    f = np.empty_like(p)
    f[:, 0] = START * p[:, 0] + 1e-300
    f[:, 0] /= f[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, t):
        f[:, k] = (f[:, k - 1] @ T) * p[:, k] + 1e-300
        f[:, k] /= f[:, k].sum(axis=1, keepdims=True)
    b = np.broadcast_to(END, (s, 10)).copy()
    out = np.empty_like(p)
    for k in range(t - 1, -1, -1):
        last = length - 1 == k
        b[last] = END
        g = f[:, k] * b + 1e-300
        out[:, k] = g / g.sum(axis=1, keepdims=True)
        b = (b * p[:, k]) @ T.T
        b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
    return out


def inside(lo: np.ndarray, hi: np.ndarray, low: float | None, high: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Which readings are out of range, and the settled values of the others."""
    low, high = -np.inf if low is None else low, np.inf if high is None else high
    a_in, b_in = (lo >= low) & (lo <= high), (hi >= low) & (hi <= high)
    out = ~(a_in | b_in)
    a, b = np.where(a_in, lo, hi), np.where(b_in, hi, lo)
    return out, settle(a[~out], b[~out])


def flags(series: list[tuple]) -> list[np.ndarray]:
    """For each (lo, hi, low limit, high limit) series, of a chunk with its source: 0 normal, 1 spike, 2 stuck, 3 out of range."""
    done: list[np.ndarray] = [np.zeros(0, np.int8)] * len(series)
    todo = []
    for i, (lo, hi, low, high, *source) in enumerate(series):
        out, x = inside(lo, hi, low, high)
        done[i] = np.where(out, np.int8(3), np.int8(0))
        if len(x) >= 2:
            e, run, _ = evidence(x, *source)
            todo.append((i, np.flatnonzero(~out), e, run, len(lo), x[1:] != x[:-1]))
    todo.sort(key=lambda p: p[4])
    at = 0
    while at < len(todo):
        most = max(todo[at][4] * 1.25, todo[at][4] + 8)
        part = []
        while at < len(todo) and todo[at][4] <= most and sum(p[4] for p in part) < 60_000:
            part.append(todo[at])
            at += 1
        width = max(p[4] for p in part)
        e = np.full((len(part), width, 10), -1e4)
        e[:, :, O] = 0.0  # readings out of range, and the padding
        for k, (_, within, own, *_) in enumerate(part):
            e[k, within] = own
        p = posteriors(e, np.array([x[4] for x in part]))
        for k, (i, within, _, run, _, changes) in enumerate(part):
            q = p[k, within]
            own = np.zeros(len(within), np.int8)
            own[q[:, S1] + q[:, S2] + q[:, S3] > 0.5] = 1
            if (run >= STUCK).any():  # a run is frozen as a whole or not at all
                edge = np.flatnonzero(np.r_[True, changes])
                frozen = np.add.reduceat(q[:, K], edge) / run[edge] > 0.5
                own[(run >= STUCK) & np.repeat(frozen, run[edge])] = 2
            done[i][within] = own
    return done


def _whole(done):
    """Calls done with tables of sorted chunks, each chunk whole in one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 100_000:
                continue
            t = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_edges(t.select(CHUNKS)))[-1])
            if last:
                yield done(t.slice(0, last))
                held = t.slice(last).to_batches()
        if sum(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held))

    return of


CHUNKS = ["entity", "kind", "chunk"]


def _series(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Start and end of each chunk of a table, and its (lo, hi, low limit, high limit)."""
    edge = np.flatnonzero(_edges(t.select(CHUNKS)))
    stop = np.r_[edge[1:], t.num_rows]
    lo, hi = t["lo"].to_numpy(), t["hi"].to_numpy()
    low, high = t["low_limit"].take(pa.array(edge)).to_pylist(), t["high_limit"].take(pa.array(edge)).to_pylist()
    return edge, stop, [(lo[a:z], hi[a:z], p, q) for a, z, p, q in zip(edge, stop, low, high)]


def _flagged(t: pa.Table) -> pa.RecordBatch:
    """Sorted chunks -> the minutes of their own readings that are flagged."""
    edge, _, series = _series(t)
    sources = t.select(["changes", "pairs", "usual"]).take(pa.array(edge)).to_pylist()
    got = np.concatenate(flags([x if q["pairs"] is None else (*x, (q["changes"], q["pairs"], q["usual"] or 0.0)) for x, q in zip(series, sources)]))
    keep = np.flatnonzero((got > 0) & t["own"].to_numpy())
    t = t.select(["entity", "kind", "minute"]).take(pa.array(keep)).append_column("flag", pa.array(got[keep].astype(np.int32))).combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)


def _own(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each chunk its start, its settled readings within limits, and which of them are its own."""
    own = t["own"].to_numpy()
    for a, z, x in zip(*_series(t)):
        out, values = inside(*x)
        yield a, values, own[a:z][~out]


def _changed(t: pa.Table) -> pa.RecordBatch:
    """Sorted chunks -> the changes up to their own readings, calm ones only where the usual change is given."""
    at, d = [], []
    usual = t["usual"].to_numpy() if "usual" in t.column_names else None
    for a, x, own in _own(t):
        if len(x) >= 2:
            on = own[1:] & ((np.diff(x) != 0) if usual is None else calm_changes(x, usual[a]))
            d.append(np.abs(np.diff(x))[on])
            at.append(np.full(len(d[-1]), a))
    at, d = (np.concatenate(v) if v else np.zeros(0) for v in (at, d))
    rows = t.select(["entity", "kind"]).take(pa.array(at.astype(np.int64))).append_column("d", pa.array(d)).combine_chunks()
    return rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)


def _runs(t: pa.Table) -> pa.RecordBatch:
    """Sorted chunks -> of their own readings the number, changes, first and last value with their runs, and the longest run."""
    rows = []
    for a, x, own in _own(t):
        x = x[own]
        if len(x):
            run = run_lengths(x)
            rows.append((a, len(x), int((np.diff(x) != 0).sum()), float(x[0]), float(x[-1]), int(run[0]), int(run[-1]), int(run.max())))
    at, *columns = zip(*rows) if rows else [()] * 8
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    keys = t.select(CHUNKS).take(pa.array(at, pa.int64())).combine_chunks()
    keys = [keys[n].combine_chunks() if keys.num_rows else pa.array([], keys.schema.field(n).type) for n in CHUNKS]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(columns, types))], [*CHUNKS, "n", "turns", "first", "last", "head", "tail", "longest"])


def _joined_runs(key: tuple, t: pa.Table) -> pa.Table:
    """A source's chunks -> changes and pairs outside its longest run; a run may go through chunks."""
    rows = t.sort_by("chunk").to_pylist()
    n, turns, open_, longest, last = 0, 0, 0, 0, None
    for r in rows:
        same = n > 0 and r["first"] == last
        turns += r["turns"] + (n > 0 and not same)
        head = r["head"] + (open_ if same else 0)
        longest = max(longest, head, r["longest"])
        open_ = head if r["turns"] == 0 else r["tail"]
        n, last = n + r["n"], r["last"]
    return pa.table({"entity": pa.array([key[0].as_py()], pa.int64()), "kind": pa.array([key[1].as_py()], pa.int32()), "changes": [turns], "pairs": [n - longest]})


def of_sources(chunks: DataFrame) -> DataFrame:
    """Of each source of several chunks: changes and pairs outside its longest run, and its usual change."""
    source = ["entity", "kind"]
    width = partitions(chunks)
    order = lambda df: df.repartition(width, *CHUNKS).sortWithinPartitions(*CHUNKS, "minute")
    chunks = cut(chunks.where("chunks > 1"))
    many = order(chunks)
    runs = many.mapInArrow(_whole(_runs), "entity bigint, kind int, chunk bigint, n bigint, turns bigint, first double, last double, head bigint, tail bigint, longest bigint")
    moves = runs.groupBy(*source).applyInArrow(_joined_runs, "entity bigint, kind int, changes bigint, pairs bigint")
    change = "entity bigint, kind int, d double"
    every = many.mapInArrow(_whole(_changed), change).groupBy(*source).agg(F.expr("percentile(d, 0.5)").alias("usual"))
    calm = order(chunks.join(every, source)).mapInArrow(_whole(_changed), change).groupBy(*source).agg(F.expr("percentile(d, 0.5)").alias("calm"), F.count("*").alias("m"))
    usual = F.when(F.col("m") >= ENOUGH // 2, F.col("calm")).otherwise(F.col("usual"))
    return moves.join(every, source, "left").join(calm, source, "left").select(*source, "changes", "pairs", F.coalesce(usual, F.lit(0.0)).alias("usual"))


def reading(valuenum: str = "valuenum", value: str = "value") -> Column:
    """valuenum, or else the number that begins the text; null without either, or where it is no finite number."""
    x = F.coalesce(F.when(~F.isnan(valuenum), F.col(valuenum)), F.expr(rf"try_cast(nullif(regexp_extract({value}, '^\\s*([-+]?[0-9]+([.][0-9]+)?)', 1), '') as double)"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def readings(chart: DataFrame, items: DataFrame, category: str = "Routine Vital Signs") -> DataFrame:
    """The readings of one category: row_id, entity, kind, minute, x, low_limit, high_limit."""
    require(chart, ["row_id", "stay_id", "itemid", "charttime", "value", "valuenum"])
    require(items, ["itemid", "category", "low_limit", "high_limit"])
    kinds = small(items.where(F.col("category") == category).select("itemid", "low_limit", "high_limit").dropDuplicates(["itemid"]))
    rows = chart.select("row_id", F.col("stay_id").alias("entity"), "itemid", F.floor(micros("charttime") / 60_000_000).alias("minute"), reading().alias("x"))
    limit = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return rows.dropna(subset=["row_id", "entity", "itemid", "minute", "x"]).join(kinds, "itemid").select("row_id", "entity", F.col("itemid").alias("kind"), "minute", "x", limit("low_limit"), limit("high_limit"))


def chunked(minutes: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Readings with their chunk and whether it is their own; readings near a border also stand in the neighbour."""
    source = ["entity", "kind"]
    minutes = minutes.withColumn("day", F.floor(F.col("minute") / 1440))
    days = minutes.groupBy(*source, "day").agg(F.count("*").alias("of_day"))
    w = Window.partitionBy(*source)
    before = days.select(*source, "day", F.coalesce(F.sum("of_day").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("of_day").over(w).alias("n"))
    k = F.row_number().over(Window.partitionBy(*source, "day").orderBy("minute")) - 1
    r = minutes.withColumn("k", k).join(before, [*source, "day"]).withColumn("rank", F.col("before") + F.col("k")).withColumn("chunks", F.ceil(F.col("n") / chunk))
    r = r.withColumn("c", F.floor(F.col("rank") * F.col("chunks") / F.col("n")))
    start = lambda c: F.ceil(c * F.col("n") / F.col("chunks"))
    near = F.array(F.col("c"), F.when((F.col("c") > 0) & (F.col("rank") < start(F.col("c")) + halo), F.col("c") - 1), F.when((F.col("c") + 1 < F.col("chunks")) & (F.col("rank") >= start(F.col("c") + 1) - halo), F.col("c") + 1))
    return r.withColumn("chunk", F.explode(F.array_compact(near))).withColumn("own", F.col("chunk") == F.col("c"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Readings by the minute, in chunks."""
    minutes = rows.groupBy("entity", "kind", "minute").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("low_limit").alias("low_limit"), F.first("high_limit").alias("high_limit"))
    return chunked(minutes).select("entity", "kind", F.col("chunk").cast("bigint").alias("chunk"), "chunks", "minute", "lo", "hi", "low_limit", "high_limit", "own")


def flagged(chart: DataFrame, items: DataFrame) -> DataFrame:
    """Every implausible reading: row_id, flag (spike, stuck or out of range).

    Readings of one source in one minute are one reading; all its rows are flagged with it,
    and rows out of range by their own reading. Rows with a null id, stay, item, time or without
    a number are no readings; items without limits have no readings out of range. Sources of
    fewer than FEWEST readings have no spikes. A row can have two flags. Repeated rows stay.
    """
    rows = readings(chart, items)
    chunks = _chunks(rows)
    long = small(cut(chart.groupBy("stay_id", "itemid").count().where(F.col("count") > CHUNK).drop("count")))  # no other source has several chunks
    sources = small(cut(of_sources(_chunks(readings(chart.join(long, ["stay_id", "itemid"]), items)))))
    chunks = chunks.join(sources, ["entity", "kind"], "left").drop("chunks")
    ordered = chunks.repartition(partitions(chart), "entity", "kind", "chunk").sortWithinPartitions("entity", "kind", "chunk", "minute")
    marks = ordered.mapInArrow(_whole(_flagged), "entity bigint, kind int, minute bigint, flag int").where("flag < 3")
    name = F.when(F.col("flag") == 1, "spike").otherwise("stuck")
    beyond = rows.where("x < low_limit or x > high_limit").select("row_id", F.lit("out of range").alias("flag"))
    return rows.select("row_id", "entity", "kind", "minute").join(marks, ["entity", "kind", "minute"]).select("row_id", name.alias("flag")).unionByName(beyond)


def found(chart: DataFrame, items: DataFrame) -> DataFrame:
    """The row_ids of all implausible readings, each once."""
    return flagged(chart, items).select("row_id").distinct()
