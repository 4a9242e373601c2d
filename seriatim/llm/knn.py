"""The most similar vectors of every vector, by cells of directions that each row asks in its own order.

Directions are cut into cells around centres fitted on a sample (spherical k-means). Every row
lies in the cell of its nearest centre and asks the cells of the centres nearest to itself until
it has met a number of rows of other documents, the reach. A sample of rows is compared with every
vector; the reach is what TARGET of the sample's true neighbours need. Nothing else is left out:
the rows asked are ranked exactly, with ties.
Cells are ordered along a Hilbert curve through their centres and packed into parts, the unit of a
task, where counts of rows say so. Rows are shipped once, to their part; a task then reads the
parts that its rows ask one after the other from the cut (a Cartesian product whose one side is a
stream), so no vector is copied for a second task and every ranking is finished where it began.
Copies are handled as classes of one vector: a class brings to the cells only the few members
that any ranking can need, and every member gets the ranking of its class.

The centres are fitted on a bounded sample of the vectors (FIT_ROWS); every vector is placed,
compared and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.operators.skew import spread_join
from seriatim.session import cut
from seriatim.sources.tables import require

K = 5
#: Rows of a block, which are those of a cell; windows of three blocks that a row meets at least; most cells, and rounds of fitting their centres.
BLOCK, CURVES, CELLS, FITS = 96, 32, 2048, 8
#: Dimensions and bits per dimension of the curve that orders the cells.
DIMS, BITS = 10, 6
#: Rows of a part, up to four times as many where there are more than PARTS of them; a cell beyond a part's rows is split by hash.
PART, PARTS = 8192, 24
#: Rows of the sample on which the centres are fitted, and the seed of the fit.
FIT_ROWS, SEED = 20_000, 20
#: Share of the true neighbours of ASKED sampled rows that the reach must hold.
TARGET, ASKED = 0.98, 1024
#: Columns of a group of top_columns.
GROUP = 16
#: More than the error of a float32 similarity.
NEAR = 1e-6
#: Bytes that a task packs before it hands them on, hits that are ranked at once, rows compared at once.
PACKED, HITS, SLAB = 8_000_000, 100_000, 1024
#: Bytes of an Arrow batch of the stream of parts, so that two tasks of an executor hold little of it.
BATCH, STREAMED = "spark.sql.execution.arrow.maxBytesPerBatch", "12m"
#: Members of classes of copies up to which their flags are broadcast.
FLAGS = 200_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows, dims), by Skilling's transpose."""
    x = [c.astype(np.uint32) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            on = (x[i] & np.uint32(q)) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint32(q)) != 0, t ^ np.uint32(q - 1), t)
        q >>= 1
    key = np.zeros(len(t), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] ^ t) >> np.uint32(b) & 1).astype(np.int64)
    return key


def directions(sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections (curves, dim, dims) that favour directions of much variance, their scales and shifts."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    value, vector = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
    weight = vector * np.sqrt(np.maximum(value, 0))
    projections = np.stack([np.linalg.qr(weight @ rng.normal(size=(dim, dims)))[0] for _ in range(curves)])
    spread = np.maximum(np.stack([(sample @ p).std(axis=0) for p in projections]), 1e-9)
    return projections, spread, rng.uniform(-0.1, 0.1, size=(curves, dims))


def keys(unit: np.ndarray, projection: np.ndarray, spread: np.ndarray, shift: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve positions of unit vectors under one projection."""
    at = (unit @ projection / (6 * spread) + 0.5 + shift) * (1 << bits)
    return hilbert(np.clip(at, 0, (1 << bits) - 1).astype(np.int64), bits)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Parts:
    """Where a curve is cut: the part of each stretch of keys, its shares, and the parts that get a copy of it."""

    def __init__(self, counts: np.ndarray, low: int, size: int, block: int):
        """counts: rows of each stretch; low: bits of a key below its stretch; size, block: rows of a part and of its borders."""
        self.low = low
        n = len(counts)
        self.part, self.shares = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.before, self.after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        part, held, borders = 0, 0, []
        for i, c in enumerate(counts):
            hot = c > size
            if held and (hot or held + c > size):
                part, held = part + 1, 0
                borders += [] if hot else [i]
            self.part[i] = part
            if hot:
                self.shares[i] = -(-c // size)
                part += int(self.shares[i])
            else:
                held += int(c)
        self.total = part + 1
        for i in borders:
            for beside, step, to in ((range(i - 1, -1, -1), self.after, self.part[i]), (range(i, n), self.before, self.part[i - 1])):
                seen, own = 0, self.part[beside[0]]
                for j in beside:
                    if seen >= block or self.part[j] != own or self.shares[j] > 1:
                        break
                    step[j] = to
                    seen += int(counts[j])

    def of(self, key: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part of each row, and the parts before and after that also see it (-1: none)."""
        at = key >> self.low
        part, shares = self.part[at], self.shares[at]
        many = shares > 1
        if many.any():
            part[many] += (chunk[many] * 0x9E3779B1 >> 7) % shares[many]
        return part, self.before[at], self.after[at]


def centres(sample: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Centres of at most n cells of directions, in the order of a Hilbert curve through them."""
    sample = sample.astype(np.float32)
    c = sample[np.sort(np.random.default_rng(seed).choice(len(sample), min(n, len(sample)), replace=False))]
    for _ in range(FITS):
        of = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        order = np.argsort(of, kind="stable")
        has = np.unique(of)
        sums = np.add.reduceat(sample[order].astype(np.float64), np.searchsorted(of[order], has), axis=0)
        norm = np.linalg.norm(sums, axis=1)
        c[has[norm > 1e-9]] = (sums / np.maximum(norm, 1e-9)[:, None])[norm > 1e-9]
    projection, spread, shift = directions(c.astype(np.float64), 1)
    return c[np.argsort(keys(c.astype(np.float64), projection[0], spread[0], shift[0]), kind="stable")]


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(code)).astype(np.int64)


def _surveyed(centre: np.ndarray, asked: np.ndarray, own: np.ndarray, crowded: np.ndarray, dim: int, k: int):
    """Rows of a partition -> kind 0: rows of each cell; 1: rows of each crowded document in it; 2: of each asked vector, the k most similar of other documents and their cells."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, docs = np.zeros(len(centre), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        best, cell = np.full((len(asked), k), -9.0), np.zeros((len(asked), k), np.int64)
        for b in batches:
            for a in range(0, b.num_rows, SLAB):
                part = b.slice(a, SLAB)
                u, did = unit_rows(_vectors(part.column("dv"), dim)), part.column("did").to_numpy()
                at = (u.astype(np.float32) @ centre.T).argmax(axis=1)
                rows += np.bincount(at, minlength=len(centre))
                if len(crowded):
                    doc = np.minimum(np.searchsorted(crowded, did), len(crowded) - 1)
                    on = crowded[doc] == did
                    docs.append(np.unique(doc[on] * len(centre) + at[on], return_counts=True))
                    if len(docs) > 64:
                        docs = [_summed(docs)]
                s = asked @ u.T
                s[own[:, None] == did[None, :]] = -9
                top = top_columns(s, k)
                s = np.concatenate([best, np.take_along_axis(s, top, axis=1)], axis=1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best, cell = np.take_along_axis(s, order, axis=1), np.take_along_axis(np.concatenate([cell, at[top]], axis=1), order, axis=1)
        c, (code, n), (i, j) = np.flatnonzero(rows), _summed(docs), np.nonzero(best > -9)
        d, e = np.divmod(code, len(centre))
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(c), len(d), len(i)])
        none = np.zeros(len(c) + len(d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), *(pa.array(np.concatenate(x)) for x in ((c, crowded[d], i), (np.zeros_like(c), e, np.zeros_like(i)), (rows[c], n, cell[i, j]), (none, best[i, j])))], ["kind", "a", "b", "n", "s"]
        )

    return of


class Reach:
    """How far rows ask: rows of each cell, of all documents and of each crowded one, and the rows to be met."""

    def __init__(self, rows: np.ndarray, docs: dict[int, tuple[np.ndarray, np.ndarray]]):
        """docs: of each crowded document the cells that it lies in, and its rows there."""
        self.rows, self.docs, self.least = rows, docs, 0
        self.crowded, most = np.array(sorted(docs), np.int64), np.zeros_like(rows)
        for cells, n in docs.values():
            most[cells] = np.maximum(most[cells], n)
        self.any = rows - most

    def fit(self, sims: np.ndarray, own: np.ndarray, true: list[list[int]], target: float, least: int) -> None:
        """sims: of the sampled rows and the centres; true: the cells of their neighbours."""
        need = []
        for s, did, cells in zip(sims, own, true):
            order = np.argsort(-s, kind="stable")
            met = np.empty(len(s), np.int64)
            met[order] = np.cumsum(self.docs_without(int(did))[order])
            need += [int(met[c]) for c in cells]
        need.sort()
        self.least = max(least, need[max(0, int(np.ceil(target * len(need))) - 1)] if need and target > 0 else 0)

    def docs_without(self, did: int) -> np.ndarray:
        rows = self.rows.copy()
        if did in self.docs:
            rows[self.docs[did][0]] -= self.docs[did][1]
        return rows

    def of(self, sims: np.ndarray, did: np.ndarray, multi: np.ndarray) -> np.ndarray:
        """The least similarity of a centre that each row asks; a class of several documents asks as if without any one of them."""
        out = self._least(sims, self.rows)
        if self.docs:
            group = np.where(multi, -2, np.where(np.isin(did, self.crowded), did, -1))
            for g in np.unique(group[group != -1]):
                on = np.flatnonzero(group == g)
                out[on] = self._least(sims[on], self.any if g == -2 else self.docs_without(int(g)))
        return out

    def _least(self, sims: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """By halving: enough rows lie in cells at least as similar."""
        if len(sims) > SLAB // 8:
            return np.concatenate([self._least(sims[a : a + SLAB // 8], rows) for a in range(0, len(sims), SLAB // 8)])
        low, high = sims.min(axis=1) - np.float32(1e-3), sims.max(axis=1)
        weight = rows.astype(np.float32)
        low = np.where((sims >= high[:, None]) @ weight >= self.least, high, low)
        for _ in range(11):
            mid = (low + high) / 2
            enough = (sims >= mid[:, None]).astype(np.float32) @ weight >= self.least
            low, high = np.where(enough, mid, low), np.where(enough, high, mid)
        return low


def _row_type(dim: int) -> np.dtype:
    return np.dtype([("chunk", "i8"), ("did", "i8"), ("q", "i8"), ("cell", "i4"), ("kind", "i4"), ("far", "f4"), ("v", "f4", (dim,))])


QUERY, CLASS, MULTI = 1, 2, 4


def _packed_parts(centre: np.ndarray, reach: Reach, parts: Parts, dim: int):
    """Rows -> packed rows of each part, and the cells that they ask, as bits."""
    kind_of = _row_type(dim)

    def flush(held: dict[int, list]) -> pa.RecordBatch:
        at = sorted(held)
        blobs = [b"".join(x.tobytes() for x, _ in held[p]) for p in at]
        bits = [np.packbits(np.any([m for _, m in held[p]], axis=0)).tobytes() for p in at]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary()), pa.array(bits, pa.binary())], ["part", "rows", "cells"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for whole in batches:
            for a in range(0, whole.num_rows, SLAB):
                b = whole.slice(a, SLAB)
                v = _vectors(b.column("dv"), dim)
                sims = unit_rows(v).astype(np.float32) @ centre.T
                rows = np.zeros(len(v), kind_of)
                query, copied, multi = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int32) for n in ("query", "copied", "multi"))
                rows["chunk"], rows["did"], rows["q"], rows["v"] = *(b.column(n).to_numpy() for n in ("chunk_id", "did", "q")), v
                rows["kind"], rows["cell"] = query * QUERY + copied * CLASS + multi * MULTI, sims.argmax(axis=1)
                rows["far"] = reach.of(sims, rows["did"], multi > 0) - NEAR
                asks = (sims >= rows["far"][:, None]) & (query > 0)[:, None]
                part, _, _ = parts.of(rows["cell"].astype(np.int64), rows["chunk"])
                order = np.argsort(part, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
                for x, y in zip(edge, [*edge[1:], len(order)]):
                    on = order[x:y]
                    held.setdefault(int(part[on[0]]), []).append((rows[on], asks[on].any(axis=0)))
                size += rows.nbytes
                if size >= PACKED:
                    yield flush(held)
                    size = 0
        if held:
            yield flush(held)

    return of


def _whole_parts(parts: Parts, dim: int, n: int):
    """Packed rows in order of parts -> one row a part: its rows by cell and chunk, and the parts that they ask."""
    kind_of = _row_type(dim)
    cell_of = np.repeat(np.arange(n), parts.shares)
    part_of = np.repeat(parts.part, parts.shares) + np.arange(parts.shares.sum()) - np.repeat(np.cumsum(parts.shares) - parts.shares, parts.shares)

    def whole(part: int, blobs: list[bytes], bits: list[bytes]) -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(b, kind_of) for b in blobs])
        rows = rows[np.lexsort((rows["chunk"], rows["cell"]))]
        cells = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits]))[:n] > 0
        asks = np.unique(part_of[cells[cell_of]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([asks.tolist()], pa.list_(pa.int32())), pa.array([rows.tobytes()], pa.binary())], ["part", "asks", "rows"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, bits = None, [], []
        for b in batches:
            for p, blob, bit in zip(*(b.column(n).to_pylist() for n in ("part", "rows", "cells"))):
                if p != now and blobs:
                    yield whole(now, blobs, bits)
                    blobs, bits = [], []
                now = p
                blobs.append(blob)
                bits.append(bit)
        if blobs:
            yield whole(now, blobs, bits)

    return of


def top_columns(s: np.ndarray, most: int) -> np.ndarray:
    """Columns of the `most` largest entries of each row, in no order.

    Columns form groups of GROUP (equal modulo the number of groups, so maxima run over whole
    rows); the largest entries lie in the groups of largest maximum, and only those are sorted.
    """
    n, w = s.shape
    if w <= most:
        return np.tile(np.arange(w), (n, 1))
    groups = -(-w // GROUP)
    if groups <= 2 * most:
        return np.argpartition(s, w - most, axis=1)[:, w - most :]
    pad = groups * GROUP - w
    p = (np.concatenate([s, np.full((n, pad), -np.inf, s.dtype)], axis=1) if pad else s).reshape(n, GROUP, groups)
    chosen = np.argpartition(p.max(axis=1), groups - most, axis=1)[:, groups - most :]
    part = np.take_along_axis(p, chosen[:, None, :], axis=2).reshape(n, -1)
    columns = (chosen[:, None, :] + np.arange(GROUP)[None, :, None] * groups).reshape(n, -1)
    k = part.shape[1]
    return np.take_along_axis(columns, np.argpartition(part, k - most, axis=1)[:, k - most :], axis=1)


def _entry_type(k: int) -> np.dtype:
    """The ranking of a class: its first chunk, and k chunks with their documents and similarities; a chunk of -1 is none."""
    return np.dtype([("q", "i8"), ("chunk", "i8", (k,)), ("did", "i8", (k,)), ("s", "f8", (k,))])


def _short_type(k: int) -> np.dtype:
    """The ranking of a single vector."""
    return np.dtype([("q", "i8"), ("chunk", "i8", (k,)), ("s", "f8", (k,))])


class Rankings:
    """The rankings of a part's queries; begins with the rows of each query's own cell, which it always asks."""

    def __init__(self, rows: np.ndarray, centre: np.ndarray, k: int):
        u = unit_rows(rows["v"])
        asks = np.flatnonzero(rows["kind"] & QUERY)
        self.k, self.centre, self.rows, self.u = k, centre, rows[asks], u[asks]
        self.u32, self.multi = self.u.astype(np.float32), (self.rows["kind"] & MULTI) > 0
        self.best = np.zeros(len(asks), _entry_type(2 * k))  # of a single vector k places only
        self.best["q"], self.best["chunk"], self.best["s"] = self.rows["q"], -1, -9
        self.floor = np.full(len(asks), -9, np.float32)
        c32 = u.astype(np.float32)
        edge = np.flatnonzero(np.r_[True, np.diff(rows["cell"]) != 0])
        first = np.searchsorted(asks, [*edge, len(rows)])
        for n, (x, y) in enumerate(zip(edge, [*edge[1:], len(rows)])):
            for a in range(first[n], first[n + 1], SLAB):
                at = np.arange(a, min(a + SLAB, first[n + 1]))
                s = self.u32[at] @ c32[x:y].T
                s[~self.multi[at][:, None] & (rows["did"][x:y][None, :] == self.rows["did"][at][:, None])] = -9
                if y - x > k:  # the best of a class may be those of few documents: all of them
                    least = np.take_along_axis(s, top_columns(s, k), axis=1).min(axis=1) - NEAR
                    i, j = np.nonzero(s >= np.where(self.multi[at], -8, np.maximum(least, -8))[:, None])
                else:
                    i, j = np.nonzero(s > -8)
                self._take(at[i], x + j, rows["chunk"], rows["did"], u)
        self.meet(rows, True)

    def meet(self, rows: np.ndarray, own: bool = False) -> None:
        """Ranks the rows of a part, in order of cells, for the queries that ask them; of their own part without their own cell."""
        cu = unit_rows(rows["v"])
        c32 = cu.astype(np.float32)
        edge = np.flatnonzero(np.r_[True, np.diff(rows["cell"]) != 0])
        asked = self.u32 @ self.centre[rows["cell"][edge]].T >= self.rows["far"][:, None]
        if own:
            asked &= rows["cell"][edge][None, :] != self.rows["cell"][:, None]
        qs, cs, held = [], [], 0
        for n, (x, y) in enumerate(zip(edge, [*edge[1:], len(rows)])):
            at = np.flatnonzero(asked[:, n])
            step = max(1, SLAB * SLAB // max(SLAB, y - x))
            for a in range(0, len(at), step):
                ask = at[a : a + step]
                s = self.u32[ask] @ c32[x:y].T
                on = np.flatnonzero(s.max(axis=1) >= self.floor[ask])
                if len(on):
                    i, j = np.nonzero(s[on] >= self.floor[ask[on]][:, None])
                    qs.append(ask[on[i]])
                    cs.append(x + j)
                    held += len(i)
                if held >= HITS:
                    self._take(np.concatenate(qs), np.concatenate(cs), rows["chunk"], rows["did"], cu)
                    qs, cs, held = [], [], 0
        if held:
            self._take(np.concatenate(qs), np.concatenate(cs), rows["chunk"], rows["did"], cu)

    def _take(self, i: np.ndarray, j: np.ndarray, chunk: np.ndarray, did: np.ndarray, cu: np.ndarray) -> None:
        """Ranks candidates j for queries i; of many ties those of the smallest chunks first, as they rule out most of the others."""
        keep = self.multi[i] | (did[j] != self.rows["did"][i])
        i, j = i[keep], j[keep]
        order = np.lexsort((chunk[j], i)) if len(i) > HITS else np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        if len(i) <= HITS:
            self._rank(i, j, chunk, did, cu)
            return
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        n = np.diff(np.r_[start, len(i)])
        early = np.arange(len(i)) - np.repeat(start, n) < 8 * self.k
        for on in (early, ~early):
            a, b = i[on], j[on]
            # no similarity is over one, so where the last is one only smaller chunks can enter
            full = self.multi[a] | (self.best["s"][a, self.k - 1] < 1) | (chunk[b] < self.best["chunk"][a, self.k - 1])
            a, b = a[full], b[full]
            at = 0
            while at < len(a):
                z = min(at + HITS, len(a))
                self._rank(a[at:z], b[at:z], chunk, did, cu)
                at = z

    def _rank(self, i: np.ndarray, j: np.ndarray, chunk: np.ndarray, did: np.ndarray, cu: np.ndarray) -> None:
        if not len(i):
            return
        k, best, many = self.k, self.best, self.multi[i]
        s = np.round(np.einsum("nd,nd->n", self.u[i], cu[j]), 9)
        for these, width in ((~many, k), (many, 2 * k)):
            a, b = i[these], j[these]
            on = np.unique(a)
            if not len(on):
                continue
            q, c, d, x = np.r_[np.repeat(on, width), a], np.r_[best["chunk"][on, :width].ravel(), chunk[b]], np.r_[best["did"][on, :width].ravel(), did[b]], np.r_[best["s"][on, :width].ravel(), s[these]]
            order = np.lexsort((c, -x, q))
            if width > k:  # at most k of a did
                by = order[np.lexsort((d[order], q[order]))]
                start = np.flatnonzero(np.r_[True, (q[by][1:] != q[by][:-1]) | (d[by][1:] != d[by][:-1])])
                late = np.zeros(len(q), bool)
                late[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)])) >= k
                order = order[~late[order] | (c[order] < 0)]
            start = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0])
            first = order[(start[:, None] + np.arange(width)).ravel()]  # a query has its old places at least
            for name, y in (("chunk", c), ("did", d), ("s", x)):
                best[name][on, :width] = y[first].reshape(-1, width)
            self.floor[on] = np.where(best["chunk"][on, width - 1] >= 0, best["s"][on, width - 1] - NEAR, -9)

    def packed(self) -> pa.RecordBatch:
        alone = (self.rows["kind"] & CLASS) == 0
        short = np.zeros(int(alone.sum()), _short_type(self.k))
        short["q"] = self.best["q"][alone]
        for n in ("chunk", "s"):
            short[n] = self.best[n][alone, : self.k]
        return pa.RecordBatch.from_arrays([pa.array([short.tobytes()], pa.binary()), pa.array([self.best[~alone].tobytes()], pa.binary())], ["one", "many"])


def _ranked(centre: np.ndarray, dim: int, k: int):
    """Pairs of a part and one that it asks; the rows of the part itself come with part -1, first unless the cluster orders otherwise."""
    kind_of = _row_type(dim)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Rankings] = {}
        early: dict[int, list[bytes]] = {}  # of a cluster that orders otherwise
        for b in batches:
            for n in range(b.num_rows):
                own, part = b.column("own")[n].as_py(), b.column("part")[n].as_py()
                blob = b.column("rows")[n].as_buffer()
                if part == -1:
                    held[own] = Rankings(np.frombuffer(blob, kind_of), centre, k)
                    for x in early.pop(own, []):
                        held[own].meet(np.frombuffer(x, kind_of))
                elif part != own and own in held:
                    held[own].meet(np.frombuffer(blob, kind_of))
                elif part != own:
                    early.setdefault(own, []).append(blob.to_pybytes())
        for own in sorted(held):
            yield held[own].packed()

    return of


def _unpacked(k: int):
    """Packed rankings of single vectors -> chunk_id, near, rank, similarity."""
    short = _short_type(k)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("one").to_pylist():
                e = np.frombuffer(blob, short)
                chunk = e["chunk"].ravel()
                keep = chunk >= 0
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(e))
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.repeat(e["q"], k), chunk, rank, e["s"].ravel())], ["chunk_id", "near", "rank", "similarity"])

    return of


def _listed(k: int):
    """Packed rankings of classes -> q, chunk, did, s."""
    long = _entry_type(2 * k)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("many").to_pylist():
                e = np.frombuffer(blob, long)
                chunk = e["chunk"].ravel()
                keep = chunk >= 0
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.repeat(e["q"], 2 * k), chunk, e["did"].ravel(), e["s"].ravel())], ["q", "chunk", "did", "s"])

    return of


def members(df: DataFrame, dim: int) -> DataFrame:
    """Usable rows with their class: chunk_id, did, dv, c1, c2."""
    require(df, ["chunk_id", "did", "dv"])
    sound = F.forall("dv", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("dv") == dim) & F.exists("dv", lambda x: x != 0)
    return df.select("chunk_id", "did", F.col("dv").cast("array<float>").alias("dv")).dropna().where(sound).withColumn("c1", F.xxhash64("dv")).withColumn("c2", F.xxhash64(F.lit(1), "dv"))


def representatives(rows: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Single rows, and the members of each class that some ranking can need: of the smallest chunk ids, k of a did, 2k in all.

    Whichever did a query excludes, at least k of the others remain, and they are the smallest.
    copies: the members of classes without their vectors. The flags of few are broadcast, so that
    vectors stay where they are read; of many they are joined, and the result is cut.
    """
    by_did = Window.partitionBy("q", "did").orderBy("chunk_id")
    by_class = Window.partitionBy("q").orderBy("chunk_id")
    few = copies.withColumn("r", F.row_number().over(by_did)).where(F.col("r") <= k).withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= 2 * k)
    kept = few.select("c1", "c2", "chunk_id", "did", (F.col("n") == 1).alias("query"))
    flags = cut(copies.join(kept, ["c1", "c2", "chunk_id", "did"], "left"))
    small = flags.count() <= FLAGS
    found = rows.join(F.broadcast(flags) if small else flags, ["c1", "c2", "chunk_id", "did"], "left").where("q is null or query is not null")
    reps = found.select("c1", "chunk_id", "did", "dv", F.coalesce("query", F.lit(True)).alias("query"), F.col("q").isNotNull().alias("copied"), F.coalesce("multi", F.lit(False)).alias("multi"), F.coalesce("q", "chunk_id").alias("q"))
    return reps if small else cut(reps)


def nearest(df: DataFrame, k: int = K, dim: int = 64, curves: int = CURVES, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """For every vector the k most similar chunks of other documents: chunk_id, near, rank (1..k), similarity.

    Cosine similarity rounded to nine decimals, ties to the smaller chunk_id. Rows with a null
    id, did or vector, with null or non-finite numbers, of another length, or all zero are left
    out; chunk ids are not negative. Copies are ranked like any other chunk of another document.
    Chunks with fewer than k others get fewer. Approximate: a row meets `curves` windows of three
    blocks at least, and as many more rows as `target` of the true neighbours of a sample need.
    """
    rows, least = members(df, dim), max(3 * curves * block, block + 2 * k)
    ids = rows.select("c1", "c2", "chunk_id", "did")
    classes = cut(ids.groupBy("c1", "c2").agg(F.min("chunk_id").alias("q"), F.count("*").alias("n"), (F.min("did") != F.max("did")).alias("multi")).where("n > 1"))
    copies = cut(spread_join(ids, classes, ["c1", "c2"], "n").select("c1", "c2", "chunk_id", "did", "q", "n", "multi"))
    reps = representatives(rows, copies.drop("n"), k)
    held = reps.groupBy("did").count().agg(F.sum("count").alias("n"), F.collect_list(F.when(F.col("count") > least // 8, F.col("did"))).alias("crowded")).first()
    if not held["n"]:
        return df.sparkSession.createDataFrame([], "chunk_id bigint, near bigint, rank int, similarity double")
    place = F.xxhash64("c1", "chunk_id")
    early = int(-(2**63) + min(1.0, 2 * FIT_ROWS / held["n"]) * (2**64 - 2**12))  # twice the sample, so that tasks need not ship a sample each
    sample = reps.where(F.col("query") & (place <= F.lit(early))).orderBy(place, "chunk_id").select("did", "dv").limit(FIT_ROWS).toArrow().combine_chunks()
    vectors = unit_rows(_vectors(sample["dv"].combine_chunks(), dim))
    centre = centres(vectors, max(1, min(CELLS, held["n"] // block)))
    asked, own = vectors[:ASKED], sample["did"].to_numpy()[:ASKED]
    reach = _reach(reps, centre, asked, own, np.sort(np.array(held["crowded"], np.int64)), k, dim)
    reach[0].fit(asked.astype(np.float32) @ centre.T, own, reach[1], target, least)
    spark = df.sparkSession
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, STREAMED)  # the cut plans and runs it at once
    try:
        ranked = cut(_asked(reps, centre, reach[0], k, dim))
    finally:
        spark.conf.set(BATCH, was)
    alone = ranked.mapInArrow(_unpacked(k), "chunk_id bigint, near bigint, rank int, similarity double")
    # single vectors rank for themselves; of a class every member takes the ranking of its first chunk
    lists = ranked.mapInArrow(_listed(k), "q bigint, chunk bigint, did bigint, s double")
    listed = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "chunk", "did"))).alias("l"))  # at most 2k entries
    sized = cut(listed.join(classes.select("q", "n"), "q"))
    mine = spread_join(copies.select("chunk_id", F.col("did").alias("own"), "q"), sized, ["q"], "n").select("chunk_id", F.posexplode(F.slice(F.filter("l", lambda x: x["did"] != F.col("own")), 1, k)).alias("at", "x"))
    return alone.unionByName(mine.select("chunk_id", F.col("x.chunk").alias("near"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.s")).alias("similarity")))


def _reach(reps: DataFrame, centre: np.ndarray, asked: np.ndarray, own: np.ndarray, crowded: np.ndarray, k: int, dim: int) -> tuple[Reach, list[list[int]]]:
    """Rows of the cells, in all and of the documents that could fill them, and the cells of the sampled rows' true neighbours."""
    seen = reps.select("did", "dv").mapInArrow(_surveyed(centre, asked, own, crowded, dim, k), "kind int, a bigint, b bigint, n bigint, s double")
    best = F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == 2, F.struct("s", "n"))), asc=False), 1, k)
    rows, docs, true = np.zeros(len(centre), np.int64), {}, [[] for _ in asked]
    for r in seen.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), best.alias("l")).collect():
        if r["kind"] == 0:
            rows[r["a"]] = r["n"]
        elif r["kind"] == 1:
            docs.setdefault(r["a"], []).append((r["b"], r["n"]))
        else:
            true[r["a"]] = [x["n"] for x in r["l"]]
    return Reach(rows, {d: tuple(np.array(x, np.int64) for x in zip(*n)) for d, n in docs.items()}), true


def _asked(reps: DataFrame, centre: np.ndarray, reach: Reach, k: int, dim: int) -> DataFrame:
    """The rankings of all queries, packed: each part with the parts that it asks."""
    parts = Parts(reach.rows, 0, max(PART, min(4 * PART, int(reach.rows.sum()) // PARTS)), 0)
    sent = reps.mapInArrow(_packed_parts(centre, reach, parts, dim), "part int, rows binary, cells binary")
    ordered = sent.repartitionById(parts.total, F.col("part")).sortWithinPartitions("part")
    packed = cut(ordered.mapInArrow(_whole_parts(parts, dim, len(centre)), "part int, asks array<int>, rows binary"))
    # the stream: a row before the first part, at which a task gets its own rows, then every part
    stream = packed.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(b"").alias("rows")).unionByName(packed.select("part", "rows")).coalesce(1)
    asks = packed.select(F.col("part").alias("own"), "asks", F.col("rows").alias("own_rows")).hint("shuffle_replicate_nl")
    pairs = stream.join(asks, (F.col("part") == -1) | F.array_contains("asks", F.col("part")))
    return pairs.select("own", "part", F.when(F.col("part") == -1, F.col("own_rows")).otherwise(F.col("rows")).alias("rows")).mapInArrow(_ranked(centre, dim, k), "one binary, many binary")


def found(df: DataFrame, k: int = K, dim: int = 64) -> DataFrame:
    """Unordered pairs, smaller chunk first, of which at least one is among the k most similar to the other."""
    n = nearest(df, k, dim)
    return n.select(F.least("chunk_id", "near").alias("chunk_id_a"), F.greatest("chunk_id", "near").alias("chunk_id_b")).distinct()
