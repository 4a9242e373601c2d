"""Long exact spans shared between records, by level-wise doubling of repeated windows.

The first level takes windows of a quarter of the length at anchors (minima of a rolling hash),
one of which lies in every window of the length, chosen by its content. A window that occurs in
one record alone cannot lie in a shared span; windows that repeat are extended to twice their
length, to the right and to the left, and counted again, until the next doubling would reach the
length itself. Starts that may then begin a shared window of the length are cut into blocks at
places of the text's own choosing. A block that repeats as a whole is counted as one row, whatever
its number of starts, and the starts inside are looked at once for each different block, not for
each occurrence; so a long copy costs few rows, and only the ends of spans are opened start by
start. Windows are compared by two 64-bit hashes over mixed code points.

Counts are sums and extremes of record numbers, combined before they are moved, and joins back to
them split hot windows over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.operators.skew import spread_join
from seriatim.session import cut
from seriatim.sources.tables import require

LENGTH = 240
#: Fixed odd bases of the two hashes modulo 2**64; any large odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Code points handled at once, unless one text is longer.
BLOCK = 1_000_000
#: Starts among which one is a border of a block, and members of a group that one task pairs.
APART, MEMBERS = 24, 4096
#: Bits of a position; a text is shorter than 2**30 code points, as an Arrow string is.
PLACE = 30


def mixed(text: str) -> np.ndarray:
    """Code points of a text, each spread over 64 bits."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of windows, from prefix sums modulo 2**64."""

    def __init__(self, codes: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        n = len(codes)
        self.back = np.full(n + 1, inverse, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        power = np.full(n, base, np.uint64)
        if n:
            power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * power, out=self.prefix[1:])

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the windows of a length, or of one length each, at the starts."""
        return (self.prefix[starts + length] - self.prefix[starts]) * self.back[starts]


class Texts:
    """Some texts laid end to end, with their hashes."""

    def __init__(self, docs: list[int], texts: list[str]):
        codes = [mixed(t) for t in texts]
        self.docs = np.asarray(docs, np.int64)
        self.stops = np.cumsum([len(c) for c in codes]).astype(np.int64)
        self.starts = np.r_[np.int64(0), self.stops[:-1]]
        joined = np.concatenate(codes)
        self.n = len(joined)
        self.one, self.two = (Rolling(joined, b) for b in BASES)

    def inside(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Whether the window at each place ends in the text it starts in."""
        of = np.searchsorted(self.stops, at, side="right")
        return at + length <= self.stops[np.minimum(of, len(self.stops) - 1)]

    def rows(self, at: np.ndarray, length: int | np.ndarray) -> list[pa.Array]:
        """Record, position and the two hashes of windows."""
        of = np.searchsorted(self.stops, at, side="right")
        pos = (at - self.starts[of]).astype(np.int32)
        return [pa.array(self.docs[of]), pa.array(pos), pa.array(self.one.at(at, length).view(np.int64)), pa.array(self.two.at(at, length).view(np.int64))]

    def smallest(self, at: np.ndarray, size: int, among: int) -> np.ndarray:
        """For each place the smallest of the `among` windows of a size that start from there on, leftmost on ties."""
        last = self.n - size + 1
        h = self.one.at(np.arange(last), size)
        h ^= h >> np.uint64(29)
        key = (h & ~np.uint64((1 << PLACE) - 1)) | np.arange(last, dtype=np.uint64)
        step = 1
        while 2 * step <= among:  # minima of 1, 2, 4, ... neighbours
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        rest = among - step
        low = np.minimum(key[at], key[at + rest]) if rest else key[at]
        return (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)

    def every(self, length: int) -> np.ndarray:
        """All starts of windows of a length."""
        return np.concatenate([np.arange(a, z - length + 1) for a, z in zip(self.starts, self.stops)]) if len(self.starts) else np.zeros(0, np.int64)

    def anchors(self, length: int, size: int) -> np.ndarray:
        """The smallest window of the size in each window of the length."""
        return np.unique(self.smallest(self.every(length), size, length - size + 1))

    def placed(self, own: list[np.ndarray]) -> np.ndarray:
        """Positions of each text as places."""
        return np.concatenate([a + np.asarray(p, np.int64) for a, p in zip(self.starts, own)])


def _over(handle: Callable[[Texts, list], pa.RecordBatch]):
    """Arrow function over (doc, text, lists ...): texts are handled some BLOCK code points at once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts, extra, held = [], [], [], 0
            for k, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                docs.append(d)
                texts.append(t.as_py())
                extra.append([c[k].values for c in b.columns[2:]])
                held += len(texts[-1])
                if held >= BLOCK:
                    yield handle(Texts(docs, texts), extra)
                    docs, texts, extra, held = [], [], [], 0
            if docs:
                yield handle(Texts(docs, texts), extra)

    return of


_WINDOWS = "doc bigint, pos int, h1 bigint, h2 bigint"


def _anchored(length: int, size: int):
    def handle(t: Texts, _: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(t.rows(t.anchors(length, size), size), ["doc", "pos", "h1", "h2"])

    return _over(handle)


def _doubled(size: int):
    """Surviving windows -> windows of twice their length, to the right (side 0) and to the left (side 1)."""

    def handle(t: Texts, extra: list) -> pa.RecordBatch:
        alive = t.placed([e[0].to_numpy() for e in extra])
        own = np.searchsorted(t.stops, alive, side="right")
        right = alive[t.inside(alive, 2 * size)]
        left = alive[alive - size >= t.starts[own]]
        columns = [pa.concat_arrays(c) for c in zip(t.rows(right, 2 * size), t.rows(left - size, 2 * size))]
        columns[1] = pa.array(np.r_[columns[1].to_numpy()[: len(right)], columns[1].to_numpy()[len(right) :] + size].astype(np.int32))
        side = pa.array(np.r_[np.zeros(len(right), np.int32), np.ones(len(left), np.int32)])
        return pa.RecordBatch.from_arrays([*columns, side], ["doc", "pos", "h1", "h2", "side"])

    return _over(handle)


def _blocks(length: int, size: int):
    """Starts that may begin a shared window of the length, in blocks: doc, pos, len (starts), h1, h2 (of all that its windows cover).

    Every window of the length holds its smallest window of the size; that one repeats in a shared
    window, and so does each doubled one around it that lies inside.
    """

    def handle(t: Texts, extra: list) -> pa.RecordBatch:
        starts = t.every(length)
        low = t.smallest(starts, size, length - size + 1)
        alive, right, left = (np.zeros(t.n + 1, bool) for _ in range(3))
        alive[t.placed([e[0].to_numpy() for e in extra])] = True
        right[t.placed([e[1].to_numpy() for e in extra])] = True
        left[t.placed([e[2].to_numpy() for e in extra])] = True
        may = alive[low] & (right[low] | (low + 2 * size > starts + length)) & (left[low] | (low - size < starts))
        border = np.zeros(t.n + 1, bool)
        wide = starts[t.inside(starts, length + APART - 1)]
        if len(wide):
            border[t.smallest(wide, size, APART)] = True
        new = may & (np.r_[True, ~may[:-1]] | (np.diff(starts, prepend=-2) != 1) | border[starts])
        first = np.flatnonzero(new)
        block = np.cumsum(new)[may] - 1
        n = np.bincount(block, minlength=len(first))
        at = starts[first]
        columns = t.rows(at, n + length - 1)
        columns[3] = pa.array(columns[3].to_numpy() ^ (n * 0x9E3779B1))
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int32))], ["doc", "pos", "h1", "h2", "len"])

    return _over(handle)


def _opened(length: int):
    """Different blocks -> their windows of the length, with what is known of the block."""
    names = ("a", "z", "n", "s1", "s2", "block")

    def handle(t: Texts, extra: list) -> pa.RecordBatch:
        pos, n = ([e[0].field(c).to_numpy() for e in extra] for c in ("pos", "len"))
        at, size = t.placed(pos), np.concatenate(n).astype(np.int64)
        # an id with several texts: a block lies in one of them
        of = np.repeat(np.arange(len(t.starts)), [len(p) for p in pos])
        fits = at + size + length - 1 <= t.stops[of]
        fits[fits] = t.one.at(at[fits], size[fits] + length - 1).view(np.int64) == np.concatenate([e[0].field("h1").to_numpy() for e in extra])[fits]
        known = [np.concatenate([e[0].field(c).to_numpy() for e in extra])[fits] for c in names]
        at, size = at[fits], size[fits]
        each = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return pa.RecordBatch.from_arrays([*t.rows(each, length), *(pa.array(np.repeat(k, size)) for k in known)], ["doc", "pos", "h1", "h2", *names])

    return _over(handle)


def _repeated(windows: DataFrame) -> DataFrame:
    """The windows that occur in more than one record."""
    windows = cut(windows)
    seen = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z").select("h1", "h2", "n")
    return spread_join(windows, cut(seen), ["h1", "h2"], "n", "left_semi")


def records(df: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc, text) of the rows with id and text, and (doc, id) of every id; doc is a hash that no two ids share.

    A record is an id, so repeated deliveries are one record; of an id with several texts each
    is searched, under the same number.
    """
    require(df, [id_column, text])
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).dropna()
    seed = 0
    while True:
        doc = F.xxhash64(F.lit(seed), "id").alias("doc")
        ids = cut(rows.groupBy("id").agg(F.max(F.length("text")).alias("n_chars")).select(doc, "id", "n_chars"))
        if not ids.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").head(1):
            return rows.select(doc, "text"), ids
        seed += 1


def blocks(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of starts, their classes (equal blocks), and the windows of every different block.

    Blocks: doc, pos, len, h1, h2. Classes: h1, h2, block (number), n (occurrences), a, z (smallest
    and largest record), s1, s2 (sums of record hashes, the signature). Windows: doc, pos (of the
    class's first occurrence), h1, h2 (of the window), and a, z, n, s1, s2, block of the class.
    """
    long = docs.where(F.length("text") >= length)
    size = max(1, length // 4)
    alive = _repeated(long.mapInArrow(_anchored(length, size), _WINDOWS))
    texts = long.join(alive.groupBy("doc").agg(F.collect_set("pos").alias("alive")), "doc").select("doc", "text", "alive")  # at most a text's positions
    texts = cut(texts)
    sides = ["right", "left"]
    if 2 * size < length:
        doubled = _repeated(texts.mapInArrow(_doubled(size), f"{_WINDOWS}, side int"))
        side = lambda k: F.collect_set(F.when(F.col("side") == k, F.col("pos")))
        texts = cut(texts.join(doubled.groupBy("doc").agg(side(0).alias("right"), side(1).alias("left")), "doc").select("doc", "text", "alive", *sides))
    else:
        texts = texts.select("*", *[F.col("alive").alias(s) for s in sides])
    found_blocks = cut(texts.mapInArrow(_blocks(length, size), f"{_WINDOWS}, len int"))
    mark = lambda seed: F.sum(F.hash(F.lit(seed), "doc").cast("bigint"))
    group = found_blocks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("z"), mark(1).alias("s1"), mark(2).alias("s2"), F.min_by("pos", "doc").alias("pos"), F.max("len").alias("len"))
    classes = cut(cut(group).withColumn("block", F.monotonically_increasing_id()))
    firsts = classes.groupBy(F.col("a").alias("doc")).agg(F.collect_list(F.struct("h1", "pos", "len", "a", "z", "n", "s1", "s2", "block")).alias("own"))  # at most a text's starts
    known = "a bigint, z bigint, n bigint, s1 bigint, s2 bigint, block bigint"
    return found_blocks, classes, cut(texts.join(firsts, "doc").select("doc", "text", "own").mapInArrow(_opened(length), f"{_WINDOWS}, {known}"))


def _shared(windows: DataFrame) -> DataFrame:
    """Groups of equal windows that more than one record has: h1, h2, k (different blocks), n, s1, s2 (of all occurrences)."""
    sums = [F.sum(c).alias(c) for c in ("n", "s1", "s2")]
    return windows.groupBy("h1", "h2").agg(F.count("*").alias("k"), F.min("a").alias("a"), F.max("z").alias("z"), *sums).where("a <> z").drop("a", "z")


def groups(found_blocks: DataFrame, classes: DataFrame, windows: DataFrame) -> DataFrame:
    """Records that share a window, one group for each different set of them: grp, doc, size (its records, or more).

    Along a span the windows bind one and the same set of records, so of the windows with equal
    signature one stands for all. This is the compact form of the pairs.
    """
    signed = _shared(windows).groupBy("n", "s1", "s2").agg(F.min_by("h2", "h1").alias("h2"), F.min_by("k", "h1").alias("k"), F.min("h1").alias("h1"))
    heads = cut(cut(signed).withColumn("grp", F.monotonically_increasing_id()).select("h1", "h2", "k", "grp", F.col("n").alias("size")))
    held = spread_join(windows.select("h1", "h2", "block"), heads, ["h1", "h2"], "k").select("block", "grp", "size").distinct()
    of = cut(held.join(classes.select("block", "h1", "h2", "n"), "block").groupBy("h1", "h2", "n").agg(F.collect_list(F.struct("grp", "size")).alias("in")))  # the windows of one block
    return spread_join(found_blocks.select("h1", "h2", "doc"), of, ["h1", "h2"], "n").select("doc", F.explode("in").alias("g")).select("g.grp", "g.size", "doc").distinct()


def pairs(members: DataFrame) -> DataFrame:
    """Pairs of the records of each group: a < b. A group is paired in squares of MEMBERS records."""
    shares = F.ceil(F.col("size") / MEMBERS).cast("int")
    left = members.select("grp", F.col("doc").alias("a"), F.pmod(F.xxhash64("doc"), shares).cast("int").alias("share"))
    right = members.select("grp", F.col("doc").alias("b"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    return left.join(right, ["grp", "share"]).where("a < b").select("a", "b").distinct()


def passages(found_blocks: DataFrame, classes: DataFrame, windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """The shared passages of each record, overlapping ones joined: doc, start, stop."""
    whole = spread_join(found_blocks, classes.where("a <> z").select("h1", "h2", "n"), ["h1", "h2"], "n", "left_semi").select("doc", F.col("pos").alias("start"), (F.col("pos") + F.col("len") + (length - 1)).alias("stop"))
    common = cut(_shared(windows).select("h1", "h2", "k"))
    ends = spread_join(windows.where("a = z"), common, ["h1", "h2"], "k", "left_semi").select("doc", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"))
    w = Window.partitionBy("doc").orderBy("start", "stop")
    new = F.when(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start"), 0).otherwise(1)
    runs = whole.unionByName(ends).withColumn("new", new).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "k").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("k")


def found(df: DataFrame, id_column: str = "note_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pairs of different records with a run of `length` or more equal characters in common: <id>_a < <id>_b.

    Case, blanks and line breaks count. Null and shorter texts share nothing; a record delivered
    twice is one record; copies of a text under different ids are pairs. Other columns are ignored.
    """
    docs, ids = records(df, id_column, text)
    p = pairs(cut(groups(*blocks(docs, length))))
    name = ids.select("doc", "id")
    both = p.join(name.select(F.col("doc").alias("a"), F.col("id").alias("x")), "a").join(name.select(F.col("doc").alias("b"), F.col("id").alias("y")), "b")
    return both.select(F.least("x", "y").alias(f"{id_column}_a"), F.greatest("x", "y").alias(f"{id_column}_b"))


def coverage(df: DataFrame, id_column: str = "note_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Of each record: its characters, how many lie in passages of `length` or more that stand in other records, and the passages.

    Result: id, n_chars, shared_chars, n_passages; records without text have none (null n_chars).
    Of an id with several texts the longest counts, then the greatest.
    """
    docs, ids = records(df, id_column, text)
    got = passages(*blocks(docs, length), length).groupBy("doc").agg(F.sum((F.col("stop") - F.col("start")).cast("bigint")).alias("shared_chars"), F.count("*").alias("n_passages"))
    known = ids.join(got, "doc", "left").select(F.col("id").alias(id_column), "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"))
    every = df.select(F.col(id_column).cast("string").alias(id_column)).dropna().distinct()
    return every.join(known, id_column, "left").fillna(0, ["shared_chars", "n_passages"])
