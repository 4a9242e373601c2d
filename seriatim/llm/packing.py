"""Items of varying size in containers of fixed capacity, by a configuration linear program.

A configuration is a multiset of sizes that fits one container. The program "fewest
configurations covering the length histogram" is solved by multiplicative weights: sizes that
are covered least gain price, and a knapsack dynamic program finds the configuration of most
price. The averaged configurations are rounded down to whole containers; what remains is a
smaller histogram, for which the program is solved again, until rounding leaves it as it is; the
rest is packed largest size first. Where packing largest first from the outset needs fewer
containers, that plan is taken. All of this sees only the histogram, which has at most as many
rows as the capacity has units, so it runs on the driver at any corpus size.

Items are then numbered within their size, without gathering a size in one task, and the number
alone tells an item's container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.session import cut, partitions
from seriatim.sources.tables import require

CAPACITY = 2048
#: Rounds of multiplicative weights and their step, and programs solved one after the other.
ROUNDS, STEP, PROGRAMS = 120, 0.35, 4

Config = dict[int, int]


def _price_best(price: np.ndarray, capacity: int) -> Config:
    """The configuration of most price: unbounded knapsack by dynamic programming over capacities; price is 0 where there is no item."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    falling = best[::-1]  # best[room - size] for size 1, 2, ... is a stretch of it
    worth = price[1:]
    for room in range(1, capacity + 1):
        gain = falling[capacity - room + 1 :] + worth[:room]
        k = int(gain.argmax())
        best[room], pick[room] = gain[k], k + 1
    out: Config = {}
    room = capacity
    while room > 0:
        size = int(pick[room])
        if price[size] > 0:
            out[size] = out.get(size, 0) + 1
        room -= size
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, enough: float = np.inf) -> tuple[list[tuple[Config, float]], int]:
    """Configurations with fractional numbers of containers that together cover the histogram nearly evenly, and how many containers are needed at least.

    No container is worth more than the best configuration, so the prices of all items divided by
    that bound the number of containers from below. With a bound of `enough` there is no need to go on.
    """
    sizes = np.flatnonzero(counts)
    total = float((sizes * counts[sizes]).sum())
    if not len(sizes):
        return [], 0
    least = 0
    share = counts[sizes] / (total / capacity)  # items of a size that an average container must hold
    seen = np.zeros(len(sizes))
    made: dict[tuple, int] = {}
    for k in range(rounds):
        lag = (k + 1) - seen / share
        price = np.zeros(capacity + 1)
        price[sizes] = sizes / capacity * np.exp(np.clip(step * lag / np.maximum(1.0, 1 / share), -30, 30))
        config = _price_best(price, capacity)
        least = max(least, int(np.ceil(float(price[sizes] @ counts[sizes]) / sum(price[s] * n for s, n in config.items()) - 1e-6)))
        if least >= enough:
            return [], least
        key = tuple(sorted(config.items()))
        made[key] = made.get(key, 0) + 1
        for s, n in config.items():
            seen[np.searchsorted(sizes, s)] += n
    return [(dict(key), n * total / capacity / rounds) for key, n in made.items()], least


def _greedy(left: np.ndarray, capacity: int) -> Config:
    """The largest remaining size, then again and again the largest that still fits."""
    out: Config = {}
    room = capacity
    rest = left.copy()
    size = capacity
    while room > 0:
        size = min(size, room)
        at = np.flatnonzero(rest[: size + 1])
        if not len(at):
            break
        size = int(at[-1])
        n = int(min(rest[size], room // size))
        out[size] = out.get(size, 0) + n
        rest[size] -= n
        room -= n * size
    return out


def _take(left: np.ndarray, config: Config, n: int, out: list[tuple[Config, int]]) -> None:
    out.append((config, n))
    for s, m in config.items():
        left[s] -= m * n


def _finished(left: np.ndarray, capacity: int, out: list[tuple[Config, int]]) -> list[tuple[Config, int]]:
    """The plan with everything that is left packed largest first."""
    left, out = left.copy(), list(out)
    while left.any():
        config = _greedy(left, capacity)
        _take(left, config, min(int(left[s] // m) for s, m in config.items()), out)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Whole configurations and how many containers each fills; together they hold exactly the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit a container of {capacity}")
        left[size] = n
    units = lambda p: sum(n for _, n in p)
    best = _finished(left, capacity, [])
    bound = -(-int((np.arange(capacity + 1) * left).sum()) // capacity)
    out: list[tuple[Config, int]] = []
    for _ in range(PROGRAMS):
        if units(best) <= bound or not left.any():
            break
        before = len(out)
        solved, least = fractional(left, capacity, enough=units(best) - units(out))
        bound = max(bound, least if not out else 0)
        for config, x in sorted(solved, key=lambda p: -p[1]):
            n = min([int(x), *(int(left[s] // m) for s, m in config.items())])
            if n > 0:
                _take(left, config, n, out)
        best = min(best, _finished(left, capacity, out), key=units)
        if len(out) == before:
            break
    return best


def slots(chosen: list[tuple[Config, int]]) -> pd.DataFrame:
    """Where the items of a size go: (size, first number, items per container, first container), in order."""
    rows, used, container = [], {}, 0
    for config, n in chosen:
        for s, m in config.items():
            rows.append((s, used.get(s, 0), m, container))
            used[s] = used.get(s, 0) + m * n
        container += n
    return pd.DataFrame(rows, columns=["size", "first", "each", "container"]).sort_values(["size", "first"], ignore_index=True)


def pieces(df: DataFrame, capacity: int) -> DataFrame:
    """Items of at most the capacity: id, part, start, size; only a longer item has several parts."""
    cuts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(capacity).cast("bigint"))
    return (
        df.where("size > 0")
        .select("id", "size", F.posexplode(cuts).alias("part", "start"))
        .select("id", "part", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity)).cast("int").alias("size"))
    )


def numbered(items: DataFrame) -> DataFrame:
    """Each item's number among the items of its size, from 0, counted in independent shares."""
    shares = 8 * partitions(items)
    w = Window.partitionBy("size", "share")
    items = items.withColumn("share", F.pmod(F.xxhash64("id", "part"), F.lit(shares)))
    before = Window.partitionBy("size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = items.groupBy("size", "share").agg(F.count("*").alias("n"))
    offset = counts.select("size", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = items.withColumn("k", F.row_number().over(w.orderBy("id", "part")) - 1)
    return ranked.join(offset, ["size", "share"]).select("id", "part", "start", "size", (F.col("before") + F.col("k")).alias("number"))


def packed(sizes: DataFrame, id_column: str, size_column: str, capacity: int = CAPACITY) -> DataFrame:
    """Every item's container: id, part, start, n (units of this part), container (from 0).

    An item is cut only if it exceeds the capacity, then into full containers and a rest. Items
    of size 0, or with a null id or size, take no room and are left out; repeated ids are items of
    their own only if the caller makes ids unique. Ties are ordered by id. An empty table gives an
    empty result.
    """
    require(sizes, [id_column, size_column])
    kind = sizes.schema[id_column].dataType.simpleString()
    items = cut(pieces(sizes.select(F.col(id_column).alias("id"), F.col(size_column).cast("bigint").alias("size")).dropna(), capacity))
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(histogram, capacity))
    keys = table["size"].to_numpy(np.int64) << 40 | table["first"].to_numpy(np.int64)
    first, each, container = (table[c].to_numpy(np.int64) for c in ("first", "each", "container"))

    @F.pandas_udf("bigint")
    def place(size: pd.Series, number: pd.Series) -> pd.Series:
        at = np.searchsorted(keys, size.to_numpy(np.int64) << 40 | number.to_numpy(np.int64), side="right") - 1
        return pd.Series(container[at] + (number.to_numpy(np.int64) - first[at]) // each[at])

    return numbered(items).select(F.col("id").cast(kind).alias(id_column), "part", "start", F.col("size").alias("n"), place("size", "number").alias("container"))
