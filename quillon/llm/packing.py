"""Filling containers of fixed capacity with items, never splitting one that fits.

The histogram of item sizes (never more rows than the capacity) defines a configuration linear program: a
configuration is a multiset of sizes within the capacity, and the fewest copies of configurations that cover
the histogram are sought. Multiplicative weights price the sizes, starting from their volume; a knapsack dynamic
program finds the best configuration for the prices, round by round, until every size is covered. The fractional
solution is rounded to whole copies that the histogram has items for, and the program is solved again for what is left, until a pass places less
than ``LITTLE`` of the items; the last few are filled largest first, again as
whole configurations with their multiplicity, so the plan's size depends on the capacity only. Where largest first
alone needs fewer containers, its plan is taken. Items then take the plan's slots by their rank within their size.

Scale: the driver sees the histogram alone. Ranks come from windows over (size, salt) with as many salts as
keep a window under a million rows; offsets of the salts are added by a join on the same key. The plan is
broadcast; it is bounded by the capacity. No items are dropped; repeated rows are items of their own.

Defined results: an item over the capacity is cut into full pieces and a rest; an item of size 0 (an empty
or null text) lies in one container, chosen by its key; an empty table has no containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.tables import cut

SALT_ROWS = 1_000_000
#: The sizes that a round of the weights prices first.
PRICED = 256
#: The share of the items that a pass of the program must place for another one to follow.
LITTLE = 0.005


def price_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int, most: np.ndarray) -> dict[int, int]:
    """The multiset of ascending sizes within the capacity with the highest total value; at most ``most`` of each.

    A dynamic program over the room, with each size's items in lots of 1, 2, 4, ...; of the sizes over half the capacity
    one at most fits, so the best of them is looked up at the end."""
    best, lots = np.zeros(capacity + 1), []
    half = int(np.searchsorted(sizes, capacity // 2, "right"))
    for k in range(half):
        left, many = min(int(most[k]), capacity // int(sizes[k])), 1
        while left > 0:
            n = min(many, left)
            left, many, w = left - n, 2 * many, n * int(sizes[k])
            gain = best[:-w] + n * value[k]
            better = gain > best[w:]
            np.copyto(best[w:], gain, where=better)
            lots.append((int(sizes[k]), n, w, better))
    out: dict[int, int] = {}
    room = capacity
    if half < len(sizes):
        gain = best[capacity - sizes[half:]] + value[half:]
        k = int(gain.argmax())
        if gain[k] > best[capacity]:
            out[int(sizes[half + k])] = 1
            room -= int(sizes[half + k])
    for s, n, w, better in reversed(lots):
        if room >= w and better[room - w]:
            out[s] = out.get(s, 0) + n
            room -= w
    return out


def fractional_solution(hist: dict[int, int], capacity: int, levels: float = 1.0, eta: float = 1.0) -> list[tuple[dict[int, int], float]]:
    """(configuration, copies) that cover the histogram fractionally, by multiplicative weights.

    Rounds go on until every size is covered ``levels`` times, then all copies are divided by the least coverage. A
    round raises some size by a whole level, and no size gets further ahead than log(capacity) / eta levels, so the
    rounds are bounded by sizes * (levels + log(capacity) / eta). The least covered ``PRICED`` sizes are priced first,
    all of them where those fill no container."""
    sizes = np.array(sorted(hist), np.int64)
    need = np.array([hist[s] for s in sizes], float)
    most = need.astype(np.int64)
    at = {int(s): k for k, s in enumerate(sizes)}
    covered, found = np.zeros(len(sizes)), {}
    while covered.min() < levels:
        value = np.exp(-eta * (covered - covered.min())) * sizes
        c: dict[int, int] = {}
        if len(sizes) > PRICED:
            own = np.sort(np.argpartition(covered, PRICED)[:PRICED])
            c = price_configuration(value[own], sizes[own], capacity, most[own])
        if sum(s * n for s, n in c.items()) < 0.999 * capacity:
            c = price_configuration(value, sizes, capacity, most)
        own = np.array([at[s] for s in c])
        gain = np.array(list(c.values())) / need[own]
        step = 1 / gain.max()
        key = tuple(sorted(c.items()))
        found[key] = found.get(key, 0.0) + step
        covered[own] += gain * step
    return [(dict(c), x / covered.min()) for c, x in found.items()]


def largest_first(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, copies) that hold all items, each container filled by the largest that fit."""
    left, plan = dict(left), []
    order = sorted((s for s in left if left[s] > 0), reverse=True)
    while order:
        c, room = {}, capacity
        for s in order:
            n = min(left[s], room // s)
            if n:
                c[s] = n
                room -= n * s
        copies = min(left[s] // n for s, n in c.items())
        plan.append((c, copies))
        for s, n in c.items():
            left[s] -= n * copies
        order = [s for s in order if left[s] > 0]
    return plan


def whole_copies(hist: dict[int, int], solution: list[tuple[dict[int, int], float]]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(whole copies of a fractional solution that there are items for, the items left over).

    In the order of their largest sizes the fractions below one copy are handed on to the next configuration."""
    left, plan, carry = dict(hist), [], 0.0
    for c, x in sorted(solution, key=lambda r: sorted(r[0].items(), reverse=True), reverse=True):
        copies = min([int(x + carry + 1e-9), *(left[s] // n for s, n in c.items())])
        carry = min(x + carry - copies, 1.0)
        if copies > 0:
            plan.append((c, copies))
            for s, n in c.items():
                left[s] -= n * copies
    return plan, left


def program_plan(hist: dict[int, int], capacity: int, levels: float = 1.0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(whole copies of configurations by passes of the program, the items left over)."""
    left, plan, total = dict(hist), [], sum(hist.values())
    while left:
        part, rest = whole_copies(left, fractional_solution(left, capacity, levels))
        plan += part
        placed = sum(left.values()) - sum(rest.values())
        left = {s: n for s, n in rest.items() if n > 0}
        if placed < LITTLE * total or not placed:
            break
    return plan, left


def make_plan(hist: dict[int, int], capacity: int, levels: float = 1.0) -> list[tuple[dict[int, int], int]]:
    """(configuration, copies) that hold exactly the histogram's items."""
    hist = {s: n for s, n in hist.items() if n > 0 and 0 < s <= capacity}
    plan, left = program_plan(hist, capacity, levels)
    plan += largest_first(left, capacity)
    alone = largest_first(hist, capacity)
    return alone if sum(n for _, n in alone) < sum(n for _, n in plan) else plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By size the rows (first rank, copies of the size in a container, first container) of its slots."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for c, copies in plan:
        for s, n in c.items():
            out.setdefault(s, []).append((rank.get(s, 0), n, base))
            rank[s] = rank.get(s, 0) + n * copies
        base += copies
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(key, piece, start, size): items (key, tokens); those over the capacity in full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    cut_ = sizes.select("key", "tokens", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut_.select("key", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).cast("int").alias("size"))


def pack(sizes: DataFrame, capacity: int, levels: float = 1.0) -> DataFrame:
    """(key, piece, start, size, container) of items (key, tokens)."""
    spark = sizes.sparkSession
    items = cut(pieces(sizes, capacity))
    hist = {r[0]: r[1] for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    plan = make_plan(hist, capacity, levels)
    total = max(1, sum(n for _, n in plan))
    table = spark.sparkContext.broadcast(slots(plan))
    salts = max(1, -(-max(hist.values(), default=1) // SALT_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)))
    within = Window.partitionBy("size", "salt").orderBy("key", "piece")
    ranked = salted.filter("size > 0").withColumn("rank", F.row_number().over(within).cast("long") - 1)
    if salts > 1:
        by_salt = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
        before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.join(by_salt.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")), ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("off"))
    kind = items.schema["key"].dataType.simpleString()

    def place(batches):
        by = table.value
        for pdf in batches:
            box = np.zeros(len(pdf), np.int64)
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                t = by[int(s)]
                k = np.searchsorted(t[:, 0], rank[own], "right") - 1
                box[own] = t[k, 2] + (rank[own] - t[k, 0]) // t[k, 1]
            yield pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "start": pdf["start"], "size": pdf["size"], "container": box})

    cols = ("key", "piece", "start", "size")
    placed = ranked.select(*cols, "rank").mapInPandas(place, f"key {kind}, piece int, start bigint, size int, container bigint")
    empty = items.filter("size = 0").select(*cols, F.pmod(F.xxhash64("key", "piece"), F.lit(total)).alias("container"))
    return placed.unionByName(empty)
