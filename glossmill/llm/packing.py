"""Problem 6: filling containers of fixed capacity, sized in tokens.

Token counts are one pass over the text; from there on only (key, size) moves.
Pieces are dealt to shards of about SHARD_ITEMS by a hash, and each shard fills
its containers by sum-of-squares packing: a piece goes to the fill level for
which the sum of the squared numbers of open containers a level grows least.
The emptiest containers of a shard are opened again at its end, and their pieces
packed anew in the same way with those of FAN_IN - 1 other shards, largest first,
until one shard of such rests remains. A shard passes on at most SHARD_ITEMS / FAN_IN pieces, so
no group is ever larger than a shard, however many documents there are.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import cut

#: Pieces that one task packs together.
SHARD_ITEMS = 25_000
#: Shards whose rests meet in the next round.
FAN_IN = 16
#: A container at least so full isn't opened again.
FULL = 0.998
#: A table of capacities is read on the driver up to so many rows.
CAPACITIES_MAX = 64


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill of each container) for sizes of 1 to capacity, in their order."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = np.zeros(capacity + 1, np.int64)  # open containers by fill level; level 0 and a full one don't count
    cost = np.zeros(capacity + 1, np.int64)  # what a further container at a level adds to the sum of squares
    gain = np.full(capacity + 1, np.iinfo(np.int32).max, np.int64)  # what one less takes from it, where there is one
    cost[1:capacity] = 1
    gain[0] = 0
    where = np.empty(len(sizes), np.int64)
    fills: list[int] = []
    for n, size in enumerate(sizes.tolist()):
        last = capacity - size
        change = cost[size:] + gain[: last + 1]
        level = last - int(change[::-1].argmin())  # of equally good levels the fullest
        if level:
            container = open_at[level].pop()
            levels[level] -= 1
            _price(levels, cost, gain, level)
        else:
            container = len(fills)
            fills.append(0)
        where[n] = container
        fills[container] = level = level + size
        if level < capacity:
            open_at[level].append(container)
            levels[level] += 1
            _price(levels, cost, gain, level)
    return where, np.asarray(fills, np.int64)


def _price(levels: np.ndarray, cost: np.ndarray, gain: np.ndarray, level: int) -> None:
    n = levels[level]
    cost[level] = 2 * n + 1
    gain[level] = 1 - 2 * n if n else np.iinfo(np.int32).max


def _packed(items: DataFrame, key_type: str, first: bool) -> DataFrame:
    """items with their container and whether it is opened again; one task for each capacity and shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(pdf["capacity"].iat[0]), int(pdf["shard"].iat[0])
        # first in an order that isn't by size, as the packing is online; the rests of shards largest first
        pdf = pdf.sort_values(["order", "row", "piece_no"], kind="stable", ignore_index=True)
        if not first:
            pdf = pdf.sort_values("n_tokens", ascending=False, kind="stable", ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        some = sizes > 0
        where = np.zeros(len(sizes), np.int64)
        where[some], fills = sum_of_squares(sizes[some], capacity)
        if not len(fills):
            fills = np.zeros(1, np.int64)
        pieces = np.bincount(where, minlength=len(fills))
        emptiest = np.argsort(fills, kind="stable")
        again = np.zeros(len(fills), bool)
        again[emptiest] = (np.cumsum(pieces[emptiest]) <= SHARD_ITEMS // FAN_IN) & (fills[emptiest] < FULL * capacity)
        return pdf.assign(container=(shard << 32) + where, again=again[where])

    schema = f"capacity int, shard long, order long, row long, key {key_type}, piece_no long, token_start long, n_tokens long"
    return items.groupBy("capacity", "shard").applyInPandas(run, schema + ", container long, again boolean")


def pack(sizes: DataFrame, capacities: list[int], *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(capacity, key, piece_no, token_start, n_tokens, container): each row of sizes, for each capacity.

    A row larger than the capacity is divided into pieces of just the capacity and
    a rest; any other is one piece. Null and 0 sizes are one piece of 0 tokens, in
    a container of their shard, which need not be theirs alone. Container numbers
    say nothing but which pieces are together, within one capacity. Repeated and
    null keys are rows like others: pieces are dealt by row, so those of one key, however
    many, are spread over all shards. No rows or no capacities give no rows.
    """
    if not capacities or min(capacities) < 1:
        return _empty(sizes, key)
    key_type = sizes.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    known = cut(sizes.select(F.col(key).alias("key"), n.alias("n"))).withColumn("row", F.monotonically_increasing_id())
    totals = known.agg(*(F.sum(F.greatest(F.ceil(F.col("n") / c), F.lit(1))).alias(str(c)) for c in capacities)).first()
    shards = {c: ceil((totals[str(c)] or 0) / SHARD_ITEMS) for c in capacities}
    if not any(shards.values()):
        return _empty(sizes, key)

    table = F.array(*(F.struct(F.lit(c).cast("int").alias("capacity"), F.lit(shards[c]).cast("long").alias("shards")) for c in capacities))
    pieces = (
        known.select("key", "n", "row", F.inline(table))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0)))))
        .withColumn("token_start", F.col("piece_no") * F.col("capacity"))
        .withColumn("order", F.xxhash64("row", "piece_no"))
        .select(
            "capacity", F.pmod("order", "shards").alias("shard"), "order", "row", "key", "piece_no", "token_start",
            F.least(F.col("capacity").cast("long"), F.col("n") - F.col("token_start")).alias("n_tokens"),
        )
    )
    done = cut(_packed(pieces, key_type, first=True))
    closed, base, most = [], 0, max(shards.values())
    while True:  # each round has a FAN_IN-th of the shards; the last has one
        closed.append(done.filter("NOT again"))
        met = F.floor((F.col("shard") - base) / FAN_IN)
        base += most
        done = cut(_packed(done.filter("again").withColumn("shard", met + base).drop("container", "again"), key_type, first=False))
        most = ceil(most / FAN_IN)
        if most == 1:
            break
    for part in closed:
        done = done.unionByName(part)
    return done.select("capacity", F.col("key").alias(key), "piece_no", "token_start", "n_tokens", "container")


def _empty(sizes: DataFrame, key: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return sizes.limit(0).select(
        F.lit(0).alias("capacity"), F.col(key), *(zero.alias(c) for c in ("piece_no", "token_start", "n_tokens", "container"))
    )


def capacities_of(specs: DataFrame, unit: str = "token") -> list[int]:
    """The container capacities of a table of sizes, smallest first; a long table is refused."""
    rows = specs.filter((F.col("used_for") == "container") & (F.col("unit") == unit) & (F.col("capacity") > 0)).select("capacity").distinct().limit(CAPACITIES_MAX + 1).collect()
    if len(rows) > CAPACITIES_MAX:
        raise ValueError(f"more than {CAPACITIES_MAX} capacities")
    return sorted(row.capacity for row in rows)
