"""Documents in containers of a fixed capacity with little unused space (problem 6).

Items are spread over blocks of a bounded number by a hash and each block is packed by bin completion: the
largest item left opens a container, fillings of any number of items are enumerated around it, and the
search goes depth first, pruned by the waste that may still be spent if the incumbent is to be beaten. The
first incumbent is best-fit decreasing. Containers left with room are emptied and their items packed again
together with those of other blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.sources.scratch import cut

#: Items of a block, about; steps of the search for each item; fill from which a container stays closed.
BLOCK, STEPS, CLOSED = 2_000, 4, 0.995


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes where it leaves least room. Open containers are bits by their room."""
    rooms, by_room, bins = 0, {}, []
    for size in sorted(sizes, reverse=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bins_there = by_room[room]
            at = bins_there.pop()
            if not bins_there:
                rooms &= ~(1 << room)
            bins[at].append(size)
            room -= size
        else:
            at, room = len(bins), capacity - size
            bins.append([size])
        by_room.setdefault(room, []).append(at)
        rooms |= 1 << room
    return bins


class Stock:
    """A multiset of sizes; ``up`` has a bit per size in stock."""

    def __init__(self, sizes: list[int], capacity: int):
        self.count, self.up = [0] * (capacity + 1), 0
        for size in sizes:
            self.put(size)

    def put(self, size: int) -> None:
        if not self.count[size]:
            self.up |= 1 << size
        self.count[size] += 1

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.up &= ~(1 << size)

    def largest(self, room: int) -> int:
        """The largest size in stock that fits, 0 if none does."""
        return max((self.up & ((1 << (room + 1)) - 1)).bit_length() - 1, 0)


def fillings(stock: Stock, room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Fillings of ``room`` by any number of items that waste at most ``waste``, least waste first, then the larger items.

    Bits of reach[i] are the totals that the i smallest sizes make, so no way is followed that leads to no
    filling. Dominated fillings are left out (Martello and Toth): where a single item fills as well as all of them,
    it alone comes out, and none that has two items in place of which one in stock would do.
    """
    if not stock.largest(room):
        if room <= waste:
            yield ()
        return
    sizes, rest = [], stock.up & ((1 << (room + 1)) - 1)
    full, reach = (1 << (room + 1)) - 1, [1]
    while rest:
        low = rest & -rest
        rest ^= low
        sizes.append(low.bit_length() - 1)
        sums, left, step = reach[-1], min(stock.count[sizes[-1]], room // sizes[-1]), 1
        while left:  # a number of copies as a sum of powers of two
            taken = min(step, left)
            sums |= (sums << (taken * sizes[-1])) & full
            left, step = left - taken, step * 2
        reach.append(sums)
    counts = [min(stock.count[size], room // size) for size in sizes]

    def dominated(way: list[int]) -> bool:
        pairs = {way[i] + way[j] for i in range(len(way)) for j in range(i)}
        return any(stock.up >> size & 1 and stock.count[size] > way.count(size) for size in pairs)

    def ways(at: int, total: int) -> Iterator[tuple[int, ...]]:
        way: list[int] = []
        # Each entry: sizes still open, total still open, length of the way so far, how many of the size to take.
        open_ = [(at, total, 0, -1)]
        while open_:
            at, total, kept, take = open_.pop()
            del way[kept:]
            if not total:
                if not dominated(way):
                    yield tuple(way)
                continue
            if take < 0:
                take = min(counts[at - 1], total // sizes[at - 1])
            size = sizes[at - 1]
            while take >= 0 and not reach[at - 1] >> (total - take * size) & 1:
                take -= 1
            if take < 0:
                continue
            if take:
                open_.append((at, total, kept, take - 1))
            way.extend([size] * take)
            open_.append((at - 1, total - take * size, len(way), -1))

    for left in range(min(waste, room) + 1):
        if not reach[-1] >> (room - left) & 1:
            continue
        if stock.count[room - left]:
            yield (room - left,)
            return
        yield from ways(len(sizes), room - left)


def least_bins(sizes: list[int], capacity: int) -> int:
    """Lower bound L2 of Martello and Toth: items over half share no container, and those near it leave known room."""
    sizes = sorted(sizes)
    sums = [0, *accumulate(sizes)]
    half, best = bisect_right(sizes, capacity // 2), -(-sums[-1] // capacity)
    for alpha in sorted({*sizes[:half], 0}):
        small, large = bisect_left(sizes, alpha), max(bisect_right(sizes, capacity - alpha), half)
        middle = large - half  # over half the container, with room for items from alpha on
        room = middle * capacity - (sums[large] - sums[half])
        best = max(best, len(sizes) - half + max(0, -(-(sums[half] - sums[small] - room) // capacity)))
    return best


def complete_bins(sizes: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Containers of sizes (each 1 to ``capacity``), by bin completion branch and bound."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least, budget = least_bins(sizes, capacity), steps * len(sizes) + 100
    while len(best) > least and budget > 0:
        allowed = (len(best) - 1) * capacity - total
        stock, left = Stock(sizes, capacity), len(sizes)
        path: list[tuple[int, tuple[int, ...], int]] = []  # opener, filling, waste
        choices: list[Iterator[tuple[int, ...]]] = []
        spent, found = 0, False
        while budget > 0:
            budget -= 1
            if not left:
                found = True
                break
            opener = stock.largest(capacity)
            stock.take(opener)
            choices.append(fillings(stock, capacity - opener, allowed - spent))
            filling = next(choices[-1], None)
            while filling is None:  # nothing left to try here: one container back
                choices.pop()
                stock.put(opener)
                if not path:
                    break
                opener, filling, waste = path.pop()
                for size in filling:
                    stock.put(size)
                left, spent = left + 1 + len(filling), spent - waste
                filling = next(choices[-1], None)
            if filling is None:
                break
            for size in filling:
                stock.take(size)
            waste = capacity - opener - sum(filling)
            path.append((opener, filling, waste))
            left, spent = left - 1 - len(filling), spent + waste
        if not found:
            break
        best = [[opener, *filling] for opener, filling, _ in path]
    return best


def _pack(items: pd.DataFrame) -> pd.DataFrame:
    capacity = int(items["capacity"].iloc[0])
    items = items.sort_values(["tokens", "doc_id", "piece"]).reset_index(drop=True)
    sizes = items["tokens"].tolist()
    start = bisect_left(sizes, 1)  # items of no size go with the first container
    free = {}
    for i in range(len(sizes) - 1, start - 1, -1):
        free.setdefault(sizes[i], []).append(i)
    of, room = [0] * len(sizes), [capacity]
    for n, content in enumerate(complete_bins(sizes[start:], capacity)):
        for size in content:
            of[free[size].pop()] = n
        room[n:] = [capacity - sum(content)]
    return items.assign(bin=of, unused=[room[n] for n in of])


def pack(documents: DataFrame, capacities: DataFrame, block: int = BLOCK) -> DataFrame:
    """capacity_name, container_id, doc_id, piece, pieces, tokens, unused for documents (doc_id, tokens).

    A document larger than the capacity, and only such a one, is split: into pieces of the whole capacity,
    each with a container to itself, and the rest. ``unused`` is the room left in the container. Documents of
    no tokens take no room and go with others; null sizes count as 0, repeated rows once, of sizes that
    differ for one document the largest. Null, repeated or non-positive capacities and empty tables give no
    rows of their own.
    """
    sizes = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max("tokens"), F.lit(0)).cast("long").alias("tokens"))
    limits = capacities.where("capacity_tokens > 0").groupBy("capacity_name").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    items = cut(sizes, "sizes").join(limits).withColumn("pieces", F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int"))
    items = items.select("capacity_name", "capacity", "doc_id", "pieces", F.posexplode(F.expr("transform(sequence(1, pieces), i -> least(capacity, tokens - (i - 1) * capacity))")).alias("piece", "tokens"))
    items = items.withColumn("piece", F.col("piece") + 1)
    full = items.where("tokens = capacity").withColumn("unused", F.lit(0)).withColumn("container_id", F.concat_ws("-", F.lit("f"), "doc_id", "piece"))
    open_ = cut(items.where("tokens < capacity"), "items")
    schema = "capacity_name string, capacity int, doc_id long, pieces int, piece int, tokens long, block long, bin int, unused long"
    out = [full.select("capacity_name", "container_id", "doc_id", "piece", "pieces", "tokens", "unused")]
    for turn in range(3):
        blocks = cut(open_.groupBy("capacity_name").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
        # As many tasks as blocks or cores ask for: left to itself Spark joins the small blocks to one or two.
        session = blocks.sparkSession
        tasks = min(blocks.agg(F.sum("blocks")).collect()[0][0] or 1, max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism))
        placed = open_.join(blocks, "capacity_name").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.col("blocks")))
        placed = placed.select("capacity_name", "capacity", "doc_id", "pieces", "piece", "tokens", "block").repartition(tasks, "capacity_name", "block")
        placed = placed.groupBy("capacity_name", "block").applyInPandas(_pack, schema)
        placed = cut(placed.withColumn("container_id", F.concat_ws("-", F.lit(turn), "block", "bin")), "packed")
        # Another turn only gains where containers with room come from several blocks.
        again = (F.col("unused") > (1 - CLOSED) * F.col("capacity")) & F.lit(turn < 2)
        out.append(placed.where(~again).select(*out[0].columns))
        open_ = placed.where(again).select("capacity_name", "capacity", "doc_id", "pieces", "piece", "tokens")
        if turn < 2 and open_.isEmpty():
            break
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def summary(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_name, containers, least_containers, tokens, unused, unused_share of a packing."""
    limits = capacities.where("capacity_tokens > 0").groupBy("capacity_name").agg(F.max("capacity_tokens").alias("capacity"))
    per = packed.groupBy("capacity_name", "container_id").agg(F.sum("tokens").alias("tokens"), F.max("unused").alias("unused"))
    per = per.groupBy("capacity_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused")).join(limits, "capacity_name")
    return per.select("capacity_name", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens", "unused", (F.col("unused") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
