"""Shards of near equal size: a minimax contiguous partition of ordered atomic groups.

Groups (equal texts) stand in the order of a hash of their text. The smallest capacity with which
a greedy pass fits them into the shards is found by binary search; the order is then cut where
that pass cuts. The pass needs only the largest prefix sum up to a limit. The driver holds bounds
for it: the smallest and largest prefix sum in each of a bounded number of cells. Where those
leave a capacity undecided, the cells around its cuts are split into finer ones, until all is exact.
A group as large as an even share gets a shard of its own first, so that it doesn't leave others
empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions

_BUCKETS = 4096
_FINER = 1024
#: Cells around the open cuts that are split in one round, besides those that leave them open.
_CELLS_A_ROUND = 32
#: Groups with at least this share of all rows are placed without a join on their hash.
_HOT_SHARE = 1024
_ROWS_A_SLOT_BUCKET = 100_000


class PrefixBounds:
    """Cells (smallest, largest) of prefix sums, in order; what is between cells is empty."""

    def __init__(self, cells: list[tuple[int, int]]):
        self.cells = sorted(cells)
        self.lows = [a for a, _ in self.cells]

    def up_to(self, limit: int) -> tuple[int, int]:
        """Bounds of the largest prefix sum that is at most limit."""
        at = bisect_right(self.lows, limit) - 1
        if at < 0:
            return 0, 0
        low, high = self.cells[at]
        return (high, high) if high <= limit else (low, limit)

    def undecided(self, places: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """Cells that more than one prefix sum may be in, and that bounds of places begin or end in."""
        hit = set()
        for low, high in places:
            for at in {bisect_right(self.lows, low) - 1, bisect_right(self.lows, high) - 1}:
                if at >= 0 and self.cells[at][0] < self.cells[at][1] and low != high:
                    hit.add(self.cells[at])
        return hit

    def between(self, early: list[tuple[int, int]], late: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """Such cells from each early place to its late one."""
        out = set()
        for (a, _), (_, b) in zip(early, late, strict=True):
            first, last = max(0, bisect_right(self.lows, a) - 1), bisect_right(self.lows, b) - 1
            out.update(c for c in self.cells[first : last + 1] if c[0] < c[1])
        return out

    def split(self, cells: set[tuple[int, int]], finer: list[tuple[int, int]]) -> PrefixBounds:
        """With the cells' parts in their place; a cell that wasn't split is an error, as the search would not end."""
        if cells & set(finer) or not cells:
            raise RuntimeError("a cell of prefix sums was not split")
        return PrefixBounds([c for c in self.cells if c not in cells] + finer)


def cuts(bounds: PrefixBounds, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Bounds of the places where the greedy pass with this capacity cuts."""
    low = high = 0
    out = []
    for _ in range(shards):
        low, high = bounds.up_to(low + capacity)[0], bounds.up_to(high + capacity)[1]
        out.append((low, high))
    return out


def _first(good, bad: int, sure: int) -> int:
    """The smallest number above bad that is good; sure is."""
    while sure - bad > 1:
        middle = (bad + sure) // 2
        bad, sure = (bad, middle) if good(middle) else (middle, sure)
    return sure


def minimax_cuts(total: int, largest: int, shards: int, bounds: PrefixBounds, refine) -> list[int]:
    """Where to cut so that the largest shard is as small as it can be. refine(cells) gives the parts of those cells, more than one of each."""
    if total <= 0:
        return []
    floor = max(-(-total // shards), largest)
    while True:
        sure = _first(lambda c: cuts(bounds, c, shards)[-1][0] >= total, floor - 1, floor + largest)
        least = _first(lambda c: cuts(bounds, c, shards)[-1][1] >= total, floor - 1, floor + largest)
        early, found = cuts(bounds, least, shards), cuts(bounds, sure, shards)
        if least == sure and all(a == b for a, b in found):
            return [a for a, _ in found]
        # the cells that leave these cuts open are always among them, so each round decides more
        cells = bounds.undecided(early) | bounds.undecided(found)
        near = sorted(bounds.between(early, found) - cells)
        cells.update(near[:: max(1, -(-len(near) // _CELLS_A_ROUND))])
        bounds = bounds.split(cells, refine(sorted(cells)))


def _refiner(placed: DataFrame, buckets: list[tuple[int, int]]):
    """buckets: (lowest prefix sum, bucket) in order; each cell lies in one bucket, which is the key of the join."""
    lows = [low for low, _ in buckets]

    def refine(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
        asked = [(buckets[bisect_right(lows, a) - 1][1], i, a, b, max(1, -(-(b - a) // _FINER))) for i, (a, b) in enumerate(cells)]
        wanted = placed.sparkSession.createDataFrame(asked, "b int, w int, low long, high long, step long")
        inside = placed.join(F.broadcast(wanted), "b").filter(F.col("hi").between(F.col("low"), F.col("high")))
        rows = inside.groupBy("w", F.floor((F.col("hi") - F.col("low")) / F.col("step")).alias("c")).agg(F.min("hi").alias("a"), F.max("hi").alias("b")).collect()
        return [(r["a"], r["b"]) for r in rows]

    return refine


def _bucket(hash_col: Column) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring(hash_col, 1, 2)), 16, 10).cast("int"), 4)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, size (UTF-8 bytes and 1), text_crc32, shard (from 0), slot (gapless from 0 in a shard).

    Rows of equal text stay together; a null text counts as empty. The largest shard is as small
    as the order of the groups allows. Null ids and repeated rows have a slot each; with fewer
    groups than shards some shards have no rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("h")))
    groups = checkpoint(rows.groupBy("h").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")))
    total, count = groups.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    own: list[bytes] = []
    for r in groups.orderBy(F.desc("s"), "h").limit(shards).collect():
        if shards - len(own) > 1 and r["s"] * (shards - len(own)) >= total:
            own.append(bytes(r["h"]))
            total -= r["s"]
    rest = groups.filter(~F.col("h").isin(own)) if own else groups
    # prefix sums: within buckets of the hash, then over the buckets' totals, of which there are few
    sums = {r["b"]: r["s"] for r in rest.groupBy(_bucket(F.col("h")).alias("b")).agg(F.sum("s").alias("s")).collect()}
    before, offsets = 0, []
    for b in sorted(sums):
        offsets.append((b, before))
        before += sums[b]
    start = spark.createDataFrame(offsets, "b int, start long")
    inner = F.sum("s").over(Window.partitionBy("b").orderBy("h"))
    placed = rest.withColumn("b", _bucket(F.col("h"))).withColumn("inner", inner).join(F.broadcast(start), "b")
    placed = checkpoint(placed.select("h", "s", "n", "b", (F.col("start") + F.col("inner")).alias("hi")))
    cells = placed.groupBy("b").agg(F.min("hi").alias("lo"), F.max("hi").alias("up"), F.max("s").alias("most")).collect()
    ends = minimax_cuts(total, max([r["most"] for r in cells], default=0), shards - len(own), PrefixBounds([(r["lo"], r["up"]) for r in cells]), _refiner(placed, sorted((r["lo"], r["b"]) for r in cells)))
    shard = F.lit(len(own))
    for end in sorted(set(ends))[:-1]:
        shard = shard + (F.col("hi") > end).cast("int")
    shard = F.least(shard, F.lit(shards - 1))
    of_group = placed.select("h", "n", shard.alias("shard"))
    # at most _HOT_SHARE groups have so many rows
    hot = [(r["h"], r["shard"]) for r in of_group.filter(F.col("n") * _HOT_SHARE >= count).select("h", "shard").collect()] + [(h, i) for i, h in enumerate(own)]
    hot_rows = rows.join(F.broadcast(spark.createDataFrame([(bytearray(h), s) for h, s in hot], "h binary, hot int")), "h", "left")
    hot_rows = hot_rows.select("id", "size", "text_crc32", "h", "hot")
    cold = hot_rows.filter("hot IS NULL").drop("hot").join(of_group.select("h", "shard"), "h")
    fields = ["id", "size", "text_crc32", "h", "shard"]
    buckets = max(shuffle_partitions(spark), -(-count // _ROWS_A_SLOT_BUCKET))
    dealt = cold.select(fields).unionByName(hot_rows.filter("hot IS NOT NULL").withColumnRenamed("hot", "shard").select(fields))
    dealt = checkpoint(dealt.withColumn("b", F.pmod(F.xxhash64("id", "h"), F.lit(buckets))))
    counts = dealt.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("k"))
    first = counts.select("shard", "b", (F.sum("k").over(Window.partitionBy("shard").orderBy("b")) - F.col("k")).alias("first"))
    local = F.row_number().over(Window.partitionBy("shard", "b").orderBy("id", "h"))
    slots = dealt.withColumn("local", local).join(first, ["shard", "b"])
    return slots.select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("local") - 1).alias("slot"))
