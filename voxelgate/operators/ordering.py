"""Ranks, running sums and exact percentiles of any number of rows, without one task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: Rows that one task may order; beyond it they are dealt by ranges, or their values counted in bins.
SMALL = 100_000
#: Bins of a range of values in one pass.
BINS = 4096


def running(rows: DataFrame, order: str, sums: dict[str, str], least: int = 0, small: int | None = None) -> tuple[DataFrame, int]:
    """rows (order is unique) with running sums by order: sums names a column of numbers for each new one. Also the number of rows.

    Many rows are dealt by ranges of order. Each range is summed by itself, and the sums of the
    ranges before, one number for each range, are added.
    """
    rows = checkpoint(rows)
    n = rows.count()
    so_far = Window.orderBy(order) if n <= (SMALL if small is None else small) else None
    if so_far is None:
        dealt = checkpoint(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
        totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in dict.fromkeys(sums.values())]).collect()
        before, at = [], dict.fromkeys(sums.values(), 0)
        for r in sorted(totals, key=lambda r: r["_range"]):
            before.append((r["_range"], *at.values()))
            at = {c: at[c] + (r[c] or 0) for c in at}
        fields = ", ".join(["_range int", *[f"_before_{c} long" for c in at]])
        rows = dealt.join(F.broadcast(rows.sparkSession.createDataFrame(before, fields)), "_range")
        so_far = Window.partitionBy("_range").orderBy(order)
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = lambda c: F.col(f"_before_{c}") if f"_before_{c}" in rows.columns else F.lit(0)
    out = rows.withColumns({name: (F.sum(F.coalesce(F.col(c), F.lit(0))).over(so_far) + base(c) + least).cast("long") for name, c in sums.items()})
    return out.drop("_range", *[f"_before_{c}" for c in sums.values()]), n


def ranked(rows: DataFrame, order: str, name: str, first: int = 1, small: int | None = None) -> tuple[DataFrame, int]:
    """rows (order is unique) with their place in the order, and their number."""
    out, n = running(rows.withColumn("_one", F.lit(1)), order, {name: "_one"}, first - 1, small)
    return out.drop("_one"), n


def percentiles(rows: DataFrame, value: str, shares: list[float], small: int | None = None) -> list[float | None]:
    """Exact percentiles (shares from 0 to 1, linear between ranks) of a column of numbers without NaN; null without values.

    Many values are counted in bins between the smallest and the largest, and again between the
    ends of the bin that has the wanted rank, until that bin has few values or one value only. A
    pass sends one row for each bin and task.
    """
    small = SMALL if small is None else small
    values = rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    n, least, most = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    if n <= small:
        return values.agg(F.percentile("v", [float(s) for s in shares])).first()[0]
    places = [s * (n - 1) for s in shares]
    wanted = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    # for each rank: the range that has it, and how many values lie below the range and in it
    held = {r: (least, most, 0, n) for r in wanted}
    while open_ := {h[:2] for h in held.values() if h[0] < h[1] and h[3] > small}:
        targets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(open_)])).alias("t")
        # halves keep the width of a range finite; where it vanishes, the smallest value is apart from the rest
        half = F.col("t.b") / 2 - F.col("t.a") / 2
        place = F.when(half > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("t.a") / 2) / half * BINS))).otherwise(F.when(F.col("v") == F.col("t.a"), F.lit(0)).otherwise(F.lit(BINS - 1)))
        inside = values.select("v", targets).filter("v BETWEEN t.a AND t.b").select("v", F.col("t.a").alias("a"), F.col("t.b").alias("b"), place.alias("bin"))
        bins = inside.groupBy("a", "b", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("a", "b", "bin").collect()
        for rank, (a, b, below, size) in list(held.items()):
            if (a, b) not in open_ or size <= small:
                continue
            for r in (r for r in bins if (r["a"], r["b"]) == (a, b)):
                if rank < below + r["n"]:
                    held[rank] = (r["least"], r["most"], below, r["n"])
                    break
                below += r["n"]
    found = {r: a for r, (a, b, _, _) in held.items() if a == b}
    for a, b in sorted({held[r][:2] for r in wanted if r not in found}):
        few = sorted(r["v"] for r in values.filter((F.col("v") >= a) & (F.col("v") <= b)).collect())
        found |= {r: few[r - held[r][2]] for r in wanted if held[r][:2] == (a, b)}
    low, high = (lambda p: found[math.floor(p)]), (lambda p: found[math.ceil(p)])
    return [low(p) + (high(p) - low(p)) * (p - math.floor(p)) if low(p) != high(p) else low(p) for p in places]
