"""Connected ground cells of frames of any size: small frames as they are, larger ones within tiles first, then across their borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: Cells up to which a frame is one group.
FEW_CELLS = 100_000
#: Side of a tile in cells; of a frame with more cells a group holds at most its square.
TILE = 64
#: Links of a frame across borders that one task joins; of a frame with more they are joined round by round.
FEW_LINKS = 500_000


class Sets:
    """Disjoint sets of numbers, each named by its least member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.parent[j] = i


def label_cells(cells: pd.DataFrame) -> np.ndarray:
    """For each row (gx, gy), the index of the first row of its component; cells touch by side or corner."""
    at, sets = {c: i for i, c in enumerate(zip(cells["gx"], cells["gy"], strict=True))}, Sets(len(cells))
    for (gx, gy), i in at.items():
        for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1)):
            if (j := at.get((gx + dx, gy + dy))) is not None:
                sets.join(i, j)
    return np.array([sets.find(i) for i in range(len(cells))], np.int64)


def _labelled(cells: DataFrame, keys: list[str], name: str) -> DataFrame:
    """cells with a column part: the least name of the cells of the same keys that are connected."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, ignore_index=True)
        return pdf.assign(part=pdf[name].to_numpy()[label_cells(pdf)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    return cells.groupBy(*keys).applyInPandas(label, f"{schema}, part {cells.schema[name].dataType.simpleString()}")


def _within_tiles(cells: DataFrame, frame: str, name: str, tile: int) -> DataFrame:
    tiled = cells.withColumns({"_tx": F.floor(F.col("gx") / tile), "_ty": F.floor(F.col("gy") / tile)})
    return _labelled(tiled, [frame, "_tx", "_ty"], name)


def _across_borders(cells: DataFrame, frame: str, tile: int) -> DataFrame:
    """Pairs (frame, a, b) of parts of different tiles that touch."""
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = cells.filter(edge("gx") | edge("gy")).select(frame, "gx", "gy", "_tx", "_ty", "part")
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))])).alias("s")
    asked = border.select(frame, "part", F.col("_tx").alias("tx"), F.col("_ty").alias("ty"), "gx", "gy", steps).select(frame, F.col("part").alias("a"), "tx", "ty", (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"))
    met = asked.join(border, [frame, "gx", "gy"]).filter((F.col("tx") != F.col("_tx")) | (F.col("ty") != F.col("_ty")))
    return met.select(frame, F.greatest("a", "part").alias("a"), F.least("a", "part").alias("b")).filter("a <> b").distinct()


def _joined_in_tasks(links: DataFrame, frame: str, kind: str) -> DataFrame:
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        sets = Sets(len(names))
        for i, j in zip(np.searchsorted(names, pdf["a"]), np.searchsorted(names, pdf["b"]), strict=True):
            sets.join(int(i), int(j))
        return pd.DataFrame({frame: pdf[frame].iloc[0], "part": names, "component": names[[sets.find(i) for i in range(len(names))]]})

    return links.groupBy(frame).applyInPandas(join, f"`{frame}` {links.schema[frame].dataType.simpleString()}, part {kind}, component {kind}")


def _joined_by_rounds(links: DataFrame, frame: str) -> DataFrame:
    """Each part learns the least name among its own and its neighbours', then that name's own, so that ways halve, until nothing changes."""
    both = checkpoint(links.select(frame, F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("near")), F.struct(F.col("b").alias("part"), F.col("a").alias("near")))).alias("l")).select(frame, "l.*"))
    known, before = checkpoint(both.groupBy(frame, "part").agg(F.min(F.least("part", "near")).alias("component"))), None
    while (mark := known.agg(F.sum(F.xxhash64(frame, "part", "component").cast("decimal(38,0)"))).first()[0]) != before:
        before = mark
        name = lambda key, out: known.select(frame, F.col("part").alias(key), F.col("component").alias(out))  # noqa: E731, B023
        heard = both.join(name("near", "theirs"), [frame, "near"]).groupBy(frame, "part").agg(F.min("theirs").alias("theirs"))
        closer = known.join(heard, [frame, "part"]).select(frame, "part", F.least("component", "theirs").alias("component"))
        jumped = closer.join(name("component", "further"), [frame, "component"], "left").select(frame, "part", F.least("component", F.coalesce("further", "component")).alias("component"))
        known = checkpoint(jumped)
    return known


def connect_cells(cells: DataFrame, frame: str = "frame_id", name: str = "first", tile: int = TILE, few: int = FEW_LINKS, few_cells: int = FEW_CELLS) -> DataFrame:
    """cells (frame, gx, gy, name, which is unique in a frame, and more) with a column component: the least name of all connected cells of the frame."""
    cells = checkpoint(cells)
    if (cells.groupBy(frame).count().agg(F.max("count")).first()[0] or 0) <= few_cells:
        return _labelled(cells, [frame], name).withColumnRenamed("part", "component")
    parts = checkpoint(_within_tiles(cells, frame, name, tile))
    links = checkpoint(_across_borders(parts, frame, tile))
    most = links.groupBy(frame).count().agg(F.max("count")).first()[0]
    parts = parts.drop("_tx", "_ty")
    if most is None:
        return parts.withColumnRenamed("part", "component")
    kind = cells.schema[name].dataType.simpleString()
    joined = _joined_in_tasks(links, frame, kind) if most <= few else _joined_by_rounds(links, frame)
    found = parts.join(joined, [frame, "part"], "left")
    return found.select(*cells.columns, F.coalesce("component", "part").alias("component"))
