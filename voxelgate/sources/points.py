"""Point clouds from files as DataFrames (path, point_id, x, y, z)."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import read_feather, register
from .shared import checkpoint

SUFFIXES = {".npy": "npy", ".pcd": "pcd", ".bin": "bin", ".feather": "feather"}
BINARY = {"npy": "npy", "pcd": "pcd", "bin": "kitti_bin"}
#: Column names of text clouds. Fixed values.
NAMES = {a: (a, f"p{a}", f"point_{a}", f"position_{a}") for a in "xyz"}


def format_of(path: str, fmt: str) -> str:
    """The format, by the suffix where it is "auto"; what isn't known is text."""
    fmt = fmt.lower()
    if fmt == "auto":
        return SUFFIXES.get(PurePosixPath(path).suffix.lower(), "text")
    if fmt not in (*SUFFIXES.values(), "text"):
        raise ValueError(f"clouds of format {fmt} can't be read")
    return fmt


def read_points(spark: SparkSession, path: str, *, fmt: str) -> DataFrame:
    fmt = format_of(path, fmt)
    if fmt == "text":
        return _read_text(spark, path)
    if fmt == "feather":
        return read_feather(spark, path, "path string, row_no long, x double, y double, z double").withColumnRenamed("row_no", "point_id")
    register(spark)
    return spark.read.format(BINARY[fmt]).load(path)


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file by itself: separated by commas, if its first data line has one, else by blanks; with or without a header.

    The header is the first line that isn't blank, even where that is a comment; without the names
    of all three columns the first three count. Only a tab between the numbers of the first line
    makes it a header too.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("point_id"), F.trim("value").alias("line")).filter("line <> ''")
    # places of the first line and of the first line of data, and the number of those; only numbers, as texts would be sorted by path
    places = checkpoint(lines.groupBy("path").agg(F.min("point_id").alias("head_id"), F.expr("min(point_id) FILTER (WHERE NOT startswith(line, '#'))").alias("first_id"), F.expr("count(*) FILTER (WHERE NOT startswith(line, '#'))").alias("n")))
    # the driver lists the files anyway, and a row for each goes to the lines, which would meet in one task for each file
    near = F.broadcast(places.withColumnRenamed("path", "_path"))
    found = lines.join(near, (F.col("path") == F.col("_path")) & F.col("point_id").isin(F.col("head_id"), F.col("first_id")))
    text = lambda place: F.max(F.when(F.col("point_id") == F.col(place), F.col("line")))
    heads = found.groupBy("path", "head_id", "n").agg(text("head_id").alias("head"), text("first_id").alias("first"))
    comma = F.contains("first", F.lit(","))
    token = F.trim(F.get(F.split("first", F.when(comma, F.lit(",")).otherwise(F.lit(" "))), F.lit(0)))
    names = F.split(F.trim(F.translate(F.lower("head"), ",", " ")), r"\s+")
    place = lambda a: F.get(F.filter(F.transform(F.array(*map(F.lit, NAMES[a])), lambda n: F.array_position(names, n)), lambda i: i > 0), F.lit(0)) - 1
    headed = token.try_cast("double").isNull()
    found = F.array(*[place(a).cast("int") for a in "xyz"])
    at = F.when(headed & ~F.exists(found, lambda i: i.isNull()), found).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    heads = heads.filter("first IS NOT NULL").select("path", comma.alias("comma"), F.when(headed, F.col("head_id")).otherwise(F.lit(-1)).alias("head_id"), at.alias("at"), (headed & (F.col("n") - (F.col("first") == F.col("head")).cast("int") <= 0)).alias("bare"))
    heads = checkpoint(heads)
    if not heads.filter("bare").isEmpty():
        raise ValueError("no line of numbers in this cloud")
    data = lines.join(F.broadcast(heads), "path").filter(F.col("point_id") > F.col("head_id")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter("line <> ''")
    parts = data.withColumn("parts", F.when(F.col("comma"), F.split("line", ",")).otherwise(F.split("line", r"\s+")))
    short = F.raise_error(F.lit("a line of this cloud has fewer than three numbers"))
    enough = F.when(F.size("parts") > F.array_max("at"), F.col("parts")).otherwise(short.cast("array<string>"))
    return parts.withColumn("parts", enough).select("path", "point_id", *[F.trim(F.get("parts", F.get("at", F.lit(i)))).cast("double").alias(a) for i, a in enumerate("xyz")])
