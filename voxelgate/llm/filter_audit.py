"""Audit of how filters interact: every order of the filters is replayed over every document.

Each document's failures are a few bits. They meet all orders of the filters (120 of five, the
broadcast side, whose size is known), five steps are exploded from each, the first failure decides
where the document goes, and sums by part, order and step are combined before the shuffle.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

LETTERS = "ABCDE"
#: More filters have too many orders to be replayed (5,040 of seven).
MOST_FILTERS = 7
_BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """What a text fails by itself: few words, repeated words, capitals, marks (A to D)."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 50,
        F.lit(100) * distinct < F.lit(65) * F.size(words),
        F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def _bits(failures: list[Column]) -> Column:
    out = F.lit(0)
    for i, fails in enumerate(failures):
        out = out + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def flag_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, part, failed (bit 0 for A to bit 4 for E), good, toxic.

    E is the text of a smaller id, anywhere in the table. A row with a null id is no copy, makes no
    row a copy and has no labels; rows that repeat an id are judged one by one, and those with the
    smallest id of a text are no copies. A null text counts as empty, a null part as the empty
    string. A label that repeats an id counts if any of its rows is 1; null labels are not 1. Very
    long texts are read whole, an empty table gives no rows, and other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    alone = checkpoint(read.select("id", "part", _bits(text_failures(F.col("text"))).alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    known = alone.filter(F.col("id").isNotNull())
    # a text has one first id, so neither join has a hot key, however many copies there are
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    no = F.lit(False)
    found = known.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    copied = F.when(F.col("first").isNull(), F.lit(1 << 4)).otherwise(0)
    with_id = found.select("id", "part", (F.col("own") + copied).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return with_id.unionByName(alone.filter(F.col("id").isNull()).select("id", "part", F.col("own").alias("failed"), no.alias("good"), no.alias("toxic")))


def replay(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from part, failed, good and toxic.

    Bit i of failed is for letters[i]. Each part that has a row has a row for every order and step,
    zeros included; no rows give none.
    """
    n = len(letters)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have {factorial(n)} orders, which is too many to replay")
    spark = flags.sparkSession
    fields = ", ".join(f"b{i} int" for i in range(1, n + 1))
    orders = spark.createDataFrame([("".join(p), *[1 << letters.index(x) for x in p]) for p in permutations(letters)], f"filter_order string, {fields}")
    crossed = flags.select("part", "failed", "good", "toxic").crossJoin(F.broadcast(orders))
    hit = lambda bit: F.col("failed").bitwiseAND(bit) != 0
    first = F.lit(0)
    for i in range(n, 0, -1):
        first = F.when(hit(F.col(f"b{i}")), F.lit(i)).otherwise(first)
    steps = F.stack(F.lit(n), *[x for i in range(1, n + 1) for x in (F.lit(i), F.col(f"b{i}"))])
    each = crossed.withColumn("first", first).select("part", "filter_order", "failed", "good", "toxic", "first", steps.alias("step", "bit"))
    removed = F.col("first") == F.col("step")
    counted = each.groupBy("part", "filter_order", "step", "bit").agg(
        F.count_if((F.col("first") == 0) | (F.col("first") > F.col("step"))).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(hit(F.col("bit")) & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("failed") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # a part and filter has as many rows as there are orders
    from_all = F.expr("sum(removed) OVER (PARTITION BY part, bit)")
    named = F.substring("filter_order", F.col("step"), F.lit(1))
    return counted.select("part", "filter_order", "step", named.alias("filter"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", from_all.alias("shapley"))
