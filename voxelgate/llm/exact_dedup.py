"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are split by successive bytes until each group is a single row or has ended. The first
digits are split across the cluster (a bounded histogram of byte prefixes finds the groups that
are too large for one task), the rest inside tasks. A prefix group that stays too large after the
last digit of a level is dealt over salted pieces: each piece first reduces its equal texts to one
representative, and the representatives alone go on to the next, deeper level. So a group that
holds a third of all rows never meets in one task, and equality is decided by bytes, not by a
digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpoint, partitions_for, tidy

#: [\x20\x09-\x0D]
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_BLANK_RUN = "[\\x20\\x09-\\x0D]+"
#: Digit ends of the first level, in bytes; each further level goes 16 times as deep.
DIGIT_ENDS = (4, 16, 64)
#: A group of at most so many rows always fits one task.
SMALL_GROUP = 1000
#: A group of more rows than FEW and more bytes than these is too large for one task too.
LARGE_BYTES, FEW = 32 << 20, 8
#: Bound of the prefixes kept from a level's histogram by their rows: 2 * MAX_SPLITS for each digit; by their bytes there is one for each LARGE_BYTES of input at most.
MAX_SPLITS = 2048


def normalise(text: bytes) -> bytes:
    """Each run of blanks becomes one space."""
    text = text.translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def radix_groups(texts: list[bytes], depth: int = 0) -> Iterator[list[int]]:
    """Positions of equal texts: split by successive bytes until singleton or ended.

    The digit widens with the depth, so that long equal texts take few rounds.
    """
    stack = [(depth, 8, list(range(len(texts))))] if texts else []
    while stack:
        at, width, members = stack.pop()
        if len(members) == 1:
            yield members
            continue
        split: dict[bytes, list[int]] = {}
        for i in members:
            split.setdefault(texts[i][at : at + width], []).append(i)
        for digit, part in split.items():
            if len(part) == 1 or len(digit) < width:
                yield part
            else:
                stack.append((at + width, min(4 * width, 4096), part))


def _prefix(text: Column, end: int, normalised: bool) -> Column:
    """The first bytes of the normalised text; only as much of it is normalised as is needed."""
    if normalised:
        return F.substring(text, 1, end)
    head = F.regexp_replace(F.substring(text, 1, 8 * end), _BLANK_RUN, " ")
    enough = (F.length(head) > end) | (F.length(text) <= 8 * end)
    whole = F.when(enough, head).otherwise(F.regexp_replace(text, _BLANK_RUN, " "))
    return F.substring(whole.cast("binary"), 1, end)


def _splitter(normalised: bool, inside: str | None):
    """Groups the rows of one task; see _level for the columns. inside: the field of the carried row that has the text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        data = pa.Table.from_batches(got)
        ids = data.column("id").to_pylist()
        counts = data.column("cnt").to_pylist()
        hot = data.column("hot").to_pylist()
        column = data.column("text") if inside is None else pc.struct_field(data.column("row").combine_chunks(), inside)
        texts = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
        if not normalised:
            texts = [normalise(x) for x in texts]
        n = len(ids)
        base = TaskContext.get().partitionId() << 32
        keep, total, winner, rep_key, rep_text = [None] * n, [0] * n, [False] * n, [0] * n, [None] * n
        number = 0
        for wanted in (False, True):
            members = [i for i in range(n) if hot[i] is wanted]
            for group in radix_groups([texts[i] for i in members]):
                group = [members[i] for i in group]
                first = min(group, key=lambda i: (ids[i] is None, ids[i] or 0, i))
                size = sum(counts[i] for i in group)
                number += 1
                for i in group:
                    keep[i], total[i], rep_key[i] = ids[first], size, base | number
                winner[first] = True
                if wanted:
                    rep_text[first] = texts[first]
        out = {
            "row": data.column("row").combine_chunks(),
            "id": data.column("id").combine_chunks(),
            "sha": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            "hot": pa.array(hot, pa.bool_()),
            "rep_key": pa.array(rep_key, pa.int64()),
            "keep_id": pa.array(keep, data.schema.field("id").type),
            "total": pa.array(total, pa.int64()),
            "winner": pa.array(winner, pa.bool_()),
            "text": pa.array(rep_text, pa.binary()),
        }
        whole = pa.table(out)
        yield from whole.to_batches(max_chunksize=4096)

    return split


def _any_of(value: Column, known: list[int]) -> Column:
    return value.isin(known) if known else F.lit(False)


def _level(df: DataFrame, scale: int, normalised: bool, inside: str | None) -> DataFrame:
    """One distributed level over columns row, id, cnt, text.

    Gives row, id, sha, hot, rep_key, keep_id, total, winner, text. For rows that aren't hot the
    group is whole; for hot ones it is a piece whose winner carries the normalised text.
    """
    spark = df.sparkSession
    ends = tuple(e * scale for e in DIGIT_ENDS)
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = partitions_for(spark, size or 0)
    limit = max(SMALL_GROUP, n // (2 * min(parts, MAX_SPLITS)))
    df = df.withColumn("prefix", _prefix(F.col("text"), ends[-1], normalised))
    hot_leaf, leaf, salts = F.lit(False), F.col("prefix"), 1
    if n > limit or (size or 0) > LARGE_BYTES:
        mark = lambda e: F.xxhash64(F.substring("prefix", 1, e))
        digits = F.array(*[F.struct(F.lit(e).alias("e"), mark(e).alias("p")) for e in ends])
        sums = df.select(F.explode(digits).alias("d"), F.octet_length("text").alias("size")).groupBy("d").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
        # prefixes are known by 8 bytes: what is taken for a heavy one goes deeper, which does no harm
        heavy = sums.filter((F.col("rows") > limit) | ((F.col("rows") > FEW) & (F.col("bytes") > LARGE_BYTES))).select("d.e", "d.p", "rows", "bytes").collect()
        hot_leaf = F.lit(True)
        for e in reversed(ends):
            large = _any_of(mark(e), sorted(r["p"] for r in heavy if r["e"] == e))
            leaf, hot_leaf = F.when(~large, F.substring("prefix", 1, e)).otherwise(leaf), F.when(~large, F.lit(False)).otherwise(hot_leaf)
        # some rows in each piece, so that equal ones get fewer from level to level
        salts = max([1, *(max(-(-r["rows"] // limit), min(r["rows"] // 4, -(-r["bytes"] // LARGE_BYTES))) for r in heavy if r["e"] == ends[-1])])
    dealt = df.withColumn("hot", hot_leaf).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))))
    dealt = dealt.repartition(parts, F.xxhash64(leaf, "salt")).select("row", "id", "cnt", "hot", *([] if inside else ["text"]))
    schema = T.StructType(
        [
            T.StructField("row", df.schema["row"].dataType),
            T.StructField("id", df.schema["id"].dataType),
            T.StructField("sha", T.StringType()),
            T.StructField("hot", T.BooleanType()),
            T.StructField("rep_key", T.LongType()),
            T.StructField("keep_id", df.schema["id"].dataType),
            T.StructField("total", T.LongType()),
            T.StructField("winner", T.BooleanType()),
            T.StructField("text", T.BinaryType()),
        ]
    )
    return checkpoint(dealt.mapInArrow(tidy(_splitter(normalised, inside)), schema))


def _resolve(df: DataFrame, scale: int = 1, normalised: bool = False, inside: str | None = None) -> DataFrame:
    out = _level(df, scale, normalised, inside)
    whole = ["row", "sha", "keep_id", "total", "winner"]
    cold, hot = out.filter(~F.col("hot")).select(whole), out.filter("hot")
    if hot.isEmpty():
        return cold
    reps = hot.filter("winner").select(F.struct("rep_key").alias("row"), "id", F.col("total").alias("cnt"), "text")
    deeper = _resolve(reps, scale * 16, True).select(F.col("row.rep_key").alias("rep_key"), F.col("keep_id").alias("keep"), F.col("total").alias("all"), F.col("winner").alias("wins"))
    # each rep_key stands for the equal rows of one piece, so no key of this join is hot
    joined = hot.select("row", "sha", "winner", "rep_key").join(deeper, "rep_key")
    return cold.unionByName(joined.select("row", "sha", F.col("keep").alias("keep_id"), F.col("all").alias("total"), (F.col("winner") & F.col("wins")).alias("winner")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: row (struct of the carried columns), keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes once each run of blanks is one space. Of equal
    texts the row with the smallest id stays; a null id counts as larger than any, and of repeated
    rows with that id exactly one stays. A null text counts as the empty text. Columns that aren't
    carried aren't read, and a carried column may have any name. Very long texts are compared
    whole, and groups of them are split by their bytes too. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry or [id_col]]).alias("row")
    given = docs.select(row, F.col(id_col).alias("id"), F.lit(1).cast("long").alias("cnt"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a carried text isn't sent twice
    bounded_batches(docs.sparkSession)
    return _resolve(given, inside=text_col if text_col in (carry or ()) else None).select("row", "keep_id", F.col("total").alias("group_size"), F.col("winner").alias("kept"), F.col("sha").alias("text_sha256"))
