"""Removal of lines that many documents have, by SQL functions alone.

Lines are exploded, normalised and hashed (128 bits); documents are counted for each hash with
map-side combining; the lines of hashes over the threshold come back to their document as
positions, by which it is put together again. Only hashes, ids and positions are shuffled with the
lines; a text moves once, to meet its positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as small letters and all else as it is."""
    bare = F.btrim(line, F.lit(_BLANKS))
    # for plain ASCII both do the same, and lower is many times as fast
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _two(*cols: Column) -> list[Column]:
    """128 bits in two columns; a null among cols counts as nothing."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """h1, h2, n_docs, keep_id: the keys of at least min_length code points that at least min_docs rows have.

    A row counts once for a key, however often it has it; keep_id is the largest id, and null if
    all of its rows have a null id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(_lines(text), line_key))).alias("key"))
    h1, h2 = _two(F.col("key"))
    hashed = keys.filter(F.char_length("key") >= min_length).select("id", h1.alias("h1"), h2.alias("h2"))
    return hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keep_id")).filter(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """For each row of docs: row (struct of the carried columns), n_lines, n_dropped, kept_text.

    A line is dropped where its key has at least min_length code points, at least min_docs rows of
    docs have it, and the row's id isn't the largest of theirs. A null or empty text is one empty
    line, and its kept text is empty. Each row counts as a document: rows that repeat an id count
    one by one and lose the same lines; a null id counts as smaller than any, and lines that only
    rows with null ids have stay. Very long texts are handled whole; lines of blanks have an empty
    key and stay; an empty table gives no rows; columns that aren't carried aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # written, so that the join below can split a line that very many documents have
    repeated = checkpoint(repeated_lines(docs, id_col, text_col, min_length, min_docs).select("h1", "h2", "keep_id"))
    # id and text tell rows apart; rows that have both in common lose the same lines
    d1, d2 = _two(F.col(id_col), text)
    at = docs.select(F.col(id_col).alias("id"), d1.alias("d1"), d2.alias("d2"), text.alias("text")).select("id", "d1", "d2", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    keyed = at.select("id", "d1", "d2", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_length)
    h1, h2 = _two(F.col("key"))
    lost = keyed.select("id", "d1", "d2", "at", h1.alias("h1"), h2.alias("h2")).join(repeated, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keep_id")))
    # a document's own positions, so no group is larger than its text
    lost = lost.groupBy("d1", "d2").agg(F.collect_set("at").alias("lost"))
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    whole = docs.select(row, text.alias("text"), d1.alias("d1"), d2.alias("d2")).join(lost, ["d1", "d2"], "left")
    n_lines = F.size(_lines(F.col("text"))).cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.col("lost"))
    # the lines are bound once, then taken by position
    rebuilt = F.get(F.transform(F.array(_lines(F.col("text"))), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    return whole.select("row", n_lines.alias("n_lines"), F.when(F.col("lost").isNotNull(), F.size("lost")).otherwise(0).cast("long").alias("n_dropped"), F.when(F.col("lost").isNull(), F.col("text")).otherwise(rebuilt).alias("kept_text"))
