"""Language identification by compression with one dictionary per language.

Each language's dictionary is raw content: pieces of its training texts. A text is coded with
every dictionary, block by block, and the language whose dictionary gives the fewest bytes is
chosen; where the second smallest is hardly larger the text is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, tidy

UNKNOWN = "und"
_BLOCK = 4096
#: Bytes by which a size counts e times less likely.
_SOFTNESS = 4.0
_ASCII_LETTER = re.compile("[A-Za-z]")
#: What is no letter in ASCII says little about the language; it becomes a space.
_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The lower-case words of a text in UTF-8, one space apart."""
    return b" ".join(text.lower().encode().translate(_SPACES).split())


def has_letter(text: str) -> bool:
    """Whether some character is a letter (general category L); numerals such as \u00b2 or \u2460 are none."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: raw content per language. min_margin, min_bytes: a text is rejected when the second smallest size exceeds the smallest by less than this share of it, or by fewer bytes."""

    dictionaries: dict[str, bytes]
    min_margin: float = 0.002
    min_bytes: int = 1
    level: int = 5


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 400, dictionary_bytes: int = 112 << 10, min_margin: float = 0.002, min_bytes: int = 1, max_languages: int = 256) -> LanguageModel:
    """Learns from whole texts of each language: as many rows as dictionary_bytes holds, at most docs_per_language, chosen by a hash of their id.

    Texts of up to a sixteenth of the dictionary go first, so that it has many; longer ones take
    what is left, whole or not at all. If no text fits, the shortest of the chosen rows is taken,
    whole too. Rows with a null text or language teach nothing; without any row there is no
    language to choose. More than max_languages languages are an error, as each has a dictionary
    in every task.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> 'und'")
    counts = {r["lang"]: r["count"] for r in given.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return LanguageModel({}, min_margin, min_bytes)
    order = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * docs_per_language / n) * (1 << 30)))])
    rows = given.filter(order < share[F.col("lang")]).select("lang", order.alias("o"), "text")
    # about 1.5 * docs_per_language rows of a language come to one task, however large the input is
    size = (F.octet_length("text") + 1).cast("long")
    in_order = Window.partitionBy("lang").orderBy(size > dictionary_bytes // 16, "o", "text")
    placed = rows.withColumns({"n": F.row_number().over(Window.partitionBy("lang").orderBy("o", "text")), "size": size}).filter(F.col("n") <= docs_per_language)
    placed = placed.withColumn("end", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shortest = F.row_number().over(Window.partitionBy("lang").orderBy("size", "n"))
    taught = placed.withColumn("by_size", shortest).filter((F.col("end") <= dictionary_bytes) | ((F.col("by_size") == 1) & (F.col("size") > dictionary_bytes))).select("lang", "text", "n").collect()
    content: dict[str, list[bytes]] = {}
    for r in sorted(taught, key=lambda r: (r["lang"], r["n"])):
        content.setdefault(r["lang"], []).append(letters(r["text"]))
    return LanguageModel({k: b" ".join(filter(None, v)) for k, v in content.items()}, min_margin, min_bytes)


class Identifier:
    """One compressor per language."""

    def __init__(self, model: LanguageModel):
        import zstandard as zstd

        self.langs = sorted(model.dictionaries)
        self.min_margin, self.min_bytes = model.min_margin, model.min_bytes
        self.coders = []
        for lang in self.langs:
            content = zstd.ZstdCompressionDict(model.dictionaries[lang] or b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=model.level)
            self.coders.append(zstd.ZstdCompressor(level=model.level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        raw = b" " + letters(text) + b" "
        blocks = [raw[i : i + _BLOCK] for i in range(0, len(raw), _BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        least = min(sizes)
        best = sizes.index(least)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        score = 1 / sum(math.exp(-min(700.0, (s - least) / _SOFTNESS)) for s in sizes)
        return self.langs[best], score, rest is not None and rest - least < max(self.min_margin * least, self.min_bytes)


def _run(model: LanguageModel, text_col: str | None):
    """text_col: where the carried row has the text, so that it isn't sent twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(model)
        for batch in batches:
            whole = batch.column("text") if text_col is None else pc.struct_field(batch.column("row"), text_col)
            for part in slices(batch, whole, 1000):
                row = part.column("row")
                text = part.column("text") if text_col is None else pc.struct_field(row, text_col)
                found = [identify(x.as_py()) for x in text]
                lang, score, rejected = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([row, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs: row (struct of the carried columns), lang_pred, score (0 to 1), rejected.

    A text that is null, empty or has no letter is `und` with score 0 and rejected. Equal sizes go
    to the first language by name and are rejected. Repeated rows and null ids are treated like
    any row; an empty table gives no rows. Only the text is read for the prediction; long texts
    are coded whole, in blocks.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    inside = text_col in carry
    given = docs.select(row, *([] if inside else [F.col(text_col).alias("text")]))
    fields = [("row", given.schema["row"].dataType), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return given.mapInArrow(tidy(_run(model, text_col if inside else None)), T.StructType([T.StructField(*f) for f in fields]))
