"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Labelled documents become vectors of term weights: trigrams of letters, hashed and weighted by the
documents that have them, trigrams of character kinds, and repetition terms. A truncated singular
value decomposition gives the latent space, and the labelled vectors in it are sent to every task.
Each document is projected, its cosines with all labelled vectors are computed exactly, block by
block, and the nearest vote with the weight of their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, tidy

#: Character kinds, by which trigrams are formed.
_KINDS = {b" ": 1, b"\n": 2, b"\t\r\x0b\x0c": 3, b".": 4, b",;:": 5, b"!?": 6, b"|": 7, b"#$%&*": 8, b"()[]{}<>": 9, b"'\"`-_": 10, b"/\\@=+~^": 11}
_DIGIT, _LOWER, _UPPER, _WIDE = 12, 13, 14, 15
_TRIGRAMS = 16**3
_REPEATS = 24
_SHAPES = _TRIGRAMS + _REPEATS
#: Buckets of the hashed trigrams of letters, and their length beside the other terms.
_LETTERS, _LETTER_SHARE = 4096, 0.4
TERMS = _SHAPES + _LETTERS


def _kind_table() -> bytes:
    kinds = bytearray(256)
    for chars, kind in _KINDS.items():
        for c in chars:
            kinds[c] = kind
    for c in range(256):
        if 48 <= c < 58:
            kinds[c] = _DIGIT
        elif 97 <= c < 123:
            kinds[c] = _LOWER
        elif 65 <= c < 91:
            kinds[c] = _UPPER
        elif c >= 128:
            kinds[c] = _WIDE
    return bytes(kinds)


_TABLE = _kind_table()


def terms(text: str | None) -> np.ndarray:
    """Terms of a text: those of kinds and repetition with a length of one together, those of letters as the root of their share; none for an empty text."""
    raw = (text or "").encode()
    out = np.zeros(TERMS, np.float32)
    if not raw:
        return out
    kinds = np.frombuffer(b"\x02" + raw.translate(_TABLE) + b"\x02\x02", np.uint8).astype(np.int32)
    grams = np.bincount(kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:], minlength=_TRIGRAMS)
    out[:_TRIGRAMS] = np.sqrt(grams / len(raw))
    words = raw.lower().split()
    if words:
        same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        fresh = len(set(words)) / len(words)
        lines = [x for x in raw.split(b"\n") if x]
        again = 1 - len(set(lines)) / max(1, len(lines))
        for at, share in ((0, same), (8, max(0.0, 1 - fresh - 0.3)), (16, again)):
            # a term for each eighth that is reached, so that near shares share terms
            out[_TRIGRAMS + at : _TRIGRAMS + at + round(8 * min(1.0, share))] = 0.35
    out /= np.linalg.norm(out)
    lower = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(lower) >= 3:
        mixed = (lower[:-2] << 16 | lower[1:-1] << 8 | lower[2:]) * np.uint32(2654435761)
        out[_SHAPES:] = np.sqrt(np.bincount(mixed >> np.uint32(20), minlength=_LETTERS) / len(lower))
    return out


def weighted(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of terms to vectors of length one; rarity: weights of the terms of letters."""
    letters = rows[:, _SHAPES:] * rarity
    letters *= _LETTER_SHARE / np.maximum(np.linalg.norm(letters, axis=1, keepdims=True), 1e-12)
    return _unit(np.concatenate([rows[:, :_SHAPES], letters], axis=1))


@dataclass(frozen=True)
class QualityModel:
    """rarity: weights of the terms of letters. projection: terms to latent axes. vectors: labelled documents in it, of length one. labels: 0 to 1."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float
    prior: float


def _hash_share(id_col: str, most: int, count: int):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(1, count)) * (1 << 30)))


def _map_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [terms(x).astype(np.float16).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(rows, pa.binary())], ["label", "key", "terms"])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 2048, axes: int = 48, neighbours: int = 25, sharpness: float = 8.0) -> QualityModel:
    """Learns from about max_labelled labelled ids, chosen by a hash of the id.

    An id with several labels counts with their mean, one with several texts with the smallest;
    null labels and ids teach nothing. Without any label every score is 0.5.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
    count = marked.count()
    chosen = marked.filter(_hash_share("id", max_labelled, count))
    # at most a few more than max_labelled ids, so they fit every task; an id has one text however often it is there
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    texts = texts.select("label", F.xxhash64("id", "text").alias("key"), "text")
    got = texts.mapInArrow(_map_terms, "label double, key long, terms binary").collect()
    got.sort(key=lambda r: (r["key"], r["label"]))
    if not got:
        return QualityModel(np.ones(_LETTERS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, sharpness, 0.5)
    raw = np.stack([np.frombuffer(r["terms"], np.float16) for r in got]).astype(np.float32)
    rarity = np.log((1 + len(raw)) / (1 + (raw[:, _SHAPES:] > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    weights = weighted(raw, rarity)
    marks = np.array([r["label"] for r in got])
    values, left = np.linalg.eigh((weights @ weights.T).astype(np.float64))
    top = np.argsort(values)[::-1][: min(axes, len(values))]
    top = top[values[top] > 1e-9]
    projection = (weights.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32) if len(top) else np.zeros((TERMS, 1), np.float32)
    return QualityModel(rarity, projection, _unit(weights @ projection), marks, neighbours, sharpness, float(marks.mean()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def scores(model: QualityModel, rows: np.ndarray) -> np.ndarray:
    """Scores of documents given as rows of terms. Of labelled documents that are equally near, each votes with the same part of what is left of the places."""
    if not len(model.labels):
        return np.full(len(rows), model.prior)
    cosine = _unit(weighted(rows, model.rarity) @ model.projection) @ model.vectors.T
    k = min(model.neighbours, cosine.shape[1])
    last = np.partition(cosine, -k, axis=1)[:, -k:][:, :1]
    above, level = cosine > last, cosine == last
    # those as near as the last share the places that the nearer ones leave
    share = above + level * ((k - above.sum(axis=1, keepdims=True)) / level.sum(axis=1, keepdims=True))
    vote = share * np.maximum(cosine, 0).astype(np.float64) ** model.sharpness
    total = vote.sum(axis=1)
    found = vote @ model.labels
    return np.clip(np.where((total > 1e-12) & rows.any(axis=1), found / np.maximum(total, 1e-12), model.prior), 0, 1)


def _run(packed: bytes, block: int):
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(zlib.decompress(packed))
        for batch in batches:
            for part in slices(batch, batch.column("text"), block):
                rows = np.stack([terms(x) for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores(model, rows))], ["row", "score"])

    return run


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), block: int = 256) -> DataFrame:
    """For each row of docs: row (struct of the carried columns) and score (0 to 1, higher: label 1 likelier).

    A null or empty text has no terms and gets the share of label 1 among the labelled; repeated
    rows get the same score; null ids are carried; an empty table gives no rows. The whole text is
    read, however long, and nothing but the text. scores defines what equally near neighbours do.
    """
    import pickle

    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    given = docs.select(row, F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(tidy(_run(zlib.compress(pickle.dumps(model), 1), block)), schema)
