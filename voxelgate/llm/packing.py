"""Packing of token sequences by concatenating and cutting.

Pass one tokenizes each partition's documents and writes the ids; the partitions' token totals,
summed up, give each partition its offset in the one long sequence of all tokens. Pass two reads
the ids again and cuts at multiples of the window: a document that crosses a boundary gets one
record for each window it touches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpoint, hold, slices, tidy
from .words import distinct_words, gather

#: Words of a worker's cache; beyond it a new one is begun, and the last full one is kept beside it.
CACHED_WORDS = 600_000
_LONG_WORD = 64
#: Latin letters, with or without what the vocabulary's pre-tokenizer cuts off after them. Such letters are composed already, and the vocabulary lowers their case.
_LETTERS_END = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!#$%&*,.:;?|]*)")


class WordEncoder:
    """Ids of a text as the tokenizers library gives them, looked up word by word.

    Where the vocabulary marks the ends of words and its pre-tokenizer drops white space, the ids of
    a text are those of its blank-separated words; those new to a worker are coded in one go. With
    any other vocabulary whole texts are coded.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.cached_words = cached_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = self.tokenizer.model.end_of_word_suffix if hasattr(self.tokenizer.model, "end_of_word_suffix") else None
        self.by_word = bool(suffix) and "Lowercase" in str(self.tokenizer.normalizer) and 'behavior=Removed' in str(self.tokenizer.pre_tokenizer).replace('"', '')
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, coded many at once and told apart by the ids that end a word."""
        out: list[bytes] = []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.frombuffer(self._coded([" ".join(part)])[0], self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, width = ids.tobytes(), self.dtype.itemsize
                cuts = [0, *(ends * width).tolist()]
                out += [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            else:
                out += self._coded(part)
        return out

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each of the distinct words, packed as dtype."""
        known = self.known
        got = list(map(known.get, words))
        new = []
        for w in compress(words, [x is None for x in got]):
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        plain = {w: (m[1].lower(), m[2]) for w in new if (m := _LETTERS_END.fullmatch(w))}
        letters = list({x for x, _ in plain.values()}.difference(known))
        other = list({x for _, x in plain.values()}.union(w for w in new if w not in plain).difference(known))
        known.update(zip(letters, self._letters(letters), strict=True))
        known.update(zip(other, self._coded(other), strict=True))
        known.update((w, known[x] + known[end]) for w, (x, end) in plain.items())
        out = [known[w] if x is None else x for x, w in zip(got, words, strict=True)]
        for w in {w for x in (new, letters, other) for w in x if len(w) > _LONG_WORD}:
            del known[w]
        if len(known) > self.cached_words:
            # words that are still met come back from there
            self.older, self.known = known, {"": b""}
        return out

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """ASCII letters in lower case, where that can't make a special token."""
        small = pc.ascii_lower(texts)
        for token in self.added:
            small = pc.if_else(pc.match_substring(small, token), texts, small)
        return small

    def __call__(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts without nulls, each followed by end, and where each text's ids begin (and the end)."""
        if self.by_word:
            codes, begins, words = distinct_words(self._lowered(texts))
            found = self.ids_of(words)
        else:
            codes, begins, found = np.arange(len(texts)), np.arange(len(texts) + 1), self._coded(texts.to_pylist())
        found.append(np.array(end, self.dtype).tobytes())
        codes = np.insert(codes, begins[1:], len(found) - 1)
        lengths = np.array([len(x) for x in found]) // self.dtype.itemsize
        ids, places = gather(np.frombuffer(b"".join(found), self.dtype), lengths, codes)
        return ids, places[begins + np.arange(len(begins))]


def _tokenize(path: str, end_id: int, cached_words: int, block_rows: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hold(f"words {path}", lambda: WordEncoder(path, cached_words))
        number, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, batch.column("text"), block_rows):
                ids, begins = encoder(part.column("text"), [end_id])
                width = encoder.dtype.itemsize
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begins * width).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.full(part.num_rows, number, np.int32)), pa.array(before + begins[:-1]), pa.array(np.diff(begins)), packed], ["row", "part", "before", "tokens", "ids"])
                before += int(begins[-1])

    return tokenize


def _cut(parts: np.ndarray, starts: np.ndarray, window: int):
    """parts: the numbers of the partitions with rows, in order. starts: the tokens before each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = starts[np.searchsorted(parts, batch.column("part").to_numpy())] + batch.column("before").to_numpy()
            source, begins, sizes, pieces, places = [], [], [], [], []
            for i, (at, n, ids) in enumerate(zip(first.tolist(), batch.column("tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                values = np.frombuffer(ids, f"<u{len(ids) // n}")
                begin = 0
                while begin < n:
                    size = min(window - (at + begin) % window, n - begin)
                    source.append(i)
                    begins.append(begin)
                    sizes.append(size)
                    places.append(at + begin)
                    pieces.append(values[begin : begin + size].astype("<u4").tobytes())
                    begin += size
            index = pa.array(source, pa.int64())
            place = np.array(places, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(index), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pieces, pa.binary()), batch.column("tokens").take(index), pa.array(place // window), pa.array(place % window)],
                ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return cut


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), cached_words: int = CACHED_WORDS, block_rows: int = 2000) -> DataFrame:
    """Pieces of sequences of at most window tokens, with only the last sequence not full.

    Gives row (struct of the carried columns), start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset. Each document ends with end_id. A null text counts as
    empty, so it is one piece that holds end_id alone; repeated rows are packed once each; null ids
    and columns of any name are carried as they are; an empty table gives no rows. A very long
    text is coded whole, in a block of its own. cached_words bounds a worker's cache (about 200
    bytes a word, and as much again for the one before) and block_rows what is coded at once:
    fewer take less memory and more time.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    given = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, long = given.schema["row"].dataType, T.LongType()
    fields = [("row", kind), ("part", T.IntegerType()), ("before", long), ("tokens", long), ("ids", T.BinaryType())]
    coded = checkpoint(given.mapInArrow(tidy(_tokenize(tokenizer_path, end_id, cached_words, block_rows), f"words {tokenizer_path}"), T.StructType([T.StructField(*f) for f in fields])))
    # each row carries its partition's number and its place there, so it doesn't matter how the second pass is dealt
    totals = sorted((r["part"], r["total"]) for r in coded.groupBy("part").agg(F.sum("tokens").alias("total")).collect())
    parts = np.array([p for p, _ in totals], np.int32)
    starts = np.cumsum([0, *[n for _, n in totals]])[:-1] if totals else np.zeros(0, np.int64)
    fields = [("row", kind), ("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)]
    return coded.mapInArrow(tidy(_cut(parts, starts, window)), T.StructType([T.StructField(*f) for f in fields]))
