"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A leaf holds the rank of the pair that starts at its position (lower merges first) together with
the position, an inner node the smallest of its leaves. So the root is the leftmost pair of the
lowest rank; each merge changes three leaves, which takes logarithmic time each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hold, slices, tidy

#: The published pattern of this kind of vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62
#: Bits of a position in a leaf; ranks take the ones above.
_AT = 40
#: Pieces kept with their ids in a worker; beyond it the cache starts anew, which costs time only.
CACHED_PIECES = 600_000
_LONG_PIECE = 64
#: Words of at most so many bytes are merged together, so many at a time.
_WIDEST, _ROWS = 64, 16_384
_AFTER_BLANK = re.compile(r"\s ")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class ByteBpe:
    """Encodes and decodes with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocab, letters = given["model"]["vocab"], byte_letters()
        self.first = [vocab[c] for c in letters]
        self.merged: list[int] = []
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(given["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.pair_keys = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], np.int64)
        self.merged_array = np.array(self.merged, np.int64)
        self.first_array = np.array(self.first, np.int64)
        self.known: dict[str, bytes] = {}
        self.forget()

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one word."""
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.ranks.get, self.merged
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << _AT | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        def pair(i: int, j: int) -> int:
            rank = rank_of(ids[i] << 32 | ids[j])
            return _NONE if rank is None else rank << _AT | i

        while (low := tree[1]) != _NONE:
            i = low & ((1 << _AT) - 1)
            gone = after[i]
            ids[i] = merged[low >> _AT]
            right = after[i] = after[gone]
            if gone < n - 1:
                put(gone, _NONE)
            if right < n:
                before[right] = i
                put(i, pair(i, right))
            elif i < size:
                put(i, _NONE)
            left = before[i]
            if left >= 0:
                put(left, pair(left, i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """All merges of many words, packed as 32-bit ids: the same trees as in merge, one row for each word."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) > _WIDEST:
                out[at] = np.array(self.merge([self.first[b] for b in word]), "<u4").tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(at)
        for width, places in by_width.items():
            for at in range(0, len(places), _ROWS):
                part = places[at : at + _ROWS]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those that don't merge, or have no right side (-1), get _NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], _NONE >> _AT)

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width)[None, :] < length[:, None], self.first_array[raw], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        places = np.arange(width)
        tree = np.empty((n, 2 * width), np.int64)
        tree[:, width:] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width) << _AT | places
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        rows = np.arange(n)
        while True:
            low = tree[rows, 1]
            going = low < _NONE
            rows, low = rows[going], low[going]
            if not len(rows):
                break
            i = low & ((1 << _AT) - 1)
            gone = after[rows, i]
            right = after[rows, gone]
            left = before[rows, i]
            made = self.merged_array[low >> _AT]
            ids[rows, i] = made
            after[rows, i] = right
            before[rows, np.minimum(right, width)] = i
            tree[rows, width + gone] = _NONE
            tree[rows, width + i] = self._rank(made, ids[rows, np.minimum(right, width)]) << _AT | i
            has = left >= 0
            tree[rows[has], width + left[has]] = self._rank(ids[rows[has], left[has]], made[has]) << _AT | left[has]
            for leaf in (gone, i, np.where(has, left, i)):
                node = width + leaf
                for _ in range(width.bit_length() - 1):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        out, alive = [], np.zeros((n, width + 2), bool)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            alive[rows, at] = True
            at = after[rows, at]
            rows, at = rows[at < length[rows]], at[at < length[rows]]
        flat = ids[:, :width][alive[:, :width]].astype("<u4").tobytes()
        ends = np.cumsum(alive[:, :width].sum(axis=1)) * 4
        begin = 0
        for end in ends.tolist():
            out.append(flat[begin:end])
            begin = end
        return out

    def _pieces(self, text: str) -> list[str]:
        """Text cut where no token can reach over: at special tokens, and before a blank that follows something else."""
        if self.special_split is not None and any(x in text for x in self.special):
            return [y for x in self.special_split.split(text) if x for y in ([x] if x in self.special else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] == " " or _AFTER_BLANK.search(text):
            return _BEFORE_BLANK.split(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special tokens written in it become their ids."""
        known = self.known
        split = [self._pieces(x) for x in texts]
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        new.difference_update(known)
        parts = {x: self.pattern.findall(x) for x in new}
        words = list({w for x in parts.values() for w in x}.difference(known))
        known.update(zip(words, self.merge_many([w.encode() for w in words]), strict=True))
        known.update((x, b"".join(map(known.__getitem__, w))) for x, w in parts.items() if len(w) != 1)
        out = [np.frombuffer(b"".join(map(known.__getitem__, x)), "<u4") for x in split]
        for x in {x for y in (new, words) for x in y if len(x) > _LONG_PIECE}:
            del known[x]
        if len(known) > CACHED_PIECES:
            self.forget()
        return out

    def forget(self) -> None:
        self.known.clear()
        self.known.update((x, np.array([i], "<u4").tobytes()) for x, i in self.special.items())

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of ids; bytes that are no UTF-8 are replaced as a decoder does."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = hold(f"bytes {path}", lambda: ByteBpe(path))
        for batch in batches:
            for part in slices(batch, batch.column("text"), 500):
                ids = bpe.encode_many(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.array([], "<u4")]).astype(np.int32)))
                texts = pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), lists, texts], ["row", "ids", "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs: row (struct of the carried columns), ids (array of int), decoded (the text they give).

    A null text counts as empty and has no ids; repeated rows are coded once each; null ids and
    columns of any name are carried as they are; an empty table gives no rows. Very long texts are
    coded whole, each in a block of its own.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    given = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [("row", given.schema["row"].dataType), ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return given.mapInArrow(tidy(_round_trip(tokenizer_path), f"bytes {tokenizer_path}"), T.StructType([T.StructField(*f) for f in fields]))
