"""Words of many texts at once, each distinct word once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For texts without nulls: the code of each word, in order; where each text's words begin (and the end); the words by code.

    Words stand between runs of [\\x20\\x09-\\x0D]; the empty word may stand at a text's ends.
    """
    lists = pc.ascii_split_whitespace(texts)
    begins = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), begins - begins[0], coded.dictionary.to_pylist()


def gather(pool: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool has one run of the given length for each code: the runs of all codes, joined, and where each begins (and the end)."""
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[codes]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return pool[np.repeat(starts[codes] - begins[:-1], sizes) + np.arange(begins[-1])], begins
