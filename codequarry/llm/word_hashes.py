"""The words of many texts as hashes, split and numbered by Arrow."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from codequarry.llm.common import SPACE_CHARS


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give what a task has freed back to the machine: its worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps or gives back by its own rules
        pass


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, one after another, and where each text's words end. Words are in
    lower case (A-Z); null texts are empty."""
    bare = pc.fill_null(texts.cast(pa.large_string()), "")
    for space in SPACE_CHARS[1:]:  # Arrow's own notions of ASCII white space and lower case depend on the locale
        bare = pc.replace_substring(bare, space, " ")
    lists = pc.split_pattern(bare, " ")
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()][1:]
    words = flat.filter(full).dictionary_encode()
    named = np.fromiter((xxhash.xxh64_intdigest(w.encode().lower()) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return named[words.indices.to_numpy()], ends
