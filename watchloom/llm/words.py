"""Words of texts as integer codes, cut to pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 4 << 20  # text handled at once; one longer text is a piece of its own


def whole(array: pa.Array) -> pa.Array:
    """A copy with buffers of its own that start at its first value.

    Some compute functions read a slice's buffers from the wrong place once the
    slice was cast, so nothing is computed from a slice.
    """
    return pa.concat_arrays([array])


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``limit`` bytes of a text or binary column, copied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(np.asarray(lengths, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            piece = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([whole(x) for x in piece.columns], schema=piece.schema)
            start = stop


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    ``codes`` holds a number into ``vocabulary`` per word, text after text;
    ``starts[i]:starts[i + 1]`` are the words of text i. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(whole(texts), "").cast(pa.large_string())
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        starts = np.asarray(lists.offsets, dtype=np.int64)
        starts = starts - starts[0]
        kept = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)
        if not kept.all():  # white space at either end leaves empty items
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            flat = flat.filter(pa.array(kept))
        coded = pc.dictionary_encode(flat)
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.vocabulary = coded.dictionary
        self.starts = starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owners(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def word_bytes(self) -> list[bytes]:
        return self.vocabulary.cast(pa.large_binary()).to_pylist()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, text after text."""
        table = np.fromiter(
            (xxhash.xxh3_64_intdigest(w) for w in self.word_bytes()), dtype=np.uint64, count=len(self.vocabulary)
        )
        return table[self.codes]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words, also across texts; shorter than ``hashes`` by n - 1."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    factor = 1
    for j in range(n):
        factor = factor * 0x9E3779B97F4A7C15 % 2**64  # odd, so each place counts in a way of its own
        out += hashes[j : j + size] * np.uint64(factor)
    return mix(out)
