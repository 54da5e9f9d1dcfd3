"""Words of whole columns of text at once, as codes into the different words of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text goes alone.
TOGETHER = 4 << 20


def chunks(batch: pa.RecordBatch, column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of the text column each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of each text's words, the words' codes, the different words by code). Words are runs of anything but ASCII white space; \"\" may be one of the different ones."""
    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy()
    found = words.flatten().dictionary_encode()
    return offsets - offsets[0], found.indices.to_numpy(), found.dictionary


_coefficients = np.zeros((2, 0), np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half the output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, unsigned: two multilinear sums of its bytes with a coefficient for each place, mixed."""
    global _coefficients
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    size = np.diff(offsets)
    if size.max(initial=0) > _coefficients.shape[1]:
        place = np.arange(2 * max(256, int(size.max())), dtype=np.uint64)
        _coefficients = np.stack([_mixed((place + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1) for k in (1, 1 << 40)])
    full = np.flatnonzero(size)
    starts = offsets[:-1][full] - offsets[0]
    place = np.arange(len(data)) - np.repeat(starts, size[full])
    sums = np.zeros((2, len(words)), np.uint64)
    for k in (0, 1):
        if len(full):
            sums[k, full] = np.add.reduceat(data * _coefficients[k][place], starts)
    return _mixed(sums[0] + _mixed(sums[1] + size.astype(np.uint64)))
