"""Words of UTF-8 texts as 64-bit hashes, whole Arrow batches at a time.

A word's hash depends on its bytes alone (ASCII letters lower-cased), never on the batch or the machine. Texts are
worked through in slices of a quarter of a megabyte, cut between words, so memory follows the slice and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
BATCH_BYTES = 2 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of the public splitmix64 generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return _mix(lower * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


_BASE = 0xD1342543DE82EF95
_VALUES = _byte_values()
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept at the usual length, made anew for a longer word."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    with np.errstate(over="ignore"):
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
            step[0] = 1
            tables.append(np.cumprod(step))
    if n <= 2 * SLICE_BYTES:
        _powers["up"], _powers["down"] = tables
    return tables[0], tables[1]


def byte_class(separators: str) -> np.ndarray:
    """Which bytes belong to words: all but the named ASCII characters. Bytes from 128 up always do."""
    inside = np.ones(256, dtype=bool)
    inside[[ord(c) for c in separators]] = False
    return inside


#: Words between white space: [^\x20\x09-\x0D]+
SPACED = byte_class("\t\n\v\f\r ")
#: Words of letters, digits and whatever is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, prefix: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, or of its first `prefix` bytes, and number of words per text.

    data: all bytes; offsets: where each text begins, and the end.
    """
    n = len(data)
    texts = len(offsets) - 1
    if not n:
        return np.empty(0, np.uint64), np.zeros(texts, np.int64)
    mask = inside[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = mask[heads]
    stops = mask
    stops[:-1] &= ~mask[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
            high = ends[to - 1]
            up, down = _power_tables(int(high - low) + 1)
            sums = np.empty(high - low + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_VALUES[data[low:high]] * up[: high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            if prefix:
                e = np.minimum(e, s + prefix)
            hashes[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
        return _mix(hashes), counts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(marks) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[marks[0] : marks[-1]], marks - marks[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of several hashes in order."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), dtype=np.uint64)
        for p in parts:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
        return h


def text_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, 0 for a text without any."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def previous(words: np.ndarray, counts: np.ndarray, back: int) -> np.ndarray:
    """The word `back` places earlier in the same text, else 0."""
    before = np.zeros_like(words)
    before[back:] = words[:-back] if back < len(words) else words[:0]
    starts = np.cumsum(counts) - counts
    for k in range(back):
        before[(starts + k)[counts > k]] = 0
    return before
