"""Vectorised work on the bytes of Arrow string columns.

A text column arrives as one UTF-8 buffer and offsets. It is cut into slices of
whole texts of about SLICE bytes, so that the arrays of a slice stay small
however many rows Arrow puts in a batch; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
SEGMENT = 1 << 20  # bytes of a long text that are hashed together
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+ by their bytes.
BY_SPACE = np.ones(256, dtype=bool)
BY_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text by their bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones((2, 1), dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows; a null text has no bytes."""
    texts = batch.column(column)
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes of this kind; none crosses two texts."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = kind[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Row 0: BASE^i, row 1: BASE^-i modulo 2^64, for i up to n."""
    global _powers
    if _powers.shape[1] <= n:
        size = max(n + 1, SLICE + 1)
        table = np.ones((2, size), dtype=np.uint64)
        table[0, 1:], table[1, 1:] = BASE, pow(BASE, -1, 1 << 64)
        _powers = np.multiply.accumulate(table, axis=1)
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial sums over the first i bytes, for substring_hashes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0, : len(data)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from starts to ends."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix) - 1)[1][starts]
    return mix(raw + (ends - starts).astype(np.uint64))



def hashed_words(low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text numbers and hashes of the words of this kind.

    A text longer than SEGMENT is hashed in segments that end between words, so
    that beside its bytes only what is kept of its words grows with it.
    """
    if len(low) <= SEGMENT:
        starts, ends, text_of = word_spans(low, offsets, kind)
        return starts, ends, text_of, substring_hashes(prefix_hashes(low), starts, ends)
    parts, at = [], 0
    while at < len(low):
        end = min(at + SEGMENT, len(low))
        while end < len(low) and kind[low[end - 1]]:  # to the end of the word
            step = np.flatnonzero(~kind[low[end : end + SEGMENT]])
            end = end + int(step[0]) + 1 if len(step) else min(end + SEGMENT, len(low))
        a, b = np.searchsorted(offsets, [at, end], side="right") - 1
        inner = np.clip(offsets[a : b + 2], at, end) - at
        starts, ends, text_of = word_spans(low[at:end], inner, kind)
        parts.append((starts + at, ends + at, text_of + a, substring_hashes(prefix_hashes(low[at:end]), starts, ends)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))
