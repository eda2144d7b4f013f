"""Burrows-Wheeler transforms of sets of strings, merged by iterative interleave refinement.

The alphabet is that of all strings of STEP bytes, numbered in the order of
their hashes and compared byte by byte. The transform holds, for each suffix in
sorted order, the symbol before it, and one turn of the refinement lengthens
the sorted prefix by one symbol. A string's last symbol is filled up with zero
bytes, and the string ends in STEP empty suffixes, one for each of its phases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from docframe.llm.text import prefix_hashes, substring_hashes

STEP = 50
START = -1
COMPARED = 1 << 15  # symbols whose bytes are compared at once


@dataclass
class Shard:
    """A shard's transform, and which string and place each of its suffixes has; empty suffixes come first."""

    symbols: np.ndarray  # the number of the symbol before the suffix, START where fewer bytes than STEP are before
    string: np.ndarray
    place: np.ndarray


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of whole numbers under 2^32 by two radix passes."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def symbol_numbers(text: np.ndarray) -> np.ndarray:
    """A number for the STEP bytes at each place, equal where and only where the bytes are."""
    begin = np.arange(len(text) - STEP + 1)
    _, first, numbers = np.unique(substring_hashes(prefix_hashes(text), begin, begin + STEP), return_index=True, return_inverse=True)
    seen = np.lib.stride_tricks.sliding_window_view(text, STEP)
    for at in range(0, len(begin), COMPARED):
        if not np.array_equal(seen[at : at + COMPARED], seen[first[numbers[at : at + COMPARED]]]):  # a collision of hashes
            return np.unique(np.ascontiguousarray(seen).view(f"V{STEP}").ravel(), return_inverse=True)[1]
    return numbers


def transforms(data: np.ndarray, offsets: np.ndarray, n_shards: int, depth: int) -> list[Shard]:
    """Every n_shards-th string in a shard of its own, by radix sorts of the suffixes' first depth bytes. Symbols are numbered for all."""
    lengths = np.diff(offsets)
    base = offsets[:-1] + np.arange(len(lengths)) * 2 * STEP
    text = np.zeros(int(offsets[-1]) + len(lengths) * 2 * STEP, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(base - offsets[:-1], lengths)] = data
    numbers = symbol_numbers(text)
    out = []
    for i in range(min(n_shards, len(lengths))):
        own = np.arange(i, len(lengths), n_shards)
        string = np.repeat(own, lengths[own])
        place = np.arange(len(string)) - np.repeat(np.cumsum(lengths[own]) - lengths[own], lengths[own])
        at, left = base[string] + place, lengths[string] - place
        order = np.arange(len(string))
        for k in range(depth - STEP, -1, -STEP):
            symbol = np.where(k < left, numbers[np.minimum(at + k, len(numbers) - 1)] + 1, 0)
            order = order[stable_order(symbol[order])]
        # The empty suffixes, in the order of their strings.
        string = np.append(np.repeat(own, STEP), string[order])
        place = np.append((lengths[own][:, None] + np.arange(STEP)).ravel(), place[order])
        out.append(Shard(np.where(place < STEP, START, numbers[np.maximum(base[string] + place - STEP, 0)]), string, place))
    return out


def merge(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard's suffixes the number of the block of suffixes, over all shards, with the same first depth bytes (a multiple of STEP).

    The interleave says which shard the next suffix comes from. It begins with
    shard after shard; each turn deals the suffixes in its order to the symbols
    before them, which sorts by one symbol more. A border between two blocks is
    where the symbol changes or a border was: its turn is the common prefix of
    its neighbours in symbols. No suffix is compared with another.
    """
    symbols = np.concatenate([s.symbols for s in shards])
    sizes = [len(s.symbols) for s in shards]
    kind = np.uint8 if len(shards) < 256 else np.uint16
    empty = np.concatenate([np.full(int((s.symbols == START).sum()), i, dtype=kind) for i, s in enumerate(shards)])  # as many as have no symbol before
    interleave = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    block = np.zeros(len(interleave), dtype=np.int64)
    for _ in range(depth // STEP):
        slots = np.argsort(interleave, kind="stable")  # a shard's suffixes keep their order
        before = np.empty(len(interleave), dtype=np.int64)
        before[slots] = symbols
        some = before != START
        symbol = before[some]
        order = stable_order(symbol)
        symbol, source, held = symbol[order], interleave[some][order], block[some][order]
        border = np.append(True, (symbol[1:] != symbol[:-1]) | (held[1:] != held[:-1]))
        interleave = np.append(empty, source)
        block = np.append(np.zeros(len(empty), np.int64), np.cumsum(border))
    return np.split(block[np.argsort(interleave, kind="stable")], np.cumsum(sizes)[:-1])


def repeated_windows(data: np.ndarray, offsets: np.ndarray, size: int, n_shards: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(string, place), sorted, of the size-byte windows of the strings that begin at two places at least in all of them."""
    if len(offsets) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shards = transforms(data, offsets, n_shards, size)
    lengths = np.diff(offsets)
    string, place, block = (np.concatenate(x) for x in ([s.string for s in shards], [s.place for s in shards], merge(shards, size)))
    whole = place + size <= lengths[string]
    string, place, block = string[whole], place[whole], block[whole]
    again = np.bincount(block, minlength=1)[block] > 1
    order = np.lexsort((place[again], string[again]))
    return string[again][order], place[again][order]
