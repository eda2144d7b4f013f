"""Removal of bytes in repeated passages, found by merging Burrows-Wheeler transforms of what may repeat.

A window of SIZE bytes has an anchor, the leftmost least hash among its ANCHOR-byte
strings; equal windows have equal anchors at equal places. A context is a run
of windows with one anchor. Contexts whose anchor occurs once can't repeat; of
the others, distinct ones of an anchor meet in a task, where the transforms of
their shards are merged and the intervals of SIZE common bytes read off. Where
an anchor has more contexts than a task may hold, it is lengthened step by
step, to one side or the other, and its contexts part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.bwt import STEP, repeated_windows
from docframe.llm.storage import add_columns, fresh_names, materialize, materialize_counting, small_batches
from docframe.llm.text import mix, prefix_hashes, slices, substring_hashes

ANCHOR = 50
MEMBERS = 1024  # contexts of an anchor that meet in one task
CHUNK = 1 << 18  # bytes of contexts whose transforms are merged together
PART = 1 << 22  # bytes of contexts in a partition


def segments(batch: pa.RecordBatch, size: int, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Slices (rows, place, bytes, offsets); a text over the limit in parts that share size - 1 bytes, place being where the part begins."""
    for rows, data, offsets in slices(batch, limit=limit):
        if len(data) <= limit:
            yield rows, 0, data, offsets
        else:
            for at in range(0, len(data) - size + 1, limit):
                part = data[at : at + limit + size - 1]
                yield rows, at, part, np.array([0, len(part)])


def find_contexts(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, anchor's place in the context, anchor's hash and the context's hash."""
    n_anchors, n_windows = len(data) - ANCHOR + 1, len(data) - size + 1
    if n_windows <= 0:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    prefix = prefix_hashes(data)
    hashes = substring_hashes(prefix, np.arange(n_anchors), np.arange(n_anchors) + ANCHOR)
    places = np.uint64((1 << 21) - 1)
    least, wide, span = (hashes & ~places) | np.arange(n_anchors, dtype=np.uint64), 1, size - ANCHOR + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if span > wide:
        least = np.minimum(least[: wide - span], least[span - wide :])
    anchor = (least & places).astype(np.int64)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(text_of[:n_windows] == text_of[size - 1 :])
    if not len(window):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    anchor, owner = anchor[window], text_of[window]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    n = np.diff(np.append(first, len(window)))
    start, anchor = window[first], anchor[first]
    lead = anchor - start
    context = mix(substring_hashes(prefix, start, start + n + size - 1) ^ mix(lead.astype(np.uint64)))
    return owner[first], start, n, lead, hashes[anchor], context


def occurrences(docs: DataFrame, size: int) -> DataFrame:
    """(key, text_hash, place, n, lead, anchor, context) for each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, at, data, offsets in segments(batch, size):
                owner, start, n, lead, anchor, context = find_contexts(data, offsets, size)
                place, owner = start - offsets[owner] + at, pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key").take(owner), rows.column("text_hash").take(owner), pa.array(place), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))],
                    ["key", "text_hash", "place", "n", "lead", "anchor", "context"],
                )

    return docs.select("key", "text_hash", "text").mapInArrow(run, "key long, text_hash long, place long, n int, lead int, anchor long, context long")


def cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given ranges one after the other, and their offsets."""
    offsets = np.append(0, np.cumsum(lengths))
    return data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


@dataclass
class Contexts:
    """Contexts of anchors (key) that are cut from root contexts (anchor, context) at places (at): n windows, the anchor at lead, and their bytes."""

    key: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    at: np.ndarray
    n: np.ndarray
    lead: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    NUMBERS = ("key", "anchor", "context", "at", "n", "lead")
    FIELDS = "key long, anchor long, context long, at int, n int, lead int, bytes binary"

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Contexts:
        raw = batch.column("bytes")
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(raw) else np.empty(0, np.uint8)
        return cls(*(batch.column(c).to_numpy().astype(np.int64) for c in cls.NUMBERS), data, offsets - offsets[0])

    def numbers(self) -> list[np.ndarray]:
        return [getattr(self, c) for c in self.NUMBERS]

    def part(self, a: int, b: int) -> Contexts:
        return Contexts(*(x[a:b] for x in self.numbers()), self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])

    def distinct(self) -> Contexts:
        """Without rows that repeat the one before: texts that repeat with their ids."""
        again = np.append(False, np.all([x[1:] == x[:-1] for x in self.numbers()], axis=0))
        if not again.any():
            return self
        rows = np.flatnonzero(~again)
        return Contexts(*(x[rows] for x in self.numbers()), *cut(self.data, self.offsets[rows], np.diff(self.offsets)[rows]))

    @staticmethod
    def joined(parts: list[Contexts]) -> Contexts:
        lengths = np.concatenate([np.diff(p.offsets) for p in parts])
        return Contexts(*(np.concatenate(x) for x in zip(*(p.numbers() for p in parts))), np.concatenate([p.data for p in parts]), np.append(0, np.cumsum(lengths)))

    def sides(self, size: int, span: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors of span bytes: half; how many first windows hold half bytes before the anchor (all others hold half after it); hashes of the half before and after, and of all prefixes."""
        half = (size - span + 1) // 2
        left = np.clip(self.lead - half + 1, 0, self.n)
        prefix, middle = prefix_hashes(self.data), self.offsets[:-1] + self.lead
        before = substring_hashes(prefix, np.maximum(middle - half, self.offsets[:-1]), middle)
        after = substring_hashes(prefix, middle + span, np.minimum(middle + span + half, self.offsets[1:]))
        return half, left, before, after, prefix


def wanted_bytes(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (key, text_hash, place, n, lead, anchor, context) as rows of Contexts."""
    lists = wanted.groupBy("key", "text_hash").agg(F.collect_list(F.struct("place", "n", "lead", "anchor", "context")).alias("wanted"))
    texts = docs.select("key", "text_hash", "text").join(lists, ["key", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                lists = rows.column("wanted")
                own, flat = np.repeat(offsets[:-1], lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
                place, n, lead, anchor, context = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "n", "lead", "anchor", "context"))
                for i in range(0, len(n), 2048):
                    part = slice(i, i + 2048)
                    raw = binary(*cut(data, own[part] + place[part], n[part] + size - 1))
                    zero = np.zeros(len(raw), np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[part]), pa.array(anchor[part]), pa.array(context[part]), pa.array(zero), pa.array(n[part].astype(np.int32)), pa.array(lead[part].astype(np.int32)), raw],
                        ["key", "anchor", "context", "at", "n", "lead", "bytes"],
                    )

    return texts.select("text", "wanted").mapInArrow(run, Contexts.FIELDS)


RUNS = "anchor long, context long, runs array<int>"


def merge_contexts(size: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over partitions of Contexts sorted by key: the repeated windows of chunks of whole keys, as begin and end, in turn, of runs in the root contexts.

    The bytes next to the anchor decide first what goes into the transforms:
    windows whose half before or after it no other context of the key has are out.
    """

    def solve(held: Contexts) -> pa.RecordBatch:
        held = held.distinct()
        _, left, before, after, _ = held.sides(size, span)
        own = mix(held.key.astype(np.uint64))
        halves = np.concatenate([mix(before ^ own), mix(after ^ ~own)])
        has = np.concatenate([left > 0, left < held.n])
        _, at, counts = np.unique(np.where(has, halves, np.arange(len(halves), dtype=np.uint64)), return_inverse=True, return_counts=True)
        alive = has & (counts[at] > 1)
        first_alive, last_alive = np.split(alive, 2)
        begin, end = np.where(first_alive, 0, left), np.where(last_alive, held.n, left)
        some = np.flatnonzero(first_alive | last_alive)
        string, place = repeated_windows(*cut(held.data, held.offsets[some] + begin[some], end[some] - begin[some] + size - 1), size)
        of, place = some[string], place + begin[some[string]] + held.at[some[string]]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1))) if len(of) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(of)) - 1 if len(of) else first
        runs, owner = np.stack([place[first], place[ends] + 1], axis=1).astype(np.int32), of[first]
        whose, n_runs = np.unique(owner, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(2 * n_runs)).astype(np.int32)), pa.array(runs.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(held.anchor[whose]), pa.array(held.context[whose]), lists], ["anchor", "context", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, at = Contexts.of(batch), 0
            borders = np.flatnonzero(np.append(True, c.key[1:] != c.key[:-1]))
            if held and held[-1].key[-1] == c.key[0]:
                borders = borders[1:]
            for border in borders.tolist():  # a chunk may end before each
                if total + c.offsets[border] - c.offsets[at] >= CHUNK:
                    yield solve(Contexts.joined([*held, c.part(at, border)]))
                    held, total, at = [], 0, border
            if at < len(c.key):
                held.append(c.part(at, len(c.key)))
                total += int(c.offsets[-1] - c.offsets[at])
        if held:
            yield solve(Contexts.joined(held))

    return run


def parted(size: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts of anchors of span bytes as contexts of the anchors lengthened by half to the left or to the right, with id, a hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Contexts.of(batch)
            half, left, before, after, prefix = c.sides(size, span)
            own = mix(c.key.astype(np.uint64))
            for to_left, rows in ((True, np.flatnonzero(left > 0)), (False, np.flatnonzero(left < c.n))):
                begin = 0 if to_left else left[rows]
                n = left[rows] if to_left else c.n[rows] - left[rows]
                lead = c.lead[rows] - (half if to_left else begin)
                key = mix((before if to_left else ~after)[rows] ^ own[rows])
                start, length = c.offsets[rows] + begin, n + size - 1
                ids = mix(substring_hashes(prefix, start, start + length) ^ mix(lead.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(c.anchor[rows]), pa.array(c.context[rows]), *(pa.array(x.astype(np.int32)) for x in (c.at[rows] + begin, n, lead)), binary(*cut(c.data, start, length)), pa.array(ids.view(np.int64))],
                    ["key", "anchor", "context", "at", "n", "lead", "bytes", "id"],
                )

    return run


def merged(contexts: DataFrame, size: int, span: int, total: int) -> DataFrame:
    """(anchor, context, runs) of Contexts (total bytes in all), the keys dealt to partitions of about PART bytes."""
    dealt = contexts.repartition(total // PART + 1, "key").sortWithinPartitions("key", "context", "at")
    return dealt.select("key", *Contexts.NUMBERS[1:], "bytes").mapInArrow(merge_contexts(size, span), RUNS)


def part_crowded(crowded: DataFrame, size: int) -> list[DataFrame]:
    """(anchor, context, runs) for Contexts whose anchors have over MEMBERS of them.

    A window holds half of its other bytes at least on one side of its anchor.
    Those next to the anchor lengthen it; contexts are parted by them, and into
    windows of either side. What no other context shares goes; equal ones
    repeat whole, and one of them stays; keys of up to MEMBERS are merged in a
    task; the others are lengthened again. After eight times an anchor is the
    whole window.
    """
    out, span = [], ANCHOR
    while span < size:
        half = (size - span + 1) // 2
        sub = materialize(crowded.mapInArrow(parted(size, span), Contexts.FIELDS + ", id long"))
        span += half
        kinds = materialize(sub.groupBy("key", "id").agg(F.count("*").alias("copies"), F.min(F.struct("anchor", "context", "at", "n", "lead", "bytes")).alias("x")))
        again = sub.select("key", "id", "anchor", "context", "at", "n").join(kinds.where("copies > 1").select("key", "id"), ["key", "id"])
        out.append(again.select("anchor", "context", F.array("at", F.col("at") + F.col("n")).alias("runs")))
        members = kinds.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        rows, seen = materialize_counting(kinds.join(members, "key").select("key", "x.*", "members"), light=F.sum(F.when(F.col("members") <= MEMBERS, F.length("bytes"))), heavy=F.count_if(F.col("members") > MEMBERS))
        if seen["light"]:
            out.append(merged(rows.where(F.col("members") <= MEMBERS), size, span, seen["light"]))
        if not seen["heavy"]:
            break
        crowded = rows.where(F.col("members") > MEMBERS).select("key", *Contexts.NUMBERS[1:], "bytes")
    return out


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """(key, text_hash, spans): begin and end, in turn, of byte ranges covered by repeated windows; they may overlap. docs: key, text_hash, text."""
    every = materialize(occurrences(docs, size))
    anchors = materialize(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    found = materialize(every.join(anchors, "anchor", "left_semi"))
    kinds = materialize(found.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key", "text_hash", "place", "n", "lead")).alias("x")))
    several = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1"))
    wanted = kinds.join(several, "anchor").select("anchor", "context", "x.*")
    contexts = wanted_bytes(docs, wanted, size).join(several, "anchor")
    contexts, seen = materialize_counting(contexts, light=F.sum(F.when(F.col("members") <= MEMBERS, F.length("bytes"))), heavy=F.count_if(F.col("members") > MEMBERS))
    parts = [merged(contexts.where(F.col("members") <= MEMBERS), size, ANCHOR, seen["light"])]
    if seen["heavy"]:
        parts += part_crowded(contexts.where(F.col("members") > MEMBERS).drop("members").dropDuplicates(["anchor", "context"]), size)
    # A context with copies repeats as a whole, whatever else was found.
    runs = kinds.where("copies > 1").select("anchor", "context", F.array(F.lit(0), F.col("x.n")).alias("runs")).unionByName(
        reduce(DataFrame.unionByName, parts).join(kinds.where("copies = 1").select("anchor", "context"), ["anchor", "context"])
    )
    spans = F.transform("runs", lambda r, i: F.col("place") + r + F.when(i % 2 == 1, size - 1).otherwise(0))
    return found.join(materialize(runs), ["anchor", "context"]).groupBy("key", "text_hash").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def remove_repeats(docs: DataFrame, size: int = 200, carry: list[str] | None = None) -> DataFrame:
    """docs (of it, the columns in carry) with n_bytes, n_removed, n_spans, kept: the bytes of text that no repeated size-byte string covers.

    Every string of size bytes (a multiple of STEP, over ANCHOR) that begins at
    two places at least, in one text or two, is removed wherever it stands;
    overlaps count and all is judged on the input. kept is binary: removal may
    cut a character. Null texts are empty and short ones stay whole. Rows that
    repeat are copies of each other. Columns of these names are replaced, all
    others stay. Contexts are told apart by two 64-bit hashes (anchor and
    whole), windows within a task byte by byte.
    """
    if size % STEP or size <= ANCHOR:
        raise ValueError(f"size must be a multiple of {STEP} over {ANCHOR}")
    small_batches(docs.sparkSession)
    key, text_hash, own_spans = fresh_names(docs, "key", "hash", "spans")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), text_hash: F.xxhash64("doc_id", "text")})
    texts = keyed.select(F.col(key).alias("key"), F.col(text_hash).alias("text_hash"), "text").where("text is not null")
    spans = repeated_spans(texts, size).withColumnsRenamed({"key": key, "text_hash": text_hash, "spans": own_spans})
    names = [c for c in docs.columns if carry is None or c in carry]
    joined = keyed.select(*{*names, "text", key, text_hash}).join(spans, [key, text_hash], "left")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text, own in zip(batch.column("text"), batch.column(own_spans)):
            raw = (text.as_py() or "").encode()
            spans = np.array(own.as_py() or [], dtype=np.int64).reshape(-1, 2)
            kept, done, n = [], 0, 0
            for a, b in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
                if a > done or not n:
                    kept.append(raw[done:a])
                    n += 1
                done = max(done, b)
            kept = b"".join([*kept, raw[done:]])
            yield len(raw), len(raw) - len(kept), n, kept

    return add_columns(joined, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", rows, [*names, own_spans]).drop(own_spans)
