"""Benchmark decontamination: a broadcast hash set of test n-grams, token windows scanned and verified, spans removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.storage import add_columns, fresh_names, materialize, materialize_counting, small_batches
from docframe.llm.text import ALNUM, BASE, LOWER, hashed_words, slices, word_spans

FIELD = "contamination struct<n_words:bigint,runs:array<struct<start:bigint,end:bigint>>,items:array<string>>"
CUT = "__cut_text string"
WINDOW = "item_id string, window binary, h long"
BITS = 26  # 2^BITS bits say which windows' hashes may occur, where their words can't be broadcast


def chain(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One hash for the n word hashes from each place on."""
    h = np.full(len(at), n, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(BASE) + hashes[at + i]
    return h


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(item_id as string, window, h, its hash): each item's runs of size words, an item of fewer words whole; words are parted by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                low = LOWER[data]
                starts, ends, text_of, hashes = hashed_words(low, offsets, ALNUM)
                raw, ids = low.tobytes(), rows.column("item_id").to_pylist()
                bounds = np.searchsorted(text_of, np.arange(len(offsets)))
                for item, a, b in zip(ids, bounds.tolist(), bounds[1:].tolist()):
                    n = min(size, b - a)
                    if n:
                        words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                        found = [b" ".join(words[i : i + n]) for i in range(b - a - n + 1)]
                        h = chain(hashes, np.arange(a, b - n + 1), n).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(h)], ["item_id", "window", "h"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, WINDOW).distinct()


class WindowSet:
    """Windows by length and hash, with the words and the items of each."""

    def __init__(self, rows):
        by_window: dict[bytes, list[str]] = {}
        for r in rows:
            own = by_window.setdefault(bytes(r["window"]), [])
            if r["item_id"] is not None:
                own.append(r["item_id"])
        vocabulary, by_length = [np.empty(0, np.uint64)], {}
        for window, items in by_window.items():
            data = np.frombuffer(window, dtype=np.uint8)
            hashes = hashed_words(data, np.array([0, len(data)]), ALNUM)[3]
            vocabulary.append(hashes)
            by_length.setdefault(len(hashes), []).append((int(chain(hashes, np.zeros(1, np.int64), len(hashes))[0]), window, items))
        self.vocabulary = np.unique(np.concatenate(vocabulary))
        self.may = np.zeros(1 << 20, dtype=bool)
        self.may[self.vocabulary >> np.uint64(44)] = True
        self.by_length = {}
        for n, own in by_length.items():
            own.sort(key=lambda x: x[0])
            self.by_length[n] = (np.array([x[0] for x in own], dtype=np.uint64), [x[1:] for x in own])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which words occur in a window."""
        out = self.may[hashes >> np.uint64(44)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        out[at] = self.vocabulary[place] == hashes[at]
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, list[str]]]]:
        """Numbers of the slice's words' texts; which words are hit; (text, place, items) of each verified window."""
        low = LOWER[data]
        starts, ends, text_of, hashes = hashed_words(low, offsets, ALNUM)
        found: list[tuple[int, int, list[str]]] = []
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        if len(starts) and self.by_length:
            unknown = np.append(0, np.cumsum(~self.known(hashes)))
            for n, (keys, values) in self.by_length.items():
                if len(starts) < n:
                    continue
                at = np.flatnonzero((unknown[n:] == unknown[:-n]) & (text_of[n - 1 :] == text_of[: len(text_of) - n + 1]))
                h = chain(hashes, at, n)
                low_at, high_at = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
                for i, a, b in zip(*(x[high_at > low_at].tolist() for x in (at, low_at, high_at))):
                    words = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + n], ends[i : i + n]))
                    for window, items in values[a:b]:
                        if window == words:
                            found.append((int(text_of[i]), i, items))
                            cover[i] += 1
                            cover[i + n] -= 1
        return text_of, np.cumsum(cover[:-1]) > 0, found


def candidates(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(text_id, windows): of each distinct text of docs (text_id, text), the windows whose hash one of its own has.

    For windows that can't be broadcast: a text's windows are hashed, those
    whose bit is set in a bitmap of fixed size meet the benchmark's in a join.
    """
    spark = docs.sparkSession
    word, bit = F.shiftrightunsigned("h", 64 - BITS + 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))")
    set_bits = found.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^(BITS - 6) rows at most
    bits = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    bits[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                _, _, text_of, hashes = hashed_words(LOWER[data], offsets, ALNUM)
                for n in range(1, size + 1):
                    at = np.flatnonzero(text_of[n - 1 :] == text_of[: max(0, len(text_of) - n + 1)]) if len(text_of) >= n else np.empty(0, np.int64)
                    h = chain(hashes, at, n)
                    may = shared.value[h >> np.uint64(64 - BITS + 6)] >> ((h >> np.uint64(64 - BITS)) & np.uint64(63)) & np.uint64(1) == 1
                    if may.any():
                        yield pa.RecordBatch.from_arrays([rows.column("text_id").take(pa.array(text_of[at[may]])), pa.array(h[may].view(np.int64))], ["text_id", "h"])

    own = docs.where("text is not null").select("text_id", "text").mapInArrow(hashed, "text_id string, h long").distinct()
    return own.join(found, "h").groupBy("text_id").agg(F.collect_list(F.struct("item_id", "window")).alias("windows"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_windows: int = 400_000, carry: list[str] | None = None, cut: bool = False) -> DataFrame:
    """docs (of it, the columns in carry) with contamination: n_words, runs of hit words (places from 0, end exclusive), items with a window in the text.

    benchmark has item_id and text; its windows are counted, and up to
    max_windows are broadcast and found in one scan. More of them are joined to
    the texts' windows by hash, and what meets is found in the texts by the
    same scan: hits are verified on the words either way. An item with a null
    item_id hits words without being listed; a null, empty or wordless item has
    no window. A null text has no words; a very long one is hashed in segments.
    Rows that repeat stay, each with its own result; of repeated items each is
    listed once. A column contamination of docs is replaced, others stay. Empty
    docs or an empty benchmark are no error. With cut there is also __cut_text,
    the text without the runs (see without_runs).
    """
    spark = docs.sparkSession
    small_batches(spark)
    found, seen = materialize_counting(windows(benchmark, size), n=F.count("*"))
    given, broadcast = docs.drop("contamination"), seen["n"] <= max_windows
    names, (own,) = given.columns, fresh_names(docs, "windows")
    if broadcast:
        shared = spark.sparkContext.broadcast(WindowSet(found.select("item_id", "window").collect()))
    else:
        keyed = given.withColumn(own, F.sha2("text", 256))
        met = materialize(candidates(keyed.select(F.col(own).alias("text_id"), "text"), found, size)).withColumnsRenamed({"text_id": own, "windows": own + "_list"})
        given = keyed.join(met, own, "left").drop(own).withColumnRenamed(own + "_list", own)

    def results(data: np.ndarray, offsets: np.ndarray, known: WindowSet) -> Iterator[dict]:
        text_of, hit, windows_found = known.hits(data, offsets)
        bounds = np.searchsorted(text_of, np.arange(len(offsets)))
        items: dict[int, set[str]] = {}
        for text, _, its in windows_found:
            items.setdefault(text, set()).update(its)
        touched = np.zeros(len(offsets) - 1, dtype=bool)
        touched[text_of[hit]] = True
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            runs = []
            if touched[i]:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).astype(np.int8)))
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
            yield {"n_words": b - a, "runs": runs, "items": sorted(items.get(i, ()))}

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for texts, data, offsets in slices(batch):
            if broadcast:
                made = results(data, offsets, shared.value)
            else:
                lists = texts.column(own).to_pylist()
                made = (x for a, b, its in zip(offsets.tolist(), offsets[1:].tolist(), lists) for x in results(data[a:b], np.array([0, b - a]), WindowSet(its or [])))
            for i, result in enumerate(made):
                if cut:
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    yield result, None if texts.column("text")[i].as_py() is None else (without_runs(raw, result["runs"]) if result["runs"] else raw).decode()
                else:
                    yield (result,)

    kept = [c for c in names if carry is None or c in carry]
    return add_columns(given, f"{FIELD}, {CUT}" if cut else FIELD, rows, kept + ([] if broadcast else [own])).drop(own)


def without_runs(raw: bytes, runs: list[dict]) -> bytes:
    """The text without the words of the runs; each run, with what stands between its words, leaves one space."""
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _ = word_spans(LOWER[data], np.array([0, len(data)]), ALNUM)
    parts, done = [], 0
    for r in runs:
        parts.append(raw[done : starts[r["start"]]])
        done = ends[r["end"] - 1]
    return b" ".join([*parts, raw[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_share: float = 1.0, max_windows: int = 400_000) -> DataFrame:
    """docs without the words hit, and without the documents of which max_share or more is hit (by default: all words).

    Null, empty and wordless texts, and all texts without a hit, stay as they
    are. Rows that repeat are cut alike. All columns stay, whatever their names.
    """
    (own,) = fresh_names(docs, "contamination")
    found = find_contamination(docs.withColumnRenamed("contamination", own), benchmark, size, max_windows, cut=True)
    n_hit = F.aggregate("contamination.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    kept = found.where((n_hit == 0) | (n_hit < F.lit(max_share) * F.col("contamination.n_words")))
    named = {"text": "__cut_text", "contamination": own}
    return kept.select(*[F.col(f"`{named.get(c, c)}`").alias(c) for c in docs.columns])
