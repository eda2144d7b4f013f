"""Two tokenizers aligned by the bytes that their tokens share, and how many documents have each pair of ids linked.

A text is cut into units that neither tokenizer's tokens cross (a run of white
space and what follows up to the next). What is known of a unit follows from
the unit alone, so that each distinct one is encoded once in a worker and a
text costs a lookup a unit. Where the vocabularies allow no such cuts, whole
texts are the units.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.storage import add_columns, fresh_names, materialize, materialize_counting, shared_folder, small_batches
from docframe.llm.text import slices

#: A unit: white space, what follows it, and on over white space other than spaces and line ends.
UNIT = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
STRETCH = 1 << 17  # units that are handled together
CACHED, CACHED_CHARS = 300_000, 1 << 25  # units and characters that a worker keeps between stretches
HELD = 1 << 21  # pairs that a task sums at once
WIDE = 4096  # links of a group above which its distinct ids are paired
ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
COUNTED = "n_best bigint, count_sum bigint"


def joined(ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> bytes:
    """The bytes of these tokens, one after the other; starts of each token's bytes in flat, and the end."""
    lengths = starts[ids + 1] - starts[ids]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts[ids] - before, lengths) + np.arange(lengths.sum())].tobytes()


class Vocabulary:
    """The tokens' bytes of a tokenizer."""

    def _hold(self, tokens: list[bytes]) -> None:
        self.size = len(tokens)
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.starts = np.append(0, np.cumsum([len(t) for t in tokens]))
        self.lengths = np.diff(self.starts)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return joined(ids, self.flat, self.starts)


class ByteLevel(Vocabulary):
    """A byte-level BPE by the JSON of the library tokenizers."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data.decode())
        self.model.no_padding()
        self.model.no_truncation()
        self.model.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes whose character is their own; the others have those from 256 on
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = {i: name for name, i in self.model.get_vocab(with_added_tokens=True).items()}
        name = lambda i: names.get(i, "")
        self._hold([bytes(byte_of[c] for c in name(i)) if all(c in byte_of for c in name(i)) else name(i).encode() for i in range(max(names) + 1)])
        spec = json.loads(data)
        before = spec.get("pre_tokenizer") or {}
        self.by_units = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and all(t["special"] for t in spec.get("added_tokens", []))

    def encode(self, stretch: str, cut: bool) -> np.ndarray:
        return np.array(self.model.encode(stretch, add_special_tokens=False).ids, dtype=np.int64)


class Pieces(Vocabulary):
    """A model of the library sentencepiece."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self._hold([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        crossing = any("\n" in p or "▁" in p.lstrip("▁") for p in names)
        begin = np.array(self.model.encode("\n"), dtype=np.int64)
        self.by_units = not crossing and len(begin) == 2 and self.bytes_of(begin) == b" \n" and "".join(self.model.encode(" a  b ", out_type=str)) == "▁▁a▁▁b▁"

    def encode(self, stretch: str, cut: bool) -> np.ndarray:
        """The ids of a stretch that begins with a space, which the model adds by itself, or, if cut, at any unit: then after a line end, whose ids are dropped."""
        return np.array(self.model.encode("\n" + stretch)[2:] if cut else self.model.encode(stretch[1:]), dtype=np.int64)


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype=np.int64):
        self.room, self.size = np.empty(1024, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.empty(end, self.room.dtype)])
        self.room[self.size : end], self.size = more, end

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


@dataclass
class Measured:
    """Of some units, each with good encodings: numbers (n_a, n_b, n_groups, n_links) as rows, the ids shown, and the pairs of one unit after the other with their links."""

    numbers: np.ndarray
    shown: list[str]
    sizes: np.ndarray
    keys: np.ndarray
    links: np.ndarray


class Units:
    """What a worker knows of the units that it has met; cleared when they are too many."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.bits = (self.b.size - 1).bit_length()
        if (self.a.size - 1).bit_length() + self.bits > 63 - STRETCH.bit_length():
            raise ValueError("a pair of ids, and the number of a text or unit, must fit into 63 bits")
        self.key_bits = (self.a.size - 1).bit_length() + self.bits
        self.cut = self.a.by_units and self.b.by_units
        name = lambda size, sep: np.array([f"{i}{sep}" for i in range(size)], dtype=object)
        self.names = [name(self.a.size, ","), name(self.a.size, "|"), name(self.b.size, ","), name(self.b.size, ";")]
        self.turn = 0
        self.clear()

    def clear(self) -> None:
        self.turn += 1
        self.place: dict[str, int] = {}
        self.chars = 0
        self.shown: list[str] = []
        self.good, self.numbers = Growing(bool), [Growing() for _ in range(4)]
        self.ends, self.keys, self.links = Growing(), Growing(), Growing()

    def split(self, text: str) -> Iterator[list[str]]:
        """The units of a space and the text, some at a time."""
        whole = " " + text
        if not self.cut:
            yield [whole]
        elif len(whole) <= STRETCH:
            yield UNIT.findall(whole)
        else:
            found = (m[0] for m in UNIT.finditer(whole))
            while part := list(islice(found, STRETCH)):
                yield part

    def stretches(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int], list[str]]]:
        """(numbers of texts, how many units of each, the units), each of about STRETCH units; a long text goes on in the next. Null and empty texts have none."""
        owners, counts, units = [], [], []
        for number, text in enumerate(texts):
            for part in self.split(text) if text else ():
                owners.append(number)
                counts.append(len(part))
                units += part
                if len(units) >= STRETCH:
                    yield np.array(owners), counts, units
                    owners, counts, units = [], [], []
        if units:
            yield np.array(owners), counts, units

    def places(self, units: list[str]) -> np.ndarray:
        """The places of the units, after those that are new have been measured."""
        if len(self.place) > CACHED or self.chars > CACHED_CHARS:
            self.clear()
        new = list(set(units) - self.place.keys())
        odd = [u for u in new if "▁" in u]  # pieces can't tell it from a space
        plain = [u for u in new if "▁" not in u] if odd else new
        step = 4096 if self.cut else 1
        for i in range(0, len(plain), step):
            self._add(plain[i : i + step])
        for u in odd:
            self._add([u])
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def _add(self, units: list[str]) -> None:
        found = self._measure(units)
        if found is None and len(units) > 1:
            for u in units:
                self._add([u])
            return
        for u in units:
            self.place[u] = len(self.place)
            self.chars += len(u)
        if found is None:
            found = Measured(np.zeros((4, 1), np.int64), [""], np.zeros(1, np.int64), *[np.empty(0, np.int64)] * 2)
            self.good.extend(np.zeros(1, bool))
        else:
            self.good.extend(np.ones(len(units), bool))
        for column, more in zip(self.numbers, found.numbers):
            column.extend(more)
        self.shown += found.shown
        self.ends.extend(self.keys.size + np.cumsum(found.sizes))
        self.keys.extend(found.keys)
        self.links.extend(found.links)

    def _measure(self, units: list[str]) -> Measured | None:
        """None where the bytes of either tokenizer's tokens aren't the units' own, or tokens cross units."""
        stretch = "".join(units)
        raw, ends = stretch.encode(), np.cumsum([len(u.encode()) for u in units])
        a, b = self.a.encode(stretch, self.cut), self.b.encode(stretch, self.cut)
        if self.a.bytes_of(a) != raw or self.b.bytes_of(b) != raw:
            return None
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        shared = np.intersect1d(a_ends, b_ends)
        unit_of = np.searchsorted(ends, shared)  # of each group
        if len(np.setdiff1d(ends, shared)):
            return None
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        of_unit = lambda values: np.bincount(unit_of, weights=values, minlength=len(units)).astype(np.int64)
        numbers = np.array([of_unit(n_a), of_unit(n_b), of_unit(np.ones(len(shared))), of_unit(n_a * n_b)])
        keys, links, own = self._pairs(a, b, n_a, n_b, first_a, first_b, a_group, unit_of)

        said = np.empty(len(a) + len(b), dtype=object)  # a group's ids of A, then those of B
        last_a, last_b = np.append(np.diff(a_group) > 0, True), np.append(np.diff(b_group) > 0, True)
        said[np.arange(len(a)) + first_b[a_group]] = np.where(last_a, self.names[1][a], self.names[0][a])
        said[np.arange(len(b)) + (first_a + n_a)[b_group]] = np.where(last_b, self.names[3][b], self.names[2][b])
        upto = np.cumsum(numbers[0] + numbers[1]).tolist()
        listed = said.tolist()
        shown = ["".join(listed[i:j]) for i, j in zip([0, *upto], upto)]
        return Measured(numbers, shown, np.bincount(own, minlength=len(units)), keys, links)

    def _pairs(self, a, b, n_a, n_b, first_a, first_b, a_group, unit_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, links, units): each unit's distinct pairs of linked ids and how often they are linked."""
        some = np.flatnonzero((n_a * n_b <= WIDE)[a_group])
        times = n_b[a_group[some]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        of_a = np.repeat(some, times)
        codes = [unit_of[a_group[of_a]] << self.key_bits | a[of_a] << self.bits | b[first_b[a_group[of_a]] + within]]
        weights = [np.ones(len(codes[0]), np.int64)]
        for g in np.flatnonzero(n_a * n_b > WIDE):
            ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            codes.append((unit_of[g] << self.key_bits | (ids_a[:, None] << self.bits | ids_b[None, :])).ravel())
            weights.append((times_a[:, None] * times_b[None, :]).ravel())
        codes, which = np.unique(np.concatenate(codes), return_inverse=True)
        links = np.bincount(which, weights=np.concatenate(weights), minlength=len(codes)).astype(np.int64)
        return codes & ((1 << self.key_bits) - 1), links, codes >> self.key_bits


_units: dict[str, Units] = {}


def units_of(models: tuple[bytes, bytes]) -> Units:
    """The worker's units of these two models; those of others go."""
    name = hashlib.sha256(models[0]).hexdigest() + hashlib.sha256(models[1]).hexdigest()
    if name not in _units:
        _units.clear()
        _units[name] = Units(*models)
    return _units[name]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, which = np.unique(keys, return_inverse=True)
    return keys, np.bincount(which, weights=counts, minlength=len(keys)).astype(np.int64)


def by_text(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their weights."""
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[begin], np.add.reduceat(weights, begin) if len(begin) else weights


def aligned_rows(units: Units, texts: list[str | None]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, keys, links) of each text; its distinct pairs come sorted."""
    sums, bad = np.zeros((4, len(texts)), np.int64), np.array([not t for t in texts], bool)
    digests: dict[int, list] = {}
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for owners, counts, parts in units.stretches(texts):
        place = units.places(parts)
        begin = np.cumsum(counts) - counts
        bad[owners[~np.logical_and.reduceat(units.good.all[place], begin)]] = True
        for row, column in zip(sums, units.numbers):
            np.add.at(row, owners, np.add.reduceat(column.all[place], begin))
        shown = list(map(units.shown.__getitem__, place.tolist()))
        for owner, at, n in zip(owners.tolist(), begin.tolist(), counts):
            said = "".join(shown[at : at + n]).encode()
            old = digests.setdefault(owner, [hashlib.sha256(), b""])
            old[0].update(old[1] + said[:-1])
            old[1] = said[-1:]  # the last separator is left out, unless the text goes on
        both = np.sort(np.repeat(owners, counts) << 32 | place)
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        times = np.diff(np.append(first, len(both)))
        owner, place = both[first] >> 32, both[first] & 0xFFFFFFFF
        ends = units.ends.all
        before = np.where(place > 0, ends[place - 1], 0)
        size = ends[place] - before
        at = np.repeat(before - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found.append(by_text(np.repeat(owner, size) << units.key_bits | units.keys.all[at], units.links.all[at] * np.repeat(times, size)))
    codes, links = found[-1] if len(found) == 2 else by_text(*map(np.concatenate, zip(*found)))
    bounds = np.searchsorted(codes >> units.key_bits, np.arange(len(texts) + 1))
    keys = codes & ((1 << units.key_bits) - 1)
    for i, row in enumerate(sums.T.tolist()):
        own = slice(bounds[i], bounds[i + 1])
        yield (0, 0, 0, 0, "", keys[:0], links[:0]) if bad[i] else (*row, digests[i][0].hexdigest(), keys[own], links[own])


def read_longs(uri: str) -> np.ndarray:
    """The file's int64 values: mapped where the shared folder is mounted, else read."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=np.int64, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=np.int64)


@dataclass
class PairCounts:
    """How many documents link each pair of ids, in sorted shards of the shared folder; best: the highest count of each id of A."""

    folder: str
    firsts: np.ndarray
    paths: list[str]
    best: np.ndarray
    bits: int

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; 0 for those that only texts without tokens have."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, side="right") - 1
        for i in np.unique(shard[shard >= 0]):
            if i not in (opened := self.__dict__.setdefault("_opened", {})):
                opened[i] = read_longs(self.paths[i])
            longs, at = opened[i], np.flatnonzero(shard == i)
            held = longs[: len(longs) // 2]
            where = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
            out[at] = np.where(held[where] == keys[at], longs[len(held) + where], 0)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_opened"}


def write_shard(folder: str, keys: np.ndarray, counts: np.ndarray) -> str:
    """A file of the keys, then of the counts; its name is new in each attempt of a task, so that none writes over another's."""
    uri = f"{folder}/{uuid.uuid4().hex}.longs"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(keys, np.int64))
        out.write(np.ascontiguousarray(counts, np.int64))
    return uri


def partial_counts(pairs: DataFrame, column: str) -> DataFrame:
    """(key, docs): in how many of a partition's rows the array column holds a key; a key may come again where a task had too many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, more, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> None:
            nonlocal keys, counts, more, size
            fresh, times = np.unique(np.concatenate([np.empty(0, np.int64), *more]), return_counts=True)
            keys, counts = summed(np.append(keys, fresh), np.append(counts, times))
            more, size = [], 0

        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "docs"])
        for batch in batches:
            more.append(batch.column(column).flatten().to_numpy())
            size += len(more[-1])
            if size > HELD:
                merged()
                if len(keys) > HELD:
                    yield out()
                    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        merged()
        yield out()

    return pairs.select(column).mapInArrow(run, "key long, docs long")


def count_pairs(pairs: DataFrame, column: str, bits: int, size_a: int, shard_rows: int = 1 << 20) -> PairCounts:
    """Each partition's partial counts, sorted by ranges of the packed keys; runs of a key are summed and each range is a shard of the shared folder.

    To the driver come each shard's path, first key and highest counts: size_a
    rows, and one more for each shard whose first id goes on from the one before.
    """
    spark = pairs.sparkSession
    folder = f"{shared_folder(spark)}/docframe-{uuid.uuid4().hex}"
    partial, seen = materialize_counting(partial_counts(pairs, column), n=F.count("*"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            k, c = batch.column("key").to_numpy(), batch.column("docs").to_numpy()
            if not len(k):
                continue
            begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            k, c = k[begin], np.add.reduceat(c, begin)
            if len(keys[-1]) and keys[-1][-1] == k[0]:  # a run that goes on from the batch before
                counts[-1][-1] += c[0]
                k, c = k[1:], c[1:]
            if len(k):
                keys.append(k)
                counts.append(c)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        if len(keys):
            path = write_shard(folder, keys, counts)
            begin = np.flatnonzero(np.append(True, keys[1:] >> bits != keys[:-1] >> bits))
            made = [[path], [int(keys[0])], [(keys[begin] >> bits).tolist()], [np.maximum.reduceat(counts, begin).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["path", "first", "a", "best"])

    n = max(1, -(-seen["n"] // shard_rows))
    ranges = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    shards = sorted(ranges.mapInArrow(shard, "path string, first long, a array<long>, best array<long>").collect(), key=lambda r: r["first"])
    best = np.zeros(size_a, np.int64)
    for r in shards:
        np.maximum.at(best, r["a"], r["best"])
    return PairCounts(folder, np.array([r["first"] for r in shards], np.int64), [r["path"] for r in shards], best, bits)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, carry: list[str] | None = None) -> DataFrame:
    """docs (of it, the columns in carry) with the columns of ALIGNED and COUNTED.

    a_path: a byte-level BPE as JSON of the library tokenizers, b_path: a model
    of the library sentencepiece; the driver reads them (a few MB) and
    broadcasts them. A encodes a space and the text, B the text (it adds the
    space itself), neither with special tokens. Byte offsets at which tokens of
    both end cut them into groups, in which each token of A is linked with each
    of B. A pair's count is the number of documents (rows) that link it; n_best
    are the links whose count is the highest of their A id, ties included, and
    count_sum is the sum of the counts over all links.

    Texts are encoded in one pass, whose result is written with each text's
    distinct pairs; they are counted, and looked up, from there.

    Texts that are null, empty, or whose bytes don't come out of either
    tokenizer (U+2581 in them, unknown characters without byte fallback) have
    zeros and '', and count nowhere. Repeated rows count each. Columns of docs
    with the new ones' names are replaced. Empty docs give an empty table.
    """
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = a.read(), b.read()
    units = units_of(files)
    context = docs.sparkSession.sparkContext
    models = context.broadcast(files)
    keys, links = fresh_names(docs, "keys", "links")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part, _, _ in slices(batch):
            yield from aligned_rows(units_of(models.value), part.column("text").to_pylist())

    own = docs.drop(*[f.split()[0] for f in COUNTED.split(", ")])
    aligned = materialize(add_columns(own, f"{ALIGNED}, {keys} array<bigint>, {links} array<bigint>", rows, carry))
    counts = context.broadcast(count_pairs(aligned, keys, units.bits, units.a.size))
    plain = T.StructType([f for f in aligned.schema if f.name not in (keys, links)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counts.value
        for batch in batches:
            lists, times = batch.column(keys), batch.column(links).flatten().to_numpy()
            own = lists.flatten().to_numpy()
            distinct, which = np.unique(own, return_inverse=True)
            docs = found.find(distinct)[which]
            upto = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            sums = lambda values: np.diff(np.append(0, np.cumsum(values))[upto])
            made = {"n_best": sums(times * (docs == found.best[own >> found.bits])), "count_sum": sums(times * docs)}
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in plain), *map(pa.array, made.values())], [*plain.names, *made])

    small_batches(docs.sparkSession)
    return aligned.mapInArrow(counted, T.StructType([*plain, *T.StructType.fromDDL(COUNTED)]))
