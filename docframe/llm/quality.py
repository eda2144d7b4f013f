"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.storage import add_columns, materialize, small_batches
from docframe.llm.text import ALNUM, BY_SPACE, LOWER, hashed_words, mix, slices

BUCKETS = 1 << 14  # of words
NAMED = 1 << 10  # of the values of string columns
STATISTICS = "bytes words lines word_length distinct distinct_by_root again upper digits symbols symbol_words symbol_ends shouted".split()


def byte_class(test) -> np.ndarray:
    return np.array([test(chr(i)) for i in range(128)] + [False] * 128)


UPPER, DIGIT = byte_class(str.isupper), byte_class(str.isdigit)
SYMBOL = byte_class(lambda c: c.isprintable() and not c.isalnum() and c != " ")


def sums_between(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(flags))
    return upto[end] - upto[begin]


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, bounds, buckets) of a slice's texts: a row of STATISTICS each, and the buckets of its distinct lower-cased words, one text after the other."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, text_of, hashes = hashed_words(LOWER[data], offsets, BY_SPACE)
    of_text = lambda flags: np.bincount(text_of, weights=flags, minlength=n)
    words = of_text(np.ones(len(starts)))
    codes = np.unique(text_of.astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(12))
    owner = (codes >> np.uint64(52)).astype(np.int64)
    buckets = (mix(codes & np.uint64((1 << 52) - 1)) % np.uint64(BUCKETS)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    same = np.zeros(len(starts))
    if len(starts) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    alnum = sums_between(ALNUM[LOWER[data]], starts, ends)
    upper = sums_between(UPPER[data], starts, ends)
    last = np.zeros(len(starts), bool)
    if len(starts):
        last = SYMBOL[data[ends - 1]] & (ends - starts > 1) & SYMBOL[data[np.maximum(ends - 2, 0)]]
    per = lambda x, y: x / np.maximum(1.0, y)
    share = lambda kind: per(sums_between(kind[data], offsets[:-1], offsets[1:]), size)
    newline = np.zeros(256, bool)
    newline[10] = True
    statistics = np.stack([
        np.log1p(size), np.log1p(words), share(newline), per(of_text(ends - starts), words), per(distinct, words), per(distinct, np.sqrt(words)), per(of_text(same), words),
        share(UPPER), share(DIGIT), share(SYMBOL), per(of_text(alnum == 0), words), per(of_text(last), words), per(of_text(upper > 1), words),
    ], axis=1)
    return statistics, np.searchsorted(owner, np.arange(n + 1)), buckets


def metadata_values(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """A row for each text: numbers as they are, other values by their hashes' buckets; NaN for nulls."""
    out = np.full((rows.num_rows, len(columns)), np.nan)
    for i, c in enumerate(columns):
        column = rows.column(c)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_decimal(column.type):
            out[:, i] = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        else:
            column = column.cast(pa.string())
            _, data, offsets = next(slices(pa.RecordBatch.from_arrays([column], ["text"]), limit=1 << 62), (None, np.empty(0, np.uint8), np.zeros(1, np.int64)))
            whole = [hash_bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            out[:, i] = np.where(pc.is_null(column).to_numpy(zero_copy_only=False), np.nan, np.array(whole, dtype=float) if whole else np.empty(0))
    return out


def hash_bytes(data: np.ndarray) -> int:
    h = np.uint64(len(data))
    with np.errstate(over="ignore"):
        for b in data:
            h = mix(np.array([h ^ np.uint64(b)], np.uint64))[0]
    return int(h % np.uint64(NAMED))


@dataclass
class Features:
    """Sparse rows: the features of each text and its values, one text after the other."""

    ids: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    def rows(self, which: np.ndarray) -> Features:
        size = np.diff(self.bounds)[which]
        at = np.repeat(self.bounds[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Features(self.ids[at], self.values[at], np.append(0, np.cumsum(size)))


@dataclass
class Binning:
    """Features from what describe and metadata_values give: a bucket of value 1/sqrt(d) for each of d distinct words, and the quantile range of each number, or the bucket of each name, with value 1/2."""

    edges: list[np.ndarray]  # of statistics, then of metadata; for names: empty
    named: list[bool]

    def __post_init__(self):
        sizes = [NAMED + 1 if name else len(e) + 2 for e, name in zip(self.edges, self.named)]
        self.first = BUCKETS + np.append(0, np.cumsum(sizes))
        self.size = int(self.first[-1])

    @staticmethod
    def of(numbers: np.ndarray, named: list[bool], bins: int) -> Binning:
        cuts = np.linspace(0, 1, bins + 1)[1:-1]
        known = [c[~np.isnan(c)] for c in numbers.T]
        return Binning([np.empty(0) if name or not len(c) else np.unique(np.quantile(c, cuts)) for c, name in zip(known, named)], named)

    def features(self, numbers: np.ndarray, bounds: np.ndarray, buckets: np.ndarray) -> Features:
        n, extra = numbers.shape
        words = np.diff(bounds)
        total = np.append(0, np.cumsum(words + extra))
        ids, values = np.empty(total[-1], np.int64), np.empty(total[-1])
        at = np.repeat(total[:-1] - bounds[:-1], words) + np.arange(len(buckets))
        ids[at], values[at] = buckets, np.repeat(1 / np.sqrt(np.maximum(1, words)), words)
        for i, (edges, name, first) in enumerate(zip(self.edges, self.named, self.first)):
            column = numbers[:, i]
            none = np.isnan(column)
            place = np.where(none, 0, column).astype(np.int64) if name else np.searchsorted(edges, np.where(none, 0, column), side="right")
            ids[total[1:] - extra + i] = first + np.where(none, NAMED if name else len(edges) + 1, place)
            values[total[1:] - extra + i] = 0.5
        return Features(ids, values, total)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows from each bound to the next."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


@dataclass
class Machine:
    """bias + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """(margins, sums of v_i x_i). The pairs' sum is (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2: linear in the features."""
        vx = self.factors[x.ids] * x.values[:, None]
        sums = segment_sums(vx, x.bounds)
        squares = segment_sums((vx * vx).sum(axis=1), x.bounds)
        return self.bias + segment_sums(self.weights[x.ids] * x.values, x.bounds) + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def gradient(self, x: Features, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the mean logistic loss."""
        margin, sums = self.margins(x)
        g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / len(y)
        text_of = np.repeat(np.arange(len(y)), np.diff(x.bounds))
        gx = g[text_of] * x.values
        to_v = gx[:, None] * (sums[text_of] - self.factors[x.ids] * x.values[:, None])
        size = len(self.weights)
        return g.sum(), np.bincount(x.ids, gx, size), np.stack([np.bincount(x.ids, column, size) for column in to_v.T], axis=1)


def fit_machine(x: Features, y: np.ndarray, size: int, rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """By Adam over shuffled batches, from small random factors; the same rows give the same machine."""
    random = np.random.default_rng(0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.05, (size, rank)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(()), m.weights, m.factors)]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for i in range(0, len(y), batch):
            step += 1
            which = order[i : i + batch]
            gb, gw, gv = m.gradient(x.rows(which), y[which])
            moves = []
            for g, (first, second) in zip((np.array(gb), gw + decay * m.weights, gv + decay * m.factors), moments):
                first *= 0.9
                first += 0.1 * g
                second *= 0.999
                second += 0.001 * g * g
                moves.append(rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
            m.bias -= float(moves[0])
            m.weights -= moves[1]
            m.factors -= moves[2]
    return m


@dataclass
class Model:
    binning: Binning | None
    machine: Machine
    metadata: list[str]

    def scores(self, batch: pa.RecordBatch) -> Iterator[float]:
        for rows, data, offsets in slices(batch):
            if self.binning is None:
                margin = np.full(rows.num_rows, self.machine.bias)
            else:
                statistics, bounds, buckets = describe(data, offsets)
                numbers = np.concatenate([statistics, metadata_values(rows, self.metadata)], axis=1)
                margin = self.machine.margins(self.binning.features(numbers, bounds, buckets))[0]
            yield from np.round(1 / (1 + np.exp(-np.clip(margin, -40, 40))), 6).tolist()  # sums of floats differ with the slices in the last places


def train(docs: DataFrame, labels: DataFrame, metadata: list[str] | None = None, max_labelled: int = 8192, bins: int = 12, rank: int = 8) -> Model:
    """A model of labels.quality = 1 from labelled texts of docs.

    Of the labelled documents max_labelled, in the order of a hash of doc_id,
    are fitted, by their distinct words' buckets, of which there are BUCKETS at
    most: what comes to the driver is bounded. metadata: columns of docs,
    numbers by their quantiles, others by their values. Of rows with the same
    doc_id one counts, the one with the least text; null texts and labels with
    nulls teach nothing. Without a label all scores are 0.5; with one kind only,
    they are near it.
    """
    metadata = metadata or []
    small_batches(docs.sparkSession)
    named = [not isinstance(docs.schema[c].dataType, T.NumericType) for c in metadata]
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("label"))
    texts = docs.where("text is not null").select("doc_id", F.struct("text", *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(metadata)]).alias("row"))
    chosen = materialize(known.join(texts.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    least = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("row").alias("row"))  # max_labelled ids at most
    given = least.select("doc_id", "label", "row.*")
    columns = [f"m{i}" for i in range(len(metadata))]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                statistics, bounds, buckets = describe(data, offsets)
                numbers = np.concatenate([statistics, metadata_values(rows, columns)], axis=1)
                upto = np.arange(rows.num_rows + 1, dtype=np.int32) * numbers.shape[1]
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(numbers.ravel())), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(buckets.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), *lists], ["doc_id", "label", "numbers", "buckets"])

    kinds = T.StructType([given.schema["doc_id"], given.schema["label"]]).add("numbers", T.ArrayType(T.DoubleType())).add("buckets", T.ArrayType(T.IntegerType()))
    got = given.mapInArrow(described, kinds).toArrow()
    if not got.num_rows:
        return Model(None, Machine(0.0, np.empty(0), np.empty((0, rank))), metadata)
    got = got.sort_by("doc_id")
    y = got.column("label").to_numpy().astype(float)
    numbers = got.column("numbers").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    lists = got.column("buckets").combine_chunks()
    binning = Binning.of(numbers, [False] * len(STATISTICS) + named, bins)
    x = binning.features(numbers, np.append(0, np.cumsum(lists.value_lengths().to_numpy())), lists.flatten().to_numpy().astype(np.int64))
    return Model(binning, fit_machine(x, y, binning.size, rank), metadata)


def score_quality(docs: DataFrame, training: DataFrame, labels: DataFrame, metadata: list[str] | None = None, carry: list[str] | None = None, **parameters) -> DataFrame:
    """docs (of it, the columns in carry) with score (0 to 1, higher: likelier of quality 1), learnt from training and labels (parameters: see train).

    The whole text and the columns of metadata decide; null texts score as
    empty ones, null metadata as a value of its own. A column score of docs is
    replaced, others stay; repeated rows stay, each with its score. Empty docs
    give an empty table.
    """
    metadata = metadata or []
    model = docs.sparkSession.sparkContext.broadcast(train(training, labels, metadata, **parameters))
    rows = lambda batch: ((x,) for x in model.value.scores(batch))
    scored = add_columns(docs, "score double", rows, None if carry is None else list(dict.fromkeys([*carry, *metadata])))
    return scored if carry is None else scored.select(*[f"`{c}`" for c in carry], "score")
