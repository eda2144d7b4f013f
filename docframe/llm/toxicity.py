"""Toxicity by non-negative positive-unlabelled learning over hashed byte n-grams and their repetition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.storage import add_columns, materialize, materialize_counting, small_batches
from docframe.llm.text import LOWER, SEGMENT, prefix_hashes, slices, substring_hashes

ORDERS = (4, 6)
MULTIPLIER = np.uint32(0x01000193)
#: Bytes of lower-cased text, with a space for what is neither letter nor digit.
FOLDED = LOWER.copy()
FOLDED[[i for i in range(128) if not chr(i).isalnum()]] = 32


AROUND = 32  # bytes on either side of an n-gram that are its context


def gram_hashes(data: np.ndarray, offsets: np.ndarray, contexts: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """32-bit hashes of the n-grams of the slice's texts, with a space before and after each, and their text numbers (and hashes of their contexts, within the text): for each order and each SEGMENT of bytes."""
    padded = np.append(np.insert(FOLDED[data], offsets[:-1], 32), np.uint8(32))
    ends = offsets[1:] + np.arange(1, len(offsets))  # the space after each text
    starts = offsets[:-1] + np.arange(len(offsets) - 1)  # the one before it
    for begin in range(0, len(padded), SEGMENT):
        inner = np.clip(np.append(0, ends[:-1]), begin, min(begin + SEGMENT, len(padded)))  # the space after a text begins the next
        owner = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.append(inner, min(begin + SEGMENT, len(padded)))))
        room = np.repeat(ends, np.diff(np.append(inner, min(begin + SEGMENT, len(padded))))) - np.arange(begin, begin + len(owner))
        low = max(0, begin - AROUND)
        prefix = prefix_hashes(padded[low : begin + SEGMENT + AROUND + max(ORDERS)]) if contexts else None
        for n in ORDERS:
            wide = padded[begin : begin + SEGMENT + n - 1].astype(np.uint32)
            size = len(wide) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ wide[i : i + size]) * MULTIPLIER
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            own = np.flatnonzero(room[:size] >= n - 1)
            if contexts:
                at, of = own + begin, owner[own]
                yield h[own], of, substring_hashes(prefix, np.maximum(at - AROUND, starts[of]) - low, np.minimum(at + n + AROUND, ends[of] + 1) - low)
            else:
                yield h[own], owner[own]


#: A feature is an n-gram's hash, and with this bit its second occurrence in a text.
TWICE = 1 << 32


def features(text_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text, each n-gram that it has, and again for those that it has twice at least: text numbers and features, sorted, each pair once."""
    both, n = np.unique(text_of.astype(np.int64) << 33 | hashes.astype(np.int64), return_counts=True)
    both = np.sort(np.append(both, both[n > 1] | TWICE))
    return both >> 33, both & ((1 << 33) - 1)


class Places:
    """Where features are in a sorted array of distinct ones: the search begins at the first with the same leading bits."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.keys = np.append(keys.astype(np.int64), 1 << 33)
        self.first = np.searchsorted(self.keys, np.arange(1 << 18, dtype=np.int64) << 15).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places, or -1 for what isn't there."""
        wanted = wanted.astype(np.int64)
        at = self.first[wanted >> 15]
        less = np.flatnonzero(self.keys[at] < wanted)
        while len(less):
            at[less] += 1
            less = less[self.keys[at[less]] < wanted[less]]
        return np.where((self.keys[at] == wanted) & (at < self.size), at, -1)


@dataclass
class Model:
    """A logistic score over the presence of chosen n-grams."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.chosen = Places(self.grams)
        self.plain = Places(np.unique(self.grams & (TWICE - 1)))  # of either kind

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and places of the chosen features of each text, each once."""
        if not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = [(np.empty(0, np.int64), np.empty(0, np.uint32))]
        for hashes, text_of in gram_hashes(data, offsets):
            hit = np.flatnonzero(self.plain.find(hashes) >= 0)
            found.append((text_of[hit], hashes[hit]))
        text_of, own = features(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        place = self.chosen.find(own)
        hit = place >= 0
        return text_of[hit], place[hit].astype(np.int64)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.grams):
            text_of, place = self.present(data, offsets)
            total += np.bincount(text_of, weights=self.weights[place], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Rows of the chosen features that a text has: their places, one text after the other, and the texts' bounds."""

    places: np.ndarray
    bounds: np.ndarray

    def __post_init__(self):
        self.text_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        upto = np.append(0.0, np.cumsum(weights[self.places]))
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        """The sums of the texts' values over each feature."""
        return np.bincount(self.places, weights=values[self.text_of], minlength=size)


def risk(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part and the negative part of the risk at w (the last is the bias), and the gradient that is followed.

    Risk: prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)]),
    with the logistic loss. Where the second term is negative, its gradient is
    followed upwards, so that the classifier unlearns what it has overfitted.
    """
    p, u = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
    positive_part = prior * np.logaddexp(0, -p).mean()
    negative_part = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    sp, su = sigmoid(p), sigmoid(u)
    to_p, to_u = -prior * sp / len(p), su / len(u)  # of the negative part
    to_p, to_u = (to_p - prior * (1 - sp) / len(p), to_u) if negative_part >= 0 else (-to_p, -to_u)
    size = len(w) - 1
    return positive_part, negative_part, np.append(positive.back(to_p, size) + unlabelled.back(to_u, size), to_p.sum() + to_u.sum())


def fit_nnpu(positive: Rows, unlabelled: Rows, size: int, prior: float, steps: int = 150, rate: float = 0.1, decay: float = 1e-3, at_once: float = 50.0) -> np.ndarray:
    """Weights of size features, and the bias last, by Adam on the non-negative risk.

    Where positive texts have over at_once features each, of which all move at
    once, the steps are smaller as much: a text's margin moves by no more.
    """
    rate *= min(1.0, at_once * len(positive.bounds) / max(1, len(positive.places)))
    w = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = risk(w, positive, unlabelled, prior)[2]
        g[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def lift(p: Column, u: Column, n_positive: int, n_unlabelled: int) -> Column:
    """How much oftener p of n_positive texts have a feature than u of n_unlabelled ones: the root of the deviance of p from the unlabelled rate, 0 where it isn't oftener.

    For many texts it comes near the distance in standard errors; for few it
    stays exact enough to tell three of three from three in a thousand.
    """
    n, rate = F.lit(float(n_positive)), (u + 0.5) / (n_unlabelled + 1.0)
    rate = F.least(rate, F.lit(1 - 1e-9))
    rest = F.when(p < n, (n - p) * F.log((n - p) / (n * (1 - rate)))).otherwise(0.0)
    return F.when(p / n > rate, F.sqrt(F.greatest(F.lit(0.0), 2 * (p * F.log(p / (n * rate)) + rest)))).otherwise(0.0)


HELD = 1 << 20  # features that a task sums at once


def tallied(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, n_features: int = 2048, least_lift: float = 3.5, part_rows: int = 10_000, steps: int = 150) -> Model:
    """A model from confirmed toxic texts (labels.toxic = 1) and unlabelled ones: all rows of docs with a text.

    Of the confirmed texts max_positive, in the order of a hash of doc_id, are
    fitted; the class prior is the toxic share of all given labels, which
    aren't used otherwise. Candidates are all features (n-grams, once, and twice
    at least) that confirmed texts have in two contexts: each text counts with
    the first place (or second) that it has, and texts with the same bytes
    around it count once, so that a copied passage, or copies of a text, don't
    stand for many. They are counted in all unlabelled texts, joined, and the
    n_features of the highest lift are chosen, of least_lift at least (see
    lift).

    The unlabelled rows are dealt by hash to parts of about part_rows; each
    part's risk, with all fitted positives, is minimised in a task of its own,
    and the weights are averaged over all unlabelled rows. Rows that repeat
    count each; of confirmed ones with the same doc_id one does. Rows with a
    null text, and labels with nulls, teach nothing. Without two positive texts
    the model scores the prior, without a label 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(0.95, max(1e-4, n_toxic / n)) if n else 0.0
    texts = docs.select("doc_id", "text").where("text is not null")
    confirmed = known.where("toxic = 1").select("doc_id").join(texts.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    # At most max_positive ids.
    positives, seen = materialize_counting(texts.join(F.broadcast(materialize(confirmed)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), n=F.count("*"))
    n_positive, none = seen["n"], Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))) if prior else -40.0)
    if n_positive < 2:
        return none

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch):
                found = list(gram_hashes(data, offsets, contexts=True))
                if found:
                    hashes, text_of, context = (np.concatenate(x) for x in zip(*found))
                    both = text_of.astype(np.int64) << 33 | hashes.astype(np.int64)
                    order = np.argsort(both, kind="stable")
                    both, context = both[order], context[order].view(np.int64)
                    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                    again = first[np.diff(np.append(first, len(both))) > 1]
                    grams = np.append(both[first], both[again] | TWICE) & ((1 << 33) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.append(context[first], context[again + 1]))], ["gram", "context"])

    n_distinct = positives.agg(F.count_distinct("text")).first()[0]
    summed = positives.select("text").mapInArrow(places, "gram long, context long").groupBy("gram").agg(F.count_distinct("context").alias("p"))
    counted, seen = materialize_counting(summed.where("p >= 2"), n=F.count("*"))
    if not seen["n"]:
        return none
    # A bit for each leading part of a candidate's hash, a few times as many as candidates: 2^27 bits at most.
    bits = min(27, max(20, int(seen["n"] * 8).bit_length()))
    place = F.col("gram").bitwiseAND(TWICE - 1)
    word, bit = F.shiftright(place, 32 - bits + 6), F.expr(f"shiftleft(1L, cast(shiftright(gram & {TWICE - 1}, {32 - bits}) & 63 as int))")
    got = counted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^(bits - 6) rows at most
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    may = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").view(bool))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, u, more, rows = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(grams), pa.array(u)], ["gram", "u"])

        def merge() -> None:
            nonlocal grams, u, more
            fresh, times = tallied(more)
            keys, which = np.unique(np.append(grams, fresh), return_inverse=True)
            grams, u, more = keys, np.bincount(which, np.append(u, times), len(keys)).astype(np.int64), []

        for batch in batches:
            rows += batch.num_rows
            for _, data, offsets in slices(batch):
                found = [(np.empty(0, np.int64), np.empty(0, np.uint32))]
                for hashes, text_of in gram_hashes(data, offsets):
                    hit = np.flatnonzero(may.value[hashes >> np.uint32(32 - bits)])
                    found.append((text_of[hit], hashes[hit]))
                more.append(features(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))[1])
                if sum(map(len, more)) > HELD:
                    merge()
                    if len(grams) > HELD:
                        yield out()
                        grams, u = np.empty(0, np.int64), np.empty(0, np.int64)
        merge()
        grams, u = np.append(grams, -1), np.append(u, rows)  # the number of texts is a row too
        yield out()

    unlabelled, seen = materialize_counting(texts.select("text").mapInArrow(occurrences, "gram long, u long").groupBy("gram").agg(F.sum("u").alias("u")), rows=F.max(F.when(F.col("gram") == -1, F.col("u"))))
    may.unpersist()
    n_unlabelled = seen["rows"]
    lifted = counted.join(unlabelled, "gram", "left").withColumn("lift", F.round(lift(F.col("p"), F.coalesce("u", F.lit(0)), n_distinct, n_unlabelled), 9))
    best = lifted.where(F.col("lift") >= least_lift).orderBy(F.desc("lift"), "gram").limit(n_features).select("gram").toArrow()
    grams = np.sort(best.column("gram").to_numpy())
    if not len(grams):
        return none
    blank = Model(grams, np.zeros(len(grams)), 0.0)
    n_parts = max(1, round(n_unlabelled / part_rows))
    turn = F.xxhash64("doc_id", "text")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                text_of, place = blank.present(data, offsets)
                bounds = np.searchsorted(text_of, np.arange(len(offsets)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("turn"), rows.column("part"), lists], ["turn", "part", "places"])

    def found(df: DataFrame) -> DataFrame:
        return df.select(turn.alias("turn"), F.pmod(F.xxhash64(turn, F.lit("part")), F.lit(n_parts)).alias("part"), "text").mapInArrow(presence, "turn long, part long, places array<int>")

    def rows_of(table: pa.Table) -> Rows:
        lists = table.sort_by("turn").column("places").combine_chunks()
        return Rows(lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())))

    shared = spark.sparkContext.broadcast(rows_of(found(positives).toArrow()))  # at most max_positive rows of n_features places

    def fit(table: pa.Table) -> pa.Table:
        w = fit_nnpu(shared.value, rows_of(table), len(grams), prior, steps)
        return pa.table([pa.array(np.arange(len(w))), pa.array(w * table.num_rows)], ["at", "w"])

    sums = found(texts).groupBy("part").applyInArrow(fit, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).orderBy("at").toArrow()
    w = np.round(sums.column("w").to_numpy() / n_unlabelled, 6)
    return Model(grams, w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, carry: list[str] | None = None, **parameters) -> DataFrame:
    """docs (of it, the columns in carry) with score (0 to 1, higher: likelier toxic), learnt from training's texts and labels (parameters: see train).

    Only the text decides, however long; null and empty texts get the bias's
    score. A column score of docs is replaced, others stay; repeated rows stay,
    each with its score. Empty docs give an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training, labels, **parameters))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[float]]:
        for _, data, offsets in slices(batch):
            yield from ((float(x),) for x in model.value.scores(data, offsets))

    return add_columns(docs, "score double", rows, carry)
