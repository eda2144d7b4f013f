"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation, beside exact unigram counts."""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.storage import materialize, small_batches
from docframe.llm.text import BY_SPACE, LOWER, hashed_words, prefix_hashes, slices, substring_hashes

END = b""
HEAD = 1 << 20  # tokens whose counts go to every worker at most
OWN = 64  # tokens with a class of their own, times the cube root of the tokens counted
CONTEXT = 3
WIDTH = 16
NOISE = 32
INNER = 6
BATCH = 2048
STEP = 1024  # tokens whose products are at hand at once
LANE = 16  # tokens of a group that meet its noise in one product
ROUNDS = 3
SHARE = 128  # tokens of a partition for each class
BLOCK = 1 << 16
LOG2E = np.float32(math.log2(math.e))


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c) summed over as many texts as fit in memory."""
    counts: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        keys, values = list(counts), list(counts.values())
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000], pa.binary()), pa.array(values[at : at + 100_000], pa.int64())], ["token", "c"])
        counts.clear()

    for batch in batches:
        for text in batch.column("text"):
            counts.update((text.as_py() or "").encode().lower().split())
            counts[END] += 1
            if len(counts) > 1_000_000:
                yield from out()
    yield from out()


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    return substring_hashes(prefix_hashes(data), np.append(0, ends)[: len(tokens)], ends)


@dataclass
class Counts:
    """The frequent tokens' counts by hash, and totals of all. Tokens without a class of their own share the last, hashed classes; both grow with the corpus."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    hashes: np.ndarray = field(init=False)
    classes: np.ndarray = field(init=False)
    class_counts: np.ndarray = field(init=False)

    def __post_init__(self):
        hashes = token_hashes(self.tokens)
        order = np.lexsort((hashes, -self.counts))[: round(OWN * math.cbrt(self.total))]
        self.own = len(order)
        self.hashed = max(1, min(math.isqrt(self.total), self.distinct - self.own))
        classes = self.bucket(hashes)
        classes[order] = np.arange(self.own)
        self.class_counts = np.bincount(classes, weights=self.counts, minlength=self.own + self.hashed).astype(np.float64)
        self.class_tokens = np.bincount(classes, minlength=self.own + self.hashed)
        by_hash = np.argsort(hashes)
        self.hashes, self.classes, self.counts = hashes[by_hash], classes[by_hash], self.counts[by_hash]
        self.end = next((i for i in by_hash.tolist() if self.tokens[i] == END), None)
        self.end = int(np.searchsorted(self.hashes, hashes[self.end])) if self.end is not None else -1
        self.tokens = []
        self.first = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of frequent tokens, or -1; the search begins at the first with the same leading bits."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        last = len(self.hashes) - 1
        at = np.minimum(self.first[hashes >> np.uint64(44)], last)
        less = np.flatnonzero(self.hashes[at] < hashes)
        while len(less):
            less = less[at[less] < last]
            at[less] += 1
            less = less[self.hashes[at[less]] < hashes[less]]
        return np.where(self.hashes[at] == hashes, at, -1).astype(np.int64)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return self.own + (hashes % np.uint64(self.hashed)).astype(np.int64)

    def sizes(self) -> np.ndarray:
        """The sums of c + 0.5 over each class's tokens and, in hashed ones, one unseen token."""
        return self.class_counts + 0.5 * (self.class_tokens + (np.arange(len(self.class_counts)) >= self.own))

    def places(self, data: np.ndarray, offsets: np.ndarray):
        """Of a slice's tokens, each text's end included: text numbers, places in the frequent tokens or -1, classes, starts and ends of the words."""
        low = LOWER[data]
        starts, ends, text_of, h = hashed_words(low, offsets, BY_SPACE)
        place = self.find(h)
        after = np.cumsum(np.bincount(text_of, minlength=len(offsets) - 1))
        text_of, place, h, starts, ends = (np.insert(x, after, y) for x, y in ((text_of, np.arange(len(offsets) - 1)), (place, self.end), (h, token_hashes([END])[0]), (starts, 0), (ends, 0)))
        classes = np.where(place >= 0, self.classes[place], self.bucket(h)) if len(self.classes) else self.bucket(h)
        return text_of, place, classes, starts, ends, low


def contexts(text_of: np.ndarray, classes: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT classes before each token, the nearest first; start before a text's first."""
    out = np.full((len(classes), CONTEXT), start, dtype=np.int64)
    for j in range(1, CONTEXT + 1):
        same = text_of[j:] == text_of[:-j]
        out[j:, j - 1] = np.where(same, classes[:-j], start)
    return out


def put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row copied as one element, which is faster."""
    whole = np.dtype((np.void, table.strides[0]))
    table.reshape(len(table), -1).view(whole)[at, 0] = rows.reshape(len(rows), -1).view(whole)[:, 0]


def run_sums(values: np.ndarray, first: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the runs of values, taken in this order, that begin at first, and the runs' lengths.

    reduceat takes as long over a run of one as over a longer one, so these are
    only copied; and it takes column by column, so two floats pass as one
    complex number where columns are even.
    """
    order = np.arange(len(values)) if order is None else order
    times = np.diff(np.append(first, len(order)))
    out = values.take(order.take(first), axis=0)
    many = np.flatnonzero(times > 1)
    if len(many):
        of = times.take(many)
        rows = values.take(order[np.repeat(times > 1, times)], axis=0)
        rows = rows.view(np.complex64) if rows.shape[-1] % 2 == 0 else rows
        put(out, many, np.add.reduceat(rows, np.cumsum(of) - of, axis=0).view(np.float32))
    return out, times


def in_order(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in ascending order and the places they come from, the earlier of equals first; number and place are sorted as one integer, so that larger numbers take no longer."""
    bits = len(at).bit_length()
    both = at.astype(np.int64) << bits
    both |= np.arange(len(at))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values, how often each occurs."""
    at, order = in_order(at)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at.take(first), *run_sums(values, first, order)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of x / -LOG2E, in place: powers of 2 are the faster ones."""
    np.exp2(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


class LogBilinear:
    """P(w | context) = P(group of w) * P(w | group), both by (sum of c_j * r[w_j]) . q + b, with a weight vector c_j for each place of the context.

    Groups are about sqrt(n) runs of about sqrt(n) classes, so that a
    probability costs 2 * sqrt(n) products. A table's last columns are b.
    """

    def __init__(self, class_counts: np.ndarray, seed: int = 1):
        self.n = n = len(class_counts)
        self.members = math.isqrt(n - 1) + 1
        self.groups = -(-n // self.members)
        random = np.random.default_rng(seed)
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.group_share = np.add.reduceat(share, np.arange(0, n, self.members))
        self.noise = share / np.repeat(self.group_share, self.members)[:n]  # within a group
        self.groups_upto = np.cumsum(self.group_share)[:-1]
        self.log_noise = np.log(INNER * self.noise).astype(np.float32)
        self.log_group_noise = np.log(NOISE * self.group_share).astype(np.float32)
        self.upto = np.append(0, np.cumsum(share))
        q = np.hstack([random.standard_normal((n, WIDTH)) * 0.1, np.log(self.noise)[:, None]])
        g = np.hstack([random.standard_normal((self.groups, WIDTH)) * 0.1, np.log(self.group_share)[:, None]])
        self.tables = [t.astype(np.float32) for t in (random.standard_normal((n + 1, WIDTH)) * 0.1, q, np.ones((CONTEXT, WIDTH)) / CONTEXT, g)]
        self.squares = [np.full_like(t, 1e-6) for t in self.tables]
        self.touched = [np.zeros(len(t), np.float32) for t in self.tables]
        self.random = random

    def weights(self) -> np.ndarray:
        """The c_j as diagonals one below the other: a context's vectors side by side, times this, are its prediction."""
        return np.concatenate([np.diag(c) for c in self.tables[2]])

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return self.tables[0].take(context.ravel(), axis=0).reshape(len(context), -1) @ self.weights()

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float = 0.2) -> None:
        """One step on a batch: each target's group against NOISE groups, which the batch shares, and each target against INNER classes of its group, which the batch's targets of a group share.

        The batch is ordered by targets, and so by groups: sums over either are
        sums of neighbours, and a group's tokens, LANE at a time, meet its noise
        classes and the group itself in one product of two matrices.
        """
        r, q, c, g = self.tables
        target, order = in_order(target)
        context = context.take(order, axis=0).ravel()
        size, own = len(target), target // self.members
        edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        present, ends = own[edges], np.append(edges[1:], size)
        weights = self.weights()
        given = r.take(context, axis=0).reshape(size, -1)
        filled = np.zeros((size + 1, WIDTH + 1), np.float32)  # a row of zeros at the end
        hat = filled[:size]
        hat[:, :WIDTH] = given @ weights
        hat[:, WIDTH] = 1  # meets b

        groups = np.searchsorted(self.groups_upto, self.random.random(NOISE), side="right")
        noise = g.take(groups, axis=0)
        against = noise.copy()
        against[:, WIDTH] -= self.log_group_noise[groups]
        against *= -LOG2E
        down = sigmoid(hat @ against.T)
        to_hat = down @ noise
        to_g = np.zeros_like(g)
        np.add.at(to_g, groups, down.T @ hat)

        begin = present * self.members
        last = np.minimum(begin + self.members, self.n)
        low, high = self.upto[begin], self.upto[last]
        drawn = np.searchsorted(self.upto, low[:, None] + self.random.random((len(present), INNER)) * (high - low)[:, None], side="right") - 1
        drawn = np.clip(drawn, begin[:, None], last[:, None] - 1)
        rivals = np.empty((len(present), INNER + 1, WIDTH + 1), np.float32)
        rivals[:, :INNER] = q.take(drawn, axis=0)
        rivals[:, INNER] = -g.take(present, axis=0)  # its sigmoid is 1 - P(data)
        against = rivals.copy()
        against[:, :INNER, WIDTH] -= self.log_noise.take(drawn)
        against[:, INNER, WIDTH] += self.log_group_noise.take(present)
        against *= -LOG2E
        lanes = -(-(ends - edges) // LANE)
        of, first = np.repeat(np.arange(len(present)), lanes), np.cumsum(lanes) - lanes
        at = np.arange(size) + np.repeat(first * LANE - edges, ends - edges)
        slots = np.full(len(of) * LANE, size)
        slots[at] = np.arange(size)
        tiles = filled.take(slots, axis=0).reshape(-1, LANE, WIDTH + 1)
        down = sigmoid(tiles @ np.ascontiguousarray(against.transpose(0, 2, 1)).take(of, axis=0))
        to_hat += (down @ rivals.take(of, axis=0)).reshape(-1, WIDTH + 1).take(at, axis=0)
        sums, _ = run_sums(down.transpose(0, 2, 1) @ tiles, first)
        to_g[present] -= sums[:, INNER]
        to_drawn = summed(drawn.ravel(), sums[:, :INNER].reshape(-1, WIDTH + 1))

        vectors = q.take(target, axis=0)
        up = sigmoid((np.einsum("ij,ij->i", hat, vectors) - self.log_noise.take(target)) * LOG2E)[:, None]
        vectors *= up
        to_hat -= vectors
        firsts = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        to_target = target.take(firsts), *run_sums(hat * -up, firsts)
        to_hat = np.ascontiguousarray(to_hat[:, :WIDTH])
        to_r = summed(context, (to_hat @ weights.T).reshape(-1, WIDTH))
        to_c = np.einsum("ikj,ij->kj", given.reshape(size, CONTEXT, WIDTH), to_hat)
        for which, at, grad, times in ((0, *to_r), (1, *to_target), (1, *to_drawn), (2, np.arange(CONTEXT), to_c, size), (3, np.arange(len(g)), to_g, size)):
            t, s = self.tables[which], self.squares[which]
            grad *= np.float32(1 / size)
            squares = s.take(at, axis=0)
            squares += grad * grad
            put(s, at, squares)
            np.sqrt(squares, out=squares)
            grad *= np.float32(rate)
            grad /= squares
            put(t, at, np.subtract(t.take(at, axis=0), grad, out=grad))
            self.touched[which][at] += times

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all classes: matrix products over all groups and over the members of each target's group."""
        _, q, _, g = self.tables
        out, own = np.empty(len(target), np.float64), target // self.members
        order = np.argsort(own.astype(np.uint16 if self.groups < 1 << 16 else np.uint32), kind="stable")
        context, target, own = context.take(order, axis=0), target.take(order), own.take(order)
        edges = np.searchsorted(own, np.arange(self.groups + 1))
        hat = np.full((len(target), WIDTH + 1), LOG2E)
        hat[:, :WIDTH] = self.predicted(context) * LOG2E
        logs = np.empty(len(target), np.float64)

        def chosen(hats: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
            scores = hats @ table.T  # in bits
            picked = scores.ravel().take(np.arange(len(hats)) * len(table) + at)
            with np.errstate(over="ignore", invalid="ignore"):
                total = np.exp2(scores, out=scores) @ np.ones(len(table), np.float32)
            sums, odd = np.log2(np.maximum(total, 1e-38)), np.flatnonzero(~((total >= 1e-30) & (total < np.inf)))
            if len(odd):  # the exponentials left the range of a float
                again = hats[odd] @ table.T
                most = again.max(axis=1)
                sums[odd] = most + np.log2(np.exp2(again - most[:, None]).sum(axis=1))
            return picked - sums

        for i in range(0, len(order), STEP):
            logs[i : i + STEP] = chosen(hat[i : i + STEP], g, own[i : i + STEP])
        for k in np.flatnonzero(np.diff(edges)).tolist():
            members = q[k * self.members : (k + 1) * self.members]
            for i in range(edges[k], edges[k + 1], STEP):
                end = min(i + STEP, edges[k + 1])
                logs[i:end] += chosen(hat[i:end], members, target[i:end] - k * self.members)
        out[order] = logs * math.log(2)
        return out

    def weighted(self) -> np.ndarray:
        """Each row of the tables and its mean squares, times how often it was touched since the start: sums over partitions give the averages."""
        return np.concatenate([np.hstack([w[:, None], w[:, None] * np.hstack([t, s.mean(axis=1, keepdims=True)])]).ravel() for t, s, w in zip(self.tables, self.squares, self.touched)])

    def average(self, sums: np.ndarray) -> None:
        """Takes the averages of weighted(); rows that nothing touched stay."""
        at = 0
        for t, s in zip(self.tables, self.squares):
            part = sums[at : at + len(t) * (t.shape[1] + 2)].reshape(len(t), -1)
            at += part.size
            seen = part[:, 0] > 0
            means = part[seen, 1:] / part[seen, :1]
            t[seen], s[seen] = means[:, :-1], means[:, -1:]


def gather_counts(training: DataFrame) -> tuple[DataFrame, Counts]:
    """All token counts as a table (token, c, rare), and what goes to the workers: at most HEAD tokens, by a least count that is a power of 2."""
    counts = materialize(training.select("text").mapInArrow(count_tokens, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    by_size = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    least, held = 62, 0
    for row in sorted(by_size, key=lambda r: -r["power"]):
        held += row["n"]
        if held > HEAD:
            break
        least = row["power"]
    frequent = counts.where(F.col("c") >= F.lit(1 << least).cast("long")).toArrow()
    head = Counts(frequent.column("token").to_pylist(), frequent.column("c").to_numpy().astype(np.int64), sum(r["c"] for r in by_size), sum(r["n"] for r in by_size))
    rare = counts.where(F.col("c") < F.lit(1 << least).cast("long"))
    shared = training.sparkSession.sparkContext.broadcast((head.own, head.hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashed = shared.value
        found = np.zeros((2, hashed), np.int64)
        for batch in batches:
            for rows, data, offsets in slices(batch, "token"):
                at = (substring_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]) % np.uint64(hashed)).astype(np.int64)
                found += np.stack([np.bincount(at, weights=rows.column("c").to_numpy(), minlength=hashed).astype(np.int64), np.bincount(at, minlength=hashed)])
        at = np.flatnonzero(found[1])
        yield pa.RecordBatch.from_arrays([pa.array(own + at), pa.array(found[0, at]), pa.array(found[1, at])], ["at", "c", "n"])

    rest = rare.mapInArrow(run, "at long, c long, n long").groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toArrow()
    at = rest.column("at").to_numpy()
    head.class_counts[at] += rest.column("c").to_numpy()
    head.class_tokens[at] += rest.column("n").to_numpy()
    return rare, head


def train(training: DataFrame, head: Counts) -> LogBilinear:
    """A model from all training tokens, each seen once.

    Rows are dealt by hash to ROUNDS rounds and, in each, to partitions of
    SHARE tokens a class, whatever files they come from. In a round all
    partitions learn from one start; a row of parameters is averaged by how
    often each partition touched it, and the next round starts there.
    """
    spark, model = training.sparkSession, LogBilinear(head.class_counts)
    parts = max(1, round(head.total / (SHARE * model.n)))
    h = F.xxhash64("doc_id", "text")
    dealt = training.select("text", h.alias("h"), F.pmod(h, F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64(h, F.lit("part")), F.lit(parts)).alias("part"))

    def learner(shared: Broadcast, k: int) -> Callable[[pa.Table], pa.Table]:
        def run(rows: pa.Table) -> pa.Table:
            own, start = shared.value
            model = copy.deepcopy(start)
            model.random = np.random.default_rng(k + 1)
            for batch in rows.sort_by([("h", "ascending"), ("text", "ascending")]).select(["text"]).combine_chunks().to_batches():
                for _, data, offsets in slices(batch):
                    text_of, _, classes, *_ = own.places(data, offsets)
                    context = contexts(text_of, classes, model.n)
                    mixed = model.random.permutation(len(classes))
                    for i in range(0, len(mixed), BATCH):
                        model.learn(context.take(mixed[i : i + BATCH], axis=0), classes.take(mixed[i : i + BATCH]))
            flat = model.weighted()
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            return pa.table([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["at", "x"])

        return run

    def add(blocks: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(b.as_py(), np.float32).astype(np.float64) for b in blocks.column("x"))
        return pa.table([blocks.column("at").slice(0, 1), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["at", "x"])

    for k in range(ROUNDS if head.total else 0):
        shared = spark.sparkContext.broadcast((head, model))
        learned = dealt.where(F.col("round") == k).groupBy("part").applyInArrow(learner(shared, k), "at int, x binary")
        sums = learned.groupBy("at").applyInArrow(add, "at int, x binary").toArrow().sort_by("at")
        if sums.num_rows:
            model.average(np.frombuffer(b"".join(sums.column("x").to_pylist()), np.float32))
        shared.unpersist()
    model.squares, model.touched, model.random = [], [], None
    return model


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Tokens are the words of ASCII-lower-cased text, then one end. Training
    texts are those not held out, all of them: for the counts and for the
    model. base_score is the unigram model's log10 probability with 0.5 added
    to each count and one unseen token; score is the log-bilinear model's, over
    classes whose number grows with the training tokens: the most frequent, OWN
    times their cube root, by themselves, the others in hashed classes, the
    root of their number, within which the token's smoothed unigram share counts. A null or empty text is one end.
    Without training texts all tokens are unseen. Rows that repeat are scored
    each by itself. A very long text is hashed in segments, its tokens are held
    whole. Other columns don't matter, whatever their names.

    Frequent tokens (at most HEAD) are looked up in the workers; the others'
    counts come by a join on the token, each of which is rare.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    training = given.where(~F.col("held_out"))
    rare, head = gather_counts(training)
    model = train(training, head)
    shared = spark.sparkContext.broadcast((head, model))
    all_size = head.total + 0.5 * (head.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lbl = shared.value
        sizes = own.sizes()
        for batch in batches:
            for rows, data, offsets in slices(batch):
                n = len(offsets) - 1
                text_of, place, classes, starts, ends, low = own.places(data, offsets)
                logs = lbl.log_probabilities(contexts(text_of, classes, lbl.n), classes) / math.log(10)
                known = place >= 0
                counted = np.log10(np.where(known, own.counts[place] if len(own.counts) else 0, 0) + 0.5)
                # Rare words and, where no text taught it, the end get their part of the score by the join.
                logs = logs + np.where(classes >= own.own, np.where(known, counted, 0) - np.log10(sizes)[classes], 0)
                base = np.where(known, counted, 0) - math.log10(all_size)
                each = lambda w: np.bincount(text_of, weights=w, minlength=n)
                ids = rows.column("row").to_pylist()
                tail = Counter(zip(text_of[~known].tolist(), (low[s:e].tobytes() for s, e in zip(starts[~known].tolist(), ends[~known].tolist()))))
                no = [None] * len(tail)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids + [ids[i] for i, _ in tail]), pa.array([b" %d" % i for i in ids] + [w for _, w in tail], pa.binary()),  # no word has a space
                        pa.array([0] * n + list(tail.values()), pa.int64()), pa.array(rows.column("doc_id").to_pylist() + no, pa.int64()), pa.array(rows.column("held_out").to_pylist() + no, pa.bool_()),
                        pa.array(np.bincount(text_of, minlength=n).tolist() + no, pa.int64()), pa.array(each(known).astype(np.int64).tolist() + no, pa.int64()),
                        pa.array(each(base).tolist() + no, pa.float64()), pa.array(each(logs).tolist() + no, pa.float64()),
                    ],
                    ["row", "token", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    parts = given.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "row long, token binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    joined = parts.join(rare, "token", "left")
    share = F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("times")), F.lit(0))).alias("n_known"),
            (F.sum("base_score") + share).alias("base_score"), (F.sum("score") + share).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(head.total).cast("long").alias("train_tokens"), "base_score", "score")
    )
