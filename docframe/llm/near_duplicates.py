"""Near-duplicates by a chosen-path set similarity join over word shingles.

Distinct shingle sets branch through independent trees: a node sends each set
to the child of a selected minwise token, so that sets of similarity s stay
together with probability s a branch. Small nodes are compared exhaustively on
sketches, large ones branch on. What a node holds together becomes a candidate
cluster, in which every link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.components import PART, components
from docframe.llm.storage import add_columns, fresh_names, materialize, materialize_counting, small, small_batches
from docframe.llm.text import BASE, BY_SPACE, LOWER, hashed_words, mix, slices

TREES = 8
LEVELS = 5  # tokens that a path chooses at most
HASHES = TREES + 2 * TREES * (LEVELS - 1)  # each tree has its own token at the root and two at each level below
NODE = 4096  # sets that are compared exhaustively on sketches
BLOCK = 128  # sets that are compared exhaustively in full, or
SHINGLES = 1 << 19  # fewer, of so many shingles together
FEW = 1_000_000  # rows with two longs that may be broadcast


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, sorted within the text, and the bounds of the texts."""
    low = LOWER[data]
    _, _, text_of, hashes = hashed_words(low, offsets, BY_SPACE)
    n_texts = len(offsets) - 1
    words = np.bincount(text_of, minlength=n_texts)
    first = np.append(0, np.cumsum(words))

    def chain(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(BASE) + hashes[at + i])
        return h

    at = np.flatnonzero(text_of[size - 1 :] == text_of[: max(0, len(text_of) - size + 1)]) if len(text_of) >= size else np.empty(0, np.int64)
    found, owner = [chain(at, size)], [text_of[at]]
    for n in range(1, size):
        short = np.flatnonzero(words == n)
        found.append(chain(first[short], n))
        owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    found, bounds = found[order], np.searchsorted(owner[order], np.arange(n_texts + 1))
    sets = [np.unique(found[a:b]) for a, b in zip(bounds, bounds[1:])]
    return np.concatenate([*sets, np.empty(0, np.uint64)]), np.append(0, np.cumsum([len(s) for s in sets]))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least of HASHES hash functions over each non-empty set; a row for each."""
    out = np.zeros((len(bounds) - 1, HASHES), dtype=np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        h = (values >> np.uint64(32)).astype(np.uint32)
        seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
        for k in range(HASHES):
            v = h * seeds[k]
            v ^= v >> np.uint32(16)
            v *= seeds[HASHES + k]
            v ^= v >> np.uint32(15)
            out[some, k] = np.minimum.reduceat(v, bounds[:-1][some])
    return out


def set_ids(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit ids of the sets: two 64-bit sums of hashes of their shingles."""
    halves = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(seed))))
        halves.append(mix((total[bounds[1:]] - total[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64)))
    raw = np.stack(halves, axis=1).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def describe(docs: DataFrame, size: int) -> DataFrame:
    """docs' columns but text with n, sid, signature: the number of shingles, an id of the set, its minwise tokens. Without shingles sid is spread and nothing more."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, data, offsets in slices(batch):
            values, bounds = shingle_sets(data, offsets, size)
            yield from zip(np.diff(bounds).tolist(), set_ids(values, bounds), (r.tobytes() for r in signatures(values, bounds)))

    spread = F.xxhash64("doc_id", F.rand(1)).cast("string").cast("binary")
    return add_columns(docs, "n bigint, sid binary, signature binary", rows, [c for c in docs.columns if c != "text"]).withColumn("sid", F.when(F.col("n") > 0, F.col("sid")).otherwise(spread))


def by_group(key: str, run: Callable[[pa.Table], Iterator[tuple[bytes, bytes]]], names: list[str]) -> Callable:
    """For mapInArrow over partitions sorted by key: run on each group's rows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table.column(key).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            found = [x for a, b in zip(edges, edges[1:]) if b - a > 1 for x in run(table.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names)

        for batch in batches:
            keys = batch.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from groups(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = [batch.slice(cut)]
            elif len(keys):
                if held and held[-1].column(key)[-1].as_py() != keys[0]:
                    yield from groups(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch)
        if held:
            yield from groups(pa.Table.from_batches(held).combine_chunks())

    return over


class Groups:
    """Union-find over places."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = self.top[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.top[max(i, j)] = min(i, j)
        return i != j


def sketches(column: pa.ChunkedArray) -> np.ndarray:
    """The low byte of each minwise token."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES).astype(np.uint8)


def alike(sketch: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of the others, those that may reach percent: their sizes allow it, and no fewer tokens agree than 6 standard deviations below."""
    t = percent / 100
    least = HASHES * t - 6.4 * math.sqrt(HASHES * t * (1 - t))
    near, far = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    others = others[100 * near >= percent * far]
    return others[(sketch[others] == sketch[i]).sum(axis=1) >= least]


def compare_node(percent: int) -> Callable[[pa.Table], Iterator[tuple[bytes, bytes]]]:
    """Candidate links (a, b) that hold together what is alike on sketches in a node: fewer than its sets."""

    def run(node: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        sids, sizes, sketch = node.column("sid").to_pylist(), node.column("n").to_numpy(), sketches(node.column("signature"))
        groups = Groups(len(sids))
        for i in range(len(sids) - 1):
            for j in alike(sketch, sizes, i, np.arange(i + 1, len(sids)), percent).tolist():
                if groups.join(i, j):
                    yield sids[i], sids[j]

    return run


def candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) from TREES trees over distinct sets (sid, n, tokens, signature).

    A node's sets go to one child at the root and to two below it, by tokens
    that no other level or tree uses: trees are independent. Nodes of up to NODE
    sets are compared. At the last
    level what is still larger shares LEVELS tokens on its path and is held
    together whole: no set is dropped, the confirmation splits it.
    """
    token = lambda i: F.substring("signature", 4 * i + 1, F.lit(4))
    roots = F.array(*[F.xxhash64(F.lit(t), token(F.lit(t))) for t in range(TREES)])
    rows = sets.select("sid", "n", "signature", F.posexplode(roots).alias("tree", "node"))
    found = []
    for level in range(1, LEVELS + 1):
        if level > 1:
            rows = materialize(rows.dropDuplicates(["sid", "node"]))
        counts = rows.groupBy("node").agg(F.count("*").alias("held")).where("held > 1")
        counts, seen = materialize_counting(counts, light=F.count_if(F.col("held") <= NODE), heavy=F.count_if(F.col("held") > NODE))
        if seen["light"]:
            light = rows.join(small(counts.where(F.col("held") <= NODE).select("node"), seen["light"], FEW), "node").select("node", "sid", "n", "signature")
            found.append(materialize(light.repartition("node").sortWithinPartitions("node", "sid").mapInArrow(by_group("node", compare_node(percent), ["a", "b"]), "a binary, b binary")))
        if not seen["heavy"]:
            break
        heavy = rows.join(small(counts.where(F.col("held") > NODE).select("node"), seen["heavy"], FEW), "node")
        if level == LEVELS:
            least = heavy.groupBy("node").agg(F.min("sid").alias("b"))
            found.append(heavy.select("node", F.col("sid").alias("a")).join(small(least, seen["heavy"], FEW), "node").where("a <> b").select("a", "b"))
            break
        children = F.array(*[F.xxhash64("node", F.lit(k), token(TREES + 2 * TREES * (level - 1) + 2 * F.col("tree") + k)) for k in range(2)])
        rows = heavy.select("sid", "n", "signature", "tree", F.explode(children).alias("node"))
    out = found[0] if found else sets.sparkSession.createDataFrame([], "a binary, b binary")
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def confirm(percent: int) -> Callable[[pa.Table], Iterator[tuple[bytes, bytes]]]:
    """Links (a, b) with 100 * intersection >= percent * union between sets of different components in a group of rows.

    Where the group has leaders, only pairs with a leader are compared unless
    the rows say that all pairs are due.
    """

    def run(group: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        sids, leader, due = group.column("sid").to_pylist(), group.column("leader").to_numpy(), bool(group.column("all_pairs")[0].as_py())
        shingles = group.column("shingles").combine_chunks()
        flat, edges = shingles.flatten().to_numpy(), shingles.offsets.to_numpy()
        edges = edges - edges[0]
        sets = [flat[a:b] for a, b in zip(edges, edges[1:])]
        sizes, sketch = np.diff(edges), sketches(group.column("signature"))
        groups = Groups(len(sids))
        first: dict[int, int] = {}
        for i, x in enumerate(group.column("part").to_pylist()):
            groups.join(i, first.setdefault(x, i))
        for i in range(len(sids)):
            others = np.arange(i + 1, len(sids))
            if not due and not leader[i]:
                others = others[leader[others]]
            for j in alike(sketch, sizes, i, others, percent).tolist():
                if groups.find(i) != groups.find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        groups.join(i, j)
                        yield sids[i], sids[j]

    return run


def confirmed_components(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the links of percent within each cluster; ids without a link are left out.

    clusters: (sid, cluster, n). Clusters of up to BLOCK sets and SHINGLES
    shingles are compared whole. A larger one is cut into blocks; in the first round all pairs of a block
    and all pairs with some leaders, who join every block, are compared. Then
    the sets outside the cluster's largest component take their turn as
    leaders, till each has met the whole cluster or has joined that component:
    no pair of two components is left uncompared.
    """
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("long").alias("blocks"))
    members = clusters.drop("n").join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    members, seen = materialize_counting(members, heavy=F.count_if(F.col("blocks") > 1))
    n_heavy = seen["heavy"]
    few = n_heavy // PART + 1  # tasks for what is small beside the sets

    def compared(rows: DataFrame) -> DataFrame:
        """rows: sid, cluster, block, part, leader, all_pairs"""
        full = rows.join(sets, "sid").withColumn("unit", F.xxhash64("cluster", "block")).repartition("unit").sortWithinPartitions("unit", F.desc("leader"), "sid")
        return materialize(full.select("unit", "sid", "leader", "all_pairs", "part", "signature", "shingles").mapInArrow(by_group("unit", confirm(percent), ["a", "b"]), "a binary, b binary"))

    def with_leaders(rows: DataFrame, chosen: DataFrame, all_pairs: bool) -> DataFrame:
        """chosen: sid, cluster, blocks, part; they go to each block of their cluster."""
        led = chosen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        plain = rows.join(chosen.select("sid", F.lit(True).alias("chosen")), "sid", "left").where("chosen is null")
        return plain.select("sid", "cluster", "block", "part", F.lit(False).alias("leader"), F.lit(all_pairs).alias("all_pairs")).unionByName(
            led.select("sid", "cluster", "block", "part", F.lit(True).alias("leader"), F.lit(all_pairs).alias("all_pairs"))
        )

    def first_of(rows: DataFrame, n: int) -> DataFrame:
        """n rows of each cluster; a share of each block's rows is weighed first, so that no task ranks a whole cluster."""
        rows = rows.withColumn("turn", F.xxhash64("sid", F.lit(7)))
        in_block = Window.partitionBy("cluster", "block").orderBy("turn", "sid")
        some = rows.withColumn("r", F.row_number().over(in_block)).where(F.col("r") <= n)
        best = some.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "sid"))), 1, n).alias("best"))
        return some.join(best.select(F.explode("best").alias("x")).select(F.col("x.sid").alias("sid")), "sid", "left_semi").drop("turn", "r")

    heavy = members.where("blocks > 1")
    start = members.withColumn("part", F.col("sid"))
    chosen = materialize(first_of(start.where("blocks > 1"), 64).select("sid", "cluster", "blocks", "part").coalesce(few)) if n_heavy else None
    links = compared(with_leaders(start, chosen, True) if n_heavy else start.select("sid", "cluster", "block", "part", F.lit(False).alias("leader"), F.lit(True).alias("all_pairs")))
    if not n_heavy:
        return components(links)
    done = chosen.select("sid")
    while True:
        parts = components(links)
        now = materialize(heavy.join(parts.withColumnRenamed("id", "sid"), "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component").coalesce(few))
        largest = now.groupBy("cluster", "part").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("part", F.struct("c", "part")).alias("largest"))
        waiting = now.join(F.broadcast(largest) if n_heavy <= FEW else largest, "cluster").where("part <> largest").join(done, "sid", "left_anti")
        chosen, seen = materialize_counting(first_of(waiting.coalesce(few), 256).select("sid", "cluster", "blocks", "part").coalesce(few), n=F.count("*"))
        n = seen["n"]
        if not n:
            return parts
        due = now.join(small(chosen.select("cluster").distinct(), n, FEW), "cluster", "left_semi")
        links = materialize(links.unionByName(compared(with_leaders(due, chosen, False))))
        done = materialize(done.unionByName(chosen.select("sid")).coalesce(few))


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """docs' columns but text, with n, component (an id of the class, null for rows that take no part) and component_id, for docs with doc_id and text."""
    small_batches(docs.sparkSession)
    described = materialize(describe(docs, shingle))
    real = described.where("n > 0 and doc_id is not null")
    sets = materialize(real.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("signature").alias("signature")))
    found = components(candidate_links(sets, percent)).select(F.col("id").alias("sid"), F.col("component").alias("cluster"))
    clusters, seen = materialize_counting(sets.join(found, "sid").select("sid", "cluster", "n", "rep", "signature"), n=F.count("*"))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, data, offsets in slices(batch):
            values, bounds = shingle_sets(data, offsets, shingle)
            for sid, a, b in zip(set_ids(values, bounds), bounds, bounds[1:]):
                yield sid, values[a:b].view(np.int64)

    if seen["n"]:
        wanted = clusters.select("rep", F.col("sid").alias("of"), "signature")
        texts = docs.select(F.col("doc_id").alias("rep"), "text").join(small(wanted, seen["n"], FEW // 20), "rep")
        full = add_columns(texts, "sid binary, shingles array<bigint>", rows, ["of", "signature"]).where("sid = of").dropDuplicates(["sid"])
        parts = confirmed_components(clusters.select("sid", "cluster", "n"), materialize(full.select("sid", "signature", "shingles")), percent).withColumnRenamed("id", "sid")
    else:
        parts = docs.sparkSession.createDataFrame([], "sid binary, component binary")
    joined = sets.select("sid", "rep", "copies").join(parts, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    linked = joined.join(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("all")), "component")
    linked, seen = materialize_counting(linked.where("all > 1").select("sid", "component", "component_id"), n=F.count("*"))
    out = described.join(small(linked, seen["n"], FEW), "sid", "left")
    takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    names = [c for c in docs.columns if c != "text"]
    return out.select(*names, "n", F.when(takes_part, F.coalesce("component", "sid")).alias("component"), F.when(takes_part, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Two documents are linked if the sets of their distinct word shingles have
    100 * intersection >= percent * union; a text of fewer words is one
    shingle, a null, empty or wordless one is linked with nothing.
    component_id is the least doc_id that links reach; kept says whether it is
    the row's own. Rows of equal doc_id count as one document where their texts
    agree. A null doc_id takes no part: its component_id is null, and it is
    kept. Other columns don't matter.

    Sets are equal by two independent 64-bit sums over their shingles' 64-bit
    hashes; other links are confirmed on the full sets of these hashes. A pair
    of similarity s meets in a tree with probability s in nodes of up to NODE
    sets below the root, and with s * (1 - (1 - s)^2)^d in those of depth d; all
    TREES miss a pair at 0.85 with probability 2.6e-7, at the deepest level
    6e-6, at 0.8 with 2.6e-6 and 4e-5, and less above.
    """
    found = classes(docs.select("doc_id", "text"), shingle, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each class of near-duplicates (see near_duplicates): the one with the least doc_id stays.

    Rows are told apart by doc_id and text: of rows with one doc_id and
    different texts each is judged by its own text; rows that repeat both are
    one, and one of them stays. Rows with a null doc_id, and those with a null,
    empty or wordless text, all stay as they are. All columns stay, whatever
    their names.
    """
    (text_hash,) = fresh_names(docs, "text_hash")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    found = materialize(classes(keyed.select("doc_id", F.col(text_hash).alias("text_hash"), "text"), shingle, percent).where("component is not null"))
    first, seen = materialize_counting(found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("held")).where("held > 1").drop("held"), n=F.count("*"))
    several = found.join(small(first, seen["n"], FEW), "component")
    is_first = F.struct("doc_id", "text_hash") == F.col("first")
    counted = several.groupBy("doc_id", "text_hash", is_first.alias("is_first")).agg(F.count("*").alias("held"))
    named = counted.withColumnRenamed("text_hash", text_hash)
    named, seen = materialize_counting(named.where("not is_first or held > 1"), gone=F.count_if(~F.col("is_first")), twice=F.count_if("is_first"))
    key = ["doc_id", text_hash]
    out = keyed.join(small(named.where("not is_first").select(*key), seen["gone"], FEW), key, "left_anti")
    if seen["twice"]:
        twice = small(named.where("is_first").select(*key), seen["twice"], FEW)
        out = out.join(twice, key, "left_anti").unionByName(out.join(twice, key, "left_semi").dropDuplicates(key))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
