"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, pseudorandom block permutations. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.storage import materialize, materialize_counting

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in text; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def permuted(i: Column, n: Column, key: list[Column], rounds: int = 24) -> Column:
    """The place of i under a pseudorandom permutation of 0 to n - 1: a swap-or-not shuffle, a bijection for any n."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        swap = F.pmod(F.xxhash64(r, F.greatest(x, partner), *key), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, turn)


def picked(points: DataFrame, parts: DataFrame, total: int, n_parts: int) -> DataFrame:
    """points (column v in 0 to total - 1) with the columns of the part (low <= v < high) that holds v: an equal join on slices of the range."""
    slices = 4 * max(1, n_parts)
    at = lambda c: F.floor(c * F.lit(slices) / F.lit(float(total))).cast("long")
    held = parts.where("high > low").withColumn("slice", F.explode(F.sequence(at(F.col("low")), at(F.col("high") - 1))))
    return points.withColumn("slice", at(F.col("v"))).join(held, "slice").where("v >= low and v < high").drop("slice")


@dataclass
class Mix:
    """sources: skey, source_size, target, n_blocks, quota. placed: a row for each document, its first word's place (start) among its source's. slots: what each output shard takes at each position."""

    sources: DataFrame
    placed: DataFrame
    slots: DataFrame
    docs: DataFrame
    block_words: int
    seed: int


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources by code point, null last, weigh weights in turn, and share the sum
    of all sizes. A target stops at max_epochs times its source's size; the
    excess goes to the others by weight till none is above. In closed form: with
    the sources ordered by that cap a unit of weight, those before some place
    get their caps and the rest one common multiple of their weights.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("total") - F.col("capped")) / (F.col("all_weights") - F.col("weight_before"))
    return (
        sizes.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("total", F.sum("source_size").over(all_rows).cast("double")).withColumn("all_weights", F.sum("weight").over(all_rows))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level).withColumn("under", F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level")))
        .withColumn("level", F.coalesce(F.first("under", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
        .withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def dealt(docs: DataFrame, seed: int) -> Column:
    """A document's pseudorandom turn within its source; rows of equal doc_id and text share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 128, shard_slots: int = 8192, seed: int = 20240607) -> Mix:
    """The mix of docs (doc_id, text, source) as tables; see source_targets for the targets.

    The words of a source, its documents in a pseudorandom order, are packed
    into blocks of block_words (its last may be shorter). Output shards have
    shard_slots slots. The sources' quotas of blocks are drawn without
    replacement over all slots, by one pseudorandom permutation of them: a
    shard's counts are multinomial given the sums over all shards, which are
    the quotas. The place in a source's quota that a slot draws is its number
    there; numbers pass through a permutation of the source's blocks, a new one
    for each epoch: no block is taken more than max_epochs times.

    All is derived from hashes and seed: reruns agree. Rows of equal doc_id are
    rows of their own; null, empty and blank texts are in no block. A null
    source is a source. Extra columns don't matter, whatever their names. Empty
    docs give empty tables. Texts aren't moved here: only sizes are. The
    sources' table, a row each, is ordered and summed in one task: it is meant
    for thousands of sources, not for a source of each host.
    """
    spark = docs.sparkSession
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), skey.alias("skey"), word_count(F.col("text")).alias("size"), dealt(docs, seed).alias("dealt"))
    base, seen = materialize_counting(base, rows=F.count("*"))
    base = base.withColumn("bucket", F.pmod("dealt", F.lit(max(1, math.isqrt(seen["rows"])))))
    sums = materialize(base.groupBy("source", "skey", "bucket").agg(F.sum("size").alias("words")))
    sizes = sums.groupBy("source", "skey").agg(F.sum("words").alias("source_size"))
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    skey_again = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sources = source_targets(sizes, weights, max_epochs).withColumn("skey", skey_again).withColumn("n_blocks", n_blocks).withColumn("quota", quota)
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)  # a row for each source
    sources = materialize(sources.withColumn("high", F.sum("quota").over(upto)).withColumn("low", F.col("high") - F.col("quota")))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()

    # Places: counts of the buckets before, then those of the bucket's own rows.
    so_far = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("words").over(so_far), F.lit(0))).join(sources.select("skey", "source_size", "target"), "skey").drop("source", "words")
    in_bucket = Window.partitionBy("skey", "bucket").orderBy("dealt", "doc_id", "size")
    before = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = base.withColumn("place", F.row_number().over(in_bucket)).withColumn("before", before).join(starts.hint("merge"), ["skey", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("before")).drop("bucket_start", "before")

    slots = picked(
        spark.range(total).select("id", permuted(F.col("id"), F.lit(max(1, total)), [F.lit(seed)]).alias("v")), sources.select("skey", "n_blocks", "low", "high"), max(1, total), n_sources
    ).withColumn("number", F.col("v") - F.col("low")).withColumn("epoch", F.floor(F.col("number") / F.col("n_blocks")))
    block = permuted(F.pmod("number", F.col("n_blocks")), F.col("n_blocks"), [F.lit(seed), F.col("skey"), F.col("epoch")])
    slots = slots.select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("position"), "skey", "number", "epoch", block.alias("block"))
    return Mix(sources, placed, slots, docs, block_words, seed)


def words_taken(mix: Mix) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken (its words in the mix, repeats counted)."""
    uses = mix.slots.groupBy("skey", "block").agg(F.count("*").alias("uses"))
    first, last = F.floor(F.col("start") / mix.block_words), F.floor((F.col("start") + F.col("size") - 1) / mix.block_words)
    nowhere = -1 - F.pmod("dealt", F.lit(1 << 30))  # documents without words are in no block, and not all on one key
    pieces = mix.placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(nowhere))))
    words = F.least((F.col("block") + 1) * mix.block_words - F.col("start"), F.col("size")) - F.greatest(F.col("block") * mix.block_words - F.col("start"), F.lit(0))
    key = ["skey", "bucket", "place", "doc_id", "source", "size", "source_size", "target"]
    counted = pieces.select(*key, "block", words.alias("words")).join(uses.hint("merge"), ["skey", "block"], "left")
    return counted.groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken")).drop("skey", "bucket", "place")


def block_texts(mix: Mix) -> DataFrame:
    """(skey, block, source, n_words, text, doc_ids): each block's words, its documents one after the other, with the space after each word.

    A text is read once, cut into its words once, and only its slices by block
    are shuffled to the blocks. Texts that repeat with their doc_id are cut
    once for all their places.
    """
    size = mix.block_words
    starts = mix.placed.where("size > 0").groupBy("doc_id", "dealt").agg(F.collect_list(F.struct("skey", "source", "start", "place", "size")).alias("places"))
    docs = mix.docs.select("doc_id", "text", dealt(mix.docs, mix.seed).alias("dealt")).where(word_count(F.col("text")) > 0)
    keyed = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "dealt"]
    once = docs.select(*keyed, "text").groupBy("id", "dealt").agg(F.first("text").alias("text"))
    texts = starts.select(*keyed, "doc_id", "places").join(once.hint("merge"), ["id", "dealt"])
    # Up to `start` words are skipped, then a block's are taken: the text's own spacing stays.
    words = texts.select("doc_id", F.explode("places").alias("at"), F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), 0).alias("words"))

    def piece(block: Column) -> Column:
        begin, end = F.greatest(block * size - F.col("at.start"), F.lit(0)), F.least((block + 1) * size - F.col("at.start"), F.col("at.size"))
        cut = F.array_join(F.slice("words", (begin + 1).cast("int"), (end - begin).cast("int")), "")
        return F.struct(block.alias("block"), (end - begin).alias("n"), cut.alias("cut"))

    first, last = F.floor(F.col("at.start") / size), F.floor((F.col("at.start") + F.col("at.size") - 1) / size)
    pieces = words.select("doc_id", "at", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    cut = F.col("p.cut")
    ended = F.concat(F.rtrim(cut, F.lit(SPACES)), F.when(F.regexp_like(cut, F.lit("[\\x0A\\x0D][\\x20\\x09-\\x0D]*$")), "\n").otherwise(" "))
    parts = pieces.select(F.col("at.skey").alias("skey"), "p.block", F.col("at.source").alias("source"), F.struct("at.start", "at.place", "doc_id", "p.n", ended.alias("cut")).alias("part"))
    packed = parts.groupBy("skey", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list("part")).alias("parts"))
    n_words = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"])
    return packed.select("skey", "block", "source", n_words.alias("n_words"), F.array_join(F.transform("parts", lambda p: p["cut"]), "").alias("text"), F.col("parts.doc_id").alias("doc_ids"))


def mixed_blocks(mix: Mix) -> DataFrame:
    """The mix itself: shard, position, source, block, epoch, n_words, text, doc_ids, a row for each slot."""
    return mix.slots.join(block_texts(mix).hint("merge"), ["skey", "block"]).select("shard", "position", "source", "block", "epoch", "n_words", "text", "doc_ids")
