"""Filters audited against one another: what each removes in any order, alone or together, and its Shapley share.

A document's failures are a mask over the filters. The documents that a set of
filters removes from a part are a polynomial over the filters, multilinear in
switches x_i of 0 or 1:

    f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i))

All figures follow from it: at a corner it is what the filters of the corner
remove, and a filter's Shapley value is the integral of its partial derivative
along the diagonal from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.storage import fresh_names

SPACES = r"[\x20\x09-\x0D]+"
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
ROWS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions of the filters that a text fails on by itself; words: the array of its words."""
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


COPY = "E"  # identical to the text of a smaller doc_id


class Removal:
    """The removal polynomial of counts by mask: coefficients[S] is that of the product of the x_i in S (a mask too)."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, every = size, range(1 << size)
        self.coefficients = [0] + [(-1) ** (s.bit_count() + 1) * sum(n for m, n in counts.items() if m & s == s) for s in every[1:]]

    def corner(self, on: int) -> int:
        """The documents that the filters of the mask remove together."""
        return sum(c for s, c in enumerate(self.coefficients) if s & on == s)

    def corners(self) -> list[int]:
        return [self.corner(on) for on in range(1 << self.size)]

    def shapley(self, i: int) -> Fraction:
        """The integral of the partial derivative by x_i over x = (t, ..., t), t from 0 to 1: the product of a term's other x is t^(|S|-1)."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if s >> i & 1), Fraction(0))


def audit_rows(total: int, counts: dict[int, int], good: dict[int, int], toxic: dict[int, int], names: str) -> Iterator[tuple]:
    """(filter_order, step, the columns of COUNTS) of a part with these documents by mask."""
    size = len(names)
    every = Removal(counts, size)
    removed, lost, bad = every.corners(), Removal(good, size).corners(), Removal(toxic, size).corners()
    full = (1 << size) - 1
    fails, alone, shares = [], [], []
    for i in range(size):
        fails.append(removed[1 << i])
        alone.append(removed[full] - removed[full ^ 1 << i])
        share = every.shapley(i) * factorial(size)
        if share.denominator != 1:
            raise ArithmeticError(f"a sum over all orders is a whole number, not {share}")
        shares.append(int(share))
    for order in permutations(range(size)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield "".join(names[j] for j in order), step, total - removed[after], here, fails[i] - here, alone[i], lost[after] - lost[before], bad[after] - bad[before], shares[i]
            before = after


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters they fail on.

    Copies are found without bringing those of a text together: rows are
    summed by text, source and labels, then the least doc_id of each text is
    taken over these sums.
    """
    text, words, bare, doc, part, mask, key, salt = fresh_names(docs, "text", "words", "bare", "doc", "part", "mask", "key", "salt")
    given = docs.select(F.col("doc_id").alias(doc), F.coalesce(F.col("source").cast("string"), F.lit("")).alias(part), F.coalesce("text", F.lit("")).alias(text))
    cut = given.withColumn(words, F.split(text, SPACES)).withColumn(bare, F.array_remove(words, ""))
    failures = text_failures(F.col(text), F.col(bare))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures.values())), F.lit(0))
    flagged = cut.select(doc, part, F.unhex(F.sha2(text, 256)).alias(key), bits.alias(mask))
    # Rows without a doc_id match no label; the salt keeps them from meeting in one task.
    flagged = flagged.withColumn(salt, F.when(F.col(doc).isNull(), F.xxhash64(key, part, mask)).otherwise(F.lit(0).cast("long")))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("none", F.lit(0).cast("long"))
    joined = flagged.join(marked, (F.col(doc) == F.col("of")) & (F.col(salt) == F.col("none")), "left")
    kinds = [key, part, mask, "good", "toxic"]
    rows = joined.select(key, part, mask, doc, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]).groupBy(*kinds, doc).agg(F.count("*").alias("n"))
    known = F.col(doc).isNotNull()
    summed = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"), F.min(F.when(known, F.struct(F.col(doc).alias("id"), "n"))).alias("least"))
    least = F.min("least.id").over(Window.partitionBy(key))  # a row for each source and label of a text
    copies = summed.withColumn("__least", least).withColumn("copies", F.col("known") - F.when(F.col("least.id") == F.col("__least"), F.col("least.n")).otherwise(F.lit(0)))
    own = 1 << len(failures)
    split = F.explode(F.array(F.struct(F.col(mask).alias("mask"), (F.col("n") - F.coalesce("copies", F.lit(0))).alias("n")), F.struct((F.col(mask) + own).alias("mask"), F.coalesce("copies", F.lit(0)).alias("n"))))
    return (
        copies.select(F.col(part).alias("part"), "good", "toxic", split.alias("x")).groupBy("part", F.col("x.mask").alias("mask"))
        .agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source), order of the five filters and step: the columns of COUNTS, see audit_rows.

    docs: doc_id, source, text; labels: doc_id, quality, toxic. A null text
    counts as an empty one, a null source as the part ''. Rows count each, also
    with a doc_id that repeats (its rows aren't copies of one another); a row
    without doc_id has no label, is no copy, and nothing is a copy of it. Of
    labels that repeat, one with a 1 is enough; those with nulls mark nothing.
    Other columns of docs are ignored; empty docs give no rows.
    """
    names = "ABCD" + COPY
    by_part = failure_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(*(batch.column(c).to_pylist() for c in ("part", "masks"))):
                of = lambda c: {m["mask"]: m[c] for m in masks if m[c]}
                made = [(part, *x) for x in audit_rows(sum(m["n"] for m in masks), of("n"), of("good"), of("toxic"), names)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made), [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(rows, ROWS)
