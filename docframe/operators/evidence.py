"""Quotes located in their sources: exactly, or with spaces ignored, in the source's coordinates. Expressions, but for the search of many quotes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.compat import SPACE, strip
from docframe.operators.literals import BLOCK_CHARS, Finder, OnceAWorker, blocks

SPAN = "struct<quote:string,offset:bigint,length:bigint,found:boolean>"
SEED = 24  # characters of a quote, spaces left out, that an automaton holds


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use refers to it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bare(c: Column) -> Column:
    """Without any space."""
    return F.regexp_replace(c, f"{SPACE}+", "")


def locate(quote: Column, source: Column) -> Column:
    """A struct {quote, offset, length, found}: where the stripped quote is first, or else where it is with spaces ignored on both sides.

    A null or blank quote gives nulls; where it isn't found, offset is -1 and
    length 0. The second search is one expression: the quote's characters with
    any spaces between them.
    """
    between = f"{SPACE}*".replace("\\", "\\\\")

    def with_quote(q: Column) -> Column:
        exact = F.position(q, source)
        characters = F.regexp_replace(bare(q), r"(?s)(.)", r"\\Q$1\\E")
        pattern = F.concat(F.lit("(?s)^(.*?)("), F.regexp_replace(characters, r"\\E\\Q", rf"\\E{between}\\Q"), F.lit(")"))
        nothing = F.struct(q.alias("quote"), F.lit(-1).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit(False).alias("found"))
        at = lambda offset, length: F.struct(q.alias("quote"), offset.cast("long").alias("offset"), length.cast("long").alias("length"), F.lit(True).alias("found"))
        loose = once(F.array(*[F.call_function("regexp_extract", source, pattern, F.lit(i)) for i in (1, 2)]), lambda m: F.when(m[1] == "", nothing).otherwise(at(F.length(m[0]), F.length(m[1]))))
        loose = F.when(F.contains(bare(source), bare(q)), loose).otherwise(nothing)
        return F.when(q == "", F.lit(None).cast(SPAN)).when(exact > 0, at(exact - 1, F.length(q))).otherwise(F.when(source.isNull(), nothing).otherwise(loose))

    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("quote", "string"), ("offset", "bigint"), ("length", "bigint"), ("found", "boolean"))])
    return F.coalesce(once(strip(F.coalesce(quote, F.lit(""))), with_quote), empty)


def occurs(quote: Column, squeezed: Column) -> Column:
    """Whether locate would find the quote in a source, given without its spaces."""
    return (F.length(bare(quote)) > 0) & F.contains(squeezed, bare(quote))


def surviving_quotes(quotes: Column, source: Column) -> Column:
    """The entries of a map whose value occurs in the source, values as they are."""
    return once(bare(source), lambda s: F.map_filter(quotes, lambda _, v: F.coalesce(occurs(v, s), F.lit(False))))


def excerpt(text: Column, begin: Column, length: Column, radius: int = 140) -> Column:
    """The text around a span, spaces collapsed."""
    first = F.greatest(F.lit(0), begin - radius)
    last = F.least(F.length(text), begin + length + radius)
    return F.btrim(F.regexp_replace(F.substring(text, first + 1, last - first), f"{SPACE}+", " "))


def joined_source(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """One text of a key's chunks in order, three dashes on a line between them; offsets are relative to it."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n---\n").alias("text"))


def attach_evidence(items: DataFrame, quote: str = "evidence", source: str = "text", children: str = "children") -> DataFrame:
    """items with evidence_span, and each of their children with its own; what isn't found stays, marked so."""
    out = items.withColumn("evidence_span", locate(F.col(quote), F.col(source)))
    if children in items.columns:
        out = out.withColumn(children, F.transform(children, lambda c: c.withField("evidence_span", locate(c[quote], F.col(source)))))
    return out


def evidence_rate(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("evidence_span.found")).alias("found"), F.count("evidence_span.quote").alias("quoted"))


#: The code points of SPACE.
SPACES = np.array([*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


class Quotes:
    """Quotes of a block, looked up by their first SEED characters without spaces."""

    def __init__(self, quotes: list[str]):
        self.stripped = [q.strip() for q in quotes]
        self.bare = ["".join(q.split()) for q in quotes]
        self.finder = Finder(b[:SEED] for b in self.bare)

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number, offset, length) of each quote that the text has: where it is first as it stands, or else with spaces ignored."""
        bare = "".join(text.split())
        first: dict[int, int] = {}
        for start, numbers in self.finder.hits(bare):
            for i in numbers:
                if i not in first and bare.startswith(self.bare[i], start):
                    first[i] = start
        kept = None
        for i, start in first.items():
            at = text.find(self.stripped[i])
            if at >= 0:
                yield i, at, len(self.stripped[i])
                continue
            if kept is None:
                kept = np.flatnonzero(~np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), SPACES))
            begin, last = int(kept[start]), int(kept[start + len(self.bare[i]) - 1])
            yield i, begin, last - begin + 1


def find_quotes(quotes: DataFrame, docs: DataFrame, quote_key: str, key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, quote_key, offset, length) of each quote (quote_key, quote) in each document (key, text) that has it, spaces ignored; as locate has them.

    The quotes come to the driver in blocks of about block_chars characters;
    each block is broadcast and searched for by one automaton in a pass over the
    documents, which are neither shuffled nor joined. Short quotes are looked
    for like long ones. Every document row has a row for each quote row that it
    holds, whatever repeats; blank and null quotes, and null texts, have none.
    """
    spark = docs.sparkSession
    asked = quotes.select(quote_key, "quote").where(F.length(bare(F.col("quote"))) > 0)
    schema = T.StructType([docs.schema[key], quotes.schema[quote_key], T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    texts = docs.select(key, "text").where("text is not null")

    def search(block: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        made = OnceAWorker(lambda: Quotes(shared.value.column("quote").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = shared.value.column(quote_key).combine_chunks()
            for batch in batches:
                found = [(row, *hit) for row, text in enumerate(batch.column("text").to_pylist()) for hit in made().find(text)]
                row, number, offset, length = zip(*found) if found else ((),) * 4
                columns = [batch.column(key).take(pa.array(row, pa.int64())), names.take(pa.array(number, pa.int64())), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return texts.mapInArrow(run, schema)

    found = [search(block) for block in blocks(asked, "quote", block_chars)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
