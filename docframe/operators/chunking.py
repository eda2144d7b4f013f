"""Overlapping chunks of documents, in the documents' own coordinates."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bounds of a request for chunks.
SIZES, OVERLAPS = (100, 4000), (0, 1000)
PART_CHARS = 1 << 20  # of the chunks that a worker holds at once


def chunk_spans(text: str, size: int = 700, overlap: int = 120) -> list[tuple[int, int]]:
    """Begin and end of each chunk that isn't blank.

    A chunk that doesn't reach the end stops after the last newline of its
    fourth quarter, if there is one. The next begins overlap before its end.
    """
    stops = (np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10) + 1).tolist()
    shared = min(max(overlap, 0), size - 1)

    def span(begin: int) -> tuple[int, int]:
        full = begin + size
        if full >= len(text):
            return begin, len(text)
        last = bisect_right(stops, full) - 1
        return begin, stops[last] if last >= 0 and stops[last] > begin + size * 3 // 4 else full

    spans = [span(0)] if text else []
    while spans and spans[-1][1] < len(text):
        begin, end = spans[-1]
        spans.append(span(max(begin + 1, end - shared)))
    return [(a, b) for a, b in spans if not text[a:b].isspace()]


def check_request(size: int, overlap: int) -> None:
    """ValueError for sizes and overlaps that no request may ask for."""
    for name, value, (least, most) in (("size", size, SIZES), ("overlap", overlap, OVERLAPS)):
        if not least <= value <= most:
            raise ValueError(f"{name} must be between {least} and {most}")


def request_problem(size: Column, overlap: Column) -> Column:
    """What check_request would say of a row's request, null where it is fine; a null size or overlap is the default one."""
    told = [F.when(~c.between(*bounds), f"{name} must be between {bounds[0]} and {bounds[1]}") for name, c, bounds in (("size", size, SIZES), ("overlap", overlap, OVERLAPS))]
    return F.coalesce(*told)


def chunk_batches(batch: pa.RecordBatch, size: int, overlap: int, limit: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """(key, offset, length, text) of the chunks of (key, text), in batches that are ended once they have limit characters."""

    def made() -> pa.RecordBatch:
        columns = list(zip(*spans)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [batch.schema.names[0], "offset", "length", "text"]
        )

    rows, spans, held = [], [], 0
    for i, text in enumerate(batch.column(1)):
        text = text.as_py() or ""
        for a, b in chunk_spans(text, size, overlap):
            rows.append(i)
            spans.append((a, b - a, text[a:b]))
            held += b - a
            if held >= limit:
                yield made()
                rows, spans, held = [], [], 0
    yield made()


def chunk_documents(docs: DataFrame, size: int = 700, overlap: int = 120, key: str = "doc_id") -> DataFrame:
    """(key, offset, length, text) of each chunk of docs' text, offsets and lengths in code points.

    substring(document, offset + 1, length) is the chunk. Null and blank texts
    have no chunks. One pass, linear in a text's length; no shuffle. A worker
    hands its chunks on in parts of about PART_CHARS characters.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from chunk_batches(batch, size, overlap)

    schema = T.StructType([T.StructField(key, kind), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("text", T.StringType())])
    return docs.select(key, "text").mapInArrow(run, schema)
