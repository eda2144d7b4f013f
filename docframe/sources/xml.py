"""Elements of XML texts at any depth, as rows; a text that can't be parsed is a row too."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def elements(text: str, tag: str, fields: dict[str, str]) -> Iterator[dict[str, str]]:
    """Of each element with this tag, in the order in which they begin: every field's text, of the first element of its tag at any depth below, with all text in that one, stripped; '' where there is none.

    The text is read as a stream; only the open elements with the tag, of which
    one may hold others, are kept, and what lies outside of them is dropped.
    """
    parser = ET.XMLPullParser(("start", "end"))
    value = lambda node, name: "".join(found.itertext()).strip() if (found := node.find(f".//{name}")) is not None else ""
    open_tags, waiting, path = 0, [], []
    for at in range(0, len(text) + (1 << 16), 1 << 16):
        if at < len(text):
            parser.feed(text[at : at + (1 << 16)])
        else:
            parser.close()
        for event, node in parser.read_events():
            if event == "start":
                path.append(node)
                if node.tag == tag:
                    open_tags += 1
                    waiting.append([node, None])
                continue
            path.pop()
            if node.tag == tag:
                open_tags -= 1
                next(w for w in reversed(waiting) if w[0] is node)[1] = {c: value(node, name) for c, name in fields.items()}
            if not open_tags:
                yield from (w[1] for w in waiting)
                waiting = []
                if path:  # done with: neither it nor what it holds is needed again
                    path[-1].remove(node)
                    path[-1].text = None


def read_elements(texts: DataFrame, tag: str, fields: dict[str, str], keys: list[str], text: str = "text") -> DataFrame:
    """(keys, position, fields, error): a row for each element of each text, from 0, and one with an error, in place of the rest, where the XML is broken or the text null.

    What stands before the fault has its rows. Fields are strings, see elements.
    """
    kept = texts.select(*keys, text)
    schema = T.StructType([kept.schema[k] for k in keys] + [T.StructField("position", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in (*fields, "error")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(text)):
                found: list[dict] = []
                try:
                    for node in elements(value.as_py() or "", tag, fields):
                        found.append(node | {"error": None})
                except ET.ParseError as e:
                    found.append(dict.fromkeys(fields) | {"error": str(e)})
                own = batch.slice(i, 1)
                columns = [own.column(k).take(pa.array([0] * len(found), pa.int32())) for k in keys]
                made = [pa.array(range(len(found)), pa.int32()), *[pa.array([f[c] for f in found], pa.string()) for c in (*fields, "error")]]
                if found:
                    yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)

    return kept.mapInArrow(rows, schema)


def read_nodes(spark, path: str, tag: str, fields: list[str]) -> DataFrame:
    """(path, position, fields, error) of the tag's elements in the XML files under path, each file whole in one task."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return read_elements(texts, tag, {c: c for c in fields}, ["path"])
