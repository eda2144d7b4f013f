"""Text vectors and exact cosine search."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.operators.chunking import check_request, chunk_documents, chunk_spans
from docframe.operators.literals import OnceAWorker

Encoder = Callable[[list[str]], np.ndarray]


@lru_cache(1 << 18)
def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


class HashedEncoder:
    """Unit vectors of word counts in dim buckets by md5: deterministic, without meaning. A stand-in where no model is at hand."""

    name = "hashed"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall("[a-z0-9]+", text.lower()):
                row[_bucket(word, self.dim)] += 1
        return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-300)


class Resident:
    """An encoder that each Python worker loads on first use and keeps for later tasks: what goes with a job is only how to load it.

    load: from the local path of the artefact to an encoder. The artefact, a
    file or folder in any store that Spark reads, is shipped once to each
    executor; without one, load gets ''. dim and name are the encoder's.
    """

    def __init__(self, spark: SparkSession, load: Callable[[str], Encoder], name: str, artefact: str | None = None):
        self.name = name
        if artefact:
            spark.sparkContext.addFile(artefact, recursive=True)
        file = os.path.basename(artefact.rstrip("/")) if artefact else ""
        self.get = OnceAWorker(lambda: load(SparkFiles.get(file) if file else ""))

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.get()(texts)


def encode(encoder: Encoder) -> Callable[[Column], Column]:
    """A column of unit vectors; the encoder is called by Arrow batch."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder([t or "" for t in texts])))

    return vectors


def embed_requests(requests: DataFrame, encoder: Encoder, key: str, texts: str = "texts") -> DataFrame:
    """(key, model, dim, vectors) of each request, an array of texts: a vector for each, in order. Without texts the model is '' and dim 0; null texts are empty ones. A batch of requests is encoded at once."""
    schema = T.StructType([requests.schema[key], *T.StructType.fromDDL("model string, dim int, vectors array<array<double>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column(texts).to_pylist()]
            flat = [t or "" for x in lists for t in x]
            made, at, found = encoder(flat) if flat else [], 0, []
            for x in lists:
                own = [v.tolist() for v in made[at : at + len(x)]]
                found.append((encoder.name if own else "", len(own[0]) if own else 0, own))
                at += len(x)
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.list_(pa.float64()))))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], schema.names)

    return requests.select(key, texts).mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """The cosine of unit vectors to 6 places; 0 where one is null."""
    return F.round(F.coalesce(dot(a, b), F.lit(0.0)), 6)


BLOCK_BYTES = 1 << 25  # of a block of queries, and of the scores of a step


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; null vectors, and those of another length or with nulls, are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    good = np.flatnonzero(sizes == dim)
    if len(good):
        rows = flat[begin[good][:, None] + np.arange(dim)]
        out[good] = np.where(np.isnan(rows).any(axis=1)[:, None], 0.0, rows)
    return out


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a column for each of ids; -inf takes no part."""
        k = self.scores.shape[1]
        hopeful = np.flatnonzero((scores >= self.scores[:, -1:]).any(axis=0) & (scores > -np.inf).any(axis=0))
        if not len(hopeful):
            return
        both = np.concatenate([self.scores, scores[:, hopeful]], axis=1)
        names = np.concatenate([self.ids, np.broadcast_to(ids[hopeful], (len(scores), len(hopeful)))], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        self.scores, self.ids = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def top_k_each(queries: DataFrame, vectors: DataFrame, k: int, min_score: float = -1.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest other vectors, those of min_score at least; ties to the smaller vec_id.

    Both: vec_id, a whole number, and embedding. The queries, whose number is
    counted, come to the driver in blocks of about block_bytes by hash, each
    broadcast as a matrix. A pass over the vectors for each block multiplies it
    with matrices of vectors, block_bytes of scores at a time; a task keeps k
    vectors a query, which are ranked together. A score is the rounded product
    of unit vectors; null vectors, and those of another length than the first
    query's, score 0. Queries without a vec_id ask for nothing.
    """
    spark = vectors.sparkSession
    asked = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    seen = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = max(0, seen[1] or 0)
    blocks = max(1, -(-seen[0] * max(1, dim) * 8 // block_bytes))
    schema = T.StructType.fromDDL("query_id long, vec_id long, score double")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def search(block: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast((block.column("vec_id").to_numpy(), matrix(block.column("embedding"), dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = Best(len(names), k)
            step = max(1, block_bytes // (8 * max(1, len(names))))
            for batch in batches:
                ids = batch.column("vec_id").to_numpy()
                v = matrix(batch.column("embedding"), dim)
                for i in range(0, len(ids), step):
                    scores = np.round(q @ v[i : i + step].T, 6) + 0.0
                    scores[names[:, None] == ids[None, i : i + step]] = -np.inf
                    best.add(scores, ids[i : i + step])
            at, place = np.nonzero((best.scores > -np.inf) & (best.scores >= min_score))
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(best.ids[at, place]), pa.array(best.scores[at, place])], schema.names)

        return rows.mapInArrow(run, schema)

    found = [search((asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).toArrow()) for i in range(blocks)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


def embed(texts: DataFrame, encoder: Encoder, column: str = "text") -> DataFrame:
    """texts with vector, model and dim."""
    return texts.withColumn("vector", encode(encoder)(F.col(column))).withColumn("model", F.lit(encoder.name)).withColumn("dim", F.size("vector"))


def embed_documents(docs: DataFrame, encoder: Encoder, size: int = 700, overlap: int = 120, key: str = "doc_id") -> DataFrame:
    """(key, offset, length, text, vector, model, dim) of each chunk; size and overlap within the bounds of a request."""
    check_request(size, overlap)
    return embed(chunk_documents(docs, size, overlap, key), encoder)


CHUNKS_AT_ONCE = 512


def chunk_scores(texts: list[str | None], wanted: np.ndarray, encoder: Encoder, size: int, overlap: int) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """(spans, scores) of each text's chunks; the chunks of several texts are encoded together."""
    spans = [chunk_spans(t or "", size, overlap) for t in texts]
    pieces = [(t, a, b) for t, own in zip(texts, spans) for a, b in own]
    scores = [np.empty(0)]
    for i in range(0, len(pieces), CHUNKS_AT_ONCE):
        scores.append(np.round(np.asarray(encoder([t[a:b] for t, a, b in pieces[i : i + CHUNKS_AT_ONCE]]), dtype=float) @ wanted, 6) + 0.0)
    bounds = np.cumsum([len(own) for own in spans])
    return list(zip(spans, np.split(np.concatenate(scores), bounds[:-1]))) if texts else []


def search_within(docs: DataFrame, query: str, encoder: Encoder, k: int = 5, min_score: float = 0.0, size: int = 700, overlap: int = 120, key: str = "doc_id") -> DataFrame:
    """(key, n_chunks, rank, offset, length, score): each document's k nearest chunks to the query, of those the ones of min_score at least; ties to the earlier.

    k is held to 1 to 50, min_score to -1 to 1; size and overlap are within the
    bounds of a request. A blank query finds nothing. A text is chunked, encoded
    and ranked in the task that reads it: nothing is shuffled.
    """
    check_request(size, overlap)
    k, min_score = min(50, max(1, k)), min(1.0, max(-1.0, min_score))
    wanted = np.asarray(encoder([query])[0], dtype=float)
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n_chunks long, rank long, offset long, length long, score double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, (spans, scores) in enumerate(chunk_scores(batch.column("text").to_pylist(), wanted, encoder, size, overlap)):
                for rank, i in enumerate(np.argsort(-scores, kind="stable")[:k].tolist(), 1):
                    if scores[i] >= min_score:
                        found.append((row, len(spans), rank, spans[i][0], spans[i][1] - spans[i][0], float(scores[i])))
            row, *columns = zip(*found) if found else ((),) * 6
            kinds = [*[pa.int64()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

    return docs.select(key, "text").where(F.lit(bool(query.strip()))).mapInArrow(run, schema)


def search_documents(notices: DataFrame, documents: DataFrame, query: str, encoder: Encoder, top_k: int, min_score: float, scanned: int | None = 200, examined: int | None = 50, least_chars: int = 50, size: int = 700, overlap: int = 120) -> DataFrame:
    """The notices whose text is nearest to the query: notices' columns, score, spec_text, by score, then position; and two counters.

    Of the first scanned notices (by position) the first examined are looked
    at; texts of over least_chars characters count, their best chunk scores
    (at least 0), and the text's first 1000 characters come along. None for
    scanned or examined: all. total_notices_searched counts the scanned
    notices, total_specs_found the texts that count. Chunks are scored in the
    pass that makes them.
    """
    wanted = np.asarray(encoder([query])[0], dtype=float)
    listed = notices if scanned is None else notices.orderBy("position").limit(scanned)
    first = listed if examined is None else listed.orderBy("position").limit(examined)
    texts = attach_texts(first, documents.select("notice_id", "text"), "notice_id").where(F.length("text") > least_chars)
    names = notices.columns
    schema = T.StructType([*notices.schema, *T.StructType.fromDDL("score double, spec_text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("text").to_pylist()
            best = [max(0.0, float(scores.max())) if len(scores) else None for _, scores in chunk_scores(held, wanted, encoder, size, overlap)]
            columns = [pa.array(best, pa.float64()), pa.array([t[:1000] for t in held], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], schema.names)

    found = texts.select(*names, "text").mapInArrow(run, schema).where(F.col("score") >= min_score).orderBy(F.desc("score"), "position").limit(top_k)
    counters = listed.agg(F.count("*").alias("total_notices_searched")).crossJoin(texts.agg(F.count("*").alias("total_specs_found")))  # one row
    return found.crossJoin(F.broadcast(counters))


def attach_texts(notices: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """notices with the column text: that of texts (key, text), '' where there is none or it is null; of several texts of a key, the first in the order of text."""
    one = texts.groupBy(key).agg(F.min("text").alias("text"))
    return notices.join(one, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
