"""Where intermediate tables go, and how small tables reach the tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one for the session, if master is local (tests), else an error: executors could not share it."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor costs a reread."""
    path = f"{shared_folder(df.sparkSession)}/docframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialize(df), and aggregates over its rows from the same pass; 0 where there are none."""
    seen = Observation()
    out = materialize(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]))
    return out, seen.get


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where the counted rows prove df small, else df as it is and Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Each name with underscores before it till no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "__" + name
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of the session hold at most so many rows: a Python worker has several copies of a batch of texts.

    Plans read the setting when they run, so it holds for the session from an
    operator's first pass on; a smaller one of the user's stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def add_columns(docs: DataFrame, fields: str, rows: Callable[[pa.RecordBatch], Iterator[list]], carry: list[str] | None = None) -> DataFrame:
    """docs with the columns that rows makes from Arrow batches with a column text.

    fields: their names and types as DDL; docs' own columns of these names are
    replaced. carry: docs' columns to return, else all.
    """
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    keep = [f for f in docs.schema if f.name.lower() not in taken and (carry is None or f.name in carry)]
    have = {f.name for f in keep}
    given = docs.select(*[F.col(f"`{f.name}`") for f in keep], *[c for c in dict.fromkeys(("text", *new.names)) if c in docs.columns and c not in have])
    names, types = [f.name for f in keep], [T.StructType([f]) for f in new]
    arrow = [_arrow_type(t) for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(rows(batch))
            columns = [pa.array([r[i] for r in made], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *new.names])

    return given.mapInArrow(run, T.StructType([*keep, *new]))


def _arrow_type(one: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(one).field(0).type
