"""The folder that driver and executors share, and small immutable files in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one for the session, if master is local (tests), else an error: executors could not share it."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docframe-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder: its plan ends there, and a lost executor costs a reread."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """written(df), and aggregates over its rows from the same pass; 0 where there are none."""
    seen = Observation()
    out = written(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]))
    return out, seen.get


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a plain path is a local one."""
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else os.path.abspath(folder))


def files_of(folder: str) -> list[str]:
    """The paths of the folder's data files, sorted; none if there is no folder."""
    store, path = store_of(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def read_lines(folder: str, path: str):
    with store_of(folder)[0].open_input_stream(path) as file:
        rest = b""
        while block := file.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from lines
        if rest:
            yield rest


def write_file(folder: str, name: str, data: bytes | Iterable[bytes]) -> str:
    """A file that appears whole: written under another name first, part by part if data comes in parts."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for block in [data] if isinstance(data, bytes) else data:
            out.write(block)
    store.move(part, f"{path}/{name}")
    return f"{path}/{name}"
