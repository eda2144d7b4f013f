"""The stateless scans over a stream; an extension, the batch operators are the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docframe.operators.rules import scan_rules


def stream_findings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rule findings of documents (doc_id, text) as their Parquet files arrive."""
    return scan_rules(spark.readStream.schema(schema).parquet(path))
