"""Connected components of a graph of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.storage import materialize, materialize_counting

PART = 100_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id in links (a, b), the least id that it reaches.

    Each turn takes the least label among neighbours, and from the third on also
    the label's own label, so that long chains halve; it ends when nothing
    changes. Every turn is written to the shared folder, in tasks of about PART
    links, however many partitions the session has.
    """
    both = links.select("a", "b").where("a <> b")
    both, seen = materialize_counting(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n=F.count("*"))
    parts = seen["n"] // PART + 1
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component"))
    labels = materialize(labels.coalesce(parts))
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").coalesce(parts).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        lower, seen = materialize_counting(lower.coalesce(parts), changed=F.count_if(F.col("component") < F.col("was")))
        if not seen["changed"]:
            return lower.select("id", "component")
        labels = lower.select("id", "component")
        if turn > 2:  # most graphs are shallow
            up = lower.select(F.col("id").alias("component"), F.col("component").alias("top"))
            labels = materialize(labels.join(up, "component").select("id", F.col("top").alias("component")).coalesce(parts))
