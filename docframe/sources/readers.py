"""Readers of the formats that records come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.compat import blank_to_null

#: The parameter of a kind of bid.
BID_TYPES = {"물품": "01", "용역": "03", "공사": "02"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of text columns: names and cells stripped, empty cells null, url dropped; rows of nulls stay."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path).drop("url")
    return rows.select(*[blank_to_null(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns])


def typed(catalogue: DataFrame, kinds: dict[str, str], required: str = "name") -> tuple[DataFrame, DataFrame]:
    """(rows that hold the types, rows that don't or lack the required column). Whole numbers may be written 8.0."""

    def value(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(x == F.floor(x), x.try_cast("bigint")) if kinds[c] == "bigint" else F.col(c).try_cast(kinds[c])

    have = [c for c in catalogue.columns if c in kinds]
    lost = F.exists(F.array(F.lit(False), *[F.col(c).isNotNull() & value(c).isNull() for c in have]), lambda x: x)
    bad = lost | F.col(required).isNull()
    return catalogue.where(~bad).withColumns({c: value(c) for c in have}), catalogue.where(bad)


#: The least values of catalogue columns; those not named may be 0, not less.
LEAST = {"cores": 1, "threads": 1, "memory_channels": 1}


def load_specs(catalogue: DataFrame, kinds: dict[str, str], required: str = "name", least: dict[str, int] = LEAST) -> DataFrame:
    """A catalogue's rows with their types, all or none: a row that lacks the required column, or holds a value of another type or below its least, ends the job when it is read."""
    rows, bad = typed(catalogue, kinds, required)
    wrong = bad.select(F.raise_error(F.concat(F.lit("not a product: "), F.to_json(F.struct("*")))).cast("string").alias(required))
    numbers = [c for c in rows.columns if kinds.get(c) in ("bigint", "double", "int")]
    low = F.exists(F.array(F.lit(False), *[F.coalesce(F.col(c) < least.get(c, 0), F.lit(False)) for c in numbers]), lambda x: x)
    checked = rows.withColumn(required, F.when(low, F.raise_error(F.concat(F.lit("out of range: "), F.to_json(F.struct("*")))).cast("string")).otherwise(F.col(required)))
    return checked.unionByName(wrong, allowMissingColumns=True)


def notices(rows: DataFrame, first: str, last: str, bid_type: str = "all", keywords: list[str] | None = None) -> DataFrame:
    """Notices of a span of days (YYYY-MM-DD or YYYYMMDD), of a kind of bid, with all keywords in their name; the filters reach the scan."""
    plain = lambda day: day.replace("-", "")
    found = rows.where(F.col("day").between(plain(first), plain(last)))
    if bid_type != "all":
        found = found.where(F.col("bid_type") == BID_TYPES.get(bid_type, "01"))
    for k in keywords or []:
        found = found.where(F.contains("name", F.lit(k)))
    return found


def read_workbook(spark: SparkSession, path: str, columns: list[str], name: str, unit: str) -> DataFrame:
    """A sheet exported as CSV, its columns by position: rows without a name dropped, the unit reduced to letters and digits."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).toDF(*columns)
    return rows.where(blank_to_null(F.col(f"`{name}`")).isNotNull()).withColumn(unit, F.regexp_replace(F.col(f"`{unit}`"), r"[^\p{L}\p{N}]", ""))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one object each; those that can't be read are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def markdown_rows(text: Column) -> Column:
    """The cells of the table rows of Markdown text, ruler rows left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.btrim(x).startswith("|") & ~F.regexp_like(x, F.lit(r"^[\s|:-]+$")))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.btrim(x), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(F.btrim(c), "^`|`$", "")))
