"""Where Python, Spark and SQL differ on text and numbers, decided once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that Python's str.isspace() accepts, as a class of Java and RE2 expressions.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = "[^" + SPACE[1:]


def strip(c: Column) -> Column:
    """Without spaces of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Without any space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", ""))


def whole_number(c: Column) -> Column:
    """An integer from text such as '8', ' 8 ' or '8.0'; null from anything else."""
    x = strip(c.cast("string")).try_cast("double")
    return F.when(x == F.floor(x), x.try_cast("long"))


def share(part: Column, whole: Column) -> Column:
    """A percentage to one place, halves to the even digit; 0 of nothing."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 1)).otherwise(0.0)


def integer_text(c: Column) -> Column:
    """An integer written as digits, with a sign or without; null from anything else, 8.0 too."""
    return F.when(F.regexp_like(strip(c.cast("string")), F.lit("^[+-]?[0-9]+$")), strip(c.cast("string")).try_cast("long"))


def dealt(df: DataFrame, key: str, rows: int = 250_000) -> DataFrame:
    """df dealt by key to as many tasks as its number of rows asks for, about rows to each, and at least as many as shuffles have. A job counts them."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), key)
