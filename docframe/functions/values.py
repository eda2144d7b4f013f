"""Values that are a flag, a number or a text, as VARIANT: none is taken for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.compat import strip

FLAG, NUMBER, TEXT = "flag", "number", "text"


NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def kind(v: Column) -> Column:
    """flag, number or text; null for null, and for arrays and objects."""
    schema = F.schema_of_variant(v)
    return F.when(schema == "BOOLEAN", FLAG).when(schema == "STRING", TEXT).when(schema.rlike(NUMBERS), NUMBER)


def flag(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def number(v: Column) -> Column:
    """As a double; null for texts, "24" too."""
    return F.when(F.schema_of_variant(v).rlike(NUMBERS), F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def value(v: Column) -> Column:
    """The VARIANT with every number a double; null where it is none of the three."""
    given = kind(v)
    return F.when(given == NUMBER, F.try_variant_get(v, "$", "double").cast("variant")).when(given.isNotNull(), v)


def of(c: Column) -> Column:
    """A boolean, number or string column as such a VARIANT."""
    return value(c.cast("variant"))


def shown(v: Column) -> Column:
    """JSON of it: a text has its quotes."""
    return F.when(kind(v).isNotNull(), F.to_json(value(v)))


def parts(v: Column) -> Column:
    """A struct of the VARIANT as flag, number and text, in small letters and without spaces at its ends: what compared needs."""
    return F.struct(flag(v).alias("flag"), number(v).alias("number"), F.lower(strip(text(v))).alias("text"))


def compare(op: Column, have: Column, want: Column) -> Column:
    """Whether have meets want by op (gte, lte, eq); null, which is undecided, for approx and other ops, where either is missing, and between kinds.

    Numbers are compared as such, texts without spaces at their ends and without
    case, and gte and lte hold between numbers only.
    """
    return compared(op, parts(have), parts(want))


def compared(op: Column, have: Column, want: Column) -> Column:
    """As compare, of two structs of parts: each value is taken apart once, however many it is compared with."""
    a, b = have["number"], want["number"]
    equal = F.coalesce(a == b, have["flag"] == want["flag"], have["text"] == want["text"])
    return F.when(op == "gte", a >= b).when(op == "lte", a <= b).when(op == "eq", equal)


def all_of(verdicts: Column) -> Column:
    """Of an array of booleans: false if one is, else null if one is, else true."""
    return F.when(F.exists(verdicts, lambda x: ~x), False).when(F.size(F.filter(verdicts, lambda x: x.isNull())) > 0, None).otherwise(True)
