"""Prompts from notices and their attachments within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Output tokens, prompt tokens, characters a token, the window if none is known, the least budget.
MAX_OUTPUT, OVERHEAD, CHARS_PER_TOKEN, FALLBACK, LEAST = 400, 512, 1.5, 8192, 1000
OMITTED, CUT = " (분량 초과로 생략)", "\n…(이하 생략)"


def input_budget(loaded: Column, configured: Column) -> Column:
    """Characters that a model's window leaves for the input; 0 and null windows count as unknown."""
    window = F.coalesce(F.nullif(loaded, F.lit(0)), F.nullif(configured, F.lit(0)), F.lit(FALLBACK))
    return F.greatest(F.lit(LEAST), F.floor((window - MAX_OUTPUT - OVERHEAD) * CHARS_PER_TOKEN).cast("int")).cast("long")


def header(notice_no: Column, title: Column, agency: Column, amount: Column) -> Column:
    """The lines about the notice; amount only where it is neither null nor empty."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-")))
    money = F.concat(F.lit("금액: "), F.nullif(amount.cast("string"), F.lit("")))
    return F.concat_ws("\n", line("공고번호", notice_no), line("공고명", title), line("수요기관", agency), money)


def clip_to_budget(parts: DataFrame, key: str, order: str, text: str, budget: Column) -> DataFrame:
    """parts with remaining (what is left of the budget before each, at least 0), clipped, and state: whole, cut or omitted."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length(F.coalesce(text, F.lit("")))
    left = F.greatest(F.lit(0), budget - F.coalesce(F.sum(length).over(before), F.lit(0)))
    return (
        parts.withColumn("remaining", left.cast("long"))
        .withColumn("clipped", F.substring(F.coalesce(text, F.lit("")), F.lit(1), F.col("remaining").cast("int")))
        .withColumn("state", F.when(F.col("remaining") <= 0, "omitted").when(length > F.col("remaining"), "cut").otherwise("whole"))
    )


def render_notices(notices: DataFrame, documents: DataFrame, budget: int) -> DataFrame:
    """(notice_no, prompt): the header, then each attachment within what remains.

    notices: notice_no, title, agency, amount. documents: notice_no, position,
    name, text. A notice without documents is its header.
    """
    heads = notices.withColumn("head", header(F.col("notice_no"), F.col("title"), F.col("agency"), F.col("amount"))).select("notice_no", "head")
    parts = documents.join(heads, "notice_no")
    clipped = clip_to_budget(parts, "notice_no", "position", "text", F.lit(budget) - F.length("head"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("첨부"))
    body = F.when(F.col("state") == "omitted", F.concat(F.lit("\n["), name, F.lit("]" + OMITTED))).otherwise(
        F.concat(F.lit("\n["), name, F.lit("]\n"), F.col("clipped"), F.when(F.col("state") == "cut", CUT).otherwise(""))
    )
    bodies = clipped.withColumn("body", body).groupBy("notice_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]).alias("bodies"))
    return heads.join(bodies, "notice_no", "left").select("notice_no", F.concat_ws("\n", "head", F.coalesce("bodies", F.array().cast("array<string>"))).alias("prompt"))


def notice_line(number: Column, name: Column, institution: Column, amount: Column, method: Column, region: Column) -> Column:
    """One notice in a classification prompt; an amount of null or 0 is unknown."""
    money = F.when(F.coalesce(amount, F.lit(0)) != 0, F.concat(amount.cast("string"), F.lit("억"))).otherwise("금액미상")
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    issuer = F.concat(F.lit("발주:"), F.nullif(institution, F.lit("")))
    return F.concat_ws(" | ", F.concat(number.cast("string"), F.lit(". "), name), issuer, money, dash(method), dash(region))
