"""Answers held against expectations, and runs held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.compat import integer_text, squeeze, strip
from docframe.operators.evidence import once
from docframe.operators.opportunity import assign_batches


def enough(quantity: Column, name: Column, least: Column) -> Column:
    """Whether the quantity (a number, or text of digits only), or the first number after ×, x or * in the name, is the least at least."""
    marked = F.regexp_substr(name, F.lit(r"[×x*]\s*([0-9]+)"))
    number = F.regexp_substr(marked, F.lit("[0-9]+")).try_cast("long")
    return (F.coalesce(integer_text(quantity), F.lit(0)) >= least) | F.coalesce(number >= least, F.lit(False))


def has_keywords(text: Column, keywords: Column, any_of: Column) -> Column:
    """Whether text holds all keywords, or any where any_of; spaces and case don't count. The text is squeezed once."""
    return once(squeeze(text), lambda t: holds(t, F.transform(keywords, squeeze), any_of))


def holds(text: Column, keywords: Column, any_of: Column) -> Column:
    """has_keywords of a text and keywords that are squeezed already."""
    inside = lambda k: F.contains(text, k)
    return F.when(any_of, F.exists(keywords, inside)).otherwise(F.forall(keywords, inside))


def judge_cases(expectations: DataFrame, items: DataFrame, responses: DataFrame) -> DataFrame:
    """(case, passes, failures, warnings, score, passed) of each case.

    expectations: case, kind (required, forbidden, must, should), keywords,
    any_of, qty_min, label; each row counts for itself, whatever its label.
    items: case, name, qty, sel. responses: case, text. Required and forbidden
    look at items with sel O, each item that a forbidden row matches is a
    failure; must and should look at the whole response. Pass: no failure. The
    score tells required rows met, and selected rows of all. Names, keywords
    and responses are squeezed once each, before they meet.
    """
    rows = items.select("case", squeeze(F.col("name")).alias("name"), "qty", (F.upper("sel") == "O").alias("chosen"))
    counted = rows.groupBy("case").agg(F.count("*").alias("n_rows"), F.count_if("chosen").alias("n_chosen"))
    each = expectations.withColumn("__row", F.monotonically_increasing_id()).withColumn("keywords", F.transform("keywords", squeeze))
    on_items = each.where("kind in ('required', 'forbidden')").join(rows.where("chosen").drop("chosen"), "case", "left")
    hit = F.coalesce(holds(F.col("name"), F.col("keywords"), F.coalesce("any_of", F.lit(False)) & (F.col("kind") == "required")) & F.col("name").isNotNull(), F.lit(False))
    hit = hit & ((F.col("kind") == "forbidden") | enough(F.col("qty"), F.col("name"), F.coalesce("qty_min", F.lit(1))))
    named = F.when(hit & (F.col("kind") == "forbidden"), F.concat(F.col("label"), F.lit(" → "), F.substring("name", 1, 40)))
    on_items = on_items.groupBy("__row", "case", "kind", "label").agg(F.count_if(hit).alias("hits"), F.collect_list(named).alias("names"))
    on_text = each.where("kind in ('must', 'should')").join(responses.select("case", squeeze(F.col("text")).alias("text")), "case", "left")
    on_text = on_text.groupBy("__row", "case", "kind", "label").agg(F.count_if(holds(F.coalesce("text", F.lit("")), F.col("keywords"), F.lit(True))).alias("hits"), F.array().cast("array<string>").alias("names"))
    both = on_items.unionByName(on_text).withColumn("bad", F.when(F.col("kind") == "forbidden", F.col("hits") > 0).otherwise(F.col("hits") == 0))
    own = F.when(F.col("kind") == "forbidden", F.col("names")).otherwise(F.array("label"))
    listed = lambda c: F.array_sort(F.flatten(F.collect_list(F.when(c, F.transform(own, lambda x: F.concat(F.col("kind"), F.lit(": "), x))))))
    failed = F.col("bad") & (F.col("kind") != "should")
    met, wanted = F.count_if(~F.col("bad") & (F.col("kind") == "required")), F.count_if(F.col("kind") == "required")
    judged = both.groupBy("case").agg(
        listed(~F.col("bad") & (F.col("kind") == "required")).alias("passes"), listed(failed).alias("failures"), listed(F.col("bad") & (F.col("kind") == "should")).alias("warnings"),
        F.concat(met, F.lit("/"), wanted).alias("required"), (F.count_if(failed) == 0).alias("passed"),
    )
    score = F.concat("required", F.lit(" required · O행 "), F.coalesce("n_chosen", F.lit(0)), F.lit("/"), F.coalesce("n_rows", F.lit(0)), F.lit("행"))
    return judged.join(counted, "case", "left").select("case", "passes", "failures", "warnings", score.alias("score"), "passed")


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, left_value, right_value and same for each cell of either table; a missing cell equals a null one."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full_outer").withColumn("same", F.col("left_value").eqNullSafe(F.col("right_value")))


def sheet_cells(rows: DataFrame, order: list[str], file: str) -> DataFrame:
    """(file, row, col, value) of each cell that isn't blank, by position: the columns' names are row 1, the rows follow in their order within each file, and columns count from 1 without file.

    Values are texts, stripped. A null file is the file ''.
    """
    columns = [c for c in rows.columns if c != file]
    named = rows.withColumn(file, F.coalesce(F.col(file).cast("string"), F.lit("")))
    placed = assign_batches(named, [file, *order])
    starts = placed.groupBy(file).agg(F.min("position").alias("__first"))
    cells = lambda texts: F.array(*[F.struct(F.lit(i).alias("col"), t.alias("value")) for i, t in enumerate(texts, 1)])
    body = placed.join(starts, file).select(F.col(file).alias("file"), (F.col("position") - F.col("__first") + 2).alias("row"), F.inline(cells([strip(F.col(f"`{c}`").cast("string")) for c in columns])))
    head = starts.select(F.col(file).alias("file"), F.lit(1).cast("long").alias("row"), F.inline(cells([strip(F.lit(c)) for c in columns])))
    return head.unionByName(body).where("value <> ''")


def compare_sheets(left: DataFrame, right: DataFrame, order: list[str], file: str) -> DataFrame:
    """(file, row, col, left_value, right_value, same) of every place that either side fills, whatever rows, columns or files only one of them has."""
    return compare_cells(sheet_cells(left, order, file), sheet_cells(right, order, file), ["file", "row", "col"])


def sheet_shapes(cells: DataFrame) -> DataFrame:
    """(file, left_rows, right_rows, left_columns, right_columns, total, failed) of compare_sheets: the last row and column that each side fills, 0 where it lacks the file; failed counts the places that differ."""
    last = lambda side, c: F.coalesce(F.max(F.when(F.col(f"{side}_value").isNotNull(), F.col(c))), F.lit(0)).cast("long")
    return cells.groupBy("file").agg(last("left", "row").alias("left_rows"), last("right", "row").alias("right_rows"), last("left", "col").alias("left_columns"), last("right", "col").alias("right_columns"), F.count("*").alias("total"), F.count_if(~F.col("same")).alias("failed"))


def compare_files(cells: DataFrame, file: str) -> DataFrame:
    """Cells compared, equal and different by file."""
    return cells.groupBy(file).agg(F.count("*").alias("total"), F.count_if("same").alias("matched"), F.count_if(~F.col("same")).alias("failed"))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of one column with side: left, right or both; the last are the intersection."""
    c = left.columns[0]
    a, b = left.distinct().withColumn("l", F.lit(True)), right.toDF(c).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, c, "full_outer").select(c, side.alias("side"))
