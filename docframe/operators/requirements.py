"""Requirements with their parts against products: three-valued verdicts, rolled up from constraints to requirements.

true is met, false is not met, null is left to people: approx, equivalents,
attributes that a product doesn't state, and values of different kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import values
from docframe.functions.compat import dealt

PASS, FAIL, REVIEW = "pass", "fail", "needs_review"
BROADCAST_ROWS = 100_000


def verdict(met: Column) -> Column:
    return F.when(met, PASS).when(~met, FAIL).otherwise(REVIEW)


def requirement_parts(items: DataFrame, key: str) -> DataFrame:
    """(key, item, part, category, name, allow_equivalent, need, constraints) of (key, items), an array of items as extract_requirements finds them.

    Part 0 is the item itself, if it has constraints or no children; its
    children follow from 1. need: the item's quantity, times a child's own.
    """
    one = items.select(key, F.posexplode("items").alias("item", "i"))
    fields = ("category", "name", "allow_equivalent", "constraints")
    part = lambda x, need, number: F.struct(number.alias("part"), *[x[f].alias(f) for f in fields], need.cast("long").alias("need"))
    least = lambda q: F.greatest(F.lit(1), F.coalesce(q, F.lit(1)))
    children = F.coalesce(F.transform("i.children", lambda c, n: part(c, least(F.col("i.qty")) * least(c["qty"]), n + 1)), F.array())
    itself = part(F.col("i"), least(F.col("i.qty")), F.lit(0))
    asked = (F.size("i.constraints") > 0) | (F.size(children) == 0)
    return one.select(key, "item", F.inline(F.concat(F.when(asked, F.array(itself)).otherwise(F.filter(F.array(itself), lambda _: F.lit(False))), children)))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the rows were counted and are few, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def match_parts(products: DataFrame, parts: DataFrame, key: str, product: str) -> DataFrame:
    """(key, item, part, product, n_met, n_unmet, n_open, verdict) of each part and each product of its category that states one of its attributes.

    products: product, category, attr, value (VARIANT). parts: see
    requirement_parts; constraints: an array of attr, op, value (VARIANT). A
    part that allows equivalents is never decided. Values are taken apart
    before they meet, on category and attribute; products are dealt by product
    to tasks of bounded size, and where the constraints are few enough to be
    broadcast that is the only shuffle: constraints, then parts are counted
    where a product's rows are.
    """
    asked = parts.select(key, "item", "part", "category", F.size("constraints").alias("n"), F.coalesce("allow_equivalent", F.lit(False)).alias("open"), F.posexplode("constraints").alias("place", "c"))
    asked = asked.select(key, "item", "part", "category", "n", "open", "place", "c.attr", "c.op", values.parts(F.col("c.value")).alias("want"))
    stated = products.select(product, "category", "attr", values.parts(F.col("value")).alias("have"))
    met = dealt(stated, product).join(_small(asked), ["category", "attr"])
    of = [key, "item", "part", product, "n", "open"]
    judged = met.select(*of, "place", values.compared(F.col("op"), F.col("have"), F.col("want")).alias("met"))
    # A product that states an attribute several times meets a constraint if one of its values does.
    each = judged.groupBy(*of, "place").agg(F.count_if("met").alias("yes"), F.count_if(F.col("met").isNull()).alias("maybe"))
    summed = each.groupBy(*of).agg(F.count_if(F.col("yes") > 0).alias("n_met"), F.count_if((F.col("yes") == 0) & (F.col("maybe") == 0)).alias("n_unmet"))
    counted = summed.withColumn("n_open", F.col("n") - F.col("n_met") - F.col("n_unmet"))
    state = F.when(F.col("open"), None).when(F.col("n_unmet") > 0, False).when(F.col("n_open") > 0, None).otherwise(True)
    return counted.select(key, "item", "part", product, "n_met", "n_unmet", "n_open", verdict(state).alias("verdict"))


def roll_up(matches: DataFrame, parts: DataFrame, stock: DataFrame, key: str, product: str) -> DataFrame:
    """(key, level, item, part, need, sure, possible, verdict): of each part, each item and each requirement.

    stock: product, category, quantity (null: not known), a row for each
    product. A part passes if the products that pass have its need between
    them (sure); it fails if those that pass or are open haven't either
    (possible; null if a quantity isn't known); products of its category that
    state none of its attributes are open. A part without constraints is open
    unless nothing of its category is there. An item is all of its parts, a
    requirement all of its items. What was matched is summed by part, and the
    rest follows from the sums of each category.
    """
    held = stock.groupBy("category").agg(F.sum("quantity").alias("all"), F.count_if(F.col("quantity").isNull()).alias("all_unknown"))
    of = matches.join(stock.select(product, "quantity"), product)
    by = lambda *states: F.col("verdict").isin(*states)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.coalesce("quantity", F.lit(0)))), F.lit(0))
    summed = of.groupBy(key, "item", "part").agg(total(by(PASS)).alias("sure"), total(by(FAIL)).alias("lost"), F.count_if(by(FAIL) & F.col("quantity").isNull()).alias("lost_unknown"))
    wanted = parts.select(key, "item", "part", "category", "need")
    both = wanted.join(summed, [key, "item", "part"], "left").join(F.broadcast(held) if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held, "category", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    open_ = zero(F.col("all_unknown")) - zero(F.col("lost_unknown"))
    possible = F.when(open_ == 0, zero(F.col("all")) - zero(F.col("lost")))
    sure = zero(F.col("sure"))
    met = F.when(sure >= F.col("need"), True).when(possible < F.col("need"), False)
    each = both.select(key, "item", "part", "need", sure.cast("long").alias("sure"), possible.cast("long").alias("possible"), met.alias("met"))
    none = F.lit(None)
    whole = each.groupBy(key, "item").agg(F.count_if(~F.col("met")).alias("no"), F.count_if(F.col("met").isNull()).alias("open"))
    state = lambda: F.when(F.col("no") > 0, False).when(F.col("open") > 0, None).otherwise(True)
    per_item = whole.select(key, "item", state().alias("met"))
    per_requirement = per_item.groupBy(key).agg(F.count_if(~F.col("met")).alias("no"), F.count_if(F.col("met").isNull()).alias("open")).select(key, state().alias("met"))
    return (
        each.select(key, F.lit("part").alias("level"), "item", "part", "need", "sure", "possible", verdict(F.col("met")).alias("verdict"))
        .unionByName(per_item.select(key, F.lit("item").alias("level"), "item", none.cast("int").alias("part"), *[none.cast("long").alias(c) for c in ("need", "sure", "possible")], verdict(F.col("met")).alias("verdict")))
        .unionByName(per_requirement.select(key, F.lit("requirement").alias("level"), none.cast("int").alias("item"), none.cast("int").alias("part"), *[none.cast("long").alias(c) for c in ("need", "sure", "possible")], verdict(F.col("met")).alias("verdict")))
    )
