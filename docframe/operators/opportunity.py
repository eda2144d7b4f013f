"""Batched classification with recovered holes, verdicts and scorecards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.compat import share, strip
from docframe.sources.shared import written, written_counting

#: Sizes of batches and of retries, the closed value sets, and the mark of an unassigned row.
BATCH, RETRY = 10, 3
SUBSIDIARIES = ("서버스테이션", "브레인웨어", "일렉테리어", "렌탈본점", "확인필요")
WORK_KINDS = ("물품", "용역", "공사")
FIT_LEVELS = ("High", "Mid", "Low")
UNASSIGNED = "확인필요"
VERDICT = "struct<work_kind:string,subsidiary:string,product:string,fit:string,reason:string>"


def assign_batches(rows: DataFrame, order: list[str], size: int = BATCH, ranges: int | None = None) -> DataFrame:
    """rows with position (from 0 in order), batch and slot (from 1); rows of equal order come by a hash of all their columns.

    Spark deals the rows to ranges of the order (so many, else as many as
    shuffles have) and sorts each; the result is written to the shared folder,
    so that a row keeps the place it had there, and each range's rows go on
    from those of the ranges before it. A job runs when this is called. Rows
    that are equal in every column may share two ranges: a seeded number parts
    them.
    """
    key = [*(F.col(c) for c in order), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.rand(7)]
    names = [f"__k{i}" for i in range(len(key))]
    keyed = rows.withColumns(dict(zip(names, key)))
    dealt = keyed.repartitionByRange(*([ranges] if ranges else []), *names).sortWithinPartitions(*names).drop(*names)
    placed = written(dealt.withColumn("__id", F.monotonically_increasing_id()))  # a range's number, then 33 bits of its row's
    bits = 33
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = placed.groupBy(F.shiftright("__id", bits).alias("__range")).agg(F.count("*").alias("__held"))
    starts = held.withColumn("__start", F.coalesce(F.sum("__held").over(before), F.lit(0))).drop("__held")
    found = placed.withColumn("__range", F.shiftright("__id", bits)).join(F.broadcast(starts), "__range")
    position = F.col("__start") + F.col("__id").bitwiseAND((1 << bits) - 1)
    numbered = found.withColumn("position", position.cast("long")).withColumn("batch", F.floor(F.col("position") / size)).withColumn("slot", (F.col("position") % size + 1).cast("long"))
    return numbered.drop("__range", "__id", "__start")


def salvage_array(text: Column, schema: str) -> Column:
    """The objects of the JSON array between the first [ and the last ]; no array, or a broken one, is empty."""
    body = F.nullif(F.regexp_substr(text, F.lit(r"(?s)\[.*\]")), F.lit(""))
    objects = F.filter(F.from_json(body, "array<string>"), lambda x: x.startswith("{"))  # elements of other kinds go
    return F.coalesce(F.transform(objects, lambda x: F.from_json(x, schema)), F.array().cast(f"array<{schema}>"))


def salvage_object(text: Column, schema: str) -> Column:
    """The JSON object between the first { and the last }; null where there is none."""
    return F.from_json(F.nullif(F.regexp_substr(text, F.lit(r"(?s)\{.*\}")), F.lit("")), schema)


def narrow(work_kind: Column, subsidiary: Column, product: Column, fit: Column, reason: Column, subsidiaries=SUBSIDIARIES, work_kinds=WORK_KINDS, fits=FIT_LEVELS) -> Column:
    """A verdict of the closed value sets: null for an unknown subsidiary, '' for an unknown kind or fit; 60 characters of reason."""
    text = lambda c: strip(F.coalesce(c.cast("string"), F.lit("")))
    within = lambda c, values: F.when(text(c).isin(*values), text(c)).otherwise("")
    made = F.struct(within(work_kind, work_kinds).alias("work_kind"), text(subsidiary).alias("subsidiary"), text(product).alias("product"), within(fit, fits).alias("fit"), F.substring(text(reason), 1, 60).alias("reason"))
    return F.when(text(subsidiary).isin(*subsidiaries), made)


def place_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows (batch, slot) with verdict, from answers (batch, slot, turn, verdict, and place, if there is one, within the answer): slots outside their batch are ignored, the last duplicate wins."""
    turn = F.struct("turn", "place") if "place" in answers.columns else F.col("turn")
    last = answers.where("verdict is not null").groupBy("batch", "slot").agg(F.max_by("verdict", turn).alias("verdict"))
    return rows.join(last, ["batch", "slot"], "left")


def holes(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows without a verdict, regrouped by RETRY in their order."""
    return assign_batches(rows.where("verdict is null").drop("batch", "slot", "position", "verdict"), [order], RETRY)


ANSWER = "struct<i:bigint,work_kind:string,subsidiary:string,product:string,fit:string,reason:string>"


Asking = Callable[[DataFrame, str, str], DataFrame]  # rows, their column of prompts, a column for {text, error} -> rows with it


def ask_batches(rows: DataFrame, line: Column, ask: Asking, heading: str, **sets) -> tuple[DataFrame, dict[str, int]]:
    """(answers, counts) of rows (batch, slot): a prompt for each batch, the heading and its rows' lines.

    answers: batch, slot, turn, place, verdict. counts: calls, failed (calls
    without an answer) and rejected (answers outside the value sets), seen in
    the pass that writes the answers.
    """
    lines = F.array_sort(F.collect_list(F.struct("slot", line.alias("line"))))
    prompts = rows.groupBy("batch").agg(F.concat(F.lit(heading), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"), F.count("*").alias("n"))
    asked = ask(prompts, "prompt", "a").select("batch", "n", "a.error", salvage_array(F.col("a.text"), ANSWER).alias("found"))
    inside = F.filter(F.transform("found", lambda x, i: F.struct(i.alias("place"), x.alias("x"))), lambda y: y["x"]["i"].between(1, F.col("n")))

    def verdict(y: Column) -> Column:
        given = narrow(*[y["x"][c] for c in ("work_kind", "subsidiary", "product", "fit", "reason")], **sets)
        return F.struct(y["x"]["i"].alias("slot"), y["place"].alias("place"), given.alias("verdict"))

    parsed = asked.select("batch", "error", F.transform(inside, verdict).alias("answers"))
    rejected = F.sum(F.size(F.filter("answers", lambda y: y["verdict"].isNull())))
    calls, counts = written_counting(parsed, calls=F.count("*"), failed=F.count_if(F.col("error").isNotNull()), rejected=rejected)
    return calls.select("batch", F.inline("answers")).withColumn("turn", F.lit(1)).select("batch", "slot", "turn", "place", "verdict"), counts


def classify(rows: DataFrame, order: str, line: Callable[[Column], Column], ask: Asking, heading: str = "", **sets) -> tuple[DataFrame, DataFrame]:
    """(results, stats): rows with verdict in input order (position), those that a batch left out asked for once more in smaller batches.

    order: a column that is unique. line: a row's line in a prompt, from its
    number. ask: see calls.answered. A call that fails leaves its rows as
    holes. sets: the closed value sets of narrow. stats, one row: total, calls
    (of the first turn), retried and recovered rows, rejected answers, missing
    rows, failed_batches; all were counted in passes that write a step's
    result, so no job runs for them alone. Empty rows: nothing is asked.
    """
    first = assign_batches(rows, [order])
    answers, asked = ask_batches(first, line(F.col("slot")), ask, heading, **sets)
    placed, seen = written_counting(place_answers(first, answers), total=F.count("*"), open=F.count_if(F.col("verdict").isNull()))
    again = {"calls": 0, "failed": 0, "rejected": 0}
    results = placed
    recovered = {"n": 0}
    if seen["open"]:
        gaps = holes(placed, order)
        more, again = ask_batches(gaps, line(F.col("slot")), ask, heading, **sets)
        filled, recovered = written_counting(place_answers(gaps, more).select(order, F.col("verdict").alias("__again")).where("__again is not null"), n=F.count("*"))
        results = placed.join(filled, order, "left").withColumn("verdict", F.coalesce("verdict", "__again")).drop("__again")
    counts = {
        "total": seen["total"], "missing": seen["open"] - recovered["n"], "calls": asked["calls"], "retried": seen["open"], "recovered": recovered["n"],
        "rejected": asked["rejected"] + again["rejected"], "failed_batches": asked["failed"] + again["failed"],
    }
    stats = rows.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))
    return results.drop("batch", "slot"), stats


def row_verdict(truth: Column, predicted: Column, assigned, unassigned: str = UNASSIGNED) -> Column:
    """How a row's prediction stands to its label."""
    return (
        F.when(predicted.isNull(), "⚠️미분석")
        .when(truth == unassigned, F.when(predicted.isin(*assigned), "🆕신규발굴").otherwise("동일(미분류)"))
        .when(truth == predicted, "일치")
        .otherwise("불일치")
    )


def scorecard(rows: DataFrame, assigned, unassigned: str = UNASSIGNED, by: list[str] | None = None) -> DataFrame:
    """Counts and rates over rows (truth, predicted, fit, labelled_fit) in one pass; rates over covered rows, labelled High over all."""
    covered, known, unknown = F.col("predicted").isNotNull(), F.col("truth").isin(*assigned), F.col("truth") == unassigned
    n = lambda c: F.count_if(c)
    counted = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("notices"), n(covered).alias("analysed"), n(~covered).alias("missing"), n(covered & known).alias("assigned"), n(covered & known & (F.col("truth") == F.col("predicted"))).alias("matched"),
        n(covered & unknown).alias("unassigned"), n(covered & unknown & F.col("predicted").isin(*assigned)).alias("discovered"), n(covered & (F.col("fit") == "High")).alias("fit_high"), n(F.col("labelled_fit") == "High").alias("labelled_high"),
    )
    return counted.withColumn("match_rate", share(F.col("matched"), F.col("assigned"))).withColumn("discovery_rate", share(F.col("discovered"), F.col("unassigned")))
