"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docframe.operators.opportunity import row_verdict, scorecard


def write_run(rows: DataFrame, stats: DataFrame, meta: dict[str, str], path: str) -> None:
    """rows and stats as JSON lines beside each other, both with the run's meta."""
    for name, df in (("rows", rows), ("stats", stats)):
        df.withColumns({k: F.lit(v) for k, v in meta.items()}).write.mode("overwrite").json(f"{path}/{name}")


def markdown_line(columns: list[str]) -> Column:
    """A row of a Markdown table."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


#: The lines of a report's summary, and the counts that they show.
MEASURES = {
    "공고 건수": "notices", "🤖 분석 완료": "analysed", "🤖 미분석(응답 유실)": "missing", "워크북이 자회사를 배정한 건": "assigned", "  그중 판정 일치": "matched", "  일치율(%)": "match_rate",
    "워크북 '확인필요' 건": "unassigned", "  🤖 자회사를 지목한 건": "discovered", "  신규발굴률(%)": "discovery_rate", "워크북 High": "labelled_high", "엔진 High": "fit_high",
}
DISCOVERED, DIFFERENT = "🆕신규발굴", "불일치"
PICKED = ("amount", "name", "agency", "truth", "predicted", "fit", "reason")


def by_amount(amount: Column, position: Column) -> list[Column]:
    """The largest amounts first, null as 0, then by position."""
    return [F.coalesce(amount, F.lit(0)).desc(), position]


def report_sheets(rows: DataFrame, assigned: tuple[str, ...], unassigned: str, meta: dict[str, str], baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sheets of a report on classified rows: summary, all, discovered and different.

    rows: position, amount, name, agency, truth, predicted, fit, labelled_fit,
    reason, and more columns, which come along in all. summary: line, label,
    value, before; the lines of meta, then the measures of this run and of
    baseline, rows of another run. all: rows and their verdict by position. The
    other two: the rows of PICKED whose label the run has found, or contradicts,
    by amount.
    """
    marked = rows.withColumn("verdict", row_verdict(F.col("truth"), F.col("predicted"), assigned, unassigned))
    shown = lambda c: F.col(c).cast("string")
    lines = lambda df, into: scorecard(df, assigned, unassigned).select(F.inline(F.array(*[F.struct(F.lit(len(meta) + i).alias("line"), F.lit(label).alias("label"), shown(c).alias(into)) for i, (label, c) in enumerate(MEASURES.items(), 1)])))
    measured = lines(rows, "value")
    measured = measured.join(lines(baseline, "before").drop("label"), "line") if baseline is not None else measured.withColumn("before", F.lit(None).cast("string"))
    head = rows.sparkSession.createDataFrame([(i, k, v, None) for i, (k, v) in enumerate(meta.items(), 1)], "line int, label string, value string, before string")
    picked = lambda v: marked.where(F.col("verdict") == v).select("position", *PICKED)
    return {"summary": head.unionByName(measured.select(head.columns)), "all": marked, "discovered": picked(DISCOVERED), "different": picked(DIFFERENT)}


def write_report(sheets: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each sheet as CSV with a header in a folder of its name, its files one after the other in the sheet's order; the rows of each, counted as they are written."""
    order = {"summary": [F.col("line")], "all": [F.col("position")]}
    counts = {}
    for name, df in sheets.items():
        keys = order.get(name) or by_amount(F.col("amount"), F.col("position"))
        seen = Observation()
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        (placed.drop("position") if name not in order else placed).observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("header", True).option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts
