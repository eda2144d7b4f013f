"""Queries on files of the formats that records come in: each is written from a given table first, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators import evaluation, opportunity
from docframe.plans.base import query
from docframe.sources import readers, shared, sinks
from docframe.sources.readers import table


def _csv(rows: DataFrame) -> str:
    folder = shared.fresh_folder(rows.sparkSession)
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(folder)
    return folder


def _catalogue_file(spark: SparkSession, folder: str) -> str:
    k, size = F.col("p_partkey"), F.col("p_size")
    return _csv(table(spark, folder, "part").select(
        k.cast("string").alias(" key "), F.concat(F.lit(" "), "p_name", F.lit("　")).alias("name "), F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, F.concat(size.cast("string"), F.lit(".0 "))).when(k % 4 == 2, size.cast("string")).otherwise("many").alias(" cores"),
        F.lit("http://x").alias("url"), F.when(k % 5 > 0, F.concat(F.lit("a,\"b\"\n"), "p_brand")).alias("socket"),
    ))


CATALOGUE_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CASE p_partkey % 4 WHEN 1 THEN p_size || '.0' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN 'many' END AS cores, CASE WHEN p_partkey % 5 > 0 THEN 'a,"b"' || chr(10) || p_brand END AS socket FROM part
"""


@query(CATALOGUE_SQL)
def catalogue_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue whose cells are padded, quoted, blank or of several lines."""
    return readers.read_catalogue(spark, _catalogue_file(spark, folder))


@query(f"SELECT key, CASE cores WHEN 'many' THEN NULL ELSE CAST(CAST(cores AS DOUBLE) AS BIGINT) END AS cores, coalesce(cores = 'many', false) AS rejected FROM ({CATALOGUE_SQL})")
def catalogue_types(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue's rows with their types, and those that don't hold them."""
    rows = readers.read_catalogue(spark, _catalogue_file(spark, folder))
    good, bad = readers.typed(rows, {"cores": "bigint"})
    return good.select("key", "cores", F.lit(False).alias("rejected")).unionByName(bad.select("key", F.lit(None).cast("bigint").alias("cores"), F.lit(True).alias("rejected")))


@query(f"SELECT key, CAST(CAST(cores AS DOUBLE) AS BIGINT) AS cores FROM ({CATALOGUE_SQL}) WHERE cores IS NULL OR cores <> 'many'")
def catalogue_load(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue that is loaded whole, or not at all: without the rows of another type it is."""
    rows = readers.read_catalogue(spark, _catalogue_file(spark, folder)).where("cores is null or cores <> 'many'")
    return readers.load_specs(rows, {"cores": "bigint"}).select("key", "cores")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS notice, regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') || '서버' AS unit, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS amount FROM orders WHERE o_orderkey % 6 > 0
""")
def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet by position, whatever its heading: rows without a name go, and the unit keeps letters and digits."""
    k = F.col("o_orderkey")
    sheet = table(spark, folder, "orders").select(F.when(k % 6 > 0, k.cast("string")).otherwise("　 ").alias("b"), F.concat("o_orderpriority", F.lit(" (서버)")).alias("a"), F.floor("o_totalprice").cast("string").alias("b2"))
    return readers.read_workbook(spark, _csv(sheet), ["notice", "unit", "amount"], "notice", "unit")


def _grouped_files(spark: SparkSession, rows: DataFrame, of: Column, text: Column) -> str:
    """A folder with a file for each group, its lines joined."""
    folder = shared.fresh_folder(spark)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "\n")
    rows.groupBy(of.alias("group")).agg(lines.alias("text")).repartition("group").write.option("lineSep", "\n").partitionBy("group").text(folder)
    return folder


@query("SELECT s_suppkey AS k, s_name AS name, s_nationkey AS n FROM supplier WHERE s_suppkey // 25 % 3 <> 1")
def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file of 25 objects over several lines each; every third file breaks off, and is left out."""
    k = F.col("s_suppkey")
    place, broken = k % 25, F.floor(k / 25) % 3 == 1
    said = F.concat(F.when(place == 0, "[").otherwise(","), F.lit("{\n"), F.expr("substring(to_json(named_struct('k', s_suppkey, 'name', s_name, 'n', s_nationkey)), 2)"))
    rows = table(spark, folder, "supplier").withColumn("k", k)
    last = rows.groupBy(F.floor(k / 25).alias("g")).agg(F.max("k").alias("k")).select("k", F.lit("]").alias("end"))
    closed = rows.join(last, "k", "left").withColumn("t", F.concat(said, F.when(~broken, F.coalesce("end", F.lit(""))).otherwise("")))
    return readers.read_json(spark, _grouped_files(spark, closed, F.floor(F.col("k") / 25), F.col("t")), "k bigint, name string, n int").drop("group")


@query("""
SELECT CAST(c_custkey // 100 AS BIGINT) AS "group", md5(string_agg(c_name || '  ', chr(10) ORDER BY c_custkey) || chr(10)) AS digest FROM customer GROUP BY 1
""")
def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a hundred lines, each read whole."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit("  ")).alias("t"))
    found = readers.read_texts(spark, _grouped_files(spark, rows, F.floor(F.col("k") / 100), F.col("t")))
    return found.select(F.regexp_extract("path", "group=([0-9]+)", 1).cast("long").alias("group"), F.md5("text").alias("digest"))


@query("SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of a hundred rows in Markdown among other lines."""
    k = F.col("c_custkey")
    row = F.concat(F.lit("  | `"), k.cast("string"), F.lit("` |"), "c_mktsegment", F.lit(" |  "), F.col("c_nationkey").cast("string"), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, row.alias("t")))), lambda x: x["t"]), "\r\n")
    texts = table(spark, folder, "customer").groupBy(F.floor(k / 100).alias("g")).agg(F.concat(F.lit("# title\n\n| key | segment | nation |\n|---|:-:|---|\n"), lines, F.lit("\nend | of text\n")).alias("text"))
    cells = texts.select(F.explode(readers.markdown_rows(F.col("text"))).alias("c")).where("c[0] <> 'key'")
    return cells.select(F.col("c")[0].cast("long").alias("c_custkey"), F.col("c")[1].alias("segment"), F.col("c")[2].alias("nation"))


REPORT_SQL = """
WITH r AS (SELECT doc_id AS position, CASE quality WHEN 1 THEN 'good' ELSE 'open' END AS truth, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN length(text) > {n} THEN 'good' ELSE 'poor' END AS predicted, CASE WHEN length(text) > 2000 THEN 'High' ELSE 'Low' END AS fit,
  CASE toxic WHEN 1 THEN 'High' ELSE 'Low' END AS labelled_fit, CASE WHEN doc_id % 5 > 0 THEN length(text) END AS amount FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, predicted IS NOT NULL AS covered, truth IN ('good', 'poor') AS known FROM r)
"""


def _run(spark: SparkSession, folder: str, least: int) -> DataFrame:
    both = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, folder, "labels"), "doc_id")
    level = lambda c: F.when(c, "High").otherwise("Low")
    return both.select(
        F.col("doc_id").alias("position"), F.when(F.col("quality") == 1, "good").otherwise("open").alias("truth"), F.when(F.col("doc_id") % 7 == 0, None).when(F.col("n") > least, "good").otherwise("poor").alias("predicted"), level(F.col("n") > 2000).alias("fit"),
        level(F.col("toxic") == 1).alias("labelled_fit"), F.when(F.col("doc_id") % 5 > 0, F.col("n")).alias("amount"), *[F.lit(c).alias(c) for c in ("name", "agency", "reason")],
    )


def _sheets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return sinks.report_sheets(_run(spark, folder, 1000), ("good", "poor"), "open", {"모델": "replay"}, _run(spark, folder, 3000))


COUNTS_SQL = """
SELECT unnest([2, 3, 4, 5, 6, 8, 9, 11, 12]) AS line, unnest([count(*), count(predicted), count(*) - count(predicted), count(*) FILTER (covered AND known), count(*) FILTER (covered AND known AND truth = predicted), count(*) FILTER (covered AND NOT known),
  count(*) FILTER (covered AND NOT known AND predicted IN ('good', 'poor')), count(*) FILTER (labelled_fit = 'High'), count(*) FILTER (covered AND fit = 'High')]) AS n FROM s
"""


@query(f"""
SELECT a.line, CAST(a.n AS VARCHAR) AS value, CAST(b.n AS VARCHAR) AS before FROM ({REPORT_SQL.format(n=1000)} {COUNTS_SQL}) a JOIN ({REPORT_SQL.format(n=3000)} {COUNTS_SQL}) b USING (line) UNION ALL SELECT 1, 'replay', NULL
""")
def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A written report's summary of two runs, read again: its counts (the rates beside them are those of scorecard)."""
    path = shared.fresh_folder(spark)
    sinks.write_report({"summary": _sheets(spark, folder)["summary"]}, path)
    read = spark.read.option("header", True).schema("line int, label string, value string, before string").csv(f"{path}/summary")
    return read.where("line not in (7, 10)").select("line", "value", "before")


@query(REPORT_SQL.format(n=1000) + """
SELECT position, truth, predicted, amount, row_number() OVER (ORDER BY coalesce(amount, 0) DESC, position) AS rank FROM s WHERE covered AND truth <> predicted AND truth <> 'open'
UNION ALL SELECT position, truth, predicted, amount, row_number() OVER (ORDER BY coalesce(amount, 0) DESC, position) FROM s WHERE covered AND truth = 'open'
""")
def report_picks(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a report picks out, numbered in its order: by amount, null as 0, then by position."""
    sheets = _sheets(spark, folder)

    def ranked(name: str) -> DataFrame:
        keyed = sheets[name].withColumn("least", -F.coalesce("amount", F.lit(0)))
        return opportunity.assign_batches(keyed.select("least", "position", "truth", "predicted", "amount").withColumnRenamed("position", "at"), ["least", "at"]).select(F.col("at").alias("position"), "truth", "predicted", "amount", (F.col("position") + 1).alias("rank"))

    return ranked("discovered").unionByName(ranked("different"))


SHEETS_SQL = """
WITH l AS (SELECT o_orderpriority AS file, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) + 1 AS r, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 1000 > 3),
g AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE o_orderpriority END AS file, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) + 1 AS r, o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 1000 > 4 OR o_orderkey < 900),
a AS (SELECT file, r, 1 AS c, CAST(o_orderkey AS VARCHAR) AS v FROM l UNION ALL SELECT file, r, 2, o_orderstatus FROM l UNION ALL SELECT DISTINCT file, 1, unnest([1, 2]), unnest(['k', 'status']) FROM l),
b AS (SELECT file, r, 1 AS c, CAST(o_orderkey AS VARCHAR) AS v FROM g UNION ALL SELECT file, r, 2, o_orderstatus FROM g WHERE o_orderstatus <> 'P' UNION ALL SELECT file, r, 3, CAST(o_custkey AS VARCHAR) FROM g
  UNION ALL SELECT DISTINCT file, 1, unnest([1, 2, 3]), unnest(['k', 'state', 'customer']) FROM g),
d AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, a.v AS left_value, b.v AS right_value, a.v IS NOT DISTINCT FROM b.v AS same FROM a FULL JOIN b ON a.file = b.file AND a.r = b.r AND a.c = b.c)
"""


def _sheet_pair(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("key", F.col("o_orderkey"))
    k = F.col("o_orderkey")
    left = orders.where(k % 1000 > 3).select(F.col("o_orderpriority").alias("file"), k.alias("k"), F.concat(F.lit(" "), "o_orderstatus").alias("status"))
    other = F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise(F.col("o_orderpriority"))
    right = orders.where((k % 1000 > 4) | (k < 900)).select(other.alias("file"), k.alias("k"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")).alias("state"), F.col("o_custkey").alias("customer"))
    return evaluation.compare_sheets(left, right, ["k"], "file")


@query(SHEETS_SQL + 'SELECT file, r AS "row", c AS col, left_value, right_value, same FROM d')
def sheet_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Two sheets a file by position: one has a column, rows and a file more, another heading, and blanks."""
    return _sheet_pair(spark, folder)


@query(SHEETS_SQL + """
SELECT file, coalesce(max(r) FILTER (left_value IS NOT NULL), 0) AS left_rows, coalesce(max(r) FILTER (right_value IS NOT NULL), 0) AS right_rows, coalesce(max(c) FILTER (left_value IS NOT NULL), 0) AS left_columns, coalesce(max(c) FILTER (right_value IS NOT NULL), 0) AS right_columns,
  count(*) AS total, count(*) FILTER (NOT same) AS failed FROM d GROUP BY file
""")
def sheet_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.sheet_shapes(_sheet_pair(spark, folder))
