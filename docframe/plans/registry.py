"""Queries over the driver's tables with the operators on procurement records, and the SQL that each must equal.

The tables hold invented prose, orders and events; they stand in for notices,
attachments, catalogues and runs, with patterns in their own languages.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import values
from docframe.functions.compat import whole_number
from docframe.operators import evaluation, evidence, generation, hardware, opportunity, records, rendering, requirements, rules, vectors
from docframe.operators.calls import answered
from docframe.operators.chunking import chunk_documents as chunks_of
from docframe.operators.chunking import request_problem
from docframe.plans.base import ORACLE_SQL, PY_SPACE, QUERIES, excerpt_sql, query  # noqa: F401 - the registry's own names
from docframe.sources import remote, shared, xml
from docframe.sources.readers import notices, table


def _cut(s: str) -> str:
    """SQL of where a chunk that begins at s ends."""
    part = f"substr(text, CAST({s} + 526 AS BIGINT), 175)"
    return f"CASE WHEN {s} + 700 >= n THEN n WHEN contains({part}, chr(10)) THEN {s} + 525 + length(regexp_extract({part}, '^(.*\\n)', 1, 's')) ELSE {s} + 700 END"


CHUNKS_SQL = f"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, n, CAST(0 AS BIGINT) AS s, CAST({_cut("0")} AS BIGINT) AS e FROM (SELECT doc_id, text, length(text) AS n FROM documents) WHERE n > 0
  UNION ALL
  SELECT doc_id, text, n, s, CAST({_cut("s")} AS BIGINT) FROM (SELECT doc_id, text, n, greatest(e - 120, s + 1) AS s FROM c WHERE e < n)
), chunks AS (
  SELECT doc_id, s AS "offset", e - s AS length, substr(text, s + 1, e - s) AS text FROM c WHERE regexp_replace(substr(text, s + 1, e - s), '{PY_SPACE}', '', 'g') <> ''
)
"""


@query(CHUNKS_SQL + 'SELECT doc_id, "offset", length FROM chunks')
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(table(spark, folder, "documents")).drop("text")


@query(CHUNKS_SQL + "SELECT lang, count(*) AS n_chunks, CAST(sum(c.length) AS BIGINT) AS n_chars, max(c.length) AS longest FROM chunks c JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chunks = chunks_of(docs.select(F.struct("doc_id", "lang").alias("id"), "text"), key="id")
    return chunks.groupBy("id.lang").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_chars"), F.max("length").alias("longest"))


NEAREST_SQL = """
WITH scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE {which}
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k} AND score >= {least}
"""


EVERY = "q.vec_id % 20 = 0"


@query(NEAREST_SQL.format(which=EVERY, k=10, least=0.0))
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return vectors.top_k_each(v.where("vec_id % 20 = 0"), v, 10, 0.0)


@query(NEAREST_SQL.format(which=EVERY, k=5, least=0.05))
def vector_topk_per_query(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return vectors.top_k_each(v.where("vec_id % 20 = 0"), v, 5, 0.05)


@query(NEAREST_SQL.format(which=EVERY, k=1, least=-1.0))
def vector_topk_all(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other vector, whatever its score."""
    v = table(spark, folder, "embeddings")
    return vectors.top_k_each(v.where("vec_id % 20 = 0"), v, 1)


@query("SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pairwise_similarity(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", vectors.similarity(F.col("embedding"), F.col("next")).alias("score"))


SCORED_SQL = """
, words AS (SELECT doc_id, "offset", unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM chunks)
, parts AS (SELECT doc_id, "offset", CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n FROM words GROUP BY ALL)
, q AS (SELECT CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT unnest(['license', 'rights', 'the', 'reserved']) AS w) GROUP BY ALL)
, norms AS (SELECT doc_id, "offset", sqrt(sum(n * n)) AS norm FROM parts GROUP BY ALL)
, dots AS (SELECT doc_id, "offset", sum(parts.n * q.n) AS dot FROM parts JOIN q USING (b) GROUP BY ALL)
, scored AS (SELECT doc_id, "offset", length, round(coalesce(dot, 0) / coalesce(norm, 1) / (SELECT sqrt(sum(n * n)) FROM q), 6) AS score FROM chunks LEFT JOIN norms USING (doc_id, "offset") LEFT JOIN dots USING (doc_id, "offset"))
"""
FUNNEL_SQL = SCORED_SQL + """
, best AS (SELECT doc_id, greatest(0.0, max(score)) AS score FROM scored GROUP BY doc_id), seen AS (SELECT doc_id, text FROM documents {first})
SELECT doc_id AS notice_id, source AS agency, score, substr(d.text, 1, 1000) AS spec_text, (SELECT count(*) FROM (SELECT 1 FROM documents {scanned})) AS total_notices_searched, (SELECT count(*) FROM seen WHERE length(text) > 50) AS total_specs_found
FROM best JOIN documents d USING (doc_id) WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 10
"""
QUERY = "license rights the reserved"
FEW_SQL = CHUNKS_SQL.replace("FROM documents) WHERE", "FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) AND length(text) > 50) WHERE")
SEARCH_SQL = FEW_SQL + FUNNEL_SQL.format(first="ORDER BY doc_id LIMIT 50", scanned="LIMIT 200")
ALL_SQL = CHUNKS_SQL.replace("FROM documents) WHERE", "FROM documents WHERE length(text) > 50) WHERE") + FUNNEL_SQL.format(first="", scanned="")


def _search(spark: SparkSession, folder: str, **limits) -> DataFrame:
    docs = table(spark, folder, "documents")
    listed = docs.select(F.col("doc_id").alias("notice_id"), F.col("doc_id").alias("position"), F.col("source").alias("agency"))
    return vectors.search_documents(listed, docs.select(F.col("doc_id").alias("notice_id"), "text"), QUERY, vectors.HashedEncoder(), 10, 0.1, **limits).drop("position")


@query(SEARCH_SQL)
def search_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel as it is asked for by default: the first 50 of 200 listed notices are looked at."""
    return _search(spark, folder)


@query(ALL_SQL)
def search_all_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As search_documents, over every document."""
    return _search(spark, folder, scanned=None, examined=None)


@query(CHUNKS_SQL + SCORED_SQL + """
, ranked AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_chunks, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "offset") AS rank FROM scored)
SELECT doc_id, n_chunks, rank, "offset", length, score FROM ranked WHERE rank <= 3 AND score >= 0.05
""")
def search_within(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.search_within(table(spark, folder, "documents"), QUERY, vectors.HashedEncoder(), 3, 0.05)


@query("""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text FROM conversations WHERE role <> 'system' AND conv_id % 3 > 0),
w AS (SELECT conv_id, place, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM c),
p AS (SELECT conv_id, place, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL),
v AS (SELECT conv_id, place, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, place)), 6) AS weight FROM p)
SELECT conv_id, 'hashed' AS model, 64 AS dim, CAST(place AS INTEGER) AS place, CAST(bucket AS INTEGER) AS bucket, weight FROM v UNION ALL SELECT DISTINCT conv_id, '', 0, -1, -1, 0.0 FROM conversations WHERE conv_id % 3 = 0
""")
def embed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of a conversation as a request for vectors; of every third conversation nothing is asked."""
    turns = table(spark, folder, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.when(turns.role != "system", F.struct("turn", "text")))), lambda x: x["text"])
    asked = turns.groupBy("conv_id").agg(texts.alias("texts")).withColumn("texts", F.when(F.col("conv_id") % 3 > 0, F.col("texts")).otherwise(F.array().cast("array<string>")))
    found = vectors.embed_requests(asked, vectors.HashedEncoder(), "conv_id")
    filled = F.flatten(F.transform("vectors", lambda v, i: F.filter(F.transform(v, lambda x, b: F.struct(i.alias("place"), b.alias("bucket"), F.round(x, 6).alias("weight"))), lambda y: y["weight"] > 0)))
    none = F.array(F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("bucket"), F.lit(0.0).alias("weight")))
    return found.select("conv_id", "model", "dim", F.inline(F.when(F.col("dim") > 0, filled).otherwise(none)))


@query("""
WITH q AS (SELECT 'item' AS kind, item_id, text FROM benchmark UNION ALL SELECT 'start', item_id, substr(text, 1, 9) FROM benchmark UNION ALL SELECT 'word', item_id, regexp_extract(text, '[A-Za-z]{3,}') FROM benchmark),
b AS (SELECT kind, item_id, regexp_replace(text, '^%s+|%s+$', '', 'g') AS quote, regexp_replace(text, '%s+', '', 'g') AS bare FROM q),
d AS (SELECT doc_id, text, regexp_replace(text, '%s+', '', 'g') AS bare FROM documents),
m AS (SELECT d.doc_id, b.kind, b.item_id, d.text, b.quote, strpos(d.text, b.quote) AS exact, strpos(d.bare, b.bare) AS pos, length(b.bare) AS n FROM d JOIN b ON contains(d.bare, b.bare) WHERE b.bare <> ''),
l AS (SELECT *, string_split(text, '') AS chars FROM m WHERE exact = 0),
p AS (SELECT *, list_filter(range(1, len(chars) + 1), lambda i: NOT regexp_full_match(chars[i], '%s')) AS places FROM l)
SELECT doc_id, kind, item_id, CAST(exact - 1 AS BIGINT) AS "offset", length(quote) AS length FROM m WHERE exact > 0
UNION ALL SELECT doc_id, kind, item_id, CAST(places[pos] - 1 AS BIGINT), places[pos + n - 1] - places[pos] + 1 FROM p
""".replace("%s", PY_SPACE))
def locate_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item, whole, its first nine characters, and its first word, in the documents that hold them, exactly or with spaces ignored."""
    items = table(spark, folder, "benchmark")
    pick = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("quote"))
    kinds = F.array(pick("item", F.col("text")), pick("start", F.substring("text", 1, 9)), pick("word", F.regexp_extract("text", "[A-Za-z]{3,}", 0)))
    quotes = items.select("item_id", F.inline(kinds)).select(F.struct("kind", "item_id").alias("id"), "quote")
    return evidence.find_quotes(quotes, table(spark, folder, "documents"), "id").select("doc_id", "id.kind", "id.item_id", "offset", "length")


@query("""
WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents)
SELECT doc_id, k.name AS quote FROM c, (VALUES ('first'), ('shouted')) k(name)
WHERE regexp_replace(CASE name WHEN 'first' THEN lines[1] ELSE upper(lines[-1]) END, '%s+', '', 'g') <> ''
  AND contains(regexp_replace(text, '%s+', '', 'g'), regexp_replace(CASE name WHEN 'first' THEN lines[1] ELSE upper(lines[-1]) END, '%s+', '', 'g'))
""".replace("%s", PY_SPACE))
def surviving_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Whole lines as quotes: a document's first, and its last in capitals."""
    docs, lines = table(spark, folder, "documents"), F.split("text", "\n")
    quotes = F.create_map(F.lit("first"), F.element_at(lines, 1), F.lit("shouted"), F.upper(F.element_at(lines, -1)))
    return docs.select("doc_id", F.explode(F.map_keys(evidence.surviving_quotes(quotes, F.col("text")))).alias("quote"))


@query("""
WITH p AS (SELECT conv_id, turn, text, CAST(greatest(0, 400 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS remaining FROM conversations)
SELECT conv_id, turn, remaining, length(substr(text, 1, remaining)) AS n_clipped, CASE WHEN remaining <= 0 THEN 'omitted' WHEN length(text) > remaining THEN 'cut' ELSE 'whole' END AS state FROM p
""")
def render_budget(spark: SparkSession, folder: str) -> DataFrame:
    parts = rendering.clip_to_budget(table(spark, folder, "conversations"), "conv_id", "turn", "text", F.lit(400))
    return parts.select("conv_id", "turn", "remaining", F.length("clipped").cast("long").alias("n_clipped"), "state")


@query("""
WITH head AS (SELECT conv_id, '공고번호: ' || conv_id || chr(10) || '공고명: ' || min_by(role, turn) || chr(10) || '수요기관: -' AS h FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, turn, role, text, h, greatest(0, 600 - length(h) - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS r FROM conversations JOIN head USING (conv_id))
SELECT conv_id AS notice_no, md5(any_value(h) || chr(10) || string_agg(CASE WHEN r <= 0 THEN chr(10) || '[' || role || '] (분량 초과로 생략)'
  ELSE chr(10) || '[' || role || ']' || chr(10) || substr(text, 1, CAST(r AS BIGINT)) || CASE WHEN length(text) > r THEN chr(10) || '…(이하 생략)' ELSE '' END END, chr(10) ORDER BY turn)) AS digest FROM p GROUP BY conv_id
""")
def render_notices(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    heads = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("title")).select(F.col("conv_id").alias("notice_no"), "title", F.lit("").alias("agency"), F.lit(None).cast("long").alias("amount"))
    prompts = rendering.render_notices(heads, turns.select(F.col("conv_id").alias("notice_no"), F.col("turn").alias("position"), F.col("role").alias("name"), "text"), 600)
    return prompts.select("notice_no", F.md5("prompt").alias("digest"))


PLAIN_RULES = [("rights", "Rights", r"all\s+rights.{0,40}reserved", ""), ("licence", "Licence", r"(licensed|distributed)\s+under.{0,60}[0-9.]+", ""), ("secret", "Secret", r"(password|token)\s*=", "")]


AT = "(strpos(text, matched) - 1)"


@query(f"""
WITH r AS (SELECT * FROM (VALUES ('rights', 'all\\s+rights.{{0,40}}reserved'), ('licence', '(licensed|distributed)\\s+under.{{0,60}}[0-9.]+'), ('secret', '(password|token)\\s*=')) t(rule_id, p)),
m AS (SELECT doc_id, rule_id, text, regexp_extract(text, p, 0, 'is') AS matched FROM documents, r)
SELECT doc_id, rule_id, CAST({AT} AS BIGINT) AS "offset", length(matched) AS length, {excerpt_sql(AT, "length(matched)")} AS excerpt FROM m WHERE matched <> ''
""")
def risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.scan_rules(table(spark, folder, "documents"), PLAIN_RULES).select("doc_id", "rule_id", "offset", "length", "excerpt")


@query("""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), r AS (
  SELECT 'near-' || item_id AS rule_id, w[1] || '[ ,.\n]+' || w[2] || '.{0,20}' || w[3] AS p FROM w WHERE len(w) > 2 UNION ALL SELECT 'either-' || item_id, '(' || w[4] || '|' || w[5] || ')[ ]+(' || w[6] || ')?[a-z]*' || w[7] FROM w WHERE len(w) > 6),
m AS (SELECT doc_id, rule_id, text, regexp_extract(text, '(?is)' || p) AS matched FROM documents, r)
SELECT doc_id, rule_id, CAST(strpos(text, matched) - 1 AS BIGINT) AS "offset", length(matched) AS length,
  regexp_replace(regexp_replace(substr(text, greatest(0, strpos(text, matched) - 141) + 1, strpos(text, matched) - 1 + length(matched) + 140 - greatest(0, strpos(text, matched) - 141)), '%s+', ' ', 'g'), '^ | $', '', 'g') AS excerpt
FROM m WHERE matched <> ''
""".replace("%s", PY_SPACE))
def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """Two rules for each benchmark item, made of its words, over every document."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    at = lambda i: F.get(w, F.lit(i))
    near = F.concat(at(0), F.lit("[ ,.\n]+"), at(1), F.lit(".{0,20}"), at(2))
    either = F.concat(F.lit("("), at(3), F.lit("|"), at(4), F.lit(")[ ]+("), at(5), F.lit(")?[a-z]*"), at(6))
    pick = lambda kind, p: F.struct(F.concat(F.lit(kind + "-"), F.col("item_id").cast("string")).alias("rule_id"), F.lit("").alias("title"), p.alias("pattern"), F.lit("").alias("reason"))
    found = rules.scan_rule_table(table(spark, folder, "documents"), table(spark, folder, "benchmark").select(F.inline(F.array(pick("near", near), pick("either", either)))))
    return found.select("doc_id", "rule_id", "offset", "length", "excerpt")


@query("""
WITH k AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM k)
SELECT page_id, host, row_number() OVER (ORDER BY page_id) AS number FROM f WHERE n = 1 ORDER BY page_id LIMIT 20
""")
def dedup_limit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return rules.first_of_each(pages, F.col("host"), ["page_id"], 20)


@query("SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10) AS BIGINT) AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 10 + 1 AS slot FROM documents")
def classify_batches(spark: SparkSession, folder: str) -> DataFrame:
    return opportunity.assign_batches(table(spark, folder, "documents").select(F.col("doc_id").alias("row_id")), ["row_id"])


@query("SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS position, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10) AS BIGINT) AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 10 + 1 AS slot, md5(text) AS digest FROM documents")
def batches_of_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of whole rows: their texts come along."""
    return opportunity.assign_batches(table(spark, folder, "documents"), ["doc_id"]).select("doc_id", "source", "position", "batch", "slot", F.md5("text").alias("digest"))


@query("""
WITH h AS (SELECT doc_id AS row_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT row_id, lang, position, CAST(floor(position / 3) AS BIGINT) AS batch, position % 3 + 1 AS slot FROM h
""")
def retry_holes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose place in their batch got no answer, regrouped; an answer is a label."""
    rows = opportunity.assign_batches(table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "lang", "text"), ["row_id"])
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), "toxic")
    answers = rows.join(labels, "row_id").select("batch", "slot", F.lit(1).alias("turn"), F.col("toxic").alias("verdict"))
    return opportunity.holes(opportunity.place_answers(rows, answers)).select("row_id", "lang", "position", "batch", "slot")


def recorded_verdicts(prompt: str) -> str:
    """A recorded client: of each line it answers with the name's status; in large batches it leaves out P, D is outside the set, and a batch without a line that is O fails."""
    lines = [line.split(" | ")[0].split(". ") for line in prompt.splitlines()[1:]]
    if not any(name.startswith("O") for _, name in lines):
        raise TimeoutError
    found = [{"i": int(i), "subsidiary": name[:1], "work_kind": name[1:], "product": f" {name} ", "fit": "High", "reason": name * 30} for i, name in lines if len(lines) <= 3 or not name.startswith("P")]
    return "Here you are:\n" + json.dumps(found)


STATUS_SETS = {"subsidiaries": ("O", "F", "P"), "work_kinds": ("1-URGENT", "5-LOW")}
CLASSIFY_SQL = """
WITH r AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders),
b AS (SELECT position // 10 AS batch, bool_or(st = 'O') AS ok, count(*) AS n FROM r GROUP BY ALL),
f AS (SELECT r.*, b.ok, ok AND (n <= 3 OR st <> 'P') AS one FROM r JOIN b ON b.batch = r.position // 10),
h AS (SELECT *, (row_number() OVER (ORDER BY position) - 1) // 3 AS rb FROM f WHERE NOT one),
rb AS (SELECT rb, bool_or(st = 'O') AS ok FROM h GROUP BY rb),
again AS (SELECT h.o_orderkey, rb.ok FROM h JOIN rb USING (rb))
"""


def _classified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("name"), "o_totalprice")
    line = lambda slot: rendering.notice_line(slot, F.col("name"), F.lit(""), F.lit(0), F.lit(""), F.lit(""))
    return opportunity.classify(rows, "o_orderkey", line, lambda rows, prompt, into: answered(rows, prompt, recorded_verdicts, into), "Classify:\n", **STATUS_SETS)


@query(CLASSIFY_SQL + """
SELECT o_orderkey, position, CASE WHEN one OR again.ok THEN st END AS subsidiary, CASE WHEN one OR again.ok THEN CASE WHEN pr IN ('1-URGENT', '5-LOW') THEN pr ELSE '' END END AS work_kind,
  CASE WHEN one OR again.ok THEN st || pr END AS product, CASE WHEN one OR again.ok THEN substr(repeat(st || pr, 30), 1, 60) END AS reason FROM f LEFT JOIN again USING (o_orderkey)
""")
def classify_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Batches asked for, holes asked for again; the client is recorded, and leaves out, fails and recovers by rule."""
    found = _classified(spark, folder)[0]
    return found.select("o_orderkey", "position", *[F.col(f"verdict.{c}").alias(c) for c in ("subsidiary", "work_kind", "product", "reason")])


@query(CLASSIFY_SQL + """
SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM f LEFT JOIN again USING (o_orderkey) WHERE NOT one AND NOT coalesce(again.ok, false)) AS missing, (SELECT count(*) FROM b) AS calls, (SELECT count(*) FROM h) AS retried,
  (SELECT count(*) FROM again WHERE ok) AS recovered, 0 AS rejected, (SELECT count(*) FROM b WHERE NOT ok) + (SELECT count(*) FROM rb WHERE NOT ok) AS failed_batches
""")
def classify_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder)[1]


PREDICTIONS_SQL = """
WITH p AS (
  SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'open' END AS truth, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN length(text) > {n} THEN 'good' ELSE 'poor' END AS predicted,
    CASE WHEN length(text) > 2000 THEN 'High' ELSE 'Low' END AS fit, CASE toxic WHEN 1 THEN 'High' ELSE 'Low' END AS labelled_fit FROM documents JOIN labels USING (doc_id)
)
"""
CARD_SQL = """count(*) AS notices, count(predicted) AS analysed, count(*) - count(predicted) AS missing, count(*) FILTER (predicted IS NOT NULL AND truth IN ('good', 'poor')) AS assigned,
  count(*) FILTER (truth = predicted AND truth IN ('good', 'poor')) AS matched, count(*) FILTER (predicted IS NOT NULL AND truth = 'open') AS unassigned, count(*) FILTER (truth = 'open' AND predicted IN ('good', 'poor')) AS discovered,
  count(*) FILTER (predicted IS NOT NULL AND fit = 'High') AS fit_high, count(*) FILTER (labelled_fit = 'High') AS labelled_high"""
RATES_SQL = "CASE WHEN assigned > 0 THEN round_even(matched * 100.0 / assigned, 1) ELSE 0 END::DOUBLE AS match_rate, CASE WHEN unassigned > 0 THEN round_even(discovered * 100.0 / unassigned, 1) ELSE 0 END::DOUBLE AS discovery_rate"


def _predictions(spark: SparkSession, folder: str, least: int) -> DataFrame:
    both = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, folder, "labels"), "doc_id")
    predicted = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("n") > least, "good").otherwise("poor")
    level = lambda c: F.when(c, "High").otherwise("Low")
    return both.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("open").alias("truth"), predicted.alias("predicted"), level(F.col("n") > 2000).alias("fit"), level(F.col("toxic") == 1).alias("labelled_fit"))


@query(PREDICTIONS_SQL.format(n=1000) + "SELECT doc_id, CASE WHEN predicted IS NULL THEN '⚠️미분석' WHEN truth = 'open' THEN '🆕신규발굴' WHEN truth = predicted THEN '일치' ELSE '불일치' END AS verdict FROM p")
def verdict_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder, 1000).select("doc_id", opportunity.row_verdict(F.col("truth"), F.col("predicted"), ("good", "poor"), "open").alias("verdict"))


@query(PREDICTIONS_SQL.format(n=1000) + f"SELECT *, {RATES_SQL} FROM (SELECT {CARD_SQL} FROM p)")
def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    return opportunity.scorecard(_predictions(spark, folder, 1000), ("good", "poor"), "open")


@query("SELECT * FROM (" + PREDICTIONS_SQL.format(n=1000) + f"SELECT 'one' AS run, *, {RATES_SQL} FROM (SELECT {CARD_SQL} FROM p)) UNION ALL SELECT * FROM (" + PREDICTIONS_SQL.format(n=3000) + f"SELECT 'two' AS run, *, {RATES_SQL} FROM (SELECT {CARD_SQL} FROM p))")
def scorecard_compare(spark: SparkSession, folder: str) -> DataFrame:
    runs = _predictions(spark, folder, 1000).withColumn("run", F.lit("one")).unionByName(_predictions(spark, folder, 3000).withColumn("run", F.lit("two")))
    return opportunity.scorecard(runs, ("good", "poor"), "open", ["run"])


@query("""
SELECT p_partkey, attr, value, unit FROM (
  SELECT p_partkey, 'cores' AS attr, CAST(p_size AS VARCHAR) AS value, NULL AS unit FROM part UNION ALL SELECT p_partkey, 'socket', p_brand, NULL FROM part
  UNION ALL SELECT p_partkey, 'memory_type', CASE WHEN p_size > 25 THEN p_type END, NULL FROM part UNION ALL SELECT p_partkey, 'ecc', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, NULL FROM part
  UNION ALL SELECT p_partkey, 'tdp_w', CAST(p_size * 10 AS VARCHAR), 'W' FROM part) WHERE value IS NOT NULL
""")
def canonical_attrs(spark: SparkSession, folder: str) -> DataFrame:
    return hardware.canonical_attributes(_catalogue(spark, folder), "p_partkey", hardware.CPU_ATTRS)


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").alias("cores"), F.col("p_brand").alias("socket"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("memory_types"),
        F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("No").alias("ecc_support"), (F.col("p_size") * 10).alias("tdp_w"),
        F.col("p_type").alias("category"),
    )


CONSTRAINTS = [("big", "cores", "gte", "30"), ("big", "ecc", "eq", "true"), ("cool", "tdp_w", "lte", "150"), ("cool", "cores", "approx", "10"), ("exact", "cores", "eq", "16")]


@query("""
WITH c AS (SELECT * FROM (VALUES ('big', 'cores', 'gte', '30'), ('big', 'ecc', 'eq', 'true'), ('cool', 'tdp_w', 'lte', '150'), ('cool', 'cores', 'approx', '10'), ('exact', 'cores', 'eq', '16')) t(requirement, attr, op, wanted)),
a AS (SELECT p_partkey, 'cores' AS attr, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'ecc', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END FROM part UNION ALL SELECT p_partkey, 'tdp_w', CAST(p_size * 10 AS VARCHAR) FROM part),
m AS (SELECT requirement, p_partkey, CASE op WHEN 'approx' THEN NULL WHEN 'gte' THEN TRY_CAST(value AS DOUBLE) >= TRY_CAST(wanted AS DOUBLE) WHEN 'lte' THEN TRY_CAST(value AS DOUBLE) <= TRY_CAST(wanted AS DOUBLE) ELSE value = wanted END AS ok FROM a JOIN c USING (attr)),
g AS (SELECT requirement, p_partkey, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad FROM m GROUP BY ALL)
SELECT requirement, p_partkey, n_ok, n AS n_constraints, CASE WHEN n_bad > 0 THEN 'fail' WHEN n_ok = n THEN 'pass' ELSE 'needs_review' END AS verdict
FROM g JOIN (SELECT requirement, count(*) AS n FROM c GROUP BY ALL) USING (requirement)
""")
def requirement_match(spark: SparkSession, folder: str) -> DataFrame:
    attributes = hardware.canonical_attributes(_catalogue(spark, folder), "p_partkey", hardware.CPU_ATTRS)
    return hardware.match_requirements(attributes, spark.createDataFrame(CONSTRAINTS, "requirement string, attr string, op string, value string"), "p_partkey")


TREE_SQL = """
WITH prod AS (SELECT p_partkey, p_type AS category, p_size AS cores, lower(p_brand) AS socket, p_size % 2 = 0 AS ecc, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_partkey % 5 END AS quantity FROM part),
req AS (SELECT n_nationkey AS k, ['ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE'] AS kinds, n_nationkey % 3 + 1 AS qty FROM nation),
parts AS (
  SELECT k, 0 AS part, kinds[k % 6 + 1] AS category, qty AS need, k % 10 = 0 AS equivalent FROM req
  UNION ALL SELECT k, 1, kinds[(k + 1) % 6 + 1], qty * (CASE WHEN k % 4 = 1 THEN 500 ELSE 2 END), false FROM req UNION ALL SELECT k, 2, CASE WHEN k % 2 = 0 THEN 'NONE' ELSE 'SMALL' END, qty, false FROM req WHERE k % 7 > 0
), conditions AS (
  SELECT k, part, category, need, equivalent, p_partkey, quantity, CASE part WHEN 0 THEN cores >= k * 2 ELSE socket = 'brand#' || (k % 20 + 1) END AS one, CASE WHEN part = 0 THEN ecc WHEN k % 4 = 0 OR k % 6 = 1 THEN NULL ELSE cores <= 20 END AS two
  FROM parts JOIN prod USING (category) WHERE part < 2
), matches AS (
  SELECT k, part, p_partkey, quantity, CAST(one IS TRUE AS INTEGER) + CAST(two IS TRUE AS INTEGER) AS n_met, CAST(one IS FALSE AS INTEGER) + CAST(two IS FALSE AS INTEGER) AS n_unmet, CAST(one IS NULL AS INTEGER) + CAST(two IS NULL AS INTEGER) AS n_open,
    CASE WHEN equivalent THEN 'needs_review' WHEN NOT one OR NOT two THEN 'fail' WHEN one AND two THEN 'pass' ELSE 'needs_review' END AS verdict FROM conditions
)
"""


def _requirements(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Products' attributes, and the parts of what a model has found: a set with children for each nation, values as flags, numbers and texts."""
    k, kinds = F.col("n_nationkey"), F.array(*map(F.lit, ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")))
    kind = lambda n: F.element_at(kinds, (n % 6 + 1).cast("int"))
    rule = lambda attr, op, value: F.concat(F.lit(f'{{"attr":"{attr}","op":'), op, F.lit(',"value":'), value, F.lit(',"raw":"x"}'))
    said = lambda text: F.lit(f'"{text}"')
    part = lambda category, qty, *rules: F.concat(F.lit('{"category":"'), category, F.lit('","qty":'), qty.cast("string"), F.lit(',"constraints":['), F.concat_ws(",", *rules), F.lit("]"))
    socket = F.concat(F.lit('" bRAND#'), (k % 20 + 1).cast("string"), F.lit(' "'))
    first = part(kind(k + 1), F.when(k % 4 == 1, 500).otherwise(2), rule("socket", said("eq"), socket), rule("cores", F.when(k % 4 == 0, '"approx"').otherwise('"lte"'), F.when(k % 6 == 1, '"20"').otherwise("20")))
    second = F.when(k % 7 > 0, F.concat(F.lit(","), part(F.when(k % 2 == 0, "NONE").otherwise("SMALL"), F.lit(1)), F.lit("}"))).otherwise("")
    item = part(kind(k), k % 3 + 1, rule("cores", said("gte"), (k * 2).cast("string")), rule("ecc", said("eq"), said("지원")))
    answer = F.concat(F.lit('{"items":['), item, F.lit(',"allow_equivalent":'), (k % 10 == 0).cast("string"), F.lit(',"children":['), first, F.lit("}"), second, F.lit("]}]}"))
    found = table(spark, folder, "nation").select("n_nationkey", opportunity.salvage_object(answer, f"struct<items:array<{generation.ITEM}>>")["items"].alias("items"))
    parts = requirements.requirement_parts(found.withColumn("items", F.transform("items", generation.tidy_item)), "n_nationkey")
    return hardware.canonical_values(_catalogue(spark, folder), "p_partkey", hardware.CPU_ATTRS, keep=("category",)), parts


@query(TREE_SQL + "SELECT k AS n_nationkey, part, p_partkey, n_met, n_unmet, n_open, verdict FROM matches")
def requirement_parts(spark: SparkSession, folder: str) -> DataFrame:
    attributes, parts = _requirements(spark, folder)
    return requirements.match_parts(attributes, parts, "n_nationkey", "p_partkey").drop("item")


@query(TREE_SQL + """
, held AS (SELECT category, sum(quantity) AS total, count(*) FILTER (quantity IS NULL) AS unknown FROM prod GROUP BY category),
s AS (SELECT k, part, sum(quantity) FILTER (verdict = 'pass') AS sure, sum(quantity) FILTER (verdict = 'fail') AS lost, count(*) FILTER (verdict = 'fail' AND quantity IS NULL) AS lost_unknown FROM matches GROUP BY ALL),
p AS (SELECT k, part, need, coalesce(sure, 0) AS sure, CASE WHEN coalesce(unknown, 0) - coalesce(lost_unknown, 0) = 0 THEN coalesce(total, 0) - coalesce(lost, 0) END AS possible FROM parts LEFT JOIN s USING (k, part) LEFT JOIN held USING (category)),
v AS (SELECT *, CASE WHEN sure >= need THEN 'pass' WHEN possible < need THEN 'fail' ELSE 'needs_review' END AS verdict FROM p),
i AS (SELECT k, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'needs_review') THEN 'needs_review' ELSE 'pass' END AS verdict FROM v GROUP BY k)
SELECT k AS n_nationkey, 'part' AS level, 0 AS item, part, CAST(need AS BIGINT) AS need, CAST(sure AS BIGINT) AS sure, CAST(possible AS BIGINT) AS possible, verdict FROM v
UNION ALL SELECT k, 'item', 0, NULL, NULL, NULL, NULL, verdict FROM i UNION ALL SELECT k, 'requirement', NULL, NULL, NULL, NULL, NULL, verdict FROM i
""")
def requirement_tree(spark: SparkSession, folder: str) -> DataFrame:
    attributes, parts = _requirements(spark, folder)
    k = F.col("p_partkey")
    stock = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("category"), F.when(k % 97 != 0, k % 5).alias("quantity"))
    return requirements.roll_up(requirements.match_parts(attributes, parts, "n_nationkey", "p_partkey"), parts, stock, "n_nationkey", "p_partkey")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'flag' WHEN 3 THEN 'number' END AS kind, CASE event_id % 5 WHEN 0 THEN value WHEN 3 THEN floor(value) END::DOUBLE AS n,
  CASE WHEN event_id % 5 = 2 THEN value > 20 END AS flag, CASE WHEN event_id % 5 = 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS t FROM events
""")
def constraint_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values as a model writes them: numbers, numbers in quotes, flags, whole numbers, and neither."""
    whole = F.floor("value").cast("string")
    said = F.element_at(F.array(F.col("value").cast("string"), F.concat(F.lit('"'), whole, F.lit('"')), (F.col("value") > 20).cast("string"), whole, F.concat(F.lit("["), whole, F.lit("]"))), (F.col("event_id") % 5 + 1).cast("int"))
    v = values.value(F.try_parse_json(said))
    return table(spark, folder, "events").select("event_id", values.kind(v).alias("kind"), values.number(v).alias("n"), values.flag(v).alias("flag"), values.text(v).alias("t"))


@query("""
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '%s+', '', 'g') AS b FROM documents)
SELECT doc_id, contains(b, 'allrights') AND contains(b, 'reserved') AS has_all, contains(b, 'licensedunder') OR contains(b, 'password=') AS has_any FROM t
""".replace("%s", PY_SPACE))
def keyword_quantifiers(spark: SparkSession, folder: str) -> DataFrame:
    held = lambda words, any_of: evaluation.has_keywords(F.col("text"), F.array(*map(F.lit, words)), F.lit(any_of))
    return table(spark, folder, "documents").select("doc_id", held(("All Rights", "Reserved"), False).alias("has_all"), held(("licensed under", "password ="), True).alias("has_any"))


@query("SELECT p_partkey, p_size >= 20 OR coalesce(TRY_CAST(regexp_extract(p_name || ' x ' || p_size * 2, '[×x*]\\s*([0-9]+)', 1) AS BIGINT) >= 20, false) AS enough FROM part")
def quantity_test(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" x "), (F.col("p_size") * 2).cast("string"))
    return table(spark, folder, "part").select("p_partkey", evaluation.enough(F.col("p_size").cast("string"), name, F.lit(20)).alias("enough"))


DIFF_SQL = """
WITH a AS (SELECT o_orderpriority AS file, o_orderkey AS cell, o_orderstatus AS value FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderpriority AS file, o_orderkey AS cell, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 13 <> 0),
d AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.cell, b.cell) AS cell, a.value AS left_value, b.value AS right_value, a.value IS NOT DISTINCT FROM b.value AS same FROM a FULL JOIN b ON a.file = b.file AND a.cell = b.cell)
"""


def _diff(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("value"))
    changed = orders.where("cell % 13 <> 0").withColumn("value", F.when(F.col("cell") % 5 != 0, F.col("value")))
    return evaluation.compare_cells(orders.where("cell % 11 <> 0"), changed, ["file", "cell"])


@query(DIFF_SQL + "SELECT * FROM d")
def table_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder)


@query(DIFF_SQL + "SELECT file, count(*) AS total, count(*) FILTER (same) AS matched, count(*) FILTER (NOT same) AS failed FROM d GROUP BY file")
def file_diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.compare_files(_diff(spark, folder), "file")


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 5000) b ON a.k = b.k
""")
def code_set_diff(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.set_differences(table(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), table(spark, folder, "supplier").where("s_acctbal < 5000").select("s_nationkey"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '' END AS work_kind, o_orderstatus AS subsidiary, substr('  ' || o_orderpriority, 3) AS product, '' AS fit, substr(repeat(o_orderpriority, 9), 1, 60) AS reason
FROM orders WHERE o_orderstatus IN ('F', 'O')
""")
def enum_narrow(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    verdict = opportunity.narrow(p, F.col("o_orderstatus"), F.concat(F.lit("  "), p, F.lit("　")), F.lit("Huge"), F.repeat(p, F.lit(9)), ("F", "O"), ("1-URGENT", "2-HIGH"))
    return table(spark, folder, "orders").select("o_orderkey", verdict.alias("v")).where("v is not null").select("o_orderkey", "v.*")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN '' WHEN 3 THEN 'false' ELSE 'No' END AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS name, event_id % 3 <> 0 AS named FROM events
""")
def flag_normalise(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("event_id") % 5
    value = F.element_at(F.array(*map(F.lit, (" No ", "ECC", "", "미지원", "No"))), (turn + 1).cast("int"))
    attr = F.when(turn == 4, "form_factor").otherwise("ecc")
    name, named = hardware.reconcile_name(F.when(F.col("event_id") % 3 == 0, F.lit(" 　")).otherwise(F.col("event_type")), F.lit(True))
    return table(spark, folder, "events").select("event_id", hardware.flag_value(attr, value).alias("value"), name.alias("name"), named.alias("named"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 0 ELSE CAST(floor(value) AS BIGINT) % 4 END AS n_objects FROM events")
def json_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of as many copies of props as value says, in a fence, beside elements that aren't objects; of small values the array is broken off."""
    n = F.pmod(F.floor("value"), F.lit(4)).cast("int")
    objects = F.array_join(F.concat(F.array_repeat("props", n), F.array(F.lit("7"), F.lit('"x"'))), ", ")
    text = F.concat(F.lit("```json\n["), objects, F.when(F.col("value") < 20, "").otherwise("]\n``` done"))
    return table(spark, folder, "events").select("event_id", F.size(opportunity.salvage_array(text, "struct<k:string>")).cast("long").alias("n_objects"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS n FROM events")
def coerce_integers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as text: those of clicks whole, with a point and a zero, the others as they are."""
    text = F.when(F.col("event_type") == "click", F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(".0 "))).otherwise(F.col("value").cast("string"))
    return table(spark, folder, "events").select("event_id", whole_number(text).alias("n"))


@query("""
SELECT p_partkey, attr, value, unit FROM (SELECT p_partkey, 'memory_size_gb' AS attr, CAST(p_size AS VARCHAR) AS value, 'GB' AS unit FROM part UNION ALL SELECT p_partkey, 'memory_type', p_type, NULL FROM part
  UNION ALL SELECT p_partkey, 'shaders', CASE WHEN p_size % 3 > 0 THEN CAST(p_size * 64 AS VARCHAR) END, NULL FROM part UNION ALL SELECT p_partkey, 'tdp_w', CAST(p_size * 10 AS VARCHAR), 'W' FROM part) WHERE value IS NOT NULL
""")
def canonical_gpu_attrs(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    gpus = table(spark, folder, "part").select("p_partkey", size.alias("memory_size"), F.col("p_type").alias("memory_type"), F.when(size % 3 > 0, size * 64).alias("shaders"), (size * 10).alias("tdp"), size.alias("base_clock"))
    return hardware.canonical_attributes(gpus, "p_partkey", hardware.GPU_ATTRS)


@query(f"""
WITH r AS (SELECT * FROM (VALUES (1, 'rights', 'Rights', 'all\\s+rights.{{0,40}}reserved'), (2, 'licence', 'Licence', '(licensed|distributed)\\s+under.{{0,60}}[0-9.]+'), (3, 'secret', 'Secret', '(password|token)\\s*=')) t(n, rule_id, title, p)),
m AS (SELECT doc_id, n, rule_id, title, text, lang, regexp_extract(text, p, 0, 'is') AS matched FROM documents, r),
f AS (SELECT doc_id, n, rule_id || '/' || title || '/' || {AT} || '/' || length(matched) || '/' || {excerpt_sql(AT, "length(matched)")} || '/' || coalesce(lang <> 'de', false) AS one FROM m WHERE matched <> ''),
g AS (SELECT doc_id, count(*) AS k, string_agg(one, '; ' ORDER BY n) AS findings FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN k > 0 THEN 'review_needed' ELSE 'no_finding' END AS verdict, CASE WHEN k > 0 THEN k || '개 위험 신호를 찾았습니다.' ELSE '등록된 경쟁 제한·부당특약 위험 신호를 찾지 못했습니다.' END AS summary,
  coalesce(findings, '') AS findings, '제5조제3항·제4항, 제6조제3항' AS articles, coalesce(lang <> 'de', false) AS verified, coalesce(substr(source || text, 1, 500), '') AS context FROM documents LEFT JOIN g USING (doc_id)
""")
def law_review(spark: SparkSession, folder: str) -> DataFrame:
    law_text = F.when(F.col("lang") == "de", "[NOT_FOUND] nothing").when(F.col("lang").isNotNull(), "1. a law")
    found = rules.review(table(spark, folder, "documents"), law_text, F.coalesce(F.concat("source", "text"), F.lit("")), PLAIN_RULES)
    one = lambda x: F.concat_ws("/", x["id"], x["title"], x["offset"], x["length"], x["excerpt"], x["basis"][1]["verified"])
    return found.select("doc_id", "verdict", "summary", F.array_join(F.transform("findings", one), "; ").alias("findings"), F.array_join("citations.article", ", ").alias("articles"), F.col("citations")[0]["verified"].alias("verified"), "context")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN s IS NOT NULL AND s NOT BETWEEN 100 AND 4000 THEN 'size must be between 100 and 4000' WHEN o IS NOT NULL AND o NOT BETWEEN 0 AND 1000 THEN 'overlap must be between 0 and 1000' END AS problem
FROM (SELECT *, CASE WHEN l_linenumber < 7 THEN CAST(l_quantity * 90 AS INTEGER) END AS s, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity * 25 AS INTEGER) - 50 END AS o FROM lineitem)
""")
def chunk_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for chunks, of which some ask for what none may."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    size, overlap = F.when(n < 7, (q * 90).cast("int")), F.when(n > 1, (q * 25).cast("int") - 50)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", request_problem(size, overlap).alias("problem"))


@query("""
WITH j AS (SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS t, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(t) AS digest, CAST(strpos(t, regexp_replace(last, '^%s+|%s+$', '', 'g')) - 1 AS BIGINT) AS "offset" FROM j
""".replace("%s", PY_SPACE))
def joined_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Turns joined to one source, in whose coordinates the last turn is located."""
    turns = table(spark, folder, "conversations")
    joined = evidence.joined_source(turns, "conv_id", "turn").join(turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last")), "conv_id")
    return joined.select("conv_id", F.md5("text").alias("digest"), evidence.locate(F.col("last"), F.col("text"))["offset"].alias("offset"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size > 10 WHEN 1 THEN p_size > 20 WHEN 2 THEN p_size > 10 OR p_size > 20 END AS is_sufficient_data, p_partkey % 4 = 3 AS rejected FROM part
""")
def product_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted products: CPU, GPU, both or neither, some with a name only."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    product = lambda c, field, least: F.when(c, F.struct(F.col("p_name").alias("name"), F.when(size > least, size).alias(field))).alias("x")
    rows = table(spark, folder, "part").select("p_partkey", product(k.isin(0, 2), "cores", 10).alias("cpu"), product(k.isin(1, 2), "shaders", 20).alias("gpu"))
    good, bad = hardware.extractions(rows)
    return good.select("p_partkey", "is_sufficient_data", F.lit(False).alias("rejected")).unionByName(bad.select("p_partkey", F.lit(None).cast("boolean").alias("is_sufficient_data"), F.lit(True).alias("rejected")))


@query("""
WITH c AS (SELECT p_partkey, ['CPU', 'RAM', '케이스', '기타', 'none'][p_size % 5 + 1] AS category, ['cores', 'ecc', 'form_factor', 'no_such'][p_partkey % 4 + 1] AS attr FROM part)
SELECT * FROM c WHERE NOT (category = 'CPU' AND attr IN ('cores', 'ecc') OR category = 'RAM' AND attr IN ('ecc', 'form_factor') OR category = '케이스' AND attr = 'form_factor')
""")
def stray_attributes(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    asked = table(spark, folder, "part").select("p_partkey", pick(("CPU", "RAM", "케이스", "기타", "none"), F.col("p_size") % 5).alias("category"), pick(("cores", "ecc", "form_factor", "no_such"), F.col("p_partkey") % 4).alias("attr"))
    return hardware.stray_attributes(asked)


SPAN = T.StructType().add("offset", T.LongType())
SHEET = T.StructType().add("name", T.StringType()).add("cores", T.LongType()).add("quotes", T.MapType(T.StringType(), T.StringType())).add("evidence_span", SPAN)


def recorded_datasheet(prompt: str, wanted: str) -> str:
    """A recorded client that is told in which schema to answer: it fills in the fields that are asked for, and more."""
    fields = [f["name"] for f in json.loads(wanted)["fields"]]
    lines = prompt.split("\n")
    sheet = {"name": lines[0][:20], "cores": len(lines), "quotes": {"first": " ".join(lines[0].split()), "invented": "no such passage"}, "evidence_span": {"offset": 7}}
    return "```json\n" + json.dumps({k: v for k, v in sheet.items() if k in fields} | {"more": 1}, ensure_ascii=False) + "\n```" if "|" not in lines[0] else "no data"


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, regexp_replace(text, '%s+', '', 'g') AS bare FROM documents)
SELECT doc_id, CASE WHEN NOT contains(l[1], '|') THEN substr(l[1], 1, 20) END AS name, CASE WHEN NOT contains(l[1], '|') THEN len(l) END AS cores, CASE WHEN NOT contains(l[1], '|') AND regexp_replace(l[1], '%s+', '', 'g') <> '' THEN 'first' ELSE '' END AS kept, false AS filled FROM d WHERE bare IS NOT NULL AND array_to_string(l, chr(10)) <> ''
""".replace("%s", PY_SPACE))
def datasheets(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of products by a client that is asked for a schema; what the server fills in isn't part of it, and quotes that don't occur go."""
    client = generation.constrained(recorded_datasheet, SHEET)
    docs = table(spark, folder, "documents").select("doc_id", "text").where("text <> ''")
    found = generation.extract_datasheet(docs, client, SHEET.simpleString())
    return found.select("doc_id", "sheet.name", "sheet.cores", F.array_join(F.map_keys(F.coalesce("sheet.quotes", F.create_map().cast("map<string,string>"))), ",").alias("kept"), F.col("sheet.evidence_span").isNotNull().alias("filled"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS number, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS name, '' AS agency, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS price FROM orders
""")
def projected_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Notices by their fields upstream, of which one is absent, some are null, and some prices aren't numbers."""
    k = F.col("o_orderkey")
    price = F.when(k % 4 == 1, F.lit("unknown")).otherwise(F.floor("o_totalprice").cast("string"))
    rows = table(spark, folder, "orders").select(k.alias("bidNtceNo"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("bidNtceNm"), price.alias("presmptPrce"))
    return records.project_notices(rows, {"number": "bidNtceNo", "name": "bidNtceNm", "agency": "ntceInsttNm", "price": "presmptPrce"})


@query("""
WITH s AS (SELECT 0 AS source_no, c_nationkey AS k, c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 = 0 UNION ALL SELECT 1, s_nationkey, s_suppkey FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_no, id) AS n FROM s)
SELECT source_no, k, id, row_number() OVER (ORDER BY source_no, id) AS number FROM f WHERE n = 1 ORDER BY source_no, id LIMIT 20
""")
def first_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A second source adds what the first one hasn't, after it."""
    one = table(spark, folder, "customer").where("c_acctbal > 0 and c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    two = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return rules.first_of_sources([one, two], F.col("k"), ["id"], 20)


@query("SELECT d.doc_id, length(coalesce(b.text, '')) AS n FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def attached_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return vectors.attach_texts(table(spark, folder, "documents").select("doc_id"), texts, "doc_id").select("doc_id", F.length("text").alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'LLM_TIMEOUT' ELSE 'INTERNAL' END AS code, CAST(CASE event_id % 3 WHEN 0 THEN 504 ELSE 500 END AS BIGINT) AS status, true AS retryable FROM events")
def failure_lookup(spark: SparkSession, folder: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("LLM_TIMEOUT"), F.lit("NO_SUCH"), F.lit(None).cast("string")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", records.classify_failure(code).alias("f")).select("event_id", "f.code", "f.status", "f.retryable")


@query("SELECT c_custkey, '••••' || right(c_name, 4) AS masked, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'http://host' END AS base FROM customer")
def config_values(spark: SparkSession, folder: str) -> DataFrame:
    base = records.first_set(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("/"))).otherwise(" "), F.lit(None).cast("string"), F.lit("http://host//"))
    return table(spark, folder, "customer").select("c_custkey", records.masked(F.col("c_name")).alias("masked"), base.alias("base"))


@query("SELECT o_orderkey, o_orderkey || '. ' || o_orderpriority || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN '발주:' || o_orderstatus || ' | ' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '금액미상' ELSE CAST(o_orderkey AS VARCHAR) || '억' END || ' | - | -' AS line FROM orders")
def notice_lines(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = rendering.notice_line(k, F.col("o_orderpriority"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(""), F.when(k % 3 == 0, 0).otherwise(k), F.lit(None).cast("string"), F.lit(""))
    return table(spark, folder, "orders").select("o_orderkey", line.alias("line"))


@query("""
SELECT o_orderkey, o_orderpriority AS name FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19950101' AND '19961231' AND o_orderstatus = 'O' AND contains(o_orderpriority, 'U') ORDER BY o_orderkey LIMIT 50 OFFSET 50
""")
def notice_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.when(F.col("o_orderstatus") == "O", "03").otherwise("01").alias("bid_type"))
    found = notices(rows, "1995-01-01", "1996-12-31", "용역", ["U"])
    return records.page(found, ["o_orderkey"], 2, 50).select("o_orderkey", "name")


def _recorded(requests: DataFrame) -> str:
    """A folder with the answers of requests (page, query, answers), as a server's log has them."""
    folder = shared.fresh_folder(requests.sparkSession)
    requests.select(F.to_json(F.struct("page", "query", "answers"))).write.text(folder)
    return folder


def _answer(status: Column | int, body: Column | str = "") -> Column:
    given = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(given(status).alias("status"), given(body).alias("body"))


NOTICE_PAGE = 200  # orders by key to a page


@query(f"""
WITH o AS (SELECT *, o_orderkey // {NOTICE_PAGE} AS page, strftime(o_orderdate, '%Y%m%d') AS day FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS bid_no, o_orderpriority AS name, day, CAST(floor(o_totalprice) AS BIGINT) AS price, CASE WHEN page % 5 = 0 THEN 'plan' ELSE 'unknown' END AS origin, CAST(page AS INTEGER) AS page
FROM o WHERE page % 11 <> 3 AND day BETWEEN '19950101' AND '19961231' AND o_orderstatus = 'O' AND contains(o_orderpriority, 'U')
""")
def notice_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of recorded answers: some are had from the second path, some at the second attempt, and some not at all, which then are empty."""
    page = F.floor(F.col("o_orderkey") / NOTICE_PAGE)
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("bidNtceNo"), F.col("o_orderpriority").alias("bidNtceNm"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("bidNtceDt"), F.floor("o_totalprice").alias("presmptPrce"),
        F.when(F.col("o_orderstatus") == "O", "03").otherwise("01").alias("bidType"), F.when(page % 5 == 0, "plan").alias("_source"),
    )
    pages = table(spark, folder, "orders").groupBy(page.alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))  # NOTICE_PAGE items at most
    p = F.col("page")
    lost, good = F.array(_answer(503)), F.array(_answer(200, F.col("body")))
    answers = F.create_map(
        F.lit("api/bid-announce"), F.when((p % 5 == 0) | (p % 11 == 3), lost).when(p % 7 == 1, F.array(_answer(500), _answer(200, F.col("body")))).otherwise(good),
        F.lit("api/bid-plan"), F.when((p % 5 == 0) & (p % 11 != 3), good).otherwise(lost),
    )
    found = remote.read_notices(spark, "1995-01-01", "1996-12-31", "용역", ["U"], base=_recorded(pages.select("page", F.lit("").alias("query"), answers.alias("answers"))), recorded="true", attempts="2", backoff="0.001")
    return found.select("bid_no", "name", "day", "price", "origin", "page")


def _law_xml(spark: SparkSession, folder: str) -> DataFrame:
    """(group, xml): laws of 50 parts by key; names lie deep and in pieces, some have no number."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("<x><법령명한글> "), F.col("p_name"), F.lit("<b> &amp; "), F.col("p_type"), F.lit("</b>\n</법령명한글></x><법령명한글>later</법령명한글>"))
    serial = F.when(k % 3 > 0, F.concat(F.lit("<y><법령일련번호>"), k.cast("string"), F.lit("</법령일련번호></y>"))).otherwise("")
    law = F.concat(F.lit("<law>"), name, serial, F.lit("<현행연혁코드/></law>"))
    laws = F.array_sort(F.collect_list(F.struct(k.alias("k"), law.alias("law"))))
    grouped = table(spark, folder, "part").groupBy(F.floor(k / 50).alias("group")).agg(F.array_join(F.transform(laws, lambda x: x["law"]), "\n").alias("laws"))
    return grouped.select("group", F.concat(F.lit("<LawSearch><page>1</page>"), "laws", F.lit("</LawSearch>")).alias("xml"))


LAWS_SQL = "p_name || ' & ' || p_type AS name, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS serial, '' AS status"


@query(f"SELECT 'q' || CAST(p_partkey // 50 AS VARCHAR) AS query, CAST(p_partkey % 50 AS INTEGER) AS position, {LAWS_SQL} FROM part")
def law_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All recorded searches; every fourth is answered by a page of HTML at first, and asked again in its task."""
    g = F.col("group")
    good = _answer(200, F.col("xml"))
    answers = F.create_map(F.lit(remote.LAW_PATH), F.when(g % 4 == 0, F.array(_answer(200, "<html>busy</html>"), good)).otherwise(F.array(good)))
    folder = _recorded(_law_xml(spark, folder).select(g.alias("page"), F.concat(F.lit("q"), g.cast("string")).alias("query"), answers.alias("answers")))
    remote.register(spark)
    return spark.read.format("laws").options(base=folder, recorded="true", target="law", backoff="0.001").load().select("query", "position", "name", "serial", "status")


@query(f"""
SELECT p_partkey // 50 AS "group", CAST(p_partkey % 50 AS INTEGER) AS position, {LAWS_SQL}, false AS broken FROM part
UNION ALL SELECT DISTINCT p_partkey // 50, CAST(count(*) OVER (PARTITION BY p_partkey // 50) AS INTEGER), CAST(NULL AS VARCHAR), NULL, NULL, true FROM part WHERE p_partkey // 50 % 3 = 1
""")
def xml_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements at any depth of every text; every third text lacks its end, and has a row for that."""
    texts = _law_xml(spark, folder).select("group", F.when(F.col("group") % 3 == 1, F.regexp_replace("xml", "</LawSearch>$", "")).otherwise(F.col("xml")).alias("text"))
    found = xml.read_elements(texts, "law", {"name": "법령명한글", "serial": "법령일련번호", "status": "현행연혁코드"}, ["group"])
    return found.select("group", "position", "name", "serial", "status", F.col("error").isNotNull().alias("broken"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(1000, floor(((CASE l_linenumber % 3 WHEN 0 THEN 16384 WHEN 1 THEN l_quantity * 1000 ELSE 8192 END) - 912) * 1.5)) AS BIGINT) AS budget FROM lineitem")
def input_budgets(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("l_linenumber") % 3
    loaded, configured = F.when(turn == 0, 16384), F.when(turn == 1, (F.col("l_quantity") * 1000).cast("int")).otherwise(0)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", rendering.input_budget(loaded, configured).alias("budget"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 20 ORDER BY s_nationkey / 20.0, s_acctbal, s_suppkey LIMIT 1")
def worker_choice(spark: SparkSession, folder: str) -> DataFrame:
    workers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("healthy"), F.col("s_nationkey").alias("in_flight"), F.lit(20).alias("capacity"), F.col("s_acctbal").alias("sequence"))
    return records.free_worker(workers).select("id")


@query("SELECT CAST(coalesce(sum(CASE WHEN s_acctbal > 0 THEN s_nationkey END), 0) AS BIGINT) AS capacity, count(*) FILTER (s_acctbal > 0) AS healthy FROM supplier")
def worker_capacity(spark: SparkSession, folder: str) -> DataFrame:
    return records.capacity(table(spark, folder, "supplier").select((F.col("s_acctbal") > 0).alias("healthy"), F.col("s_nationkey").alias("capacity")))


@query("""
WITH p AS (SELECT doc_id, '공고번호: ' || doc_id || chr(10) || '공고명: ' || coalesce(nullif(source, ''), '-') || chr(10) || '수요기관: ' || coalesce(nullif(lang, ''), '-') AS h, text FROM documents),
t AS (SELECT doc_id, h || chr(10) || CASE WHEN 4000 - length(h) <= 0 THEN '' ELSE substr(coalesce(text, ''), 1, CAST(4000 - length(h) AS BIGINT)) END AS t FROM p)
SELECT CAST(doc_id AS VARCHAR) AS notice_no, CASE WHEN contains(t, 'password') THEN NULL WHEN contains(t, 'rights reserved') THEN 'Reserved.' ELSE 'A notice.' END AS summary, CASE WHEN contains(t, 'password') THEN 'LLM_TIMEOUT' END AS code FROM t
""")
def llm_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of every document, its prompt rendered within 4,000 characters, by a recorded client that times out on some."""
    docs = table(spark, folder, "documents").withColumn("notice_no", F.col("doc_id").cast("string"))
    notices_ = docs.select("notice_no", F.col("source").alias("title"), F.col("lang").alias("agency"), F.lit(None).cast("long").alias("amount"))
    parts = docs.select("notice_no", F.lit(0).alias("position"), F.lit("text").alias("name"), "text")
    found = generation.summarize(notices_, recorded_summary, "replay", 4000, parts)
    return found.select("notice_no", "summary", F.col("failure.code").alias("code"))


def recorded_summary(prompt: str) -> str:
    if "password" in prompt:
        raise TimeoutError
    return "Reserved. " if "rights reserved" in prompt else " A notice."


@query("""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '%s+', '', 'g') AS bare, strpos(text, 'All rights reserved.') AS exact FROM documents WHERE contains(text, 'rights reserved')),
l AS (SELECT *, CASE WHEN exact = 0 THEN strpos(bare, 'Allrightsreserved.') ELSE 0 END AS pos FROM d),
p AS (SELECT *, CASE WHEN pos > 0 THEN list_filter(range(1, length(text) + 1), lambda i: NOT regexp_full_match(string_split(text, '')[i], '%s')) END AS places FROM l)
SELECT doc_id, 'CPU' AS category, CAST(NULL AS VARCHAR) AS name, false AS named, 2 AS qty, 'false' AS flag, exact + pos > 0 AS found, CAST(CASE WHEN exact > 0 THEN exact - 1 WHEN pos > 0 THEN places[pos] - 1 ELSE -1 END AS BIGINT) AS "offset",
  CAST(CASE WHEN exact > 0 THEN 20 WHEN pos > 0 THEN places[pos + 17] - places[pos] + 1 ELSE 0 END AS BIGINT) AS length, 'fan' AS child, true AS child_found FROM p
""".replace("%s", PY_SPACE))
def extract_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """Items and their children by a recorded client, their evidence located in the documents, with other spaces too."""
    child = {"name": "fan", "named": True, "evidence": "reserved"}
    item = {"category": "CPU", "name": " ", "named": True, "qty": 2, "constraints": [{"attr": "ecc", "op": "eq", "value": "미지원", "raw": "x"}], "evidence": "All rights reserved.", "children": [child]}
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = generation.extract_requirements(docs, generation.ReplayClient({"rights reserved": generation.recorded({"items": [item]})}, "{}"))
    one = F.col("children")[0]
    return found.select(
        "doc_id", "category", "name", "named", "qty", values.shown(F.col("constraints")[0]["value"]).alias("flag"), "evidence_span.found", "evidence_span.offset", "evidence_span.length", one["name"].alias("child"), one["evidence_span"]["found"].alias("child_found")
    )


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, lower(regexp_replace(line, '%s+', '', 'g')) AS line FROM l),
t AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '%s+', '', 'g')) AS b FROM documents),
c AS (SELECT doc_id, coalesce(bool_or(contains(line, 'allrights') AND contains(line, 'reserved')), false) AS required, count(*) FILTER (contains(line, 'password=') ) AS forbidden, count(line) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id AS "case", CASE WHEN required THEN 1 ELSE 0 END || '/1 required · O행 ' || n || '/' || n || '행' AS score, CAST(CASE WHEN required THEN 0 ELSE 1 END + forbidden + CASE WHEN contains(b, 'licensed') OR contains(b, 'reserved') THEN 0 ELSE 1 END AS INTEGER) AS n_failures,
  contains(b, 'warranty') = false AS warned, required AND forbidden = 0 AND (contains(b, 'licensed') OR contains(b, 'reserved')) AS passed FROM c JOIN t USING (doc_id)
""".replace("%s", PY_SPACE))
def judge_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an answer, its lines as the rows chosen, against one set of expectations."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("case"), "text")
    rows = [("required", ["All rights", "reserved"], False, "notice"), ("forbidden", ["password ="], False, "secret"), ("must", ["licensed", "Reserved"], True, "terms"), ("should", ["warranty"], True, "warranty")]
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, words)).alias("keywords"), F.lit(some).alias("any_of"), F.lit(1).alias("qty_min"), F.lit(label).alias("label")) for k, words, some, label in rows])
    expected = docs.select("case", F.inline(wanted))
    chosen = docs.select("case", F.explode(F.split("text", "\n")).alias("name"), F.lit("1").alias("qty"), F.lit("O").alias("sel"))
    judged = evaluation.judge_cases(expected, chosen, docs)
    return judged.select("case", "score", F.size("failures").alias("n_failures"), (F.size("warnings") > 0).alias("warned"), "passed")


from docframe.plans import formats  # noqa: E402, F401 - its queries register themselves
