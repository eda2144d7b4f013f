"""The queries opN_<name> over whole tables, and the SQL that some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.alignment import align_tokenizers
from docframe.llm.decontamination import find_contamination
from docframe.llm.filter_audit import audit_filters
from docframe.llm.language_id import identify_language
from docframe.llm.language_model import score_texts
from docframe.llm.license_scan import TEMPLATES, scan_licenses, whole_templates
from docframe.llm.mixing import plan_mix, words_taken
from docframe.llm.near_duplicates import near_duplicates
from docframe.llm.pii import BASE_KINDS, find_personal_data
from docframe.llm.quality import score_quality
from docframe.llm.storage import fold, table
from docframe.llm.suffix_dedup import remove_repeats
from docframe.llm.top_k import top_k
from docframe.llm.toxicity import score_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold() == 0
    found = identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), docs.where(~held_out), carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("embedding"))
    return top_k(whole, whole.where("vec_id % 50 = 0"), k=5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_hit = F.aggregate("contamination.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    items = F.col("contamination.items")
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH lists AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM lists WHERE kind = 'b' AND len(w) > 0
), win AS (
  SELECT DISTINCT id AS item_id, m, array_to_string(w[i:i + m - 1], ' ') AS window FROM items
), docs AS (
  SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE kind = 'd'
), hits AS (
  SELECT d.id, d.i, win.m, win.item_id
  FROM (SELECT docs.id, docs.i, l.m, array_to_string(w[i:i + l.m - 1], ' ') AS window FROM docs, (SELECT DISTINCT m FROM win) l WHERE docs.i + l.m - 1 <= len(docs.w)) d
  JOIN win ON win.m = d.m AND win.window = d.window
), covered AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY id
)
SELECT lists.id AS doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lists LEFT JOIN covered ON covered.id = lists.id LEFT JOIN named ON named.id = lists.id WHERE kind = 'd'
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(plan_mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, dice, licenses of each whole document."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_embedded_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_license_scan, with whole licence texts, and notices inside longer lines; its SQL has neither."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_templates(), embedded=True).drop("text")


OP5_SQL = r"""
WITH raw(name, number, t) AS (VALUES __TEMPLATES__),
split AS (SELECT name, number, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
templates AS (SELECT name, number, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS b FROM split),
low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_split_to_array(t, '\r?\n'), regexp_split_to_array(t, '(?:\r?\n){2,}'), [t])) AS u FROM low),
words AS (SELECT doc_id, row_number() OVER () AS unit, regexp_extract_all(u, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM units),
pairs AS (SELECT doc_id, unit, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS b FROM words),
scored AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) AS dice FROM pairs p JOIN templates t ON len(p.b) BETWEEN ceil(len(t.b) * 2 / 3 - 1e-9) AND floor(len(t.b) * 1.5 + 1e-9)),
found AS (SELECT doc_id, name, max(dice) AS dice FROM scored WHERE dice >= 0.8 GROUP BY ALL),
best AS (SELECT doc_id, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses FROM found GROUP BY doc_id)
SELECT d.doc_id, license, round(coalesce(dice, 0), 6)::DOUBLE AS dice, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN best USING (doc_id)
""".replace("__TEMPLATES__", ", ".join("('{}', {}, '{}')".format(n, i, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), size=200, carry=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold() == 1)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: x["base"])
    counts = [F.expr(f"size(filter(pii, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold() == 0
    found = score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), docs.where(~held_out), labels.where(~held_out), carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str = "/opt/tokenizers/byte_bpe_50k.json", b: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), a, b, carry=["doc_id"])


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold() == 0
    found = score_quality(docs.select("doc_id", held_out.alias("held_out"), "text", "n_chars"), docs.where(~held_out), labels.where(~held_out), ["n_chars"], carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, '[' || substr(filter_order, 1, step - 1) || '_]' AS before, '[' || substr(filter_order, 1, step) || ']' AS upto
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS mask
  FROM d LEFT JOIN marks ON marks.doc_id = d.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), audited AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT regexp_matches(mask, upto) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(mask, f) AND NOT regexp_matches(mask, before) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(mask, f) AND regexp_matches(mask, before) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(mask, f) AND NOT regexp_matches(mask, before) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(mask, f) AND NOT regexp_matches(mask, before) THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audited
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_top_k": op2_top_k,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_license_scan": op5_license_scan,
    "op5_embedded_notices": op5_embedded_notices,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_model": op7_language_model,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_quality": op12_quality,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op2_top_k": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_license_scan": OP5_SQL, "op13_filter_audit": OP13_SQL}
