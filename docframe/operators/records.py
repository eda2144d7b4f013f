"""Small record operators: validation, defaults, failure classes, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.compat import blank_to_null

#: Code, status, retryable, message.
FAILURES = [
    ("BAD_REQUEST", 400, False, "요청 형식이 올바르지 않습니다."),
    ("INPUT_TOO_LARGE", 400, False, "문서 분량이 너무 많아 분석할 수 없습니다."),
    ("TAG_MISSING", 400, False, "문서 태그가 확인되지 않아 서약서 검토를 시작할 수 없습니다."),
    ("UNAUTHORIZED", 401, False, "AI 서비스 호출 권한이 없습니다."),
    ("NOT_PORTED", 501, False, "AI 분석 기능이 아직 준비되지 않았습니다."),
    ("EMBEDDING_UNAVAILABLE", 503, False, "임베딩 기능을 사용할 수 없습니다."),
    ("LLM_UNAVAILABLE", 503, True, "AI 분석 서버에 연결할 수 없어 분석을 완료하지 못했습니다."),
    ("LLM_TIMEOUT", 504, True, "AI 분석이 제한 시간 내에 끝나지 않았습니다."),
    ("LLM_MALFORMED", 502, True, "AI 응답을 해석하지 못했습니다."),
    ("INTERNAL", 500, True, "분석 처리 중 오류가 발생했습니다."),
]


def classify_failure(code: Column) -> Column:
    """{code, status, retryable, message} of a failure code; an unknown or null code is INTERNAL."""
    specs = F.create_map(*[x for c, s, r, m in FAILURES for x in (F.lit(c), F.struct(F.lit(c).alias("code"), F.lit(s).cast("long").alias("status"), F.lit(r).alias("retryable"), F.lit(m).alias("message")))])
    return F.coalesce(F.try_element_at(specs, code), F.element_at(specs, F.lit("INTERNAL")))


def failure_body(code: Column, extra: Column, request_id: Column, retry_after_ms: Column) -> Column:
    """A failure's answer as a map of texts: extras that aren't null or empty, the core fields over them, retryAfterMs only where there is one."""
    f = classify_failure(code)
    core = F.create_map(F.lit("code"), f["code"], F.lit("error"), f["message"], F.lit("retryable"), f["retryable"].cast("string"), F.lit("requestId"), request_id)
    own = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != "") & ~k.isin("code", "error", "retryable", "requestId"))
    wait = F.map_filter(F.create_map(F.lit("retryAfterMs"), retry_after_ms.cast("string")), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(own, lambda k, _: k != "retryAfterMs"), core, wait)


def request_id(body: Column, state: Column, header: Column) -> Column:
    """The first that isn't empty of the body's, the state's and the header's, else a new one."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (body, state, header)], F.uuid())


def project_notices(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Notices by the names of their fields upstream (new name to old): missing or null text is '', a missing price null."""
    price = {"price"}
    have = {c: F.col(f"`{c}`") for c in rows.columns}
    text = lambda old: F.coalesce(have[old].cast("string"), F.lit("")) if old in have else F.lit("")
    money = lambda old: have[old].try_cast("long") if old in have else F.lit(None).cast("long")
    return rows.select(*[(money(old) if new in price else text(old)).alias(new) for new, old in names.items()])


def first_set(*values: Column) -> Column:
    """The first value that isn't blank, without a slash at its end."""
    return F.regexp_replace(F.coalesce(*[blank_to_null(v) for v in values]), "/+$", "")


def key_set(secret: Column) -> Column:
    """Whether a secret is set: what masked shows isn't empty."""
    return F.length(F.coalesce(blank_to_null(secret), F.lit(""))) > 0


def masked(secret: Column) -> Column:
    """The last four characters after four dots; blank stays blank."""
    return F.when(F.length(F.coalesce(blank_to_null(secret), F.lit(""))) == 0, "").otherwise(F.concat(F.lit("••••"), F.right(secret, F.lit(4))))


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page number (from 1) of rows in order; at most 200 rows a page."""
    size = max(1, min(size, 200))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def free_worker(workers: DataFrame) -> DataFrame:
    """The healthy worker with the least load for its capacity, then the least used, then the first."""
    return workers.where("healthy and in_flight < capacity").orderBy(F.col("in_flight") / F.col("capacity"), "sequence", "id").limit(1)


def capacity(workers: DataFrame) -> DataFrame:
    return workers.agg(F.coalesce(F.sum(F.when(F.col("healthy"), F.col("capacity"))), F.lit(0)).cast("long").alias("capacity"), F.count_if("healthy").alias("healthy"))


def worker_specs(text: Column) -> Column:
    """[{id, base, capacity}] of 'base@capacity, ...': blank parts are skipped, capacity is 1 to 32 and by default 1."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.btrim(p)), lambda p: p != "")
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "@([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return F.transform(parts, lambda p, i: F.struct((i + 1).cast("long").alias("id"), F.regexp_replace(F.regexp_replace(p, "@[0-9]+$", ""), "/+$", "").alias("base"), F.greatest(F.lit(1), F.least(F.lit(32), number(p))).cast("long").alias("capacity")))
