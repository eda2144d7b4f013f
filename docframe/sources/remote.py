"""Notices and laws as tables: Python data sources whose filters become parameters of the requests.

    register(spark)
    spark.read.format("notices").option("base", "https://host").load().where("day between '20240101' and '20240131' and bid_type = '03'")
    spark.read.format("laws").option("base", "https://host").option("target", "law").option("queries", '["입찰"]').load()

Requests are made by the tasks: the driver plans which task asks for what, and
neither asks, counts nor waits itself. A request that fails is repeated in its
task, with growing pauses. Answers come from a server, or from a folder in which
a Spark job or an earlier run has recorded them.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains

from docframe.operators.rules import NOT_FOUND, first_of_each
from docframe.sources.readers import BID_TYPES
from docframe.sources.shared import files_of, read_lines
from docframe.sources.xml import elements

Ask = Callable[[str, dict[str, str], int], tuple[int, str]]  # path, parameters, attempt from 0 -> status, body


class SourceError(OSError):
    """No usable answer after all attempts."""


@dataclass
class Part(InputPartition):
    """What one task asks for: pages from first on by step (till last, if it is known), a query, or a file of recorded answers."""

    first: int = 1
    step: int = 1
    last: int | None = None
    query: str = ""
    file: str = ""

    def __hash__(self):
        return hash((self.first, self.step, self.query, self.file))


@dataclass
class Asking:
    """How answers are come by; options: base (a URL, or a folder with recorded = true), timeout, attempts, backoff (seconds before the second attempt, doubled for each further one)."""

    base: str
    recorded: bool
    timeout: float
    attempts: int
    backoff: float

    @staticmethod
    def of(options: dict[str, str]) -> Asking:
        if "base" not in options:
            raise ValueError("the option base names the server or the folder of answers")
        return Asking(options["base"].rstrip("/"), options.get("recorded", "false").lower() == "true", float(options.get("timeout", 30)), int(options.get("attempts", 3)), float(options.get("backoff", 0.25)))

    def http(self, path: str, params: dict[str, str], attempt: int) -> tuple[int, str]:
        request = urllib.request.Request(f"{self.base}/{path}?{urllib.parse.urlencode(params)}")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""

    def lines(self, file: str) -> Iterator[tuple[dict, Ask]]:
        """Recorded answers, one request a line: {"page": 1, "query": "", "answers": {path: [{"status": 200, "body": ""}, ...]}}, one for each attempt; the last repeats."""
        for line in filter(None, map(bytes.strip, read_lines(self.base, file))):
            said = json.loads(line)

            def ask(path: str, params: dict[str, str], attempt: int, answers: dict = said["answers"]) -> tuple[int, str]:
                given = answers.get(path) or [{"status": 404, "body": ""}]
                one = given[min(attempt, len(given) - 1)]
                return one["status"], one["body"]

            yield said, ask

    def answer(self, ask: Ask, path: str, params: dict[str, str], parse: Callable[[str], list]) -> list:
        """parse(body) of the first attempt that is answered with 200 and can be parsed."""
        why: Exception | str = ""
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            try:
                status, body = ask(path, params, attempt)
                if status == 200:
                    return parse(body)
                why = f"status {status}"
            except (OSError, ValueError) as e:  # lost, late or unreadable answers
                why = e
        raise SourceError(f"{path} {params}: {why}")


# --- notices

#: The fields of a notice in the answers, and our columns.
NOTICE_FIELDS = {"bidNtceNo": "bid_no", "bidNtceNm": "name", "ntceInsttNm": "agency", "bidNtceDt": "noticed", "bidClseDt": "closes"}
NOTICE_PATHS = ("api/bid-announce", "api/bid-plan")
NOTICE_SCHEMA = "bid_no string, name string, agency string, noticed string, closes string, price long, origin string, bid_type string, day string, page int"


@dataclass
class NoticeReader(DataSourceReader):
    """One task a page or series of pages; the filters on day, bid_type and name are parameters, and hold exactly for the rows."""

    asking: Asking
    options: dict[str, str]
    filters: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        kinds = {"day": (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual), "bid_type": (EqualTo,), "name": (StringContains,)}
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute[0] in kinds:
                continue  # they never are
            if isinstance(f, kinds.get(f.attribute[0] if getattr(f, "attribute", None) else "", ())):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        if self.asking.recorded:
            return [Part(file=f) for f in files_of(self.asking.base)]
        if "pages" in self.options:
            return [Part(first=i, last=i) for i in range(1, int(self.options["pages"]) + 1)]
        n = int(self.options.get("parallel", 8))
        return [Part(first=i + 1, step=n) for i in range(n)]

    def params(self, page: int) -> dict[str, str]:
        day = lambda *kinds: [f.value.replace("-", "") for f in self.filters if f.attribute[0] == "day" and isinstance(f, kinds)]
        first, last = day(EqualTo, GreaterThan, GreaterThanOrEqual), day(EqualTo, LessThan, LessThanOrEqual)
        words = [f.value for f in self.filters if isinstance(f, StringContains)]
        kinds = [f.value for f in self.filters if f.attribute[0] == "bid_type"]
        given = {"fromDate": max(first, default=""), "toDate": min(last, default=""), "bidType": kinds[0] if kinds else "", "andTerms": ",".join(words)}
        return {k: v for k, v in given.items() if v} | {"pageNo": str(page), "numOfRows": self.options.get("perPage", "50")}

    def rows(self, items: list[dict], page: int) -> pa.RecordBatch:
        asked = next((f.value for f in self.filters if f.attribute[0] == "bid_type"), "")
        made = []
        for item in items:
            row = {c: str(item.get(k) or "") for k, c in NOTICE_FIELDS.items()}
            row |= {"price": item.get("presmptPrce"), "origin": item.get("_source") or "unknown", "bid_type": str(item.get("bidType") or asked), "day": "".join(c for c in row["noticed"] if c.isdigit())[:8], "page": page}
            if all(self.holds(f, row[f.attribute[0]]) for f in self.filters):
                made.append(row)
        kinds = [("price", pa.int64()), ("page", pa.int32())]
        return pa.RecordBatch.from_pylist(made, pa.schema([(c, dict(kinds).get(c, pa.string())) for c in (x.split()[0] for x in NOTICE_SCHEMA.split(", "))]))

    @staticmethod
    def holds(f: Filter, value: str) -> bool:
        if isinstance(f, StringContains):
            return f.value in value
        tests = {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}
        return tests[type(f)]

    def items(self, ask: Ask, page: int) -> list[dict]:
        """A page's notices by the first path that answers; where none does, an empty page, or with onError = fail an error."""

        def parse(body: str) -> list[dict]:
            found = json.loads(body)
            if not isinstance(found, dict) or not all(isinstance(x, dict) for x in found.get("items") or []):
                raise ValueError("not a page of notices")
            return found.get("items") or []

        why = None
        for path in self.options.get("paths", ",".join(NOTICE_PATHS)).split(","):
            try:
                return self.asking.answer(ask, path, self.params(page), parse)
            except SourceError as e:
                why = e
        if self.options.get("onError", "empty") == "fail":
            raise why
        return []

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to ask for
            return
        if partition.file:
            for said, ask in self.asking.lines(partition.file):
                yield self.rows(self.items(ask, said["page"]), said["page"])
            return
        for page in range(partition.first, partition.last + 1) if partition.last else count(partition.first, partition.step):
            found = self.items(self.asking.http, page)
            yield self.rows(found, page)
            if len(found) < int(self.options.get("perPage", 50)):
                return


class Notices(DataSource):
    """Options: those of Asking; perPage; pages (a task for each) or parallel (so many tasks take turns till a short page); paths, tried one after the other; onError: empty or fail."""

    @classmethod
    def name(cls) -> str:
        return "notices"

    def schema(self) -> str:
        return NOTICE_SCHEMA

    def reader(self, schema) -> NoticeReader:
        options = _plain(self.options, "base recorded timeout attempts backoff perPage pages parallel paths onError")
        return NoticeReader(Asking.of(options), options)


# --- laws

#: The columns of a kind of law, and the elements that they come from.
LAW_FIELDS = {
    "law": {"name": "법령명한글", "serial": "법령일련번호", "status": "현행연혁코드", "law_id": "법령ID", "day": "시행일자"},
    "admrul": {"name": "행정규칙명", "serial": "행정규칙일련번호", "day": "발령일자", "ministry": "소관부처명"},
}
LAW_PATH = "lawSearch.do"
UNKNOWN = "알 수 없음"
LAW_LABELS = {"law": (("law_id", "법령ID"), ("serial", "MST"), ("day", "시행일")), "admrul": (("serial", "행정규칙일련번호"), ("day", "발령일자"), ("ministry", "소관부처"))}
NO_STATUS, HEADING, NOTHING = "상태 미표시", {"law": "법령 검색어: ", "admrul": "행정규칙 검색어: "}, {"law": " 관련 법령을 찾지 못했습니다.", "admrul": " 관련 행정규칙을 찾지 못했습니다."}
LAW_PAGE = "https://www.law.go.kr/법령/"


def law_rows(xml: str, target: str) -> list[dict[str, str]]:
    """The target's elements, in the document's order, at any depth: each field is the text, at any depth, of its first element. An empty text, a page of HTML or broken XML is an error."""
    if not xml.strip() or "<html" in xml.lower():
        raise ValueError("an empty answer, or a page of HTML")
    try:
        return list(elements(xml, target, LAW_FIELDS[target]))
    except ET.ParseError as e:
        raise ValueError(f"XML: {e}") from e


@dataclass
class LawReader(DataSourceReader):
    """One task a query, or a file of recorded answers. An answer that stays unusable ends the job."""

    asking: Asking
    options: dict[str, str]
    only: list[str] | None = None

    def __post_init__(self):
        self.target = self.options.get("target", "law")
        if "queries" in self.options:
            self.only = json.loads(self.options["queries"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] == "query":
                self.only = [f.value] if self.only is None or f.value in self.only else []
            elif not (isinstance(f, IsNotNull) and f.attribute[0] == "query"):
                yield f

    def partitions(self) -> list[Part]:
        if self.asking.recorded:
            return [Part(file=f) for f in files_of(self.asking.base)]
        if self.only is None:
            raise ValueError("the option queries, or a filter query = '...', says what to ask for")
        return [Part(query=q) for q in self.only]

    def batch(self, ask: Ask, query: str) -> pa.RecordBatch:
        display = max(1, min(100, int(self.options.get("display", 20))))
        params = {"OC": self.options.get("key", ""), "type": "XML", "target": self.target, "query": query, "display": str(display)}
        if self.options.get("knd"):
            params["knd"] = self.options["knd"]
        found = self.asking.answer(ask, self.options.get("path", LAW_PATH), params, lambda body: law_rows(body, self.target))
        made = [{"query": query, "position": i, **row} for i, row in enumerate(found)]
        return pa.RecordBatch.from_pylist(made, pa.schema([("query", pa.string()), ("position", pa.int32()), *[(c, pa.string()) for c in LAW_FIELDS[self.target]]]))

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        if not partition.file:
            yield self.batch(self.asking.http, partition.query)
            return
        for said, ask in self.asking.lines(partition.file):
            if self.only is None or said["query"] in self.only:
                yield self.batch(ask, said["query"])


class Laws(DataSource):
    """Options: those of Asking; target: law or admrul; queries: a JSON array; display (1 to 100); knd; key; path."""

    @classmethod
    def name(cls) -> str:
        return "laws"

    def schema(self) -> str:
        return "query string, position int, " + ", ".join(f"{c} string" for c in LAW_FIELDS[self.options.get("target", "law")])

    def reader(self, schema) -> LawReader:
        options = _plain(self.options, "base recorded timeout attempts backoff target queries display knd key path")
        return LawReader(Asking.of(options), options)


def _plain(options, names: str) -> dict[str, str]:
    return {n: options[n] for n in names.split() if n in options}


def register(spark: SparkSession) -> None:
    """The formats notices and laws for this session, whose filters then reach Python sources (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Notices)
    spark.dataSource.register(Laws)


def read_notices(spark: SparkSession, first: str, last: str, category: str = "all", keywords: list[str] | None = None, **options: str) -> DataFrame:
    """Notices of a span of days, of a category (unknown ones count as goods), with all keywords in their name; options: see Notices."""
    register(spark)
    rows = spark.read.format("notices").options(**options).load().where(F.col("day").between(first.replace("-", ""), last.replace("-", "")))
    if category != "all":
        rows = rows.where(F.col("bid_type") == BID_TYPES.get(category, BID_TYPES["물품"]))
    for word in keywords or []:
        rows = rows.where(F.contains("name", F.lit(word)))
    return rows


#: Queries of contracts are put as these.
ABOUT_CONTRACTS = r"확약|입찰|경쟁|부당\s*특약"
CONTRACT_QUERIES = {"law": ["국가를 당사자로 하는 계약에 관한 법률", "지방자치단체를 당사자로 하는 계약에 관한 법률"], "admrul": ["정부 입찰·계약 집행기준", "지방자치단체 입찰 및 계약집행기준"]}


def search_laws(spark: SparkSession, target: str, queries: list[str], display: int = 20, **options: str) -> DataFrame:
    """The first display laws of the queries, one after the other, each once by its number (or its name, if it has none): number from 1, query, position, and the columns of LAW_FIELDS."""
    register(spark)
    rows = spark.read.format("laws").options(target=target, queries=json.dumps(queries), display=str(display), **options).load()
    turn = F.array_position(F.array(*map(F.lit, queries)), F.col("query"))
    named = rows.withColumn("turn", turn).withColumn("name", F.when(F.col("name") == "", UNKNOWN).otherwise(F.col("name")))
    return first_of_each(named, F.coalesce(F.nullif("serial", F.lit("")), "name"), ["turn", "position"], display).drop("turn")


def law_text(laws: DataFrame, query: str, target: str) -> DataFrame:
    """One row: text, the numbered laws of a search as they are shown, or a remark that nothing was found."""
    quoted = F.url_encode("name")
    for java, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(java), F.lit(wanted))
    url = F.concat(F.lit("\n   - URL: " + LAW_PAGE), quoted) if target == "law" else F.lit("")
    status = F.concat(F.lit(" ["), F.coalesce(F.nullif("status", F.lit("")), F.lit(NO_STATUS)), F.lit("]")) if target == "law" else F.lit("")
    lines = [F.concat(F.lit(f"\n   - {label}: "), F.col(c)) for c, label in LAW_LABELS[target]]
    shown = F.concat(F.col("number").cast("string"), F.lit(". "), "name", status, *lines, url)
    said = laws.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", shown.alias("x")))), lambda r: r["x"]), "\n\n").alias("x"))  # display rows at most
    return said.select(F.concat(F.lit(HEADING[target] + query + "\n\n"), F.coalesce(F.nullif("x", F.lit("")), F.lit(NOT_FOUND + NOTHING[target]))).alias("text"))
