"""Risky clauses by patterns, and ordered results without repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.operators.evidence import excerpt
from docframe.operators.literals import BLOCK_CHARS, Finder, Fold, OnceAWorker, beginnings, blocks, required_literals

#: Id, title, pattern, reason.
RISK_RULES = [
    ("exclusive_supply", "제조사·공급사 독점 조건", r"(특정|해당)\s*(제조사|공급사).{0,80}(독점|단독|유일)|타\s*(제조사|공급사).{0,40}(배제|금지)", "특정 업체만 참여·공급할 수 있도록 하는 조건은 경쟁 제한 및 부당특약 가능성을 확인해야 합니다."),
    ("other_bid_ban", "다른 입찰 참가 제한", r"(타|다른|유사)\s*(입찰|공고|사업).{0,60}(참가하지|응찰하지|제안하지|참가|응찰|제안).{0,30}(금지|제한|불가|않)|중복\s*(입찰|참가).{0,20}(금지|제한)", "해당 계약 이행과 무관하게 다른 입찰 참가까지 제한하면 필요한 범위를 넘는 경쟁 제한인지 확인해야 합니다."),
    ("blanket_waiver", "포괄적 권리 포기", r"(일체의?\s*(이의|민원|소송|청구).{0,30}(제기하지|포기)|어떠한\s*이의도\s*제기하지)", "계약상대자의 권리를 포괄적으로 포기시키는 조항은 계약상 이익을 부당하게 제한하는지 확인해야 합니다."),
]
#: Law, article, heading, url.
LAW_BASES = [
    ("국가를 당사자로 하는 계약에 관한 법률", "제5조제3항·제4항", "계약의 원칙·부당한 특약등", "https://www.law.go.kr/법령/국가를당사자로하는계약에관한법률/제5조"),
    ("지방자치단체를 당사자로 하는 계약에 관한 법률", "제6조제3항", "계약의 원칙·부당한 특약등", "https://www.law.go.kr/법령/지방자치단체를당사자로하는계약에관한법률/제6조"),
]
#: Fixed value: the mark of a search that found nothing.
NOT_FOUND = "[NOT_FOUND]"


def scan_rules(docs: DataFrame, rules: list[tuple[str, str, str, str]] = RISK_RULES, key: str = "doc_id") -> DataFrame:
    """(key, rule_id, title, offset, length, matched, excerpt, reason) of each rule's first match in a text.

    The rules are columns of the scan itself: no join, one pass. Case is
    ignored and a dot matches newlines.
    """

    def finding(rule: tuple[str, str, str, str]) -> Column:
        name, title, pattern, reason = rule
        matched = F.regexp_substr("text", F.lit(f"(?is){pattern}"))
        return F.struct(F.lit(name).alias("rule_id"), F.lit(title).alias("title"), matched.alias("matched"), F.lit(reason).alias("reason"))

    found = docs.select(key, "text", F.inline(F.array(*map(finding, rules)))).where("matched is not null and matched <> ''")
    at = (F.instr("text", F.col("matched")) - 1).cast("long")
    return found.withColumn("offset", at).withColumn("length", F.length("matched").cast("long")).select(
        key, "rule_id", "title", "offset", "length", "matched", excerpt(F.col("text"), F.col("offset").cast("int"), F.col("length").cast("int")).alias("excerpt"), "reason"
    )


FINDING = "rule_id string, title string, offset long, length long, matched string, excerpt string, reason string"


class RuleBook:
    """Rules whose patterns are tried only on texts that hold a string they can't match without, and there only where a match may begin.

    The leftmost place where a pattern matches is that of its search. A pattern
    whose beginnings aren't known is searched for.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = [re.compile(p, re.I | re.S) for p in patterns]
        required, begins = ([of(p, re.I | re.S) for p in patterns] for of in (required_literals, beginnings))
        self.fold = Fold(c for found in (*required, *begins) for s in found or () for c in s)
        folded = lambda each: [None if found is None else frozenset(map(self.fold, found)) for found in each]
        required, begins = folded(required), folded(begins)
        strings = list(dict.fromkeys(s for found in (*required, *begins) for s in found or ()))
        number = {s: n for n, s in enumerate(strings)}
        self.finder = Finder(strings)
        self.always = [i for i, found in enumerate(required) if found is None]
        self.of: dict[int, list[int]] = {}
        for i, found in enumerate(required):
            for s in found or ():
                self.of.setdefault(number[s], []).append(i)
        self.required, self.begins = ([None if found is None else [number[s] for s in found] for found in each] for each in (required, begins))

    def matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(number, offset, matched) of each rule's first match."""
        at: dict[int, list[int]] = {}
        for place, (n,) in self.finder.hits(self.fold(text)):
            at.setdefault(n, []).append(place)
        candidates = set(self.always).union(*(self.of[n] for n in at if n in self.of))
        for i in sorted(candidates):
            if m := self._first(i, text, at):
                yield i, m.start(), m[0]

    def _first(self, i: int, text: str, at: dict[int, list[int]]) -> re.Match | None:
        if self.begins[i] is None:
            return self.patterns[i].search(text)
        match, required = self.patterns[i].match, self.required[i]
        last = len(text) if required is None else max(at[n][-1] for n in required if n in at)
        for place in sorted(p for n in self.begins[i] for p in at.get(n, ()) if p <= last):
            if m := match(text, place):
                return m
        return None


def scan_rule_table(docs: DataFrame, rules: DataFrame, key: str = "doc_id", radius: int = 140, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """As scan_rules, with rules as a DataFrame (rule_id, title, pattern, reason), of any number.

    Patterns are Python's, case is ignored and a dot matches newlines; one that
    can't be compiled is an error before any text is read. The rules come to
    the driver in blocks of about block_chars characters of patterns, each
    broadcast; in a pass over the documents for each block, an automaton finds
    the strings without which a pattern can't match and those with which its
    matches begin; only the patterns of strings that a text holds are tried on
    it (those without such a string, always), where a match may begin. Null texts, and rules with a null pattern, find nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(key, "text").where("text is not null")
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(FINDING)])
    given = rules.select("rule_id", "title", "pattern", "reason").where("pattern is not null")

    def search(block: pa.Table) -> DataFrame:
        for name, pattern in zip(block.column("rule_id").to_pylist(), block.column("pattern").to_pylist()):
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"rule {name}: {e}") from e
        shared = spark.sparkContext.broadcast(block)
        made = OnceAWorker(lambda: RuleBook(shared.value.column("pattern").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = {c: shared.value.column(c).to_pylist() for c in ("rule_id", "title", "reason")}
            for batch in batches:
                found = []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for i, at, matched in made().matches(text):
                        around = re.sub(r"\s+", " ", text[max(0, at - radius) : at + len(matched) + radius]).strip()
                        found.append((row, book["rule_id"][i], book["title"][i], at, len(matched), matched, around, book["reason"][i]))
                row, *columns = zip(*found) if found else ((),) * 8
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

        return texts.mapInArrow(run, schema)

    found = [search(block) for block in blocks(given, "pattern", block_chars)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


#: The parts of a review that don't depend on its text.
CATEGORY, SEVERITY, REVIEW, NOTHING = "competition_or_unfair_term", "high", "review_needed", "no_finding"
FOUND_TEXT, NOTHING_TEXT = "개 위험 신호를 찾았습니다.", "등록된 경쟁 제한·부당특약 위험 신호를 찾지 못했습니다."
CONTEXT = 500


def review(docs: DataFrame, law_text: Column, context: Column | None = None, rules=RISK_RULES, key: str = "doc_id") -> DataFrame:
    """(key, verdict, summary, findings, citations, context) of each document, in one pass.

    findings: an array of id, title, category, severity, verdict, reason,
    offset, length, excerpt and basis, the law bases, each verified if a law
    search (law_text) found something to cite. citations: the same bases.
    context: its first CONTEXT characters.
    """
    verified = F.coalesce(~F.contains(law_text, F.lit(NOT_FOUND)), F.lit(False))
    bases = F.array(*[F.struct(F.lit(a).alias("law"), F.lit(b).alias("article"), F.lit(c).alias("heading"), F.lit(d).alias("url"), verified.alias("verified")) for a, b, c, d in LAW_BASES])
    held = F.array(*[F.struct(F.lit(name).alias("id"), F.lit(title).alias("title"), F.regexp_substr("text", F.lit(f"(?is){pattern}")).alias("matched"), F.lit(reason).alias("reason")) for name, title, pattern, reason in rules])

    def finding(x: Column) -> Column:
        offset, length = F.position(x["matched"], F.col("text")) - 1, F.length(x["matched"])
        fixed = [F.lit(v).alias(k) for k, v in (("category", CATEGORY), ("severity", SEVERITY), ("verdict", REVIEW))]
        return F.struct(x["id"].alias("id"), x["title"].alias("title"), *fixed, x["reason"].alias("reason"), offset.cast("long").alias("offset"), length.cast("long").alias("length"), excerpt(F.col("text"), offset, length).alias("excerpt"), bases.alias("basis"))

    found = docs.withColumn("__found", F.filter(held, lambda x: x["matched"].isNotNull() & (x["matched"] != "")))
    n = F.size("__found")
    return found.select(
        key, F.when(n > 0, REVIEW).otherwise(NOTHING).alias("verdict"), F.when(n > 0, F.concat(n, F.lit(FOUND_TEXT))).otherwise(NOTHING_TEXT).alias("summary"),
        F.transform("__found", finding).alias("findings"), bases.alias("citations"), F.substring(F.lit("") if context is None else context, 1, CONTEXT).alias("context"),
    )


def first_of_sources(sources: list[DataFrame], key: Column, order: list[str], limit: int) -> DataFrame:
    """first_of_each over the sources one after the other, numbered by source from 0: a later source's rows come after all of an earlier one's."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("source_no", F.lit(i)) for i, df in enumerate(sources)])
    return first_of_each(rows, key, ["source_no", *order], limit)


def first_of_each(rows: DataFrame, key: Column, order: list[str], limit: int) -> DataFrame:
    """The first row of each key in order, numbered from 1, up to limit: repeats go before the limit counts.

    The first of each key is taken in parallel; only then are limit rows, a
    report, put in order.
    """
    first = Window.partitionBy("__key").orderBy(*order)
    kept = rows.withColumn("__key", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__key").orderBy(*order).limit(limit)
    return kept.withColumn("number", F.row_number().over(Window.orderBy(*order)).cast("long"))
