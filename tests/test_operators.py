import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.operators import evaluation, evidence, generation, hardware, opportunity, records, rendering, rules, vectors
from docframe.operators.chunking import chunk_batches, chunk_documents, chunk_spans
from docframe.sources import readers, sinks, xml

HOSTILE = st.text(alphabet="ab \n\r\t　 \x1c😀한글.", max_size=400)


@given(HOSTILE, st.integers(1, 60), st.integers(0, 70))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, size, overlap):
    spans = list(chunk_spans(text, size, overlap))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(0 < b - a <= size and text[a:b].strip() for a, b in spans)
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)
    assert [a for a, _ in spans] == sorted({a for a, _ in spans})


def test_chunks_are_handed_on_in_parts():
    """A worker never holds all chunks of a batch; none is lost where a part ends."""
    texts = ["ab c\n" * 300, None, "", "x" * 1000, "y z " * 500]
    batch = pa.RecordBatch.from_pydict({"k": list(range(5)), "text": pa.array(texts, pa.string())})
    got = list(chunk_batches(batch, 100, 20, 250))
    assert len(got) > 10 and max(sum(b.column("length").to_pylist()) for b in got) < 250 + 100
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(i, a, b - a, t[a:b]) for i, t in enumerate(texts) for a, b in chunk_spans(t or "", 100, 20)]


def test_chunks_are_in_the_documents_coordinates(spark):
    docs = spark.createDataFrame([(1, "가나다\n" * 400), (2, None), (3, " \n "), (4, "short")], "doc_id long, text string")
    chunks = chunk_documents(docs, 300, 60).join(docs.withColumnRenamed("text", "whole"), "doc_id")
    assert chunks.where(F.substring("whole", F.col("offset").cast("int") + 1, F.col("length").cast("int")) != F.col("text")).count() == 0
    assert {r.doc_id for r in chunks.collect()} == {1, 4}
    with pytest.raises(ValueError):
        chunk_documents(docs, 0)


def plain_locate(quote, source):
    """By the definition: characters that aren't spaces, and where they are."""
    q = (quote or "").strip()
    if not q:
        return None
    if q in source:
        return q, source.index(q), len(q), True
    dense = [(c, i) for i, c in enumerate(source) if not c.isspace()]
    want = [c for c in q if not c.isspace()]
    for k in range(len(dense) - len(want) + 1):
        if [c for c, _ in dense[k : k + len(want)]] == want:
            first, last = dense[k][1], dense[k + len(want) - 1][1]
            return q, first, last + 1 - first, True
    return q, -1, 0, False


def test_locate_equals_the_definition(spark):
    r = random.Random(1)
    letters = ["a", "b", " ", "　", ".", "*", "(", "\\", "E", "Q", "$", "😀", "\x1c", "\n"]
    rows = [("".join(r.choice(letters) for _ in range(r.randint(0, 4))), "".join(r.choice(letters) for _ in range(40))) for _ in range(600)]
    rows += [("64GB", "메모리  64GB\n이상 (ECC)"), ("메모리 64GB 이상", "메모리  64GB\n이상 (ECC)"), ("128GB", "메모리"), (" 　", "x"), (None, "x")]
    got = spark.createDataFrame(rows, "q string, s string").select("q", "s", evidence.locate(F.col("q"), F.col("s")).alias("x"), evidence.occurs(F.col("q"), evidence.bare(F.col("s"))).alias("o")).collect()
    kinds = set()
    for row in got:
        want = plain_locate(row.q, row.s)
        assert (None if row.x.quote is None else tuple(row.x)) == want, (row.q, row.s)
        assert bool(row.o) == bool(want and want[3])
        kinds.add(want and (want[3], want[2] == len(want[0])))
    assert len(kinds) == 4
    nothing = spark.createDataFrame([("q", None)], "q string, s string").select(evidence.locate(F.col("q"), F.col("s")).alias("x")).first().x
    assert tuple(nothing) == ("q", -1, 0, False)


def test_quotes_found_with_other_spaces(spark):
    passage = "the quick brown fox jumps over the lazy dog and goes home"
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, "x " + passage.replace(" ", " \n ") + "z"), (3, "nothing"), (4, None), (5, "a short  one")], "doc_id long, text string")
    quotes = spark.createDataFrame([(10, " " + passage), (11, "short one"), (12, " "), (13, None)], "item long, quote string")
    got = {(r.doc_id, r.item): (r.offset, r.length) for r in evidence.find_quotes(quotes, docs, "item").collect()}
    assert got == {(1, 10): (2, len(passage)), (2, 10): (2, len(passage) + 2 * passage.count(" ")), (5, 11): (2, 10)}


def test_rendering_edges(spark):
    notices = spark.createDataFrame([("1", "t", None, 0), ("2", None, "a", None)], "notice_no string, title string, agency string, amount long")
    documents = spark.createDataFrame([("1", 0, "x", "a" * 20), ("1", 1, "", "b"), ("1", 2, "z", "c")], "notice_no string, position int, name string, text string")
    head = "공고번호: 1\n공고명: t\n수요기관: -\n금액: 0"
    out = {r.notice_no: r.prompt for r in rendering.render_notices(notices, documents, len(head) + 21).collect()}
    assert out["1"] == head + "\n\n[x]\n" + "a" * 20 + "\n\n[첨부]\nb\n\n[z] (분량 초과로 생략)"
    assert out["2"] == "공고번호: 2\n공고명: -\n수요기관: a"


def test_rules_in_their_language(spark):
    docs = spark.createDataFrame([(1, "계약상대자는 타 입찰에\n참가하지 않는다. 일체의 이의를 제기하지 아니한다."), (2, "clean"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in rules.review(docs, F.lit("1. 국가계약법"), F.lit("c" * 600)).collect()}
    assert {f.id for f in found[1].findings} == {"other_bid_ban", "blanket_waiver"} and found[1].verdict == "review_needed" and found[1].summary.startswith("2개")
    assert all(b.verified for f in found[1].findings for b in f.basis) and len(found[1].citations) == 2 and len(found[1].context) == 500
    assert found[2].verdict == found[3].verdict == "no_finding" and found[2].findings == []
    assert not rules.review(docs, F.lit("[NOT_FOUND]")).first().citations[0].verified


def test_sources_come_one_after_the_other(spark):
    one, two = spark.createDataFrame([(5, "a"), (6, "b")], "i int, k string"), spark.createDataFrame([(1, "b"), (2, "c")], "i int, k string")
    assert [(r.source_no, r.i, r.number) for r in rules.first_of_sources([one, two], F.col("k"), ["i"], 3).orderBy("number").collect()] == [(0, 5, 1), (0, 6, 2), (1, 2, 3)]


def test_repeats_go_before_the_limit(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b"), (4, None), (5, "c")], "i int, k string")
    assert [(r.i, r.number) for r in rules.first_of_each(rows, F.coalesce("k", F.lit("?")), ["i"], 3).orderBy("number").collect()] == [(0, 1), (2, 2), (3, 3)]


def test_answers_by_slot(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "batch long, slot long").withColumn("row_id", F.col("slot"))
    answers = spark.createDataFrame([(0, 1, 1, "a"), (0, 1, 2, "b"), (0, 9, 1, "x"), (0, 0, 1, "x")], "batch long, slot long, turn int, verdict string")
    placed = opportunity.place_answers(rows, answers)
    assert {r.slot: r.verdict for r in placed.collect()} == {1: "b", 2: None, 3: None}
    assert [(r.row_id, r.position) for r in opportunity.holes(placed).orderBy("position").collect()] == [(2, 0), (3, 1)]


def test_positions_of_wide_rows(spark):
    """Over the sample's size, with many columns, and ties."""
    rows = spark.range(120_000).select((F.col("id") * 7919 % 120_000).alias("row_id"), F.md5(F.col("id").cast("string")).alias("a"), F.repeat(F.lit("x"), 50).alias("text"), (F.col("id") % 3).alias("few")).repartition(7)
    placed = opportunity.assign_batches(rows, ["row_id"])
    assert placed.where("position <> row_id or batch <> row_id div 10 or slot <> row_id % 10 + 1").count() == 0 and placed.columns == [*rows.columns, "position", "batch", "slot"]
    tied = opportunity.assign_batches(rows, ["few"])
    assert tied.select("position").distinct().count() == 120_000 and [tuple(r) for r in tied.groupBy("few").agg(F.min("position"), F.max("position")).orderBy("few").collect()] == [(0, 0, 39_999), (1, 40_000, 79_999), (2, 80_000, 119_999)]
    again = opportunity.holes(placed.withColumn("verdict", F.when(F.col("row_id") % 2 == 0, "x")))
    assert again.where("row_id <> 2 * position + 1").count() == 0
    assert opportunity.assign_batches(rows.limit(0), ["row_id"]).count() == 0


def test_the_last_of_repeated_answers_wins(spark):
    rows = spark.createDataFrame([(0, 1)], "batch long, slot long")
    answers = spark.createDataFrame([(0, 1, 1, i, f"v{i}") for i in range(20)], "batch long, slot long, turn int, place int, verdict string").repartition(5)
    assert opportunity.place_answers(rows, answers).first().verdict == "v19"


def test_narrow_and_salvage(spark):
    text = '설명\n```json\n[{"자회사": " 브레인웨어 ", "업무구분": "기타", "fit": "High", "제품": "PC", "근거": "' + "가" * 70 + '"}, 3]\n```'
    schema = "struct<`자회사`:string,`업무구분`:string,fit:string,`제품`:string,`근거`:string>"
    x = F.element_at(opportunity.salvage_array(F.col("t"), schema), 1)
    v = spark.createDataFrame([(text,)], "t string").select(opportunity.narrow(x["업무구분"], x["자회사"], x["제품"], x["fit"], x["근거"]).alias("v")).first().v
    assert (v.work_kind, v.subsidiary, v.product, v.fit, len(v.reason)) == ("", "브레인웨어", "PC", "High", 60)


def test_judging_finds_wrong_answers(spark):
    expected = spark.createDataFrame([("c", "required", ["SSD", "8TB"], False, 2, "disk"), ("c", "forbidden", ["HDD"], False, 1, "no disks"), ("c", "must", ["보증", "warranty"], True, 1, "warranty"), ("c", "should", ["note"], True, 1, "note")], "case string, kind string, keywords array<string>, any_of boolean, qty_min int, label string")
    items = lambda name, qty, sel="O": spark.createDataFrame([("c", name, qty, sel)], "case string, name string, qty string, sel string")
    text = spark.createDataFrame([("c", "Warranty 3 years")], "case string, text string")
    good = evaluation.judge_cases(expected, items("ssd 8 TB ×2", None), text).first()
    assert good.passed and good.score == "1/1 required · O행 1/1행" and good.warnings == ["should: note"]
    for name, qty, sel in (("ssd 8 TB", "1", "O"), ("ssd 8 TB", "2", "X"), ("ssd 8TB HDD", "2", "O")):
        assert not evaluation.judge_cases(expected, items(name, qty, sel), text).first().passed


def test_expectations_of_equal_labels_count_each(spark):
    expected = spark.createDataFrame([("c", "required", [k], False, 1, "same") for k in ("ssd", "ram")] + [("c", "forbidden", ["hdd"], False, 1, "no disks")], "case string, kind string, keywords array<string>, any_of boolean, qty_min int, label string")
    items = spark.createDataFrame([("c", "SSD", "1", "o"), ("c", "HDD 1", "8.0", "O"), ("c", "HDD 2", "1", "O"), ("c", "RAM", "1", "X")], "case string, name string, qty string, sel string")
    got = evaluation.judge_cases(expected, items, spark.createDataFrame([("c", "")], "case string, text string")).first()
    assert got.passes == ["required: same"] and got.failures == ["forbidden: no disks → hdd1", "forbidden: no disks → hdd2", "required: same"] and got.score == "1/2 required · O행 3/4행"
    assert not spark.range(1).select(evaluation.enough(F.lit("8.0"), F.lit("x"), F.lit(2)).alias("e")).first().e


def test_requirements_are_undecided_where_they_must_be(spark):
    have = spark.createDataFrame([("p", "cores", "16"), ("p", "ecc", "true"), ("q", "cores", "8")], "part string, attr string, value string")
    want = spark.createDataFrame([("r", "cores", "gte", "16"), ("r", "ecc", "eq", "true"), ("s", "cores", "approx", "16"), ("t", "cores", "gte", "8"), ("t", "tdp_w", "lte", "65")], "requirement string, attr string, op string, value string")
    got = {(r.requirement, r.part): r.verdict for r in hardware.match_requirements(have, want, "part").collect()}
    assert got == {("r", "p"): "pass", ("r", "q"): "fail", ("s", "p"): "needs_review", ("s", "q"): "needs_review", ("t", "p"): "needs_review", ("t", "q"): "needs_review"}


def test_categories_and_workers(spark):
    stray = hardware.stray_attributes(spark.createDataFrame([("RAM", "memory_size_gb"), ("RAM", "capacity_gb"), ("?", "ecc"), (None, "ecc")], "category string, attr string"))
    assert sorted(r.attr for r in stray.collect()) == ["ecc", "ecc", "memory_size_gb"]
    specs = spark.range(1).select(records.worker_specs(F.lit("http://a/@4, ,http://b,http://c@99")).alias("w")).first().w
    assert [(w.id, w.base, w.capacity) for w in specs] == [(1, "http://a", 4), (2, "http://b", 1), (3, "http://c", 32)]


def test_clients_fail_by_row(spark):
    class Client:
        def __call__(self, prompt):
            if "slow" in prompt:
                raise TimeoutError
            if "down" in prompt:
                raise ConnectionError
            if "odd" in prompt:
                raise KeyError
            return " " if "empty" in prompt else "fine"

    prompts = spark.createDataFrame([("1", "ok"), ("2", "slow"), ("3", "down"), ("4", "empty"), ("5", None), ("6", "odd")], "notice_no string, prompt string")
    got = {r.notice_no: (r.summary, r.failure and r.failure.code) for r in generation.summarize(prompts, Client(), "m").collect()}
    assert got == {"1": ("fine", None), "2": (None, "LLM_TIMEOUT"), "3": (None, "LLM_UNAVAILABLE"), "4": (None, "LLM_MALFORMED"), "5": (None, "BAD_REQUEST"), "6": (None, "INTERNAL")}
    notices = spark.createDataFrame([("1", "", "a", None), ("", "t", "a", None), ("", "", "a", None)], "notice_no string, title string, agency string, amount long").where("notice_no <> '' or title <> ''")
    none = spark.createDataFrame([], "notice_no string, position int, name string, text string")
    assert {r.failure for r in generation.summarize(notices, Client(), "m", 1000, none).collect()} == {None}


def test_datasheet_keeps_only_quotes_that_occur(spark):
    answer = json.dumps({"name": "X", "cores": 8, "quotes": {"cores": "8  cores", "tdp": "65 W"}})
    texts = spark.createDataFrame([(1, "X has 8 cores")], "doc_id long, text string")
    sheet = generation.extract_datasheet(texts, generation.ReplayClient({"X": answer}), "struct<name:string,cores:bigint,quotes:map<string,string>>").first().sheet
    assert (sheet.name, sheet.cores, sheet.quotes) == ("X", 8, {"cores": "8  cores"})


def test_children_and_schemas(spark):
    child = {"name": " ", "named": True, "qty": 0, "constraints": [{"attr": "ecc", "op": "eq", "value": "yes"}], "evidence": "two  fans"}
    answer = generation.recorded({"items": [{"category": "완제품", "name": "PC", "named": True, "prebuilt": True, "notes": ["n"], "evidence": "no", "children": [child]}]})
    texts = spark.createDataFrame([(1, "PC with two fans")], "doc_id long, text string")
    got = generation.extract_requirements(texts, generation.ReplayClient({"PC": answer})).first()
    one = got.children[0]
    assert (got.qty, got.prebuilt, got.notes, got.evidence_span.found) == (1, True, ["n"], False)
    assert (one.name, one.named, one.qty, one.constraints[0].value.toPython(), tuple(one.evidence_span)) == (None, False, 1, True, ("two  fans", 8, 8, True))
    asked = generation.response_schema(spark.createDataFrame([], "a string, evidence_span struct<x:int>, c array<struct<b:int,evidence_span:string>>").schema)
    assert asked.simpleString() == "struct<a:string,c:array<struct<b:int>>>"
    assert generation.constrained(lambda prompt, schema: schema, asked)("x") == asked.json()


def test_products_and_loads(spark, tmp_path):
    rows = spark.createDataFrame([(1, ("a", 8), None), (2, ("b", None), None), (3, None, None)], "i int, cpu struct<name:string,cores:int>, gpu struct<name:string,memory:int>")
    good, bad = hardware.extractions(rows)
    assert {r.i: r.is_sufficient_data for r in good.collect()} == {1: True, 2: False} and [r.i for r in bad.collect()] == [3]
    specs = spark.createDataFrame([("a", "8.0"), ("b", None)], "name string, cores string")
    assert readers.load_specs(specs, {"cores": "bigint"}).count() == 2
    for name, cores in (("c", "x"), (None, "1"), ("d", "0"), ("e", "-1")):
        with pytest.raises(Exception):
            readers.load_specs(specs.unionByName(spark.createDataFrame([(name, cores)], specs.schema)), {"cores": "bigint"}).collect()


def test_failures_and_notices(spark):
    extra = F.create_map(F.lit("reason"), F.lit("r"), F.lit("empty"), F.lit(""), F.lit("zero"), F.lit("0"), F.lit("retryable"), F.lit("false"))
    got = spark.range(1).select(records.failure_body(F.lit("NOPE"), extra, records.request_id(F.lit(""), F.lit("s"), F.lit("h")), F.lit(None).cast("long")).alias("b")).first().b
    assert (got["code"], got["retryable"], got["requestId"], got["reason"], got["zero"]) == ("INTERNAL", "true", "s", "r", "0") and "empty" not in got and "retryAfterMs" not in got
    rows = spark.createDataFrame([("1", None, "7"), ("2", "n", "x")], "bidNtceNo string, bidNtceNm string, presmptPrce string")
    names = {"number": "bidNtceNo", "name": "bidNtceNm", "agency": "ntceInsttNm", "price": "presmptPrce"}
    assert [tuple(r) for r in records.project_notices(rows, names).orderBy("number").collect()] == [("1", "", "", 7), ("2", "n", "", None)]
    assert [r.k for r in spark.createDataFrame([("a",), (" ",), (None,)], "s string").select(records.key_set(F.col("s")).alias("k")).collect()] == [True, False, False]


def test_search_bounds(spark):
    docs = spark.createDataFrame([(1, "a b\n" * 300), (2, None)], "doc_id long, text string")
    e = vectors.HashedEncoder(16)
    found = vectors.search_within(docs, "a", e, 99, -5.0, 100, 0).collect()
    assert {r.n_chunks for r in found} == {len(found)} and vectors.search_within(docs, " ", e).count() == 0
    with pytest.raises(ValueError):
        vectors.embed_documents(docs, e, 99)
    got = vectors.embed(docs, e).where("doc_id = 1").first()
    assert got.dim == 16 and got.model == "hashed"


def test_encoder(spark):
    e = vectors.HashedEncoder(16)
    got = [r.v for r in spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(vectors.encode(e)(F.col("t")).alias("v")).collect()]
    assert got[0] == pytest.approx(list(e(["a b a"])[0])) and sum(x * x for x in got[0]) == pytest.approx(1) and set(got[1]) == set(got[2]) == {0.0}


def test_nearest_vectors(spark):
    import numpy as np

    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.6, -0.8, 1.0]) for _ in range(4)]) for i in range(120)] + [(200, None), (201, [1.0]), (202, [None, 0.0, 0.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    value = {i: np.array(v) if v is not None and len(v) == 4 and None not in v else np.zeros(4) for i, v in rows if i is not None}
    for block, least in ((1 << 25, -9.0), (64, 0.5)):
        want = []
        for q in value:
            best = sorted((-round(float(value[q] @ value[i]), 6) + 0.0, i) for i in value if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best) if -s >= least]
        got = vectors.top_k_each(df.where("vec_id is null or vec_id % 1 = 0"), df, 5, least, block_bytes=block)
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == sorted(want)
    assert vectors.top_k_each(df.limit(0), df, 5).count() == 0 and vectors.top_k_each(df, df.limit(0), 5).count() == 0


def test_resident_encoder(spark, tmp_path):
    """Loaded once in each worker, from the shipped artefact, for all tasks and jobs."""
    (tmp_path / "model").mkdir()
    (tmp_path / "model/dim.txt").write_text("8")
    loads = tmp_path / "loads"
    loads.mkdir()

    def load(path):
        import os
        import uuid

        (loads / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return vectors.HashedEncoder(int(open(os.path.join(path, "dim.txt")).read()))

    e = vectors.Resident(spark, load, "shipped", str(tmp_path / "model"))
    texts = spark.range(200).select("id", F.array(F.lit("a b"), F.col("id").cast("string")).alias("texts")).repartition(16)
    for _ in range(3):
        assert {(r.model, r.dim, len(r.vectors)) for r in vectors.embed_requests(texts, e, "id").collect()} == {("shipped", 8, 2)}
    workers = [p.name.split("-")[0] for p in loads.iterdir()]
    assert len(workers) == len(set(workers)) <= 8
    none = vectors.embed_requests(texts.select("id", F.when(F.col("id") > 0, F.array().cast("array<string>")).alias("texts")), e, "id")
    assert {(r.model, r.dim, len(r.vectors)) for r in none.collect()} == {("", 0, 0)}


def test_attached_texts(spark):
    notices = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    texts = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (9, "x"), (None, "n")], "k long, text string")
    assert sorted((r.k or 0, r.text) for r in vectors.attach_texts(notices, texts, "k").collect()) == [(0, ""), (1, "a"), (2, ""), (3, "")]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name , cores,url\n A , 8.0 ,u\nB,x,u\n,,u\nC,,u\n")
    rows = readers.read_catalogue(spark, str(tmp_path / "c.csv"))
    assert rows.columns == ["name", "cores"]
    good, bad = readers.typed(rows, {"cores": "bigint"})
    assert {(r.name, r.cores) for r in good.collect()} == {("A", 8), ("C", None)} and bad.count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"case": "a",\n "n": 1}')
    (tmp_path / "j/b.json").write_text("{broken")
    assert [r.case for r in readers.read_json(spark, str(tmp_path / "j"), "case string, n int").collect()] == ["a"]
    (tmp_path / "x.xml").write_text("<r><law><name> N </name><id>1</id></law><law><name>M</name></law></r>")
    assert {(r.name, r.id) for r in xml.read_nodes(spark, str(tmp_path / "x.xml"), "law", ["id", "name"]).collect()} == {("N", "1"), ("M", "")}
    table = spark.range(1).select(readers.markdown_rows(F.lit("# t\n| code | status |\n|---|---|\n| `A` | 400 |\n")).alias("r")).first().r
    assert table == [["code", "status"], ["A", "400"]]
    (tmp_path / "w.csv").write_text("a,b\nn,서버 (주)!\n ,x\n")
    assert [tuple(r) for r in readers.read_workbook(spark, str(tmp_path / "w.csv"), ["notice", "unit"], "notice", "unit").collect()] == [("n", "서버주")]
    assert readers.read_texts(spark, str(tmp_path / "x.xml")).first().text.startswith("<r>")
    sinks.write_run(good, bad, {"version": "v"}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/rows")).where("version = 'v'").count() == 2
    assert good.orderBy("name").select(sinks.markdown_line(["name", "cores"]).alias("l")).first().l == "| A | 8 |"


def test_elements(spark, monkeypatch):
    r = random.Random(1)

    def tree(depth):
        inner = lambda: "".join(tree(depth + 1) if r.random() < 0.6 and depth < 5 else r.choice([" t ", "x&amp;", "\n", ""]) for _ in range(r.randrange(4)))
        tag = r.choice(["law", "a", "b", "c"])
        return f"<{tag}>{inner()}</{tag}>"

    import xml.etree.ElementTree as ET

    value = lambda n, t: "".join(f.itertext()).strip() if (f := n.find(f".//{t}")) is not None else ""
    for _ in range(200):
        text = "<r>" + "".join(tree(0) for _ in range(4)) + "</r>"
        want = [{"x": value(n, "a"), "y": value(n, "law")} for n in ET.fromstring(text).iter("law")]
        assert list(xml.elements(text, "law", {"x": "a", "y": "law"})) == want
    assert list(xml.elements("<law><a>1</a></law>", "law", {"x": "a"})) == [{"x": "1"}]
    long = "<r>" + "<law><a>é</a></law>" * 20_000 + "</r>"
    assert len(list(xml.elements(long, "law", {"x": "a"}))) == 20_000
    rows = spark.createDataFrame([(1, "<r><law><a>1</a></law><law>"), (2, None), (3, "<r/>"), (4, "<law/>")], "id long, text string")
    got = [(x.id, x.position, x.a, x.error is None) for x in xml.read_elements(rows, "law", {"a": "a"}, ["id"]).orderBy("id", "position").collect()]
    assert got == [(1, 0, "1", True), (1, 1, None, False), (2, 0, None, False), (4, 0, "", True)]
    assert xml.read_elements(rows.limit(0), "law", {"a": "a"}, ["id"]).count() == 0


def test_stream_findings(spark, tmp_path):
    from docframe.streaming.scans import stream_findings

    spark.createDataFrame([(1, "중복 입찰 금지"), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = stream_findings(spark, str(tmp_path / "in"), "doc_id long, text string").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.doc_id for r in spark.table("found").collect()] == [1]


def test_evidence_of_joined_chunks(spark):
    chunks = spark.createDataFrame([(1, 700, "tail 8 GB"), (1, 0, "head"), (2, 0, "x")], "doc_id long, offset int, text string")
    items = evidence.joined_source(chunks, "doc_id", "offset").withColumn("evidence", F.when(F.col("doc_id") == 1, "8  GB").otherwise("16 GB"))
    spans = evidence.attach_evidence(items)
    assert {r.doc_id: (r.text, tuple(r.evidence_span)) for r in spans.collect()} == {1: ("head\n---\ntail 8 GB", ("8  GB", 14, 4, True)), 2: ("x", ("16 GB", -1, 0, False))}
    assert tuple(evidence.evidence_rate(spans).first()) == (1, 2)


def test_sufficiency_and_report(spark):
    rows = spark.createDataFrame([(0, "a", "a", 5.0, None), (1, "확인필요", "a", None, 1), (2, "a", "b", 9.0, None)], "position int, truth string, predicted string, amount double, cores int")
    assert [r.s for r in rows.orderBy("position").select(hardware.sufficient(["cores"]).alias("s")).collect()] == [False, True, False]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "n0", "g", "a", "a", "High", "High", "r,\"q\"", 5.0), (1, "n1", "g", "확인필요", "a", "Low", "Low", "r", None), (2, "n2", None, "a", "b", "Low", "High", "r", 9.0), (3, "n3", "g", "a", None, None, "Low", None, 1.0), (4, "n4", "g", "b", "a", "Low", "Low", "r", 20.0)],
        "position int, name string, agency string, truth string, predicted string, fit string, labelled_fit string, reason string, amount double",
    )
    sheets = sinks.report_sheets(rows, ("a", "b"), "확인필요", {"모델": "m", "프롬프트 버전": "v"}, rows.where("position < 2"))
    assert sinks.write_report(sheets, str(tmp_path / "r")) == {"summary": 13, "all": 5, "discovered": 1, "different": 2}
    read = lambda name: spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r" / name))
    lines = {r.label: (r.value, r.before) for r in read("summary").collect()}
    assert lines["모델"] == ("m", None) and lines["공고 건수"] == ("5", "2") and lines["  일치율(%)"] == ("33.3", "100.0") and lines["  🤖 자회사를 지목한 건"] == ("1", "1")
    assert [(r.name, r.amount) for r in read("different").collect()] == [("n4", "20.0"), ("n2", "9.0")] and read("different").columns == list(sinks.PICKED)
    assert {r.name: (r.verdict, r.reason) for r in read("all").collect()}["n0"] == ("일치", 'r,"q"') and [r.name for r in read("discovered").collect()] == ["n1"]


def test_sheets_by_position(spark):
    left = spark.createDataFrame([("f", 1, " x "), ("f", 2, None), ("g", 5, "only"), (None, 7, "n")], "file string, k int, v string")
    right = spark.createDataFrame([("f", 1, "x", 1.5), ("f", 2, " ", 2.0), ("f", 3, "y", None), ("h", 1, "z", None)], "file string, k int, w string, extra double")
    cells = evaluation.compare_sheets(left, right, ["k"], "file")
    got = {(r.file, r.row, r.col): (r.left_value, r.right_value, r.same) for r in cells.collect()}
    assert got[("f", 1, 2)] == ("v", "w", False) and got[("f", 1, 1)] == ("k", "k", True) and got[("f", 2, 2)] == ("x", "x", True) and ("f", 3, 2) not in got
    assert got[("f", 4, 1)] == (None, "3", False) and got[("f", 2, 3)] == (None, "1.5", False) and got[("g", 2, 2)] == ("only", None, False) and got[("", 2, 1)] == ("7", None, False)
    shapes = {r.file: tuple(r)[1:] for r in evaluation.sheet_shapes(cells).collect()}
    assert shapes["f"] == (3, 4, 2, 3, 10, 6) and shapes["g"][:2] == (2, 0) and shapes["h"][:4] == (0, 2, 0, 3) and shapes[""][1] == 0
