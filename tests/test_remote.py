import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlparse

import pytest
from pyspark.sql import functions as F

from docframe.sources import remote
from docframe.sources.remote import SourceError, law_rows, law_text, read_notices, search_laws


@pytest.fixture(scope="module")
def server():
    """Notices 0 to 104, and laws; what it does with a request depends on its path and how often it has come."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):  # noqa: N802
            url = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            seen.append((url.path, asked))
            status, body = self.answer(url.path.strip("/"), asked, sum(x == seen[-1] for x in seen))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def answer(self, path, asked, times):
            if path.startswith("flaky/") and times < 3:
                return 500, ""
            if path.startswith("down/"):
                return (200, "{broken") if times % 2 else (503, "")
            if path.endswith("plan"):
                return 200, json.dumps({"items": [{"bidNtceNo": "p", "bidNtceNm": "a plan", "bidNtceDt": "2024-01-05", "_source": "plan"}] if asked["pageNo"] == "1" else []})
            if path.endswith("announce"):
                days = [(i, f"2024-01-{1 + i % 28:02d}") for i in range(105)]
                found = [(i, d) for i, d in days if asked.get("fromDate", "") <= d.replace("-", "") <= asked.get("toDate", "9")]
                first = (int(asked["pageNo"]) - 1) * int(asked["numOfRows"])
                return 200, json.dumps({"items": [{"bidNtceNo": str(i), "bidNtceNm": f"notice {i}", "bidNtceDt": d + " 10:00", "presmptPrce": i or None} for i, d in found[first : first + int(asked["numOfRows"])]]})
            if asked["query"] == "html":
                return 200, "<HTML>sorry"
            if asked["query"] == "none":
                return 200, "<LawSearch/>"
            node = lambda n, name: f"<법령일련번호>{n}</법령일련번호><x><법령명한글> {name}<b>!</b> </법령명한글></x><법령명한글>later</법령명한글>"
            return 200, f"<LawSearch><law>{node(1, asked['query'])}</law><y><law>{node(2, 'a&amp;b/c d~*')}</law></y><law><시행일자>20240101</시행일자></law></LawSearch>"

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_notices_by_parameters(spark, server):
    base, seen = server
    for options in ({"parallel": "3"}, {"pages": "4"}):
        seen.clear()
        found = read_notices(spark, "2024-01-03", "2024-01-20", "용역", ["notice"], base=base, perPage="20", backoff="0.01", **options)
        rows = found.collect()
        assert sorted(int(r.bid_no) for r in rows) == [i for i in range(105) if 3 <= 1 + i % 28 <= 20]
        assert {r.bid_type for r in rows} == {"03"} and {r.price for r in rows if r.bid_no != "0"} == {int(r.bid_no) for r in rows if r.bid_no != "0"}
        asked = [a for _, a in seen]
        assert all((a["fromDate"], a["toDate"], a["bidType"], a["andTerms"], a["numOfRows"]) == ("20240103", "20240120", "03", "notice", "20") for a in asked)
        assert sorted({int(a["pageNo"]) for a in asked})[:4] == [1, 2, 3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(line.lstrip("*()0123456789:+- ").startswith("Filter") for line in plan.splitlines())  # the scan itself has them
    assert read_notices(spark, "20240101", "20240131", "no such kind", base=base, pages="1").first().bid_type == "01"
    assert read_notices(spark, "20240101", "20240131", base=base, pages="1").where("day > '20240102' and day < '20240104' and name like '%notice 2%'").first().bid_no == "2"


def test_notices_that_fail(spark, server):
    base, seen = server
    seen.clear()
    ask = lambda **o: read_notices(spark, "20240101", "20240131", base=base, pages="1", backoff="0.01", **o)
    assert ask(paths="flaky/announce").count() == 50 and len(seen) == 3  # answered at the third attempt, in the same task
    assert [r.origin for r in ask(paths="down/announce,plan").collect()] == ["plan"]
    assert ask(paths="down/announce").count() == 0
    with pytest.raises(Exception, match="status 503|JSON|Expecting"):
        ask(paths="down/announce", onError="fail").count()
    assert read_notices(spark, "20240101", "20240131", base="http://127.0.0.1:9", pages="2", backoff="0.01").count() == 0


def test_laws(spark, server):
    base, _ = server
    found = search_laws(spark, "law", ["one", "none", "two"], 4, base=base, backoff="0.01")
    rows = [(r.number, r["query"], r.name, r.serial, r.day) for r in found.orderBy("number").collect()]
    assert rows == [(1, "one", "one!", "1", ""), (2, "one", "a&b/c d~*!", "2", ""), (3, "one", remote.UNKNOWN, "", "20240101")]  # two brings nothing new
    text = law_text(found, "입찰", "law").first().text
    assert text.startswith("법령 검색어: 입찰\n\n1. one! [상태 미표시]\n   - 법령ID: \n   - MST: 1\n   - 시행일: \n   - URL: https://www.law.go.kr/법령/one%21\n\n2. ")
    assert quote("a&b/c d~*!") in text
    nothing = law_text(search_laws(spark, "law", ["none"], base=base), "x", "law").first().text
    assert nothing == "법령 검색어: x\n\n[NOT_FOUND] 관련 법령을 찾지 못했습니다."
    with pytest.raises(Exception, match="HTML"):
        search_laws(spark, "law", ["html"], base=base, backoff="0.01").count()
    assert spark.read.format("laws").option("base", base).load().where(F.col("query") == "one").count() == 3


def test_law_rows():
    with pytest.raises(ValueError, match="XML"):
        law_rows("<law>", "law")
    with pytest.raises(ValueError, match="empty"):
        law_rows(" \n", "law")
    assert law_rows("<r><admrul><행정규칙명>a<i>b</i>c</행정규칙명></admrul></r>", "admrul") == [{"name": "abc", "serial": "", "day": "", "ministry": ""}]


def test_recorded_answers(spark, tmp_path):
    said = {"page": 1, "query": "q", "answers": {"lawSearch.do": [{"status": 500, "body": ""}, {"status": 200, "body": "<r><law><법령명한글>n</법령명한글></law></r>"}]}}
    (tmp_path / "a.txt").write_text(json.dumps(said) + "\n\n" + json.dumps(said | {"query": "other"}))
    (tmp_path / "_SUCCESS").write_text("")
    assert [r.name for r in search_laws(spark, "law", ["q"], base=str(tmp_path), recorded="true", backoff="0.01").collect()] == ["n"]
    with pytest.raises(Exception, match="500"):
        search_laws(spark, "law", ["q"], base=str(tmp_path), recorded="true", attempts="1").count()
    assert issubclass(SourceError, OSError)
    assert read_notices(spark, "20240101", "20240131", base=str(tmp_path / "none"), recorded="true").count() == 0
