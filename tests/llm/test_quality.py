import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from docframe.llm import quality as q, text as T
from docframe.llm.quality import score_quality
from docframe.llm.queries import QUERIES
from tests.llm.test_operators import EDGE_TEXTS, documents, edges, words

FOLDER = "/root/testdata/sf0.001"


def sparse(r, n, size):
    rows = [sorted(r.sample(range(size), r.randrange(size))) for _ in range(n)]
    return q.Features(np.array(sum(rows, []), np.int64), np.array([r.uniform(-1, 1) for row in rows for _ in row]), np.append(0, np.cumsum([len(x) for x in rows])))


def plain_margin(m, ids, values):
    """Every pair of features."""
    return m.bias + sum(m.weights[i] * x for i, x in zip(ids, values)) + sum(m.factors[i] @ m.factors[j] * x * y for (i, x), (j, y) in combinations(zip(ids, values), 2))


def test_machine_equals_all_pairs():
    r, random_ = random.Random(1), np.random.default_rng(1)
    m, x = q.Machine(0.3, random_.normal(size=9), random_.normal(size=(9, 3))), sparse(r, 20, 9)
    got = m.margins(x)[0]
    for i, (a, b) in enumerate(zip(x.bounds, x.bounds[1:])):
        assert got[i] == pytest.approx(plain_margin(m, x.ids[a:b], x.values[a:b]))


def test_gradient_equals_differences():
    r, random_ = random.Random(2), np.random.default_rng(2)
    m, x = q.Machine(0.1, random_.normal(size=6), random_.normal(size=(6, 2))), sparse(r, 12, 6)
    y = np.array([r.randrange(2) for _ in range(12)], float)
    loss = lambda b, w, v: np.mean(np.logaddexp(0, (f := q.Machine(b, w, v).margins(x)[0])) - y * f)
    gb, gw, gv = m.gradient(x, y)
    e = 1e-6
    assert gb == pytest.approx((loss(m.bias + e, m.weights, m.factors) - loss(m.bias - e, m.weights, m.factors)) / 2 / e, abs=1e-6)
    for i in range(6):
        step = e * np.eye(6)[i]
        assert gw[i] == pytest.approx((loss(m.bias, m.weights + step, m.factors) - loss(m.bias, m.weights - step, m.factors)) / 2 / e, abs=1e-6)
        for k in range(2):
            step = np.zeros((6, 2))
            step[i, k] = e
            assert gv[i, k] == pytest.approx((loss(m.bias, m.weights, m.factors + step) - loss(m.bias, m.weights, m.factors - step)) / 2 / e, abs=1e-6)


def test_pairs_are_learnt():
    """Exclusive or of two features: no weights of single features tell it."""
    rows = [(i % 2, 2 + i // 2 % 2) for i in range(400)]
    x = q.Features(np.array(rows).ravel(), np.ones(800), np.arange(0, 801, 2))
    y = np.array([float(a == b - 2) for a, b in rows])
    m = q.fit_machine(x, y, 4, rank=4, epochs=60, batch=50)
    assert ((m.margins(x)[0] > 0) == (y == 1)).all()


def test_statistics_equal_plain_ones(monkeypatch):
    r = random.Random(3)
    texts = ["", " ", "A", "a a b\nA A", "%%% x### | Wh&&&", "THE END! 12 a1"] + ["".join(r.choice("aB1 #|\n  é") for _ in range(r.randrange(300))) for _ in range(60)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    for segment in (1 << 20, 64):
        monkeypatch.setattr(T, "SEGMENT", segment)
        statistics, bounds, buckets = q.describe(data, offsets)
        for i, t in enumerate(texts):
            w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
            low = [x.lower() for x in w]
            count = lambda test: sum(map(test, w)) / max(1, len(w))
            share = lambda pattern: len(re.findall(pattern, t.encode())) / max(1, len(t.encode()))
            symbol = rb"[!-/:-@\[-`{-~]"
            want = {
                "bytes": np.log1p(len(t.encode())), "words": np.log1p(len(w)), "lines": share(rb"\n"), "word_length": count(len), "distinct": len(set(low)) / max(1, len(w)), "distinct_by_root": len(set(low)) / max(1, len(w) ** 0.5),
                "again": sum(a == b for a, b in zip(low, low[1:])) / max(1, len(w)), "upper": share(rb"[A-Z]"), "digits": share(rb"[0-9]"), "symbols": share(symbol), "symbol_words": count(lambda x: not re.search(rb"[A-Za-z0-9\x80-\xff]", x)),
                "symbol_ends": count(lambda x: bool(re.search(symbol + symbol + rb"$", x))), "shouted": count(lambda x: len(re.findall(rb"[A-Z]", x)) > 1),
            }
            assert dict(zip(q.STATISTICS, statistics[i])) == pytest.approx(want), t
            assert bounds[i + 1] - bounds[i] == len(set(low))
        assert len(buckets) == bounds[-1]


def test_metadata_values():
    rows = pa.RecordBatch.from_pydict({"a": [1, None, 3], "b": ["x", None, "x"], "text": ["", "", ""]})
    got = q.metadata_values(rows, ["a", "b"])
    assert got[0, 0] == 1 and np.isnan(got[1]).all() and got[0, 1] == got[2, 1] and 0 <= got[0, 1] < q.NAMED


def test_good_and_bad_texts_part(spark):
    r = random.Random(6)
    texts = [words(r, r.randrange(20, 90), 400) for _ in range(300)]
    texts = [" | ".join(t.split()) if i % 4 == 0 else t for i, t in enumerate(texts)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(200)] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in score_quality(docs, docs, labels, ["lang", "contamination"]).collect()}
    assert all((got[i] >= 0.5) == (i % 4 > 0) for i in range(300))
    assert got == {x.doc_id: x.score for x in score_quality(docs.repartition(7), docs.repartition(3), labels, ["lang", "contamination"]).collect()}


def test_quality_of_odd_tables(spark):
    docs = edges(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, docs, labels, ["source", "contamination"])
    rows = got.collect()
    assert len(rows) == len(EDGE_TEXTS) + 2 and all(0 <= x.score <= 1 for x in rows) and got.columns.count("score") == 1
    assert len({x.score for x in rows if x.doc_id == 7}) == 1
    assert {x.score for x in score_quality(docs, docs.limit(0), labels).collect()} == {0.5}
    assert {x.score for x in score_quality(docs, docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), docs, labels).count() == 0
    one = score_quality(docs, docs, labels.where("quality = 1"), max_labelled=3).collect()
    assert all(x.score > 0.5 for x in one)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in QUERIES["op12_quality"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
