import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docframe.llm import alignment as al
from docframe.llm.alignment import align_tokenizers
from docframe.llm.queries import QUERIES
from tests.llm.test_operators import EDGE_TEXTS, documents, edges

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = ["▁ a▁b", "<s> <|endoftext|> </s> it's we'll", "  a  b \n\n  c\t d \r\n e ", " x　y \x1c z\x85", "日本語 テキスト ümläut ÀÉ", "😀😀 👍🏽‍", "\x00\x01 a", "=" * 300 + " " * 70 + "1234567890123", "á é", "▁"]


def plain_alignment(texts):
    """Whole texts by the two libraries, tokens one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            made.append(None)
            continue
        ends = [set(np.cumsum([len(t) for t in x]).tolist()) for x in (bytes_a, bytes_b)]
        cuts = sorted(ends[0] & ends[1])
        groups = {c: ([], []) for c in cuts}
        for side, (ids, tokens) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
            at = 0
            for i, t in zip(ids, tokens):
                at += len(t)
                groups[cuts[np.searchsorted(cuts, at)]][side].append(i)
        made.append((ids_a, ids_b, list(groups.values()), Counter((x, y) for g in groups.values() for x in g[0] for y in g[1])))
    docs = Counter(pair for m in made if m for pair in m[3])
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
        out.append((len(m[0]), len(m[1]), len(m[2]), m[3].total(), sum(n for p, n in m[3].items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in m[3].items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


def aligned(docs):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(docs, A, B, carry=["doc_id"]).collect()}


def test_alignment_equals_brute_force(spark):
    r = random.Random(4)
    texts = [*EDGE_TEXTS, *ODD] + ["".join(r.choice([" ", " ", "\n", "the", "Hauß", "x1", "'s", "▁" if i % 9 == 0 else "e", "--", "日", "\t", "  "]) for _ in range(r.randrange(80))) for i in range(150)]
    docs = documents(spark, texts).repartition(6)
    assert aligned(docs) == dict(enumerate(plain_alignment(texts)))


@pytest.mark.parametrize("limits", [{"STRETCH": 7, "CACHED": 5}, {"WIDE": 1}])
def test_alignment_within_limits(monkeypatch, limits):
    """Long texts in stretches, a full cache, early sums and wide groups: in this process, as workers have their own limits."""
    for k, v in limits.items():
        monkeypatch.setattr(al, k, v)
    texts = [t for t in ODD * 2 if t] + ["Le petit chat est là, isn't it? 12345678 " * 5]
    units = al.Units(open(A, "rb").read(), open(B, "rb").read())
    rows = list(al.aligned_rows(units, texts))
    docs = Counter(k for r in rows for k in r[5].tolist())
    best = defaultdict(int)
    for k, n in docs.items():
        best[k >> units.bits] = max(best[k >> units.bits], n)
    pairs = [list(zip(r[5].tolist(), r[6].tolist())) for r in rows]
    got = [(*r[:4], sum(n for k, n in p if docs[k] == best[k >> units.bits]), sum(n * docs[k] for k, n in p), r[4]) for r, p in zip(rows, pairs)]
    assert got == plain_alignment(texts)


def test_whole_texts_as_units():
    units = al.Units(open(A, "rb").read(), open(B, "rb").read())
    cut = al.Units(open(A, "rb").read(), open(B, "rb").read())
    assert units.cut
    units.cut = False
    for t in [*ODD, "Le petit chat  est là,\nisn't it?"]:
        (one,), (other,) = al.aligned_rows(units, [t]), al.aligned_rows(cut, [t])
        assert one[:5] == other[:5] and np.array_equal(one[5], other[5]) and np.array_equal(one[6], other[6])


def test_alignment_of_odd_tables(spark):
    docs = edges(spark)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = plain_alignment([t for _, t in rows])
    got = sorted((r.doc_id or -1, *[r[c] for c in COLUMNS]) for r in align_tokenizers(docs.withColumn("n_a", docs.score).withColumn("key", docs.score), A, B).collect())
    assert got == sorted((i or -1, *w) for (i, _), w in zip(rows, want))
    assert aligned(docs.limit(0)) == {}


def test_pair_counts(spark, monkeypatch):
    """Several shards, and keys that come again from a task."""
    monkeypatch.setattr(al, "HELD", 3)
    r = random.Random(8)
    lists = [sorted(r.sample(range(0, 60), r.randrange(20))) for _ in range(80)]
    pairs = spark.createDataFrame([([k << 3 for k in x],) for x in lists], "k array<long>").repartition(5)
    counts = al.count_pairs(pairs, "k", 5, 60, shard_rows=8)
    want = Counter(k << 3 for x in lists for k in x)
    keys = np.array(sorted(want))
    assert len(counts.paths) > 1 and counts.find(keys).tolist() == [want[k] for k in keys.tolist()]
    assert counts.find(np.array([1, 9999])).tolist() == [0, 0]
    best = [max([n for k, n in want.items() if k >> 5 == a], default=0) for a in range(60)]
    assert counts.best.tolist() == best


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([d.doc_id for d in docs], plain_alignment([d.text for d in docs])))
