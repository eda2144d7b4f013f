import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from docframe.llm.filter_audit import COUNTS, Removal, audit_filters
from tests.llm.test_operators import documents, edges, words


def plain_audit(rows, labels):
    """Each order, one filter after the other, over (doc_id, source, text)."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = defaultdict(list)
    for i, source, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        masks[source or ""].append((i, {f for f, x in fails.items() if x}))
    out, shares = {}, Counter()
    for part, own in masks.items():
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[part, f] += len(gone)
                failing = [x for x in own if f in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in audit_filters(docs, labels).collect()}


def test_removal_polynomial():
    r = random.Random(5)
    counts = {m: r.randrange(50) for m in range(1 << 4)}
    poly = Removal(counts, 4)
    for on in range(1 << 4):
        assert poly.corner(on) == sum(n for m, n in counts.items() if m & on)
    orders = list(permutations(range(4)))
    for i in range(4):
        before = [sum(1 << j for j in order[: order.index(i)]) for order in orders]
        assert poly.shapley(i) * len(orders) == sum(poly.corner(b | 1 << i) - poly.corner(b) for b in before)


def test_audit_equals_brute_force(spark):
    r = random.Random(3)
    texts = [words(r, r.choice([3, 49, 50, 51, 80]), r.choice([5, 60, 2000])) + r.choice(["", "", "#", " A|b"]) for _ in range(120)]
    texts = [t.upper() if r.random() < 0.2 else t for t in texts] + [None, "", " \n", "", None] + ["the same text"] * 40
    rows = [(r.choice([i, i, i, None]) if i > 150 else i, r.choice(["a", "b", "", None]), t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[120], (None, "a", texts[3])]
    r.shuffle(rows)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 170, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, source string, text string, good string, `__least` long").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(docs, marks) == plain_audit(rows, labels)


def test_audit_of_odd_tables(spark):
    docs, none = edges(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(x.doc_id, x.source, x.text) for x in docs.collect()]
    assert audited(docs, none) == plain_audit(rows, [])
    assert audited(docs.limit(0), none) == {}
    one = audited(documents(spark, ["a " * 60], source=lambda i: None), none)
    assert len(one) == 600 and one["", "ABCDE", 2] == (0, 1, 0, 1, 0, 0, 120)
