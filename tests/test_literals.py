import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docframe.operators import evidence, literals, rules
from docframe.operators.literals import Finder, Fold, blocks, required_literals, same_letters


def test_finder():
    f = Finder(["he", "she", "", "hers", "he"])
    assert sorted((s, n) for s, at in f.hits("ushers") for n in at) == [(1, 1), (2, 0), (2, 3), (2, 4)]
    assert list(Finder([""]).hits("abc")) == []


def test_blocks(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 7), "") for i in range(100)], "i long, text string, other string")
    parts = list(blocks(rows, "text", 50))
    assert len(parts) > 3 and sorted(x for p in parts for x in p.column("i").to_pylist()) == list(range(100))
    assert [p.num_rows for p in blocks(rows, "text")] == [100] and list(blocks(rows.limit(0), "text")) == []


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", {"abc"}), ("ab*cd", {"cd"}), ("a?b?", None), ("(foo|quux)x", {"foo", "quux"}), ("(foo|b*)", None), ("(?:ab)c", {"abc"}), ("(longer){2,3}x", {"longer"}), (r"\babc\b", {"abc"}), ("a(?=bcd)e", {"a"}), ("[ab]c|de", {"c", "de"}),
        ("(a|b)(?P<n>hello|world)", {"hello", "world"}), ("x(?!abc)", {"x"}), (".", None), ("", None), (r"(ab)\1", {"ab"}),
    ],
)
def test_required_literals(pattern, want):
    found = required_literals(pattern, re.I | re.S)
    assert (found and set(found)) == want or (found and want and all(any(w in f or f in w for w in want) for f in found))


def random_pattern(r, depth=0):
    kinds = ["lit", "lit", "lit", "opt", "alt", "group", "class", "dot", "star", "plus"]
    out = ""
    for _ in range(r.randrange(1, 5)):
        kind = r.choice(kinds if depth < 3 else kinds[:3])
        inner = lambda: random_pattern(r, depth + 1)
        out += {
            "lit": lambda: "".join(r.choice("abKskİıſÉß") for _ in range(r.randrange(1, 4))), "opt": lambda: f"(?:{inner()})?", "alt": lambda: f"({inner()}|{inner()})", "group": lambda: f"({inner()})", "class": lambda: "[abk]",
            "dot": lambda: ".", "star": lambda: f"(?:{inner()})" + "{0,2}", "plus": lambda: f"(?:{inner()})" + "{1,2}",
        }[kind]()
    return out


def test_no_match_without_a_required_literal():
    r = random.Random(11)
    hits = 0
    for _ in range(600):
        pattern = random_pattern(r)
        found = required_literals(pattern, re.I | re.S)
        if not found:
            continue
        fold = Fold(c for s in found for c in s)
        for _ in range(40):
            text = "".join(r.choice("abkKsSKſıİIiÉéßẞ") for _ in range(r.randrange(14)))
            if re.search(pattern, text, re.I | re.S):
                hits += 1
                assert any(fold(s) in fold(text) for s in found), (pattern, text, found)
    assert hits > 300
    assert {"k", "K", "\u212a"} == same_letters("k")


def plain_spans(quotes, docs):
    """locate by its definition, for every pair."""
    out = []
    for d, text in docs:
        for q, quote in quotes:
            strip, bare = (quote or "").strip(), "".join((quote or "").split())
            if not bare or text is None:
                continue
            if (at := text.find(strip)) >= 0:
                out.append((d, q, at, len(strip)))
                continue
            places = [i for i, c in enumerate(text) if not c.isspace()]
            at = "".join(text[i] for i in places).find(bare)
            if at >= 0:
                out.append((d, q, places[at], places[at + len(bare) - 1] - places[at] + 1))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_quotes_equal_brute_force(spark, block):
    r = random.Random(12)
    write = lambda n: "".join(r.choice("aab b  \n　é😀\x1c") for _ in range(n))
    docs = [(i, write(r.randrange(120))) for i in range(60)] + [(100, None), (101, ""), (3, "a b"), (3, "a b")]
    quotes = [(i, write(r.randrange(8))) for i in range(30)] + [(50 + i, (d[1] or "")[2:60]) for i, d in enumerate(docs[:20])] + [(90, None), (91, " "), (92, "a"), (92, "a")]
    quotes += [(93, "b" * 50), (94, "ab" * 40)]
    docs += [(200, "x " + " ".join("b" * 60)), (201, "ab\n" * 45)]
    one, two = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(quotes, "q long, quote string")
    got = sorted(tuple(x) for x in evidence.find_quotes(two, one, "q", block_chars=block).collect())
    assert got == plain_spans(quotes, docs) and got
    assert evidence.find_quotes(two.limit(0), one, "q").count() == 0 and evidence.find_quotes(two, one.limit(0), "q").count() == 0


@pytest.mark.parametrize("block", [1 << 22, 9000])
def test_thousand_rules_equal_the_plain_scan(spark, block):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdeksé") for _ in range(r.randrange(2, 6)))
    made = [r.choice([f"{word()}\\s*{word()}", f"({word()}|{word()}).{{0,9}}{word()}", f"[a-c]{word()}?", f"{word()}$", f"(?:{word()})+", ".?", f"^{word()}"]) for _ in range(1000)]
    texts = [" ".join(r.choice([word(), word().upper(), "K", "\n"]) for _ in range(r.randrange(40))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    table = spark.createDataFrame([(f"r{i}", "t", p, "why") for i, p in enumerate(made)] + [("none", "t", None, "why")], "rule_id string, title string, pattern string, reason string")
    want = sorted((d, f"r{i}", m.start(), m[0]) for d, t in enumerate(texts) if t is not None for i, p in enumerate(made) if (m := re.search(p, t, re.I | re.S)))
    got = rules.scan_rule_table(docs, table, block_chars=block)
    assert sorted((x.doc_id, x.rule_id, x.offset, x.matched) for x in got.collect()) == want and len(want) > 1000
    assert rules.scan_rule_table(docs, table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rule bad"):
        rules.scan_rule_table(docs, spark.createDataFrame([("bad", "t", "(", "")], table.schema))


@pytest.mark.parametrize("pattern, want", [("ab[ ,]+cd.{0,9}e", "ab cd|ab,cd|ab  |ab ,|ab, |ab,,"), ("(ab|c)[ ]+(e)?[a-z]*f", "ab |c "), ("a*b", "aa|ab|b"), ("(?:ab){2,}c", "abab"), ("^a\\b", "a"), ("(a|)b", "ab|b"), ("a?b?", None), (".b", None)])
def test_beginnings(pattern, want):
    assert literals.beginnings(pattern, re.I | re.S) == (want and frozenset(want.split("|")))


def test_rules_are_tried_only_where_they_may_begin():
    """Words without what a match begins with aren't searched, and the leftmost match is the search's."""
    r = random.Random(5)
    part = lambda: r.choice(["ab", "b", "a+", "b*", "[ab]", "(a|ba)", "(?:ab)+", "(b)?", "a{2,3}", ".", " +", "\\b", "^", "$", "(?=a)", "[^a]", "c", "k", "(?:a|)", "(?!b)"])
    patterns = ["".join(part() for _ in range(r.randrange(1, 6))) for _ in range(600)]
    texts = ["".join(r.choice("aAbB cK\u212a\n") for _ in range(r.randrange(30))) for _ in range(120)]
    book = rules.RuleBook(patterns)
    for text in texts:
        assert list(book.matches(text)) == [(i, m.start(), m[0]) for i, p in enumerate(patterns) if (m := re.search(p, text, re.I | re.S))]
    tried = []
    one = rules.RuleBook(["the[ ]+cat"])
    one.patterns = [SimpleNamespace(match=lambda text, at: tried.append(at), search=lambda text: tried.append("all"))]
    assert list(one.matches("the dog, the  cow, the fox and a cat")) == [] and tried == [9]


def test_rule_table_equals_rule_columns(spark):
    """The fixed rules by either way."""
    texts = ["특정 제조사에 독점 공급", "타 입찰 참가를 금지한다. 일체의 이의를 제기하지 않는다", "x", None, "중복   입찰 금지 " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(rules.RISK_RULES, "rule_id string, title string, pattern string, reason string")
    columns = ["doc_id", "rule_id", "title", "offset", "length", "matched", "excerpt", "reason"]
    assert sorted(map(tuple, rules.scan_rule_table(docs, table).select(columns).collect())) == sorted(map(tuple, rules.scan_rules(docs).select(columns).withColumn("length", F.col("length")).collect()))
