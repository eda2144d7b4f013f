import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import bwt, language_model as lm, near_duplicates as nd, pii, suffix_dedup, text as T, toxicity
from docframe.llm.components import components
from docframe.llm.decontamination import decontaminate, find_contamination
from docframe.llm.language_id import identify_language
from docframe.llm.language_model import CONTEXT, Counts, LogBilinear, score_texts
from docframe.llm.mixing import mixed_blocks, permuted, plan_mix, words_taken
from docframe.llm.top_k import top_k

SCHEMA = "doc_id long, text string, lang string, source string, score string, n_words string, pii string, contamination int, n_bytes string"
EDGE_TEXTS = [None, "", " \n\t ", "one", "one two", "ÀÉ 日本語 one two", "x" * 5000, "a b c d e f g h i j k l m", "a b c d e f g h i j k l m"]


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", source(i), "x", "y", "z", 7, "w") for i, t in enumerate(texts)], SCHEMA)


def edges(spark):
    """Nulls in all columns, empty and long texts, a repeated row."""
    docs = documents(spark, EDGE_TEXTS)
    return docs.unionByName(docs.where("doc_id = 7")).unionByName(spark.createDataFrame([(None,) * 9], SCHEMA))


def words(r, n, size=60):
    return " ".join("".join(chr(97 + (k * 7 + j) % 26) for j in range(2 + k % 5)) for k in (r.randrange(size) for _ in range(n)))


# --- helpers


def test_words_of_long_texts(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("ab  \nc") for _ in range(2000)) + "d" * 500
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 700, 700, len(text)])
    whole = T.hashed_words(data, offsets, T.BY_SPACE)
    monkeypatch.setattr(T, "SEGMENT", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, T.hashed_words(data, offsets, T.BY_SPACE)))


def test_word_spans_and_hashes():
    data, offsets = np.frombuffer("ab  Ab\x0b".encode() + b"" + b"c ab", dtype=np.uint8), np.array([0, 7, 7, 11])
    starts, ends, owner = T.word_spans(T.LOWER[data], offsets, T.BY_SPACE)
    assert list(zip(starts, ends, owner)) == [(0, 2, 0), (4, 6, 0), (7, 8, 2), (9, 11, 2)]
    h = T.substring_hashes(T.prefix_hashes(T.LOWER[data]), starts, ends)
    assert h[0] == h[1] == h[3] != h[2]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# --- 1 language


def test_languages(spark):
    r = random.Random(0)
    texts = [" ".join(r.choice(["the", "and", "thing", "with"] if i % 2 else ["der", "und", "nicht", "schön"]) for _ in range(30)) for i in range(40)]
    docs = documents(spark, texts)
    got = identify_language(docs.where("doc_id < 20"), docs.where("doc_id >= 20"))
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 for x in got.collect()) and got.columns.count("score") == 1
    odd = {x.doc_id: x.lang_pred for x in identify_language(edges(spark), docs).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[3] in ("en", "de") and odd[None] == "und"
    assert {x.lang_pred for x in identify_language(docs, docs.limit(0)).collect()} == {"und"}
    assert identify_language(docs.limit(0), docs).count() == 0


def plain_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        w = f" {word} "
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return out


def plain_languages(training, texts, size):
    """Profiles and out-of-place distances from the definition."""
    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]]
    by_lang = {}
    for lang, text in training:
        if lang is not None:
            by_lang.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in by_lang.items() if c}
    out = []
    for text in texts:
        own = ranked(plain_grams(text))
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        apart = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out.append((best, 1 - apart[best] / (size * len(own))))
    return out


@pytest.mark.parametrize("block_languages", [2000, 2])
def test_languages_equal_brute_force(spark, block_languages):
    r = random.Random(2)
    letters = {"de": "aäbdeéß", "en": "abcdeth", "fr": "aàceész", "ja": "日本語の", None: "xyz"}
    write = lambda lang: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 30)))
    rows = [(i, r.choice([*letters])) for i in range(150)]
    rows = [(i, lang, write(lang) + r.choice(["", " ÀB-9_c", "\n" + write("en")])) for i, lang in rows]
    long = ["it's a long text of words ", "ein langer Text mit ß "]
    rows += [(150, "en", long[0] * 30_000), (151, "de", long[1] * 30_000 + "y" * 10)] + [(152 + i, None, t) for i, t in enumerate(EDGE_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = {x.doc_id: (x.lang_pred, x.score) for x in identify_language(docs, docs.where("doc_id % 3 <> 0 or doc_id >= 150"), size=40, block_languages=block_languages).collect()}
    want = plain_languages([(lang, t) for i, lang, t in rows if i % 3 or i >= 150], [t for _, _, t in rows], 40)
    assert {i: (lang, round(x, 9)) for i, (lang, x) in got.items()} == {i: (lang, round(x, 9)) for i, (lang, x) in enumerate(want)}


def test_each_task_keeps_only_a_profile(spark):
    from docframe.llm.language_id import train_profiles

    assert "WindowGroupLimit" in train_profiles(documents(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()


# --- 2 top-k


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.integers(-3, 4, (700, 6)).astype(float)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 6), (1002, [1.0] * 5), (1003, []), (None, [1.0] * 6), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for q in top_k(df, df.where("vec_id % 50 = 0"), k=5, query_block=5, seeds=50, tree_rows=200).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    usable = [(i, v) for i, v in rows if i is not None and v and len(v) == 6 and not np.isnan(v).any()]
    for q in range(0, 700, 50):
        want = sorted(((-int(np.dot(x[q], v)), i) for i, v in usable if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert 1000 not in got and top_k(df.limit(0), df.where("vec_id = 0")).count() == 0 and top_k(df, df.limit(0)).count() == 0


# --- 3 decontamination


def hit_words(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w, hit, found = pattern.findall(lower(text)), set(), set()
    for item, t in items:
        b = pattern.findall(lower(t))
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [400_000, 7])
def test_contamination_equals_brute_force(spark, max_windows):
    r = random.Random(3)
    items = [(10, words(r, 14)), (2, "Kurz é!"), (3, None), (4, " -- "), (5, "A b, c d e F g h i j k l")]
    texts = [words(r, 30) + " " + items[0][1][: r.randrange(20, 70)].upper() + " " + words(r, 9) for _ in range(20)] + ["x kurz É y", "kurz é KURZ é", "a b c d e f g h i j k l m"]
    docs = documents(spark, EDGE_TEXTS + texts).withColumn("__windows", F.lit(1))
    got = find_contamination(docs, spark.createDataFrame(items + items[:1], "item_id long, text string"), max_windows=max_windows)
    assert {*got.columns} == {*docs.columns} and got.count() == len(EDGE_TEXTS + texts)
    for row in got.collect():
        c = row.contamination
        assert (c.n_words, sum(x.end - x.start for x in c.runs), c["items"]) == hit_words((EDGE_TEXTS + texts)[row.doc_id], items)


def test_decontamination_cuts_only_what_is_hit(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = documents(spark, ["Keep this. One two, three four five six seven eight nine ten! And this.", "clean  text\n", None, "one two three four five six seven eight nine ten eleven"])
    got = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert got == {0: "Keep this.  ! And this.", 1: "clean  text\n", 2: None} and decontaminate(docs, bench).where("contamination = 7").count() == 3
    assert decontaminate(docs, bench.limit(0)).count() == 4 and decontaminate(edges(spark), bench).columns == docs.columns


# --- 4 mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, active = {}, float(sum(sizes.values())), set(names)
    while active:
        unit = left / sum(w[s] for s in active)
        over = [s for s in active if unit * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: unit * w[s] for s in active}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            active.remove(s)
    return out


def test_mix_meets_its_targets(spark):
    r = random.Random(4)
    texts = EDGE_TEXTS + [words(r, r.randrange(1, 900)) for _ in range(300)]
    docs = documents(spark, texts, lambda i: None if i % 10 == 0 else "big" if i % 3 == 0 else "tiny" if i % 50 == 7 else f"s{i % 4}")
    docs = docs.unionByName(docs.where("doc_id in (7, 12)"))
    got = words_taken(plan_mix(docs, block_words=16)).collect()
    again = words_taken(plan_mix(docs.repartition(5), block_words=16)).collect()
    assert Counter(tuple(x) for x in got) == Counter(tuple(x) for x in again)
    assert len(got) == len(texts) + 2
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for x in got:
        assert x.size == count(texts[x.doc_id]) and x.taken <= 3 * x.size
        sizes[x.source] += x.size
        taken[x.source] += x.taken
    want = targets(sizes)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 + 0.01 * want[s], s


def test_blocks_hold_the_texts(spark):
    docs = documents(spark, ["a b\nc d", "e f  g", None, "h"], lambda i: "s")
    mix = plan_mix(docs, block_words=3)
    blocks = mixed_blocks(mix).collect()
    assert sum(b.n_words for b in blocks) == sum(x.taken for x in words_taken(mix).collect()) == 8
    assert sorted(w for b in blocks for w in b.text.split()) == list("abcdefgh") and all(len(b.text.split()) == b.n_words for b in blocks)
    assert any("b\n" in b.text for b in blocks) or any(b.text.startswith("c") for b in blocks)
    assert words_taken(plan_mix(docs.limit(0))).count() == 0 and mixed_blocks(plan_mix(documents(spark, ["", None]))).count() == 0


def test_blocks_of_long_and_repeated_texts(spark):
    """A text of a million words is cut once; rows that repeat keep places of their own."""
    long = " ".join(f"w{i}" for i in range(1_000_000))
    docs = documents(spark, [long, "a b c", None], lambda i: "s")
    docs = docs.unionByName(docs.where("doc_id = 1")).withColumns({"dealt": F.lit(1), "skey": F.lit("x"), "block": F.lit(None).cast("long")})
    mix = plan_mix(docs)
    blocks = mixed_blocks(mix).select("block", "n_words", "text", "position", "shard").collect()
    assert sum(b.n_words for b in blocks) == sum(x.taken for x in words_taken(mix).collect()) == 1_000_006
    assert Counter(w for b in blocks for w in b.text.split()) == Counter(long.split()) + Counter("a b c a b c".split())
    assert len({(b.shard, b.position) for b in blocks}) == len(blocks)


def test_each_shard_is_at_the_target_weights(spark):
    docs = documents(spark, [words(random.Random(i), 200) for i in range(600)], lambda i: f"s{i % 3}")
    mix = plan_mix(docs, block_words=8, shard_slots=2048)
    share = {r.skey: r.quota for r in mix.sources.collect()}
    got = mix.slots.groupBy("shard", "skey").count().collect()
    full = {s for s in {r.shard for r in got} if sum(r["count"] for r in got if r.shard == s) == 2048}
    assert len(full) > 5
    for r in got:
        p = share[r.skey] / sum(share.values())
        assert r.shard not in full or abs(r["count"] - 2048 * p) < 5 * math.sqrt(2048 * p * (1 - p)) + 1
    assert {r.skey: r["count"] for r in mix.slots.groupBy("skey").count().collect()} == share


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), [F.lit(1), F.lit("s")]).alias("x")).collect()
        assert sorted(x.x for x in got) == list(range(n))
    assert [x.x for x in got] != list(range(n))


# --- 6 repeated bytes


def joined_bytes(strings):
    return np.frombuffer(b"".join(strings), dtype=np.uint8), np.append(0, np.cumsum([len(s) for s in strings]))


def test_transforms_merge_to_blocks_of_equal_suffixes(monkeypatch):
    r = random.Random(5)
    parts = [bytes(r.choice(b"abc") for _ in range(r.randrange(30, 90))) for _ in range(4)]
    strings = [b"".join(r.choice(parts) for _ in range(r.randrange(5))) + b"x" * r.randrange(3) for _ in range(12)]
    found = []
    for collide in (False, True):
        if collide:  # symbols of equal hashes are told apart by their bytes
            monkeypatch.setattr(bwt, "substring_hashes", lambda prefix, a, b: a % 2)
        shards, seen = bwt.transforms(*joined_bytes(strings), 3, 150), {}
        for s, b in zip(shards, bwt.merge(shards, 150)):
            for string, place, block in zip(s.string, s.place, b):
                if place + 150 <= len(strings[string]):
                    seen.setdefault(strings[string][place : place + 150], set()).add(int(block))
        assert len(seen) > 20 and all(len(b) == 1 for b in seen.values()) and len({min(b) for b in seen.values()}) == len(seen)
        found.append([x.tolist() for x in bwt.repeated_windows(*joined_bytes(strings), 100)])
    assert found[0] == found[1] and found[0][0]


def repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        hit = [False] * len(r)
        for i in range(len(r) - size + 1):
            if starts[r[i : i + size]] > 1:
                hit[i : i + size] = [True] * size
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(r), sum(hit), runs, hashlib.sha256(bytes(c for c, h in zip(r, hit) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("members", [1024, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, tmp_path, members):
    """The registered query itself."""
    from docframe.llm.queries import op6_suffix_dedup

    monkeypatch.setattr(suffix_dedup, "MEMBERS", members)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 14)
    r = random.Random(6)
    passage, line = words(r, 60, 500), "All rights reserved, and some more words to be over fifty bytes. " * 2
    texts = EDGE_TEXTS + ["é" * 300, "ab" * 400] + [words(r, r.randrange(20, 150), 5000) + " " + r.choice([passage, passage[10:], line, line + passage, ""]) + " " + words(r, r.randrange(50), 5000) for _ in range(60)]
    texts += [words(r, 1 + i % 3, 9) + " " + passage[60:270] + words(r, 2, 5) for i in range(40)]  # contexts that part only next to the passage
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_suffix_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == dict(enumerate(repeats(texts, 200)))


def test_repeats_in_long_texts(spark):
    r = random.Random(7)
    passage = words(r, 100, 4000)
    long = " ".join([words(r, 110_000, 10**6), passage, words(r, 110_000, 10**6)])  # over two segments
    docs = documents(spark, [long, "x " + passage]).withColumns({"__key": F.lit(1), "__spans": F.lit("a")})
    got = suffix_dedup.remove_repeats(docs, 200).orderBy("doc_id").collect()
    assert len(long) > 1 << 20 and got[1].n_removed >= len(passage) and got[0].n_removed >= len(passage) and got[0]["__spans"] == "a"
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, 208)


def test_repeats_of_edge_rows(spark):
    got = suffix_dedup.remove_repeats(edges(spark), 200).collect()
    assert len(got) == len(EDGE_TEXTS) + 2
    long = next(x for x in got if x.doc_id == 6)
    assert (long.n_removed, long.n_spans, bytes(long.kept)) == (5000, 1, b"")
    assert suffix_dedup.remove_repeats(edges(spark).limit(0), 200).count() == 0


# --- 7 language model


def test_scores_equal_counts_and_are_probabilities(spark):
    r = random.Random(7)
    texts = EDGE_TEXTS + [words(r, r.randrange(60)) + " Rare%d" % i for i in range(80)]
    docs = documents(spark, texts).unionByName(documents(spark, texts).where("doc_id = 9"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    got = score_texts(docs, fold == 1).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    training, held = Counter(), lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in [*enumerate(texts), (9, texts[9])]:
        if not held(i):
            training.update(tokens(t))
    total, distinct = sum(training.values()), len(training)
    assert len(got) == len(texts) + 1
    for x in got:
        own = tokens(texts[x.doc_id])
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(x.doc_id), len(own), sum(training[w] > 0 for w in own), total)
        assert x.base_score == pytest.approx(sum(math.log10((training[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
        assert x.score < 0
    nothing = score_texts(documents(spark, ["a b", None]), F.lit(True)).collect()
    assert [x.n_known for x in nothing] == [0, 0] and [x.train_tokens for x in nothing] == [0, 0]
    assert score_texts(edges(spark), fold == 1).count() == len(EDGE_TEXTS) + 2


def test_scores_equal_a_plain_forward_pass(spark):
    """The score recomputed token by token from the trained tables: context vectors, group, member, and the share in a hashed class."""
    from docframe.llm import language_model as lm

    r = random.Random(13)
    texts = [*EDGE_TEXTS, *(words(r, r.randrange(1, 50), 500) + (" Rare%d" % i if i % 3 else "") for i in range(150))]
    docs = documents(spark, texts).select("doc_id", "text")
    training = docs.where("doc_id % 5 <> 1")
    _, head = lm.gather_counts(training)
    model = lm.train(training, head)
    counts = Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in (t or "").encode().lower().split() + [b""])
    tables = [t.astype(float) for t in model.tables]
    own_class = {}
    for w in {w for t in texts for w in (t or "").encode().lower().split()} | {b""}:
        h = lm.token_hashes([w])
        at = np.searchsorted(head.hashes, h[0])
        own_class[w] = int(head.classes[at]) if at < len(head.hashes) and head.hashes[at] == h[0] else int(head.bucket(h)[0])
    size = Counter()
    for w, c in counts.items():
        size[own_class[w]] += c + 0.5
    softmax = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    got = {x.doc_id: x.score for x in score_texts(docs, F.col("doc_id") % 5 == 1).collect()}
    for i, t in enumerate(texts):
        classes, total = [model.n] * lm.CONTEXT, 0.0
        for w in (t or "").encode().lower().split() + [b""]:
            hat = sum(tables[0][classes[-1 - j]] * tables[2][j] for j in range(lm.CONTEXT))
            k, group = own_class[w], own_class[w] // model.members
            members = tables[1][group * model.members : (group + 1) * model.members]
            p = softmax(tables[3][:, :-1] @ hat + tables[3][:, -1])[group] * softmax(members[:, :-1] @ hat + members[:, -1])[k - group * model.members]
            if k >= head.own:
                p *= (counts[w] + 0.5) / (size[k] + 0.5)
            total += math.log10(p)
            classes.append(k)
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_model_learns_what_follows():
    head = Counts([b"", *[b"w%d" % i for i in range(20)]], np.full(21, 1000, np.int64), 21_000, 21)
    model, r = LogBilinear(head.class_counts), np.random.default_rng(0)
    sequence = np.cumsum(np.ones(4000, np.int64)) % 20
    context = np.stack([np.roll(sequence, j + 1) for j in range(CONTEXT)], axis=1)
    before = model.log_probabilities(context, sequence).mean()
    for _ in range(60):
        pick = r.permutation(len(sequence))[:1024]
        model.learn(context[pick], sequence[pick], 0.2)
    assert model.log_probabilities(context, sequence).mean() > before + 1
    every = np.stack([model.log_probabilities(context[:5], np.full(5, c)) for c in range(len(head.class_counts))])
    assert np.exp(every).sum(axis=0) == pytest.approx(1, abs=1e-4)


def plain_step(model, context, target, rate=0.2):
    """LogBilinear.learn by plain indexing and sums."""
    r, q, c, g = model.tables
    order = np.argsort(target, kind="stable")
    context, target = context[order], target[order]
    own, size = target // model.members, len(target)
    present, of = np.unique(own, return_inverse=True)
    given = [r[context[:, j]] for j in range(CONTEXT)]
    hat = np.hstack([sum(x * c[j] for j, x in enumerate(given)), np.ones((size, 1), np.float32)])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def summed(at, values):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order])))
        return at[order][first], np.add.reduceat(values[order], first, axis=0), np.diff(np.append(first, len(at)))

    groups = np.searchsorted(model.groups_upto, model.random.random(lm.NOISE), side="right")
    up, down = sigmoid(model.log_group_noise[own] - (hat * g[own]).sum(axis=1)), sigmoid(hat @ g[groups].T - model.log_group_noise[groups])
    to_hat, to_g = down @ g[groups] - up[:, None] * g[own], np.zeros_like(g)
    at, sums, _ = summed(own, -up[:, None] * hat)
    to_g[at] = sums
    np.add.at(to_g, groups, down.T @ hat)
    up = sigmoid(model.log_noise[target] - (hat * q[target]).sum(axis=1))
    to_hat -= up[:, None] * q[target]
    to_target = summed(target, -up[:, None] * hat)
    begin = present * model.members
    last = np.minimum(begin + model.members, model.n)
    low, high = model.upto[begin], model.upto[last]
    drawn = np.searchsorted(model.upto, low[:, None] + model.random.random((len(present), lm.INNER)) * (high - low)[:, None], side="right") - 1
    drawn = np.clip(drawn, begin[:, None], last[:, None] - 1)
    noise = q[drawn][of]
    down = sigmoid(np.einsum("ikj,ij->ik", noise, hat) - model.log_noise[drawn][of])
    to_hat += np.einsum("ik,ikj->ij", down, noise)
    to_drawn = summed(drawn.ravel(), np.add.reduceat(down[:, :, None] * hat[:, None, :], np.searchsorted(of, np.arange(len(present))), axis=0).reshape(-1, hat.shape[1]))
    to_r = summed(context.T.ravel(), np.concatenate([to_hat[:, :-1] * c[j] for j in range(CONTEXT)]))
    to_c = np.stack([(to_hat[:, :-1] * x).sum(axis=0) for x in given])
    for which, at, grad, times in ((0, *to_r), (1, *to_target), (1, *to_drawn), (2, slice(None), to_c, size), (3, slice(None), to_g, size)):
        grad = grad / np.float32(size)
        model.squares[which][at] += grad * grad
        model.tables[which][at] -= np.float32(rate) * grad / np.sqrt(model.squares[which][at])
        model.touched[which][at] += times


def steps(n, size):
    """A model of n classes, and batches of this size."""
    share = 1 / np.arange(1, n + 1) ** 1.1
    sequence = np.searchsorted(np.cumsum(share / share.sum())[:-1], np.random.default_rng(2).random(5 * size + CONTEXT))
    context = np.stack([sequence[CONTEXT - 1 - j : len(sequence) - 1 - j] for j in range(CONTEXT)], axis=1)
    return LogBilinear(share * 1e6), [(context[i : i + size], sequence[CONTEXT:][i : i + size]) for i in range(0, 5 * size, size)]


@pytest.mark.parametrize("n, size", [(1, 3), (2, 1), (50, 7), (3000, 2048), (70_000, 500)])
def test_a_step_equals_a_plain_one(n, size):
    (a, batches), (b, _) = steps(n, size), steps(n, size)
    for batch in batches:
        a.learn(*batch)
        plain_step(b, *batch)
    for x, y in zip([*a.tables, *a.squares, *a.touched], [*b.tables, *b.squares, *b.touched]):
        assert x.dtype == np.float32 and np.allclose(x, y, rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("n", [40_000, 200_000])
def test_a_step_takes_less_time_than_a_plain_one(n):
    timed = f"""
import statistics, time
from tests.llm.test_operators import LogBilinear, plain_step, steps
model, batches = steps({n}, 2048)
def seconds(step, batch):
    began = time.process_time()
    step(model, *batch)
    return time.process_time() - began
print(statistics.median(seconds(LogBilinear.learn, batch) / seconds(plain_step, batch) for batch in batches * 6))
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", timed], cwd=here, env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=120)
    assert float(ran.stdout) < 0.72, ran.stderr


def test_classes_grow_with_the_corpus():
    tokens = [b"w%d" % i for i in range(8000)]
    few, many = (Counts(tokens, np.full(8000, c, np.int64), 8000 * c, 8000) for c in (1, 125))
    assert 255 < few.own < many.own == 6400 and few.own + few.hashed == len(few.class_counts)
    text = np.frombuffer(b"w1 w4999 unseen", np.uint8)
    assert few.places(text, np.array([0, len(text)]))[2].max() >= few.own
    assert many.places(text, np.array([0, len(text)]))[2].tolist()[:2] != [many.own] * 2
    assert few.sizes().sum() == 8000 + 0.5 * (8000 + few.hashed)


def test_scores_do_not_depend_on_file_splits(spark):
    r = random.Random(8)
    docs = documents(spark, [words(r, r.randrange(60), 400) for _ in range(300)])
    one, many = ({x.doc_id: x.score for x in score_texts(docs.repartition(n), F.col("doc_id") % 5 == 1).collect()} for n in (1, 24))
    assert one == pytest.approx(many, rel=1e-6)


# --- 8 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(8)
    for n in range(4000):
        text = "".join(r.choice(["a", "Z", "@", ".", "-", " ", "+", "1", "25", "4", "0", "(", ")", "é", "b.c", "4111 1111 1111 1111"]) for _ in range(r.randrange(25)))
        assert [(x["kind"], x["start"], x["end"]) for x in pii.spans_of(text) if x["base"]] == plain_spans(text), text


def test_other_kinds_need_their_checks_and_words(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32 and not GB82 WEST 1234 5698 7654 33; SSN 123-45-6789 yes"
    assert [text[x["start"] : x["end"]] for x in pii.spans_of(text) if not x["base"]] == ["GB82 WEST 1234 5698 7654 32", "123-45-6789"]
    assert not pii.spans_of("part 123-45-6789")
    assert pii.spans_of("x" * 200_000 + "@y") == [] and pii.spans_of("1." * 100_000) != [] and pii.spans_of("1" * 100_000) == [] and pii.spans_of("1" * 5000 + ".1.1.1") == []
    docs = documents(spark, ["mail a.b@c.de now", "clean", None, "+1 (555) 555-0100"])
    assert {x.doc_id: x.text for x in pii.redact(docs).collect()} == {0: "mail [EMAIL] now", 1: "clean", 2: None, 3: "[PHONE]"}
    assert pii.find_personal_data(edges(spark)).count() == len(EDGE_TEXTS) + 2 and pii.redact(docs.limit(0)).count() == 0


# --- 9 toxicity


def test_places_of_hashes():
    r = np.random.default_rng(5)
    keys = np.unique(np.append(r.integers(0, 1 << 32, 3000, dtype=np.uint32), np.array([0, 7, 8, 0xFFFFFFFF], np.uint32)))
    asked = np.concatenate([keys[::2], r.integers(0, 1 << 32, 3000, dtype=np.uint32), np.array([9, 0xFFFFFFFE], np.uint32)])
    where = {k: i for i, k in enumerate(keys.tolist())}
    for known in (keys, keys[:-1]):
        got = toxicity.Places(known).find(asked)
        assert got.tolist() == [where[k] if k in where and where[k] < len(known) else -1 for k in asked.tolist()]
    assert (toxicity.Places(keys[:0]).find(keys) == -1).all()


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(9)
    bad = ["stupid", "vequos", "chllorn"]
    toxic = {i: i % 6 == 0 for i in range(600)}
    texts = [words(r, 60, 400) + (" " + " ".join(r.choice(bad) for _ in range(3)) if toxic[i] else "") + " " + words(r, 20, 400) for i in range(600)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(toxic[i])) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, docs.where("doc_id < 400"), labels).collect()}
    held = range(400, 600)
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == toxic[i] for i in held) >= 195
    odd = toxicity.score_toxicity(edges(spark), docs, labels).collect()
    assert len(odd) == len(EDGE_TEXTS) + 2 and all(x.score < 0.5 for x in odd)
    assert all(x.score < 0.5 for x in toxicity.score_toxicity(docs, docs, labels.limit(0)).limit(5).collect())


@pytest.mark.parametrize("n_confirmed", [0, 1, 3, 6])
@pytest.mark.parametrize("passage", [0, 500_000])
def test_toxicity_of_few_confirmed_texts(spark, n_confirmed, passage):
    """Insults score above other texts with three confirmed texts, also where these share a long passage; with fewer than two all score the prior."""
    r = random.Random(21)
    shared = " " + " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(passage // 8))
    texts = [words(r, 40, 300) + " you vequos idiot chllorn" + (shared if i < n_confirmed else "") for i in range(12)] + [words(r, 40, 300) for _ in range(400)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < n_confirmed)) for i in [*range(n_confirmed), *range(20, 60)]], "doc_id long, toxic int")
    asked = documents(spark, ["what a vequos idiot he is, chllorn", "the weather is fine, with some clouds"])
    insult, weather = (x.score for x in toxicity.score_toxicity(asked, docs, labels).orderBy("doc_id").collect())
    if n_confirmed < 2:
        assert insult == weather == pytest.approx(n_confirmed / (40 + n_confirmed) if n_confirmed else 1e-4)
    else:
        assert insult > 2 * weather and insult > n_confirmed / 40


def test_second_occurrences_are_features_of_their_own():
    r = np.random.default_rng(3)
    hashes = r.integers(0, 1 << 32, 300_000, dtype=np.uint64).astype(np.uint32)
    text_of, own = toxicity.features(np.zeros(600_000, np.int64), np.append(hashes, hashes))
    assert len(own) == len(np.unique(own)) == 2 * len(np.unique(hashes)) and (own >= toxicity.TWICE).sum() * 2 == len(own)


def sparse(x):
    return toxicity.Rows(np.nonzero(x)[1], np.append(0, np.cumsum(x.sum(axis=1).astype(int))))


def test_nnpu_ignores_positives_among_the_unlabelled():
    r = np.random.default_rng(0)
    p, u = np.zeros((50, 3)), np.zeros((500, 3))
    p[:, 0] = 1
    u[:50, 0], u[:, 1] = 1, r.random(500) < 0.5
    w = toxicity.fit_nnpu(sparse(p), sparse(u), 3, 0.1)
    assert w[-1] + w[0] > 0 > w[-1] + w[1]


@pytest.mark.parametrize("scale", [0.3, 4.0])
def test_risk_and_gradient(scale):
    """The risk of the definition, and its gradient by finite differences, on either side of zero."""
    r = np.random.default_rng(1)
    p, u, w, prior = r.random((9, 4)) < 0.6, r.random((30, 4)) < 0.2, np.append(np.full(4, scale), -1.0), 0.4
    loss = lambda f: np.log1p(np.exp(-f))

    def parts(w):
        fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return prior * loss(fp).mean(), loss(-fu).mean() - prior * loss(-fp).mean()

    one, two, gradient = toxicity.risk(w, sparse(p), sparse(u), prior)
    assert (one, two) == pytest.approx(parts(w)) and (two < 0) == (scale == 4.0)
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        wanted = sum(parts(w + step)) - sum(parts(w - step)) if two >= 0 else parts(w - step)[1] - parts(w + step)[1]
        assert gradient[i] == pytest.approx(wanted / 2e-6, abs=1e-6)


def plain_features(text):
    out = Counter()
    padded = " " + "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text) + " "
    raw = padded.encode()
    for n in toxicity.ORDERS:
        out.update(raw[i : i + n] for i in range(len(raw) - n + 1))
    return out


def gram_hash(gram):
    h = len(gram)
    for b in gram:
        h = ((h ^ b) * 0x01000193) % 2**32
    h = ((h ^ h >> 15) * 0x85EBCA6B) % 2**32
    return h ^ h >> 13


def test_scores_and_choice_equal_brute_force(spark, monkeypatch):
    """Features, their counts over all texts, their choice and the scores recomputed one text at a time."""
    monkeypatch.setattr(toxicity, "SEGMENT", 50)
    r = random.Random(12)
    texts = [words(r, r.randrange(5, 40), 300) + (" vequos" * (1 + i % 2) if i % 4 == 0 else "") for i in range(120)] + ["", "É é"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, n_features=40, part_rows=50, steps=30)
    has = []
    for t in texts:
        grams = plain_features(t)
        has.append({gram_hash(g) for g in grams} | {gram_hash(g) | toxicity.TWICE for g, n in grams.items() if n > 1})
    places = {}
    for i in range(0, 100, 4):
        padded = (" " + "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in texts[i]) + " ").encode()
        seen = {}
        for n in toxicity.ORDERS:
            for at in range(len(padded) - n + 1):
                seen.setdefault(gram_hash(padded[at : at + n]), []).append(padded[max(0, at - toxicity.AROUND) : at + n + toxicity.AROUND])
        for g, around in seen.items():
            places.setdefault(g, set()).add(around[0])
            if len(around) > 1:
                places.setdefault(g | toxicity.TWICE, set()).add(around[1])
    p, u = {g: len(x) for g, x in places.items()}, Counter(g for own in has for g in own)
    candidates = sorted(p)
    lift = {}
    for g in candidates:
        n, rate = 25, (u[g] + 0.5) / (len(texts) + 1)
        rest = (n - p[g]) * math.log((n - p[g]) / (n * (1 - rate))) if p[g] < n else 0
        lift[g] = round(math.sqrt(max(0, 2 * (p[g] * math.log(p[g] / (n * rate)) + rest))), 9) if p[g] / n > rate else 0
    want = sorted((g for g in candidates if p[g] > 1 and lift[g] >= 3.5), key=lambda g: (-lift[g], g))[:40]
    near = {g for g in want if lift[g] > lift[want[-1]] + 1e-6}
    assert near <= set(model.grams.tolist()) and len(model.grams) == len(want) and len(want) > 5
    weights = dict(zip(model.grams.tolist(), model.weights.tolist()))
    got = toxicity.score_toxicity(docs, docs, labels, n_features=40, part_rows=50, steps=30).collect()
    for x in got:
        assert x.score == pytest.approx(1 / (1 + math.exp(-model.bias - sum(weights[g] for g in has[x.doc_id] if g in weights))), abs=1e-4)


# --- 10 near-duplicates


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            i, j = find(i), find(j)
            top[max(i, j)] = min(i, j)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(1000)
    return " ".join(w)


@pytest.mark.parametrize("node, block", [(4096, 128), (8, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, node, block):
    monkeypatch.setattr(nd, "NODE", node)
    monkeypatch.setattr(nd, "BLOCK", block)
    r = random.Random(10)
    seeds = [words(r, r.randrange(30, 120), 3000) for _ in range(12)]
    texts = EDGE_TEXTS + seeds + [edited(r, r.choice(seeds[:4]), r.randrange(5)) for _ in range(60)] + [s.upper() for s in seeds[:3]] + ["Shared line of words here. " + words(r, 40, 3000) for _ in range(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nd.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 85)))


def test_near_duplicates_of_edge_rows(spark):
    got = nd.near_duplicates(edges(spark), 5, 80).collect()
    assert len(got) == len(EDGE_TEXTS) + 2
    assert {(x.doc_id, x.component_id, x.kept) for x in got if x.doc_id in (None, 0, 7, 8)} == {(None, None, True), (0, 0, True), (7, 7, True), (8, 7, False)}
    kept = nd.drop_near_duplicates(edges(spark))
    assert 8 not in {x.doc_id for x in kept.collect()} and kept.columns == edges(spark).columns
    assert nd.near_duplicates(edges(spark).limit(0)).count() == 0 and nd.drop_near_duplicates(edges(spark).limit(0)).count() == 0


def test_rows_of_equal_ids_are_judged_by_their_texts(spark):
    long = words(random.Random(3), 200, 10**6)
    rows = [(1, long), (5, long), (5, "a text of its own"), (6, "twice the same row here"), (6, "twice the same row here"), (7, None), (7, None), (8, "..."), (None, long), (None, long), (2, "one more"), (9, "one more")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __text_hash string")
    got = nd.drop_near_duplicates(docs)
    want = [(1, long), (5, "a text of its own"), (6, "twice the same row here"), (7, None), (7, None), (8, "..."), (None, long), (None, long), (2, "one more")]
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_trees_use_tokens_of_their_own():
    used = [*range(nd.TREES), *(nd.TREES + 2 * nd.TREES * (level - 1) + 2 * tree + k for level in range(1, nd.LEVELS) for tree in range(nd.TREES) for k in (0, 1))]
    assert sorted(used) == list(range(nd.HASHES))


# --- 5 licences


def brute_license(text):
    from docframe.llm.license_scan import TEMPLATES

    def bigrams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        return set(zip(w, w[1:])) if len(w) > 1 else set(w)

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = {}
    for unit in {*re.split("\r?\n", low), *re.split("(?:\r?\n){2,}", low), low}:
        a = set(bigrams(unit))
        for name, t in TEMPLATES:
            b = set(bigrams(t))
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= 0.8:
                found[name] = max(found.get(name, 0), dice)
    best = min(found, key=lambda n: (-found[n], n), default=None)
    return best, round(found.get(best, 0), 6), ",".join(sorted(found))


def test_licenses_equal_brute_force(spark):
    from docframe.llm.license_scan import TEMPLATES, scan_licenses

    r = random.Random(11)
    texts = EDGE_TEXTS + [t.upper() for _, t in TEMPLATES] + [words(r, 50) + "\n" + edited(r, r.choice(TEMPLATES)[1], r.randrange(3)) + "\n" + words(r, 20) for _ in range(80)] + ["All rights\n\nReserved.\nreleased under the mit licence", "reserved", "x\r\nAll rights reserved.\r\ny z", "x\r\n\r\nReleased under\r\nthe MIT License.\r\n\r\ny"]
    docs = documents(spark, texts).withColumns({"license": F.lit(1), "__pairs": F.lit("x")})
    got = {x.doc_id: (x.license, x.dice, x.licenses) for x in scan_licenses(docs, TEMPLATES).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert scan_licenses(edges(spark)).count() == len(EDGE_TEXTS) + 2 and scan_licenses(docs.limit(0)).count() == 0


def test_hundreds_of_license_templates(spark):
    from docframe.llm.license_scan import TEMPLATES, scan_licenses

    many = TEMPLATES + [(f"own-{i}", f"the terms number {i} of vendor x{i} hold for file y{i} and for z{i}") for i in range(300)]
    docs = documents(spark, ["a line\nthe terms number 7 of vendor x7 hold for file y7 and for z7", "All rights reserved.", "nothing"])
    assert [x.license for x in scan_licenses(docs, many).orderBy("doc_id").collect()] == ["own-7", "proprietary", None]


def test_whole_and_embedded_licenses(spark):
    from docframe.llm.license_scan import bigrams, scan_licenses, whole_templates, words_of

    whole = whole_templates()
    texts = {n: t for n, t in whole if len(t) > 1000}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"} <= set(texts)
    inside = ["Copyright 2021 Acme. All rights reserved. See the file.", "this tool is released under the MIT license and more words follow here", words(random.Random(5), 40), "All was well with the rights of others reserved"]
    docs = documents(spark, [*texts.values(), *inside])
    got = [x.license for x in scan_licenses(docs, whole, embedded=True).orderBy("doc_id").collect()]
    assert got == [*texts, "proprietary", "MIT", None, None]
    short = [t for t in whole if len(words_of(t[1])) <= 100]
    r = random.Random(6)
    mixed = [words(r, r.randrange(30)) + " " + edited(r, r.choice(short)[1], r.randrange(3)) + " " + words(r, 9) for _ in range(40)]
    for x in scan_licenses(documents(spark, mixed), short, embedded=True).collect():
        w, best = words_of(x.text), {}
        for n, t in short:
            own, k = set(bigrams(t)), len(words_of(t))
            units = [set(bigrams(" ".join(w[i : i + k]))) for i in range(len(w) - 1)] + [set(bigrams(x.text))]
            best[n] = max(best.get(n, 0), *(2 * len(u & own) / (len(u) + len(own)) for u in units))
        assert x.licenses == ",".join(sorted(n for n, d in best.items() if d >= 0.8))
