import random
from itertools import product

from pyspark.sql import functions as F

from docframe.functions import values
from docframe.functions.compat import dealt
from docframe.operators import generation, hardware, requirements
from docframe.operators.opportunity import salvage_object


def parsed(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.try_parse_json("t"))


def test_kinds(spark):
    texts = ['"24"', "1", "1.50", "1e300", "true", "null", "[1]", '{"a": 1}', None, "{broken", '""', "-0"]
    got = {r.t: (r.kind, r.n, r.f, r.s, r.shown) for r in parsed(spark, texts).select("t", values.kind(F.col("v")).alias("kind"), values.number(F.col("v")).alias("n"), values.flag(F.col("v")).alias("f"), values.text(F.col("v")).alias("s"), values.shown(F.col("v")).alias("shown")).collect()}
    assert got['"24"'] == ("text", None, None, "24", '"24"') and got["1"] == ("number", 1.0, None, None, "1.0") and got["true"] == ("flag", None, True, None, "true")
    assert got["1.50"][1] == 1.5 and got["1e300"][1] == 1e300 and got['""'] == ("text", None, None, "", '""')
    assert all(got[t] == (None,) * 5 for t in ("null", "[1]", '{"a": 1}', None, "{broken"))


def test_comparison(spark):
    rows = [("gte", "16", "16", True), ("gte", '"16"', "16", None), ("lte", "8.5", "8", False), ("eq", "1", "1.0", True), ("eq", '" DDR5 "', '"ddr5"', True), ("eq", "true", "true", True), ("eq", "true", "false", False), ("eq", "true", '"true"', None), ("approx", "1", "1", None), ("gte", "1", None, None), ("no", "1", "1", None), ("gte", '"b"', '"a"', None)]
    df = spark.createDataFrame([(op, a, b, want) for op, a, b, want in rows], "op string, a string, b string, want boolean")
    for r in df.withColumn("got", values.compare(F.col("op"), F.try_parse_json("a"), F.try_parse_json("b"))).collect():
        assert r.got == r.want, r


def test_flags_and_catalogue(spark):
    df = parsed(spark, ['"R/E"', '"non-ECC"', '" "', "true", '"지원"', "3"])
    got = [r.x for r in df.orderBy("i").select(values.shown(hardware.flag_variant(F.lit("ecc"), F.col("v"))).alias("x")).collect()]
    assert got == ["true", "false", '" "', "true", "true", "3.0"]
    assert [r.x for r in df.orderBy("i").select(values.shown(hardware.flag_variant(F.lit("rpm"), F.col("v"))).alias("x")).collect()][0] == '"R/E"'
    cat = spark.createDataFrame([(1, 84, "Yes", "DDR5", None), (2, None, "No", None, 4.5)], "k int, cores int, ecc_support string, memory_types string, base_clock_ghz double")
    found = {(r.k, r.attr): r.x for r in hardware.canonical_values(cat, "k", hardware.CPU_ATTRS).select("k", "attr", values.shown(F.col("value")).alias("x")).collect()}
    assert found == {(1, "cores"): "84.0", (1, "ecc"): "true", (1, "memory_type"): '"DDR5"', (2, "ecc"): "false", (2, "base_clock_ghz"): "4.5"}


def three(verdicts):
    return False if False in verdicts else None if None in verdicts else True


NAMES = {True: "pass", False: "fail", None: "needs_review"}


def plain_tree(products, stock, requirements_):
    """Everything against everything."""
    matches, rolled = [], []
    for k, items in requirements_.items():
        levels = []
        for i, item in enumerate(items):
            parts = ([(0, item, item.get("qty") or 1)] if item["constraints"] or not item["children"] else []) + [(n + 1, c, (item.get("qty") or 1) * max(1, c.get("qty") or 1)) for n, c in enumerate(item["children"])]
            states = []
            for n, part, need in parts:
                sure, possible, unknown = 0, 0, False
                for p, (category, quantity) in stock.items():
                    if category != part["category"]:
                        continue
                    met = []
                    for c in part["constraints"]:
                        got = [judge(c["op"], v, c["value"]) for a, v in products.get(p, []) if a == c["attr"]]
                        met.append(True if True in got else None if None in got or not got else False)
                    state = None if part.get("allow_equivalent") else three(met)
                    if any(a == c["attr"] for a, _ in products.get(p, []) for c in part["constraints"]):
                        matches.append((k, i, n, p, met.count(True), met.count(False), met.count(None), NAMES[state]))
                    else:
                        state = None
                    sure += (quantity or 0) if state else 0
                    if state is not False:
                        possible += quantity or 0
                        unknown |= quantity is None
                states.append(True if sure >= need else False if not unknown and possible < need else None)
                rolled.append((k, "part", i, n, need, sure, None if unknown else possible, NAMES[states[-1]]))
            levels.append(three(states))
            rolled.append((k, "item", i, None, None, None, None, NAMES[levels[-1]]))
        rolled.append((k, "requirement", None, None, None, None, None, NAMES[three(levels)]))
    return matches, rolled


def judge(op, have, want):
    kind = lambda v: "flag" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"
    if op == "approx" or kind(have) != kind(want) or (op != "eq" and kind(have) != "number"):
        return None
    return {"gte": lambda: have >= want, "lte": lambda: have <= want, "eq": lambda: have.strip().lower() == want.strip().lower() if isinstance(have, str) else have == want}[op]()


def test_trees_equal_brute_force(spark):
    r = random.Random(14)
    value = lambda: r.choice([r.randrange(4), r.randrange(4), r.choice(["1", "x", " X"]), r.random() < 0.5])
    part = lambda: {"category": r.choice("AAB"), "qty": r.choice([None, 0, 1, 3]), "allow_equivalent": r.choice([None, False, False, True]), "constraints": [{"attr": r.choice("uvw"), "op": r.choice(["gte", "lte", "eq", "eq", "approx"]), "value": value()} for _ in range(r.randrange(4))]}
    wanted = {k: [part() | {"children": [part() for _ in range(r.randrange(3))]} for _ in range(r.randrange(1, 3))] for k in range(25)}
    stock = {p: (r.choice("ABC"), r.choice([0, 1, 2, 2, None] if p % 9 == 0 else [0, 1, 2])) for p in range(30)}
    products = {p: [(r.choice("uvw"), value()) for _ in range(r.randrange(5))] for p in stock}
    rows = spark.createDataFrame([(k, generation.recorded({"items": v})) for k, v in wanted.items()], "k long, said string")
    items = rows.select("k", salvage_object(F.col("said"), f"struct<items:array<{generation.ITEM}>>")["items"].alias("items")).withColumn("items", F.transform("items", generation.tidy_item))
    parts = requirements.requirement_parts(items, "k")
    flat = [(p, stock[p][0], a, generation.recorded({"v": v})) for p, own in products.items() for a, v in own]
    attributes = spark.createDataFrame(flat, "p long, category string, attr string, said string").select("p", "category", "attr", values.value(F.try_parse_json(F.regexp_extract("said", r'^\{"v": (.*)\}$', 1))).alias("value"))
    held = spark.createDataFrame([(p, c, q) for p, (c, q) in stock.items()], "p long, category string, quantity long")
    matches, rolled = plain_tree(products, stock, wanted)
    got = requirements.match_parts(attributes, parts, "k", "p")
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(matches, key=order)
    assert sorted(map(tuple, requirements.roll_up(got, parts, held, "k", "p").collect()), key=order) == sorted(rolled, key=order)
    assert {v for *_, v in rolled} == set(NAMES.values())
    assert requirements.match_parts(attributes.limit(0), parts, "k", "p").count() == 0
    plan = requirements.match_parts(attributes, parts, "k", "p")._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert plan.count("Exchange hashpartitioning") == 1


def test_all_of(spark):
    for given in product([True, False, None], repeat=2):
        df = spark.createDataFrame([(list(given),)], "v array<boolean>")
        assert df.select(values.all_of(F.col("v")).alias("x")).first().x == three(given)


def test_products_meet_constraints_after_one_shuffle(spark):
    """What was matched is counted where a product's rows are, in tasks of bounded size, without sets of what was seen."""
    products = spark.createDataFrame([(i, "CPU", a, str(i)) for i in range(40) for a in ("cores", "tdp_w")], "p long, category string, attr string, value string")
    variants = products.withColumn("value", F.try_parse_json("value"))
    parts = spark.createDataFrame([(1, 0, 0, "CPU", False, 1, [("cores", "gte", "20"), ("tdp_w", "lte", "30")])], "k long, item int, part int, category string, allow_equivalent boolean, need long, constraints array<struct<attr:string,op:string,value:string>>")
    parts = parts.withColumn("constraints", F.transform("constraints", lambda c: F.struct(c["attr"].alias("attr"), c["op"].alias("op"), F.try_parse_json(c["value"]).alias("value"))))
    got = requirements.match_parts(variants, parts, "k", "p")
    asked = spark.createDataFrame([("r", "cores", "gte", "20"), ("r", "tdp_w", "lte", "30")], "requirement string, attr string, op string, value string")
    flat = hardware.match_requirements(products.drop("category"), asked, "p")
    for found in (got, flat):
        assert sorted(x.p for x in found.where("verdict = 'pass'").collect()) == list(range(20, 31)) and found.count() == 40
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" not in plan and [line.count("p#") for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "requirement" not in line.split("(", 1)[1].split(")")[0]] == [1]
    assert dealt(products, "p", 10).rdd.getNumPartitions() == max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
