import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from docframe.operators import opportunity
from docframe.operators.calls import Answers, Calling, Flusher, answered
from docframe.sources.shared import read_lines


class Counted:
    """A client that notes each call in a folder; what it does depends on the prompt."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, prompt):
        with open(os.path.join(self.folder, f"{prompt}-{os.getpid()}-{threading.get_ident()}-{time.time_ns()}"), "x"):
            pass
        if "slow" in prompt:
            raise TimeoutError
        if "down" in prompt:
            raise ConnectionError
        if "odd" in prompt:
            raise KeyError
        return " " if "empty" in prompt else prompt.upper()

    def calls(self):
        return sorted(f.split("-")[0] for f in os.listdir(self.folder))


class Dies(Counted):
    """Ends the whole worker process once, in the midst of a task."""

    def __call__(self, prompt):
        answer = super().__call__(prompt)
        flag = self.folder + ".died"
        if prompt.startswith("kill") and not os.path.exists(flag):
            time.sleep(0.5)
            open(flag, "x").close()
            os._exit(1)
        return answer


@pytest.fixture
def client(tmp_path):
    (tmp_path / "calls").mkdir()
    return Counted(tmp_path / "calls")


def prompts(spark, given):
    return spark.createDataFrame(list(enumerate(given)), "id long, prompt string").repartition(3)


def test_each_prompt_once(spark, client, tmp_path):
    rows = prompts(spark, ["a", "b", "a", None, "", "empty", "slow", "down", "odd", "a"])
    found = answered(rows, "prompt", client, store=str(tmp_path / "store"), attempts=2, backoff=0.01)
    want = {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, "BAD_REQUEST"), 4: (None, "BAD_REQUEST"), 5: (None, "LLM_MALFORMED"), 6: (None, "LLM_TIMEOUT"), 7: (None, "LLM_UNAVAILABLE"), 8: (None, "INTERNAL"), 9: ("A", None)}
    got = lambda: {r.id: tuple(r.answer) for r in found.collect()}
    assert got() == want and found.columns == ["id", "prompt", "answer"]
    once = client.calls()
    assert once == sorted(["a", "b", "empty", "odd", "slow", "slow", "down", "down"])
    assert got() == want and client.calls() == once  # the plan ran again, nobody was asked
    more = answered(prompts(spark, ["a", "c"]), "prompt", client, store=str(tmp_path / "store"))
    assert {tuple(r.answer) for r in more.collect()} == {("A", None), ("C", None)} and client.calls() == sorted([*once, "c"])
    answered(prompts(spark, ["a", "slow"]), "prompt", client, store=str(tmp_path / "store"), again=True).collect()
    assert client.calls() == sorted([*once, "c", "slow"])  # only what had failed
    assert answered(rows.limit(0), "prompt", client).count() == 0


def test_merged_files(spark, client, tmp_path):
    store = tmp_path / "store"
    answered(prompts(spark, [f"p{i}" for i in range(50)]), "prompt", client, store=str(store), tasks=2).collect()
    files = [f for _, _, names in os.walk(store) for f in names]
    assert len(files) == 2
    kept = Answers(str(store), 0, False)
    assert len(kept.held) + len(Answers(str(store), 1, False).held) == 50


def test_answers_are_written_while_the_task_goes_on(tmp_path):
    kept = Answers(str(tmp_path), 3, False)
    with Flusher() as flusher:
        flusher.buckets[3] = kept
        for i in range(30):
            kept.keep(str(i), (f"a{i}", None))
            time.sleep(0.02)
        deadline = time.time() + 5
        while len(Answers(str(tmp_path), 3, False).held) < 30 and time.time() < deadline:
            time.sleep(0.02)
    assert Answers(str(tmp_path), 3, False).held == {str(i): (f"a{i}", None) for i in range(30)} and len(kept.files) > 1
    kept.merge()
    assert len(os.listdir(tmp_path / "00003")) == 1 and len(Answers(str(tmp_path), 3, False).held) == 30


def test_several_at_once(spark, tmp_path):
    most = tmp_path / "most"
    most.mkdir()
    lock = threading.Lock

    class Slow:
        def __call__(self, prompt):
            import docframe.operators.calls as module

            state = module.__dict__.setdefault("_test", {"lock": lock(), "now": 0, "most": 0})
            with state["lock"]:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.1)
            with state["lock"]:
                state["now"] -= 1
            (most / str(state["most"])).touch()
            return prompt

    answered(prompts(spark, [str(i) for i in range(40)]), "prompt", Slow(), tasks=1, parallel=5).collect()
    assert 2 <= max(int(f) for f in os.listdir(most)) <= 5


def test_clients_in_turn(client):
    def down(prompt):
        raise OSError

    assert Calling([down, client])("x") == ("X", None)
    assert Calling([down, down])("x") == (None, "LLM_UNAVAILABLE")
    tries = []

    def third_time(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise TimeoutError
        return "at last"

    assert Calling([third_time], 3, 0.01)("x") == ("at last", None) and Calling([third_time], 1)("y") == ("at last", None)


def test_a_lost_task_asks_nothing_again(tmp_path):
    """In a session of its own, whose tasks are tried again: the worker is killed after some answers."""
    import subprocess
    import sys

    (tmp_path / "calls").mkdir()
    code = f"""
import sys; sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]!r}
from pyspark.sql import SparkSession
from docframe.operators.calls import answered
from tests.test_calls import Dies
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
rows = spark.createDataFrame([(f"p{{i}}",) for i in range(30)] + [("kill me",)], "prompt string").coalesce(1)
got = answered(rows, "prompt", Dies({str(tmp_path / "calls")!r}), tasks=1, parallel=1).collect()
assert sorted(r.answer.text for r in got) == sorted([f"P{{i}}" for i in range(30)] + ["KILL ME"]), got
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=180, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    calls = Counted(tmp_path / "calls").calls()
    assert calls.count("kill me") == 2 and sorted(set(calls)) == sorted(c for i, c in enumerate(calls) if c != "kill me" or calls.index(c) == i)
    assert os.path.exists(tmp_path / "calls.died")


def test_classification_counts_what_it_sees(spark, client):
    def ask(rows, prompt, into):
        return answered(rows, prompt, lambda p: '[{"i": 1, "subsidiary": "x"}, {"i": 2, "subsidiary": "nobody"}, {"i": 99, "subsidiary": "x"}]', into)

    rows = spark.range(23).select(F.col("id").alias("k"))
    results, stats = opportunity.classify(rows, "k", lambda slot: F.concat(slot.cast("string"), F.lit(" "), F.col("k").cast("string")), ask, subsidiaries=("x",))
    got = {r.k: r.verdict is not None for r in results.collect()}
    first = {0, 10, 20}
    gaps = [k for k in range(23) if k not in first]
    assert got == {k: k in first or gaps.index(k) % 3 == 0 for k in range(23)}
    assert stats.first().asDict() == {"total": 23, "missing": 13, "calls": 3, "retried": 20, "recovered": 7, "rejected": 3 + 7, "failed_batches": 0}
    none, zero = opportunity.classify(rows.limit(0), "k", lambda slot: slot.cast("string"), ask)
    assert none.count() == 0 and set(zero.first().asDict().values()) == {0}


def test_positions_by_any_partitioning(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 7).alias("few"))
    want = {r.k: r.position for r in opportunity.assign_batches(rows, ["few"]).collect()}
    assert sorted(want.values()) == list(range(5000))
    assert want == {r.k: r.position for r in opportunity.assign_batches(rows.repartition(13), ["few"], ranges=1000).collect()}
    same = spark.range(3000).select(F.lit(1).alias("k"))
    assert sorted(r.position for r in opportunity.assign_batches(same, ["k"], ranges=8).collect()) == list(range(3000))


def test_written_answers_leave_memory(tmp_path):
    """Only what isn't written is held; what was written is found again, failures that were asked for again are replaced, and merged files hold each answer once."""
    ids = [f"{i:064x}" for i in range(50)]
    first = Answers(str(tmp_path), 3, False)
    for n, i in enumerate(ids):
        first.keep(i, (f"é {n}\n", None) if n % 2 else (None, "LLM_TIMEOUT"))
        if n % 10 == 9:
            first.flush()
            assert not first.pending and not first.places
    assert len(first.files) == 5
    again = Answers(str(tmp_path), 3, True)
    assert [again.get(i) for i in ids] == [(f"é {n}\n", None) if n % 2 else None for n in range(50)] and again.get("f" * 64) is None
    for n, i in enumerate(ids[:20]):
        if n % 2 == 0:
            again.keep(i, ("now", None))
    again.merge()
    last = Answers(str(tmp_path), 3, False)
    assert len(last.files) == 1 and sum(map(bool, read_lines(last.folder, last.files[0]))) == 50
    assert [last.get(i) for i in ids] == [(f"é {n}\n", None) if n % 2 else ("now", None) if n < 20 else (None, "LLM_TIMEOUT") for n in range(50)]
