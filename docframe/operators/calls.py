"""Calls to a model: several at once in each task, each answer kept once under its prompt's hash."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.sources.shared import files_of, fresh_folder, read_lines, store_of, write_file

Client = Callable[[str], str]
ANSWER = "struct<text:string,error:string>"


@dataclass
class Calling:
    """How a prompt is asked for: the clients one after the other (a server that is lost or late is passed over), all of them again after a pause, attempts times in all."""

    clients: Sequence[Client]
    attempts: int = 1
    backoff: float = 0.5

    def __call__(self, prompt: str) -> tuple[str | None, str | None]:
        """(text, error); an error is a failure's code. An answer that is blank, or a client's own fault, isn't asked for again."""
        error = "LLM_UNAVAILABLE"
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            for client in self.clients:
                try:
                    text = client(prompt)
                except TimeoutError:
                    error = "LLM_TIMEOUT"
                except OSError:
                    error = "LLM_UNAVAILABLE"
                except Exception:  # noqa: BLE001 - a row that fails is data
                    return None, "INTERNAL"
                else:
                    return (text, None) if text and text.strip() else (None, "LLM_MALFORMED")
        return None, error


FLUSH = 0.1  # seconds till an answer is written
ROWS = 1000  # prompts whose answers a task hands on together


class Answers:
    """The kept answers of one bucket: files of the shared folder, one for what came in each FLUSH seconds since the last merge, and merged ones.

    In memory are the places of answers that were there before, and the answers
    that aren't written yet.
    """

    def __init__(self, store: str, bucket: int, again: bool):
        self.folder, self.again = f"{store}/{bucket:05d}", again
        self.files = files_of(self.folder)
        self.before = len(self.files)
        self.lock, self.pending = threading.Lock(), {}
        self.places: dict[str, tuple[int, int, int, bool]] = {}  # file, offset, length, whether it failed
        for n, path in enumerate(self.files):
            offset = 0
            for line in read_lines(self.folder, path):
                if line:
                    said = json.loads(line)
                    self.places[said["id"]] = (n, offset, len(line), bool(said["error"]))
                offset += len(line) + 1

    def get(self, prompt_id: str) -> tuple[str | None, str | None] | None:
        place = self.places.get(prompt_id)
        return None if place is None or (self.again and place[3]) else self._read(place)

    @property
    def held(self) -> dict[str, tuple[str | None, str | None]]:
        """The answers that were there before, read all at once."""
        return {i: self._read(place) for i, place in self.places.items()}

    def _read(self, place: tuple[int, int, int, bool]) -> tuple[str | None, str | None] | None:
        n, offset, length, _ = place
        try:
            with store_of(self.folder)[0].open_input_file(self.files[n]) as file:
                file.seek(offset)
                said = json.loads(file.read(length))
        except FileNotFoundError:  # another attempt of the task has merged it: asked twice
            return None
        return said["text"], said["error"]

    def keep(self, prompt_id: str, answer: tuple[str | None, str | None]) -> None:
        with self.lock:
            self.places.pop(prompt_id, None)  # a failure that was asked for again
            self.pending[prompt_id] = answer

    def flush(self) -> None:
        """Writes what isn't written yet: a task that comes after a lost one finds it."""
        with self.lock:
            if self.pending:
                lines = "".join(json.dumps({"id": i, "text": text, "error": error}, ensure_ascii=False) + "\n" for i, (text, error) in self.pending.items())
                self.files.append(write_file(self.folder, f"{uuid.uuid4().hex}.json", lines.encode()))
                self.pending = {}

    def _lines(self) -> Iterator[bytes]:
        """Those of all files; of the first ones, which were there before, the lines that still hold."""
        for n, path in enumerate(self.files):
            offset = 0
            try:
                for line in read_lines(self.folder, path):
                    if line and (n >= self.before or self.places.get(json.loads(line)["id"], ())[:2] == (n, offset)):
                        yield line + b"\n"
                    offset += len(line) + 1
            except FileNotFoundError:  # another attempt's merged file has them
                continue

    def merge(self) -> None:
        """One file in place of many, read and written line by line: written before they go, so that nothing is lost between."""
        self.flush()
        if len(self.files) > 1:
            write_file(self.folder, f"merged-{uuid.uuid4().hex}.json", self._lines())
            store = store_of(self.folder)[0]
            for path in self.files:
                try:
                    store.delete_file(path)
                except FileNotFoundError:  # another attempt of the task has merged too
                    pass


class Flusher:
    """While it is open, a thread writes the buckets' answers every FLUSH seconds; what it can't write, the end of the task tries again."""

    def __init__(self):
        self.buckets: dict[int, Answers] = {}
        self.ended = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.ended.wait(FLUSH):
            for kept in list(self.buckets.values()):
                try:
                    kept.flush()
                except OSError:
                    continue

    def __enter__(self) -> Flusher:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()


def ask_each(prompts: DataFrame, calling: Calling, store: str, parallel: int, again: bool) -> DataFrame:
    """(id, text, error) of (id, bucket, prompt), which is dealt by bucket: at most parallel calls of a task are under way at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(kept: Answers, prompt_id: str, prompt: str) -> tuple[str | None, str | None]:
            answer = calling(prompt)
            kept.keep(prompt_id, answer)
            return answer

        with Flusher() as flusher, ThreadPoolExecutor(parallel) as pool:
            buckets = flusher.buckets
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                found: list = [None] * batch.num_rows
                under_way: deque = deque()
                for i, (prompt_id, bucket, prompt) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "bucket", "prompt")))):
                    if bucket not in buckets:
                        buckets[bucket] = Answers(store, bucket, again)
                    kept = buckets[bucket]
                    found[i] = kept.get(prompt_id)
                    if found[i] is None:
                        if len(under_way) >= parallel:
                            at, call = under_way.popleft()
                            found[at] = call.result()
                        under_way.append((i, pool.submit(one, kept, prompt_id, prompt)))
                for at, call in under_way:
                    found[at] = call.result()
                columns = [batch.column("id"), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "error"])
        for kept in buckets.values():
            kept.merge()

    return prompts.mapInArrow(run, "id string, text string, error string")


def answered(rows: DataFrame, prompt: str, clients: Client | Sequence[Client], into: str = "answer", store: str | None = None, parallel: int = 8, attempts: int = 1, backoff: float = 0.5, tasks: int | None = None, again: bool = False) -> DataFrame:
    """rows with the struct into {text, error}: what the clients answer to the column prompt.

    Equal prompts are asked for once. An answer is written to store, a folder
    (else a new one in the shared folder), within FLUSH seconds, under the
    prompt's hash; whoever runs the plan again, or a task of it after an
    executor is lost, finds it there and asks for what is missing only. A later
    job that names the same store asks for new prompts only, and for failed
    ones if again is true. Prompts are dealt by their hash to tasks (else as
    many as shuffles have), each with at most parallel calls at once; the
    clients are called from several threads. Null and empty prompts are
    BAD_REQUEST and aren't asked for. Speculative copies of a task may ask
    twice; the last answer is kept.
    """
    spark = rows.sparkSession
    calling = Calling(tuple(clients) if isinstance(clients, Sequence) else (clients,), attempts, backoff)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("__id", F.when(F.col(prompt) != "", F.sha2(F.col(prompt).cast("string"), 256)))
    distinct = keyed.where("__id is not null").groupBy(F.col("__id").alias("id")).agg(F.any_value(F.col(prompt).cast("string")).alias("prompt"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")
    dealt = distinct.withColumn("bucket", bucket).repartitionById(tasks, "bucket")
    found = ask_each(dealt.select("id", "bucket", "prompt"), calling, store or fresh_folder(spark), parallel, again)
    both = keyed.join(found.select(F.col("id").alias("__id"), F.struct("text", "error").alias("__answer")), "__id", "left")
    bad = F.struct(F.lit(None).cast("string").alias("text"), F.lit("BAD_REQUEST").alias("error"))
    return both.withColumn(into, F.coalesce("__answer", bad)).drop("__id", "__answer")
