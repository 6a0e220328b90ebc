"""Calls of an injected model over rows: retries, fallback to other models, cropping of prompts, map and reduce.

A model is a function(prompt, model name) -> Response. It runs in Python workers, once per row; retries happen within the row, never through failed tasks.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from itertools import groupby, islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import ship

COMPLETED, EXCEEDED, OVERLOADED, INVALID, ERRORED = "COMPLETED", "EXCEEDED", "OVERLOADED", "INVALID", "ERRORED"


@dataclass
class Response:
    status: str
    text: str | None = None
    prompt_tokens: int = 0
    completion_tokens: int = 0
    most_tokens: int = 0


@dataclass
class Candidate:
    name: str
    most_completion: int = 0


@dataclass
class Outcome:
    text: str | None = None
    model: str | None = None
    events: list[str] = field(default_factory=list)


Model = Callable[[str, str], Response]
#: Looks at a response, and gives it back, or another one in its place.
Check = Callable[[Response], Response]


def candidates(chain: Sequence[Candidate], start: int = 0) -> list[Candidate]:
    """The configured chain from an index on; an empty rest is an error."""
    rest = list(chain)[start:] if 0 <= start < len(chain) else []
    if not rest:
        raise ValueError(f"no model at {start} of {len(chain)}")
    return rest


def crop(prompt: str, response: Response, most_completion: int) -> str:
    """A prompt cut after an answer that hit a limit."""
    if not prompt.strip():
        return prompt
    ratio = 1.0
    if most_completion and response.completion_tokens >= most_completion - V.COMPLETION_BUFFER:
        ratio = min(most_completion / (response.completion_tokens + 1), V.COMPLETION_RATIO)
    if ratio >= 1 and response.most_tokens > 0:
        ratio = min(response.most_tokens / (response.prompt_tokens + response.completion_tokens + 1), V.PROMPT_RATIO)
    return prompt[: int(len(prompt) * ratio)]


def attempt(model: Model, prompt: str, name: str, events: list[str], retry_invalid: bool = True, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None, check: Check | None = None) -> Response | None:
    """Up to ATTEMPTS calls while the model is overloaded, its answer invalid (as it says, or as check finds) or it raises, with growing random pauses. The last response if none is better, also where later calls raised; None if there was no response at all. A TypeError is a mistake in the model's code, and isn't retried."""
    rng, last = rng or random.Random(), None
    for k in range(V.ATTEMPTS):
        try:
            last = check(model(prompt, name)) if check else model(prompt, name)
        except TypeError:
            return last
        except Exception:  # noqa: BLE001  whatever it is, the next call may do better
            pass
        else:
            if last.status == OVERLOADED:
                events.append("OVERLOAD_RETRY")
            elif last.status == INVALID and retry_invalid:
                events.append("HOPEFUL_RETRY")
            else:
                return last
        if k + 1 < V.ATTEMPTS:
            sleep(min(V.MOST_DELAY_S, V.LEAST_DELAY_S * 2**k * (1 + rng.random())))
    return last


def complete(model: Model, prompt: str, chain: Sequence[Candidate], retry_invalid: bool = True, sleep: Callable[[float], None] = time.sleep, check: Check | None = None) -> Outcome:
    """The first completed answer of the chain. An error ends it. A prompt that is too long goes to the next model, and is cropped where there is none, as long as that makes it shorter."""
    out, k = Outcome(), 0
    while k < len(chain):
        response = attempt(model, prompt, chain[k].name, out.events, retry_invalid, sleep, check=check)
        if response and response.status == COMPLETED:
            out.events.append("SUCCESS")
            out.text, out.model = response.text, chain[k].name
            return out
        last = k + 1 == len(chain)
        if response is None:
            if last:
                break
        elif response.status == EXCEEDED and last:
            shorter = crop(prompt, response, chain[k].most_completion)
            out.events.append("CROP")
            if not shorter.strip() or len(shorter) >= len(prompt):
                break
            prompt = shorter
            continue
        elif response.status not in (EXCEEDED, OVERLOADED, INVALID) or last:
            break
        out.events.append("SWITCH")
        k += 1
    out.events.append("FAILURE")
    return out


#: Folders that kept answers are dealt to; a task holds those of one folder at a time, by the hashes of their prompts. Answers that are kept at a time, and seconds after which fewer are.
FOLDERS, KEPT_AT_ONCE, KEPT_AFTER_S = 256, 32, 10.0


def _name(prompt: str | None, chain: Sequence[Candidate], retry_invalid: bool) -> str:
    """What an answer is kept under: a prompt that is put to other models is another one."""
    return hashlib.sha256(json.dumps([prompt, [(c.name, c.most_completion) for c in chain], retry_invalid]).encode()).hexdigest()


class Answers:
    """Outcomes of prompts, kept in files that are written once; None for a folder keeps nothing. A file that a lost worker left unfinished counts up to where it breaks off."""

    def __init__(self, folder: str | None, name: str):
        self.store, self.path = fs.FileSystem.from_uri(f"{folder.rstrip('/')}/{name}") if folder else (None, None)
        self.known: dict[str, Outcome] = {}
        self.waiting: list[tuple[str, Outcome]] = []
        self.since = time.monotonic()
        if self.store:
            self.store.create_dir(self.path, recursive=True)
            for info in self.store.get_file_info(fs.FileSelector(self.path)):
                with self.store.open_input_stream(info.path) as f:
                    for line in f.read().decode(errors="replace").splitlines():
                        try:
                            key, text, model, events = json.loads(line)
                        except ValueError:
                            continue
                        self.known[key] = Outcome(text, model, events)

    def add(self, key: str, outcome: Outcome, at_once: int = KEPT_AT_ONCE) -> None:
        self.known[key] = outcome
        self.waiting.append((key, outcome))
        if len(self.waiting) >= at_once or time.monotonic() - self.since > KEPT_AFTER_S:
            self.keep()

    def keep(self) -> None:
        if self.store and self.waiting:
            with self.store.open_output_stream(f"{self.path}/{uuid.uuid4().hex}.jsonl") as f:
                f.write("".join(json.dumps([k, o.text, o.model, o.events]) + "\n" for k, o in self.waiting).encode())
        self.waiting, self.since = [], time.monotonic()


def answered(rows: Iterable[tuple[str, str | None, str]], ask: Callable[[str | None], Outcome], answers: Callable[[str], Answers], threads: int, at_once: int) -> Iterator[Outcome]:
    """Outcomes of (folder, prompt, key) rows in their order, by folder. Prompts without an answer are asked once each, so many at a time; what is done is kept even if a later call fails."""
    held = None
    with ThreadPoolExecutor(threads) as pool:
        for folder, group in groupby(rows, key=lambda r: r[0]):
            held = answers(folder)
            group = list(group)
            todo = {key: prompt for _, prompt, key in group if key not in held.known}
            running, left = {}, iter(todo.items())
            try:
                while True:
                    for key, prompt in islice(left, threads - len(running)):
                        running[pool.submit(ask, prompt)] = key
                    if not running:
                        break
                    done, _ = wait(running, return_when=FIRST_COMPLETED)
                    for d in done:
                        held.add(running.pop(d), d.result(), at_once)
            finally:
                held.keep()
            yield from (held.known[key] for _, _, key in group)


def map_prompts(prompts: DataFrame, model: Model, chain: Sequence[Candidate], prompt: str = "prompt", concurrency: int = V.CONCURRENCY, retry_invalid: bool = True, sleep: Callable[[float], None] = time.sleep, check: Check | None = None, answers: str | None = None, tasks: int | None = None, at_once: int = KEPT_AT_ONCE) -> DataFrame:
    """prompts with answer, model and events; at most concurrency calls run at a time, in all tasks together.

    Prompts are dealt to tasks by their hash, so equal ones are asked once, and each task makes its share of the calls at a time. With a folder for answers (in a store that pyarrow.fs opens), what is answered is kept there every at_once calls; a task that runs again, or a later job with the same prompts, models and folder, asks only the others. Failed prompts are kept, too: another folder asks them again. Without a folder nothing outlives a task.
    """
    spark = prompts.sparkSession
    ship(spark)
    tasks = max(1, min(concurrency, tasks or spark.sparkContext.defaultParallelism))
    threads, chain = max(1, concurrency // tasks), list(chain)
    folder = F.lower(F.hex(F.pmod(F.xxhash64(F.coalesce(prompt, F.lit(""))), F.lit(FOLDERS))))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in prompts.dtypes), "answer string", "model string", "events array<string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: list[tuple[str, Answers]] = []

        def of(name: str) -> Answers:
            if not opened or opened[0][0] != name:
                opened[:] = [(name, Answers(answers, name))]
            return opened[0][1]

        for batch in batches:
            texts = [None if pd.isna(p) else p for p in batch[prompt]]
            rows = [(f, p, _name(p, chain, retry_invalid)) for f, p in zip(batch["_folder"], texts, strict=True)]
            done = list(answered(rows, lambda p: complete(model, p, chain, retry_invalid, sleep, check), of, threads, at_once))
            yield batch.drop(columns="_folder").assign(answer=[d.text for d in done], model=[d.model for d in done], events=[d.events for d in done])

    dealt = prompts.withColumn("_folder", folder).repartition(tasks, "_folder").sortWithinPartitions("_folder")
    return dealt.mapInPandas(run, schema)


def map_reduce(batches: DataFrame, group: str, model: Model, chain: Sequence[Candidate], instructions: str, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """An answer per group from its batches (batch, item, text): a prompt per batch; groups of one batch are done, the others' answers are put into one more prompt. Batches without answer are left out; a group without any has none. Few and short texts of a group meet in one row, as they must fit one prompt."""
    head = F.lit(instructions + "\n\n")
    texts = batches.groupBy(group, "batch").agg(F.sort_array(F.collect_list(F.struct("item", "text"))).alias("x"))
    first = map_prompts(texts.select(group, "batch", F.concat(head, F.array_join(F.transform("x", lambda p: p["text"]), "\n")).alias("prompt")), model, chain, sleep=sleep)
    lists = first.groupBy(group).agg(F.count(F.lit(1)).alias("batches"), F.sort_array(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("batch", "answer")))).alias("x"), F.flatten(F.collect_list("events")).alias("events"))
    lists = lists.withColumn("answers", F.transform("x", lambda p: p["answer"])).select(group, "batches", "answers", "events")
    single = lists.where("batches = 1").select(group, F.try_element_at("answers", F.lit(1)).alias("answer"), F.lit("single-pass").alias("strategy"), "events")
    several = lists.where("batches > 1 and size(answers) > 0").select(group, F.col("events").alias("before"), F.concat(head, F.to_json(F.col("answers"))).alias("prompt"))
    reduced = map_prompts(several, model, chain, sleep=sleep).select(group, "answer", F.lit("map-reduce").alias("strategy"), F.concat("before", "events").alias("events"))
    none = lists.where("batches > 1 and size(answers) = 0").select(group, F.lit(None).cast("string").alias("answer"), F.lit("map-reduce").alias("strategy"), "events")
    return single.unionByName(reduced).unionByName(none)


def json_prompt(persona: str, instructions: str, schema: dict, data: str) -> str:
    """Persona, instructions, the schema of the answer and the data, in this order."""
    return f"{persona}\n\n{instructions}\n\nThe answer is JSON of this schema:\n{json.dumps(schema)}\n\nData:\n{data}\n"
