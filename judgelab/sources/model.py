"""A client for model servers, and asking many prompts once each.

Calls of a partition run a few at a time.  A call that the server refuses for
now (too many requests, or a fault of its own) or that gets no answer is tried
again after a pause that doubles.  With a store, answers are kept as files as
soon as a few have come, so that a task that runs again, or a later run, asks
only what is missing.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers of a server that are worth another try.
RETRYABLE = frozenset({429, 500, 502, 503, 504})


class ModelError(RuntimeError):
    """A call failed; ``passing`` if it may succeed later."""

    def __init__(self, message: str, passing: bool = False):
        super().__init__(message)
        self.passing = passing


@dataclass(frozen=True)
class Policy:
    retries: int = 2
    backoff: float = 0.5  # seconds before the first new try
    at_once: int = 4
    kept_every: int = 16  # answers of a file in the store


@dataclass(frozen=True)
class ChatServer:
    """``ChatServer(...)`` as ``complete``: makes a function from a prompt to the text of the server's first choice."""

    url: str
    model: str
    key: str = ""
    timeout: float = 60.0
    as_json: bool = False

    def __call__(self) -> Callable[[str], str]:
        def said(prompt: str) -> str:
            body = {"model": self.model, "messages": [{"role": "user", "content": prompt}]} | ({"response_format": {"type": "json_object"}} if self.as_json else {})
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
            request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    answer = json.load(got)
            except urllib.error.HTTPError as e:
                raise ModelError(f"status {e.code}", e.code in RETRYABLE) from e
            except OSError as e:
                raise ModelError(f"no answer: {e}", True) from e
            except ValueError as e:
                raise ModelError("an answer that is no JSON") from e
            try:
                return answer["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError) as e:
                raise ModelError("an answer without a choice") from e

        return said


def patient(call: Callable[[str], str], policy: Policy, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None]]:
    """``call`` with retries: (answer, None) or (None, what went wrong)."""

    def run(prompt: str) -> tuple[str | None, str | None]:
        for k in range(policy.retries + 1):
            try:
                return call(prompt), None
            except Exception as e:  # noqa: BLE001  a failed call is a missing answer, checked downstream
                error = f"{type(e).__name__}: {e}"
                if not getattr(e, "passing", False):
                    break
                if k < policy.retries:
                    sleep(policy.backoff * 2**k)
        return None, error

    return run


def key_of(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


class _Kept:
    """Answers in the store: a folder for the first digits of a prompt's key, a file for a few answers."""

    def __init__(self, store: str):
        self.files, self.root = fs.FileSystem.from_uri(store if "://" in store else f"file://{store}")

    def folder(self, key: str) -> str:
        return f"{self.root}/part={key[:2]}"

    def known(self, folder: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for info in self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as f:
                    found |= dict(json.loads(line) for line in f.read().decode().splitlines() if line)
        return found

    def add(self, folder: str, answers: dict[str, str]) -> None:
        """One file, named by what it holds; it gets its name when it is whole."""
        name = key_of("".join(sorted(answers)))
        self.files.create_dir(folder, recursive=True)
        with self.files.open_output_stream(f"{folder}/{name}.tmp") as f:
            f.write("\n".join(json.dumps([k, v]) for k, v in answers.items()).encode())
        self.files.move(f"{folder}/{name}.tmp", f"{folder}/{name}.json")


def _asker(complete: Callable[[], Callable[[str], str]], store: str | None, policy: Policy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, kept = patient(complete(), policy), _Kept(store) if store else None
        folder, known = None, {}
        with ThreadPoolExecutor(policy.at_once) as pool:
            for b in batches:
                prompts = b.column("prompt").to_pylist()
                for lo in range(0, len(prompts), policy.kept_every):
                    some = prompts[lo : lo + policy.kept_every]
                    keys = [key_of(p) for p in some]
                    answers: dict[str, tuple[str | None, str | None]] = {}
                    for f in dict.fromkeys(kept.folder(k) for k in keys) if kept else ():
                        if f != folder:  # keys come in order, so a folder is read once
                            folder, known = f, kept.known(f)
                        answers |= {k: (known[k], None) for k in keys if k in known}
                    missing = [(k, p) for k, p in zip(keys, some, strict=True) if k not in answers]
                    answers |= dict(zip([k for k, _ in missing], pool.map(call, [p for _, p in missing]), strict=True))
                    if kept:
                        fresh: dict[str, dict[str, str]] = {}
                        for k, _ in missing:
                            if answers[k][0] is not None:
                                fresh.setdefault(kept.folder(k), {})[k] = answers[k][0]
                        for f, found in fresh.items():
                            kept.add(f, found)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([answers[k][j] for k in keys], pa.string()) for j in (0, 1))], names=["prompt", "answer", "error"])

    return run


def ask(prompts: DataFrame, complete: Callable[[], Callable[[str], str]], store: str | None = None, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(prompt, answer, error) of distinct ``prompts`` (prompt); ``store``: a folder that all executors reach.

    A folder of the store is read and written by one task, as prompts are dealt
    out by the first digits of their keys, so no answer is asked for twice while
    the store holds it.
    """
    keyed = prompts.select("prompt", F.sha2(F.col("prompt").cast("binary"), 256).alias("__key"))
    dealt = keyed.repartition(F.substring("__key", 1, 2)).sortWithinPartitions("__key").select("prompt")
    return dealt.mapInArrow(_asker(complete, store, policy), "prompt string, answer string, error string")
