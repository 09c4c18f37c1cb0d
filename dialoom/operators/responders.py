"""Who answers prompts: a model server, a table of recorded replies, or a rule.

All take rows with a `prompt` column and add a nullable `response`; null says
that the call failed. A reply must not be asked for twice: write or persist
the result before several consumers read it.
"""

from __future__ import annotations

import json
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import islice
from queue import SimpleQueue

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(items: Iterable, work: Callable, threads: int) -> Iterator:
    """`work` of each item, in order, `threads` at a time; an item is taken once there is room for it.

    Up to four times `threads` items are under way or done and waiting for an
    earlier one, so a slow call keeps others from being made only for long.
    """
    with ThreadPoolExecutor(threads) as pool:
        waiting: deque[Future] = deque()
        for item in items:
            waiting.append(pool.submit(work, item))
            while waiting and (len(waiting) >= 4 * threads or waiting[0].done()):
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


@dataclass(frozen=True)
class HttpResponder:
    """A chat endpoint: one user message a prompt, no retries; any failure is null.

    A task has `in_flight` calls under way on each host: those of `host` and
    of `more_hosts`, which serve the same model. `parallel` partitions bound
    the tasks, and with that a host's load: `parallel` times `in_flight`. The
    function is marked non-deterministic, so that the optimizer neither
    repeats it nor moves filters through it.
    """

    model: str
    host: str = "http://localhost:11434"
    temperature: float = 0.1
    timeout: float | None = None
    parallel: int | None = None
    options: tuple[tuple[str, object], ...] = ()
    in_flight: int = 4
    more_hosts: tuple[str, ...] = ()

    def _post(self, path: str, body: dict | None = None, host: str | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{(host or self.host).rstrip('/')}{path}", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
            return json.load(reply)

    def ask(self, prompt: str, host: str | None = None) -> str | None:
        body = {"model": self.model, "stream": False, "messages": [{"role": "user", "content": prompt}], "options": dict(self.options) | {"temperature": self.temperature}}
        try:
            content = self._post("/api/chat", body, host)["message"]["content"]
        except Exception:  # a failed call is a null reply, not a failed task
            return None
        return content if isinstance(content, str) else None

    def ask_all(self, prompts: Iterable[str | None]) -> Iterator[str | None]:
        """Replies in the order of the prompts; each call holds one of its host's places."""
        places: SimpleQueue = SimpleQueue()
        hosts = (self.host, *self.more_hosts)
        for _ in range(self.in_flight):
            for host in hosts:
                places.put(host)

        def one(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            host = places.get()
            try:
                return self.ask(prompt, host)
            finally:
                places.put(host)

        return in_order(prompts, one, self.in_flight * len(hosts))

    def respond(self, df: DataFrame) -> DataFrame:
        spread = df.repartition(self.parallel) if self.parallel else df

        def call(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            replies = self.ask_all(p for batch in prompts for p in batch)
            while some := list(islice(replies, 256)):
                yield pd.Series(some, dtype="object")

        asked = F.pandas_udf(call, "string").asNondeterministic()
        return spread.withColumn("response", asked("prompt"))

    def models(self) -> list[str] | None:
        """Names of the server's models; null if it can't be reached."""
        try:
            return [m.get("name") or m.get("model") for m in self._post("/api/tags")["models"]]
        except Exception:
            return None

    def connected(self) -> bool:
        return self.models() is not None

    def model_info(self) -> dict | None:
        try:
            return next((m for m in self._post("/api/tags")["models"] if self.model in (m.get("name"), m.get("model"))), None)
        except Exception:
            return None

    def available(self) -> bool:
        return self.model in (self.models() or [])

    def pull(self) -> bool:
        try:
            self._post("/api/pull", {"model": self.model, "stream": False})
        except Exception:
            return False
        return True

    def with_model(self, name: str) -> tuple[HttpResponder, bool]:
        """This responder with another model, if the server has it; else unchanged."""
        other = replace(self, model=name)
        return (other, True) if other.available() else (self, False)


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


@dataclass(frozen=True)
class ReplayResponder:
    """Recorded replies (prompt_key, response), joined by the prompt's digest; unknown prompts get null."""

    replies: DataFrame

    def respond(self, df: DataFrame) -> DataFrame:
        known = self.replies.groupBy("prompt_key").agg(F.first("response", ignorenulls=True).alias("response"))
        return df.withColumn("prompt_key", prompt_key(F.col("prompt"))).join(known, "prompt_key", "left").drop("prompt_key")


@dataclass(frozen=True)
class RuleResponder:
    """A column rule, for tests; no part of the compared behaviour."""

    rule: Callable[[Column], Column]

    def respond(self, df: DataFrame) -> DataFrame:
        return df.withColumn("response", self.rule(F.col("prompt")))
