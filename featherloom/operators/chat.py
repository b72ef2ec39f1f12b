"""Candidates from a language model behind an HTTP interface of chat completions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

#: Answers that say that a later try may succeed.
LATER = frozenset({408, 425, 429, 500, 502, 503, 504})


@dataclass
class Chat:
    """Sends a prompt to ``url`` and gives the texts of the answers.

    A call that meets a busy or failing server, or none, is tried ``attempts`` times in all, after the wait that the answer asks for or else twice as long each time; other refusals aren't tried again.
    A call without an answer is left out of the sample and counts as a failure in ``calls``.
    """

    url: str
    model_id: str
    key: str | None = None
    system: str = ""
    temperature: float = 0.8
    attempts: int = 4
    wait_s: float = 1.0
    most_wait_s: float = 60.0
    timeout_s: float = 120.0
    sleep: Callable[[float], None] = time.sleep
    calls: list[dict] = field(default_factory=list)

    def _request(self, prompt: str) -> Request:
        told = [{"role": "system", "content": self.system}] if self.system else []
        body = {"model": self.model_id, "temperature": self.temperature, "messages": [*told, {"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return Request(self.url, json.dumps(body).encode(), headers)

    def _pause(self, error: Exception, attempt: int) -> float | None:
        """Seconds to wait before the next try, or null if there is none."""
        if attempt + 1 >= self.attempts:
            return None
        asked = None
        if isinstance(error, HTTPError):
            if error.code not in LATER:
                return None
            asked = error.headers.get("Retry-After")
        pause = self.wait_s * 2**attempt
        if asked:
            try:
                pause = float(asked)
            except ValueError:
                try:
                    pause = parsedate_to_datetime(asked).timestamp() - time.time()
                except ValueError:
                    pass
        return min(max(pause, 0.0), self.most_wait_s)

    def ask(self, prompt: str) -> str | None:
        began = time.monotonic()
        for attempt in range(self.attempts):
            try:
                with urlopen(self._request(prompt), timeout=self.timeout_s) as answer:
                    found = json.load(answer)
                text, usage = found["choices"][0]["message"]["content"], found.get("usage") or {}
            except (OSError, ValueError, LookupError, TypeError) as e:  # no connection, a refusal, no JSON, another shape
                pause = self._pause(e, attempt)
                if pause is None:
                    break
                self.sleep(pause)
                continue
            self._note(usage, time.monotonic() - began, True)
            return text
        self._note({}, time.monotonic() - began, False)
        return None

    def _note(self, usage: dict, seconds: float, ok: bool) -> None:
        self.calls.append({"model_id": self.model_id, "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens"), "latency_s": seconds, "ok": ok})

    def sample(self, prompt: str, parents: list[str], n: int) -> list[str]:
        return [text for text in (self.ask(prompt) for _ in range(n)) if text is not None]

    def table(self, spark: SparkSession) -> DataFrame:
        """The calls so far, as report.call_stats reads them."""
        return spark.createDataFrame([tuple(c.values()) for c in self.calls], "model_id string, prompt_tokens long, completion_tokens long, latency_s double, ok boolean")
