"""Descriptions of files by a generator: prompt in, typed JSON out, failures as rows.

The generator is an object with ``generate(system, prompt, label) -> str``. The
default works offline and is deterministic, so plans and tests need no network;
``HttpGenerator`` speaks two public chat request shapes. Calls run in as many
partitions as may be in flight at once; each has its share of a rate limit and
keeps it over every window of a minute.

With a journal every answer is a file of its own in a shared folder before the
next call begins. A task that runs again, after a lost executor or a lost block,
and a later run take what is there and call only for the rest.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BASE_SECONDS, MAX_RETRIES, RETRY_STATUS
from ..sources import store
from .prompts import system

log = logging.getLogger(__name__)

_LIST, _NAMED = "array<string>", "array<struct<name:string,description:string>>"
_METHODS = "array<struct<name:string,description:string,params:array<struct<name:string,description:string>>,returns:string,throws:array<string>>>"
#: Required fields of each kind's description and their types; all of a struct's fields are required too.
FIELDS: dict[str, dict[str, str]] = {
    "apex": {"class_name": "string", "summary": "string", "description": "string", "methods": _METHODS, "properties": _NAMED, "usage_examples": _LIST, "relationships": _LIST},
    "triggers": {"trigger_name": "string", "sobject": "string", "summary": "string", "description": "string", "events": "array<struct<event:string,description:string>>", "handler_classes": _LIST, "usage_notes": _LIST, "relationships": _LIST},
    "flows": {"api_name": "string", "label": "string", "summary": "string", "description": "string", "business_process": "string", "entry_criteria": "string", "key_decisions": _LIST, "admin_notes": _LIST, "relationships": _LIST},
    "validation-rules": {"rule_name": "string", "object_name": "string", "summary": "string", "when_fires": "string", "what_protects": "string", "formula_explanation": "string", "edge_cases": _LIST, "relationships": _LIST},
    "objects": {"object_name": "string", "label": "string", "summary": "string", "description": "string", "purpose": "string", "key_fields": _LIST, "relationships": _LIST, "admin_notes": _LIST},
    "lwc": {"component_name": "string", "summary": "string", "description": "string", "api_props": _NAMED, "usage_notes": _LIST, "relationships": _LIST},
    "flexipages": {"api_name": "string", "label": "string", "summary": "string", "description": "string", "usage_context": "string", "key_components": _LIST, "relationships": _LIST},
    "aura": {"component_name": "string", "summary": "string", "description": "string", "attributes": _NAMED, "usage_notes": _LIST, "relationships": _LIST},
}
#: Name, display name, key variable, whether a key is needed, base address, default model.
PROVIDERS = (
    ("gemini", "Google Gemini", "GEMINI_API_KEY", True, "https://generativelanguage.googleapis.com/v1beta", "gemini-2.5-flash"),
    ("groq", "Groq", "GROQ_API_KEY", True, "https://api.groq.com/openai/v1", "llama-3.3-70b-versatile"),
    ("openai", "OpenAI", "OPENAI_API_KEY", True, "https://api.openai.com/v1", "gpt-4o-mini"),
    ("ollama", "Ollama (local)", "OLLAMA_API_KEY", False, "http://localhost:11434/v1", "llama3.2"),
)
CONCURRENCY = 3
#: Seconds of a rate window, for a connection, and for a whole answer; the text that says that no quota is left.
WINDOW_SECONDS, CONNECT_SECONDS, ANSWER_SECONDS, NO_QUOTA = 60.0, 30, 120, "limit: 0"


class Generator(Protocol):
    def generate(self, system: str, prompt: str, label: str) -> str: ...


def providers(spark: SparkSession) -> DataFrame:
    """The providers and where their key would come from."""
    rows = [(*p, "environment" if os.environ.get(p[2]) else "not needed" if not p[3] else "missing") for p in PROVIDERS]
    return spark.createDataFrame(rows, "provider string, display_name string, env_var string, needs_key boolean, base_url string, default_model string, key_state string")


def api_key(provider: str) -> str:
    """The key from the environment; empty if the provider needs none, else an error."""
    p = next(p for p in PROVIDERS if p[0] == provider)
    if (key := os.environ.get(p[2])) or not p[3]:
        return key or ""
    raise KeyError(f"{p[1]} needs a key in {p[2]}")


@dataclass(frozen=True)
class OfflineGenerator:
    """A description made of the prompt's first line and its hash. It is ``local``: calls go nowhere; and ``free``: asking again takes less than looking up an answer."""

    local = free = True

    def generate(self, system: str, prompt: str, label: str) -> str:
        kind = system.split(":", 1)[0]
        words = re.findall(r"\w+", label)
        head = f"{' '.join(words)} ({hashlib.sha256(prompt.encode()).hexdigest()[:8]})"
        out: dict[str, object] = {f: [] if t.startswith("array") else head for f, t in FIELDS.get(kind, {"summary": "string"}).items()}
        return json.dumps(out, sort_keys=True)


class HttpGenerator:
    """A chat request over HTTPS; retries what may pass, waiting as the answer asks or ever longer. Without a key ``prepare`` looks for one."""

    def __init__(self, provider: str, model: str, key: str | None = None, send: Callable | None = None, sleep: Callable[[float], None] = time.sleep):
        self.provider, self.model, self.key, self.send, self.sleep = provider, model, key, send, sleep

    def prepare(self) -> None:
        """Called on the driver once there is something to describe: only then is a key needed."""
        if self.key is None:
            self.key = api_key(self.provider)

    def request(self, system: str, prompt: str) -> tuple[str, dict, dict]:
        base = next(p[4] for p in PROVIDERS if p[0] == self.provider)
        if self.provider == "gemini":
            body = {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0.2, "responseMimeType": "application/json"}}
            return f"{base}/models/{self.model}:generateContent", {"x-goog-api-key": self.key}, body
        body = {"model": self.model, "temperature": 0.2, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        return f"{base}/chat/completions", {"Authorization": f"Bearer {self.key}"} if self.key else {}, body

    def text_of(self, answer: dict) -> str:
        if self.provider == "gemini":
            return answer["candidates"][0]["content"]["parts"][0]["text"]
        return answer["choices"][0]["message"]["content"]

    def generate(self, system: str, prompt: str, label: str) -> str:
        url, headers, body = self.request(system, prompt)
        for attempt in range(MAX_RETRIES + 1):
            status, sent, text = (self.send or _post)(url, headers, body)
            if status == 200:
                return self.text_of(json.loads(text))
            if attempt == MAX_RETRIES or status not in (*RETRY_STATUS, 0) or (self.provider == "gemini" and status == 429 and NO_QUOTA in text):
                raise RuntimeError(f"{self.provider}: {label}: status {status}: {text[:200]}")
            seconds = wait(sent.get("retry-after"), text, attempt)
            log.warning("%s: %s: status %s, attempt %s of %s, again in %s s", self.provider, label, status, attempt + 1, MAX_RETRIES + 1, seconds)
            self.sleep(seconds)
        raise AssertionError


def wait(header: str | None, body: str, attempt: int, chance: Callable[[int, int], int] | None = None) -> int:
    """Seconds before the next try: the header's, else the body's hint, else random in half to all of a doubling cap."""
    import math
    import random

    for text in (header, m[1] if (m := re.search(r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)s", body)) else None):
        try:
            return math.ceil(float(text)) + 1
        except (TypeError, ValueError, OverflowError):  # an infinite wait is none
            continue
    half = BASE_SECONDS * 2**attempt // 2
    return (chance or random.randint)(half, 2 * half)


def _post(url: str, headers: dict, body: dict) -> tuple[int, dict, str]:
    """Status (0 for a network error), headers and text; a connection and an answer each have their own time."""
    import http.client
    from urllib.parse import urlsplit

    at = urlsplit(url)
    kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
    line = kind(at.hostname, at.port, timeout=CONNECT_SECONDS)
    try:
        line.connect()
        line.sock.settimeout(ANSWER_SECONDS)
        line.request("POST", at.path + (f"?{at.query}" if at.query else ""), json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        answer = line.getresponse()
        return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read().decode(errors="replace")
    except (OSError, http.client.HTTPException) as e:
        return 0, {}, str(e)
    finally:
        line.close()


class Limiter:
    """At most ``capacity`` starts in any window of a minute (0: no limit); ``acquire`` waits until one more may start."""

    def __init__(self, capacity: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.clock, self.sleep, self.started = capacity, clock, sleep, deque()

    def acquire(self) -> None:
        while self.capacity:
            now = self.clock()
            while self.started and now - self.started[0] >= WINDOW_SECONDS:
                self.started.popleft()
            if len(self.started) < self.capacity:
                self.started.append(now)
                return
            self.sleep(WINDOW_SECONDS - (now - self.started[0]) + 0.001)


def shares(per_minute: int, concurrency: int) -> list[int]:
    """A limit dealt out to partitions; with a limit below the partitions only so many of them."""
    n = min(concurrency, per_minute) if per_minute else concurrency
    return [per_minute // n + (i < per_minute % n) for i in range(n)]


def problem(kind: str, text: str) -> str | None:
    """What is wrong with a description: no JSON object, a field missing or of the wrong type; further fields are fine."""
    try:
        found = json.loads(text)
    except ValueError as e:
        return f"no JSON: {e}"
    if not isinstance(found, dict):
        return "no JSON object"
    for name, kind_of in FIELDS.get(kind, {}).items():
        if name not in found:
            return f"missing field {name}"
        if (at := _unlike(found[name], kind_of, name)) is not None:
            return at
    return None


def _unlike(value: object, kind_of: str, at: str) -> str | None:
    """Where a value is not of its type (a string, a list or a struct with all of its fields, to any depth), else None."""
    if kind_of == "string":
        return None if isinstance(value, str) else f"wrong type of {at}"
    inner = kind_of[kind_of.index("<") + 1 : -1]
    if kind_of.startswith("array"):
        if not isinstance(value, list):
            return f"wrong type of {at}"
        return next((found for i, v in enumerate(value) if (found := _unlike(v, inner, f"{at}[{i}]")) is not None), None)
    if not isinstance(value, dict):
        return f"wrong type of {at}"
    for name, of in _fields(inner):
        if name not in value:
            return f"missing field {at}.{name}"
        if (found := _unlike(value[name], of, f"{at}.{name}")) is not None:
            return found
    return None


def _fields(inner: str) -> list[tuple[str, str]]:
    """Names and types between the brackets of a struct."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(inner + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, of = inner[start:i].split(":", 1)
            out.append((name, of))
            start = i + 1
    return out


class Journal:
    """Answers by what was asked, each a file of its own; failures only for the ``run`` that met them."""

    def __init__(self, folder: str, model: str, run: str) -> None:
        self.folder, self.model, self.run = folder, model, run

    def _at(self, asked: tuple[str, ...], failed: bool) -> str:
        key = hashlib.sha256(json.dumps([self.model, *asked]).encode()).hexdigest()
        return f"{self.folder}/{self.run}/{key}.error" if failed else f"{self.folder}/answers/{key[:2]}/{key}.json"

    def get(self, asked: tuple[str, ...]) -> tuple[str | None, str | None] | None:
        if (answer := store.read(self._at(asked, False))) is not None:
            return answer.decode(), None
        if (wrong := store.read(self._at(asked, True))) is not None:
            return None, wrong.decode()
        return None

    def put(self, asked: tuple[str, ...], text: str | None, wrong: str | None) -> None:
        store.write(self._at(asked, bool(wrong)), (wrong or text or "").encode("utf-8", "surrogatepass"))


def enrich(work: DataFrame, generator: Generator, concurrency: int = CONCURRENCY, per_minute: int = 0, journal: Journal | None = None) -> DataFrame:
    """``work(kind, path, name, prompt, ...)`` with ``documentation`` and ``error``; one of them is null.

    At most ``concurrency`` calls run at once; a generator that says that it is
    ``local`` calls nobody, so without a limit its rows are described where they
    are, in as many tasks as they come in. ``per_minute`` (0: no limit) is
    dealt out to them; a call is admitted once, not for each retry. The generator
    is told the kind's fields, and an answer without them, nested ones included,
    is an error. What the ``journal`` has is not asked for again, and each answer
    is in it before the next call.
    """
    if concurrency < 1:
        raise ValueError("concurrency must be 1 or more")
    names, capacity = work.columns, shares(per_minute, concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        limiter = Limiter(capacity[TaskContext.get().partitionId() % len(capacity)])
        for pdf in batches:
            docs, errors = [], []
            for kind, path, prompt, name in zip(pdf["kind"], pdf["path"], pdf["prompt"], pdf["name"], strict=True):
                asked = (kind, path or "", prompt or "", name or "")
                if journal and (known := journal.get(asked)):
                    text, wrong = known
                else:
                    limiter.acquire()
                    try:
                        text = generator.generate(system(kind, FIELDS[kind]) if kind in FIELDS else f"{kind}: Answer with a JSON object.", prompt, name or path)
                        wrong = problem(kind, text)
                    except Exception as e:  # noqa: BLE001  every failure is a row, and the others go on
                        text, wrong = None, str(e) or type(e).__name__
                    if journal:
                        journal.put(asked, text, wrong)
                docs.append(None if wrong else text)
                errors.append(f"{name or path}: {wrong}" if wrong else None)
            yield pdf.assign(documentation=docs, error=errors)[[*names, "documentation", "error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema) + ", documentation string, error string"
    dealt = work if getattr(generator, "local", False) and not per_minute else work.repartition(len(capacity))
    return dealt.mapInPandas(run, schema)


def documents(enriched: DataFrame, kind: str) -> DataFrame:
    """The descriptions of one kind as a struct column ``doc``."""
    fields = ", ".join(f"{f} {t}" for f, t in FIELDS[kind].items())
    return enriched.where((F.col("kind") == kind) & F.col("documentation").isNotNull()).withColumn("doc", F.from_json("documentation", fields))
