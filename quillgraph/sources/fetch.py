"""Fetching over HTTP, from tasks: polite clients for an index's answers and for PDFs, and attempts as a table.

A client is made once in each task.  Links are dealt out by host, so that one task alone talks to a host and its pace
holds over the whole cluster.  `opener` does the talking: it takes an address and returns an `Answer` or raises; tests and
closed networks put their own in its place.
"""

from __future__ import annotations

import hashlib
import os
import random
import socket
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an attempt to fetch a PDF may come to.
OUTCOMES = ("ok", "refused", "not-found", "http-error", "not-a-pdf", "too-large", "timeout", "network", "redirect-loop", "cancelled")
WEEK = 7 * 24 * 3600
MOST_BYTES = 200_000_000
_ATTEMPT = pa.schema([("work_id", pa.string()), ("place", pa.int32()), ("url", pa.string()), ("outcome", pa.string()), ("size", pa.int64()), ("sha256", pa.string())])


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes


class Loop(Exception):
    """Redirects that never end."""


Opener = Callable[[str], Answer]


def open_url(url: str, timeout: float = 30.0) -> Answer:
    """The standard library's opener; its redirect errors are loops."""
    try:
        with urlopen(Request(url, headers={"User-Agent": "quillgraph"}), timeout=timeout) as r:
            return Answer(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(MOST_BYTES + 1))
    except HTTPError as e:
        if "redirect" in str(e.reason).lower():
            raise Loop(url) from e
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, b"")


def wait_asked(headers: dict[str, str]) -> float | None:
    """The seconds that a Retry-After header asks for; dates aren't read."""
    value = headers.get("retry-after", "").strip()
    return float(value) if value.isdigit() else None


class Client:
    """GETs at a limited rate, with retries of what may pass, and a cache of files."""

    def __init__(self, rate: float = 5.0, retries: int = 3, longest_wait: float = 60.0, cache: str | None = None, max_age: float = WEEK, opener: Opener = open_url, clock=time.monotonic, sleep=time.sleep, jitter=random.random):
        self.pause, self.retries, self.longest, self.cache, self.max_age = 1.0 / rate, retries, longest_wait, cache, max_age
        self.opener, self.clock, self.sleep, self.jitter = opener, clock, sleep, jitter
        self.free_at = clock()

    def _place(self, url: str) -> str | None:
        return self.cache and os.path.join(self.cache, hashlib.sha256(url.encode()).hexdigest())

    def _kept(self, path: str | None) -> bytes | None:
        try:
            if path and time.time() - os.path.getmtime(path) < self.max_age:
                with open(path, "rb") as f:
                    return f.read()
        except OSError:
            pass
        return None

    def get(self, url: str) -> Answer:
        """The answer, from the cache if it is young; 429 and 5xx and broken connections are tried again, longer waits than allowed are not."""
        path = self._place(url)
        if (body := self._kept(path)) is not None:
            return Answer(200, {}, body)
        for turn in range(self.retries + 1):
            now = self.clock()
            if now < self.free_at:
                self.sleep(self.free_at - now)
            self.free_at = max(now, self.free_at) + self.pause
            asked = None
            try:
                answer = self.opener(url)
                if answer.status != 429 and answer.status < 500:
                    break
                asked = wait_asked(answer.headers)
                if asked is not None and asked > self.longest:
                    break
            except (URLError, OSError):
                if turn == self.retries:
                    raise
            if turn < self.retries:
                self.sleep(max(asked or 0.0, 2.0**turn * (0.5 + self.jitter())))
        if path and answer.status == 200:
            try:
                os.makedirs(self.cache, exist_ok=True)
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(answer.body)
                os.replace(f"{path}.{os.getpid()}", path)
            except OSError:
                pass  # a fetch never fails over the cache
        return answer


def outcome_of(answer: Answer | Exception, most: int = MOST_BYTES) -> str:
    """One of `OUTCOMES` for an answer, or for what was raised instead."""
    if isinstance(answer, Answer):
        if answer.status in (401, 403):
            return "refused"
        if answer.status in (404, 410):
            return "not-found"
        if answer.status != 200:
            return "http-error"
        if b"%PDF-" not in answer.body[:1024]:
            return "not-a-pdf"
        return "too-large" if len(answer.body) > most else "ok"
    if isinstance(answer, Loop):
        return "redirect-loop"
    if isinstance(answer, KeyboardInterrupt):
        return "cancelled"
    cause = getattr(answer, "reason", answer)
    if isinstance(cause, (TimeoutError, socket.timeout)):
        return "timeout"
    return "http-error" if isinstance(answer, ValueError) else "network"


def attempted(links: DataFrame, opener: Opener = open_url, pause: float = 1.0, tasks: int = 32) -> DataFrame:
    """(work_id, place, url, outcome, size, sha256) of one try of each link (work_id, place, url), at most one a `pause` and host."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str, float] = {}
        for rows in batches:
            out = []
            for work, place, url in zip(*(c.to_pylist() for c in rows.columns[:3]), strict=True):
                host = urlsplit(url or "").hostname
                answer: Answer | Exception
                if urlsplit(url or "").scheme not in ("http", "https") or not host:
                    answer = ValueError(url)
                else:
                    time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                    free[host] = time.monotonic() + pause
                    try:
                        answer = opener(url)
                    except Exception as e:  # noqa: BLE001  # whatever it is, it is this link's outcome
                        answer = e
                result = outcome_of(answer)
                good = result == "ok"
                out.append((work, place, url, result, len(answer.body) if good else None, hashlib.sha256(answer.body).hexdigest() if good else None))
            yield pa.RecordBatch.from_pylist([dict(zip(_ATTEMPT.names, r, strict=True)) for r in out], schema=_ATTEMPT)

    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    dealt = links.select("work_id", F.col("place").cast("int").alias("place"), "url").withColumn("host", host).repartition(tasks, "host").sortWithinPartitions("host", "place", "work_id")
    return dealt.mapInArrow(make, "work_id string, place int, url string, outcome string, size long, sha256 string")


def downloaded(links: DataFrame, keep: Callable[[DataFrame], DataFrame], opener: Opener = open_url, pause: float = 1.0) -> DataFrame:
    """All attempts for works with ranked links (work_id, place from 1, url): the next link of a work is tried only where those before failed.

    `keep` writes a table and reads it back, so that no link is tried twice.
    """
    last = links.agg(F.max("place")).first()[0] or 0
    done = None
    for place in range(1, last + 1):
        todo = links.filter(F.col("place") == place)
        if done is not None:
            todo = todo.join(done.filter("outcome = 'ok'").select("work_id"), "work_id", "left_anti")
        tried = keep(attempted(todo, opener, pause))
        done = tried if done is None else done.unionByName(tried)
    return done if done is not None else attempted(links, opener, pause)
