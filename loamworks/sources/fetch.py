"""Pages over HTTP as a source: urls are spread over tasks, each with bounded concurrency, retries and pauses."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "url string, success boolean, html string, error_message string, response_time double"


def get(url: str, timeout: float = 30.0) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "loamworks"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def attempt(url: str | None, fetch: Callable[[str], str], attempts: int, backoff: float, pause: Callable[[float], None] = time.sleep) -> tuple:
    """One row of the result: the page, or the last error after all attempts."""
    began, error = time.monotonic(), "no url"
    for k in range(attempts if url else 0):
        try:
            return url, True, fetch(url), None, time.monotonic() - began
        except (OSError, ValueError, urllib.error.URLError) as problem:
            error = f"{type(problem).__name__}: {problem}"
            if k + 1 < attempts:
                pause(backoff**k)
    return url, False, None, error, time.monotonic() - began


def robots_rules(host: str, fetch: Callable[[str], str], known: dict[str, str | None]) -> str | None:
    """The robots text of a host (scheme and name), asked for once in each task; none if it cannot be had."""
    if host not in known:
        try:
            known[host] = fetch(f"{host}/robots.txt")
        except (OSError, ValueError, urllib.error.URLError):
            known[host] = None
    return known[host]


def blocked(text: str | None, url: str, agent: str | None = None) -> bool:
    """Whether a robots text keeps a url from being fetched.

    Without an agent by the plain rule of `functions.text.robots_allows` (a line that begins with "disallow: /");
    with one by the full rules for that agent.
    """
    if not text:
        return False
    if agent is None:
        return any(line.strip().lower().startswith("disallow: /") for line in text.split("\n"))
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return not rules.can_fetch(agent, url)


def fetch_pages(urls: DataFrame, url: str = "url", concurrency: int = 10, attempts: int = 3, backoff: float = 1.5, fetch: Callable[[str], str] = get, robots: bool = True, agent: str | None = None) -> DataFrame:
    """url, success, html, error_message, response_time of each url; a failure is a row, not an exception.

    With `robots`, a host's robots text is asked first and urls that it keeps out are not requested.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}

        def one(u: str | None) -> tuple:
            if robots and u and "://" in u and blocked(robots_rules("/".join(u.split("/", 3)[:3]), fetch, known), u, agent):
                return u, False, None, "blocked by robots.txt", 0.0
            return attempt(u, fetch, attempts, backoff)

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                rows = list(pool.map(one, b["url"]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return urls.select(F.col(url).alias("url")).mapInPandas(run, SCHEMA)
