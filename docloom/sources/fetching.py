"""Fetching of pages: a table of addresses in, a table of responses out.

All addresses of a host are in one task, so no host is asked by two tasks at once; within a task hosts take turns, and
between two requests to one host at least ``delay`` seconds pass. The rules of a site are asked for once a task, with the
same agent: 401 and 403 forbid all, other 4xx allow all, and a site whose rules can't be read is not fetched. What a request
is made with is a function, so that tests and other clients can put theirs in its place.

Defined results: each distinct address has one row; ``error`` says why one has no body; addresses that aren't http or https
are not asked for; a null address is left out; an empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pages import allowed

#: What a request gives: final address, status, Content-Type, body.
Response = tuple[str, int, str, bytes]
#: Sites whose rules a task remembers.
SITES = 10_000
SCHEMA = "url string, final_url string, status int, content_type string, body binary, error string"


def http(url: str, agent: str, timeout: float) -> Response:
    """A GET request, redirects followed."""
    request = Request(url, headers={"User-Agent": agent, "Accept": "text/html,text/plain;q=0.9,*/*;q=0.1"})
    try:
        with urlopen(request, timeout=timeout) as response:
            return response.geturl(), response.status, response.headers.get("Content-Type", ""), response.read()
    except HTTPError as error:
        return url, error.code, "", b""


class Visitor:
    """A task's requests: one at a time, each host's apart by ``delay`` seconds."""

    def __init__(self, transport: Callable[[str, str, float], Response], agent: str, delay: float, timeout: float):
        self.transport, self.agent, self.delay, self.timeout = transport, agent, delay, timeout
        self.last: OrderedDict[str, float] = OrderedDict()
        self.sites: OrderedDict[str, RobotFileParser | None] = OrderedDict()

    def ask(self, url: str) -> Response:
        host = urlsplit(url).netloc.lower()
        wait = self.last.pop(host, -self.delay) + self.delay - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        try:
            return self.transport(url, self.agent, self.timeout)
        finally:
            self.last[host] = time.monotonic()
            if len(self.last) > SITES:
                self.last.popitem(last=False)

    def rules(self, url: str) -> RobotFileParser | None:
        parts = urlsplit(url)
        site = f"{parts.scheme.lower()}://{parts.netloc.lower()}"
        if site not in self.sites:
            self.sites[site] = self.read_rules(f"{site}/robots.txt")
            if len(self.sites) > SITES:
                self.sites.popitem(last=False)
        return self.sites[site]

    def read_rules(self, url: str) -> RobotFileParser | None:
        try:
            _, status, _, body = self.ask(url)
        except Exception:
            return None
        rules = RobotFileParser(url)
        if status >= 500:
            return None
        if status in (401, 403):
            rules.disallow_all = True
        elif status >= 400:
            rules.allow_all = True
        else:
            rules.parse(body.decode("utf-8", "replace").splitlines())
        rules.modified()
        return rules

    def visit(self, url: str) -> tuple:
        """(final_url, status, content_type, body, error)."""
        try:
            rules = self.rules(url)
            if rules is None:
                return None, None, None, None, "the site's rules can't be verified"
            if not rules.can_fetch(self.agent, url):
                return None, None, None, None, "disallowed by robots.txt"
            final, status, kind, body = self.ask(url)
            return (final, status, kind, body, None) if status < 400 else (final, status, kind, None, f"status {status}")
        except Exception as error:
            return None, None, None, None, f"{type(error).__name__}: {error}"


def fetch_pages(pages: DataFrame, agent: str, url: str = "url", delay: float = 1.0, timeout: float = 20.0, transport: Callable[[str, str, float], Response] = http, domains: list[str] | None = None) -> DataFrame:
    """(url, final_url, status, content_type, body, error) of each distinct address of ``pages``; ``pages.decoded_bodies`` makes texts of the bodies. Every run asks anew: write the result once."""

    def run(batches):
        visitor = Visitor(transport, agent, delay, timeout)
        for batch in batches:
            for at in range(batch.num_rows):  # a page at a time: bodies may be large
                address, good = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                told = visitor.visit(address) if good else (None, None, None, None, "unsupported address")
                yield pa.record_batch([pa.array([x], t) for x, t in zip((address, *told), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["url", "final_url", "status", "content_type", "body", "error"])

    rows = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    turns = rows.withColumn("host", host).withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("url")))
    dealt = turns.repartition("host").sortWithinPartitions("turn", "host")
    return dealt.select("url", allowed(F.col("url"), domains)).mapInArrow(run, SCHEMA)
