"""Fetching, with a transport of the tests' own and with a local server."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from docloom.sources import fetching, pages

RULES = {"a.org": "User-agent: *\nDisallow: /private\n", "b.org:8080": "", "closed.org": 403, "none.org": 404, "broken.org": 503}


def transport_into(folder, slow=0.02):
    """Notes when each request began and ended."""

    def ask(url, agent, timeout):
        began = time.time()
        host, _, path = url.partition("://")[2].partition("/")
        time.sleep(slow)
        Path(folder, f"{host.replace(':', '_')}-{time.time_ns()}").write_text(f"{host} {began} {time.time()} {path}")
        if host == "down.org":
            raise OSError("no route")
        if path == "robots.txt":
            made = RULES.get(host, "")
            return (url, made, "", b"") if isinstance(made, int) else (url, 200, "text/plain", made.encode())
        return (url + "#final", 404, "", b"") if path == "gone" else (url + "#final", 200, "text/html; charset=utf-8", f"<p>{agent} é {path}</p>".encode())

    return ask


def test_rules_and_outcomes(spark, tmp_path):
    urls = ["http://a.org/x", "http://a.org/x", "http://a.org/private/y", "http://a.org/gone", "http://b.org:8080/private", "https://closed.org/", "http://none.org/z", "http://broken.org/z", "http://down.org/z", "ftp://a.org/x", "no address", None]
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, error int").repartition(3)
    got = fetching.fetch_pages(df, "bot", delay=0, transport=transport_into(tmp_path))
    rows = {r.url: r for r in got.collect()}
    assert sorted(rows) == sorted({u for u in urls if u})
    assert {u: r.error for u, r in rows.items() if r.error} == {
        "http://a.org/private/y": "disallowed by robots.txt", "http://a.org/gone": "status 404", "https://closed.org/": "disallowed by robots.txt", "http://broken.org/z": "the site's rules can't be verified",
        "http://down.org/z": "the site's rules can't be verified", "ftp://a.org/x": "unsupported address", "no address": "unsupported address",
    }
    read = rows["http://a.org/x"]
    assert (read.final_url, read.status, bytes(read.body).decode()) == ("http://a.org/x#final", 200, "<p>bot é x</p>")
    assert fetching.fetch_pages(df.limit(0), "bot").collect() == []


def test_one_task_a_host_and_time_between(spark, tmp_path):
    """No two requests to a host overlap, and each waits for the delay; hosts go on beside one another."""
    urls = [f"http://h{k % 5}.org/{k}" for k in range(40)]
    df = spark.createDataFrame([(u,) for u in urls], "url string").repartition(8)
    got = fetching.fetch_pages(df, "bot", delay=0.05, transport=transport_into(tmp_path))
    began = time.time()
    bodies = pages.decoded_bodies(got)
    assert sorted(r.html for r in bodies.select("html").collect()) == sorted(f"<p>bot é {k}</p>" for k in range(40))
    assert time.time() - began < 45
    by_host = {}
    for note in (p.read_text().split(" ") for p in tmp_path.iterdir()):
        by_host.setdefault(note[0], []).append((float(note[1]), float(note[2]), note[3]))
    assert len(by_host) == 5
    for asked in by_host.values():
        asked.sort()
        assert len(asked) == 9 and [p for *_, p in asked].count("robots.txt") == 1
        assert all(later[0] - earlier[1] >= 0.045 for earlier, later in zip(asked, asked[1:], strict=False))


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            known = {"/robots.txt": b"User-agent: *\nDisallow: /no\n", "/page": "<title>T</title><p>é</p>".encode()}
            self.send_response(200 if self.path in known else 302 if self.path == "/moved" else 410)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            if self.path == "/moved":
                self.send_header("Location", "/page")
            self.end_headers()
            self.wfile.write(known.get(self.path, b""))

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_over_http(spark, server):
    df = spark.createDataFrame([(server + p,) for p in ("/page", "/moved", "/gone", "/no/page")], "url string")
    rows = {r.url.removeprefix(server): r for r in fetching.fetch_pages(df, "bot/1.0", delay=0).collect()}
    assert rows["/page"].status == 200 and rows["/moved"].final_url == server + "/page" and rows["/moved"].body == rows["/page"].body
    assert rows["/gone"].error == "status 410" and rows["/no/page"].error == "disallowed by robots.txt"
