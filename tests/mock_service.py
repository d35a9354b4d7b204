"""A small search service for tests: a virtual corpus behind a local HTTP server."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse


def entry(k: int) -> dict:
    return {"dc:identifier": f"SCOPUS_ID:{k}", "prism:doi": f"10.1000/mock.{k:04d}", "dc:title": f"Title {k}", "dc:creator": "Doe, J.", "prism:publicationName": "Journal", "prism:coverDate": f"20{k % 20 + 1:02d}-05-01", "citedby-count": str(k)}


@contextmanager
def service(total: int = 450, say_total: bool = True, fail_first: int = 0, status: int = 429, runaway: bool = False, body: bytes | None = None, answer: Callable[[dict], int] | None = None):
    asked: list[dict] = []
    tell = answer
    failures = [fail_first]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, code: int, data: bytes, **headers: str) -> None:
            self.send_response(code)
            for k, v in {"X-RateLimit-Limit": "20000", "X-RateLimit-Remaining": "19999", **headers}.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            asked.append(q | {"path": url.path, "key": self.headers.get("X-ELS-APIKey")})
            if failures[0] > 0:
                failures[0] -= 1
                return self.answer(status, b"", Retry_After="0")
            if body is not None:
                return self.answer(200, body)
            if "/doi/" in url.path or "/scopus_id/" in url.path:
                return self.lookup(unquote(url.path))
            n = tell(q) if tell else total // 10 if q.get("date") else total
            count = int(q["count"])
            at = int(q.get("start", 0)) if "cursor" not in q else (0 if q["cursor"] == "*" else int(q["cursor"]))
            rows = [entry(k) for k in range(at, min(at + count, 10**9 if runaway else n))]
            results: dict = {"entry": rows or [{"error": "Result set was empty"}]}
            if say_total and not runaway:
                results["opensearch:totalResults"] = str(n)
            if "cursor" in q and (runaway or at + len(rows) < n):
                results["cursor"] = {"@next": str(at + len(rows))}
            self.answer(200, json.dumps({"search-results": results}).encode())

        def lookup(self, path: str):
            key = path.split("/doi/")[-1]
            if "forbidden" in key:
                return self.answer(403, b"")
            if "missing" in key:
                return self.answer(404, b"")
            reference = {"@id": "1", "ref-info": {"ref-authors": {"author": [{"ce:surname": "Roe", "ce:initials": "R."}]}, "refd-itemidlist": {"itemid": {"@idtype": "DOI", "$": "10.1/r"}}, "ref-title": {"ref-titletext": "Cited"}, "ref-sourcetitle": "J", "ref-publicationyear": {"@first": "1999"}}}
            found = {
                "coredata": {"dc:identifier": "SCOPUS_ID:7", "prism:doi": key, "dc:title": "T", "dc:description": "An abstract", "prism:publicationName": "J", "prism:coverDate": "2020-01-01", "citedby-count": "3"},
                "authkeywords": {"author-keyword": [{"$": "alpha"}, {"$": "beta"}]},
                "item": {"bibrecord": {"tail": {"bibliography": {"@refcount": "2", "reference": [reference]}}}},
            }
            self.answer(200, json.dumps({"abstracts-retrieval-response": found}).encode())

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()
