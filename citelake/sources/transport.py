"""Requests to a bibliographic search service: building, retrying, quota and typed errors."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from citelake.errors import TRANSIENT, BadInput, Malformed, NoKey, Offline, SearchError, of_status

MAX_TRIES = 3
TIMEOUT = 60.0


@dataclass(frozen=True)
class Quota:
    limit: int | None = None
    remaining: int | None = None
    reset: datetime | None = None
    status: str | None = None
    retry_after: float | None = None


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds from a Retry-After header, given in seconds or as a date; never below 0."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        then = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, (then - (now or datetime.now(UTC))).total_seconds())


def quota_of(headers: Mapping[str, str]) -> Quota:
    low = {k.lower(): v for k, v in headers.items()}

    def number(name: str) -> int | None:
        try:
            return int(float(low[name]))
        except (KeyError, ValueError):
            return None

    stamp = number("x-ratelimit-reset")
    if stamp is not None and stamp > 10**11:  # milliseconds
        stamp //= 1000
    return Quota(number("x-ratelimit-limit"), number("x-ratelimit-remaining"), datetime.fromtimestamp(stamp, UTC) if stamp else None, low.get("x-els-status"), retry_after(low.get("retry-after")))


@dataclass
class Service:
    """Where and how to ask. The key is taken from the argument, else from the environment, and is never shown."""

    base_url: str
    api_key: str | None = field(default=None, repr=False)
    inst_token: str | None = field(default=None, repr=False)
    timeout: float | None = TIMEOUT
    max_tries: int = MAX_TRIES
    pause: float = 1.0
    backoff: Callable[[int], float] | None = None  # seconds to wait after the n-th failure; else the pause, doubled each time

    def headers(self) -> dict[str, str]:
        key = self.api_key or os.environ.get("SCOPUS_API_KEY")
        if not key:
            raise NoKey("no API key was given")
        token = self.inst_token or os.environ.get("SCOPUS_INST_TOKEN")
        return {"Accept": "application/json", "User-Agent": "citelake", "X-ELS-APIKey": key} | ({"X-ELS-Insttoken": token} if token else {})

    def get(self, path: str = "", params: Mapping[str, object] | None = None) -> tuple[bytes, Quota]:
        query = urllib.parse.urlencode({k: v for k, v in (params or {}).items() if v is not None})
        url = self.base_url + path + (f"?{query}" if query else "")
        request = urllib.request.Request(url, headers=self.headers())
        for attempt in range(1, self.max_tries + 1):
            try:
                wait = self.timeout if self.timeout and self.timeout > 0 else None
                with urllib.request.urlopen(request, timeout=wait) as answer:  # noqa: S310
                    return answer.read(), quota_of(dict(answer.headers))
            except urllib.error.HTTPError as error:
                quota = quota_of(dict(error.headers))
                if error.code not in TRANSIENT or attempt == self.max_tries:
                    raise of_status(error.code, quota) from None
                own = self.backoff(attempt) if self.backoff else self.pause * 2 ** (attempt - 1)
                time.sleep(quota.retry_after if quota.retry_after is not None else own)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                raise Offline(f"the service can't be reached: {type(error).__name__}") from None
        raise SearchError("no answer")

    def page(self, query: str, count: int, start: int | None = None, cursor: str | None = None, date: str | None = None, view: str = "STANDARD") -> tuple[dict, Quota]:
        """One page as parsed JSON: its search-results object."""
        if start is not None and cursor is not None:
            raise BadInput("start and cursor exclude each other")
        body, quota = self.get("", {"query": query, "count": count, "start": start, "cursor": cursor, "date": date, "view": view})
        try:
            results = json.loads(body)["search-results"]
        except (ValueError, KeyError, TypeError):
            raise Malformed("the answer isn't a page of search results", quota=quota) from None
        if not isinstance(results, dict):
            raise Malformed("the answer isn't a page of search results", quota=quota)
        return results, quota

    def lookup(self, kind: str, identifier: str, view: str | None = None) -> tuple[dict, Quota]:
        """One abstract; each segment of the identifier is percent-encoded, its slashes stay."""
        safe = "/".join(urllib.parse.quote(s, safe="") for s in identifier.split("/"))
        body, quota = self.get(f"/{kind}/{safe}", {"view": view})
        try:
            found = json.loads(body)["abstracts-retrieval-response"]
        except (ValueError, KeyError, TypeError):
            raise Malformed("the answer isn't an abstract", quota=quota) from None
        if not isinstance(found, dict) or not ({"coredata", "references"} & set(found)):
            raise Malformed("the answer isn't an abstract", quota=quota)
        return found, quota


def total_of(results: dict) -> float | None:
    try:
        return float(results["opensearch:totalResults"])
    except (KeyError, TypeError, ValueError):
        return None


def entries_of(results: dict) -> list[dict]:
    """The entries of a page; the lone error entry that stands for an empty result is none."""
    found = results.get("entry") or []
    found = [found] if isinstance(found, dict) else found
    if len(found) == 1 and "error" in found[0] and not found[0].get("dc:identifier") and not found[0].get("prism:doi"):
        return []
    return found
