"""Typed errors and warnings of the search workflow. All can be pickled, so tasks can raise them."""

from __future__ import annotations


class SearchError(Exception):
    """Base of all errors; status is the HTTP status, if one was seen."""

    def __init__(self, message: str, status: int | None = None, quota: object = None):
        super().__init__(message)
        self.message, self.status, self.quota = message, status, quota

    def __reduce__(self):
        return type(self), (self.message, self.status, self.quota)


class BadInput(SearchError): ...


class NoKey(SearchError): ...


class Offline(SearchError): ...


class Malformed(SearchError): ...


class BadRequest(SearchError): ...


class Unauthorized(SearchError): ...


class Forbidden(SearchError): ...


class NotFound(SearchError): ...


class TooLong(SearchError): ...


class RateLimited(SearchError): ...


class ServerFault(SearchError): ...


#: Fixed meaning of each status; all others are faults of the server.
BY_STATUS = {400: BadRequest, 401: Unauthorized, 403: Forbidden, 404: NotFound, 413: TooLong, 414: TooLong, 429: RateLimited}
#: Fixed statuses that are tried again.
TRANSIENT = frozenset({429, 500, 502, 503, 504})


def of_status(status: int, quota: object = None) -> SearchError:
    kind = BY_STATUS.get(status, ServerFault)
    return kind(f"the service answered with status {status}", status, quota)


class SearchWarning(UserWarning): ...


class Capped(SearchWarning): ...


class Shortfall(SearchWarning): ...


class CacheUnreadable(SearchWarning): ...


class CacheMismatch(SearchWarning): ...


class IncompleteReferences(SearchWarning): ...


class DroppedRecords(SearchWarning): ...


class MissingCounts(SearchWarning): ...
