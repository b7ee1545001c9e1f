"""Errors that are part of the interface: a reason, a code, and what to do next."""

from __future__ import annotations

import json
import re

from pantry.functions.scalars import HTML

#: reason: (code, whether to try again, what to do)
CONTRACT: dict[str, tuple[str, bool | None, str]] = {
    "not_found": ("NotFound", None, "Check the barcode, or search by name."),
    "no_filters": ("InvalidParams", None, "Give a search text or at least one filter."),
    "additives_filter_needs_tag_search": ("InvalidParams", False, "Drop the text or the additive filter; additives combine with facets only."),
    "page_out_of_range": ("InvalidParams", False, "Ask for a page within the window, or narrow the search."),
    "invalid_input": ("InvalidParams", False, "Correct the request."),
    "upstream_error": ("ServiceUnavailable", True, "Try again later."),
    "upstream_timeout": ("Timeout", True, "Try again, or narrow the request."),
    "upstream_rejected": ("InvalidParams", False, "Change the request; it would be refused again."),
    "rate_limited": ("RateLimited", True, "Wait for the stated number of seconds."),
}


class CatalogError(Exception):
    """A declared failure."""

    def __init__(self, reason: str, message: str, **data: object):
        super().__init__(message)
        self.reason, self.message, self.data = reason, message, data
        self.code, self.retryable, self.recovery = CONTRACT[reason]

    def to_dict(self) -> dict:
        out = {"reason": self.reason, "code": self.code, "message": self.message, "recovery": {"hint": self.recovery}, **self.data}
        return out if self.retryable is None else out | {"retryable": self.retryable}


def is_html(body: str) -> bool:
    """Whether a body is a rendered page, wherever in it the page begins."""
    return re.search(HTML, body) is not None


def detail_of(body: str | None) -> str | None:
    """What a refusing source says for itself: its ``detail``, a note for a rendered page, or the first 200 characters."""
    if not isinstance(body, str) or not body.strip():
        return None
    try:
        parsed = json.loads(body)
        if isinstance(parsed, dict) and isinstance(parsed.get("detail"), str):
            return parsed["detail"]
    except ValueError:
        pass
    return "a rendered page was served in place of data" if is_html(body) else body[:200]


def reason_of(status: int | None, timed_out: bool = False) -> str:
    """The reason for a failed read, from its status alone and never from its message."""
    if timed_out or status in (408, 504):
        return "upstream_timeout"
    if status == 429:
        return "rate_limited"
    if status is None or status >= 500:
        return "upstream_error"
    return "upstream_rejected"


def failure(key: str, error: BaseException) -> dict[str, str]:
    """A batch's entry for a key whose source could not be read."""
    if isinstance(error, CatalogError):
        message = error.message if re.search(r"[.!?]$", error.message) else error.message + "."
        return {"barcode": key, "reason": error.reason, "error": f"{message} {error.recovery}"}
    return {"barcode": key, "reason": "upstream_error", "error": str(error)}
