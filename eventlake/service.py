"""Decisions of a thin HTTP layer: content negotiation, admission, errors, health."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

SUPPORTED = ("application/json", "application/vnd.apache.arrow.stream")


class NotAcceptable(ValueError):
    pass


def negotiate(accept: str | None) -> str:
    """The first supported type by descending q, ties in the header's order; */* and nothing mean JSON."""
    if not (accept or "").strip():
        return SUPPORTED[0]
    ranked = []
    for part in accept.split(","):
        kind, *params = (p.strip().lower() for p in part.split(";"))
        q = 1.0
        for p in params:
            if p.startswith("q="):
                try:
                    q = float(p[2:])
                except ValueError:
                    q = 0.0
        if kind and q > 0:
            ranked.append((kind, q))
    for kind, _ in sorted(ranked, key=lambda r: -r[1]):
        if kind in ("*/*", "application/*"):
            return SUPPORTED[0]
        if kind in SUPPORTED:
            return kind
    raise NotAcceptable(accept)


@dataclass
class Gate:
    """Refuses writes beyond a number or a byte total in flight; asked before a body is parsed."""

    # Fixed values.
    most_writes: int = 10_000
    most_bytes: int = 64 << 20
    writes: int = 0
    bytes: int = 0
    refused: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def enter(self, size: int) -> bool:
        with self._lock:
            if self.writes + 1 > self.most_writes or self.bytes + size > self.most_bytes:
                self.refused += 1
                return False
            self.writes, self.bytes = self.writes + 1, self.bytes + size
            return True

    def leave(self, size: int) -> None:
        with self._lock:
            self.writes, self.bytes = self.writes - 1, self.bytes - size

    def ready(self, hot_ok: bool = True) -> bool:
        return hot_ok and self.bytes < 0.9 * self.most_bytes


class Overloaded(RuntimeError):
    pass


# Which status and code an error becomes.
ERRORS = {
    "NoSuchNamespace": (404, "NoSuchNamespaceException"), "NoSuchTable": (404, "NoSuchTableException"), "Overloaded": (503, "SERVER_OVERLOADED"), "ValueError": (400, "BAD_REQUEST"),
    "Conflict": (409, "COMPACTION_CONFLICT"), "NotAcceptable": (406, "NOT_ACCEPTABLE"),
}


def error_response(error: Exception) -> tuple[int, dict]:
    status, code = ERRORS.get(type(error).__name__, (500, "STORAGE_ERROR"))
    return status, {"error": str(error), "code": code}
