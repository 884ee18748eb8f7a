"""Errors with a code, an exit status and a hint."""

from __future__ import annotations

EXIT_STATUS = {
    "INVALID_ARGS": 2, "RESOLUTION_FAILED": 3, "INDEX_UNREADABLE": 4, "REF_NOT_FOUND": 5, "SCHEMA_MISMATCH": 6, "INTERNAL_ERROR": 7,
    "DISCOVERY_FAILED": 8, "AMBIGUOUS_MATCH": 9, "FETCH_BLOCKED": 10, "FETCH_RATE_LIMITED": 11, "POLICY_VIOLATION": 12,
}


class EngineError(Exception):
    def __init__(self, code: str, message: str, hint: str = ""):
        super().__init__(message)
        self.code, self.message, self.hint = code, message, hint

    @property
    def exit_status(self) -> int:
        return EXIT_STATUS.get(self.code, EXIT_STATUS["INTERNAL_ERROR"])

    def envelope(self) -> dict:
        return {"ok": False, "error": {"code": self.code, "message": self.message, "hint": self.hint}}
