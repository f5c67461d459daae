"""Coded errors of the engine and their HTTP form."""

from __future__ import annotations

from typing import Any

# Error codes and the HTTP status of each.
STATUS = {
    "CONFIG": 400,
    "NOT_INITIALIZED": 400,
    "NOT_FOUND": 404,
    "INVALID_OPERATION": 400,
    "INVALID_IDENTIFIER": 400,
    "INVALID_JSON": 400,
    "INVALID_PLAN": 400,
    "INVALID_SQL": 400,
    "STALE_PLAN": 409,
    "DEPENDENCY_CONFLICT": 409,
    "APPLY_FAILED": 500,
    "FK_VIOLATION": 500,
    "INTEGRITY_ERROR": 500,
    "UNSUPPORTED": 400,
    "NO_PRIMARY_KEY": 400,
    "REVERT_FAILED": 500,
    "NOT_REVERTIBLE": 400,
    "ALREADY_REVERTED": 409,
    "SNAPSHOT_FAILED": 500,
    "RECOVER_FAILED": 500,
    "SYNC_NOT_CONFIGURED": 400,
    "SYNC_NON_FAST_FORWARD": 409,
    "SYNC_DIVERGED": 409,
    "IMMUTABLE_MIGRATION_EDITED": 409,
    "SYNC_AUTH_FAILED": 400,
    "SYNC_UNREACHABLE": 500,
    "INTERNAL": 500,
}


class EngineError(Exception):
    def __init__(self, code: str, message: str, detail: Any = None):
        assert code in STATUS, code
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.detail = code, message, detail

    def to_json(self) -> dict:
        out = {"code": self.code, "message": self.message}
        return out if self.detail is None else out | {"detail": self.detail}

    def problem(self, instance: str) -> dict:
        """RFC 9457 problem details."""
        out = {"type": f"urn:stratum:error:{self.code.lower()}", "title": self.code, "status": STATUS[self.code], "detail": self.message, "instance": instance, "code": self.code}
        return out if self.detail is None else out | {"details": self.detail}
