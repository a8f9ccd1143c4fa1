"""Named errors, their exit codes and the JSON envelope."""

from __future__ import annotations

#: Exit codes by the kind's first part or whole name; fixed values.
CODES = {
    "usage": 1, "cli": 1, "config": 2, "index.schema_mismatch": 10, "index.unreadable": 10,
    "index.embed_model_mismatch": 11, "index.embed_dim_mismatch": 11, "config.model_backend_mismatch": 2, "index.missing": 12,
    "backend": 20, "backend.auth_failed": 21, "backend.rate_limited": 22, "parsing": 30, "io": 40, "io.oversize": 41, "unknown": 99,
}


class IndexError_(Exception):
    """An error of a known kind. ``detail`` is free and goes to the envelope."""

    def __init__(self, kind: str, message: str, **detail):
        super().__init__(message)
        self.kind, self.message, self.detail = kind, message, detail

    @property
    def code(self) -> int:
        return CODES.get(self.kind, CODES.get(self.kind.split(".")[0], 99))

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "kind": self.kind, "message": self.message, "detail": self.detail}}


def as_error(e: BaseException) -> IndexError_:
    return e if isinstance(e, IndexError_) else IndexError_("unknown", str(e) or type(e).__name__, type=type(e).__name__)
