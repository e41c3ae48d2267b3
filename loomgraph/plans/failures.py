"""Checking the arguments of a tool, and the one shape that failures have."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

INVALID, MISSING, INTERNAL = "invalid_parameter", "missing_parameter", "internal_error"
FIX_CALL, RETRY = "fix_call", "retry"


@dataclass(frozen=True)
class Failure(Exception):
    """A call that can't be answered: what is wrong, with which parameter, and what would be valid."""

    code: str
    message: str
    hint: str
    parameter: str | None = None
    valid: tuple[str, ...] = ()

    def payload(self) -> str:
        out: dict[str, Any] = {"status": "error", "code": self.code, "message": self.message, "hint": self.hint}
        if self.code == INVALID:
            out["invalid_parameter"] = self.parameter
        if self.code == MISSING:
            out["missing_parameter"] = self.parameter
        if self.code in (INVALID, MISSING):
            out["valid_parameters"] = list(self.valid)
        return json.dumps(out, ensure_ascii=False)


def invalid(parameter: str | None, valid, message: str) -> Failure:
    return Failure(INVALID, message, FIX_CALL, parameter, tuple(valid))


def missing(parameter: str, valid, message: str) -> Failure:
    return Failure(MISSING, message, FIX_CALL, parameter, tuple(valid))


def internal() -> Failure:
    """Says nothing about the cause, which belongs in the log."""
    return Failure(INTERNAL, "The query failed inside the engine; the log has the details.", RETRY)


def is_failure(text: str) -> bool:
    """Whether a result is a failure payload; texts of results never are."""
    try:
        found = json.loads(text)
    except ValueError:
        return False
    return isinstance(found, dict) and found.get("status") == "error" and "code" in found


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    required: bool = False
    default: Any = None


def check(parameters: tuple[Parameter, ...], arguments: dict[str, Any]) -> dict[str, Any]:
    """The arguments with defaults, or a Failure: unknown names, wrong types, required ones that are missing, null or blank."""
    names = tuple(p.name for p in parameters)
    for name in arguments:
        if name not in names:
            raise invalid(name, names, f"Unknown parameter '{name}'. Valid parameters: {', '.join(names) or 'none'}.")
    out = {}
    for p in parameters:
        value = arguments.get(p.name)
        if value is None:
            if p.required:
                raise missing(p.name, names, f"Parameter '{p.name}' is required.")
            out[p.name] = p.default
            continue
        right = isinstance(value, p.kind) and not (p.kind is int and isinstance(value, bool))
        if not right:
            raise invalid(p.name, names, f"Parameter '{p.name}' must be of type {'string' if p.kind is str else 'integer'}.")
        if p.required and isinstance(value, str) and not value.strip():
            raise missing(p.name, names, f"Parameter '{p.name}' must not be blank.")
        out[p.name] = value
    return out
