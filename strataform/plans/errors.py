"""Errors that carry a stable code."""

from __future__ import annotations


class EngineError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def invalid_query(message: str) -> EngineError:
    return EngineError("INVALID_QUERY", message)


def unsupported(message: str) -> EngineError:
    return EngineError("UNSUPPORTED_SCHEMA", message)
