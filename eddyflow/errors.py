"""Errors with stable codes, by area."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine; ``code`` is stable."""

    code = "EF-0000"

    def __init__(self, message: str):
        super().__init__(f"[{self.code}] {message}")


class ConfigError(EngineError):
    code = "EF-1000"


class SqlError(EngineError):
    code = "EF-2000"


class CatalogError(EngineError):
    code = "EF-2100"


class WindowError(EngineError):
    code = "EF-3000"


class JoinError(EngineError):
    code = "EF-4000"


class ChangelogError(EngineError):
    code = "EF-5000"


class SchemaError(EngineError):
    code = "EF-6000"


class ConnectorError(EngineError):
    code = "EF-7000"


class StreamError(EngineError):
    code = "EF-8000"
