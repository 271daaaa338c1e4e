"""Typed errors of the driver side; inside jobs the same kinds are values of an ``error_kind`` column."""

from __future__ import annotations


class GroundcheckError(Exception):
    """Root of all errors; ``context`` carries what is known about the case."""

    def __init__(self, message: str, **context: object):
        super().__init__(message)
        self.context = context


class ConfigurationError(GroundcheckError): ...


class ExtractionError(GroundcheckError): ...


class FetchError(GroundcheckError): ...


class DeadReferenceError(FetchError): ...


class InaccessibleReferenceError(FetchError): ...


class LLMError(GroundcheckError): ...


class LLMParseError(LLMError):
    """The reply is not the declared object; the raw reply is kept."""

    def __init__(self, message: str, raw: str = ""):
        super().__init__(message, raw=raw)
        self.raw = raw


class LLMProviderError(LLMError): ...
