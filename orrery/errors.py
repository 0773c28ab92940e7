"""Diagnostics: every public error has a stable code, a phase, and, where it comes from a text, a location."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Position:
    offset: int
    line: int
    column: int


@dataclass(frozen=True)
class Span:
    """A half-open stretch of a source text."""

    start: Position
    end: Position

    def to_dict(self) -> dict:
        return {k: vars(getattr(self, k)) for k in ("start", "end")}


class DiagnosticError(Exception):
    code = "error"
    phase = "runtime"
    retryable = False

    def __init__(self, message: str, code: str | None = None, span: Span | None = None, **details: Any) -> None:
        super().__init__(message)
        self.message = message
        self.code = code or type(self).code
        self.span = span
        self.details = details

    def at(self, span: Span | None) -> DiagnosticError:
        """The same error, located; a location that is known already stays."""
        self.span = self.span or span
        return self

    def to_dict(self) -> dict:
        out = {"error": type(self).__name__, "code": self.code, "message": self.message, "phase": self.phase, "retryable": self.retryable, "details": self.details}
        return out | ({"location": self.span.to_dict()} if self.span else {})


class QueryError(DiagnosticError):
    """Errors that a query's own data raise."""


class QLSyntaxError(DiagnosticError):
    code, phase = "syntax_error", "parse"


class TypeMismatchError(DiagnosticError):
    code, phase = "type_mismatch", "compile"


class SchemaError(DiagnosticError):
    code, phase = "invalid_schema", "compile"


class UnknownNameError(DiagnosticError):
    code, phase = "unknown_name", "plan"


class UnknownDatasetError(DiagnosticError):
    code, phase = "unknown_dataset", "plan"


class UnknownFieldError(DiagnosticError):
    code, phase = "unknown_field", "plan"


class PredicateError(DiagnosticError):
    code, phase = "invalid_operand", "plan"


class TraversalError(DiagnosticError):
    code, phase = "invalid_traversal", "plan"


class ConstraintError(DiagnosticError):
    code = "constraint"


class ReferenceError_(DiagnosticError):
    code = "missing_reference"


class FunctionError(DiagnosticError):
    code = "function_type"


class TransactionError(DiagnosticError):
    code = "transaction"


class StorageError(DiagnosticError):
    code = "storage_io"


class UnsupportedError(DiagnosticError):
    code, phase = "unsupported", "plan"


class PermissionDeniedError(DiagnosticError):
    code = "permission_denied"


class QueryTimeoutError(DiagnosticError):
    code, retryable = "timeout", True


class DeadlockError(DiagnosticError):
    code, retryable = "deadlock", True
