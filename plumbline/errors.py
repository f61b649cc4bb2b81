"""Everything that the engine refuses, one class for each reason."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all refusals."""


def _kinds(*names: str) -> None:
    for name in names:
        globals()[name] = type(name, (EngineError,), {"__doc__": f"Refusal: {name}."})


_kinds(
    "SyntaxFault", "StatementTooLong", "InvalidIdentifier", "UnknownTable", "UnknownColumn", "AmbiguousColumn", "DuplicateAlias", "DuplicateName", "TypeMismatch", "NullComparison", "ParameterCount", "InvalidTimestamp", "LimitExceeded", "JoinDepthExceeded", "UnindexedJoin", "ScanBudgetExceeded", "SortBufferExceeded", "InvalidJoin", "InvalidView", "DependencyConflict", "ReadOnlyView", "NotNullViolation", "DuplicateKey", "UniqueViolation", "ReferenceViolation", "LinkViolation", "ImmutableKey", "ArityMismatch", "TextTooLong", "RowTooLarge", "InvalidDefault", "InvalidExpand", "UnknownDomain", "DomainDeleting", "InvalidDomain", "KeyTooLong", "ValueTooLarge", "UnknownIndex", "InvalidIndexField", "EmptyFilter", "VersionConflict", "InvalidDocument", "ArchiveCorrupt", "AlreadyExists", "RateLimited", "Forbidden", "SequenceExhausted", "ReindexRunning", "BackupRunning", "NoSharedFolder",
)
