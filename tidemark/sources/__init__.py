from tidemark.sources.conform import PROBLEMS, Conformed, conform
from tidemark.sources.documents import SchemaDocumentError, to_document, to_struct
from tidemark.sources.lakehouse import (
    Appended,
    ConcurrentChange,
    Lakehouse,
    RejectedRows,
    SnapshotNotFound,
    TableNotFound,
    TableState,
)

__all__ = [
    "PROBLEMS",
    "Appended",
    "ConcurrentChange",
    "Conformed",
    "Lakehouse",
    "RejectedRows",
    "SchemaDocumentError",
    "SnapshotNotFound",
    "TableNotFound",
    "TableState",
    "conform",
    "to_document",
    "to_struct",
]
