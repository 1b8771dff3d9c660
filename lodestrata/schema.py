"""The fact tables: names, columns, keys and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations. Fixed values.
SYMBOL_KINDS = ("file", "module", "namespace", "package", "class", "method", "property", "field", "constructor", "enum", "interface", "function", "variable", "constant", "struct", "event", "operator", "typeParameter", "heading")
VISIBILITIES = ("public", "protected", "private", "internal", "fileLocal", "local")
ROLES = ("call", "read", "write", "import", "export", "extends", "implements", "instantiate", "typeUse")
UNKNOWN_REASONS = ("NotImplemented", "DynamicallyTyped", "ExternalDependency", "ParseError", "RecursionLimit", "Ambiguous", "RuntimeConstructed", "NotIndexed")
PROVENANCES = ("bound", "declared", "inferred", "nameMatched", "asserted")
DEPTHS = ("full", "surface", "outline")
CONTENTS = ("code", "data", "document")
COMMENT_FORMS = ("leading", "trailing", "inline", "standalone")
PLACEMENTS = ("above", "after", "before", "inside")
LITERAL_KINDS = ("string", "number", "boolean")
QUESTIONS = ("describe", "why", "relate", "contract", "effects", "usage")
FACT_KINDS = ("declaration", "reference", "import", "literal", "comment", "doc", "answer", "doubt")
BINDING_STATUSES = ("bound", "ambiguous", "unbound")

SPAN = ["startLine int", "startChar int", "endLine int", "endChar int"]


# Columns of each table. Fixed values.
_TABLES = {
    "meta": ["key string", "value string"],
    "files": ["module string", "contentHash string", "indexedAt bigint", "depth string", "content string"],
    "parse_failures": ["module string", "reason string", "failedAt bigint"],
    "notes": ["module string", "ordinal int", "severity string", "message string", "path string", *SPAN],
    "symbols": [
        "symbolId string", "factId string", "module string", "name string", "kind string", "languageKind string", "visibility string", "exported boolean",
        "containerId string", "signature string", *SPAN, "nameLine int", "nameChar int", "nameEndLine int", "nameEndChar int", "mLines int",
        "mParameters int", "mNesting int", "mBranches int",
    ],
    "refs": [
        "factId string", "module string", "name string", "role string", "status string", "targetId string", "candidates array<string>", "fromId string",
        "provenance string", "reason string", *SPAN,
    ],
    "imports": [
        "factId string", "module string", "specifier string", "reExport boolean", "name string", *SPAN, "localName string",
        "localStartLine int", "localStartChar int", "localEndLine int", "localEndChar int",
    ],
    "literals": ["factId string", "module string", "kind string", "value string", "number double", "containerId string", *SPAN],
    "comments": ["factId string", "module string", "raw string", "normalized string", "form string", "placement string", "anchorId string", *SPAN],
    "docs": ["factId string", "module string", "raw string", "normalized string", "fenced boolean", "anchorId string", *SPAN],
    "answers": [
        "symbolId string", "question string", "factId string", "prose string", "citations array<string>", "thin boolean", "model string", "createdAt bigint",
        "doubtId string", "doubtReason string", "doubtAt bigint", "doubtBy string",
    ],
    "gaps": ["symbolId string", "question string", "askCount bigint", "lastAsked bigint"],
    "refactor_transactions": ["id string", "state string", "startedAt bigint"],
    "refactor_steps": ["transactionId string", "stepNo int", "kind string", "phase string", "plan string", "createdAt bigint"],
    "refactor_blobs": ["hash string", "bytes binary"],
    "refactor_images": [
        "transactionId string", "scope string", "stepNo int", "module string", "existedBefore boolean", "beforeHash string", "existsAfter boolean", "afterHash string",
    ],
    "refactor_issues": ["transactionId string", "stepNo int", "kind string", "detail string", "module string", "line int"],
}

#: Rewritten together whenever a module is.
FACT_TABLES = ("refs", "symbols", "imports", "literals", "comments", "docs", "notes")
#: Written by people or agents; a rebuild of the facts keeps them.
KNOWLEDGE_TABLES = ("answers", "gaps", "refactor_transactions", "refactor_steps", "refactor_blobs", "refactor_images", "refactor_issues")
KEYS = {
    "meta": ["key"], "files": ["module"], "parse_failures": ["module"], "notes": ["module", "ordinal"], "symbols": ["symbolId"], "answers": ["symbolId", "question"],
    "gaps": ["symbolId", "question"], "refactor_transactions": ["id"], "refactor_steps": ["transactionId", "stepNo"], "refactor_blobs": ["hash"],
    "refactor_images": ["transactionId", "scope", "stepNo", "module"],
}


def ddl(table: str) -> str:
    return ", ".join(_TABLES[table])


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(ddl(table))


TABLES = list(_TABLES)
