"""The extractor interface, its dispatch by extension, and the explosion of facts into tables."""

from __future__ import annotations

import bisect
import importlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestrata.functions.coordinates import Coordinates
from lodestrata.functions.ids import Descriptor, SymbolId, compose_symbol, digest_column, fact_id_column, number_occurrences, rebase, written
from lodestrata.runtime import tasks

_SPAN = "startLine: int, startChar: int, endLine: int, endChar: int"
#: Nested schema of one file's facts.
FACTS = (
    "module string, provider string, error string, "
    f"declarations array<struct<symbolId: string, name: string, kind: string, languageKind: string, visibility: string, exported: boolean, containerId: string, signature: string, {_SPAN}, "
    "nameLine: int, nameChar: int, nameEndLine: int, nameEndChar: int, mLines: int, mParameters: int, mNesting: int, mBranches: int>>, "
    f"references array<struct<name: string, role: string, status: string, targetId: string, candidates: array<string>, fromId: string, provenance: string, reason: string, {_SPAN}>>, "
    f"imports array<struct<specifier: string, reExport: boolean, name: string, localName: string, {_SPAN}>>, "
    f"literals array<struct<kind: string, value: string, number: double, containerId: string, {_SPAN}>>, "
    f"comments array<struct<raw: string, normalized: string, form: string, placement: string, anchorId: string, {_SPAN}>>, "
    f"docs array<struct<raw: string, normalized: string, fenced: boolean, anchorId: string, {_SPAN}>>, "
    f"notes array<struct<severity: string, message: string, path: string, {_SPAN}>>"
)
# Which extractor owns a file, by extension. Fixed values.
CLAIMS = {
    ".json": "json", ".jsonc": "json", ".jsonl": "json", ".ndjson": "json", ".yml": "yaml", ".yaml": "yaml", ".md": "markdown", ".mdc": "markdown", ".markdown": "markdown",
    ".py": "python", ".html": "html", ".htm": "html", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "typescript", ".jsx": "typescript",
    ".mjs": "typescript", ".cjs": "typescript", ".rs": "rust", ".kt": "kotlin", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".c": "c", ".h": "c", ".gd": "gdscript",
}
_MODULES = {"json": "data", "yaml": "data", "markdown": "prose", "html": "prose", "python": "python_"}


@dataclass
class Facts:
    """What an extractor gathers; positions are given as character offsets and become UTF-16 positions."""

    module: str
    language: str
    text: str
    declarations: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    literals: list[dict] = field(default_factory=list)
    comments: list[dict] = field(default_factory=list)
    docs: list[dict] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)
    error: str | None = None

    def __post_init__(self):
        self.at = Coordinates(self.text)
        self._astral = [i for i, c in enumerate(self.text) if c > "￿"] if len(self.at.units) > 2 * len(self.text) else None
        self._head: str | None = None

    def span(self, start: int, end: int) -> dict:
        """4 x span of a range of character offsets."""
        if self._astral:
            start, end = (i + bisect.bisect_left(self._astral, i) for i in (start, end))
        a, b = self.at.position(start) or (0, 0), self.at.position(end) or (0, 0)
        return {"startLine": a[0], "startChar": a[1], "endLine": b[0], "endChar": b[1]}

    def symbol(self, *descriptors: Descriptor) -> str:
        tail = written(descriptors)
        if self._head is None:
            self._head = compose_symbol(SymbolId(self.language, self.module))
        return self._head + tail

    def declare(self, path: tuple[Descriptor, ...], kind: str, start: int, end: int, name_start: int, name_end: int, container: str | None = None, **more) -> str:
        symbol = self.symbol(*path)
        name = self.span(name_start, name_end)
        self.declarations.append({
            "symbolId": symbol, "name": path[-1].name, "kind": kind, "languageKind": None, "visibility": "public", "exported": None, "containerId": container, "signature": None,
            **self.span(start, end), "nameLine": name["startLine"], "nameChar": name["startChar"], "nameEndLine": name["endLine"], "nameEndChar": name["endChar"],
            "mLines": None, "mParameters": None, "mNesting": None, "mBranches": None, **more,
        })
        return symbol

    def refer(self, name: str, role: str, start: int, end: int, target: str | None = None, origin: str | None = None, reason: str | None = None, candidates: list[str] | None = None, status: str | None = None) -> None:
        status = status or ("bound" if target else "ambiguous" if candidates else "unbound")
        self.references.append({"name": name, "role": role, "status": status, "targetId": target, "candidates": candidates, "fromId": origin,
                                "provenance": "bound" if target else None, "reason": None if target else reason or "NotIndexed", **self.span(start, end)})

    def literal(self, value, start: int, end: int, container: str | None = None) -> None:
        kind = "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        text = ("true" if value else "false") if kind == "boolean" else str(int(value)) if kind == "number" and float(value).is_integer() and abs(value) < 1e16 else str(value)
        self.literals.append({"kind": kind, "value": text, "number": float(value) if kind == "number" else None, "containerId": container, **self.span(start, end)})

    def note(self, message: str, severity: str = "info", start: int | None = None, end: int | None = None) -> None:
        span = self.span(start, end or start) if start is not None else dict.fromkeys(("startLine", "startChar", "endLine", "endChar"))
        self.notes.append({"severity": severity, "message": message, "path": None, **span})

    def numbered(self) -> None:
        """Occurrences for name paths that are declared again; what hangs on a renamed declaration follows it."""
        rows = [{"symbolId": d["symbolId"], "start": (d["startLine"], d["startChar"]), "end": (d["endLine"], d["endChar"])} for d in self.declarations]
        final = number_occurrences(rows)
        moved = [(rows[i]["symbolId"], to, rows[i]["start"], rows[i]["end"]) for i, to in final.items() if to != rows[i]["symbolId"]]
        for i, d in enumerate(self.declarations):
            d["symbolId"] = final[i]
        if not moved:
            return

        def place(row: dict, column: str) -> None:
            if row.get(column) is None:
                return
            at = (row["startLine"], row["startChar"])
            for old, new, start, end in reversed(moved):
                if start <= at <= end and (to := rebase(row[column], old, new)) and (row is None or row.get("symbolId") != new):
                    row[column] = to
                    return

        for rows_, column in ((self.declarations, "containerId"), (self.references, "fromId"), (self.literals, "containerId"), (self.docs, "anchorId")):
            for r in rows_:
                place(r, column)


def parse_file(module: str, text: str, depth: str = "full") -> Facts | None:
    """The facts of one file, or None if no extractor owns it; a syntax error is stated in ``error``."""
    from lodestrata.sources.extract.attach import attach_comments

    name = module.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    provider = CLAIMS.get(name[dot:].lower()) if dot > 0 else "gdscript" if name == "project.godot" else None
    if provider is None:
        return None
    facts = Facts(module, provider, text)
    try:
        importlib.import_module(f"lodestrata.sources.extract.{_MODULES.get(provider, 'code')}").parse(facts)
    except (SyntaxError, ValueError, RecursionError) as e:
        failed = Facts(module, provider, text)
        failed.error = f"{type(e).__name__}: {e}"[:500]
        return failed
    facts.numbered()
    facts.comments = attach_comments(facts)
    if depth == "outline":
        facts.references, facts.literals, facts.comments = [], [], []
    return facts


_COLUMNS = ["declarations", "references", "imports", "literals", "comments", "docs", "notes"]


#: Files whose facts go back to the JVM in one batch.
_FILES = 500


def extract(files: DataFrame, depth: str = "full", only: tuple[str, ...] = tuple(_COLUMNS)) -> DataFrame:
    """files (module, text) -> one row of nested facts for each file that an extractor owns, with the kinds in ``only``.

    Parsing costs far more than reading, and a table of small texts is read by one task or a few, so the files are dealt
    out to all cores first.
    """
    every = StructType.fromDDL(FACTS)
    schema = StructType([every[c] for c in ("module", "provider", "error", *only)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, _FILES):
                b = whole.slice(at, _FILES)
                found = [parse_file(module, text or "", depth) for module, text in zip(b["module"].to_pylist(), b["text"].to_pylist()) if module]
                found = [f for f in found if f is not None]
                rows = ([f.module for f in found], [f.language for f in found], [f.error for f in found], *([getattr(f, c) for f in found] for c in only))
                yield pa.RecordBatch.from_arrays([pa.array(r, type=t) for r, t in zip(rows, arrow.types)], schema=arrow)

    return files.select("module", "text").repartition(tasks(files.sparkSession)).mapInArrow(run, schema)


def explode_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """The nested rows as fact tables with fact ids, parse failures and notes."""
    good = facts.filter("error is null")
    span = ["startLine", "startChar", "endLine", "endChar"]
    each = lambda c: good.select("module", F.explode(c).alias("x")).select("module", "x.*")
    with_id = lambda df, kind, *fields: df.select(fact_id_column(kind, "module", *fields).alias("factId"), "*")
    declarations = each("declarations")
    own = [c for c in declarations.columns if c != "module"]
    references = each("references").withColumn("_c", F.array_join("candidates", ","))
    comments, docs = each("comments"), each("docs")
    notes = good.select("module", F.posexplode("notes").alias("ordinal", "x")).select("module", "ordinal", "x.*")
    return {
        "symbols": with_id(declarations, "declaration", *own),
        "refs": with_id(references, "reference", "name", "role", "status", "targetId", "_c", "provenance", "reason", "fromId", *span).drop("_c"),
        "imports": with_id(each("imports"), "import", "specifier", "name", "localName", "reExport", *span),
        "literals": with_id(each("literals"), "literal", "kind", "value", "containerId", *span),
        "comments": with_id(comments, "comment", "raw", *span),
        "docs": with_id(docs, "doc", "raw", "fenced", *span),
        "notes": notes,
        "parse_failures": facts.filter("error is not null").select("module", F.col("error").alias("reason")),
    }


def declaration_digest(*columns: str) -> F.Column:
    return digest_column(*columns)
