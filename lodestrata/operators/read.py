"""Reads over the fact tables: names, literals, comments, documents, imports, totals.

Every function takes DataFrames with the columns of ``lodestrata.schema`` and returns one, with a total order wherever a
limit applies.  Filters and column choices stay declarative, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.search import check_term, pattern_matches, text_filter
from lodestrata.functions.text import mentions

PLACE = ("module", "startLine", "startChar", "factId")


def summary(symbols: DataFrame) -> DataFrame:
    """What a list shows of a declaration; absent stays null."""
    return symbols.select("symbolId", "name", "kind", "module", "visibility", "exported", "signature", "containerId", "startLine", "startChar")


def find_by_name(symbols: DataFrame, name: str, module: str | None = None) -> DataFrame:
    """Exact name, optionally in one module."""
    found = symbols.filter(F.col("name") == name)
    return found.filter(F.col("module") == module) if module is not None else found


def search_symbols(symbols: DataFrame, term: str | None = None, pattern: str | None = None, kind: str | None = None, module: str | None = None) -> DataFrame:
    """Names holding a term (ASCII case ignored, no wildcards) or matching ``/pattern/flags``."""
    found = symbols.filter(text_filter("name", term, pattern))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    return found.filter(mentions("module", check_term(module))) if module is not None else found


def literals(table: DataFrame, value: str | None = None, low: float | None = None, high: float | None = None, pattern: str | None = None) -> DataFrame:
    """Exact value, else a numeric range (both ends in), else a pattern; none of them is refused."""
    if value is not None:
        return table.filter(F.col("value") == value)
    if low is not None or high is not None:
        number = F.col("number")
        return table.filter(number.isNotNull() & (number >= F.lit(float("-inf") if low is None else float(low))) & (number <= F.lit(float("inf") if high is None else float(high))))
    if pattern is not None:
        return table.filter(pattern_matches("value", pattern))
    raise ValueError("give a value, a range or a pattern")


def comment_filter(form: str | None = None, module: str | None = None, term: str | None = None, pattern: str | None = None) -> Column:
    """One condition for a page and for its count."""
    out = F.lit(True)
    if form is not None:
        out = out & (F.col("form") == form)
    if module is not None:
        out = out & mentions("module", check_term(module))
    return out & text_filter("normalized", term, pattern) if term is not None or pattern is not None else out


def doc_filter(fenced: bool | None = None, module: str | None = None, term: str | None = None, pattern: str | None = None) -> Column:
    """The same for document regions; ``fenced`` None means either."""
    out = F.lit(True)
    if fenced is not None:
        out = out & (F.col("fenced") == fenced)
    if module is not None:
        out = out & mentions("module", check_term(module))
    return out & text_filter("normalized", term, pattern) if term is not None or pattern is not None else out


def with_anchor(comments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each comment or region with the declaration it belongs to, if any."""
    anchor = symbols.select(F.col("symbolId").alias("anchorId"), F.col("name").alias("anchorName"), F.col("kind").alias("anchorKind"))
    return comments.join(anchor, "anchorId", "left")


def find_imports(imports: DataFrame, specifier: str | None = None, pattern: str | None = None, module: str | None = None, module_pattern: str | None = None) -> DataFrame:
    """Exactly one way of asking: specifier or importing module, as a term or as a pattern."""
    asked = [(c, t, p) for c, t, p in (("specifier", specifier, None), ("specifier", None, pattern), ("module", module, None), ("module", None, module_pattern)) if t is not None or p is not None]
    if len(asked) != 1:
        raise ValueError("give exactly one of specifier, pattern, module and module_pattern")
    column, term, regex = asked[0]
    return imports.filter(text_filter(column, term, regex))


def imports_binding(imports: DataFrame, local: str) -> DataFrame:
    """Imports that bring ``local`` into scope, under its own or another name."""
    return imports.filter(F.coalesce("localName", "name") == local)


def spelled_elsewhere(refs: DataFrame, name: str, target: str) -> DataFrame:
    """References spelled ``name`` that are not known to mean ``target``."""
    return refs.filter((F.col("name") == name) & ~F.col("targetId").eqNullSafe(F.lit(target)))


def is_resolved(status: Column | str = "status") -> Column:
    """P14."""
    c = status if isinstance(status, Column) else F.col(status)
    return c.isin("bound", "known", "inferred")


def reason_of(status: str = "status", reason: str = "reason") -> Column:
    """Why a binding isn't resolved; null if it is."""
    return F.when(F.col(status) == "ambiguous", "Ambiguous").when(~is_resolved(status), F.col(reason))


def is_dangling(reason: str = "reason") -> Column:
    """Unresolved for a reason that a rename or move would have to answer for."""
    return F.col(reason).isNotNull() & ~F.col(reason).isin("ExternalDependency", "NotIndexed", "DynamicallyTyped")


def references_to(refs: DataFrame, target: str) -> DataFrame:
    """S13."""
    return refs.filter(F.col("targetId") == target)


def members_of(symbols: DataFrame, container: DataFrame | str) -> DataFrame:
    """Direct members of one declaration, or of each of a table with ``symbolId``."""
    if isinstance(container, str):
        return symbols.filter(F.col("containerId") == container)
    return symbols.join(container.select(F.col("symbolId").alias("containerId")).distinct(), "containerId", "left_semi")


def outline(symbols: DataFrame, module: str) -> DataFrame:
    return summary(symbols.filter(F.col("module") == module)).orderBy("startLine", "startChar", "symbolId")


def describe(symbols: DataFrame, refs: DataFrame, comments: DataFrame, docs: DataFrame, symbol: str) -> DataFrame:
    """One row: the declaration, its leading comment, prose under it (headings), member count and reference count."""
    at = lambda t, c: t.filter(F.col(c) == symbol)
    lead = at(comments, "anchorId").filter("form = 'leading'").agg(F.min_by("normalized", F.struct("startLine", "startChar")).alias("documentation"))
    prose = at(docs, "anchorId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("startLine", "startChar", "normalized"))), lambda x: x["normalized"]), "\n").alias("prose"))
    counts = at(symbols, "containerId").agg(F.count("*").alias("members")), at(refs, "targetId").agg(F.count("*").alias("referenceCount"))
    one = summary(at(symbols, "symbolId"))
    for part in (lead, prose, *counts):  # one row each
        one = one.crossJoin(F.broadcast(part))
    return one


# ---- aggregates ------------------------------------------------------------------------------------------------------


def shared_literals(table: DataFrame, least_files: int = 2, limit: int = 50) -> DataFrame:
    """A2: values that several modules spell out."""
    found = table.groupBy("value", "kind").agg(F.count_distinct("module").alias("files"), F.count("*").alias("uses"))
    return found.filter(F.col("files") >= least_files).orderBy(F.desc("files"), F.desc("uses"), "value", "kind").limit(limit)


def totals(**tables: DataFrame) -> DataFrame:
    """A3: (what, n) a table."""
    out = None
    for what, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    """A4."""
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def content_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A5: files and symbols by content class, an unrecorded class counting as ``unknown``."""
    per = symbols.groupBy("module").agg(F.count("*").alias("n"))
    return (
        files.join(per, "module", "left").groupBy(F.coalesce("content", F.lit("unknown")).alias("content"))
        .agg(F.count_distinct("module").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))
    )


def depth_totals(files: DataFrame) -> DataFrame:
    """A6."""
    return files.groupBy("depth").agg(F.count("*").alias("n"))


def module_summary(symbols: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Modules by how much they declare."""
    per = files.select("module", "content").join(symbols.groupBy("module").agg(F.count("*").alias("symbols")), "module", "left")
    ranked = per.select("module", "content", F.coalesce("symbols", F.lit(0)).alias("symbols")).orderBy(F.desc("symbols"), "module")
    return ranked.limit(limit) if limit else ranked


def note_totals(notes: DataFrame) -> DataFrame:
    """A10."""
    return notes.agg(F.count_distinct("module").alias("modules"), F.count("*").alias("notes"))


def comment_forms(comments: DataFrame) -> DataFrame:
    """A11."""
    return comments.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("anchorId").isNotNull()).alias("anchored"))


def scan_breakdown(seen: DataFrame) -> DataFrame:
    """``seen`` has denied, generated and owners (int) a tracked file; the four parts add up to tracked."""
    part = F.when(F.col("denied"), "denied").when(F.col("generated"), "generated").when(F.col("owners") == 1, "claimed").otherwise("unclaimed")
    return seen.withColumn("part", part).agg(F.count("*").alias("tracked"), *(F.count_if(F.col("part") == p).alias(p) for p in ("claimed", "unclaimed", "generated", "denied")))


def overview(files: DataFrame, symbols: DataFrame, refs: DataFrame, literal_table: DataFrame, comments: DataFrame) -> DataFrame:
    """One row of totals."""
    parts = [
        files.agg(F.count("*").alias("files"), F.count_if(F.col("content") == "code").alias("code"), F.count_if(F.col("content") == "document").alias("documents"), F.count_if(F.col("content").isNull()).alias("unrecorded")),
        symbols.agg(F.count("*").alias("symbols"), F.count_distinct("kind").alias("kinds")),
        refs.agg(F.count("*").alias("references"), F.count("targetId").alias("bound")),
        literal_table.agg(F.count("*").alias("literals")),
        comments.agg(F.count("*").alias("comments"), F.count("anchorId").alias("anchored")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(p))
    return out


# ---- window-shaped -----------------------------------------------------------------------------------------------------


def occurrence_numbers(rows: DataFrame, path: list[str], order: list) -> DataFrame:
    """1 for the first of a repeated name path, 2 for the next, in source order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*path).orderBy(*order)))


def line_runs(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Maximal runs of consecutive distinct lines by key: first, last and number of lines."""
    group = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    runs = rows.select(*keys, line).distinct().withColumn("_run", group)
    return runs.groupBy(*keys, "_run").agg(F.min(line).alias("firstLine"), F.max(line).alias("lastLine"), F.count("*").alias("lines")).drop("_run")


def per_kind_cap(rows: DataFrame, kind: str, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each kind, and whether the kind had more."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("_rank") <= cap + 1)
    cut = ranked.withColumn("truncated", F.max("_rank").over(Window.partitionBy(kind)) > cap)
    return cut.filter(F.col("_rank") <= cap).drop("_rank")


def by_module(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered by module, in the order of ``columns``."""
    return rows.groupBy("module").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


#: Lines of a bin: interval joins meet by (module, bin), so a large module is not one group of points times spans.
BIN = 1024


def bins(first: str, last: str) -> Column:
    """The bins that a range of lines touches."""
    at = lambda c: F.floor(F.col(c) / BIN)
    return F.when(F.col(first) <= F.col(last), F.sequence(at(first), at(last)))


def innermost(points: DataFrame, spans: DataFrame, key: str = "module") -> DataFrame:
    """The tightest span that holds a position: points (id, key, line, char), spans (symbolId, key, 4 x span)."""
    at, start, end = F.struct("line", "char"), F.struct("startLine", "startChar"), F.struct("endLine", "endChar")
    held = points.withColumn("_bin", F.floor(F.col("line") / BIN)).join(spans.withColumn("_bin", F.explode(bins("startLine", "endLine"))), [key, "_bin"]).filter((start <= at) & (at <= end))
    tight = F.struct("startLine", "startChar", (-F.col("endLine")).alias("x"), (-F.col("endChar")).alias("y"), "symbolId")
    return held.groupBy("id").agg(F.max_by("symbolId", tight).alias("symbolId"))


def union_projects(**lakes: DataFrame) -> DataFrame:
    """The same query over several projects, with the project's name."""
    out = None
    for name, df in lakes.items():
        one = df.withColumn("project", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
