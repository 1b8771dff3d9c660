"""Import resolution and binding across files, as joins.

A specifier becomes an ordered list of candidate paths; the first that is a known module wins.  Distinct (module,
specifier) pairs are resolved once and joined back.  Names that a file imports are then bound to the declarations of the
resolved module: one bound, several ambiguous, none left unbound with its reason.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestrata.operators.ingest import extension_of, resolve_candidates

# Suffixes that a specifier may leave out, by language. Fixed values.
_TS = (".ts", ".tsx", ".d.ts", ".mts", ".js", ".jsx", ".mjs", ".json", "/index.ts", "/index.tsx", "/index.js")
_TS_SWAPS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",)}
_SELF = ("crate", "self", "super")


def candidates(module: str, specifier: str) -> list[str]:
    """Paths that ``specifier`` may mean in ``module``, likeliest first; none for what can't be a path here."""
    here, dot = posixpath.dirname(module), posixpath.splitext(module)[1].lower()
    join = lambda *p: posixpath.normpath(posixpath.join(*p))
    out: list[str] = []
    if dot == ".py":
        level = len(specifier) - len(specifier.lstrip("."))
        tail = specifier[level:].replace(".", "/")
        base = here
        for _ in range(level - 1):
            base = posixpath.dirname(base)
        roots = [base] if level else ["", here, "src"]
        for r in roots:
            at = posixpath.join(r, tail) if tail else r
            out += [f"{at}.py", f"{at}/__init__.py"] if tail else [posixpath.join(at, "__init__.py")]
    elif dot in (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"):
        if specifier.startswith("."):
            at = join(here, specifier)
            stem, ext = posixpath.splitext(at)
            out = [at, *(stem + s for s in _TS_SWAPS.get(ext, ())), *(at + s for s in _TS)]
    elif dot == ".rs":
        parts = [p for p in specifier.split("::") if p]
        if parts and parts[0] in _SELF:
            root = here.split("/src")[0] + "/src" if "/src" in here else "src" if here.startswith("src") else here
            base = {"crate": root, "self": here, "super": posixpath.dirname(here)}[parts[0]]
            for n in range(len(parts), 1, -1):  # the longest module path first
                at = posixpath.join(base, *parts[1:n])
                out += [f"{at}.rs", f"{at}/mod.rs"]
    elif dot in (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"):
        out = [join(here, specifier), specifier, join("include", specifier), join("src", specifier)]
    elif dot in (".gd", ".godot"):
        out = [specifier.removeprefix("res://")] if specifier.startswith("res://") else [join(here, specifier)]
    elif dot in (".html", ".htm", ".md", ".markdown"):
        path = specifier.split("#")[0].split("?")[0]
        out = [path.lstrip("/") if path.startswith("/") else join(here, path)] if path and "://" not in path else []
    return [p for p in dict.fromkeys(out) if p and not p.startswith("..")]


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports with target, status (resolved, external, unresolved) and reason.

    A relative specifier without a module is unresolved, any other one is taken for a dependency.
    """

    @F.pandas_udf("array<string>")
    def paths(modules: pd.Series, specifiers: pd.Series) -> pd.Series:
        return pd.Series([candidates(m, s) if m is not None and s is not None else [] for m, s in zip(modules, specifiers)], dtype=object)

    found = resolve_candidates(imports, paths("module", "specifier"), modules)
    local = F.col("specifier").rlike(r"^(\.|/|res://|crate\b|self\b|super\b)")
    status = F.when(F.col("target").isNotNull(), "resolved").when(local, "unresolved").otherwise("external")
    return found.withColumns({"status": status, "reason": F.when(status == "unresolved", "NotIndexed").when(status == "external", "ExternalDependency")})


def bind_across(refs: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unbound references whose name the file imports, bound to the target module's top-level declaration.

    An explicit import of the name comes before star imports, and a star import alone never proves a binding: what it could
    mean stays ambiguous.  Imports of packages explain a reference as an external dependency.  Symbols and imported names
    grow with the workspace, so the joins are merged and nothing is gathered on the driver to be broadcast.
    """
    top = symbols.filter("containerId is null").select(F.col("module").alias("target"), F.col("name").alias("importedName"), "symbolId").hint("merge")
    named = resolved.filter("name is not null and name <> '*'").select("module", F.coalesce("localName", "name").alias("name"), F.col("name").alias("importedName"), "target", F.col("status").alias("_s"), F.lit(True).alias("_explicit"))
    starred = resolved.filter("name = '*' and target is not null").select("module", "target")
    by_star = starred.join(top, "target").select("module", F.col("importedName").alias("name"), "symbolId")
    hit = named.join(top, ["target", "importedName"], "left").groupBy("module", "name").agg(
        F.collect_set("symbolId").alias("_ids"), F.bool_or(F.col("_s") == "external").alias("_external")
    )
    star = by_star.groupBy("module", "name").agg(F.collect_set("symbolId").alias("_stars"))
    joined = refs.join(hit.hint("merge"), ["module", "name"], "left").join(star.hint("merge"), ["module", "name"], "left")
    # a member access has its own reason and is not a name of the file
    open_ = (F.col("status") == "unbound") & ~F.col("reason").eqNullSafe(F.lit("DynamicallyTyped"))
    n = F.coalesce(F.size("_ids"), F.lit(0))
    some = F.when(n > 0, F.array_sort("_ids")).otherwise(F.array_sort("_stars"))
    status = F.when(open_ & (n == 1), "bound").when(open_ & ((n > 1) | F.col("_stars").isNotNull()), "ambiguous").otherwise(F.col("status"))
    out = joined.withColumns({
        "_status": status, "targetId": F.when(open_ & (n == 1), F.element_at("_ids", 1)).otherwise(F.col("targetId")),
        "candidates": F.when(open_ & (status == "ambiguous"), some).otherwise(F.col("candidates")),
        "provenance": F.when(open_ & (n == 1), "bound").otherwise(F.col("provenance")),
        "reason": F.when(open_ & (n == 1), F.lit(None)).when(status == "ambiguous", "Ambiguous").when(open_ & F.col("_external"), "ExternalDependency").otherwise(F.col("reason")),
    })
    return out.withColumn("status", F.col("_status")).select(*refs.columns)


def claims_of(files: DataFrame, claims: dict[str, str]) -> DataFrame:
    """Provider of each file by extension, from a fixed map."""
    table = F.create_map(*[F.lit(x) for kv in claims.items() for x in kv])
    return files.withColumn("provider", table[extension_of("module")])
