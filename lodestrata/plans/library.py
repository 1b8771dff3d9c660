"""More queries of the registry: each calls the library function that its name says, over the driver's tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from lodestrata import paging
from lodestrata.functions import coordinates, ids, numbers, text
from lodestrata.lake import FactLake, ResultCache
from lodestrata.operators import graph, ingest, read, refactor
from lodestrata.plans.registry import query
from lodestrata.streaming import feed

_MODULE = "regexp_replace(url, '^https?://', '')"


def _pages(f):
    return f.t("pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("module"), "html")


def _fresh(f, tag: str) -> str:
    return f"{graph.shared_folder(f.spark)}/{tag}-{uuid.uuid4().hex}"


def mapped(fn, returns: str):
    """A Python function of one string as an Arrow-batched column function; null stays null."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    return run


# ---- sources, routing, guards ----------------------------------------------------------------------------------------


@query(
    "scope_decision",
    f"""with p as (select page_id, {_MODULE} as m from pages), k as (select distinct m from p where page_id % 3 = 0)
        select page_id, regexp_matches(m, '^[^/]*/de(?:/.*)?$') as denied, case when regexp_matches(m, '^[^/]*/de(?:/.*)?$') then false when regexp_matches(m, '^[^/]*/en/[^/]*$') then true
         when regexp_matches(m, '^(?:.*/)?fr/[^/]*$') then false else m in (select m from k) end as allowed from p""",
)
def scope_decision(f):
    """S4."""
    files = _pages(f)
    got = ingest.in_scope(files, include=["*/en/*"], exclude=["**/fr/*"], deny=["*/de/**"], known=files.filter("page_id % 3 = 0"))
    return got.select("page_id", "denied", "allowed")


@query("generated_files", "select doc_id as module from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0)")
def generated_files(f):
    """S5."""
    value = F.when(F.col("quality") == 0, "set").when(F.col("toxic") == 1, "unset").otherwise("unspecified")
    return ingest.without_generated(f.t("documents").select(F.col("doc_id").alias("module")), f.t("labels").select(F.col("doc_id").alias("module"), value.alias("value")))


@query(
    "external_modules",
    """select page_id, s as specifier, starts_with(s, '../') or s = '..' or starts_with(s, '/') or list_contains(string_split(s, '/'), 'node_modules') as external
       from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as s from pages)""",
)
def external_modules(f):
    """S7."""
    return f.page_imports.select("page_id", "specifier", ingest.is_external("specifier").alias("external"))


@query(
    "guarded_reads",
    """select doc_id, case when n_chars * 300 > 4194304 then 'tooLarge' when doc_id % 7 = 0 then 'binary' else 'ok' end as state,
        case when not coalesce(n_chars * 300 > 4194304, false) and doc_id % 7 <> 0 then length(text) end as n from documents""",
)
def guarded_reads(f):
    """S8."""
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(b"a\0b"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    files = f.t("documents").select("doc_id", content.alias("content"), (F.col("n_chars") * 300).alias("length"))
    return ingest.guarded(files).select("doc_id", "state", F.length("text").cast("long").alias("n"))


@query("ignored_paths", f"select page_id, list_has_any(string_split({_MODULE}, '/'), ['en', 'raw', 'm.ththth.example.net']) as ignored from pages")
def ignored_paths(f):
    """P17."""
    return _pages(f).select("page_id", ingest.ignored("module", ["en", "raw", "m.ththth.example.net"]).alias("ignored"))


@query(
    "module_paths",
    f"select page_id, regexp_replace({_MODULE}, '/+$', '') as module, replace(replace(regexp_replace({_MODULE}, '/+$', ''), '%', '%25'), ' ', '%20') as field, regexp_replace({_MODULE}, '/+$', '') as back, lower(regexp_extract(string_split({_MODULE}, '/')[-1], '^.+(\\.[^.]+)$', 1)) as extension from pages",
)
def module_paths(f):
    """Paths with empty and dot segments come back to their canonical form."""
    rough = F.concat(F.lit("./"), F.replace("module", F.lit("/"), F.lit("/.//")))
    rows = _pages(f).select("page_id", "module", mapped(ids.normalize_module, "string")(rough).alias("clean"))
    field = mapped(ids.encode_module, "string")("clean")
    return rows.withColumn("field", field).select("page_id", F.col("clean").alias("module"), "field", mapped(ids.decode_module, "string")("field").alias("back"), ingest.extension_of("module").alias("extension"))


# ---- predicates and joins ---------------------------------------------------------------------------------------------


@query("symbol_summary", "select 'p' || p_partkey as symbolId, p_name as name, p_brand as module, p_size % 2 = 0 as exported, p_size as startLine from part")
def symbol_summary(f):
    """P1."""
    none = F.lit(None).cast("string")
    table = f.parts.join(f.t("part").select(F.concat(F.lit("p"), "p_partkey").alias("symbolId"), "p_size"), "symbolId")
    full = table.withColumns({"visibility": none, "exported": F.col("p_size") % 2 == 0, "signature": none, "startLine": F.col("p_size"), "startChar": F.lit(0)})
    return read.summary(full).select("symbolId", "name", "module", "exported", "startLine")


@query("find_by_name", "select 'p' || p_partkey as symbolId from part where p_name = 'red widget' and p_brand = 'Brand#17'")
def find_by_name(f):
    """P3."""
    return read.find_by_name(f.parts, "red widget", "Brand#17").select("symbolId")


_STATUS = "case l_returnflag when 'R' then 'bound' when 'A' then 'ambiguous' else 'unbound' end"
_REASON = "case l_linestatus when 'F' then 'ExternalDependency' else 'ParseError' end"


@query(
    "resolved_reasons",
    f"""with r as (select {_STATUS} as status, {_REASON} as reason from lineitem),
        w as (select status, status = 'bound' as resolved, case when status = 'ambiguous' then 'Ambiguous' when status <> 'bound' then reason end as why from r)
        select status, resolved, why, why is not null and why not in ('ExternalDependency', 'NotIndexed', 'DynamicallyTyped') as dangling, count(*) as n from w group by all""",
)
def resolved_reasons(f):
    """P14, P15."""
    rows = f.t("lineitem").select(F.expr(_STATUS).alias("status"), F.expr(_REASON).alias("reason"))
    known = rows.select("status", read.is_resolved().alias("resolved"), read.reason_of().alias("why"))
    return known.withColumn("dangling", read.is_dangling("why")).groupBy("status", "resolved", "why", "dangling").agg(F.count("*").alias("n"))


@query("term_guard", "select count(*) as n from part where contains(lower(p_name), 'widget')")
def term_guard(f):
    """Terms that can't be searched for are refused before a plan is made."""
    for wrong in ("a\0b", "x" * 2001):
        try:
            read.search_symbols(f.parts, term=wrong)
        except ValueError:
            continue
        raise AssertionError("a term that is refused was taken")
    return read.search_symbols(f.parts, term="WIDGET").agg(F.count("*").alias("n"))


@query(
    "comment_anchors",
    "select page_id, raw, n_name as anchorName, case when n_name is not null then 'class' end as anchorKind from (select page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) as raw from pages) left join nation on n_nationkey = page_id % 40",
)
def comment_anchors(f):
    """J3."""
    comments = f.page_comments.withColumn("anchorId", F.concat(F.lit("n"), F.col("page_id") % 40))
    return read.with_anchor(comments, f.geography).select("page_id", "raw", "anchorName", "anchorKind")


@query("type_hierarchy", "select distinct 'o' || l_orderkey as sub, 'p' || l_partkey as super, case l_returnflag when 'R' then 'extends' else 'implements' end as role from lineitem where l_returnflag in ('R', 'A')")
def type_hierarchy(f):
    """J5."""
    role = F.when(F.col("name").startswith("R"), "extends").when(F.col("name").startswith("A"), "implements").otherwise("call")
    return graph.heritage(f.refs.withColumn("role", role))


@query(
    "rename_places",
    """with t as (select min(l_partkey) as k from lineitem), u as (select distinct 's' || l_suppkey as module, l_linenumber as a, cast(l_quantity as integer) as b from lineitem, t where l_partkey = k)
       select p_brand as module, 'declaration' as place, p_size as startLine, 4 as startChar, p_size as endLine, 9 as endChar from part, t where p_partkey = k
       union all select module, 'reference', a, b, a, b + 5 from u
       union all select 's' || s_suppkey, 'import', cast(s_suppkey as integer), 0, cast(s_suppkey as integer), 5 from supplier where s_nationkey % 2 = 0 and 's' || s_suppkey in (select module from u)""",
)
def rename_places(f):
    """Every place that spells the least part, with its span."""
    target = f"p{f.t('lineitem').agg(F.min('l_partkey')).first()[0]}"  # a parameter of the rename
    at = lambda line, char, width: {"startLine": line, "startChar": char, "endLine": line, "endChar": char + width}
    size = f.t("part").select(F.concat(F.lit("p"), "p_partkey").alias("symbolId"), "p_size")
    symbols = f.parts.join(size, "symbolId").withColumns({"nameLine": F.col("p_size"), "nameChar": F.lit(4), "nameEndLine": F.col("p_size"), "nameEndChar": F.lit(9)})
    refs = f.t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("targetId"), F.concat(F.lit("s"), "l_suppkey").alias("module"), "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    imports = f.t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("module"), F.when(F.col("s_nationkey") % 2 == 0, "spelled").otherwise("other").alias("name"), F.col("s_suppkey").cast("int").alias("k"))
    return refactor.rename_sites(symbols, refs.withColumns(at(F.col("l_linenumber"), F.col("q"), 5)), imports.withColumns(at(F.col("k"), F.lit(0), 5)), target, "spelled")


@query(
    "move_needs",
    f"""with b as (select o_orderkey as k, cast(extract('day' from o_orderdate) as integer) % 3 + 1 as a from orders where o_orderkey % 5 = 0),
        r as (select cast(l_orderkey as varchar) as module, l_returnflag || l_linestatus as name, 'p' || l_partkey as targetId, {_STATUS} as status from lineitem join b on k = l_orderkey and l_linenumber between a and a + 2),
        s as (select 'p' || p_partkey as targetId, cast(p_partkey as varchar) as tm, case when p_size % 2 = 0 then 'private' else 'public' end as v from part),
        i as (select cast(o_orderkey as varchar) as module, 'NO' as name, o_orderpriority as specifier from orders where o_orderkey % 10 = 0)
        select distinct r.module, r.name, r.targetId, specifier, case when specifier is not null then 'import' when status <> 'bound' then 'unbound' when tm = r.module and v = 'private' then 'privateSibling'
         when tm = r.module then 'sibling' else 'elsewhere' end as need from r left join s using (targetId) left join i on i.module = r.module and i.name = r.name""",
)
def move_needs(f):
    """What the bodies that move refer to, and what that takes."""
    body = f.t("orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("module"), (F.dayofmonth("o_orderdate") % 3 + 1).alias("startLine"))
    body = body.withColumns({"startChar": F.lit(0), "endLine": F.col("startLine") + 2, "endChar": F.lit(1 << 30)})
    refs = f.t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("module"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.concat(F.lit("p"), "l_partkey").alias("targetId"), F.expr(_STATUS).alias("status"),
        F.col("l_linenumber").alias("startLine"), F.lit(0).alias("startChar"),
    )
    symbols = f.t("part").select(F.concat(F.lit("p"), "p_partkey").alias("symbolId"), F.col("p_partkey").cast("string").alias("module"), F.when(F.col("p_size") % 2 == 0, "private").otherwise("public").alias("visibility"))
    imports = f.t("orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("module"), F.lit("NO").alias("name"), F.lit(None).cast("string").alias("localName"), F.col("o_orderpriority").alias("specifier"))
    return refactor.move_dependencies(refs, body, symbols, imports)


@query("orphaned_references", "select 'p' || l_partkey as targetId, count(*) as n from lineitem where l_partkey not in (select p_partkey from part where p_size > 25) group by 1")
def orphaned_references(f):
    """J16."""
    left = f.t("part").filter("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("symbolId"))
    return refactor.orphans(f.refs, left).groupBy("targetId").agg(F.count("*").alias("n"))


@query("rows_by_module", "select p_brand as module, count(*) as n, min(p_name) as first from part group by 1")
def rows_by_module(f):
    """O8."""
    return read.by_module(f.parts, "name", "symbolId").select("module", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["name"].alias("first"))


@query("new_ids", "select distinct l_partkey as symbolId from lineitem where l_linenumber = 7 and l_partkey not in (select l_partkey from lineitem where l_linenumber = 1)")
def new_ids(f):
    """U4."""
    at = lambda c: f.t("lineitem").filter(c).select(F.col("l_partkey").alias("symbolId"))
    return refactor.new_ids(at("l_linenumber = 1"), at("l_linenumber = 7"))


# ---- graph -------------------------------------------------------------------------------------------------------------


_RING = "e(a, b) as (select n_nationkey, n_nationkey * 2 % 25 from nation union all select n_nationkey, (n_nationkey + 5) % 25 from nation where n_nationkey % 3 = 0)"


def _ring(f):
    n = F.col("n_nationkey")
    rows = f.t("nation")
    return rows.select(n.alias("a"), (n * 2 % 25).alias("b")).union(rows.filter(n % 3 == 0).select(n.alias("a"), ((n + 5) % 25).alias("b")))


@query("reachability_prune", f"with recursive {_RING}, r(n) as (select 5 union select b from e join r on a = n) select n_nationkey as module from nation where n_nationkey not in (select n from r)")
def reachability_prune(f):
    """Nations that a walk from the sixth doesn't reach."""
    roots = f.t("nation").filter("n_nationkey = 5").select(F.col("n_nationkey").alias("node"))
    return ingest.unreachable(f.t("nation").select(F.col("n_nationkey").alias("module")), graph.reachable(_ring(f), roots)).select("module")


@query(
    "cycle_membership",
    f"""with recursive {_RING}, w(a, b) as (select a, b from e union select w.a, e.b from w join e on e.a = w.b), c as (select x.a as node, min(x.b) as component from w x join w y on x.a = y.b and x.b = y.a group by x.a)
        select node, component from c where component = (select component from c where node = 3)""",
)
def cycle_membership(f):
    """G2."""
    one = f.t("nation").filter("n_nationkey = 3").select(F.col("n_nationkey").alias("node"))
    return graph.cycle_of(_ring(f), one)


@query(
    "import_neighbourhood",
    "with i as (select 's' || l_suppkey as m, 'p' || l_partkey as t from lineitem), o as (select m, t from i where m = (select min('s' || l_suppkey) from lineitem)) select module from (select m as module from o union select t from o) order by module limit 32",
)
def import_neighbourhood(f):
    """G12."""
    imports = f.refs.select("module", F.col("targetId").alias("target"))
    return graph.neighbourhood(imports, imports.agg(F.min("module").alias("module")))


_SYM = "sym geo world "


def _geo_ids(f):
    """Regions, nations and customers under ids that hold their containers."""
    region, nation, customer = f.t("region"), f.t("nation"), f.t("customer")
    r = region.select("r_regionkey", F.concat(F.lit(_SYM), F.translate("r_name", " ", "_"), F.lit("/")).alias("symbolId"))
    n = nation.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("symbolId", "n_name", F.lit("#")).alias("symbolId"))
    c = customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("symbolId", F.lit("`"), "c_name", F.lit("`.")).alias("symbolId"))
    return r.select("symbolId").union(n.select("symbolId")).union(c)


_GEO_IDS = f"""g as (select r_regionkey, '{_SYM}' || replace(r_name, ' ', '_') || '/' as id from region), n as (select n_nationkey, id || n_name || '#' as id from nation join g on n_regionkey = r_regionkey),
 s as (select id from g union all select id from n union all select id || '`' || c_name || '`.' from customer join n on c_nationkey = n_nationkey)"""


@query("id_subtree", f"with {_GEO_IDS} select id as symbolId from s where starts_with(id, '{_SYM}AMERICA/NATION_1#')")
def id_subtree(f):
    """NATION_1 and its customers, and not NATION_11."""
    return graph.subtree(_geo_ids(f), f"{_SYM}AMERICA/NATION_1#")


@query("id_moves", f"with {_GEO_IDS} select id as oldKey, 'sym geo map NEW/' || substr(id, length('{_SYM}AMERICA/') + 1) as newKey from s where starts_with(id, '{_SYM}AMERICA/')")
def id_moves(f):
    """G11."""
    return refactor.id_map(_geo_ids(f), f"{_SYM}AMERICA/", "sym geo map NEW/")


@query("symbol_id_parts", f"with {_GEO_IDS} select id as symbolId, 'world' as module, case when length(id) - length(replace(replace(id, '/', ''), '`', '')) > 0 and not ends_with(id, '/') then regexp_replace(id, '(`[^`]*`\\.|[^/#`]+#)$', '') end as owner from s")
def symbol_id_parts(f):
    """Ids parsed, and their owners composed again."""
    return _geo_ids(f).select("symbolId", mapped(ids.module_of, "string")("symbolId").alias("module"), mapped(ids.owner_of, "string")("symbolId").alias("owner"))


# ---- text, coordinates, literals --------------------------------------------------------------------------------------


@query("normalized_comments", "select page_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as normalized, true as block from (select page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) as raw from pages)")
def normalized_comments(f):
    """T1, T3."""
    raw = F.concat(F.lit("<!--"), "raw", F.lit("-->"))
    rows = f.page_comments.select("page_id", raw.alias("raw"))
    return rows.select("page_id", mapped(text.normalize_comment, "string")("raw").alias("normalized"), mapped(text.is_block_comment, "boolean")("raw").alias("block"))


@query(
    "line_positions",
    """with d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null and not contains(text, chr(13)))
       select doc_id, cast(len(l) as bigint) as lines, length(l[-1]) + length(regexp_replace(l[-1], '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as lastChar from d""",
)
def line_positions(f):
    """Where a text ends, in lines and UTF-16 units, by its coordinates."""

    def end(t: str) -> str:
        at = coordinates.Coordinates(t)
        line, char = at.position(len(at.units) // 2)
        return f"{line + 1}:{char}"

    rows = f.t("documents").filter("text is not null and not contains(text, '\r')").select("doc_id", F.split(mapped(end, "string")("text"), ":").alias("p"))
    return rows.select("doc_id", F.col("p")[0].cast("long").alias("lines"), F.col("p")[1].cast("long").alias("lastChar"))


@query("file_edits", "select doc_id as module, sha256('XYZ' || substr(text, 4) || '!') as digest from documents where length(string_split(text, chr(10))[1]) >= 3 and not contains(text, chr(10))")
def file_edits(f):
    """Two edits of each one-line document, applied together."""
    one = f.t("documents").filter("not contains(text, '\n') and length(text) >= 3").select(F.col("doc_id").alias("module"), "text")
    edit = lambda a, b, s: one.select("module", F.lit(0).alias("startLine"), a.alias("startChar"), F.lit(0).alias("endLine"), b.alias("endChar"), F.lit(s).alias("newText"))
    end = coordinates.utf16_length("text")
    edits = edit(F.lit(0), F.lit(3), "XYZ").union(edit(end, end, "!"))
    return refactor.apply_to_files(one, edits).filter("problem is null").select("module", F.sha2("text", 256).alias("digest"))


@query(
    "number_literals",
    """select p_partkey, case p_partkey % 4 when 0 then cast(p_size as double) when 1 then cast(p_size as double) * 1000 when 2 then p_retailprice else cast(p_size as double) end as value from part""",
)
def number_literals(f):
    """Sizes and prices as Rust writes them, decoded."""
    size = F.col("p_size")
    written = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex(size)), F.lit("u32"))).when(F.col("p_partkey") % 4 == 1, F.concat(size.cast("string"), F.lit("_000i64"))).when(
        F.col("p_partkey") % 4 == 2, F.col("p_retailprice").cast("string")
    ).otherwise(F.concat(F.lit("0b"), F.conv(size.cast("string"), 10, 2)))
    return f.t("part").select("p_partkey", mapped(lambda s: numbers.decode_number(s, "rust"), "double")(written).alias("value"))


@query("string_literals", "select p_partkey, 'a' || chr(10) || p_name || 'A\\' as value from part")
def string_literals(f):
    """T18."""
    body = F.concat(F.lit("a\\n"), "p_name", F.lit("\\u0041\\\\"))
    return f.t("part").select("p_partkey", mapped(numbers.decode_string, "string")(body).alias("value"))


# ---- extraction --------------------------------------------------------------------------------------------------------


def _facts(files, *only: str):
    """Facts of the kinds that a query reads; the others need not leave the worker."""
    from lodestrata.sources.extract import extract

    return extract(files, only=only)


@query("json_facts", "select event_id, json_extract_string(props, '$.k') as value, cast(json_extract_string(props, '$.k') as double) as number, 'k' as name from events")
def json_facts(f):
    """The key of each event's properties as a declaration, and its value as a literal."""
    files = f.t("events").select(F.concat(F.lit("e/"), F.col("event_id"), F.lit(".json")).alias("module"), F.col("props").alias("text"))
    facts = _facts(files, "declarations", "literals").select("module", F.explode("literals").alias("l"), F.col("declarations")[0]["name"].alias("name"))
    return facts.select(F.regexp_extract("module", r"(\d+)", 1).cast("long").alias("event_id"), F.col("l.value").alias("value"), F.col("l.number").alias("number"), "name")


@query(
    "markdown_facts",
    """select doc_id, 'Source ' || source as heading, coalesce(nullif(lang, ''), 'none') || ' words' as prose, case when doc_id % 2 = 0 then 'x = 1' end as fenced from documents where source is not null and lang is not null""",
)
def markdown_facts(f):
    """A heading, prose below it and every other time a fenced block, read back from Markdown."""
    fence = F.when(F.col("doc_id") % 2 == 0, "\n```\nx = 1\n```\n").otherwise("")
    body = F.concat(F.lit("# Source "), "source", F.lit("\n\n"), "lang", F.lit(" words\n"), fence)
    files = f.t("documents").filter("source is not null and lang is not null").select(F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".md")).alias("module"), body.alias("text"))
    docs = lambda fenced: F.filter("docs", lambda d: d["fenced"] == F.lit(fenced))
    return _facts(files, "declarations", "docs").select(
        F.regexp_extract("module", r"(\d+)", 1).cast("long").alias("doc_id"), F.filter("declarations", lambda d: d["kind"] == "heading")[0]["name"].alias("heading"),
        docs(False)[0]["normalized"].alias("prose"), F.get(docs(True), F.lit(0))["normalized"].alias("fenced"),
    )


@query(
    "python_facts",
    "select p_partkey, 'part_' || p_partkey as name, case when p_size % 2 = 0 then 2 else 1 end as parameters, cast(p_size as double) as number, case when p_size % 2 = 0 then 'even ' || p_brand end as comment from part",
)
def python_facts(f):
    """A function a part, with parameters, a literal and a comment."""
    even = F.col("p_size") % 2 == 0
    body = F.concat(F.when(even, F.concat(F.lit("# even "), "p_brand", F.lit("\n"))).otherwise(""), F.lit("def part_"), F.col("p_partkey"), F.when(even, "(a, b)").otherwise("(a)"), F.lit(":\n    return "), F.col("p_size"), F.lit("\n"))
    files = f.t("part").select(F.concat(F.lit("p/"), F.col("p_partkey"), F.lit(".py")).alias("module"), body.alias("text"))
    found = F.filter("declarations", lambda d: d["kind"] == "function")[0]
    return _facts(files, "declarations", "literals", "comments").select(
        F.regexp_extract("module", r"(\d+)", 1).cast("long").alias("p_partkey"), found["name"].alias("name"), found["mParameters"].alias("parameters"), F.col("literals")[0]["number"].alias("number"),
        F.get("comments", F.lit(0))["normalized"].alias("comment"),
    )


def _code(f, extension: str, body, only: str):
    """One file a part, and (p_partkey, facts of one kind)."""
    files = f.t("part").select(F.concat(F.lit("p/"), F.col("p_partkey"), F.lit(extension)).alias("module"), body.alias("text"))
    return _facts(files, only).withColumn("p_partkey", F.regexp_extract("module", r"(\d+)", 1).cast("long"))


def _members(facts):
    """(p_partkey, name, kind, visibility) of every declaration."""
    return facts.select("p_partkey", F.explode("declarations").alias("d")).select("p_partkey", "d.name", "d.kind", "d.visibility")


def _vis(a: str, b: str):
    return F.when(F.col("p_size") % 2 == 0, a).otherwise(b)


@query(
    "typescript_members",
    """select p_partkey, unnest([{'name': 'P' || p_partkey, 'kind': 'class', 'visibility': case when p_size % 2 = 0 then 'public' else 'fileLocal' end}, {'name': 'size', 'kind': 'property', 'visibility': 'private'},
        {'name': 'area', 'kind': 'method', 'visibility': 'public'}], recursive := true) from part""",
)
def typescript_members(f):
    """X16, X18."""
    body = F.concat(_vis("export ", ""), F.lit("class P"), F.col("p_partkey"), F.lit(" {\n  private size = "), F.col("p_size"), F.lit(";\n  area(a: number): number { return this.size; }\n}\n"))
    return _members(_code(f, ".ts", body, "declarations"))


@query(
    "typescript_roles",
    "select p_partkey, unnest([{'name': 'go', 'role': 'call', 'bound': true}, {'name': 'n', 'role': case when p_size % 2 = 0 then 'write' else 'read' end, 'bound': true}, {'name': 'P', 'role': 'instantiate', 'bound': true}], recursive := true) from part",
)
def typescript_roles(f):
    """Calls, compound writes and instantiations, bound in their file."""
    body = F.concat(F.lit("class P {}\nlet n = 1;\nfunction go() { return 1; }\ngo();\nn "), _vis("+= 2", "- 2"), F.lit(";\nnew P();\n"))
    return _code(f, ".ts", body, "references").select("p_partkey", F.explode("references").alias("r")).select("p_partkey", "r.name", "r.role", F.col("r.targetId").isNotNull().alias("bound"))


@query(
    "csharp_members",
    """select p_partkey, unnest([{'name': 'P' || p_partkey, 'kind': 'class', 'visibility': case when p_size % 2 = 0 then 'public' else 'internal' end}, {'name': 'size', 'kind': 'field', 'visibility': 'private'},
        {'name': 'Area', 'kind': 'method', 'visibility': case when p_size % 2 = 0 then 'protected' else 'private' end}], recursive := true) from part""",
)
def csharp_members(f):
    """X20."""
    body = F.concat(_vis("public ", ""), F.lit("class P"), F.col("p_partkey"), F.lit(" {\n  int size = "), F.col("p_size"), F.lit(";\n  "), _vis("protected ", ""), F.lit("int Area(int a) { return size; }\n}\n"))
    return _members(_code(f, ".cs", body, "declarations"))


@query(
    "kotlin_members",
    "select p_partkey, unnest([{'name': 'P' || p_partkey, 'kind': 'class', 'visibility': case when p_size % 2 = 0 then 'internal' else 'public' end}, {'name': 'size', 'kind': 'property', 'visibility': 'private'}, {'name': 'area', 'kind': 'method', 'visibility': 'public'}], recursive := true) from part",
)
def kotlin_members(f):
    """X21."""
    body = F.concat(F.lit("package p\n"), _vis("internal ", ""), F.lit("class P"), F.col("p_partkey"), F.lit(" {\n  private val size = "), F.col("p_size"), F.lit("\n  fun area(): Int { return size }\n}\n"))
    return _members(_code(f, ".kt", body, "declarations"))


@query(
    "gdscript_members",
    "select p_partkey, unnest([{'name': 'size', 'kind': 'property', 'visibility': 'public'}, {'name': case when p_size % 2 = 0 then '_go' else 'go' end, 'kind': 'function', 'visibility': case when p_size % 2 = 0 then 'private' else 'public' end}], recursive := true) from part",
)
def gdscript_members(f):
    """X22."""
    body = F.concat(F.lit("extends Node\nvar size = "), F.col("p_size"), F.lit("\nfunc "), _vis("_go", "go"), F.lit("():\n\treturn size\n"))
    return _members(_code(f, ".gd", body, "declarations"))


@query("python_references", "select p_partkey, case when p_size % 2 = 0 then 'bound' else 'unbound' end as status, case when p_size % 2 = 0 then 'go' else 'gone' end as name from part")
def python_references(f):
    """A call that means the function above, and one that means nothing here."""
    body = F.concat(F.lit("def go():\n    pass\n\n\ndef run():\n    "), _vis("go", "gone"), F.lit("()\n"))
    return _code(f, ".py", body, "references").select("p_partkey", F.explode("references").alias("r")).select("p_partkey", "r.status", "r.name")


@query("yaml_facts", "select p_partkey, unnest([{'kind': 'string', 'value': p_name}, {'kind': 'number', 'value': cast(p_size as varchar)}, {'kind': 'boolean', 'value': case when p_size % 2 = 0 then 'true' else 'false' end}], recursive := true) from part")
def yaml_facts(f):
    """Scalars of two YAML documents in one file."""
    body = F.concat(F.lit("name: "), "p_name", F.lit("\nsize: "), F.col("p_size"), F.lit("\n---\neven: "), _vis("true", "false"), F.lit("\n"))
    return _code(f, ".yaml", body, "literals").select("p_partkey", F.explode("literals").alias("l")).select("p_partkey", "l.kind", "l.value")


@query("jsonl_facts", "select p_partkey, unnest([p_name, cast(p_size as varchar)]) as value, case when p_size % 2 = 0 then 1 else 0 end as notes from part")
def jsonl_facts(f):
    """Records line by line, and a note where a file is lenient JSON."""
    body = F.concat(F.lit('{"a": "'), "p_name", F.lit('"}\n{"a": '), F.col("p_size"), F.lit("}\n"))
    lenient = F.concat(F.lit('{"a": 1'), _vis(" // odd\n", "\n"), F.lit("}"))
    notes = _code(f, ".json", lenient, "notes").select("p_partkey", F.size("notes").alias("notes")).hint("merge")
    return _code(f, ".jsonl", body, "literals").select("p_partkey", F.explode("literals").alias("l")).join(notes, "p_partkey").select("p_partkey", F.col("l.value").alias("value"), "notes")


@query(
    "resolved_candidates",
    """select p_partkey, case when p_size % 3 = 0 then 'src/m' || p_partkey || '.ts' when p_size % 3 = 1 then 'src/m' || p_partkey || '/index.ts' end as target,
        case when p_size % 3 < 2 then 'resolved' else 'unresolved' end as status, case when p_size % 3 = 2 then 'NotIndexed' end as reason from part""",
)
def resolved_candidates(f):
    """The first candidate path of a relative specifier that is a module here."""
    from lodestrata.operators.resolve import resolve_imports

    k = F.col("p_partkey").cast("string")
    imports = f.t("part").select("p_partkey", F.lit("src/app.ts").alias("module"), F.concat(F.lit("./m"), k).alias("specifier"))
    target = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("src/m"), k, F.lit(".ts"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("src/m"), k, F.lit("/index.ts")))
    return resolve_imports(imports, f.t("part").select(target.alias("module")).filter("module is not null")).select("p_partkey", "target", "status", "reason")


@query(
    "bound_across_files",
    """select p_partkey, case p_size % 3 when 0 then 'bound' when 1 then 'ambiguous' else 'unbound' end as status, case p_size % 3 when 0 then 'sym' || p_partkey end as targetId,
        case p_size % 3 when 1 then 'Ambiguous' when 2 then 'ExternalDependency' end as reason from part""",
)
def bound_across_files(f):
    """An imported name bound to its one declaration, to none of two, or put down to a dependency."""
    from lodestrata.operators.resolve import bind_across

    k, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    none = F.lit(None).cast("string")
    part = f.t("part")
    refs = part.select(
        "p_partkey", F.concat(F.lit("m"), k).alias("module"), F.lit("go").alias("name"), F.lit("unbound").alias("status"), none.alias("targetId"), F.array().cast("array<string>").alias("candidates"),
        none.alias("provenance"), F.lit("NotIndexed").alias("reason"),
    )
    resolved = part.select(F.concat(F.lit("m"), k).alias("module"), F.lit("go").alias("name"), none.alias("localName"), F.when(kind < 2, F.concat(F.lit("t"), k)).alias("target"), F.when(kind < 2, "resolved").otherwise("external").alias("status"))
    one = lambda s: part.filter(kind < 2).select(F.concat(F.lit("t"), k).alias("module"), F.lit("go").alias("name"), F.concat(F.lit(s), k).alias("symbolId"), none.alias("containerId"), kind.alias("kind"))
    symbols = one("sym").union(one("twin").filter("kind = 1"))
    return bind_across(refs, resolved, symbols).select("p_partkey", "status", "targetId", "reason")


@query(
    "attached_comments",
    "select p_partkey, case p_partkey % 3 when 0 then 'leading' when 1 then 'trailing' else 'standalone' end as form, case when p_partkey % 3 < 2 then 'part_' || p_partkey end as anchor from part",
)
def attached_comments(f):
    """A comment above its function, one after it on its line, and one that a blank line keeps apart."""
    k = F.col("p_partkey")
    own = F.concat(F.lit("part_"), k.cast("string"))
    body = F.when(k % 3 == 0, F.concat(F.lit("# about\n"), own, F.lit(" = 1\n"))).when(k % 3 == 1, F.concat(own, F.lit(" = 1  # about\n"))).otherwise(F.concat(F.lit("# about\n\n\n"), own, F.lit(" = 1\n")))
    files = f.t("part").select(F.concat(F.lit("p/"), k, F.lit(".py")).alias("module"), body.alias("text"))
    rows = _facts(files, "declarations", "comments").select("module", F.col("comments")[0].alias("c"), "declarations")
    anchor = F.get(F.filter("declarations", lambda d: d["symbolId"] == F.col("c.anchorId")), F.lit(0))["name"]
    return rows.select(F.regexp_extract("module", r"(\d+)", 1).cast("long").alias("p_partkey"), F.col("c.form").alias("form"), anchor.alias("anchor"))


# ---- the lake ----------------------------------------------------------------------------------------------------------


@query(
    "lake_replace_and_forget",
    """select p_brand as module, count(*) as n, cast(sum(p_size) + case when p_brand = 'Brand#2' then 100 * count(*) else 0 end as double) as total from part where p_brand <> 'Brand#3' group by 1
       union all select 'scan', 3, cast(count(*) as double) from part""",
)
def lake_replace_and_forget(f):
    """Literals of all brands written, those of one replaced, those of another forgotten, a summary kept."""
    lake = FactLake(f.spark, _fresh(f, "lake"), buckets=8)
    rows = f.t("part").select(F.col("p_brand").alias("module"), F.col("p_partkey").cast("string").alias("factId"), F.lit("number").alias("kind"), F.col("p_size").cast("double").alias("number"))
    names = lambda *m: f.spark.createDataFrame([(x,) for x in m], "module string")
    lake.replace_modules({"literals": rows}, rows.select("module"))
    lake.replace_modules({"literals": rows.filter("module = 'Brand#2'").withColumn("number", F.col("number") + 100)}, names("Brand#2"))
    version = lake.forget_modules(names("Brand#3"))
    lake.put_meta(parts=f.t("part").count(), version=version)
    held = lake.meta("parts", "version")
    summary = f.spark.createDataFrame([("scan", int(held["version"]), float(held["parts"]))], "module string, n long, total double")
    return lake.read("literals").groupBy("module").agg(F.count("*").alias("n"), F.sum("number").alias("total")).union(summary)


@query(
    "lake_upserts",
    """with a as (select c_custkey as k, 'first' as prose, case when c_custkey % 3 = 0 then 'd' end as doubt from customer where c_nationkey < 10)
       select 'c' || c_custkey as symbolId, case when c_nationkey >= 5 and c_nationkey < 15 then 'second' when c_nationkey < 10 then 'first' else 'third' end as prose,
        case when c_nationkey < 10 and c_nationkey < 5 and c_custkey % 3 = 0 then 'd' when c_custkey % 2 = 0 and (c_nationkey < 20) then 'late' end as doubtId from customer where c_nationkey < 20""",
)
def lake_upserts(f):
    """K3, K5, K7: answers written, overwritten by key, inserted where absent, and doubted where nobody has."""
    lake = FactLake(f.spark, _fresh(f, "lake"))
    some = lambda c, prose: f.t("customer").filter(c).select(F.concat(F.lit("c"), "c_custkey").alias("symbolId"), F.lit("why").alias("question"), F.lit(prose).alias("prose"))
    first = some("c_nationkey < 10", "first").withColumn("doubtId", F.when(F.substring("symbolId", 2, 20).cast("long") % 3 == 0, "d"))
    lake.write_table("answers", first)
    lake.upsert("answers", some("c_nationkey >= 5 and c_nationkey < 15", "second"))
    lake.insert_absent("answers", some("c_nationkey < 20", "third"))
    lake.update_where_null("answers", some("c_custkey % 2 = 0", "-").withColumn("doubtId", F.lit("late")), "doubtId")
    return lake.read("answers").select("symbolId", "prose", "doubtId")


@query(
    "lake_doubts_and_steps",
    "select 'answers' as what, count(*) as affected, count(*) filter (c_nationkey < 10) as held from customer where c_nationkey < 10 union all select 'steps', (select count(*) from nation where n_nationkey % 2 = 1), (select count(*) from nation)",
)
def lake_doubts_and_steps(f):
    """K7: updates of what exists say how many rows they met."""
    lake = FactLake(f.spark, _fresh(f, "lake"))
    key = [F.concat(F.lit("c"), "c_custkey").alias("symbolId"), F.lit("why").alias("question")]
    lake.write_table("answers", f.t("customer").filter("c_nationkey < 10").select(*key, F.lit("p").alias("prose")))
    _, doubted = lake.set_doubt(f.t("customer").select(*key, F.lit("d").alias("doubtId"), F.lit("r").alias("doubtReason"), F.lit(1).alias("doubtAt"), F.lit("me").alias("doubtBy")))
    steps = f.t("nation").select(F.lit("t").alias("transactionId"), F.col("n_nationkey").alias("stepNo"), F.when(F.col("n_nationkey") % 2 == 1, "written").otherwise("finalized").alias("phase"))
    lake.write_table("refactor_steps", steps)
    _, finished = lake.complete_step(steps)
    done = [("answers", doubted, lake.read("answers").filter("doubtId = 'd'").count()), ("steps", finished, lake.read("refactor_steps").filter("phase = 'finalized'").count())]
    return f.spark.createDataFrame(done, "what string, affected long, held long")


@query("lake_rebuild_and_drop", "select (select count(*) from part) as before, cast(0 as bigint) as facts, (select count(*) from nation) as knowledge, 2 as lakes, 1 as dropped, true as unlisted")
def lake_rebuild_and_drop(f):
    """A rebuild drops facts and keeps knowledge; lakes are found below a folder, and deleted."""
    from lodestrata.lake import inventory

    root = _fresh(f, "lakes")
    one, two = FactLake(f.spark, f"{root}/one"), FactLake(f.spark, f"{root}/two")
    rows = f.t("part").select(F.col("p_brand").alias("module"), F.col("p_partkey").cast("string").alias("factId"))
    one.replace_modules({"literals": rows}, rows.select("module"))
    cache = ResultCache(one)
    before = cache.get("n", lambda: one.read("literals").agg(F.count("*").alias("n"))).first().n
    one.write_table("gaps", f.t("nation").select(F.col("n_name").alias("symbolId"), F.lit("why").alias("question")))
    one.rebuild()
    two.put_meta(a="b")
    after = cache.get("n", lambda: one.read("literals").agg(F.count("*").alias("n"))).first().n
    cache.clear()
    lakes = len(inventory(f.spark, root))
    kept = one.read("gaps").count()
    two.drop()
    left = inventory(f.spark, root)
    return f.spark.createDataFrame([(before, after, kept, lakes, lakes - len(left), all(not x["root"].endswith("two") for x in left))], "before long, facts long, knowledge long, lakes int, dropped int, unlisted boolean")


@query("outline_then_upgrade", "select (select count(*) from region) as outlined, cast(0 as bigint) as literalsFirst, (select count(*) from region) as pending, (select count(*) from region) as literals, cast(0 as bigint) as pendingLast")
def outline_then_upgrade(f):
    """Files indexed as outlines, then brought to full depth; what is current is skipped."""
    lake = FactLake(f.spark, _fresh(f, "lake"), buckets=4)
    body = F.concat(F.lit("def f():\n    return "), F.col("r_regionkey") + 1, F.lit("\n"))
    files = f.t("region").select(F.concat(F.translate(F.lower("r_name"), " ", "_"), F.lit(".py")).alias("module"), body.alias("text")).withColumn("contentHash", ids.content_hash("text"))
    lake.ingest(files, at=1, depth="outline")
    outlined, first, pending = lake.read("symbols").filter("kind = 'function'").count(), lake.read("literals").count(), lake.pending(files).count()
    lake.upgrade(files, at=2, modules=lake.read("files"))
    return f.spark.createDataFrame([(outlined, first, pending, lake.read("literals").count(), lake.pending(files).count())], "outlined long, literalsFirst long, pending long, literals long, pendingLast long")


# ---- knowledge ---------------------------------------------------------------------------------------------------------


def _proposals(f):
    """Answers proposed from conversations: a turn answers why its conversation is, citing the turn before and itself."""
    at = F.format_string("%d:%d", "conv_id", "turn")
    before = F.format_string("%d:%d", F.col("conv_id"), F.col("turn") - 1)
    question = F.when(F.col("turn") % 5 == 4, "guess").otherwise(F.concat(F.lit("q"), F.col("turn").cast("string")))
    return f.t("conversations").select(
        F.concat(F.lit("sym conv m"), F.col("conv_id").cast("string"), F.lit(" c.")).alias("symbolId"), F.when(F.col("turn") == 1, "why").when(F.col("turn") == 2, "usage").otherwise(question).alias("question"),
        F.when(F.col("conv_id") % 7 == 0, "").otherwise("because").alias("prose"), F.when(F.col("conv_id") % 5 == 0, F.array(before)).otherwise(F.array(before, at)).alias("citations"), "turn", "conv_id",
    ).filter("turn in (1, 2, 4)")


_PROPOSED = """p as (select conv_id, turn, case turn when 1 then 'why' when 2 then 'usage' else 'guess' end as question from conversations where turn in (1, 2, 4)),
 x as (select p.*, exists (select 1 from conversations c where c.conv_id = p.conv_id and c.turn = p.turn - 1 and c.role = 'user') as before, exists (select 1 from conversations c where c.conv_id = p.conv_id and c.turn = p.turn and c.role = 'user') as own from p),
 j as (select *, case when question = 'guess' then 'unknown question guess' when conv_id % 7 = 0 then 'an answer needs prose' when not before then 'does not resolve: ' || conv_id || ':' || (turn - 1)
  when conv_id % 5 <> 0 and not own then 'does not resolve: ' || conv_id || ':' || turn when conv_id % 3 = 0 then 'no cited fact is about sym conv m' || conv_id || ' c.' end as refused from x)"""


def _known(f):
    facts = f.t("conversations").filter("role = 'user'").select(F.format_string("%d:%d", "conv_id", "turn").alias("factId"), "conv_id")
    subjects = facts.filter("conv_id % 3 <> 0").select(F.concat(F.lit("sym conv m"), F.col("conv_id").cast("string"), F.lit(" c.")).alias("symbolId"), "factId")
    return facts.select("factId"), subjects


@query("judged_answers", f"with {_PROPOSED} select 'sym conv m' || conv_id || ' c.' as symbolId, question, refused from j")
def judged_answers(f):
    """The rules of writing, over a table of proposed answers."""
    from lodestrata.operators import knowledge

    proposed = _proposals(f)
    facts, subjects = _known(f)
    return knowledge.judge(proposed, facts, subjects, FactLake(f.spark, _fresh(f, "lake")).read("answers")).select("symbolId", "question", "refused")


@query(
    "recorded_answers",
    f"with {_PROPOSED} select 'sym conv m' || conv_id || ' c.' as symbolId, question, case when conv_id % 5 = 0 then 1 else 2 end as live, case when conv_id % 4 = 0 and conv_id % 8 <> 0 then 'doubted' else 'standing' end as state from j where refused is null",
)
def recorded_answers(f):
    """Answers recorded, every fourth conversation's doubted, every eighth's reaffirmed, and recalled."""
    from lodestrata.operators import knowledge

    lake, (facts, subjects) = FactLake(f.spark, _fresh(f, "lake")), _known(f)
    knowledge.record(lake, _proposals(f), facts, subjects, at=1)
    conv = F.regexp_extract("symbolId", r"m(\d+)", 1).cast("long")
    some = lake.read("answers").filter(conv % 4 == 0).select("symbolId", "question", F.lit("changed").alias("doubtReason"), F.lit("me").alias("doubtBy"), F.lit(2).cast("long").alias("doubtAt"))
    knowledge.invalidate(lake, some)
    knowledge.reaffirm(lake, lake.read("answers").filter((conv % 8 == 0) & F.col("doubtId").isNotNull()))
    return knowledge.recall(lake.read("answers"), facts).select("symbolId", "question", F.col("live").cast("int").alias("live"), "state")


@query("journal_recovered", "select 'm' || n_nationkey as module, case when n_nationkey % 3 = 0 then 'after' when n_nationkey % 3 = 1 then 'before' else 'changed' end as found from nation")
def journal_recovered(f):
    """A step that a crash cut short, read back from the lake and compared with the files that it left."""
    lake, n = FactLake(f.spark, _fresh(f, "lake")), f.t("nation").count()
    journal = refactor.Journal({f"m{i}": b"old %d" % i for i in range(n)})
    journal.start()
    journal.step("rename", {f"m{i}": b"new %d" % i for i in range(n)})
    journal.steps[-1]["phase"] = "written"
    journal.save(lake, "t1", at=1)
    left = {f"m{i}": (b"new %d", b"old %d", b"other %d")[i % 3] % i for i in range(n)}
    return f.spark.createDataFrame(sorted(refactor.Journal.load(lake, "t1", left).recover().items()), "module string, found string")


# ---- pages -------------------------------------------------------------------------------------------------------------


@query("counted_page", "select 20 as items, 'exact' as kind, count(*) as n, count(*) > 20 as truncated from part where p_size = 7 having count(*) >= 20 union all select cast(count(*) as integer), 'exact', count(*), false from part where p_size = 7 having count(*) < 20")
def counted_page(f):
    """A page with the exact count of its rows, as it goes on the wire."""
    page = paging.counted(f.t("part").filter("p_size = 7"), 20, "p_partkey")
    return f.spark.createDataFrame([(len(page.items), page.kind, page.count, page.wire()["truncated"])], "items int, kind string, n long, truncated boolean")


@query("scanned_page", "select 10 as items, 'atLeast' as kind, count(*) as n, 'pageAndScanCapped' as reason, true as incomplete from (select * from events order by event_id limit 5000) where event_type = 'click'")
def scanned_page(f):
    """Matches of a scan that stopped at its cap."""
    read_ = f.t("events").orderBy("event_id").limit(5000)
    page = paging.scanned(read_.filter("event_type = 'click'"), 10, min(5000, f.t("events").count()), 5000 if f.t("events").count() >= 5000 else f.t("events").count(), "event_id")
    return f.spark.createDataFrame([(len(page.items), page.kind, page.count, page.reason, page.wire().get("scanIncomplete", False))], "items int, kind string, n long, reason string, incomplete boolean")


# ---- streams -----------------------------------------------------------------------------------------------------------


def _events(f, *columns: str):
    """The events table as a stream of its file."""
    out = _fresh(f, "feed")
    f.t("events").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*columns).repartition(4).write.parquet(out)
    return feed.read_feed(f.spark, out, f.spark.read.parquet(out).schema)


def _collected(f, stream, mode: str = "complete"):
    """What a stream has put out once it has read all there is."""
    out = _fresh(f, "out")
    query_ = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).option("checkpointLocation", _fresh(f, "state")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return f.spark.read.schema(stream.schema).parquet(out)


@query("stream_counters", "select user_id, event_type, count(*) as askCount, max(ts) as lastAsked from events group by 1, 2")
def stream_counters(f):
    """The ledger of demand, kept by a stream."""
    return _collected(f, feed.counted(_events(f, "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days")).withColumn("lastAsked", F.col("lastAsked").cast("timestamp_ntz"))


@query("stream_windows", "select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(f):
    """Event-time windows, kept by a stream."""
    got = _collected(f, feed.windowed(_events(f, "event_type", "ts"), "ts", "6 hours", late="3650 days", keys=("event_type",)))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_applied",
    """with last as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1)
       select user_id as module, case when event_type = 'purchase' then 'forget' else 'reindex' end as action from last where event_type = 'purchase' or user_id % 7 <> 0""",
)
def stream_applied(f):
    """A change feed read as a stream, coalesced, decided and applied, each batch once."""
    lake, out = FactLake(f.spark, _fresh(f, "lake")), _fresh(f, "applied")
    events = _events(f, "user_id as module", "struct(ts, event_id) as seq", "if(event_type = 'purchase', 'deleted', 'changed') as kind", "props as contentHash", "if(user_id % 7 = 0, 0, 1) as owners")
    none = lambda: f.spark.createDataFrame([], "module long, contentHash string")
    apply = lambda decided, _: decided.select("module", "action").write.mode("append").parquet(out)
    feed.apply_feed(events, none, apply, _fresh(f, "state"), lake=lake).awaitTermination()
    return f.spark.read.schema("module long, action string").parquet(out)
