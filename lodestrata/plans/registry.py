"""Name -> query over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids, text
from lodestrata.functions.search import compile_pattern, glob_pattern
from lodestrata.operators import graph, history, ingest, knowledge, read, refactor
from lodestrata.plans.views import Facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over :class:`Facts`, with its oracle where SQL can express it."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Facts(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def key(prefix: str, column: str = "symbolId", to: str | None = None) -> F.Column:
    """The table key inside a view's id."""
    return F.substring(column, len(prefix) + 1, 20).cast("long").alias(to or column)


_REFS = "(select 'p' || l_partkey as targetId, 'o' || l_orderkey as fromId, case when l_returnflag = 'R' then 'call' else 'read' end as role, l_linenumber as startLine from lineitem)"

# ---- hubs, edges, fan --------------------------------------------------------------------------------------------------


@query("most_referenced", "select 'p' || l_partkey as symbolId, count(*) as fanIn from lineitem where l_partkey is not null group by 1 order by fanIn desc, symbolId limit 20")
def most_referenced(f):
    return graph.hubs(f.refs)


@query(
    "hub_with_declaration",
    """with hub as (select 'p' || l_partkey as symbolId, count(*) as fanIn from lineitem where l_partkey is not null group by 1 order by fanIn desc, symbolId limit 20)
       select symbolId, fanIn, p_name as name, p_brand as module, p_type as kind from hub left join part on 'p' || p_partkey = symbolId""",
)
def hub_with_declaration(f):
    return graph.hubs(f.refs, f.parts)


@query("reference_lookup", f"select fromId, role, startLine from {_REFS} where targetId = (select min('p' || p_partkey) from part)")
def reference_lookup(f):
    first = f.parts.agg(F.min("symbolId").alias("targetId"))
    return f.refs.join(F.broadcast(first), "targetId", "left_semi").select("fromId", "role", "startLine")


@query("unreferenced_symbols", "select 'o' || o_orderkey as symbolId from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def unreferenced_symbols(f):
    return graph.unreferenced(f.order_symbols, f.refs.select(F.col("fromId").alias("targetId"))).select("symbolId")


@query("distinct_edges", "select distinct 'o' || l_orderkey as a, 'p' || l_partkey as b from lineitem where l_orderkey is not null and l_partkey is not null")
def distinct_edges(f):
    return graph.distinct_edges(f.refs)


@query(
    "fan_in_out",
    """with o as (select o_orderkey, o_custkey from orders),
       e as (select l_orderkey, l_partkey from lineitem),
       own as (select 'o' || l_orderkey as symbolId, l_partkey from e union all select 'c' || o_custkey, l_partkey from e join o on o_orderkey = l_orderkey),
       s as (select 'o' || o_orderkey as symbolId from o union all select 'c' || c_custkey from customer),
       fo as (select symbolId, count(distinct l_partkey) as fanOut from own group by 1)
       select s.symbolId, 0 as fanIn, coalesce(fanOut, 0) as fanOut from s left join fo using (symbolId)""",
)
def fan_in_out(f):
    got = graph.fan_in_out(f.order_symbols.union(f.customer_symbols), f.refs)
    return got.withColumn("fanIn", F.col("fanIn").cast("int"))


@query("part_fan_in", "select 'p' || p_partkey as symbolId, coalesce(n, 0) as fanIn from part left join (select l_partkey, count(*) as n from lineitem group by 1) on l_partkey = p_partkey")
def part_fan_in(f):
    return graph.fan_in_out(f.parts, f.refs).select("symbolId", "fanIn")


@query(
    "call_hierarchy_incoming",
    f"""with t as (select min(targetId) as t from {_REFS} where role = 'call')
        select fromId as peer, count(*) as sites, min(startLine) as firstLine, max(startLine) as lastLine from {_REFS} r, t where role = 'call' and targetId = t.t group by fromId""",
)
def call_hierarchy_incoming(f):
    return graph.calls(f.refs, f.refs.filter("role = 'call'").agg(F.min("targetId")).first()[0])


@query(
    "call_hierarchy_outgoing",
    f"""with t as (select min(fromId) as t from {_REFS} where role = 'call')
        select targetId as peer, count(*) as sites, min(startLine) as firstLine, max(startLine) as lastLine from {_REFS} r, t where role = 'call' and fromId = t.t group by targetId""",
)
def call_hierarchy_outgoing(f):
    return graph.calls(f.refs, f.refs.filter("role = 'call'").agg(F.min("fromId")).first()[0], incoming=False)


@query("call_sites_by_pair", f"select fromId as peer, targetId, count(*) as sites from {_REFS} where role = 'call' group by 1, 2")
def call_sites_by_pair(f):
    return f.refs.filter("role = 'call'").groupBy(F.col("fromId").alias("peer"), "targetId").agg(F.count("*").alias("sites"))


@query("members_of", "select 'n' || n_nationkey as containerId, count(*) as members from (select c_nationkey as n_nationkey from customer union all select s_nationkey from supplier) group by 1")
def members_of(f):
    return read.members_of(f.geography, f.geography.filter("kind = 'class'")).groupBy("containerId").agg(F.count("*").alias("members"))


_GEO = """g(id, name, parent) as (select 'r' || r_regionkey, r_name, cast(null as varchar) from region union all select 'n' || n_nationkey, n_name, 'r' || n_regionkey from nation
 union all select 'c' || c_custkey, c_name, 'n' || c_nationkey from customer union all select 's' || s_suppkey, s_name, 'n' || s_nationkey from supplier)"""


@query(
    "supertypes_transitive",
    f"with recursive {_GEO}, w(start, ancestor, depth) as (select id, parent, 1 from g where parent is not null union all select start, parent, depth + 1 from w join g on g.id = ancestor where parent is not null and depth < 16) select start, ancestor, min(depth) as depth from w group by 1, 2",
)
def supertypes_transitive(f):
    return graph.ancestors(f.geography.filter("containerId is not null").select(F.col("symbolId").alias("child"), F.col("containerId").alias("parent")))


@query(
    "heading_path",
    f"with recursive {_GEO}, w(leaf, id, name, parent, depth) as (select id, id, name, parent, 0 from g union all select leaf, g.id, g.name, g.parent, depth + 1 from w join g on g.id = w.parent where depth < 16) select leaf, name, depth from w",
)
def heading_path(f):
    return graph.container_path(f.geography)


_EDGES = """e(a, b) as (select a, b from (select s_nationkey as a, c_nationkey as b, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join supplier on l_suppkey = s_suppkey group by 1, 2) where n > (select 1.35 * count(*) / 625 from lineitem))"""


def _nation_edges(f):
    return f.nation_edges.filter(F.col("n") > F.lit(1.35) * f.t("lineitem").count() / 625).select("a", "b")


@query(
    "cycles_scc",
    f"""with recursive {_EDGES}, r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
       m as (select x.a as node, least(x.a, min(x.b)) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a)
       select node, component from m""",
)
def cycles_scc(f):
    return graph.strong_components(_nation_edges(f))


@query(
    "cycles_largest",
    f"""with recursive {_EDGES}, r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
       m as (select x.a as node, least(x.a, min(x.b)) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a)
       select component, count(*) as size from m group by 1 order by size desc, component limit 20""",
)
def cycles_largest(f):
    return graph.cycles(_nation_edges(f))


@query(
    "import_closure",
    f"with recursive {_EDGES}, w(node, depth) as (select min(a), 0 from e union select e.b, depth + 1 from w join e on e.a = node where depth < 25) select node, min(depth) as depth from w where node is not null group by 1",
)
def import_closure(f):
    edges = graph.kept(_nation_edges(f))
    return graph.reachable(edges, edges.agg(F.min("a").alias("node")).filter("node is not null"))


@query(
    "modules_exposing",
    """with recursive i as (select n_name as module, r_name as target from nation join region on r_regionkey = n_regionkey union all select c_mktsegment, n_name from customer join nation on n_nationkey = c_nationkey),
       w(node, depth) as (select distinct r_name, 0 from region where r_regionkey = 0 union select i.module, depth + 1 from w join i on i.target = node where depth < 9)
       select node, min(depth) as depth from w group by 1""",
)
def modules_exposing(f):
    nation, region = f.t("nation"), f.t("region")
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("module"), F.col("r_name").alias("target"))
    b = f.t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("module"), F.col("n_name").alias("target"))
    start = region.filter("r_regionkey = 0").select(F.col("r_name").alias("node"))
    return graph.modules_exposing(a.union(b).distinct().withColumn("reExport", F.lit(True)), start)


# ---- search ------------------------------------------------------------------------------------------------------------


@query("search_names_substring", "select c_custkey, c_name as name from customer where contains(lower(c_name), '00001') order by name, c_custkey limit 50")
def search_names_substring(f):
    found = read.search_symbols(f.geography.filter("kind = 'method'"), term="00001")
    return found.select(key("c", to="c_custkey"), "name").orderBy("name", "c_custkey").limit(50)


@query("search_names_probe", "select count(*) > 50 as overflow, least(count(*), 51) as floor from customer where contains(lower(c_name), '1')")
def search_names_probe(f):
    found = read.search_symbols(f.geography.filter("kind = 'method'"), term="1").limit(51)
    return found.agg((F.count("*") > 50).alias("overflow"), F.count("*").alias("floor"))


@query("page_with_exact_count", "with h as (select p_partkey, p_name from part where contains(lower(p_name), 'a')) select p_partkey, (select count(*) from h) as total from h order by p_partkey limit 50")
def page_with_exact_count(f):
    hit = f.t("part").filter(text.mentions("p_name", "A")).select("p_partkey")
    return hit.orderBy("p_partkey").limit(50).crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))


@query("name_regex_flags", "select p_partkey from part where regexp_matches(p_name, '(?i)^[a-m].*E')")
def name_regex_flags(f):
    return f.t("part").filter(F.col("p_name").rlike(compile_pattern("/^[a-m].*E/i"))).select("p_partkey")


@query("literals_exact", "select p_partkey as factId from part where p_size = 7")
def literals_exact(f):
    return read.literals(f.literals, value="7").select("factId")


@query("literals_in_range", "select p_partkey as factId, cast(p_size as double) as number from part where p_size between 10 and 20")
def literals_in_range(f):
    return read.literals(f.literals, low=10, high=20).select("factId", "number")


@query("literals_regex", "select p_partkey as factId from part where regexp_matches(cast(p_size as varchar), '^1[0-5]$')")
def literals_regex(f):
    return read.literals(f.literals, pattern="/^1[0-5]$/").select("factId")


@query("shared_literals", "select cast(p_size as varchar) as value, 'number' as kind, count(distinct p_brand) as files, count(*) as uses from part group by p_size having count(distinct p_brand) >= 2 order by files desc, uses desc, value limit 50")
def shared_literals(f):
    return read.shared_literals(f.literals)


@query("html_comments", "select page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) as raw from pages")
def html_comments(f):
    return f.page_comments


@query("comment_search", "select page_id, count(*) as n from (select page_id, trim(unnest(regexp_extract_all(html, '<!--(.*?)-->', 1))) as normalized from pages) where contains(lower(normalized), 'ad') group by 1")
def comment_search(f):
    normal = f.page_comments.select("page_id", text.normalize_doc("raw").alias("normalized"), F.lit("standalone").alias("form"), F.lit("").alias("module"))
    return normal.filter(read.comment_filter(form="standalone", term="AD")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("html_links", """select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as specifier from pages""")
def html_links(f):
    return f.page_imports.select("page_id", "specifier")


@query("find_imports", """select page_id, specifier from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as specifier from pages) where contains(lower(specifier), '/th')""")
def find_imports(f):
    return read.find_imports(f.page_imports, specifier="/TH").select("page_id", "specifier")


@query("html_headings", "select page_id, unnest(regexp_extract_all(html, '<h1>(.*?)</h1>', 1)) as raw from pages")
def html_headings(f):
    return f.t("pages").select("page_id", F.explode(F.expr("regexp_extract_all(html, '<h1>(.*?)</h1>', 1)")).alias("raw"))


@query("doc_lines", "select doc_id, cast(i - 1 as integer) as ord, l as raw from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(l) <> ''")
def doc_lines(f):
    return f.doc_lines.select("doc_id", "ord", "raw")


@query("doc_normalize", "select doc_id, length(trim(regexp_replace(text, '[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'))) as n from documents")
def doc_normalize(f):
    return f.t("documents").select("doc_id", F.length(text.normalize_doc("text")).cast("long").alias("n"))


@query("doc_search", "select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) where trim(l) <> '' and contains(lower(regexp_replace(l, '[ \\t]+', ' ', 'g')), 'licensed under') group by 1")
def doc_search(f):
    regions = f.doc_lines.select("doc_id", text.normalize_doc("raw").alias("normalized"), F.lit(False).alias("fenced"), F.lit("").alias("module"))
    return regions.filter(read.doc_filter(fenced=False, term="Licensed UNDER")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("commits_mentioning", "select conv_id, turn from conversations where regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')")
def commits_mentioning(f):
    return history.mentioning(f.t("conversations"), "the", limit=None, text="text").select("conv_id", "turn")


@query("scope_globs", "select page_id from pages where regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*/en/(?:.*)$') and not regexp_matches(url, '#')")
def scope_globs(f):
    path = F.regexp_replace("url", "^https?://", "")
    return f.t("pages").filter(path.rlike(glob_pattern("*/en/**")) & ~F.col("url").contains("#") & path.rlike("/en/")).select("page_id")


@query("preview_lines", "select doc_id, cast(greatest(len(string_split(text, chr(10))) - 8, 0) as integer) as more from documents where text is not null")
def preview_lines(f):
    shown = F.regexp_extract(text.preview("text"), r"\n… (\d+) more lines$", 1)
    return f.t("documents").filter("text is not null").select("doc_id", F.coalesce(F.nullif(shown, F.lit("")).cast("int"), F.lit(0)).alias("more"))


# ---- totals ------------------------------------------------------------------------------------------------------------


@query("totals", "select 'symbols' as what, (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) as n union all select 'refs', count(*) from lineitem union all select 'literals', count(*) from part union all select 'files', count(*) from pages union all select 'commits', count(*) from orders")
def totals(f):
    return read.totals(symbols=f.geography, refs=f.t("lineitem"), literals=f.literals, files=f.t("pages"), commits=f.t("orders"))


@query("symbols_by_kind", "select 'namespace' as kind, count(*) as n from region union all select 'class', count(*) from nation union all select 'method', count(*) from customer union all select 'field', count(*) from supplier")
def symbols_by_kind(f):
    return read.symbols_by_kind(f.geography)


def _files(f):
    kind = F.when(F.col("source").isin("src0", "src1"), "code").when(F.col("source").isin("src2", "src3", "src4"), "document")
    return f.t("documents").select(F.col("doc_id").cast("string").alias("module"), kind.alias("content"), F.col("lang").alias("depth"))


@query(
    "content_totals",
    """select coalesce(case when source in ('src0', 'src1') then 'code' when source in ('src2', 'src3', 'src4') then 'document' end, 'unknown') as content,
        count(*) as files, cast(sum(n) as bigint) as symbols from (select source, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 0) as n from documents) group by 1""",
)
def content_totals(f):
    return read.content_totals(_files(f), f.doc_lines.select(F.col("doc_id").cast("string").alias("module")))


@query("depth_totals", "select lang as depth, count(*) as n from documents group by 1")
def depth_totals(f):
    return read.depth_totals(_files(f))


@query("module_summary", "select cast(doc_id as varchar) as module, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 0) as symbols from documents order by symbols desc, module limit 15")
def module_summary(f):
    return read.module_summary(f.doc_lines.select(F.col("doc_id").cast("string").alias("module")), _files(f), 15).select("module", "symbols")


@query(
    "overview",
    """select (select count(*) from documents) as files, (select count(*) from documents where source in ('src0', 'src1')) as code, (select count(*) from documents where source in ('src2', 'src3', 'src4')) as documents,
        (select count(*) from documents where source not in ('src0', 'src1', 'src2', 'src3', 'src4') or source is null) as unrecorded,
        (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) as symbols, cast(4 as bigint) as kinds,
        (select count(*) from lineitem) as "references", (select count(l_partkey) from lineitem) as bound, (select count(*) from part) as literals,
        (select count(*) from (select unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) from pages)) as comments, cast(0 as bigint) as anchored""",
)
def overview(f):
    return read.overview(_files(f), f.geography, f.refs, f.literals, f.page_comments.withColumn("anchorId", F.lit(None).cast("string")))


@query("comment_forms", "select case when contains(raw, 'ad') then 'leading' else 'standalone' end as form, count(*) as n, count(*) filter (contains(raw, '1')) as anchored from (select unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) as raw from pages) group by 1")
def comment_forms(f):
    return read.comment_forms(f.page_comments.select(F.when(F.contains("raw", F.lit("ad")), "leading").otherwise("standalone").alias("form"), F.when(F.contains("raw", F.lit("1")), F.lit("x")).alias("anchorId")))


@query("scan_breakdown", "select count(*) as tracked, count(*) filter (not d and not g and o = 1) as claimed, count(*) filter (not d and not g and o <> 1) as unclaimed, count(*) filter (not d and g) as generated, count(*) filter (d) as denied from (select source = 'src1' as d, source = 'src2' as g, case when lang = 'en' then 1 when lang = 'fr' then 2 else 0 end as o from documents)")
def scan_breakdown(f):
    owners = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(0)
    return read.scan_breakdown(f.t("documents").select((F.col("source") == "src1").alias("denied"), (F.col("source") == "src2").alias("generated"), owners.alias("owners")))


@query("note_totals", "select count(distinct doc_id) as modules, count(*) as notes from labels where quality = 0")
def note_totals(f):
    return read.note_totals(f.t("labels").filter("quality = 0").select(F.col("doc_id").alias("module")))


@query("kind_content_rollup", "select kind, module, count(*) as n from (select p_type as kind, p_brand as module from part) group by rollup (kind, module)")
def kind_content_rollup(f):
    return f.parts.rollup("kind", "module").agg(F.count("*").alias("n"))


# ---- history -----------------------------------------------------------------------------------------------------------


@query(
    "co_change",
    """with w as (select distinct l_orderkey c, l_partkey f from lineitem), ok as (select c from w group by c having count(*) <= 40), t as (select min(f) f from w),
       h as (select w.c from w join t on w.f = t.f join ok on ok.c = w.c)
       select w.f as module, count(*) as together, (select count(*) from h) as outOf from w join h on w.c = h.c where w.f <> (select f from t) group by w.f""",
)
def co_change(f):
    return history.co_changed(f.changes, f.changes.agg(F.min("path").alias("path")))


@query("skipped_wide", "select count(*) as skippedWideCommits from (select l_orderkey from lineitem group by 1 having count(*) > 6)")
def skipped_wide(f):
    return history.skipped_wide(f.changes, 6)


@query(
    "file_history",
    """with o as (select min_by(o_orderkey, (o_orderdate, o_orderkey)) as k from orders)
       select l_partkey as path, count(distinct l_orderkey) as commits, cast(sum(cast(l_quantity as bigint)) as bigint) as linesAdded, min(o_orderdate) as firstSeen, max(o_orderdate) as lastTouched,
        bool_or(l_orderkey = (select k from o)) as truncated from lineitem join orders on l_orderkey = o_orderkey group by 1""",
)
def file_history(f):
    return history.file_history(f.changes, f.commits).select("path", "commits", "linesAdded", "firstSeen", "lastTouched", "truncated")


@query(
    "file_history_recent",
    """select path, list_sum(list_transform(r, lambda x: x.hash)) ::bigint as hashes, len(r) as n from (select path, list({'hash': hash}) as r from (select l_partkey as path, l_orderkey as hash,
        row_number() over (partition by l_partkey order by o_orderdate desc, l_orderkey desc, l_linenumber) as rn from lineitem join orders on l_orderkey = o_orderkey) where rn <= 20 group by path)""",
)
def file_history_recent(f):
    got = history.file_history(f.changes, f.commits)
    return got.select("path", F.aggregate("recent", F.lit(0).cast("long"), lambda a, x: a + x["hash"]).alias("hashes"), F.size("recent").cast("long").alias("n"))


# ---- feed, invalidation ------------------------------------------------------------------------------------------------


@query("event_coalesce", "select user_id as module, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def event_coalesce(f):
    feed = f.t("events").select(F.col("user_id").alias("module"), "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return ingest.coalesce(feed, "seq").select("module", "event_id", "event_type")


@query(
    "invalidation_decision",
    """with last as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1),
       held as (select user_id, max(props) as h from events group by 1)
       select l.user_id as module, case when l.event_type = 'purchase' then 'forget' when l.props = held.h then 'ignore' when l.user_id % 7 = 0 then 'ignore' else 'reindex' end as action,
        case when l.event_type = 'purchase' then null when l.props = held.h then 'unchanged' when l.user_id % 7 = 0 then 'unclaimed' end as reason from last l left join held using (user_id)""",
)
def invalidation_decision(f):
    feed = f.t("events").select(
        F.col("user_id").alias("module"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "deleted").otherwise("changed").alias("kind"), F.col("props").alias("contentHash"),
        F.when(F.col("user_id") % 7 == 0, 0).otherwise(1).alias("owners"),
    )
    files = f.t("events").groupBy(F.col("user_id").alias("module")).agg(F.max("props").alias("contentHash"))
    return ingest.decide(ingest.coalesce(feed, "seq"), files).select("module", "action", "reason")


@query(
    "debounce_sessions",
    """select user_id, sid, count(*) as n, min(ts) as start from (select user_id, ts, cast(sum(brk) over (partition by user_id order by ts, event_id) as bigint) as sid from (
        select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '30' minute then 0 else 1 end as brk from events)) group by 1, 2""",
)
def debounce_sessions(f):
    got = ingest.bursts(f.t("events"), ["user_id"], "ts", "event_id", "30 minutes")
    return got.select("user_id", "sid", "n", "start")


@query(
    "session_windows",
    """select user_id, min(ts) as start, count(*) as n from (select user_id, ts, cast(sum(brk) over (partition by user_id order by ts, event_id) as bigint) as sid from (
        select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30' minute then 0 else 1 end as brk from events)) group by user_id, sid""",
)
def session_windows(f):
    return f.t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query(
    "content_hash_skip",
    "select doc_id as module from documents where doc_id % 2 = 1 or doc_id % 3 = 0",
)
def content_hash_skip(f):
    """Files whose text changed, or that were only outlined: every even document is unchanged, every third was an outline."""
    now = f.t("documents").select(F.col("doc_id").alias("module"), ids.content_hash(F.coalesce("text", F.lit(""))).alias("contentHash"), F.lit("full").alias("depth"))
    edited = F.when(F.col("doc_id") % 2 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit("")))
    held = f.t("documents").select(F.col("doc_id").alias("module"), ids.content_hash(edited).alias("contentHash"), F.when(F.col("doc_id") % 3 == 0, "outline").otherwise("full").alias("depth"))
    return ingest.needs_indexing(now, held).select("module")


@query("json_flatten_props", "select event_id, json_extract_string(props, '$.k') as v from events")
def json_flatten_props(f):
    return f.t("events").select("event_id", F.get_json_object("props", "$.k").alias("v"))


@query("json_literal_typing", "select event_id, case json_type(props, '$.k') when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' else 'number' end as kind, cast(json_extract_string(props, '$.k') as double) as number from events")
def json_literal_typing(f):
    v = F.try_variant_get(F.parse_json("props"), "$.k", "variant")
    kind = F.schema_of_variant(v)
    return f.t("events").select(
        "event_id", F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number").alias("kind"), F.try_variant_get(F.parse_json("props"), "$.k", "double").alias("number")
    )


# ---- identity ----------------------------------------------------------------------------------------------------------


@query("fact_id_digest", "select doc_id, substr(sha256(concat('3:=doc', strlen(cast(doc_id as varchar)), ':=', doc_id, case when text is null then '0:-' else concat(strlen(text), ':=', text) end)), 1, 16) as digest from documents")
def fact_id_digest(f):
    return f.t("documents").select("doc_id", ids.digest_column(F.lit("doc"), "doc_id", "text").alias("digest"))


@query("duplicate_facts", "select digest, count(*) as n from (select substr(sha256(text), 1, 32) as digest from documents where text is not null) group by 1 having count(*) > 1")
def duplicate_facts(f):
    return f.t("documents").filter("text is not null").groupBy(ids.content_hash("text").alias("digest")).agg(F.count("*").alias("n")).filter("n > 1")


@query("occurrence_numbering", "select p_partkey, cast(row_number() over (partition by p_type order by p_size, p_partkey) as integer) as occurrence from part")
def occurrence_numbering(f):
    return read.occurrence_numbers(f.t("part"), ["p_type"], ["p_size", "p_partkey"]).select("p_partkey", "occurrence")


@query("line_runs_islands", "select l_orderkey, min(l_linenumber) as firstLine, max(l_linenumber) as lastLine, count(*) as lines from (select l_orderkey, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag <> 'N')) group by l_orderkey, g")
def line_runs_islands(f):
    return read.line_runs(f.t("lineitem").filter("l_returnflag <> 'N'"), ["l_orderkey"], "l_linenumber")


@query("per_kind_cap", "select kind, factId, n > 40 as truncated from (select event_type as kind, event_id as factId, row_number() over (partition by event_type order by event_id) rn, count(*) over (partition by event_type) n from events) where rn <= 40")
def per_kind_cap(f):
    return read.per_kind_cap(f.t("events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("factId")), "kind", ["factId"], 40)


@query("admission", "select l_orderkey as module, count(*) as violations from (select l_orderkey, l_partkey from lineitem group by 1, 2 having count(*) > 1) group by 1")
def admission(f):
    rows = f.t("lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").cast("string").alias("symbolId"))
    return ingest.repeated_ids(rows).groupBy("module").agg(F.count("*").alias("violations"))


@query("admission_containers", "select o_orderkey as module from orders left join customer on c_custkey = o_custkey + 10 where c_custkey is null")
def admission_containers(f):
    rows = f.t("orders").select(F.col("o_orderkey").alias("module"), (F.col("o_custkey") + 10).alias("containerId"))
    return ingest.unknown_containers(rows, f.t("customer").select(F.col("c_custkey").alias("symbolId"))).select("module")


@query("route_claims", "select page_id, case when contains(url, '/en/') and not contains(url, '/de/') then 'english' when contains(url, '/fr/') then 'french' end as provider, cast((contains(url, '/en/'))::int + (contains(url, '/fr/'))::int as integer) as owners from pages")
def route_claims(f):
    claims = f.spark.createDataFrame([("english", "en"), ("french", "fr")], "provider string, extension string")
    lang = F.when(F.contains("url", F.lit("/en/")), "en").when(F.contains("url", F.lit("/fr/")), "fr")
    got = ingest.route(f.t("pages").select("page_id", lang.alias("extension"), F.col("url").alias("module")), claims, key="page_id")
    return got.select("page_id", "provider", F.col("owners").cast("int").alias("owners"))


# ---- knowledge ---------------------------------------------------------------------------------------------------------


@query(
    "fact_set_for_subject",
    """with p as (select min(p_partkey) as k from part),
       u as (select 'declaration' as kind, 'p' || k as factId from p union all select 'reference', l_orderkey || ':' || l_linenumber from lineitem, p where l_partkey = k
        union all select 'literal', 'size' || p_size from part, p where p_partkey = k),
       r as (select *, row_number() over (partition by kind order by factId) rn, count(*) over (partition by kind) n from u)
       select kind, factId, n > 10 as truncated from r where rn <= 10""",
)
def fact_set_for_subject(f):
    subject = f"p{f.t('part').agg(F.min('p_partkey')).first()[0]}"
    symbols = f.parts.withColumn("factId", F.col("symbolId"))
    refs = f.t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("targetId"), F.lit(None).cast("string").alias("fromId"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("factId"))
    lits = f.t("part").select(F.concat(F.lit("p"), "p_partkey").alias("containerId"), F.concat(F.lit("size"), "p_size").alias("factId"))
    return knowledge.facts_for(subject, {"symbols": symbols, "refs": refs, "literals": lits}, cap=10)


@query("citation_resolve", "select doc_id from labels l where exists (select 1 from documents d where d.doc_id = l.doc_id and d.source <> 'src3')")
def citation_resolve(f):
    cites = f.t("labels").select("doc_id", F.col("doc_id").alias("factId"))
    return knowledge.resolve(cites, f.t("documents").filter("source <> 'src3'").select(F.col("doc_id").alias("factId"))).select("doc_id")


_TURNS = "t as (select conv_id || ':' || turn as id, case when turn > 0 then conv_id || ':' || (turn - 1) end as cites, role, text, turn from conversations)"


@query("stale_answers", f"with {_TURNS} select id as answerId, cast(1 as bigint) as gone from t where cites is not null and not exists (select 1 from t u where u.id = t.cites and u.role = 'user')")
def stale_answers(f):
    facts = f.turns.filter("role = 'user'")
    return knowledge.stale_answers(f.turns, facts)


@query(
    "staleness_cascade",
    f"""with recursive {_TURNS}, s as (select id, cites, cites is not null and not exists (select 1 from t u where u.id = t.cites) or contains(text, 'ndti') as stale, contains(text, 'thre') as doubted from t),
       up(id, source, d) as (select s.id, u.id, 1 from s join s u on u.id = s.cites union all select up.id, u.id, d + 1 from up join s x on x.id = up.source join s u on u.id = x.cites where d < 60)
       select s.id as answerId, s.stale, coalesce(bool_or(u.stale), false) as inheritedStale, coalesce(bool_or(u.doubted), false) as doubtedUpstream from s left join up on up.id = s.id left join s u on u.id = up.source group by 1, 2""",
)
def staleness_cascade(f):
    """A turn is stale if it cites a turn that isn't there; turns with one word are made to cite a missing fact, with another to be doubted."""
    extra = F.when(F.contains("text", F.lit("ndti")), F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    answers = f.turns.withColumns({"citations": F.concat("citations", extra), "doubtId": F.when(F.contains("text", F.lit("thre")), F.lit("d"))})
    return knowledge.cascade(answers, f.turns)


@query("answer_counts", "select role as model, count(*) as answers, count(*) filter (contains(text, 'thre')) as doubted from conversations group by 1")
def answer_counts(f):
    return knowledge.answer_counts(f.turns.select(F.col("role").alias("model"), F.when(F.contains("text", F.lit("thre")), F.lit("d")).alias("doubtId")))


@query("gap_ledger", "select user_id, event_type, count(*) as askCount, max(ts) as lastAsked from events group by 1, 2")
def gap_ledger(f):
    return knowledge.ask_ledger(f.t("events"), ["user_id", "event_type"], "ts")


@query(
    "gaps_ranked",
    """with g as (select user_id as symbolId, event_type as question, count(*) as askCount, max(ts) as lastAsked from events group by 1, 2),
       a as (select c_custkey as symbolId, 'click' as question, c_acctbal < 0 as stale from customer where c_nationkey < 12), fi as (select o_custkey as symbolId, count(*) as fanIn from orders group by 1)
       select g.*, coalesce(fanIn, 0) as fanIn, case when a.stale then 'recheck' else 'missing' end as state from g left join a using (symbolId, question) left join fi using (symbolId) where a.symbolId is null or a.stale""",
)
def gaps_ranked(f):
    gaps = knowledge.ask_ledger(f.t("events").select(F.col("user_id").alias("symbolId"), F.col("event_type").alias("question"), "ts"), ["symbolId", "question"], "ts")
    answers = f.t("customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("symbolId"), F.lit("click").alias("question"), F.col("c_custkey").alias("factId"))
    stale = f.t("customer").filter("c_nationkey < 12 and c_acctbal < 0").select(F.col("c_custkey").alias("answerId"))
    return knowledge.gaps_ranked(gaps, answers, stale, f.t("orders").select(F.col("o_custkey").alias("targetId")))


@query(
    "migrate_keys",
    """with k as (select distinct user_id as u, event_type as q from events), m as (select distinct user_id as o, user_id + 3 as n from events where user_id % 5 = 0)
       select u as symbolId, q as question from k where u not in (select o from m) union all
       select m.n, k.q from k join m on k.u = m.o where not exists (select 1 from k x where x.u = m.n and x.q = k.q)""",
)
def migrate_keys(f):
    rows = f.t("events").select(F.col("user_id").alias("symbolId"), F.col("event_type").alias("question")).distinct()
    moves = f.t("events").filter("user_id % 5 = 0").select(F.col("user_id").alias("oldKey"), (F.col("user_id") + 3).alias("newKey")).distinct()
    return knowledge.migrate_keys(rows, moves, "symbolId", ["question"])


# ---- refactoring -------------------------------------------------------------------------------------------------------


@query(
    "interval_position_lookup",
    """with s as (select l_orderkey as module, l_returnflag as id, min(l_linenumber) as a, max(l_linenumber) as b from lineitem group by 1, 2)
       select l.l_orderkey || ':' || l.l_linenumber as id, arg_max(s.id, (s.a, -s.b, s.id)) as symbolId from (select distinct l_orderkey, l_linenumber from lineitem) l join s on s.module = l.l_orderkey and l.l_linenumber between s.a and s.b group by 1""",
)
def interval_position_lookup(f):
    lines = f.t("lineitem").select(F.col("l_orderkey").alias("module"), "l_returnflag", "l_linenumber")
    points = lines.select(F.concat_ws(":", "module", "l_linenumber").alias("id"), "module", F.col("l_linenumber").alias("line"), F.lit(0).alias("char")).distinct()
    spans = lines.groupBy("module", F.col("l_returnflag").alias("symbolId")).agg(F.min("l_linenumber").alias("startLine"), F.lit(0).alias("startChar"), F.max("l_linenumber").alias("endLine"), F.lit(0).alias("endChar"))
    return read.innermost(points, spans)


@query("as_of_nearest_declaration", "select event_id, lead(event_id) over (partition by user_id order by ts, event_id) as anchor from events")
def as_of_nearest_declaration(f):
    return ingest.nearest_below(f.t("events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "anchor")


@query(
    "impact_diff",
    """with b as (select l_returnflag || l_linestatus as k, l_partkey % 100 as m, count(*) as n from lineitem where l_linenumber <= 3 group by 1, 2),
       a as (select l_returnflag || l_linestatus as k, l_partkey % 100 as m, count(*) as n from lineitem where l_linenumber > 3 group by 1, 2)
       select a.k as name, a.m as module, coalesce(b.n, 0) as was, a.n as now from a left join b using (k, m) where a.n > coalesce(b.n, 0)""",
)
def impact_diff(f):
    rows = f.t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("l_partkey") % 100).alias("module"), "l_linenumber")
    return refactor.increases(rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber > 3"), ["name", "module"])


@query("rename_sites", "select module, count(*) as sites from (select p_brand as module from part union all select 's' || l_suppkey from lineitem union all select p_brand from part where p_size > 10) group by 1")
def rename_sites(f):
    one = lambda t, c: t.select(F.col(c).alias("module"))
    return refactor.sites_by_module(one(f.t("part"), "p_brand"), one(f.refs, "module"), one(f.t("part").filter("p_size > 10"), "p_brand"))


@query("name_collisions", "select distinct p_brand as module, p_type as name from part where exists (select 1 from part q where q.p_brand = part.p_brand and q.p_type = part.p_type and q.p_partkey <> part.p_partkey)")
def name_collisions(f):
    symbols = f.parts.select("module", F.col("kind").alias("name"), "symbolId")
    return refactor.collisions(symbols)


@query(
    "move_dependencies",
    """with s as (select o_orderkey, cast(extract('day' from o_orderdate) as integer) % 3 + 1 as a from orders)
       select l_orderkey as module, count(*) as inside, count(*) filter (l_returnflag = 'R') as unbound from lineitem join s on o_orderkey = l_orderkey and l_linenumber between a and a + 2 group by 1""",
)
def move_dependencies(f):
    body = f.t("orders").select(F.col("o_orderkey").alias("module"), (F.dayofmonth("o_orderdate") % 3 + 1).alias("startLine")).withColumns({"startChar": F.lit(0), "endLine": F.col("startLine") + 2, "endChar": F.lit(1 << 30)})
    refs = f.t("lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("startLine"), F.lit(0).alias("startChar"), (F.col("l_returnflag") == "R").alias("unbound"))
    inside = refactor.refs_inside(refs, body)
    return inside.groupBy("module").agg(F.count("*").alias("inside"), F.count_if("unbound").alias("unbound"))


@query("unbound_tally", "select l_returnflag as role, l_linestatus as name, count(*) as n, min(l_shipdate) as reason from lineitem where l_discount > 0.05 group by 1, 2")
def unbound_tally(f):
    rows = f.t("lineitem").filter("l_discount > 0.05").select(F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("name"), F.col("l_shipdate").alias("reason"))
    return refactor.unbound_tally(rows)


@query("binding_coalesce", "select count(*) as n from (select c_name as name, case when c_nationkey % 2 = 0 then n_name end as local from customer join nation on n_nationkey = c_nationkey) where coalesce(local, name) = (select min(n_name) from nation where n_nationkey % 2 = 0)")
def binding_coalesce(f):
    nation = f.t("nation")
    rows = f.t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("n_name")).alias("localName"))
    local = nation.filter("n_nationkey % 2 = 0").agg(F.min("n_name")).first()[0]
    return read.imports_binding(rows, local).agg(F.count("*").alias("n"))


@query("null_safe_exclusion", "select count(*) as n from orders left join lineitem on o_orderkey = l_orderkey where l_partkey is distinct from 5")
def null_safe_exclusion(f):
    rows = f.t("orders").join(f.t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.lit("x").alias("name"), F.col("l_partkey").cast("string").alias("targetId"))
    return read.spelled_elsewhere(rows, "x", "5").agg(F.count("*").alias("n"))


@query("blob_gc", "select p_partkey as hash from part where p_partkey not in (select l_partkey from lineitem where l_linenumber = 7 and l_returnflag = 'A' and l_partkey is not null union select l_partkey from lineitem where l_linenumber = 7 and l_returnflag = 'R' and l_partkey is not null)")
def blob_gc(f):
    used = lambda flag: f.t("lineitem").filter((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == 7)).select(F.col("l_partkey").alias("hash"))
    return refactor.garbage(f.t("part").select(F.col("p_partkey").alias("hash")), used("A"), used("R"))


@query("multi_project_union", "select 'customers' as project, count(*) as n from customer union all select 'suppliers', count(*) from supplier")
def multi_project_union(f):
    return read.union_projects(customers=f.t("customer").agg(F.count("*").alias("n")), suppliers=f.t("supplier").agg(F.count("*").alias("n")))


@query("specifier_resolution", """with i as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as s from pages), m as (select distinct regexp_replace(url, '^https?://[^/]*', '') as module from pages)
       select page_id, s as specifier, case when m.module is not null then 'resolved' when starts_with(s, '/') then 'unresolved' else 'external' end as status from i left join m on m.module = i.s""")
def specifier_resolution(f):
    known = f.t("pages").select(F.regexp_replace("url", "^https?://[^/]*", "").alias("module")).distinct()
    return ingest.resolve_specifiers(f.page_imports.select("page_id", "specifier"), known).select("page_id", "specifier", "status")


@query(
    "extracted_html_symbols",
    """select 'p/' || page_id || '.html' as module, cast(len(regexp_extract_all(html, '<h[1-6]\\b[^>]*>')) as integer) as declarations, cast(len(regexp_extract_all(html, '<(?:a|link)\\b[^>]*?\\bhref="')) as integer) as imports,
        cast(len(regexp_extract_all(html, '<!--')) as integer) as comments, 0 as literals,
        cast(len(list_filter(regexp_extract_all(html, '<(?:p|li|td|blockquote|pre|div|footer)\\b[^>]*>([^<]*)', 1), lambda x: trim(x) <> '')) as integer) as docs from pages""",
)
def extracted_html_symbols(f):
    """Headings, comments and links of every page by the HTML extractor."""
    from lodestrata.sources.extract import extract

    files = f.t("pages").select(F.concat(F.lit("p/"), F.col("page_id"), F.lit(".html")).alias("module"), F.col("html").alias("text"))
    facts = extract(files)
    return facts.select("module", F.size("declarations").alias("declarations"), F.size("imports").alias("imports"), F.size("comments").alias("comments"), F.size("docs").alias("docs"), F.size("literals").alias("literals"))


from lodestrata.plans import library  # noqa: E402, F401  (registers the rest)
