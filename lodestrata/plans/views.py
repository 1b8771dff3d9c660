"""The driver's tables seen as facts, so that the fact operators run over them unchanged.

region > nation > customer, supplier are containers and leaves of one module; parts are the targets that order lines refer
to; orders are commits and their lines the files that changed; pages hold comments, headings and links; events are the
change feed; conversation turns cite the turn before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class Facts:
    """Lazy views over one directory of tables; each property reads only the columns that its facts need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def geography(self) -> DataFrame:
        """Symbols: regions, nations, customers and suppliers, each in its container."""
        none = F.lit(None).cast("string")
        one = lambda t, i, n, kind, c: t.select(i.alias("symbolId"), F.col(n).alias("name"), F.lit(kind).alias("kind"), c.alias("containerId"), F.lit("geo").alias("module"))
        return (
            one(self.t("region"), _id("r", "r_regionkey"), "r_name", "namespace", none)
            .union(one(self.t("nation"), _id("n", "n_nationkey"), "n_name", "class", _id("r", "n_regionkey")))
            .union(one(self.t("customer"), _id("c", "c_custkey"), "c_name", "method", _id("n", "c_nationkey")))
            .union(one(self.t("supplier"), _id("s", "s_suppkey"), "s_name", "field", _id("n", "s_nationkey")))
        )

    @property
    def parts(self) -> DataFrame:
        return self.t("part").select(
            _id("p", "p_partkey").alias("symbolId"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.lit(None).cast("string").alias("containerId"), F.col("p_brand").alias("module")
        )

    @property
    def order_symbols(self) -> DataFrame:
        return self.t("orders").select(
            _id("o", "o_orderkey").alias("symbolId"), F.col("o_orderpriority").alias("name"), F.lit("function").alias("kind"), _id("c", "o_custkey").alias("containerId"), F.lit("orders").alias("module")
        )

    @property
    def customer_symbols(self) -> DataFrame:
        return self.t("customer").select(
            _id("c", "c_custkey").alias("symbolId"), F.col("c_name").alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("containerId"), F.lit("orders").alias("module")
        )

    @property
    def refs(self) -> DataFrame:
        """References from orders to parts; the role is call for returned lines, else read."""
        return self.t("lineitem").select(
            _id("p", "l_partkey").alias("targetId"), _id("o", "l_orderkey").alias("fromId"), F.when(F.col("l_returnflag") == "R", "call").otherwise("read").alias("role"),
            _id("s", "l_suppkey").alias("module"), F.col("l_linenumber").alias("startLine"), F.concat("l_returnflag", "l_linestatus").alias("name"),
        )

    @property
    def literals(self) -> DataFrame:
        return self.t("part").select(F.col("p_size").cast("string").alias("value"), F.lit("number").alias("kind"), F.col("p_size").cast("double").alias("number"), F.col("p_brand").alias("module"), F.col("p_partkey").alias("factId"))

    @property
    def changes(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))

    @property
    def commits(self) -> DataFrame:
        return self.t("orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("message"))

    @property
    def page_imports(self) -> DataFrame:
        href = F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"))
        return self.t("pages").select("page_id", F.col("url").alias("module"), href.alias("specifier"))

    @property
    def page_comments(self) -> DataFrame:
        return self.t("pages").select("page_id", F.explode(F.expr("regexp_extract_all(html, '<!--(.*?)-->', 1)")).alias("raw"))

    @property
    def doc_lines(self) -> DataFrame:
        lines = self.t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "raw"))
        return lines.filter(F.trim("raw") != "")

    @property
    def nation_edges(self) -> DataFrame:
        """Supplier's nation -> customer's nation of each line, with the number of lines."""
        supplier, customer = self.t("supplier").select("s_suppkey", F.col("s_nationkey").alias("a")), self.t("customer").select("c_custkey", F.col("c_nationkey").alias("b"))
        lines = self.t("lineitem").select("l_orderkey", "l_suppkey").join(self.t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        per = lines.groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("k"))
        return per.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("a", "b").agg(F.sum("k").alias("n"))

    @property
    def turns(self) -> DataFrame:
        """Answers: each turn is one, citing the turn before it."""
        return self.t("conversations").select(
            F.format_string("%d:%d", "conv_id", "turn").alias("factId"),
            F.when(F.col("turn") > 0, F.array(F.format_string("%d:%d", F.col("conv_id"), F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("citations"),
            "conv_id", "turn", "role", "text",
        )
