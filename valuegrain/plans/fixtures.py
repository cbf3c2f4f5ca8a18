"""Views over the driver's tables that the registered queries start from.

The same SELECTs run in Spark and, for the oracles, in DuckDB; only two functions differ by name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuegrain.sources.staging import prepared, stage
from valuegrain.sources.tables import table

DIALECTS = {
    "duckdb": {"epoch": lambda x: f"CAST(epoch({x}) AS BIGINT)", "sha": lambda x: f"sha256({x})"},
    "spark": {"epoch": lambda x: f"(CAST(unix_date(CAST({x} AS DATE)) AS BIGINT) * 86400 + hour({x}) * 3600 + minute({x}) * 60 + CAST(second({x}) AS INT))", "sha": lambda x: f"sha2({x}, 256)"},
}
#: A line's number in its order: (l_orderkey, l_linenumber) repeats, so it is counted.
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"


def views(dialect: str) -> dict[str, str]:
    """SELECTs by name; later ones use earlier ones."""
    epoch, sha = DIALECTS[dialect]["epoch"], DIALECTS[dialect]["sha"]
    null = lambda t: f"CAST(NULL AS {t})"
    return {
        "fx_lines": f"""SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS n, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
            {epoch('l_shipdate')} AS shipped, {epoch('o_orderdate')} AS ordered, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "fx_gaps": "SELECT k, n, c, shipped - ordered AS secs FROM fx_lines WHERE shipped >= ordered",
        "fx_sums": "SELECT k, max(c) AS c, sum(secs) AS secs FROM fx_gaps GROUP BY k HAVING count(*) BETWEEN 2 AND 26",
        "fx_customers": "SELECT c, sum(secs) AS secs FROM fx_sums GROUP BY c HAVING count(*) BETWEEN 2 AND 26",
        "fx_places": "SELECT DISTINCT c_nationkey AS nk, n_regionkey AS rk FROM fx_customers JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        "fx_nodes": f"""
            SELECT concat('O:', CAST(o_orderkey AS VARCHAR(20))) AS id, 'ROOT' AS node_type, 'DATE' AS value_kind, {null('DOUBLE')} AS number_val, {epoch('o_orderdate')} AS date_secs, {null('BIGINT')} AS duration_secs, o_orderkey AS source_id, 1 AS line_number FROM orders
            UNION ALL SELECT concat('S:', CAST(k AS VARCHAR(20)), ':', CAST(n AS VARCHAR(20))), 'ROOT', 'DATE', {null('DOUBLE')}, shipped, {null('BIGINT')}, k, CAST(n + 1 AS INT) FROM fx_lines
            UNION ALL SELECT concat('P:', CAST(k AS VARCHAR(20)), ':', CAST(n AS VARCHAR(20))), 'ROOT', 'NUMBER', price, {null('BIGINT')}, {null('BIGINT')}, k, CAST(n + 1 AS INT) FROM fx_lines
            UNION ALL SELECT concat('D:', CAST(k AS VARCHAR(20)), ':', CAST(n AS VARCHAR(20))), 'DERIVED', 'DURATION', {null('DOUBLE')}, {null('BIGINT')}, secs, {null('BIGINT')}, {null('INT')} FROM fx_gaps
            UNION ALL SELECT concat('T:', CAST(k AS VARCHAR(20))), 'DERIVED', 'DURATION', {null('DOUBLE')}, {null('BIGINT')}, CAST(secs AS BIGINT), {null('BIGINT')}, {null('INT')} FROM fx_sums
            UNION ALL SELECT concat('C:', CAST(c AS VARCHAR(20))), 'DERIVED', 'DURATION', {null('DOUBLE')}, {null('BIGINT')}, CAST(secs AS BIGINT), {null('BIGINT')}, {null('INT')} FROM fx_customers
            UNION ALL SELECT DISTINCT concat('N:', CAST(nk AS VARCHAR(20))), 'DERIVED', 'NUMBER', CAST(nk AS DOUBLE), {null('BIGINT')}, {null('BIGINT')}, {null('BIGINT')}, {null('INT')} FROM fx_places
            UNION ALL SELECT DISTINCT concat('R:', CAST(rk AS VARCHAR(20))), 'DERIVED', 'NUMBER', CAST(rk AS DOUBLE), {null('BIGINT')}, {null('BIGINT')}, {null('BIGINT')}, {null('INT')} FROM fx_places""",
        "fx_links": """
            SELECT concat('O:', CAST(k AS VARCHAR(20))) AS parent_id, concat('D:', CAST(k AS VARCHAR(20)), ':', CAST(n AS VARCHAR(20))) AS child_id, 'DATE_DIFF' AS operation FROM fx_gaps
            UNION ALL SELECT concat('S:', CAST(k AS VARCHAR(20)), ':', CAST(n AS VARCHAR(20))), concat('D:', CAST(k AS VARCHAR(20)), ':', CAST(n AS VARCHAR(20))), 'DATE_DIFF' FROM fx_gaps
            UNION ALL SELECT concat('D:', CAST(g.k AS VARCHAR(20)), ':', CAST(g.n AS VARCHAR(20))), concat('T:', CAST(g.k AS VARCHAR(20))), 'DURATION_SUM' FROM fx_gaps g JOIN fx_sums s ON g.k = s.k
            UNION ALL SELECT concat('T:', CAST(s.k AS VARCHAR(20))), concat('C:', CAST(s.c AS VARCHAR(20))), 'DURATION_SUM' FROM fx_sums s JOIN fx_customers u ON s.c = u.c
            UNION ALL SELECT concat('C:', CAST(c AS VARCHAR(20))), concat('N:', CAST(c_nationkey AS VARCHAR(20))), 'EXPRESSION' FROM fx_customers JOIN customer ON c = c_custkey
            UNION ALL SELECT concat('N:', CAST(nk AS VARCHAR(20))), concat('R:', CAST(rk AS VARCHAR(20))), 'EXPRESSION' FROM fx_places""",
        "fx_edges": "SELECT row_number() OVER (PARTITION BY child_id ORDER BY parent_id) AS edge_id, parent_id, child_id, operation, CASE WHEN operation = 'EXPRESSION' THEN 'a' END AS expression FROM fx_links",
        "fx_sources": f"""SELECT o_orderkey AS source_id, concat('orders/', CAST(o_orderkey AS VARCHAR(20)), '.csv') AS file_path, {epoch('o_orderdate')} AS checked, {sha("concat(o_orderstatus, CAST(" + epoch('o_orderdate') + " AS VARCHAR(20)))")} AS content_hash FROM orders""",
        "fx_seeds": "SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 41 = 0 THEN 'FILE_DELETED' ELSE 'SOURCE_FILE_MODIFIED' END AS reason FROM orders WHERE o_orderkey % 37 = 0 OR o_orderkey % 41 = 0",
    }


def ctes(*last: str) -> str:
    """DuckDB WITH clause of the views."""
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in [*views("duckdb").items()]) + (",\n" + ",\n".join(last) if last else "")


INPUTS = ("orders", "lineitem", "customer", "nation")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    prepared(spark)
    parts, wanted = views("spark"), []
    for k in parts:
        wanted.append(k)
        if k == name:
            break
    text = "WITH " + ",\n".join(f"{k} AS ({parts[k]})" for k in wanted) + f"\nSELECT * FROM {name}"
    tables = {t: table(spark, sf_dir, t) for t in INPUTS}
    for t in INPUTS:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    used = {t: df for t, df in tables.items() if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_lines``, staged: the join and the numbering of lines are the dear part of every other view."""
    return stage(view(spark, sf_dir, "fx_lines"), "lines")


def _name(kind: str, *parts: str) -> Column:
    return F.concat(F.lit(kind), *[x for i, p in enumerate(parts) for x in ([F.lit(":")] if i else []) + [F.col(p).cast("string")]])


#: Kinds of nodes, and of edges by their children, in the order of the views.
KINDS, CHILDREN = "OSPDTCNR", "DTCNR"


class Graph:
    """The nodes and edges of the views, made from one pass over the lines; only the kinds asked for are made.

    ``fx_nodes`` and ``fx_edges`` say what they are; the tests compare both with them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepared(spark), sf_dir
        self._known: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._known:
            self._known[name] = stage(make(), name)
        return self._known[name]

    def lines(self) -> DataFrame:
        return self._once("lines", lambda: view(self.spark, self.sf_dir, "fx_lines").select("k", "n", "c", "price", "shipped", "ordered"))

    def gaps(self) -> DataFrame:
        return self.lines().filter("shipped >= ordered").select("k", "n", "c", (F.col("shipped") - F.col("ordered")).alias("secs"))

    def sums(self) -> DataFrame:
        return self._once("sums", lambda: self.gaps().groupBy("k").agg(F.max("c").alias("c"), F.sum("secs").alias("secs"), F.count("*").alias("m")).filter("m between 2 and 26").drop("m"))

    def customers(self) -> DataFrame:
        return self._once("customers", lambda: self.sums().groupBy("c").agg(F.sum("secs").alias("secs"), F.count("*").alias("m")).filter("m between 2 and 26").drop("m"))

    def _nations(self) -> DataFrame:
        """(c, nk) of the customers that have a value."""
        return self.customers().join(table(self.spark, self.sf_dir, "customer"), F.col("c") == F.col("c_custkey")).select("c", F.col("c_nationkey").alias("nk"))

    def _places(self) -> DataFrame:
        nation = table(self.spark, self.sf_dir, "nation")
        return self._once("places", lambda: self._nations().join(nation, F.col("nk") == F.col("n_nationkey")).select("nk", F.col("n_regionkey").alias("rk")).distinct())

    def _seeds(self) -> DataFrame:
        return view(self.spark, self.sf_dir, "fx_seeds").select(F.col("source_id").alias("_s"), "reason")

    def _made(self, kind: str, seeded: bool = False) -> DataFrame:
        """Nodes of a kind; ``seeded``: those of seeded sources are stale. Seeds meet numbers, before ids are made of them."""
        null = lambda t: F.lit(None).cast(t)
        row = lambda df, id, of, what, number=null("double"), date=null("bigint"), secs=null("bigint"), source=null("bigint"), line=null("int"): df.select(  # noqa: E731, A002
            id.alias("id"), F.lit(of).alias("node_type"), F.lit(what).alias("value_kind"), number.alias("number_val"), F.timestamp_seconds(date).alias("date_val"), secs.cast("bigint").alias("duration_secs"), source.alias("source_id"), line.cast("int").alias("line_number"),
            (F.col("_s").isNotNull() if seeded and of == "ROOT" else F.lit(False)).alias("is_stale"), (F.col("reason") if seeded and of == "ROOT" else F.lit(None).cast("string")).alias("stale_reason"),
        )
        c = F.col
        with_seeds = lambda df: df.join(self._seeds(), c("k") == c("_s"), "left") if seeded else df
        if kind == "O":
            own = view(self.spark, self.sf_dir, "fx_sources").select(c("source_id").alias("k"), "checked")
            return row(with_seeds(own), _name("O:", "k"), "ROOT", "DATE", date=c("checked"), source=c("k"), line=F.lit(1))
        if kind == "S":
            return row(with_seeds(self.lines()), _name("S:", "k", "n"), "ROOT", "DATE", date=c("shipped"), source=c("k"), line=c("n") + 1)
        if kind == "P":
            return row(with_seeds(self.lines()), _name("P:", "k", "n"), "ROOT", "NUMBER", number=c("price"), source=c("k"), line=c("n") + 1)
        if kind in "DTC":
            own, parts = {"D": (self.gaps, ("k", "n")), "T": (self.sums, ("k",)), "C": (self.customers, ("c",))}[kind]
            return row(own(), _name(f"{kind}:", *parts), "DERIVED", "DURATION", secs=c("secs"))
        key = {"N": "nk", "R": "rk"}[kind]
        return row(self._places().select(key).distinct(), _name(f"{kind}:", key), "DERIVED", "NUMBER", number=c(key).cast("double"))

    def made(self, kinds: str = KINDS, seeded: bool = False) -> DataFrame:
        """The nodes of some kinds (first letters of their ids), made from the lines whenever they are read; ``seeded``: the roots of the seeded sources are stale."""
        return reduce(DataFrame.unionByName, [self._made(k, seeded) for k in kinds])

    def nodes(self, kinds: str = KINDS) -> DataFrame:
        """``made``, staged."""
        return self._once(f"nodes-{kinds}", lambda: self.made(kinds))

    def _links(self, child: str, order: bool = True) -> DataFrame:
        """(edge_id, parent_id, child_id, operation) of the edges to children of a kind; a child's edges are numbered in order of its parents' ids, or not at all."""
        def numbered(df: DataFrame, key: str, parent: Column, operation: str) -> DataFrame:
            own = df.select(F.col(key), parent.alias("parent_id"))
            at = F.row_number().over(Window.partitionBy(key).orderBy("parent_id")) if order else F.lit(None).cast("int")
            return own.select(at.alias("edge_id"), "parent_id", _name(f"{child}:", key).alias("child_id"), F.lit(operation).alias("operation"))

        if child == "D":  # an order's date is before a line's
            at = F.explode(F.array(F.struct(F.lit(1).alias("edge_id"), _name("O:", "k").alias("parent_id")), F.struct(F.lit(2).alias("edge_id"), _name("S:", "k", "n").alias("parent_id"))))
            return self.gaps().select(at.alias("e"), _name("D:", "k", "n").alias("child_id")).select("e.edge_id", "e.parent_id", "child_id", F.lit("DATE_DIFF").alias("operation"))
        if child == "T":
            return numbered(self.gaps().join(self.sums().select("k"), "k", "left_semi"), "k", _name("D:", "k", "n"), "DURATION_SUM")
        if child == "C":
            return numbered(self.sums().join(self.customers().select("c"), "c", "left_semi"), "c", _name("T:", "k"), "DURATION_SUM")
        if child == "N":
            return numbered(self._nations(), "nk", _name("C:", "c"), "EXPRESSION")
        return numbered(self._places(), "rk", _name("N:", "nk"), "EXPRESSION")

    def links(self, children: str = CHILDREN) -> DataFrame:
        """(parent_id, child_id, operation) of the edges, neither numbered nor staged: for what reads them once and needs no order."""
        return reduce(DataFrame.unionByName, [self._links(k, order=False) for k in children]).drop("edge_id")

    def edges(self, children: str = CHILDREN) -> DataFrame:
        """The edges to children of some kinds."""
        own = reduce(DataFrame.unionByName, [self._links(k) for k in children])
        return self._once(f"edges-{children}", lambda: own.withColumn("expression", F.when(F.col("operation") == "EXPRESSION", "a")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).nodes()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).edges()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "fx_sources")
    return own.select(
        "source_id", "file_path", F.timestamp_seconds("checked").alias("mtime"), (F.col("source_id") % 1000 + 10).alias("file_size"), "content_hash",
        F.timestamp_seconds("checked").alias("last_checked_at"), F.col("source_id").cast("string").alias("identity"),
    )


def marked(spark: SparkSession, sf_dir: str, graph: Graph | None = None) -> DataFrame:
    """Nodes with the roots of the seeded sources stale."""
    return (graph or Graph(spark, sf_dir)).made(seeded=True)
