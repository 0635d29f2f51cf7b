"""A graph over the TPC-H-like tables: a node for each region, nation, customer, supplier, part and order, an edge for
each foreign key, and order-part and part-supplier edges from lineitem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.merge import completed_edges, completed_nodes
from knotwork.runtime import dealt
from knotwork.schema import Graph


def _ord(table: int, phase: int, key: Column, sub: Column | None = None) -> Column:
    return F.struct(F.lit(table).cast("long").alias("file_ord"), F.lit(phase).alias("phase"), key.cast("long").alias("ordinal"), (F.lit(0) if sub is None else sub).cast("int").alias("sub"))


def _id(table: str, key: str) -> Column:
    return F.concat(F.lit(f"{table}::"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def nodes(place: int, table: str, name: str, kind: str, key: str, label: Column, community: Column) -> DataFrame:
        return t[table].select(
            _id(name, key).alias("id"), F.lit(kind).alias("type"), label.alias("name"), F.lit(name).alias("src"), (F.col(key) + 1).cast("int").alias("line"),
            F.lit("EXTRACTED").alias("confidence"), (community % 5).cast("int").alias("community"), _ord(place, 0, F.col(key)).alias("ord"),
        )

    def edges(place: int, rows: DataFrame, source: tuple[str, str], target: tuple[str, str], kind: str, symbol: Column | None = None, line: bool = True) -> DataFrame:
        inferred = kind in ("calls", "inherits")
        return rows.select(
            _id(*source).alias("source"), _id(*target).alias("target"), F.lit(kind).alias("type"), (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"),
            F.lit(source[0]).alias("src"), ((F.col(source[1]) + 1) if line else F.lit(None)).cast("int").alias("line"), F.lit("INFERRED" if inferred else "EXTRACTED").alias("confidence"),
            _ord(place, 1, F.col(source[1]), F.col(target[1])).alias("ord"),
        )

    c = F.col
    all_nodes = [
        nodes(0, "region", "region", "module", "r_regionkey", c("r_name"), c("r_regionkey")),
        nodes(1, "nation", "nation", "module", "n_nationkey", c("n_name"), c("n_regionkey")),
        nodes(2, "customer", "customer", "class", "c_custkey", c("c_name"), c("c_nationkey")),
        nodes(3, "supplier", "supplier", "class", "s_suppkey", c("s_name"), c("s_nationkey")),
        nodes(4, "part", "part", "function", "p_partkey", F.concat("p_brand", F.lit("."), "p_name"), c("p_size")),
        nodes(5, "orders", "order", "file", "o_orderkey", F.concat(F.lit("order."), "o_orderpriority"), c("o_custkey")),
    ]
    lines = t["lineitem"]
    n_lines = lines.count()  # from the footers of the files
    pairs = lambda *keys: dealt(lines.select(*keys), n_lines, *keys).distinct()
    all_edges = [
        edges(1, t["nation"], ("nation", "n_nationkey"), ("region", "n_regionkey"), "contains"),
        edges(2, t["customer"], ("customer", "c_custkey"), ("nation", "c_nationkey"), "imports"),
        edges(3, t["supplier"], ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "imports"),
        edges(5, t["orders"], ("order", "o_orderkey"), ("customer", "o_custkey"), "calls", c("o_orderstatus")),
        edges(6, pairs("l_orderkey", "l_partkey"), ("order", "l_orderkey"), ("part", "l_partkey"), "links"),
        edges(7, pairs("l_partkey", "l_suppkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"), "inherits", line=False),
    ]
    return Graph(completed_nodes(reduce(DataFrame.unionByName, all_nodes)), completed_edges(reduce(DataFrame.unionByName, all_edges)))


#: The same graph in SQL: CTEs ``nodes`` and ``edges``; (tab, k, sub) stands for ``ord``.
STAR_SQL = """
nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'module' AS type, r_name AS name, 'region' AS src, CAST(r_regionkey + 1 AS BIGINT) AS line, 'EXTRACTED' AS confidence, CAST(r_regionkey % 5 AS BIGINT) AS community, 0 AS tab, CAST(r_regionkey AS BIGINT) AS k FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'module', n_name, 'nation', n_nationkey + 1, 'EXTRACTED', n_regionkey % 5, 1, n_nationkey FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'class', c_name, 'customer', c_custkey + 1, 'EXTRACTED', c_nationkey % 5, 2, c_custkey FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'class', s_name, 'supplier', s_suppkey + 1, 'EXTRACTED', s_nationkey % 5, 3, s_suppkey FROM supplier
  UNION ALL SELECT 'part::' || p_partkey, 'function', p_brand || '.' || p_name, 'part', p_partkey + 1, 'EXTRACTED', p_size % 5, 4, p_partkey FROM part
  UNION ALL SELECT 'order::' || o_orderkey, 'file', 'order.' || o_orderpriority, 'order', o_orderkey + 1, 'EXTRACTED', o_custkey % 5, 5, o_orderkey FROM orders
),
edges AS (
  SELECT 'nation::' || n_nationkey AS source, 'region::' || n_regionkey AS target, 'contains' AS type, CAST(NULL AS VARCHAR) AS symbol, 'nation' AS src, CAST(n_nationkey + 1 AS BIGINT) AS line, 'EXTRACTED' AS confidence, 1 AS tab, CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS sub FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'imports', NULL, 'customer', c_custkey + 1, 'EXTRACTED', 2, c_custkey, c_nationkey FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'imports', NULL, 'supplier', s_suppkey + 1, 'EXTRACTED', 3, s_suppkey, s_nationkey FROM supplier
  UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 'calls', o_orderstatus, 'order', o_orderkey + 1, 'INFERRED', 5, o_orderkey, o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'order::' || l_orderkey, 'part::' || l_partkey, 'links', NULL, 'order', l_orderkey + 1, 'EXTRACTED', 6, l_orderkey, l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'part::' || l_partkey, 'supplier::' || l_suppkey, 'inherits', NULL, 'part', NULL, 'INFERRED', 7, l_partkey, l_suppkey FROM lineitem
),
both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
degrees AS MATERIALIZED (SELECT n.id, CAST(count(e.id) AS BIGINT) AS degree FROM nodes n LEFT JOIN (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e ON e.id = n.id GROUP BY n.id)
"""
