"""Queries over the tables for every graph operator, and equivalent DuckDB SQL.

The reference inputs of the extractors are source files; their queries synthesise sources from table columns, so that SQL
can state the expected rows from the columns.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork import fixed_values as V
from knotwork.functions import code, text
from knotwork.operators import analytics, community, incremental, merge, render, search, text_index, traverse
from knotwork.plans.star_graph import STAR_SQL, star_graph
from knotwork.runtime import cut, release, scratch_path, tables
from knotwork.schema import Graph
from knotwork.sources import discover, extract, nodelink, sinks, store
from knotwork.sources.files import Folder
from knotwork.streaming import changes

QUESTION = "How does the blue gear of Brand#12 reach customer_7 and widget suppliers?"
TERMS = text.terms_of(QUESTION)
START, PATH_END = "customer::7", "supplier::3"
PATTERNS = ["Brand#1*", "!Brand#12", "/Brand#2/", "Brand#3/SMALL*", "*/LARGE/green*", "!*.md", "*plate*"]
SUFFIXES = (".py", ".JS", ".md", ".txt", ".bin", "", ".toml", ".TSX", ".go")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, star: bool = False):
    """Register a query under its name, with its SQL; ``star``: the SQL begins with the star graph's CTEs."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH RECURSIVE {STAR_SQL}" if star else "") + sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- Sources ---------------------------------------------------------------------------------------------------------


@query("""
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS pos, CASE WHEN m = 0 THEN b WHEN m = 1 THEN '!' || n ELSE b || '/' END AS pattern
FROM (SELECT p_partkey AS k, p_size % 5 AS m, p_brand AS b, p_name AS n FROM part) WHERE m < 3""")
def ignore_patterns(spark, sf_dir):
    """Parts as lines of an ignore file, with comments and blank lines, read by the reader of such files."""
    m = F.col("p_size") % 5
    line = F.when(m == 0, F.concat(F.lit("  "), "p_brand")).when(m == 1, F.concat(F.lit("!"), "p_name", F.lit(" \t"))).when(m == 2, F.concat("p_brand", F.lit("/  "))).when(m == 3, F.concat(F.lit("  # "), "p_name")).otherwise("   ")
    with tempfile.TemporaryDirectory() as root:
        with open(f"{root}/{discover.IGNORE_FILES[0]}", "w", encoding="utf-8") as f:
            f.writelines(f"{r.line}\n" for r in table(spark, sf_dir, "part").orderBy("p_partkey").select(line.alias("line")).toLocalIterator())
        return spark.createDataFrame(list(enumerate(discover.ignore_patterns(root))), "pos long, pattern string")


def _paths(spark, sf_dir) -> DataFrame:
    """Relative paths of three components from parts."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), suffix).alias("path"))


PATHS_SQL = f"""paths AS (SELECT p_partkey, p_brand AS brand, p_type AS kind, replace(p_name, ' ', '_') || s AS name, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '_') || s AS path
  FROM (SELECT *, {list(SUFFIXES)}[p_partkey % {len(SUFFIXES)} + 1] AS s FROM part))"""  # noqa: S608


@query(f"""WITH {PATHS_SQL}
SELECT p_partkey, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.JS' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.txt' THEN 'text'
  WHEN path LIKE '%.toml' THEN 'config' WHEN path LIKE '%.TSX' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' ELSE 'other' END AS kind FROM paths""")
def classify_ext(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("kind", text.kind_of(F.col("path")))


@query(f"""WITH {PATHS_SQL}
SELECT p_partkey, (brand LIKE 'Brand#1%' OR kind LIKE 'Brand#1%' OR name LIKE 'Brand#1%') AS p0, brand = 'Brand#12' AS p1, brand = 'Brand#2' AS p2,
  path LIKE 'Brand#3/SMALL%' AS p3, regexp_full_match(path, '.*/LARGE/green.*') AS p4, name LIKE '%.md' AS p5, (brand LIKE '%plate%' OR kind LIKE '%plate%' OR name LIKE '%plate%') AS p6 FROM paths""")
def ignore_match(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("p_partkey", *[text.matches_pattern(p, x.removeprefix("!")).alias(f"p{i}") for i, x in enumerate(PATTERNS)])


LAST_MATCH = """CASE WHEN name LIKE '%plate%' THEN true WHEN name LIKE '%.md' THEN false WHEN path LIKE '%/LARGE/green%' OR path LIKE 'Brand#3/SMALL%' OR brand = 'Brand#2' THEN true
  WHEN brand = 'Brand#12' THEN false WHEN brand LIKE 'Brand#1%' THEN true ELSE false END"""


@query(f"WITH {PATHS_SQL} SELECT p_partkey, {LAST_MATCH} AS ignored FROM paths")
def ignore_last_match(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", text.ignored(F.col("path"), PATTERNS).alias("ignored"))


@query(f"""WITH {PATHS_SQL}
SELECT p_partkey, ({LAST_MATCH}) OR brand = 'Brand#2' OR (brand LIKE 'Brand#1%' AND brand <> 'Brand#12') OR (brand = 'Brand#3' AND kind = 'SMALL') AS ignored FROM paths""")
def ignore_prune(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", text.pruned(F.col("path"), PATTERNS).alias("ignored"))


@query("""
WITH d AS (SELECT 'd/' || doc_id || '.txt' AS rel, doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)
SELECT rel, sha256, sha256 IN (SELECT sha256 FROM d WHERE doc_id % 2 = 0) AS hit FROM d""")
def content_hash_dedup(spark, sf_dir):
    """Documents as files against an extraction cache by content that holds every other one of them."""
    text_ = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    files = text_.select("doc_id", F.col("doc_id").alias("file_ord"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), F.lit("text").alias("kind"), F.lit(".txt").alias("suffix"), F.sha2("text", 256).alias("sha256"), F.lit("").alias("content"))
    cache = store.Cache(spark, Folder(spark, scratch_path(spark, "cache")), by_content=True)
    cache.add(extract.extracted(files.where("doc_id % 2 = 0").drop("doc_id")))
    hits, misses = cache.split(files.drop("doc_id"))
    found = hits.where("id IS NOT NULL").select("file_ord" if "file_ord" in hits.columns else F.col("ord.file_ord").alias("file_ord")).distinct().withColumn("hit", F.lit(True))
    both = found.unionByName(misses.select("file_ord", F.lit(False).alias("hit")))
    return files.join(both, "file_ord").select("rel", "sha256", "hit")


@query(f"""WITH {STAR_SQL} SELECT source, target, type, line, confidence FROM edges""")
def nodelink_roundtrip(spark, sf_dir):
    """The whole star graph written as one node-link file and read back."""
    path = f"{scratch_path(spark, 'graph')}/graph.json"
    g = star_graph(spark, sf_dir)
    with tables(spark) as keep:
        nodelink.save(Graph(keep(g.nodes), keep(g.edges)), path)
    release(spark)
    return longs(nodelink.load(spark, path).edges.select("source", "target", "type", "line", "confidence"), "line")


# --- Extractors ------------------------------------------------------------------------------------------------------

#: Rows of a table whose files one task parses; the rows are narrow and the parsing long, and a scan has no more tasks than its file has row groups.
FILES_A_TASK = 10_000


def _dealt_files(spark, sf_dir, name: str, key: str, *columns: str) -> DataFrame:
    """The columns of a table that sources are made of, dealt by its key to tasks of so many files."""
    rows = table(spark, sf_dir, name).select(key, *columns)
    return rows.repartition(max(1, -(-rows.count() // FILES_A_TASK)), key)  # counted from the footers of the files


def _extracted(sources: DataFrame) -> DataFrame:
    """Extraction rows of (rel, suffix, content)."""
    return extract.extracted(sources.withColumn("file_ord", F.lit(0).cast("long")))


def _edges(rows: DataFrame) -> DataFrame:
    return longs(rows.where("source IS NOT NULL").select("source", "target", "type", "symbol", "line", "confidence"), "line")


def _supplier_python(spark, sf_dir) -> DataFrame:
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    source = F.concat(F.lit("import nation_"), n, F.lit("\nfrom .base import Supplier, Other\n\nclass S"), k, F.lit("(Supplier):\n    def load(self):\n        return fetch_"), n, F.lit("(len(self.name))\n\ndef make():\n    return S"), k, F.lit("()\n"))
    return _dealt_files(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("s/"), k, F.lit(".py")).alias("rel"), F.lit(".py").alias("suffix"), source.alias("content"))


PYTHON_SQL = """
WITH s AS (SELECT 's/' || s_suppkey || '.py' AS rel, 'S' || s_suppkey AS c, s_nationkey AS n FROM supplier)
SELECT 'file::' || rel AS source, 'module::nation_' || n AS target, 'imports' AS type, NULL AS symbol, CAST(1 AS BIGINT) AS line, 'EXTRACTED' AS confidence FROM s
UNION ALL SELECT 'file::' || rel, 'module::base', 'imports', x, 2, 'EXTRACTED' FROM s, (VALUES ('Supplier'), ('Other')) v(x)
UNION ALL SELECT 'file::' || rel, 'class::' || rel || '::' || c, 'defines', NULL, 4, 'EXTRACTED' FROM s
UNION ALL SELECT 'class::' || rel || '::' || c, 'symbol::?::Supplier', 'inherits', 'Supplier', 4, 'INFERRED' FROM s
UNION ALL SELECT 'file::' || rel, 'function::' || rel || '::' || c || '.load', 'defines', NULL, 5, 'EXTRACTED' FROM s
UNION ALL SELECT 'class::' || rel || '::' || c, 'function::' || rel || '::' || c || '.load', 'has-method', NULL, 5, 'EXTRACTED' FROM s
UNION ALL SELECT 'function::' || rel || '::' || c || '.load', 'symbol::?::fetch_' || n, 'calls', 'fetch_' || n, 6, 'INFERRED' FROM s
UNION ALL SELECT 'file::' || rel, 'function::' || rel || '::make', 'defines', NULL, 8, 'EXTRACTED' FROM s
UNION ALL SELECT 'function::' || rel || '::make', 'symbol::?::' || c, 'calls', c, 9, 'INFERRED' FROM s"""


@query(PYTHON_SQL)
def extract_python(spark, sf_dir):
    return _edges(_extracted(_supplier_python(spark, sf_dir)))


@query("""
WITH s AS (SELECT 'c/' || c_custkey || '.py' AS rel, c_custkey AS k, lower(c_mktsegment) AS m FROM customer)
SELECT 'function::' || rel || '::f' AS source, x AS symbol, CAST(line AS BIGINT) AS line FROM s, LATERAL (VALUES ('api.' || m || '.get', 2), ('run', 2), ('helper_' || k, 3)) v(x, line)""")
def extract_python_calls(spark, sf_dir):
    k, m = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    source = F.concat(F.lit("def f(x):\n    api."), m, F.lit(".get(len(x)).run(print(x))\n    helper_"), k, F.lit("(x)[0]()\n"))
    files = _dealt_files(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(F.concat(F.lit("c/"), k, F.lit(".py")).alias("rel"), F.lit(".py").alias("suffix"), source.alias("content"))
    return longs(_extracted(files).where("type = 'calls'").select("source", "symbol", "line"), "line")


def _nation_sources(spark, sf_dir, suffix: str, source: Column) -> DataFrame:
    files = _dealt_files(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumn("k", F.col("s_suppkey").cast("string")).withColumn("n", F.col("s_nationkey").cast("string"))
    return files.select(F.concat(F.lit("x/"), "k", F.lit(suffix)).alias("rel"), F.lit(suffix).alias("suffix"), source.alias("content"))


def _expected(suffix: str, *rows: str) -> str:
    """SQL for edges of a file a supplier; each row is (source, target, type, symbol, line, confidence) over rel, k, n."""
    union = "\nUNION ALL ".join(f"SELECT {r} FROM s" for r in rows)
    return f"WITH s AS (SELECT 'x/' || s_suppkey || '{suffix}' AS rel, s_suppkey AS k, s_nationkey AS n FROM supplier), e(source, target, type, symbol, line, confidence) AS ({union})\nSELECT source, target, type, CAST(symbol AS VARCHAR) AS symbol, CAST(line AS BIGINT) AS line, confidence FROM e"


DEFINES = "'file::' || rel, '{kind}::' || rel || '::{name}, 'defines', NULL, NULL, 'EXTRACTED'"
IMPORTS = "'file::' || rel, 'module::{name}, 'imports', NULL, {line}, 'EXTRACTED'"


JS_SQL = _expected(".js", IMPORTS.format(name="lib' || n", line=1), IMPORTS.format(name="fs'", line=2), IMPORTS.format(name="./re' || k", line=3), DEFINES.format(kind="function", name="f' || k"), DEFINES.format(kind="function", name="g'"), DEFINES.format(kind="class", name="C' || k"), "'class::' || rel || '::C' || k, 'symbol::?::Base.B' || n, 'inherits', 'Base.B' || n, NULL, 'INFERRED'")


def _js_files(spark, sf_dir) -> DataFrame:
    s = F.concat(F.lit("import {a} from 'lib"), "n", F.lit("';\nconst fs = require(\"fs\");\nexport * from './re"), "k", F.lit("';\nexport async function f"), "k", F.lit("() {}\nconst g = (x) => x;\nexport class C"), "k", F.lit(" extends Base.B"), "n", F.lit(" {}\n"))
    return _nation_sources(spark, sf_dir, ".js", s)


@query(JS_SQL)
def extract_js(spark, sf_dir):
    return _edges(_extracted(_js_files(spark, sf_dir)))


GO_SQL = _expected(".go", IMPORTS.format(name="fmt'", line=2), IMPORTS.format(name="net/' || n", line=2), IMPORTS.format(name="os'", line=6), DEFINES.format(kind="function", name="F' || k"), DEFINES.format(kind="function", name="M'"), DEFINES.format(kind="class", name="T' || k"))


def _go_files(spark, sf_dir) -> DataFrame:
    s = F.concat(F.lit('package x\nimport (\n"fmt"\n"net/'), "n", F.lit('"\n)\nimport "os"\nfunc F'), "k", F.lit("() {}\nfunc (t *T) M() {}\ntype T"), "k", F.lit(" struct {}\n"))
    return _nation_sources(spark, sf_dir, ".go", s)


@query(GO_SQL)
def extract_go(spark, sf_dir):
    return _edges(_extracted(_go_files(spark, sf_dir)))


RUST_SQL = _expected(".rs", IMPORTS.format(name="std::io' || n || '::'", line=1), DEFINES.format(kind="function", name="f' || k"), DEFINES.format(kind="class", name="S' || k"), DEFINES.format(kind="class", name="E'"))


def _rust_files(spark, sf_dir) -> DataFrame:
    s = F.concat(F.lit("use std::io"), "n", F.lit("::{Read, Write};\npub async fn f"), "k", F.lit("() {}\npub struct S"), "k", F.lit(";\nenum E { A }\n"))
    return _nation_sources(spark, sf_dir, ".rs", s)


@query(RUST_SQL)
def extract_rust(spark, sf_dir):
    return _edges(_extracted(_rust_files(spark, sf_dir)))


JAVA_SQL = _expected(".java", IMPORTS.format(name="java.util.N' || n", line=1), IMPORTS.format(name="a.b.*'", line=2), DEFINES.format(kind="class", name="C' || k"), "'class::' || rel || '::C' || k, 'symbol::?::Base' || n, 'inherits', 'Base' || n, NULL, 'INFERRED'", DEFINES.format(kind="function", name="m' || k"))


def _java_files(spark, sf_dir) -> DataFrame:
    s = F.concat(F.lit("import java.util.N"), "n", F.lit(";\nimport static a.b.*;\npublic final class C"), "k", F.lit(" extends Base"), "n", F.lit(" {\n  public static int m"), "k", F.lit("(int x) throws E {\n    return 1;\n  }\n  public synchronized while(int z) {\n  }\n}\n"))
    return _nation_sources(spark, sf_dir, ".java", s)


@query(JAVA_SQL)
def extract_java(spark, sf_dir):
    return _edges(_extracted(_java_files(spark, sf_dir)))


MARKDOWN_SQL = """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"\\s()]+)"', 1)) AS href FROM pages),
l AS (SELECT 'p/' || page_id || '.md' AS rel, href, CAST(3 + count(*) OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS line FROM (SELECT *, row_number() OVER () AS n FROM a))
SELECT 'heading::' || rel || '::h2-Links' AS source, 'link::' || href AS target, 'links' AS type, line FROM l WHERE href NOT LIKE '#%' AND href NOT LIKE 'mailto:%'
UNION ALL SELECT 'file::p/' || page_id || '.md', 'heading::p/' || page_id || '.md::' || h, 'contains', NULL FROM pages, (VALUES ('h1-Page'), ('h2-Links')) v(h)"""


def _markdown_files(spark, sf_dir) -> DataFrame:
    links = F.transform(F.regexp_extract_all("html", F.lit(r'href="([^"\s()]+)"'), F.lit(1)), lambda h: F.concat(F.lit("[a]("), h, F.lit(")")))
    source = F.concat(F.lit("# Page\n## Links \n"), F.array_join(links, "\n"), F.lit("\n"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".md")).alias("rel"), F.lit(".md").alias("suffix"), source.alias("content"))


@query(MARKDOWN_SQL)
def extract_markdown(spark, sf_dir):
    return longs(_extracted(_markdown_files(spark, sf_dir)).where("source IS NOT NULL").select("source", "target", "type", "line"), "line")


@query(" UNION ALL ".join(f"SELECT source, target, type, line FROM ({sql})" for sql in (PYTHON_SQL, JS_SQL, GO_SQL, RUST_SQL, JAVA_SQL, MARKDOWN_SQL)))
def extract_code(spark, sf_dir):
    """Files of six languages in one table, extracted in SQL by the table function."""
    makers = (_supplier_python, _js_files, _go_files, _rust_files, _java_files, _markdown_files)
    files = reduce(DataFrame.unionByName, [f(spark, sf_dir).select("rel", "content") for f in makers])
    return code.extracted_by_sql(files, "x.source, x.target, x.type, CAST(x.line AS BIGINT) AS line", "x.source IS NOT NULL")


@query("SELECT 'file::d/' || doc_id || '.txt' AS id, 'file' AS type, 'd/' || doc_id || '.txt' AS name, 'text' AS language, 'EXTRACTED' AS confidence FROM documents WHERE text IS NOT NULL")
def extract_text(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), F.lit(".txt").alias("suffix"), F.col("text").alias("content"))
    return _extracted(files).select("id", "type", "name", "language", "confidence")


@query("""
SELECT 'file::q/' || p_partkey || s AS id, CASE s WHEN '.py' THEN 'python' WHEN '.JSX' THEN 'javascript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' WHEN '.markdown' THEN 'markdown' ELSE 'text' END AS language
FROM (SELECT p_partkey, ['.py', '.JSX', '.tsx', '.go', '.rs', '.java', '.markdown', '.yaml', '.rst'][p_partkey % 9 + 1] AS s FROM part)""")
def extract_dispatch(spark, sf_dir):
    kinds = F.array(*map(F.lit, (".py", ".JSX", ".tsx", ".go", ".rs", ".java", ".markdown", ".yaml", ".rst")))
    s = F.element_at(kinds, (F.col("p_partkey") % 9 + 1).cast("int"))
    files = _dealt_files(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("q/"), F.col("p_partkey").cast("string"), s).alias("rel"), s.alias("suffix"), F.lit("x = 1\n").alias("content"))
    return _extracted(files).where("type = 'file'").select("id", "language")


# --- Merging ---------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT 'customer::' || o_custkey AS id, o_orderkey AS k, o_orderkey % 5 = 0 AS stub,
    CASE WHEN o_orderkey % 5 = 0 THEN 'stub' WHEN o_orderkey % 2 = 0 THEN 'class' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name,
    CASE WHEN o_orderkey % 7 < 3 THEN o_orderstatus END AS src, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS line FROM orders)
SELECT id, min_by(type, (stub, k)) FILTER (type IS NOT NULL) AS type, min_by(name, (stub, k)) FILTER (name IS NOT NULL) AS name, min_by(src, (stub, k)) FILTER (src IS NOT NULL) AS src,
  CAST(min_by(line, (stub, k)) FILTER (line IS NOT NULL) AS BIGINT) AS line, min(k) AS first FROM r GROUP BY id""")
def merge_nodes(spark, sf_dir):
    k = F.col("o_orderkey")
    place = F.struct(F.lit(0).cast("long").alias("file_ord"), F.lit(0).alias("phase"), k.alias("ordinal"), F.lit(0).alias("sub"))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer::"), F.col("o_custkey").cast("string")).alias("id"), F.when(k % 5 == 0, "stub").when(k % 2 == 0, "class").alias("type"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("name"),
        F.when(k % 7 < 3, F.col("o_orderstatus")).alias("src"), F.when(k % 4 == 1, k).cast("int").alias("line"), place.alias("ord"),
    )
    return longs(merge.merge_nodes(rows).select("id", "type", "name", "src", "line", F.col("ord.ordinal").alias("first")), "line")


@query("""
WITH r AS (SELECT DISTINCT 'part::' || l_partkey AS source, 'supplier::' || l_suppkey AS target, l_orderkey AS k, l_linenumber AS i,
    CASE WHEN l_orderkey % 2 = 0 THEN 'calls' ELSE 'imports' END AS type, CASE WHEN l_orderkey % 3 = 0 THEN 's' || l_linenumber END AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS line FROM lineitem)
SELECT source, target, min_by(type, (k, i)) AS type, min_by(symbol, (k, i)) FILTER (symbol IS NOT NULL) AS symbol, CAST(min_by(line, (k, i)) FILTER (line IS NOT NULL) AS BIGINT) AS line FROM r GROUP BY source, target""")
def merge_edges(spark, sf_dir):
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    place = F.struct(F.lit(0).cast("long").alias("file_ord"), F.lit(1).alias("phase"), k.alias("ordinal"), i.cast("int").alias("sub"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")).alias("target"),
        F.when(k % 2 == 0, "calls").otherwise("imports").alias("type"), F.when(k % 3 == 0, F.concat(F.lit("s"), i.cast("string"))).alias("symbol"), F.when(i % 2 == 0, k).cast("int").alias("line"), place.alias("ord"),
    )
    return longs(merge.merge_edges(rows).select("source", "target", "type", "symbol", "line"), "line")


#: Orders as files that sight themselves, their customer and their parts. Before the change all orders but pending ones are there; then
#: pending ones come, urgent ones go, and those of low priority lose their parts and get other lines.
CHANGED_SQL = """
f AS (SELECT o.*, o_orderstatus <> 'P' AS base, o_orderpriority NOT LIKE '1-%' AS present, o_orderpriority LIKE '5-%' AS low FROM orders o),
m AS (SELECT *, base AND (low OR NOT present) AS gone, present AND (low OR NOT base) AS came FROM f),
n AS (
  SELECT 'order::' || o_orderkey AS id, 'file' AS type, label AS name, line, o_orderkey AS k FROM (SELECT *, 'order.' || o_orderpriority AS label, o_orderkey + CASE WHEN low THEN 1000000 ELSE 0 END AS line FROM m WHERE present)
  UNION ALL SELECT 'customer::' || o_custkey, 'class', 'of ' || o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END, o_orderkey FROM m WHERE present
),
e AS (
  SELECT 'order::' || o_orderkey AS source, 'customer::' || o_custkey AS target, 'calls' AS type, o_orderstatus AS symbol, o_orderkey + CASE WHEN low THEN 1000000 ELSE 0 END AS line FROM m WHERE present
  UNION ALL SELECT DISTINCT 'order::' || o_orderkey, 'part::' || l_partkey, 'links', NULL, o_orderkey FROM m JOIN lineitem ON l_orderkey = o_orderkey WHERE present AND NOT low
),
touched AS (
  SELECT 'order::' || o_orderkey AS id FROM m WHERE gone OR came UNION SELECT 'customer::' || o_custkey FROM m WHERE gone OR came
  UNION SELECT 'part::' || l_partkey FROM m JOIN lineitem ON l_orderkey = o_orderkey WHERE gone OR (came AND NOT low)
)
"""


def _order_rows(files: DataFrame, parts: DataFrame, low: Column) -> Graph:
    """The unmerged rows of orders as files with their parts; orders that are ``low`` show other lines and no parts."""
    k = F.col("o_orderkey")
    line = (k + F.when(low, 1_000_000).otherwise(0)).cast("int")
    place = lambda phase, at, sub: F.struct(k.cast("long").alias("file_ord"), F.lit(phase).alias("phase"), at.cast("long").alias("ordinal"), F.lit(sub).alias("sub")).alias("ord")
    name = lambda table, key: F.concat(F.lit(f"{table}::"), F.col(key).cast("string"))
    me, customer = name("order", "o_orderkey"), name("customer", "o_custkey")
    nodes = files.select(me.alias("id"), F.lit("file").alias("type"), F.concat(F.lit("order."), "o_orderpriority").alias("name"), line.alias("line"), place(0, F.lit(0), 0)).unionByName(
        files.select(customer.alias("id"), F.lit("class").alias("type"), F.concat(F.lit("of "), k.cast("string")).alias("name"), F.when(F.col("o_orderstatus") != "F", k).cast("int").alias("line"), place(0, F.lit(1), 0)))
    edges = files.select(me.alias("source"), customer.alias("target"), F.lit("calls").alias("type"), F.col("o_orderstatus").alias("symbol"), line.alias("line"), place(1, F.lit(0), 0))
    links = parts.where(~low).select(me.alias("source"), name("part", "l_partkey").alias("target"), F.lit("links").alias("type"), F.lit(None).cast("string").alias("symbol"), k.cast("int").alias("line"), place(1, F.col("l_partkey") + 1, 0))
    return Graph(nodes, edges.unionByName(links))


def _stored(df: DataFrame) -> DataFrame:
    """``df`` evaluated into a table of the shared folder, of which later steps read the columns that they need."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _orders_changed(spark, sf_dir) -> tuple[Graph, Graph, Graph, Graph]:
    """The unmerged rows of orders before a change, of those that went, of those that came, and of all after it.

    Orders meet their lines once, for all four.
    """
    flags = {"base": F.col("o_orderstatus") != "P", "present": ~F.col("o_orderpriority").startswith("1-"), "low": F.col("o_orderpriority").startswith("5-")}
    f = table(spark, sf_dir, "orders").withColumns(flags)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = _stored(f.select("o_orderkey", *flags).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", *flags))
    base, present, low = map(F.col, flags)
    rows = lambda which, low: _order_rows(f.where(which), parts.where(which), low)
    return rows(base, F.lit(False)), rows(base & (low | ~present), F.lit(False)), rows(present & (low | ~base), low), rows(present, low)


@query(f"""WITH {CHANGED_SQL},
known AS (SELECT id, max(type) AS type, min_by(name, k) AS name, CAST(min_by(line, k) FILTER (line IS NOT NULL) AS BIGINT) AS line FROM n GROUP BY id),
stubs AS (SELECT DISTINCT target AS id, 'stub' AS type, target AS name, CAST(NULL AS BIGINT) AS line FROM e WHERE type = 'links'),
ends AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id)
SELECT x.id, x.type, x.name, x.line, CAST(coalesce(degree, 0) AS BIGINT) AS degree, t.id IS NOT NULL AS anew
FROM (SELECT * FROM known UNION ALL SELECT * FROM stubs) x LEFT JOIN ends USING (id) LEFT JOIN touched t ON t.id = x.id""")
def incremental_nodes(spark, sf_dir):
    """Nodes and degrees after orders came, went and changed, and which of them were merged anew."""
    rows, left, came, now = _orders_changed(spark, sf_dir)
    built = merge.build(rows.nodes, rows.edges)
    before = Graph(_stored(built.nodes), _stored(built.edges))
    known = analytics.degree(before.nodes, before.edges)
    touched = incremental.Touched.by(left, came)
    after = incremental.merged(before, touched, now)
    anew = after.anew.nodes.select("id", F.lit(True).alias("anew"))
    x = after.graph.nodes.join(incremental.degrees(known, before, after, touched), "id").join(anew, "id", "left")
    return longs(x.select("id", "type", "name", "line", "degree", F.coalesce("anew", F.lit(False)).alias("anew")), "line")


@query(f"WITH {CHANGED_SQL} SELECT source, target, type, symbol, CAST(line AS BIGINT) AS line FROM e")
def incremental_edges(spark, sf_dir):
    """Edges after the same change."""
    rows, left, came, now = _orders_changed(spark, sf_dir)
    edges, _ = incremental.merged_edges(merge.merge_edges(rows.edges), incremental.touched_pairs(left, came), now.edges)
    return longs(edges.select("source", "target", "type", "symbol", "line"), "line")


@query("SELECT DISTINCT 'supplier::' || s AS id, 'stub' AS type, 'supplier::' || s AS name, 'INFERRED' AS confidence FROM (SELECT s_suppkey AS s FROM supplier UNION SELECT l_suppkey FROM lineitem)")
def stub_nodes(spark, sf_dir):
    """Suppliers as endpoints while their nodes are left out."""
    g = star_graph(spark, sf_dir)
    return merge.stub_nodes(g.nodes.where("src <> 'supplier'"), g.edges)


# --- Search ----------------------------------------------------------------------------------------------------------

SCORE_SQL = """
scored AS (SELECT id, CAST(total + CASE WHEN total > 0 AND type IN ('function', 'class', 'module') THEN 1 ELSE 0 END AS BIGINT) AS score FROM (
  SELECT id, type, list_sum(list_transform({terms}, lambda t: CASE WHEN nm = t OR sh = t THEN 10 WHEN contains(nm, t) THEN 5 WHEN contains(nid, t) THEN 2
    WHEN greatest(common(t, sh), common(t, nm)) >= 4 AND greatest(common(t, sh), common(t, nm)) >= least(length(t), length(sh)) // 2 THEN 3 ELSE 0 END)) AS total
  FROM (SELECT id, type, lower(name) AS nm, lower(id) AS nid, regexp_replace(regexp_replace(lower(name), '^.*\\.', '', 's'), '^.*::', '', 's') AS sh FROM nodes)) WHERE total > 0)
"""


def _score_sql() -> str:
    """``common(a, b)`` spelled out: the largest i with equal prefixes."""
    out = SCORE_SQL.format(terms=TERMS)
    for b in ("sh", "nm"):
        out = out.replace(f"common(t, {b})", f"list_max(list_filter(range(0, least(length(t), length({b})) + 1), lambda i: left(t, i) = left({b}, i)))")
    return out


SEEDS_SQL = f", {_score_sql()}, seeds AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank FROM scored ORDER BY score DESC, id LIMIT 8)"


@query("""
SELECT conv_id, turn, list_aggregate(list_distinct_in_order, 'string_agg', ' ') AS terms FROM (
  SELECT conv_id, turn, list_filter(l, lambda t, i: list_position(l, t) = i) AS list_distinct_in_order FROM (
    SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: t NOT IN """ + str(V.STOP_WORDS) + """) AS l FROM conversations WHERE text IS NOT NULL)) WHERE len(list_distinct_in_order) > 0""")
def terms(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", text.terms(F.col("text")).alias("t"))
    return x.where(F.size("t") > 0).select("conv_id", "turn", F.array_join("t", " ").alias("terms"))


@query("""
SELECT p_partkey, CAST(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS BIGINT) AS overlap
FROM (SELECT p_partkey, p_brand AS a, 'Brand#' || p_size AS b FROM part)""")
def prefix_overlap(spark, sf_dir):
    b = F.concat(F.lit("Brand#"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.prefix_overlap(F.col("p_brand"), b).cast("long").alias("overlap"))


@query(f", {_score_sql()} SELECT id, score FROM scored", star=True)
def score_nodes(spark, sf_dir):
    return search.scored(star_graph(spark, sf_dir).nodes, TERMS)


#: The terms of all turns of all conversations, and the points of each term and node.
ASKED_SQL = f""", asked AS (SELECT DISTINCT conv_id, turn, lower(t) AS term FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+')) AS t FROM conversations) WHERE lower(t) NOT IN {V.STOP_WORDS}),
lows AS (SELECT id, type, lower(name) AS low, lower(id) AS low_id, split_part(split_part(lower(name), '.', -1), '::', -1) AS short FROM nodes),
all_names AS MATERIALIZED (SELECT string_agg(low || ' ' || low_id, ' ') AS text FROM lows),
each_term AS MATERIALIZED (SELECT term FROM (SELECT DISTINCT term FROM asked), all_names WHERE contains(text, term) OR left(term, 4) IN (SELECT left(low, 4) FROM lows UNION SELECT left(short, 4) FROM lows)),
matched AS MATERIALIZED (SELECT * FROM (SELECT term, id, type, CASE WHEN low = term OR short = term THEN 10 WHEN contains(low, term) THEN 5 WHEN contains(low_id, term) THEN 2
  WHEN (length(short) >= k AND length(term) >= k AND left(short, k) = left(term, k)) OR (length(low) >= k AND length(term) >= k AND left(low, k) = left(term, k)) THEN 3 ELSE 0 END AS points
  FROM (SELECT *, greatest(4, least(length(term), length(short)) // 2) AS k FROM each_term, lows)) WHERE points > 0)
"""


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.terms(F.col("text"))).alias("term"))


@query(f"{ASKED_SQL} SELECT term, count(*) AS matches, CAST(sum(points) AS BIGINT) AS points, min_by(id, (-points, id)) AS best FROM matched GROUP BY term", star=True)
def term_matches(spark, sf_dir):
    """Every term of all conversations looked up in the index of the star graph's names."""
    x = text_index.term_scores(star_graph(spark, sf_dir).nodes, _asked(spark, sf_dir))
    return x.groupBy("term").agg(F.count("*").alias("matches"), F.sum("points").cast("long").alias("points"), F.min_by("id", F.struct(-F.col("points"), "id")).alias("best"))


@query(f"""{ASKED_SQL}, total AS (SELECT conv_id, turn, id, CAST(sum(points) + max(CASE WHEN type IN {V.FAVOURED_TYPES} THEN 1 ELSE 0 END) AS BIGINT) AS score FROM asked JOIN matched USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, id) AS rank FROM total)
SELECT * FROM ranked WHERE rank <= {V.SEEDS}""", star=True)
def question_seeds(spark, sf_dir):
    """The seeds of every turn of all conversations as a question to the star graph."""
    return text_index.question_seeds(star_graph(spark, sf_dir).nodes, _asked(spark, sf_dir), ["conv_id", "turn"])


@query(f"{SEEDS_SQL} SELECT id, score FROM seeds", star=True)
def seeds(spark, sf_dir):
    return search.seeds(star_graph(spark, sf_dir).nodes, TERMS)


@query(f"{SEEDS_SQL} SELECT id, score, rank FROM seeds", star=True)
def seed_rank(spark, sf_dir):
    return search.seed_ranks(star_graph(spark, sf_dir).nodes, TERMS)


# --- Traversal -------------------------------------------------------------------------------------------------------


def _start(spark) -> DataFrame:
    return traverse.seeds_table(spark, [START])


@query(" SELECT a, b FROM both_ways", star=True)
def undirected_edges(spark, sf_dir):
    return traverse.undirected(star_graph(spark, sf_dir).edges)


@query(" SELECT 'nation::7' AS id, target AS neighbour, 'out' AS direction FROM edges WHERE source = 'nation::7' UNION ALL SELECT 'nation::7', source, 'in' FROM edges WHERE target = 'nation::7'", star=True)
def neighbors_1hop(spark, sf_dir):
    return traverse.neighbours(star_graph(spark, sf_dir).edges, spark.createDataFrame([("nation::7",)], "id string"))


@query(" SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM nodes WHERE community = 1) AND target IN (SELECT id FROM nodes WHERE community = 1)", star=True)
def induced_subgraph(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return traverse.induced(g.edges, g.nodes.where("community = 1").select("id")).select("source", "target", "type")


@query(f", reach(id, depth) AS (SELECT '{START}', 0 UNION SELECT b, depth + 1 FROM reach JOIN both_ways ON a = id WHERE depth < 3) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY id", star=True)
def bfs_reach(spark, sf_dir):
    return longs(traverse.bfs(star_graph(spark, sf_dir), _start(spark), 3).select("id", "depth"), "depth")


@query(", reach(id, depth) AS (SELECT 'supplier::3', 0 UNION SELECT source, depth + 1 FROM reach JOIN edges ON target = id WHERE depth < 2) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY id", star=True)
def affected(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return longs(traverse.affected(g, traverse.seeds_table(spark, ["supplier::3"]), 2).select("id", "depth"), "depth")


@query("""
, listed AS (SELECT id, 0 AS part, tab, k, CAST(0 AS BIGINT) AS sub FROM nodes WHERE id = 'nation::7'
  UNION ALL SELECT target, 1, tab, k, sub FROM edges WHERE source = 'nation::7'
  UNION ALL SELECT n.id, 2, n.tab, n.k, 0 FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'nation::7'),
once AS (SELECT id, min((part, tab, k, sub)) AS p FROM listed GROUP BY id)
SELECT id, CAST(row_number() OVER (ORDER BY p, id) - 1 AS BIGINT) AS pos FROM once""", star=True)
def explain_ego(spark, sf_dir):
    return traverse.ego(star_graph(spark, sf_dir), "nation::7")


PATH_SQL = f""", reach(id, depth) AS (SELECT '{START}', 0 UNION SELECT b, depth + 1 FROM reach JOIN both_ways ON a = id WHERE depth < 3),
level AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id),
parent AS (SELECT c.id, min(p.id) AS up FROM level c JOIN both_ways ON b = c.id JOIN level p ON p.id = a AND p.depth = c.depth - 1 GROUP BY c.id),
back(id, step) AS (SELECT '{PATH_END}', 0 UNION ALL SELECT up, step + 1 FROM back JOIN parent USING (id))"""


def _path(spark, sf_dir) -> list[str]:
    return traverse.shortest_path(star_graph(spark, sf_dir), START, PATH_END)


@query(PATH_SQL + " SELECT id, CAST((SELECT max(step) FROM back) - step AS BIGINT) AS pos FROM back", star=True)
def shortest_path(spark, sf_dir):
    return spark.createDataFrame([(x, i) for i, x in enumerate(_path(spark, sf_dir))], "id string, pos long")


@query(PATH_SQL + " SELECT CAST(count(*) AS BIGINT) AS nodes FROM back", star=True)
def shortest_path_len(spark, sf_dir):
    return spark.createDataFrame([(len(_path(spark, sf_dir)),)], "nodes long")


@query()
def dfs_order(spark, sf_dir):
    return traverse.seeds_table(spark, traverse.dfs(star_graph(spark, sf_dir), [START], 2))


def _chains(spark, sf_dir) -> Graph:
    """Turns of conversations, each edge to the next turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    turn = lambda t: F.concat(F.lit("turn::"), F.col("conv_id").cast("string"), F.lit("::"), t.cast("string"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return Graph(c.select(turn(F.col("turn")).alias("id")), c.join(nxt, ["conv_id", "turn"]).select(turn(F.col("turn")).alias("source"), turn(F.col("turn") + 1).alias("target")))


@query("""
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT 'turn::' || conv_id || '::' || turn AS id, min('turn::' || conv_id || '::' || turn) OVER (PARTITION BY conv_id, run) AS component FROM g""")
def connected_components(spark, sf_dir):
    g = _chains(spark, sf_dir)
    return traverse.connected_components(g.nodes, g.edges)


# --- Analytics -------------------------------------------------------------------------------------------------------


@query(" SELECT id, degree FROM degrees", star=True)
def degree(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return analytics.degree(g.nodes, g.edges)


@query(f"""
, noisy AS (SELECT id, degree + CASE WHEN src = 'order' THEN 1 ELSE 0 END AS degree, type, name, src, community FROM degrees JOIN nodes USING (id)
  UNION ALL SELECT '{V.NOISE_MODULES[0]}', (SELECT count(*) FROM orders), 'module', 'os', NULL, NULL)
SELECT id, CAST(degree AS BIGINT) AS degree, type, name, src, community FROM noisy WHERE id NOT IN {V.NOISE_MODULES} ORDER BY degree DESC, id LIMIT 20""", star=True)
def god_nodes(spark, sf_dir):
    """With a module of the noise list that every order points at, so that it would come first."""
    g, noise = star_graph(spark, sf_dir), V.NOISE_MODULES[0]
    node = merge.completed_nodes(spark.createDataFrame([(noise, "module", "os")], "id string, type string, name string"))
    more = g.nodes.where("src = 'order'").select(F.col("id").alias("source"), F.lit(noise).alias("target"), F.lit("imports").alias("type"))
    return longs(analytics.hubs(g.nodes.unionByName(node), g.edges.unionByName(merge.completed_edges(more))), "community")


@query(" SELECT id, degree FROM degrees ORDER BY degree DESC, id LIMIT 5", star=True)
def god_nodes_fallback(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return analytics.fallback_hubs(g.nodes, g.edges)


def _assignment(g: Graph) -> DataFrame:
    """A deterministic stand-in for communities."""
    return g.nodes.select("community", "id")


@query("""
, x AS (SELECT e.*, s.community AS cs, t.community AS ct FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE s.community <> t.community),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY tab, k, sub) = 1)
SELECT CAST(a.degree + b.degree AS BIGINT) AS score, source, target, cs AS source_community, ct AS target_community, type, src
FROM f JOIN degrees a ON a.id = source JOIN degrees b ON b.id = target ORDER BY score DESC, tab, k, sub LIMIT 10""", star=True)
def surprises(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return longs(analytics.surprises(g.nodes, g.edges, _assignment(g)).drop("ord"), "source_community", "target_community")


@query(" SELECT type, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY type", star=True)
def report_type_counts(spark, sf_dir):
    return analytics.type_counts(star_graph(spark, sf_dir).nodes)


@query(" SELECT confidence, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY confidence", star=True)
def report_confidence_counts(spark, sf_dir):
    return analytics.confidence_counts(star_graph(spark, sf_dir).edges)


@query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS i FROM nodes)
SELECT community, CAST(count(*) AS BIGINT) AS n, string_agg(name, '|' ORDER BY id) FILTER (i <= 5) AS sample FROM r GROUP BY community""", star=True)
def report_communities(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return longs(analytics.community_sizes(g.nodes, _assignment(g)).withColumn("sample", F.array_join("sample", "|")), "community")


@query(" SELECT community, string_agg(id, ' ' ORDER BY id) AS members FROM nodes GROUP BY community", star=True)
def community_members(spark, sf_dir):
    x = analytics.community_members(_assignment(star_graph(spark, sf_dir)))
    return longs(x.withColumn("members", F.array_join("members", " ")), "community")


@query(" SELECT (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS nodes, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS edges, (SELECT CAST(count(DISTINCT community) AS BIGINT) FROM nodes) AS communities", star=True)
def graph_stats(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return analytics.stats(g.nodes, g.edges, _assignment(g))


@query(" SELECT CAST(count(*) AS BIGINT) AS prior, CAST(count(*) FILTER (src <> 'order') AS BIGINT) AS new, count(*) > 1.5 * count(*) FILTER (src <> 'order') AS refused FROM nodes", star=True)
def shrink_guard(spark, sf_dir):
    """The whole graph against the one without orders."""
    nodes = star_graph(spark, sf_dir).nodes
    prior, new = nodes.count(), nodes.where("src <> 'order'").count()
    return spark.createDataFrame([(prior, new, store.shrinks(prior, new))], "prior long, new long, refused boolean")


@query("""
, l AS (SELECT CASE WHEN a.source < a.target THEN a.source ELSE a.target END AS a, CASE WHEN a.source < a.target THEN a.target ELSE a.source END AS b FROM edges a),
u AS (SELECT DISTINCT s.community AS ca, t.community AS cb, a, b FROM l JOIN nodes s ON s.id = a JOIN nodes t ON t.id = b),
d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM u UNION ALL SELECT cb FROM u) GROUP BY c),
i AS (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (ca = cb) AS DOUBLE) AS inside FROM u)
SELECT round(inside / m - (SELECT sum(CAST(d AS DOUBLE) * d) FROM d) / (4 * m * m), 6) AS modularity FROM i""", star=True)
def modularity(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return community.modularity(g.edges, _assignment(g))


@query(" SELECT CAST(greatest(1, floor(count(*) * 0.25)) AS BIGINT) AS threshold FROM nodes", star=True)
def community_threshold(spark, sf_dir):
    return community.threshold(star_graph(spark, sf_dir).nodes)


@query()
def louvain(spark, sf_dir):
    """Communities of the whole star graph."""
    g = star_graph(spark, sf_dir)
    return community.communities(g)


@query(" SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS disconnected, true AS better FROM nodes", star=True)
def louvain_quality(spark, sf_dir):
    """Nodes with a community, communities that are not connected, and whether modularity is above 0.17, which sequential moves in one task
    pass by 0.03 to 0.07 on these tables."""
    g = star_graph(spark, sf_dir)
    with tables(spark) as keep:
        number, links = known = community.numbered_graph(keep, g)
        found = keep(community.communities(g, known=known).join(number, "id").select("id", "n", "community"))
        of = found.select(F.col("n").alias("id"), "community")
        side = lambda end: of.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
        inside = links.join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b", "w")
        parts = of.join(community.parts(keep, inside, found.count()), "id", "left").groupBy("community").agg(F.countDistinct(F.coalesce("component", "id")).alias("n"))
        counts = found.agg(F.count("*").alias("nodes"), F.lit(1).alias("k")).join(parts.agg(F.count_if(F.col("n") > 1).alias("disconnected"), F.lit(1).alias("k")), "k")
        value = community.modularity(links.select(F.col("a").alias("source"), F.col("b").alias("target")), of)
        return cut(counts.join(value.select((F.col("modularity") > 0.17).alias("better"), F.lit(1).alias("k")), "k").drop("k"))


@query("""
, h AS (SELECT type, name, row_number() OVER (ORDER BY degree DESC, id) AS pos FROM degrees JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 3)
SELECT CAST(pos AS BIGINT) AS pos, CASE type WHEN 'function' THEN 'How does the `' || name || '` function work?' WHEN 'class' THEN 'What does the `' || name || '` class do?' WHEN 'module' THEN 'What relies on the `' || name || '` module?'
  WHEN 'file' THEN 'Walk me through `' || name || '`.' ELSE 'What is `' || name || '`?' END AS question FROM h
UNION ALL SELECT 4, 'How are the major subsystems connected?' UNION ALL SELECT 5, 'What''s the architectural entry point of this project?'""", star=True)
def suggest_questions(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return analytics.questions(analytics.hubs(g.nodes, g.edges), 5)


# --- Rendering and sinks ---------------------------------------------------------------------------------------------


@query(" SELECT id, 'NODE id=' || id || ' type=' || type || ' name=' || name || ' src=' || src || ':' || line || ' confidence=' || confidence AS line FROM nodes", star=True)
def node_lines(spark, sf_dir):
    return render.node_lines(star_graph(spark, sf_dir).nodes)


@query(" SELECT source, target, 'EDGE ' || source || ' --[' || type || ']--> ' || target || ' src=' || src || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || ' confidence=' || confidence AS line FROM edges", star=True)
def edge_lines(spark, sf_dir):
    return render.edge_lines(star_graph(spark, sf_dir).edges)


@query(f"{SEEDS_SQL}, reach(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT b, depth + 1 FROM reach JOIN both_ways ON a = id WHERE depth < 2) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY id", star=True)
def answer_nodes(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    first = search.seed_ranks(g.nodes, TERMS).select("id", (F.col("rank") - 1).alias("pos"))
    return longs(traverse.bfs(g, first, 2).select("id", "depth"), "depth")


def _text_rows(spark, value: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(value.split("\n"))), "pos long, line string")


#: Characters that the lines of regions and nations may take: it ends among the nations.
REGION_TOKENS = 500


def _region_lines_sql() -> str:
    """Lines in order, then a walk that takes what fits: a node that does not fit ends it, an edge that does not is left out."""
    either = lambda c: f"coalesce({c}, '?')"
    return f"""
, n AS (SELECT id, CASE WHEN k % 3 > 0 THEN type END AS type, CASE WHEN k % 4 > 0 THEN name END AS name, CASE WHEN k % 5 > 0 THEN src END AS src, line, confidence, row_number() OVER (ORDER BY tab, k) AS place FROM nodes WHERE tab < 2),
l AS (SELECT place, 0 AS part, 'NODE id=' || id || ' type=' || {either("type")} || ' name=' || coalesce(name, id) || ' src=' || {either("src")} || ':' || line || ' confidence=' || confidence AS line FROM n
  UNION ALL SELECT s.place, 1, 'EDGE ' || source || ' --[' || e.type || ']--> ' || target || ' src=' || e.src || ':' || e.line || ' confidence=' || e.confidence FROM edges e JOIN n s ON s.id = source JOIN n t ON t.id = target),
f AS (SELECT row_number() OVER (ORDER BY place, part) AS i, part, line, length(line) + 1 AS cost FROM l),
walk AS (SELECT CAST(0 AS BIGINT) AS i, {REGION_TOKENS * V.CHARACTERS_PER_TOKEN} AS room, false AS taken, false AS over
  UNION ALL SELECT f.i, CASE WHEN cost <= room AND NOT over THEN room - cost ELSE room END, cost <= room AND NOT over, over OR (part = 0 AND cost > room) FROM walk JOIN f ON f.i = walk.i + 1)
SELECT CAST(row_number() OVER (ORDER BY f.i) - 1 AS BIGINT) AS pos, line FROM walk JOIN f USING (i) WHERE taken"""


@query(_region_lines_sql(), star=True)
def render_regions(spark, sf_dir):
    """Regions and nations under a budget; some have no type, name or source."""
    g = star_graph(spark, sf_dir)
    k = F.col("ord.ordinal")
    nodes = g.nodes.where("src IN ('region', 'nation')").withColumns({"type": F.when(k % 3 > 0, F.col("type")), "name": F.when(k % 4 > 0, F.col("name")), "src": F.when(k % 5 > 0, F.col("src"))})
    order = nodes.select("id", F.row_number().over(Window.orderBy("ord")).cast("long").alias("pos"))  # the nodes of two small tables
    return _text_rows(spark, render.render(Graph(nodes, g.edges), order, REGION_TOKENS))


@query()
def render_budget(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return _text_rows(spark, render.render(g, traverse.bfs(g, _start(spark), 2).select("id", "pos"), 500))


@query()
def answer(spark, sf_dir):
    return _text_rows(spark, render.answer(star_graph(spark, sf_dir), QUESTION))


@query(" SELECT id, name, type, community, degree, src FROM nodes JOIN degrees USING (id)", star=True)
def viz_nodes(spark, sf_dir):
    return longs(sinks.viz_nodes(star_graph(spark, sf_dir)).drop("ord"), "community")


@query(" SELECT source, target, type FROM edges", star=True)
def viz_links(spark, sf_dir):
    return sinks.viz_links(star_graph(spark, sf_dir)).drop("ord")


CALLFLOW_SQL = ", top AS MATERIALIZED (SELECT id, name, replace(id, ':', '_') AS mermaid_id, degree FROM degrees JOIN nodes USING (id) ORDER BY degree DESC, tab, k LIMIT 40)"


@query(CALLFLOW_SQL + " SELECT id, name, mermaid_id, degree FROM top", star=True)
def callflow_nodes(spark, sf_dir):
    return sinks.callflow_nodes(star_graph(spark, sf_dir)).drop("ord")


@query(CALLFLOW_SQL.replace("LIMIT 40", "LIMIT 1600") + " SELECT s.mermaid_id AS source_id, t.mermaid_id AS target_id, type FROM edges JOIN top s ON s.id = source JOIN top t ON t.id = target", star=True)
def callflow_edges(spark, sf_dir):
    """With enough sections that hubs touch each other."""
    return sinks.callflow_edges(star_graph(spark, sf_dir), 200).select("source_id", "target_id", "type")


@query("""
SELECT p_partkey, left(CASE WHEN regexp_matches(s, '^[A-Za-z]') THEN s ELSE 'n_' || s END, 64) AS mermaid_id
FROM (SELECT p_partkey, regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN '7' ELSE '' END || p_brand || '.' || p_name || '::' || p_type || repeat('x', p_size), '[^A-Za-z0-9_]', '_', 'g') AS s FROM part)""")
def mermaid_ids(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "7").otherwise(""), "p_brand", F.lit("."), "p_name", F.lit("::"), "p_type", F.repeat(F.lit("x"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", text.mermaid_id(name).alias("mermaid_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's seeds and their two-hop neighbourhood, in reading order, as text lines."""
    g = star_graph(spark, sf_dir)
    first = search.seed_ranks(g.nodes, TERMS).select("id", (F.col("rank") - 1).alias("pos"))
    reached = traverse.bfs(g, first, 2)
    return reached.join(render.node_lines(g.nodes), "id").select("pos", "depth", "id", "line")


# --- Streams ---------------------------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, max_by(struct_pack(gone := event_type = 'error', v := value), (ts, event_id)) AS now FROM events GROUP BY ALL),
x AS (SELECT user_id, day, now, lag(now) OVER (PARTITION BY user_id ORDER BY day) AS was FROM l),
y AS (SELECT user_id, CAST(day AS BIGINT) AS day, CASE WHEN NOT now.gone AND coalesce(was.gone, true) THEN 'added' WHEN now.gone AND NOT coalesce(was.gone, true) THEN 'deleted'
  WHEN NOT now.gone AND was.v IS DISTINCT FROM now.v THEN 'changed' END AS change, CASE WHEN NOT now.gone THEN now.v END AS value FROM x)
SELECT * FROM y WHERE change IS NOT NULL""")
def event_changes(spark, sf_dir):
    """Events as a log of single changes to users, errors as deletions: the net changes of every day."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    x = changes.net_changes(table(spark, sf_dir, "events"), ["user_id"], day, ["ts", "event_id"], "value", F.col("event_type") == "error")
    return x.select("user_id", F.col("offset").alias("day"), "change", "value")
