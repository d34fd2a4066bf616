"""Registered queries over Python sources that Spark derives from parts: a file has the parts of a brand in a block of 200 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.jobs.queries import query
from graphloom.jobs.tables import read
from graphloom.operators import compile as C
from graphloom.operators import resolve as R
from graphloom.sources import python_source as P
from graphloom.sources import skeleton as K

_PATH = "lower(replace(p_brand, '#', '_')) || '/block_' || CAST(p_partkey // 200 AS VARCHAR) || '.py'"
#: Five lines a part after two lines of head: class, docstring, method, its body, constant.
_PARTS = f"parts AS (SELECT p_partkey AS k, p_name AS title, {_PATH} AS path, lower(replace(p_brand, '#', '_')) || '/block_' || CAST(p_partkey // 200 - 1 AS VARCHAR) || '.py' AS before, CAST(5 * (row_number() OVER (PARTITION BY {_PATH} ORDER BY p_partkey) - 1) + 3 AS INT) AS line FROM part)"


def sources(spark, d) -> DataFrame:
    """rel_path, source. A file has 200 parts at most, so no group grows with the data."""
    key, block = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 200).cast("long")
    part = read(spark, d, "part").withColumn("folder", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).withColumn("block", block)
    lines = F.array(F.concat(F.lit("class P"), key, F.lit("(Base"), (F.col("p_partkey") % 7).cast("string"), F.lit("):")), F.concat(F.lit('    """'), "p_name", F.lit('"""')), F.lit("    def make(self, n):"), F.concat(F.lit("        return helper_"), (F.col("p_partkey") % 5).cast("string"), F.lit("(len(n))")), F.concat(F.lit("C"), key, F.lit(" = int(1)")))
    files = part.groupBy("folder", "block").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.array_join(lines, "\n").alias("text")))).alias("parts"))
    head = F.concat(F.lit("import os\nfrom .block_"), F.greatest(F.col("block") - 1, F.lit(0)).cast("string"), F.lit(" import make\n"))
    path = F.concat("folder", F.lit("/block_"), F.col("block").cast("string"), F.lit(".py"))
    return files.select(path.alias("rel_path"), F.concat(head, F.array_join("parts.text", "\n"), F.lit("\n")).alias("source"))


@query(f"""WITH {_PARTS} SELECT path || '::P' || k AS node_id, 'CLASS' AS type, CAST(NULL AS VARCHAR) AS class_name, line AS start_line, line + 3 AS end_line, CAST(NULL AS VARCHAR) AS signature, title AS doc FROM parts
UNION ALL SELECT path || '::P' || k || '.make', 'FUNCTION', 'P' || k, line + 2, line + 3, '(self, n)', NULL FROM parts
UNION ALL SELECT path || '::C' || k, 'CONSTANT', NULL, line + 4, line + 4, NULL, NULL FROM parts""")
def source_entities(spark, d):
    return P.entities(C.parsed_once(sources(spark, d))).select("node_id", "type", "class_name", "start_line", "end_line", "signature", "doc")


@query(f"WITH {_PARTS} SELECT path || '::P' || k || '.make' AS caller_id, 'P' || k AS class_name, unnest(['len', 'helper_' || CAST(k % 5 AS VARCHAR)]) AS symbol FROM parts UNION ALL SELECT DISTINCT path, CAST(NULL AS VARCHAR), 'int' FROM parts")
def source_calls(spark, d):
    return P.calls(C.parsed_once(sources(spark, d))).select("caller_id", "class_name", "symbol")


@query(f"WITH {_PARTS} SELECT path || '::P' || k AS node_id, 'Base' || CAST(k % 7 AS VARCHAR) AS base FROM parts")
def source_bases(spark, d):
    return P.class_bases(P.parse(sources(spark, d))).select("node_id", "base")


@query(f"WITH {_PARTS} SELECT DISTINCT path AS src, before AS dst FROM parts WHERE before IN (SELECT path FROM parts)")
def source_relative_imports(spark, d):
    return P.relative_imports(C.parsed_once(sources(spark, d)))


@query(f"WITH {_PARTS} SELECT DISTINCT path AS import_id, 'os' AS name, CAST(NULL AS VARCHAR) AS file_path FROM parts")
def source_absolute_imports(spark, d):
    """No file here is called os, so each of these imports leads outside."""
    parsed = C.parsed_once(sources(spark, d))
    return R.absolute_imports(P.imported_names(parsed), P.modules(parsed))


@query(f"""WITH {_PARTS}, s AS (SELECT path || '::P' || k AS node_id, concat_ws(chr(10), 'Type: CLASS', 'Name: P' || k, 'Doc: ' || title) AS text,
  concat_ws(chr(10), 'Type: CLASS', 'Name: P' || k, 'Inherits: Base' || (k % 7), 'Docstring: ' || title, 'Methods:', '  - def make(self, n)', 'Calls: helper_' || (k % 5) || ', len', 'File: ' || path) AS skeleton FROM parts
UNION ALL SELECT path || '::P' || k || '.make', concat_ws(chr(10), 'Type: FUNCTION', 'Name: make', 'Class: P' || k),
  concat_ws(chr(10), 'Signature: def make(self, n)', 'Class: P' || k, 'Calls: helper_' || (k % 5) || ', len', 'Return expressions: helper_' || (k % 5) || '(len(n))', 'File: ' || path) FROM parts
UNION ALL SELECT path || '::C' || k, 'Type: CONSTANT' || chr(10) || 'Name: C' || k, 'Type: CONSTANT' || chr(10) || 'Name: C' || k FROM parts)
SELECT node_id, skeleton, CASE WHEN text = skeleton THEN text ELSE text || chr(10) || chr(10) || skeleton END AS passage FROM s""")
def semantic_skeleton(spark, d):
    own = P.entities(C.parsed_once(sources(spark, d)))
    own = own.withColumn("text", T.embedding_text(F.col("type"), F.col("name"), F.col("class_name"), F.array().cast("array<string>"), F.col("doc")))
    parts = [F.col(c) for c in ("chunk", "text", "class_name", "file_path")]
    return own.select("node_id", K.skeleton(*parts).alias("skeleton"), K.rerank_passage(*parts).alias("passage"))


#: A program in which names resolve: a file of shared classes and functions for each brand, and files of parts that import it and the file before.
_FOLDER = "lower(replace(p_brand, '#', '_'))"
_PROGRAM = f"""parts AS (SELECT p_partkey AS k, p_name AS title, {_FOLDER} AS folder, p_partkey // 200 AS block, {_FOLDER} || '/block_' || CAST(p_partkey // 200 AS VARCHAR) || '.py' AS path, {_FOLDER} || '/base.py' AS base,
  CAST(row_number() OVER (PARTITION BY {_FOLDER}, p_partkey // 200 ORDER BY p_partkey) AS INT) AS n FROM part),
folders AS (SELECT DISTINCT folder FROM parts), blocks AS (SELECT DISTINCT folder, block, path, base FROM parts),
jobs AS (SELECT folder, base, i FROM (SELECT DISTINCT folder, base FROM parts), unnest(range(5)) AS r(i))"""


def program(spark, d) -> DataFrame:
    """rel_path, source. A file has 200 parts at most, so no group grows with the data."""
    key, folder = F.col("p_partkey").cast("string"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    part = read(spark, d, "part").withColumn("folder", folder).withColumn("block", F.floor(F.col("p_partkey") / 200).cast("long"))
    shared = "".join(f"class Base_FOLDER_{i}:\n    pass\ndef job_FOLDER_{i}(n):\n    return n\n" for i in range(5))
    base = part.select("folder").distinct().select(F.concat("folder", F.lit("/base.py")).alias("rel_path"), F.replace(F.lit(shared), F.lit("FOLDER"), F.col("folder")).alias("source"))
    lines = F.concat(
        F.lit("class P"), key, F.lit("(Base_"), "folder", F.lit("_"), (F.col("p_partkey") % 5).cast("string"), F.lit('):\n    """'), "p_name", F.lit('"""\n    def make(self, n):\n        return self.size(n) + job_'), "folder",
        F.lit("_"), (F.col("p_partkey") % 5).cast("string"), F.lit("(n)\n    def size(self, n):\n        def half(m):\n            return len(m)\n        return scale(half(n))\nC"), key, F.lit(": int = 1\n"),
    )
    files = part.groupBy("folder", "block").agg(F.array_sort(F.collect_list(F.struct("p_partkey", lines.alias("text")))).alias("parts"))
    before = F.when(F.col("block") > 0, F.concat(F.lit("from "), "folder", F.lit(" import block_"), (F.col("block") - 1).cast("string"))).otherwise(F.lit("import os"))
    head = F.concat(F.lit("from .base import Base_"), "folder", F.lit("_0\n"), before, F.lit("\ndef scale(n):\n    return make(n)\n"))
    blocks = files.select(F.concat("folder", F.lit("/block_"), F.col("block").cast("string"), F.lit(".py")).alias("rel_path"), F.concat(head, F.array_join("parts.text", "")).alias("source"))
    return base.unionByName(blocks)


@query(f"""WITH {_PROGRAM}
SELECT path || '::P' || k AS node_id, 'CLASS' AS type, 'P' || k AS name, path AS file_path, CAST(NULL AS VARCHAR) AS class_name, 9 * (n - 1) + 5 AS start_line, CAST(NULL AS VARCHAR) AS signature, 'Type: CLASS' || chr(10) || 'Name: P' || k || chr(10) || 'Inherits: Base_' || folder || '_' || (k % 5) || chr(10) || 'Doc: ' || title AS text FROM parts
UNION ALL SELECT path || '::P' || k || '.' || m, 'FUNCTION', m, path, 'P' || k, 9 * (n - 1) + pos, CASE m WHEN 'half' THEN '(m)' ELSE '(self, n)' END, 'Type: FUNCTION' || chr(10) || 'Name: ' || m || chr(10) || 'Class: P' || k FROM parts, (VALUES ('make', 7), ('size', 9), ('half', 10)) AS f(m, pos)
UNION ALL SELECT path || '::C' || k, 'CONSTANT', 'C' || k, path, NULL, 9 * (n - 1) + 13, NULL, NULL FROM parts
UNION ALL SELECT path || '::scale', 'FUNCTION', 'scale', path, NULL, 3, '(n)', 'Type: FUNCTION' || chr(10) || 'Name: scale' FROM blocks
UNION ALL SELECT base || '::' || 'Base_' || folder || '_' || i, 'CLASS', 'Base_' || folder || '_' || i, base, NULL, 4 * i + 1, NULL, 'Type: CLASS' || chr(10) || 'Name: Base_' || folder || '_' || i FROM jobs
UNION ALL SELECT base || '::' || 'job_' || folder || '_' || i, 'FUNCTION', 'job_' || folder || '_' || i, base, NULL, 4 * i + 3, '(n)', 'Type: FUNCTION' || chr(10) || 'Name: job_' || folder || '_' || i FROM jobs
UNION ALL SELECT path, 'FILE', 'block_' || block || '.py', NULL, NULL, NULL, NULL, NULL FROM blocks
UNION ALL SELECT folder || '/base.py', 'FILE', 'base.py', NULL, NULL, NULL, NULL, NULL FROM folders UNION ALL SELECT folder, 'MODULE', folder, NULL, NULL, NULL, NULL, NULL FROM folders""")
def graph_nodes(spark, d):
    return C.compile_graph(program(spark, d))[0].select("node_id", "type", "name", "file_path", "class_name", "start_line", "signature", "text")


@query(f"""WITH {_PROGRAM}, kinds AS (SELECT path AS src, path || '::P' || k AS dst, 'CONTAINS' AS relationship FROM parts UNION ALL SELECT path, path || '::P' || k || '.' || m, 'CONTAINS' FROM parts, (VALUES ('make'), ('size'), ('half')) AS f(m)
UNION ALL SELECT path, path || '::C' || k, 'CONTAINS' FROM parts UNION ALL SELECT path, path || '::scale', 'CONTAINS' FROM blocks
UNION ALL SELECT base, base || '::Base_' || folder || '_' || i, 'CONTAINS' FROM jobs UNION ALL SELECT base, base || '::job_' || folder || '_' || i, 'CONTAINS' FROM jobs)
SELECT * FROM kinds
UNION ALL SELECT folder, path, 'MEMBER_OF' FROM blocks UNION ALL SELECT folder, folder || '/base.py', 'MEMBER_OF' FROM folders
UNION ALL SELECT path, base, 'IMPORTS' FROM blocks UNION ALL SELECT a.path, b.path, 'IMPORTS' FROM blocks a JOIN blocks b ON a.folder = b.folder AND a.block = b.block + 1
UNION ALL SELECT path || '::P' || k, base || '::Base_' || folder || '_' || (k % 5), 'INHERITS_FROM' FROM parts
UNION ALL SELECT path || '::P' || k || '.make', path || '::P' || k || '.size', 'CALLS' FROM parts
UNION ALL SELECT path || '::P' || k || '.make', base || '::job_' || folder || '_' || (k % 5), 'CALLS' FROM parts
UNION ALL SELECT path || '::P' || k || '.size', path || '::scale', 'CALLS' FROM parts UNION ALL SELECT path || '::P' || k || '.size', path || '::P' || k || '.half', 'CALLS' FROM parts
UNION ALL SELECT path || '::scale', path || '::P' || min(k) || '.make', 'CALLS' FROM parts GROUP BY path""")
def graph_edges(spark, d):
    """All four ways of resolving a call are taken: a member, the file's own, the first of that name in it, and what it imports."""
    return C.compile_graph(program(spark, d))[1]


@query(f"WITH {_PROGRAM} SELECT a.path AS import_id, f.name, CASE WHEN f.name = a.folder THEN NULL ELSE b.path END AS file_path FROM blocks a LEFT JOIN blocks b ON a.folder = b.folder AND a.block = b.block + 1, unnest(CASE WHEN a.block = 0 THEN ['os'] ELSE [a.folder, a.folder || '.block_' || (a.block - 1)] END) AS f(name)")
def program_absolute_imports(spark, d):
    facts = C.parsed_once(program(spark, d))
    return R.absolute_imports(P.imported_names(facts), P.modules(facts))
