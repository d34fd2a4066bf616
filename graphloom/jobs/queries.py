"""The registered queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.jobs.tables import CENTRAL_SQL, NODES_SQL, graph, nodes, ranked_nodes, read
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.operators import search as S
from graphloom.operators import sync as Y
from graphloom.operators import vector_index as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {CENTRAL_SQL} SELECT node_id, calls_in_degree, round(call_centrality, 9) AS call_centrality FROM central")
def call_centrality(spark, d):
    return G.call_centrality(*graph(spark, d)).select("node_id", "calls_in_degree", F.round("call_centrality", 9).alias("call_centrality"))


NODE_TYPES, EDGE_TYPES = ["MODULE", "FILE", "CLASS", "FUNCTION"], ["SUBMODULE_OF", "MEMBER_OF", "CONTAINS", "IMPORTS", "INHERITS_FROM", "CALLS"]


@query(f"""WITH {NODES_SQL}, an AS (SELECT type FROM nodes UNION ALL SELECT 'FILE' FROM (SELECT DISTINCT file_path FROM nodes) UNION ALL SELECT 'MODULE' FROM region UNION ALL SELECT 'CLASS' FROM nation),
ae AS (SELECT relationship AS type FROM edges UNION ALL SELECT 'CONTAINS' FROM nodes UNION ALL SELECT 'SUBMODULE_OF' FROM nation),
dom AS (SELECT 'node' AS kind, unnest(['MODULE', 'FILE', 'CLASS', 'FUNCTION']) AS label UNION ALL SELECT 'edge', unnest(['SUBMODULE_OF', 'MEMBER_OF', 'CONTAINS', 'IMPORTS', 'INHERITS_FROM', 'CALLS']))
SELECT kind, label, CASE kind WHEN 'node' THEN (SELECT count(*) FROM an WHERE type = label) ELSE (SELECT count(*) FROM ae WHERE type = label) END AS n FROM dom
UNION ALL SELECT 'node', 'total', count(*) FROM an UNION ALL SELECT 'edge', 'total', count(*) FROM ae""")
def graph_summary(spark, d):
    n, e = graph(spark, d)
    kinds = n.select("type").unionByName(n.select("file_path").distinct().select(F.lit("FILE").alias("type"))).unionByName(read(spark, d, "region").select(F.lit("MODULE").alias("type"))).unionByName(read(spark, d, "nation").select(F.lit("CLASS").alias("type")))
    rels = e.select("relationship").unionByName(n.select(F.lit("CONTAINS").alias("relationship"))).unionByName(read(spark, d, "nation").select(F.lit("SUBMODULE_OF").alias("relationship")))
    return G.summary(kinds, rels, NODE_TYPES, EDGE_TYPES)


_PATHS = "paths AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _paths(spark, d):
    return read(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(f"""WITH {_PATHS}, s AS (SELECT path, string_split(path, '/') AS p FROM paths)
SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS src, array_to_string(p[1:i], '/') AS dst, 'SUBMODULE_OF' AS relationship FROM s, unnest(range(2, len(p))) AS r(i)
UNION ALL SELECT array_to_string(p[1:len(p) - 1], '/'), path, 'MEMBER_OF' FROM s WHERE len(p) > 1""")
def folder_tree(spark, d):
    return G.folder_tree(_paths(spark, d))


@query(f"""WITH {_PATHS} SELECT path, len(list_filter(string_split(path, '/'), lambda x: x IN ('en', 'build', '.*'))) > 0 AS ignored FROM paths""")
def ignore_filter(spark, d):
    """A path is ignored if one of its segments equals a pattern; patterns are no globs."""
    return _paths(spark, d).distinct().select("path", F.arrays_overlap(F.split("path", "/"), F.array(F.lit("en"), F.lit("build"), F.lit(".*"))).alias("ignored"))


@query(f"""WITH {CENTRAL_SQL}, sides AS (SELECT a.node_id AS anchor, 'caller' AS side, src AS node_id FROM nodes a JOIN edges ON dst = a.node_id UNION ALL SELECT a.node_id, 'callee', dst FROM nodes a JOIN edges ON src = a.node_id),
r AS (SELECT anchor, side, node_id, row_number() OVER (PARTITION BY anchor, side ORDER BY call_centrality DESC, node_id) AS rank FROM sides JOIN central USING (node_id))
SELECT anchor, side, node_id, rank FROM r WHERE rank <= 5""")
def call_neighbors_topk(spark, d):
    n, e = graph(spark, d)
    near = G.call_neighbours(e, n.select(F.col("node_id").alias("anchor")))
    scored = near.join(G.call_centrality(n, e).select("node_id", "call_centrality"), "node_id")
    return G.ranked(scored, ["anchor", "side"], F.desc("call_centrality"), F.col("node_id"), n=5).select("anchor", "side", "node_id", "rank")


@query(f"""WITH {CENTRAL_SQL}, sides AS (SELECT a.node_id AS anchor, 1 AS step, src AS node_id FROM nodes a JOIN edges ON dst = a.node_id UNION ALL SELECT a.node_id, 3, dst FROM nodes a JOIN edges ON src = a.node_id),
r AS (SELECT anchor, step, node_id, row_number() OVER (PARTITION BY anchor, step ORDER BY call_centrality DESC, node_id) AS k FROM sides JOIN central USING (node_id))
SELECT anchor, step, CASE step WHEN 1 THEN 'caller' ELSE 'callee' END AS role, node_id FROM r WHERE k = 1 UNION ALL SELECT node_id, 2, 'anchor', node_id FROM nodes""")
def call_chain(spark, d):
    """Best caller, the anchor itself, best callee."""
    n, e = graph(spark, d)
    near = G.call_neighbours(e, n.select(F.col("node_id").alias("anchor"))).join(G.call_centrality(n, e).select("node_id", "call_centrality"), "node_id")
    best = G.ranked(near, ["anchor", "side"], F.desc("call_centrality"), F.col("node_id"), n=1)
    sides = best.select("anchor", F.when(F.col("side") == "caller", 1).otherwise(3).alias("step"), F.col("side").alias("role"), "node_id")
    return sides.unionByName(n.select(F.col("node_id").alias("anchor"), F.lit(2).alias("step"), F.lit("anchor").alias("role"), "node_id"))


@query(f"""WITH {NODES_SQL}, gone AS (SELECT node_id FROM nodes WHERE file_path = 'brand_11.py' UNION ALL SELECT 'brand_11.py')
SELECT * FROM edges WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)""")
def strip_calls_for_file(spark, d):
    n, e = graph(spark, d)
    return G.strip_calls(e, n, spark.createDataFrame([("brand_11.py",)], "file_path string"))


_CALLS_SQL = """defs AS (SELECT 'FUNCTION' AS type, replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '_')) || '.py' AS file_path, min(p_partkey) AS node_ord FROM part GROUP BY ALL),
nd AS (SELECT *, file_path || '::' || name AS node_id FROM defs),
imp AS (SELECT DISTINCT lower(replace(a.p_brand, '#', '_')) || '.py' AS src, lower(replace(b.p_brand, '#', '_')) || '.py' AS dst FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey),
calls AS (SELECT DISTINCT lower(replace(a.p_brand, '#', '_')) || '.py' AS file_path, lower(replace(a.p_brand, '#', '_')) || '.py::' || replace(a.p_name, ' ', '_') AS caller_id, replace(b.p_name, ' ', '_') AS symbol FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_linenumber * 10)"""


@query(f"""WITH {_CALLS_SQL}, reg AS (SELECT name, arg_max(file_path, node_ord) AS there FROM nd GROUP BY name)
SELECT DISTINCT caller_id AS src, coalesce(a.node_id, CASE WHEN imp.dst IS NOT NULL THEN b.node_id END) AS dst FROM calls c LEFT JOIN nd a ON a.node_id = c.file_path || '::' || symbol LEFT JOIN reg ON reg.name = symbol
LEFT JOIN imp ON imp.src = c.file_path AND imp.dst = there LEFT JOIN nd b ON b.node_id = there || '::' || symbol WHERE coalesce(a.node_id, CASE WHEN imp.dst IS NOT NULL THEN b.node_id END) IS NOT NULL""")
def callee_resolution(spark, d):
    part, lines = read(spark, d, "part"), read(spark, d, "lineitem")
    name, path = F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".py"))
    defs = part.select("p_partkey", name.alias("name"), path.alias("file_path"))
    nd = defs.groupBy("name", "file_path").agg(F.min("p_partkey").alias("node_ord")).withColumn("node_id", F.concat_ws("::", "file_path", "name")).withColumn("type", F.lit("FUNCTION")).withColumn("is_method", F.lit(False))
    caller = lines.select("l_partkey", "l_suppkey", "l_linenumber").join(defs.select(F.col("p_partkey").alias("l_partkey"), F.col("name").alias("own"), "file_path"), "l_partkey")
    imports = caller.join(defs.select(F.col("p_partkey").alias("l_suppkey"), F.col("file_path").alias("dst")), "l_suppkey").select(F.col("file_path").alias("src"), "dst").distinct()
    called = caller.withColumn("k", (F.col("l_linenumber") * 10).cast("long")).join(defs.select(F.col("p_partkey").alias("k"), F.col("name").alias("symbol")), "k")
    calls = called.select("file_path", F.concat_ws("::", "file_path", "own").alias("caller_id"), F.lit(None).cast("string").alias("class_name"), "symbol").distinct()
    return R.callees(calls, nd, imports)


@query("""WITH cls AS (SELECT n_name AS name, 'r' || n_regionkey || '.py' AS file_path, n_nationkey AS node_ord FROM nation UNION ALL SELECT r_name, 'r' || r_regionkey || '.py', r_regionkey FROM region),
nd AS (SELECT *, file_path || '::' || name AS node_id FROM cls), reg AS (SELECT name, arg_max(file_path, node_ord) AS there FROM nd GROUP BY name),
c AS (SELECT DISTINCT 'r' || n_regionkey || '.py::' || n_name AS src, 'r' || n_regionkey || '.py' AS file_path, r_name AS base FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = c_custkey % 5),
imp AS (SELECT 'r' || r_regionkey || '.py' AS src, 'r' || ((r_regionkey + 1) % 5) || '.py' AS dst FROM region)
SELECT DISTINCT c.src, coalesce(a.node_id, CASE WHEN imp.dst IS NOT NULL THEN there || '::' || base END) AS dst FROM c LEFT JOIN nd a ON a.node_id = c.file_path || '::' || base LEFT JOIN reg ON reg.name = base
LEFT JOIN imp ON imp.src = c.file_path AND imp.dst = there WHERE coalesce(a.node_id, CASE WHEN imp.dst IS NOT NULL THEN there || '::' || base END) IS NOT NULL""")
def inheritance_resolution(spark, d):
    nation, region, customer = (read(spark, d, t) for t in ("nation", "region", "customer"))
    path = lambda k: F.concat(F.lit("r"), k.cast("string"), F.lit(".py"))
    nd = nation.select(F.col("n_name").alias("name"), path(F.col("n_regionkey")).alias("file_path"), F.col("n_nationkey").alias("node_ord")).unionByName(region.select(F.col("r_name").alias("name"), path(F.col("r_regionkey")).alias("file_path"), F.col("r_regionkey").alias("node_ord")))
    nd = nd.withColumn("node_id", F.concat_ws("::", "file_path", "name")).withColumn("type", F.lit("CLASS"))
    bases = customer.select("c_nationkey", (F.col("c_custkey") % 5).cast("int").alias("r_regionkey")).distinct().join(region, "r_regionkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    classes = bases.select(F.concat_ws("::", path(F.col("n_regionkey")), "n_name").alias("node_id"), path(F.col("n_regionkey")).alias("file_path"), F.col("r_name").alias("base"))
    return R.bases(classes, nd, region.select(path(F.col("r_regionkey")).alias("src"), path((F.col("r_regionkey") + 1) % 5).alias("dst")))


@query("""WITH m AS (SELECT page_id AS file_ord, url AS file_path, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS module FROM pages),
s AS (SELECT file_path, file_ord, array_to_string(string_split(module, '.')[i:], '.') AS name FROM m, unnest(range(1, len(string_split(module, '.')) + 1)) AS r(i)),
f AS (SELECT name, arg_min(file_path, file_ord) AS file_path FROM s GROUP BY name),
i AS (SELECT page_id AS import_id, array_to_string(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')[2:], '.') AS name FROM pages)
SELECT import_id, i.name, file_path FROM i LEFT JOIN f ON f.name = i.name""")
def import_suffix_match(spark, d):
    own = read(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("module"))
    imports = own.select(F.col("page_id").alias("import_id"), F.array_join(F.slice(F.split("module", "[.]"), 2, 100), ".").alias("name"))
    return R.absolute_imports(imports, own.select("module", F.col("url").alias("file_path"), F.col("page_id").alias("file_ord")))


@query("""SELECT doc_id, round((CASE WHEN contains(lower(source), 'src1') OR contains(lower(lang), 'src1') THEN 3 WHEN contains(lower(text), 'src1') THEN 2 ELSE 0 END
+ CASE WHEN contains(lower(source), 'th') OR contains(lower(lang), 'th') THEN 3 WHEN contains(lower(text), 'th') THEN 2 ELSE 0 END
+ CASE WHEN contains(lower(source), 'en') OR contains(lower(lang), 'en') THEN 3 WHEN contains(lower(text), 'en') THEN 2 ELSE 0 END) / 9.0, 9) AS score FROM documents""")
def keyword_score(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.round(T.keyword_score(["src1", "th", "en"], F.col("source"), F.col("lang"), F.col("text"), F.lit("")), 9).alias("score"))


_TERMS = ["steel_1", "green", "small", "tin_22", "antique brass zz", "zzz qqq"]
_LITERAL_SQL = """round(CASE WHEN lower(name) = term THEN 100 WHEN ends_with(lower(name), '.' || term) OR contains(node_id, '.' || term) THEN 90 WHEN contains(lower(name), term) THEN 70 + call_centrality WHEN contains(lower(signature), term) THEN 35 + call_centrality ELSE 50 + call_centrality END
- CASE WHEN length(term) <= 4 AND lower(name) <> term AND contains(lower(signature), term) THEN 25 ELSE 0 END, 9)"""


def _grep_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{CENTRAL_SQL}, t AS (SELECT DISTINCT unnest([{listed}]) AS term),
lit AS (SELECT term, node_id, node_ord, {_LITERAL_SQL} AS score FROM central JOIN t ON contains(lower(grep_text), term)),
best AS (SELECT * FROM lit QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, node_ord) = 1),
fz AS (SELECT term, node_id, node_ord, round(CASE WHEN contains(lower(name || ' ' || signature), term) THEN 80 + call_centrality ELSE len(list_filter(tk, lambda x: contains(lower(name || ' ' || signature), x))) / len(tk) * 50 + call_centrality END, 9) AS score
  FROM central JOIN (SELECT term, list_filter(regexp_extract_all(term, '[a-zA-Z0-9_]+'), lambda x: length(x) >= 2) AS tk FROM t WHERE term NOT IN (SELECT term FROM best)) ON len(tk) > 0),
fuz AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, node_ord) AS rank FROM fz WHERE score > 0)"""


_GREP_SQL = _grep_sql(_TERMS)


def _grep(spark, d):
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return S.grep(ranked_nodes(spark, d), terms).withColumn("score", F.round("score", 9))


@query(f"WITH {_GREP_SQL} SELECT term, node_id, score FROM best")
def grep_literal(spark, d):
    return _grep(spark, d).filter("mode = 'literal'").select("term", "node_id", "score")


@query(f"WITH {_GREP_SQL} SELECT term, node_id, score, rank FROM fuz WHERE rank <= 3")
def grep_fuzzy(spark, d):
    return _grep(spark, d).filter("mode = 'fuzzy'").select("term", "node_id", "score", "rank")


@query(ORACLES["grep_literal"])
def grep_literal_indexed(spark, d):
    """By posting lists: only nodes that have the rarest letter triples of a term are compared with it."""
    own = ranked_nodes(spark, d)
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    found = S.grep(own, terms, postings=S.posted(own)).withColumn("score", F.round("score", 9))
    return found.filter("mode = 'literal'").select("term", "node_id", "score")


#: Vectors of terms: those with these numbers; a part's name has the vector with its number.
_TERM_VECTORS = {"antique brass zz": 3, "zzz qqq": 5, "tin_22 rim": 8}
_BOOSTED_SQL = _grep_sql([*_TERMS, *_TERM_VECTORS]).split("fuz AS (")[0]


@query(f"""WITH {_BOOSTED_SQL} tv AS (SELECT v.term, e.embedding::DOUBLE[] AS q FROM (VALUES {", ".join(f"('{t}', {k})" for t, k in _TERM_VECTORS.items())}) AS v(term, k) JOIN embeddings e ON e.vec_id = v.k),
alike AS (SELECT t.term, n.node_id, n.node_ord, 60 * list_dot_product(e.embedding::DOUBLE[], q) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)) + 1e-9) AS score
  FROM central n JOIN embeddings e ON e.vec_id = n.node_ord JOIN tv ON true JOIN (SELECT term FROM t WHERE term NOT IN (SELECT term FROM best)) t ON t.term = tv.term),
m AS (SELECT term, node_id, node_ord, max(score) AS score FROM (SELECT term, node_id, node_ord, score FROM fz UNION ALL SELECT term, node_id, node_ord, score FROM alike) GROUP BY ALL HAVING max(score) > 0)
SELECT term, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY term ORDER BY round(score, 9) DESC, node_ord) AS rank FROM m QUALIFY rank <= 3""")
def grep_fuzzy_vectors(spark, d):
    """Fuzzy hits by letters or by the likeness of names to the term; names meet terms through an index of their vectors."""
    own = ranked_nodes(spark, d)
    vectors = _vectors(spark, d)
    names = S.named(own, own.select("name", F.col("node_ord").alias("id")).join(vectors, "id").select("name", "vector"), vectors.join(F.broadcast(spark.createDataFrame(list(_TERM_VECTORS.items()), "term string, id long")), "id").select("term", "vector"))
    found = S.grep(own, spark.createDataFrame([(t,) for t in [*_TERMS, *_TERM_VECTORS]], "term string").distinct(), names=names)
    return found.filter("mode = 'fuzzy'").select("term", "node_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {NODES_SQL}, x AS (SELECT node_id, [p for p in string_split(replace(regexp_replace(node_id, '_[0-9]+$', ''), '::', '.'), '.') if p <> ''] AS p, regexp_replace(node_id, '_[0-9]+$', '') AS term FROM nodes)
SELECT node_id, term AS text, 1.0::DOUBLE AS weight FROM x UNION ALL SELECT node_id, p[-1], 0.85 FROM x UNION ALL SELECT node_id, p[-2] || ' ' || p[-1], 0.8 FROM x UNION ALL SELECT node_id, p[-2], 0.35 FROM x""")
def symbol_expansion(spark, d):
    term = F.regexp_replace("node_id", "_[0-9]+$", "")
    return nodes(spark, d).select("node_id", F.explode(T.expansions(term)).alias("e")).select("node_id", "e.text", "e.weight")


@query(f"""WITH {NODES_SQL}, hit AS (SELECT DISTINCT file_path FROM nodes JOIN part ON p_partkey = node_ord WHERE p_size = 7 AND p_retailprice > 1500)
SELECT node_id, CASE WHEN file_path IN (SELECT file_path FROM hit) THEN 15.0 ELSE 0.0 END AS boost FROM nodes""")
def affinity_boost(spark, d):
    own = nodes(spark, d)
    part = read(spark, d, "part").filter("p_size = 7 and p_retailprice > 1500").select(F.col("p_partkey").alias("node_ord"))
    hit = own.join(part, "node_ord", "left_semi").select("file_path").distinct().withColumn("hit", F.lit(True))
    return own.join(hit, "file_path", "left").select("node_id", F.when(F.col("hit"), 15.0).otherwise(0.0).alias("boost"))


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark, d):
    """Every hundredth vector asks for all."""
    return _vectors(spark, d).filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))


_SIM_SQL = "s AS (SELECT q.vec_id AS qid, x.vec_id AS id, list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings x, embeddings q WHERE q.vec_id % 100 = 0)"


@query(f"WITH {_SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) AS rank FROM s WHERE sim > 0) SELECT qid, id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 50")
def cosine_topk(spark, d):
    return S.top_similar(_vectors(spark, d), _asked(spark, d)).withColumn("sim", F.round("sim", 6))


@query(ORACLES["cosine_topk"])
def cosine_topk_indexed(spark, d):
    """The same by cells of vectors: those whose bound says that they can't be among the 50 are not compared."""
    return I.top_similar(I.build(_vectors(spark, d)), _asked(spark, d)).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_SIM_SQL} SELECT id, round(max(sim), 6) AS sim FROM s GROUP BY id HAVING max(sim) > 0")
def max_sim_multi_query(spark, d):
    return S.best_similarity(_vectors(spark, d), _asked(spark, d)).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_SIM_SQL}, a AS (SELECT qid, id, sim FROM s WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, id) <= 50),
k AS (SELECT a.*, 0.7 * sim + 0.3 * (CASE WHEN contains(lower(source), 'src1') OR contains(lower(lang), 'src1') THEN 3 WHEN contains(lower(text), 'src1') THEN 2 ELSE 0 END / 3.0) AS score FROM a JOIN documents ON doc_id = id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM k) SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 20""")
def hybrid_retrieval(spark, d):
    """50 by similarity, of them 20 by the blend with keywords; a model's scores would order the last step."""
    # Keywords are counted where the texts are read, so no text meets an exchange.
    words = read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.keyword_score(["src1"], F.col("source"), F.col("lang"), F.col("text"), F.lit("")).alias("words"))
    scored = S.top_similar(_vectors(spark, d), _asked(spark, d)).drop("rank").join(words, "id").select("qid", "id", (0.7 * F.col("sim") + 0.3 * F.col("words")).alias("score"))
    return G.ranked(scored, ["qid"], F.desc(F.round("score", 9)), F.col("id"), n=20).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT doc_id, 'Type: CLASS' || chr(10) || 'Name: ' || source || chr(10) || 'Class: ' || lang || chr(10) || 'Inherits: ' || lang || ', ' || source || CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN chr(10) || 'Doc: ' || substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 600) ELSE '' END AS embedding_text FROM documents""")
def embedding_text(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", T.embedding_text(F.lit("CLASS"), F.col("source"), F.col("lang"), F.array("lang", "source"), F.col("text")).alias("embedding_text"))


@query(f"WITH {NODES_SQL} SELECT node_id, grep_text FROM nodes")
def grep_text(spark, d):
    return nodes(spark, d).select("node_id", "grep_text")


@query("""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(replace(array_to_string(list_filter(string_split(trim(coalesce(text, ''), chr(10) || chr(9) || ' '), chr(10)), lambda x: NOT starts_with(ltrim(x), '```')), ' '), '`', ''), '\\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_extract(t, '^(.+?[.!?])(\\s|$)', 1) <> '' THEN regexp_extract(t, '^(.+?[.!?])(\\s|$)', 1) ELSE t END AS sentence FROM f""")
def one_sentence(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.one_sentence(F.col("text")).alias("sentence"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: ltrim(x) <> '' AND NOT starts_with(ltrim(x), '#'))[1:2], chr(10)) AS head FROM documents""")
def first_nonempty_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", T.first_lines(F.col("text"), 2).alias("head"))


@query("""WITH m AS (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_linenumber || ':' || (l_linenumber + 1) || ':p' || l_partkey AS cite FROM lineitem)
SELECT cite, block, pos FROM m QUALIFY row_number() OVER (PARTITION BY cite ORDER BY block, pos) = 1""")
def cite_dedupe(spark, d):
    """A citation is printed where it occurs first: the least position of each, by partial aggregation."""
    from pyspark.sql import Window

    lines = read(spark, d, "lineitem")
    own = lines.select(F.col("l_orderkey").alias("block"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("pos"), T.cite(F.col("l_linenumber"), F.col("l_linenumber") + 1, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("cite"))
    return own.groupBy("cite").agg(F.min(F.struct("block", "pos")).alias("at")).select("cite", "at.block", "at.pos")


@query("""SELECT d.doc_id AS node_id, sha1(text) AS body_hash, CASE WHEN lang = 'en' THEN 'own' WHEN c.doc IS NOT NULL THEN c.doc ELSE '' END AS docstring, CASE WHEN lang = 'en' THEN 'native' WHEN c.doc IS NOT NULL THEN 'auto' ELSE 'none' END AS docstring_source
FROM documents d LEFT JOIN (SELECT sha1(text) AS h, max('q' || quality) AS doc FROM documents JOIN labels USING (doc_id) GROUP BY 1) c ON c.h = sha1(d.text)""")
def doc_cache_merge(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.sha1(F.col("text")).alias("body_hash"), F.when(F.col("lang") == "en", "own").alias("docstring"))
    cache = docs.join(read(spark, d, "labels").withColumnRenamed("doc_id", "node_id"), "node_id").select("body_hash", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("doc"))
    return Y.with_cached_docs(docs, cache)


_SNAP = "old AS (SELECT user_id AS path, max(ts) AS mtime FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 7 <> 0 GROUP BY 1), cur AS (SELECT user_id AS path, max(ts) AS mtime FROM events WHERE (ts >= TIMESTAMP '2024-01-15' OR user_id % 2 = 0) AND user_id % 11 <> 0 GROUP BY 1)"


def _snapshots(spark, d):
    own = read(spark, d, "events").select(F.col("user_id").alias("path"), "ts", "value")
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    return own.filter((F.col("ts") < split) & (F.col("path") % 7 != 0)), own.filter(((F.col("ts") >= split) | (F.col("path") % 2 == 0)) & (F.col("path") % 11 != 0))


@query(f"WITH {_SNAP} SELECT coalesce(old.path, cur.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'deleted' ELSE 'dirty' END AS change FROM old FULL JOIN cur ON old.path = cur.path WHERE old.path IS NULL OR cur.path IS NULL OR cur.mtime > old.mtime")
def file_changes(spark, d):
    old, now = (s.groupBy("path").agg(F.max("ts").alias("mtime")) for s in _snapshots(spark, d))
    return Y.changes(old, now)


@query("""WITH old AS (SELECT user_id AS path, max(ts) AS mtime, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 7 <> 0 GROUP BY 1), cur AS (SELECT user_id AS path, max(ts) AS mtime, max(CASE WHEN value > 5 THEN value END) AS value FROM events WHERE (ts >= TIMESTAMP '2024-01-15' OR user_id % 2 = 0) AND user_id % 11 <> 0 GROUP BY 1)
SELECT coalesce(old.path, cur.path) AS path, coalesce(cur.mtime, old.mtime) AS mtime, coalesce(cur.value, old.value) AS value FROM old FULL JOIN cur ON old.path = cur.path""")
def snapshot_upsert(spark, d):
    a, b = _snapshots(spark, d)
    old = a.groupBy("path").agg(F.max("ts").alias("mtime"), F.max("value").alias("value"))
    new = b.groupBy("path").agg(F.max("ts").alias("mtime"), F.max(F.when(F.col("value") > 5, F.col("value"))).alias("value"))
    return Y.upsert(old, new, "path", ["mtime", "value"])
