"""Registered queries of neighbours and chains that rank by what was asked, of symbols, and of graphs after changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import models
from graphloom.functions import text as T
from graphloom.jobs.queries import _TERMS, ORACLES, _asked, _grep_sql, _vectors, query
from graphloom.jobs.source_queries import program
from graphloom.jobs.tables import CENTRAL_SQL, NODES_SQL, graph, nodes, ranked_nodes, read
from graphloom.operators import answer as A
from graphloom.operators import delta as D
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.sources.store import stored

#: A part's vector is the one with its number, if there is one; every hundredth vector asks.
_SCORED = f"""{CENTRAL_SQL}, sim AS (SELECT x.vec_id AS node_ord, max(list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS sim FROM embeddings x, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY x.vec_id),
scored AS (SELECT node_id, round(CASE WHEN sim IS NULL THEN call_centrality ELSE sim + 0.1 * call_centrality END, 9) AS score FROM central LEFT JOIN sim USING (node_ord)),
sides AS (SELECT dst AS anchor, 'caller' AS side, src AS node_id FROM edges UNION ALL SELECT src, 'callee', dst FROM edges),
r AS (SELECT anchor, side, node_id, row_number() OVER (PARTITION BY anchor, side ORDER BY score DESC, node_id) AS rank FROM sides JOIN scored USING (node_id))"""


def _with_vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes with centrality and vector, and the calls among them; both are read several times."""
    n, e = graph(spark, d)
    calls = stored(e, "calls")
    own = G.call_centrality(n, calls).join(_vectors(spark, d).select(F.col("id").alias("node_ord"), "vector"), "node_ord", "left")
    return stored(own.select("node_id", "vector", "call_centrality", F.col("grep_text").alias("passage")), "nodes"), calls


def _asks(spark, d) -> DataFrame:
    return _asked(spark, d).select(F.lit("all").alias("ask"), F.col("qid").cast("string").alias("query"), F.col("query").alias("vector"))


def _anchors(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit("all").alias("ask"), F.col("node_id").alias("anchor"))


@query(f"WITH {_SCORED} SELECT anchor, side, node_id, rank FROM r WHERE rank <= 5")
def neighbours_ranked(spark, d):
    """Callers and callees of every node, by the queries and centrality."""
    n, e = _with_vectors(spark, d)
    return A.ranked_neighbours(n, e, _anchors(nodes(spark, d)), _asks(spark, d), most_nodes=True).select("anchor", "side", "node_id", "rank")


@query(f"""WITH {_SCORED}, c AS (SELECT anchor, -rank AS step, 'caller' AS role, node_id FROM r WHERE side = 'caller' AND rank <= 2 UNION ALL SELECT node_id, 0, 'anchor', node_id FROM nodes UNION ALL SELECT anchor, rank, 'callee', node_id FROM r WHERE side = 'callee' AND rank <= 2),
f AS (SELECT a.anchor, b.node_id FROM r a JOIN r b ON a.side = 'callee' AND a.rank = 1 AND b.side = 'callee' AND b.rank = 1 AND b.anchor = a.node_id)
SELECT * FROM c UNION ALL SELECT anchor, 3, 'downstream', node_id FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.anchor = f.anchor AND c.node_id = f.node_id)""")
def call_chain_ranked(spark, d):
    """Two callers, the anchor, two callees and the best callee's best callee, for every node."""
    n, e = _with_vectors(spark, d)
    return A.chains(n, e, _anchors(nodes(spark, d)), _asks(spark, d), most_nodes=True).select("anchor", "step", "role", "node_id")


#: Chains of all nodes as if they had been asked for: a number for each part size, ranked by key.
@query(f"""WITH {CENTRAL_SQL}, sides AS (SELECT dst AS anchor, 'caller' AS role, src AS node_id FROM edges UNION ALL SELECT src, 'callee', dst FROM edges),
best AS (SELECT anchor, role, node_id FROM sides JOIN central USING (node_id) QUALIFY row_number() OVER (PARTITION BY anchor, role ORDER BY call_centrality DESC, node_id) = 1),
asked AS (SELECT nodes.node_id AS anchor, 1 AS block, p_size AS no, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rank FROM nodes JOIN part ON p_partkey = node_ord),
f AS (SELECT block, no, rank, role, name, (node_ord // 10) || ':' || (node_ord // 10 + 2) || ':' || file_path AS cite FROM (SELECT block, no, rank, 'anchor' AS role, anchor AS node_id FROM asked UNION ALL SELECT block, no, rank, role, node_id FROM asked JOIN best USING (anchor)) JOIN nodes USING (node_id)),
c AS (SELECT *, CASE role WHEN 'anchor' THEN 1 WHEN 'caller' THEN 3 ELSE 4 END AS place FROM f),
new AS (SELECT block, no, rank, place, name || ': ' || cite AS line FROM c QUALIFY row_number() OVER (PARTITION BY cite ORDER BY block, no, rank, place, name) = 1),
g AS (SELECT block, no, rank, max(CASE role WHEN 'anchor' THEN name END) AS anchor, max(CASE role WHEN 'caller' THEN name END) AS caller, max(CASE role WHEN 'callee' THEN name END) AS callee FROM f GROUP BY ALL),
t AS (SELECT g.block, g.no, g.rank, concat_ws(' -> ', caller, anchor || ' (anchor)', callee) AS line FROM g LEFT JOIN (SELECT * FROM new WHERE place = 1) n ON n.block = g.block AND n.no = g.no AND n.rank = g.rank WHERE caller IS NOT NULL OR callee IS NOT NULL OR n.line IS NOT NULL)
SELECT block, no, rank, place, line FROM new UNION ALL SELECT block, no, rank, 2, line FROM t QUALIFY row_number() OVER (PARTITION BY line ORDER BY block, no, rank) = 1""")
def results_markdown(spark, d):
    """The lines of an answer, each cite and each flow where it occurs first."""
    from pyspark.sql import Window

    n, e = graph(spark, d)
    near = G.call_neighbours(e, n.select(F.col("node_id").alias("anchor"))).join(G.call_centrality(n, e).select("node_id", "call_centrality"), "node_id")
    best = G.ranked(near, ["anchor", "side"], F.desc("call_centrality"), F.col("node_id"), n=1).select("anchor", F.col("side").alias("role"), "node_id")
    sizes = read(spark, d, "part").select(F.col("p_partkey").alias("node_ord"), F.col("p_size").alias("no"))
    asked = n.join(sizes, "node_ord").select(F.col("node_id").alias("anchor"), F.lit(1).alias("block"), "no", F.row_number().over(Window.partitionBy("no").orderBy("node_ord")).alias("rank"))
    chain = asked.join(best, "anchor").select("block", "no", "rank", "role", "node_id").unionByName(asked.select("block", "no", "rank", F.lit("anchor").alias("role"), F.col("anchor").alias("node_id")))
    line = F.floor(F.col("node_ord") / 10)
    return A.told(chain.join(n.select("node_id", "name", T.cite(line, line + 2, F.col("file_path")).alias("cite")), "node_id"))


@query(f"""WITH {_grep_sql(_TERMS)}, hits AS (SELECT term, node_id, score, 'literal' AS mode, 1 AS rank FROM best UNION ALL SELECT term, node_id, score, 'fuzzy', rank FROM fuz WHERE rank <= 3)
SELECT hits.term, hits.node_id, round(hits.score, 4) AS score, mode, rank, type, file_path, name, signature, CAST(node_ord // 10 AS BIGINT) AS start_line, CAST(node_ord // 10 + 2 AS BIGINT) AS end_line FROM hits JOIN nodes USING (node_id)""")
def search_hits(spark, d):
    """Results of a search as they are shown."""
    own = ranked_nodes(spark, d)
    hits = S.grep(own, spark.createDataFrame([(t,) for t in _TERMS], "term string")).drop("node_ord")
    line = F.floor(F.col("node_ord") / 10)
    return A.described(hits, own.withColumn("start_line", line).withColumn("end_line", line + 2))


@query(f"WITH {NODES_SQL} SELECT DISTINCT file_path FROM nodes JOIN part ON p_partkey = node_ord WHERE p_size > 5")
def tracked_files(spark, d):
    part = read(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node_ord"))
    return G.tracked_files(nodes(spark, d).join(part, "node_ord", "left_semi"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN len(string_split(text, chr(10))) ELSE 0 END AS lines FROM documents")
def line_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("lines"))


#: What a query asks for in words: the first eight words of the document with the vector's number.
_ASKED_WORDS = "array_to_string(list_filter(string_split(text, ' '), lambda x: x <> '')[1:8], ' ')"


@query(f"""WITH s AS (SELECT q.vec_id AS no, x.vec_id AS node_id, list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings x JOIN documents ON doc_id = x.vec_id, embeddings q WHERE q.vec_id % 100 = 0),
a AS (SELECT no, node_id, sim FROM s WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY no ORDER BY round(sim, 9) DESC, node_id) <= 50),
k AS (SELECT no, node_id, text, round(0.7 * sim + 0.3 * (CASE WHEN contains(lower(source), 'src1') OR contains(lower(lang), 'src1') THEN 3 WHEN contains(lower(text), 'src1') THEN 2 ELSE 0 END / 3.0), 9) AS score FROM a JOIN documents ON doc_id = node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, node_id) AS was FROM k QUALIFY was <= 20),
w AS (SELECT r.no, node_id, score, was, list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9_]+')) AS asked, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS has FROM r JOIN (SELECT doc_id, {_ASKED_WORDS} AS query FROM documents) q ON q.doc_id = r.no)
SELECT no, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY no ORDER BY CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, has)) / len(asked) ELSE 0 END DESC, was) AS rank FROM w QUALIFY rank <= 2""")
def hybrid_reranked(spark, d):
    """50 by similarity, 20 of them by the blend with keywords, 2 of these by a scorer that reads query and passage."""
    docs = read(spark, d, "documents").withColumnRenamed("doc_id", "node_id")
    own = docs.join(_vectors(spark, d).withColumnRenamed("id", "node_id"), "node_id").select("node_id", "vector", F.col("source").alias("name"), F.col("lang").alias("signature"), F.col("text").alias("passage"), F.lit("").alias("grep_text"))
    words = F.array_join(F.slice(F.filter(F.split("text", " "), lambda x: x != ""), 1, 8), " ")
    queries = _asked(spark, d).select(F.col("qid").alias("no"), F.col("query").alias("vector")).join(docs.select(F.col("node_id").alias("no"), words.alias("query")), "no")
    return A.semantic(own, queries, A.lexical, ["src1"]).withColumn("score", F.round("score", 6))


_SYMBOLS = ["steel_1", "brand_2.green", "brand_7::small_ring", "zzz.qqq"]
_EXPANDED = [("steel_1", "steel_1", 1.0)] + [(w, t, x) for w, o, m in (("brand_2.green", "brand_2", "green"), ("brand_7::small_ring", "brand_7", "small_ring"), ("zzz.qqq", "zzz", "qqq")) for t, x in ((w, 1.0), (m, 0.85), (f"{o} {m}", 0.8), (o, 0.35))]


@query(f"""WITH x AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{t}', {x}::DOUBLE)" for w, t, x in _EXPANDED)}) AS v(whole, term, weight)), {_grep_sql([t for _, t, _ in _EXPANDED])},
g AS (SELECT term, node_id, node_ord, score FROM best UNION ALL SELECT term, node_id, node_ord, score FROM fuz WHERE rank <= 3),
m AS (SELECT whole AS term, node_id, node_ord, max(round(score, 4) * weight) AS fused FROM g JOIN x USING (term) GROUP BY ALL)
SELECT term, node_id, round(fused, 6) AS fused, row_number() OVER (PARTITION BY term ORDER BY fused DESC, node_ord) AS rank FROM m QUALIFY rank <= 3""")
def grep_symbol_aware(spark, d):
    terms = spark.createDataFrame([(t,) for t in _SYMBOLS], "term string")
    return S.symbol_grep(ranked_nodes(spark, d), terms).withColumn("fused", F.round("fused", 6))


@query(f"""WITH {NODES_SQL}, w AS (SELECT node_id, unnest(regexp_extract_all(lower(grep_text), '[a-z0-9_]+')) AS w FROM nodes),
t AS (SELECT node_id, w AS token FROM w UNION ALL SELECT node_id, p FROM (SELECT node_id, unnest(string_split(w, '_')) AS p FROM w WHERE contains(w, '_')) WHERE p <> ''),
h AS (SELECT node_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS place, CASE WHEN substr(md5(token), 9, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 1 ELSE -1 END AS sign FROM t),
s AS (SELECT node_id, place, CAST(sum(sign) AS DOUBLE) AS x FROM h GROUP BY ALL)
SELECT node_id, CAST(place AS INT) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY node_id)), 5) AS weight FROM s WHERE x <> 0""")
def embedded_nodes(spark, d):
    """Vectors of all nodes by the default model, which each worker loads once; places with a weight as rows."""
    vectors = nodes(spark, d).select("node_id", models.embedder()(F.col("grep_text")).alias("v"))
    return vectors.select("node_id", F.posexplode("v").alias("place", "w")).filter("w != 0").select("node_id", "place", F.round(F.col("w").cast("double"), 5).alias("weight"))


@query(ORACLES["graph_edges"])
def incremental_edges(spark, d):
    """The program's edges after a sync from an older state: some files were not there, some were other, one is gone."""
    now = program(spark, d).withColumn("mtime", F.lit(2.0))
    kind = F.crc32("rel_path") % 4
    was = now.filter(kind > 0).withColumn("source", F.when(kind == 1, F.lit("def make(n):\n    return gone(n)\n")).otherwise(F.col("source"))).withColumn("mtime", F.when(kind == 1, 1.0).otherwise(2.0))
    gone = spark.createDataFrame([("gone.py", "def gone(n):\n    return n\n", 1.0)], "rel_path string, source string, mtime double")
    was = was.unionByName(gone)
    return D.synced(now, was.select(F.col("rel_path").alias("path"), "mtime"), D.built(was)).edges
