"""Literal, fuzzy and symbol-aware search over nodes, and similarity search over vectors. Ties always break on node order.

Terms are what somebody asked: they meet all nodes in blocks of at most ``blocks.ASKED``, each of which is broadcast. Queries
are vectors, of which there may be as many as rows: they meet all others in the cells of a grid (``vector_grid``).
Only the best rows of each task go to the exchange that ranks them (Spark limits groups before a ranking window).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vector as V
from graphloom.operators import vector_grid as grid
from graphloom.operators.blocks import in_blocks
from graphloom.operators.graph import ranked
from graphloom.operators.vector_index import VectorIndex, build
from graphloom.operators.vector_index import top_similar as nearest_vectors
from graphloom.sources.store import stored


def grep(nodes: DataFrame, terms: DataFrame, fuzzy_n: int = 3, cased: bool = False, postings: Postings | None = None, names: Names | None = None) -> DataFrame:
    """For terms(term): the best literal hit, or up to fuzzy_n fuzzy hits where there is none; (term, node_id, score, mode, rank).
    nodes: node_id, name, signature, grep_text, call_centrality, near, node_ord.

    With postings of the nodes, terms of three letters and more meet only nodes that have their rarest letter triples. With
    names, a fuzzy score is ``NAME_BOOST`` times the similarity of the term's vector and the name's, if that is more.
    """
    columns = ["term", "node_id", "node_ord", "score", "mode", "rank"]

    def block(t: DataFrame) -> DataFrame:
        if postings is None:
            met = nodes.join(t, F.contains(T.folded(F.col("grep_text"), cased), F.col("t")))
        else:
            short = nodes.join(F.broadcast(t.filter(F.length("t") < GRAM)), F.contains(T.folded(F.col("grep_text"), cased), F.col("t")))
            met = nodes.join(candidates(postings, t), "node_id").filter(F.contains(T.folded(F.col("grep_text"), cased), F.col("t"))).select(*short.columns).unionByName(short)
        literal = met.withColumn("score", T.literal_rank(F.col("t"), F.col("node_id"), F.col("name"), F.col("signature"), F.col("call_centrality"), F.col("near"), cased))
        # The best hits are read twice: as they are, and for the terms that have none.
        best = stored(ranked(literal, ["term"], F.desc("score"), F.col("node_ord"), n=1).withColumn("mode", F.lit("literal")).select(*columns), "literal")
        missing = F.broadcast(t.join(best.select("term"), "term", "left_anti"))
        rank = T.fuzzy_rank(F.col("t"), F.col("name"), F.col("signature"), F.col("call_centrality"), cased)
        some = ranked(nodes.join(missing, F.length("t") > 0).withColumn("score", rank).filter("score > 0"), ["term"], F.desc("score"), F.col("node_ord"), n=fuzzy_n)
        if names is not None:
            # The best by either score hold the best by the larger one.
            alike = names.nearest(missing, fuzzy_n)
            both = stored(some.select("term", "t", "node_id").unionByName(alike.select("term", "t", "node_id")).distinct(), "alike")
            scored = names.similar(nodes.join(F.broadcast(both), "node_id"), missing).withColumn("score", F.greatest(rank, NAME_BOOST * F.col("sim"))).filter("score > 0")
            some = ranked(scored, ["term"], F.desc("score"), F.col("node_ord"), n=fuzzy_n)
        return best.unionByName(some.withColumn("mode", F.lit("fuzzy")).select(*columns))

    stripped = T.strip(F.col("term"))
    return in_blocks(terms.select((stripped if cased else F.lower(stripped)).alias("t"), "term").filter("t != ''").distinct(), "term", block)


#: Letters of the pieces under which texts are posted, and how many of a term's pieces are looked up.
GRAM, RAREST = 3, 4


class Postings(NamedTuple):
    rows: DataFrame  # gram, node_id, in order
    grams: DataFrame  # gram, n: how many nodes have it


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def posted(nodes: DataFrame) -> Postings:
    """Postings of nodes(node_id, grep_text): which nodes have which three letters in a row, whatever their case."""
    each = nodes.select("node_id", F.explode(_grams(T.folded(F.col("grep_text")))).alias("gram"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(each.repartitionByRange(parts, "gram", "node_id").sortWithinPartitions("gram", "node_id").select("gram", "node_id"), "postings")
    return Postings(rows, stored(rows.groupBy("gram").agg(F.count("*").alias("n")), "grams"))


def candidates(postings: Postings, terms: DataFrame) -> DataFrame:
    """(term, t, node_id): nodes that have the rarest pieces of terms(term, t); all hits of terms with pieces are among them."""
    own = terms.select("term", "t", F.explode(_grams(F.lower("t"))).alias("gram"))
    known = postings.grams.join(F.broadcast(own), "gram")
    # A piece that no node has is in no posting, so a term with one never has as many as it picks.
    rarest = ranked(F.broadcast(own).join(known.select("term", "gram", "n"), ["term", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0))), ["term"], F.col("n"), F.col("gram"), n=RAREST)
    picked = stored(rarest.withColumn("many", F.max("rank").over(Window.partitionBy("term"))).select("term", "t", "gram", "many"), "picked")
    met = postings.rows.join(F.broadcast(picked), "gram").groupBy("term", "t", "node_id").agg(F.count("*").alias("n"), F.max("many").alias("many"))
    return met.filter("n = many").select("term", "t", "node_id")


#: What the similarity of a name to a term counts as a fuzzy score.
NAME_BOOST = 60.0


class Names(NamedTuple):
    """Vectors of names, each kept once, whatever the number of its nodes; terms(term, vector): of what is asked."""

    vectors: DataFrame  # name, vector, ord: the least node_ord of its nodes
    nodes: DataFrame  # name, node_id, node_ord
    index: VectorIndex  # of the vectors, by ord
    terms: DataFrame

    def nearest(self, terms: DataFrame, n: int) -> DataFrame:
        """(term, t, node_id): the n nodes of the names closest to each of terms(term, t), and further nodes of these names."""
        asked = self.terms.join(F.broadcast(terms), "term").select(F.col("term").alias("qid"), F.col("vector").alias("query"))
        found = nearest_vectors(self.index, asked, n)
        named = found.join(self.vectors.select(F.col("ord").alias("id"), "name"), "id").select(F.col("qid").alias("term"), "name")
        first = ranked(self.nodes.join(F.broadcast(named.select("name").distinct()), "name", "left_semi"), ["name"], F.col("node_ord"), n=n).select("name", "node_id")
        return named.join(first, "name").join(F.broadcast(terms.select("term", "t")), "term").select("term", "t", "node_id")

    def similar(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """pairs(term, name, ...) with sim, the cosine of their vectors; null where one has none."""
        asked = self.terms.join(F.broadcast(terms.select("term")), "term", "left_semi").select("term", V.as_double(F.col("vector")).alias("__t"))
        own = pairs.join(self.vectors.select("name", V.as_double(F.col("vector")).alias("__v")), "name", "left").join(F.broadcast(asked), "term", "left")
        norms = F.sqrt(V.dot(F.col("__t"), F.col("__t"))) * F.sqrt(V.dot(F.col("__v"), F.col("__v"))) + 1e-9
        return own.withColumn("sim", F.when(F.size("__t") == F.size("__v"), V.dot(F.col("__t"), F.col("__v")) / norms)).drop("__t", "__v")


def named(nodes: DataFrame, name_vectors: DataFrame, term_vectors: DataFrame) -> Names:
    """Names of nodes(node_id, name, node_ord) from name_vectors(name, vector), a row a name, and term_vectors(term, vector)."""
    own = nodes.filter("coalesce(name, '') != ''").select("name", "node_id", "node_ord")
    vectors = stored(own.groupBy("name").agg(F.min("node_ord").alias("ord")).join(name_vectors.select("name", "vector"), "name"), "name-vectors")
    return Names(vectors, own, build(vectors.select(F.col("ord").alias("id"), "vector")), term_vectors)


def symbol_grep(nodes: DataFrame, terms: DataFrame, n: int = 3, **how) -> DataFrame:
    """grep of each term's expansions; a node keeps its best weighted score. how: as of ``grep``."""
    expanded = terms.select(F.col("term").alias("whole"), F.explode(T.expansions(F.col("term"))).alias("e")).groupBy("whole", F.col("e.text").alias("term")).agg(F.max("e.weight").alias("weight"))
    found = grep(nodes, expanded.select("term").distinct(), **how).join(F.broadcast(expanded), "term")
    fused = found.groupBy("whole", "node_id", "node_ord").agg(F.max(F.round("score", 4) * F.col("weight")).alias("fused"))
    return ranked(fused, ["whole"], F.desc("fused"), F.col("node_ord"), n=n).select(F.col("whole").alias("term"), "node_id", "fused", "rank")


def best_similarity(items: DataFrame, queries: DataFrame) -> DataFrame:
    """items(id, vector) with the highest cosine over the queries(qid, query); 0 and less is dropped."""
    own = items.filter(F.size("vector") > 0)
    return grid.most_similar(own, queries, [], own.count()).filter("sim > 0")


def top_similar(items: DataFrame, queries: DataFrame, n: int = 50) -> DataFrame:
    """The n items closest to each query: (qid, id, sim, rank)."""
    own = items.filter(F.size("vector") > 0)
    return ranked(grid.top(own, queries, n), ["qid"], F.desc(F.round("sim", 9)), F.col("id"), n=n).select("qid", "id", "sim", "rank")
