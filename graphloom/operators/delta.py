"""A code graph after changes, without joining what they don't reach.

A graph keeps a reverse index beside its tables: under which names files are looked up by which files. A change of files
becomes a change of names: names whose registered definer is another than before, module names and paths that came or
went. The index turns these into the files that have to be resolved again; only their facts are read, and they meet
only the nodes of those files and of the names they use. All other nodes and edges stay as they are.

Tables: uses (kind, name, file_path), where kind is symbol (called, or a base class), module (imported by its dotted
name) or stem (imported relative to the file). The others are those of ``compile``.

Defined results. The graph after a change equals that of all files built anew. A file that was tracked, but of which
nothing is known, counts as new. Files that did not change are not parsed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import compile as C
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.operators.sync import changes
from graphloom.sources import python_source as P
from graphloom.sources.store import stored
from graphloom.sources.workspace import dealt

RESOLVED = ("CALLS", "INHERITS_FROM", "IMPORTS")


class Graph(NamedTuple):
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    uses: DataFrame


def uses(facts: DataFrame) -> DataFrame:
    """(kind, name, file_path): what each file looks up by name."""
    kind = lambda df, k, name, path: df.select(F.lit(k).alias("kind"), F.col(name).alias("name"), F.col(path).alias("file_path"))
    parts = [
        kind(P.calls(facts), "symbol", "symbol", "file_path"),
        kind(P.class_bases(facts), "symbol", "base", "file_path"),
        kind(P.imported_names(facts), "module", "name", "import_id"),
        kind(P.wanted_stems(facts), "stem", "stem", "src"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def built(files: DataFrame) -> Graph:
    """The graph of files (rel_path, source), with its index."""
    facts = C.parsed_once(files)
    nodes, edges = C.graph_of(facts)
    return Graph(facts, stored(nodes, "nodes"), stored(edges, "edges"), stored(uses(facts), "uses"))


def kept(graph: Graph) -> Graph:
    """The graph as tables of its own, so that the next change does not read through all changes before it."""
    return Graph(*(stored(df, name) for df, name in zip(graph, Graph._fields, strict=True)))


def file_of(node_id: Column) -> Column:
    """The file of a node; names hold no colons."""
    return F.regexp_replace(node_id, "::[^:]*$", "")


def _same(df: DataFrame, keys: DataFrame, on: str, key: str = "path") -> DataFrame:
    return df.join(keys.select(F.col(key).alias(on)), on, "left_semi").select(*df.columns)


def _other(df: DataFrame, keys: DataFrame, on: str, key: str = "path") -> DataFrame:
    return df.join(keys.select(F.col(key).alias(on)), on, "left_anti").select(*df.columns)


def changed_files(files: DataFrame, tracked: DataFrame, graph: Graph) -> DataFrame:
    """(path, change) of files(rel_path, source, mtime) since tracked(path, mtime): new, dirty or deleted."""
    change = changes(tracked, files.select(F.col("rel_path").alias("path"), "mtime"))
    known = graph.facts.filter("kind in ('FILE', 'ERROR')").select(F.col("rel_path").alias("path"))
    unknown = files.filter("rel_path is not null").select(F.col("rel_path").alias("path")).join(known, "path", "left_anti").select("path", F.lit("new").alias("change"))
    return change.filter("path is not null").unionByName(unknown).groupBy("path").agg(F.max("change").alias("change"))


def _registry_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names (name) of nodes of which the registered definer, as a class or at all, is another than before."""

    def registered(nodes: DataFrame) -> DataFrame:
        classes = nodes.filter("type = 'CLASS'").groupBy("name").agg(F.max_by("file_path", "node_ord").alias("class_path"))
        return R.registry(nodes).join(classes, "name", "full")

    both = registered(before).join(registered(after).toDF("name", "now", "class_now"), "name", "full")
    return both.filter(~(F.col("file_path").eqNullSafe(F.col("now")) & F.col("class_path").eqNullSafe(F.col("class_now")))).select("name")


def affected_files(graph: Graph, change: DataFrame, names: DataFrame, moved: DataFrame) -> DataFrame:
    """(path) of unchanged files that have to be resolved again; names (name): symbols of other definers; moved (path): files that came or went."""
    placed = moved.select(F.lit("FILE").alias("kind"), F.col("path").alias("rel_path"))
    modules = P.suffixes(P.modules(placed)).select(F.lit("module").alias("kind"), "name")
    stems = P.stems(placed).select(F.lit("stem").alias("kind"), F.col("stem").alias("name"))
    asked = names.select(F.lit("symbol").alias("kind"), "name").unionByName(modules).unionByName(stems).distinct()
    users = graph.uses.join(asked, ["kind", "name"], "left_semi").select(F.col("file_path").alias("path")).distinct()
    return _other(users, change, "path")


def _resolved(graph_facts: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that facts of some files give, among nodes of those files and of names that they use; graph_facts: of all files, for their paths."""
    places = graph_facts.filter("kind in ('FILE', 'ERROR')").select("kind", "rel_path")
    wanted = P.imported_names(facts)
    found = R.absolute_imports(wanted, P.modules(places), wanted.select("name").distinct()).filter("file_path is not null and file_path != import_id")
    relative = P.met_stems(P.wanted_stems(facts), places)
    imported = stored(found.select(F.col("import_id").alias("src"), F.col("file_path").alias("dst")).unionByName(relative).distinct(), "imports")
    kind = lambda df, name: df.select("src", "dst", F.lit(name).alias("relationship"))
    return kind(imported, "IMPORTS").unionByName(kind(R.bases(P.class_bases(facts), nodes, imported), "INHERITS_FROM")).unionByName(kind(C.call_edges(facts, nodes, imported), "CALLS"))


def _in_folders(paths: DataFrame, relationship: str) -> DataFrame:
    return paths.filter("contains(path, '/')").select(F.regexp_replace("path", "/[^/]*$", "").alias("src"), F.col("path").alias("dst"), F.lit(relationship).alias("relationship"))


def synced(files: DataFrame, tracked: DataFrame, graph: Graph) -> Graph:
    """The graph of files(rel_path, source, mtime), from that of an older state, tracked(path, mtime)."""
    change = stored(changed_files(files, tracked, graph), "change")
    here = change.filter("change != 'deleted'")
    sources = _same(files.withColumn("path", F.col("rel_path")), here, "path").groupBy("rel_path").agg(F.max("source").alias("source"))
    fresh = stored(P.parse(dealt(sources, "rel_path")), "facts")
    old_facts = _other(graph.facts, change, "rel_path")
    facts = old_facts.unionByName(fresh)

    own = graph.nodes.filter(F.col("file_path").isNotNull())
    gone, new = stored(_same(own, change, "file_path"), "gone"), stored(C.entity_nodes(fresh), "entities")
    stay = _other(own, change, "file_path")
    names = gone.select("name").unionByName(new.select("name")).distinct()
    moved = change.filter("change != 'dirty'").select("path")
    brief = ["type", "name", "is_method", "file_path", "node_ord"]
    namesakes = stored(_same(stay.select(*brief), names, "name", "name"), "namesakes")
    redefined = _registry_changes(gone.select(*brief).unionByName(namesakes), new.select(*brief).unionByName(namesakes))
    again = stored(affected_files(graph, change, redefined, moved).unionByName(here.select("path")), "again")

    # Facts of the files that are resolved again, and the nodes that they can meet.
    some = stored(fresh.unionByName(_same(old_facts, _other(again, change, "path"), "rel_path")), "some")
    symbols = uses(some).filter("kind = 'symbol'").select("name").distinct()
    reached = _same(stay, again, "file_path").unionByName(_same(_other(stay, again, "file_path"), symbols, "name", "name")).unionByName(new)
    resolved = _resolved(facts, some, stored(reached, "reached"))

    # Folders: only those on the way to files that came or went.
    paths = facts.filter("kind in ('FILE', 'ERROR')").select("kind", "rel_path")
    folders = moved.select(F.explode(G.folders(F.col("path"))).alias("path")).distinct()
    places = folders.unionByName(moved)
    alive = _same(paths.select(F.explode(G.folders(F.col("rel_path"))).alias("path")), folders, "path").distinct()
    arrived = _same(paths.select(F.col("rel_path").alias("path")), moved, "path").distinct()
    tree = _in_folders(alive, "SUBMODULE_OF").unionByName(_in_folders(arrived, "MEMBER_OF"))
    contains = new.select(F.col("file_path").alias("src"), F.col("node_id").alias("dst"), F.lit("CONTAINS").alias("relationship"))

    known = graph.edges.withColumn("__file", file_of(F.col("src")))
    kept = _other(known.filter(F.col("relationship").isin(*RESOLVED)), again.unionByName(change.select("path")).distinct(), "__file")
    kept_contains = _other(known.filter("relationship = 'CONTAINS'"), change, "__file")
    kept_tree = _other(known.filter("relationship in ('MEMBER_OF', 'SUBMODULE_OF')"), places, "dst")
    edges = reduce(DataFrame.unionByName, [x.select("src", "dst", "relationship") for x in (kept, kept_contains, kept_tree, resolved, tree, contains)])

    place_nodes = _same(C.place_nodes(paths), places, "node_id")
    other_places = _other(graph.nodes.filter(F.col("file_path").isNull()), places, "node_id")
    nodes = stay.unionByName(other_places).unionByName(new).unionByName(place_nodes, allowMissingColumns=True)
    new_uses = _other(graph.uses, change, "file_path").unionByName(uses(fresh))
    return Graph(facts, nodes, edges, new_uses)
