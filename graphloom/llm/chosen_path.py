"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Each of several independent trees sends every set down paths: a node
picks one minwise coordinate (or two, as its own hash says) and a set goes on to the child named by the value it
has there, so two sets stay together with a probability equal to their similarity at every step. Nodes with few
sets are compared exhaustively on 64 coordinates; larger nodes compare with their pivots and branch on. The
candidates are confirmed on the full sets, and links are closed to components by large-star and small-star rounds.

Equal sets are one set from the start, so groups of exact copies of any size cost one row in the join. No node is
ever gathered beyond ``leaf`` sets, and nothing is left out: what is still large at the last level is compared in
blocks of ``leaf`` and with pivots, and after that, on full sets, each of its components with all the others.

Defined results. Null or empty text: an empty set, linked with nothing, kept. Fewer words than a shingle has: the
whole sequence is one shingle. Repeated rows share a component and each is returned. Rows that share a doc_id are one
document with the links of all its texts, and their component is one. A null doc_id has a null component, is linked
with nothing and kept. Columns other than doc_id and text are not read. An empty table gives an empty result.

Shingles are 64-bit hashes, and sets with the same 128-bit digest of them are taken as equal.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import written

COORDINATES = 64
#: A second coordinate is taken in this share of nodes: 1 / 0.8 coordinates a node on average.
SECOND = 0.25
#: Candidates agree on this share of coordinates at least; a pair at 0.8 falls short once in about 30,000 times.
SIEVE = 0.6
#: More sets than a node that is compared ever holds.
PLACES = 1 << 15
#: Ids of documents that may be broadcast: 8 bytes each, some 100 MB as a hash table.
BROADCAST_IDS = 2_000_000
#: Bounds of a part of sets that is compared with another part as a whole, and the shingles compared at a time.
PART_SETS = 400
PART_SHINGLES = 50_000
WIDTH = 2048
LINK = "a long, b long, ca long, cb long"

#: Further coordinates of sets that are candidates, and the share of them that pairs in different components agree on at
#: least before full sets are compared: a pair at 0.8 falls short once in about 30,000 times.
FINE = 256
FINE_SIEVE = 0.7

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 62, COORDINATES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES + FINE, dtype=np.uint64)


def recall_of(trees: int, similarity: float, depth: int) -> float:
    """Probability that a pair at the given similarity is a candidate, if leaves lie at that depth.

    All trees branch on the same coordinates: the share of them that the pair agrees on varies, and it falls by the sieve or
    holds for each tree alike.
    """
    found = 0.0
    for same in range(COORDINATES + 1):
        if same < SIEVE * COORDINATES:
            continue
        share, lost = same / COORDINATES, 0.0
        for _ in range(depth):
            one = 1 - share + share * lost
            lost = (1 - SECOND) * one + SECOND * one * one
        found += math.comb(COORDINATES, same) * similarity**same * (1 - similarity) ** (COORDINATES - same) * (1 - lost**trees)
    return found


def trees_for(recall: float, similarity: float = 0.8, depth: int = 5) -> int:
    """Trees so that a pair at the given similarity meets in one of them with probability recall, if leaves lie at that depth."""
    most = recall_of(1 << 20, similarity, depth)
    if recall > most:
        raise ValueError(f"{COORDINATES} coordinates give a recall of {most:.6f} at most")
    return next(t for t in range(1, 1 << 20) if recall_of(t, similarity, depth) >= recall)


def document_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Yields the sorted distinct shingle hashes of each row."""
    data = tk.LOWER[data]
    starts, ends, rows = tk.words(data, offsets, tk.NOT_SPACE)
    h = tk.word_hashes(data, starts, ends)
    grams = tk.runs(h, width)
    for k in range(len(offsets) - 1):
        lo, hi = rows[k], rows[k + 1]
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            whole = width
            for x in h[lo:hi].tolist():
                whole = tk.mix_int(31 * whole + x)
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def minwise(s: np.ndarray, at: slice = slice(COORDINATES)) -> np.ndarray:
    """Coordinates of a set of shingles."""
    mul, add = _MUL[at], _ADD[at]
    out = np.full(len(mul), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(out, ((s[k : k + 2048, None] * mul + add) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def _sets(width: int, with_signature: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                n, ids, payload, fine = [], [], [], []
                for s in document_sets(data, offsets, width):
                    n.append(len(s))
                    ids.append(tk.mix(s).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(len(s))).tobytes())
                    payload.append(minwise(s).tobytes() if with_signature else s.view(np.int64))
                    if not with_signature:
                        fine.append(minwise(s, slice(COORDINATES, None)).astype(np.uint8).tobytes())
                doc = batch.column("doc_id").slice(lo, hi - lo)
                if with_signature:
                    yield pa.record_batch([doc, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(payload, pa.binary())], ["doc_id", "n_shingles", "set_id", "signature"])
                else:
                    yield pa.record_batch([doc, pa.array(ids, pa.binary()), tk.list_array(np.concatenate(payload), np.array(n), pa.int64()), pa.array(fine, pa.binary())], ["doc_id", "set_id", "shingles", "fine"])

    return run


def _branch(node: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of sets at their nodes: row numbers and the children's hashes."""
    first = (node % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((node >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    both = np.flatnonzero((node >> np.uint64(40)) % np.uint64(1000) < np.uint64(1000 * SECOND))
    row = np.concatenate([np.arange(len(node)), both])
    at = np.concatenate([first, second[both]])
    child = tk.mix(tk.mix(node[row] + np.uint64(at.astype(np.uint64) + np.uint64(1))) ^ (signatures[row, at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return row, child


def _rows_out(doc: np.ndarray, node: np.ndarray, signatures: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    sketch = signatures.astype(np.uint8)[row]
    return pa.record_batch([pa.array(node.view(np.int64)), pa.array(doc[row]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(row), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())], ["node", "doc_id", "sketch"])


def _grow(trees: int):
    """Children of (doc_id, nodes, signature) rows, whose nodes are a list; of each tree's root where there are no nodes yet (trees > 0)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)
                signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                if trees:
                    for t in range(trees):
                        row, child = _branch(np.full(len(doc), tk.mix_int(1000 + t), np.uint64), signatures)
                        yield _rows_out(doc, child, signatures, row)
                else:
                    nodes, offsets = tk.list_parts(part.column("nodes"))
                    of_doc = np.repeat(np.arange(len(doc)), np.diff(offsets))
                    for k in range(0, len(nodes), 8000):
                        own = of_doc[k : k + 8000]
                        row, child = _branch(nodes[k : k + 8000].astype(np.int64).view(np.uint64), signatures[own])
                        yield _rows_out(doc, child, signatures, own[row])

    return run


def _forest(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which of the pairs of numbers join two groups, if they are taken in turn."""
    group: dict[int, int] = {}
    out = np.zeros(len(first), bool)
    for k, (x, y) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
        while x in group:
            x = group[x]
        while y in group:
            y = group[y]
        if x != y:
            group[y] = x
            out[k] = True
    return out


def _similar(batches):
    """Nodes (docs, sketches) that have candidate pairs: the sets of such pairs, and all pairs, those of a spanning forest of the closest ones first."""
    for batch in batches:
        nodes, every, forest = [], [], []
        for docs, sketches in zip(batch.column("docs").to_pylist(), batch.column("sketches").to_pylist(), strict=True):
            docs = np.array(docs)
            order = np.argsort(docs, kind="stable")
            docs, m = docs[order], np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, COORDINATES)[order]
            same = (m[:, None, :] == m[None, :, :]).sum(axis=2)
            i, j = np.nonzero(np.triu(same >= SIEVE * COORDINATES, 1))
            if not len(i):
                continue
            used, ends = np.unique(np.stack([i, j]), return_inverse=True)
            x, y = ends.reshape(2, -1)
            closest = np.lexsort((y, x, -same[i, j]))
            x, y = x[closest], y[closest]
            tree = _forest(x, y)
            code = x * PLACES + y
            nodes.append(docs[used])
            every.append(np.concatenate([code[tree], code[~tree]]))
            forest.append(int(tree.sum()))
        yield _node_rows(nodes, every, np.array(forest))


def _node_rows(nodes: list[np.ndarray], pairs: list[np.ndarray], forest: np.ndarray) -> pa.RecordBatch:
    joined = [tk.list_array(np.concatenate([np.zeros(0, np.int64), *x]), np.array(list(map(len, x)), np.int64), kind) for x, kind in ((nodes, pa.int64()), (pairs, pa.int32()))]
    return pa.record_batch([*joined, pa.array(forest.astype(np.int32))], ["docs", "pairs", "forest"])


#: Sets of a node in order, candidate pairs of them (place of the one * PLACES + place of the other), and how many of these are its forest.
NODE = "docs array<long>, pairs array<int>, forest int"


def _compare(rows: DataFrame, *keys: str) -> DataFrame:
    """Candidates of nodes that are known to hold few sets."""
    nodes = rows.groupBy(*keys).agg(F.collect_list("doc_id").alias("docs"), F.collect_list("sketch").alias("sketches")).filter(F.size("docs") > 1)
    return nodes.select("docs", "sketches").mapInArrow(_similar, NODE)


def _with_pivots(rows: DataFrame, pivots: int = 4) -> DataFrame:
    """Candidates of large nodes: each set with a few pivots. One order of all sets for each pivot makes nodes of like sets share them."""
    order = [F.xxhash64("doc_id", F.lit(k)) for k in range(pivots)]
    chosen = rows.groupBy("node").agg(*[F.min(F.struct(o.alias("o"), "doc_id", "sketch")).alias(f"p{k}") for k, o in enumerate(order)])
    pivot = chosen.select("node", F.array(*[F.col(f"p{k}.doc_id") for k in range(pivots)]).alias("pivots"), F.array(*[F.col(f"p{k}.sketch") for k in range(pivots)]).alias("sketches"))
    return rows.join(pivot, "node").select("doc_id", "sketch", "pivots", "sketches").mapInArrow(_pivot_pairs, NODE)


def _pivot_pairs(batches):
    """Each set with its closest pivot."""
    for batch in batches:
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        n = len(doc)
        pivot = batch.column("pivots").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        x = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, 1, COORDINATES)
        y = np.frombuffer(b"".join(batch.column("sketches").flatten().to_pylist()), np.uint8).reshape(n, -1, COORDINATES)
        same = np.where(pivot == doc[:, None], 0, (x == y).sum(axis=2))
        best = same.argmax(axis=1)
        i = np.flatnonzero(same[np.arange(n), best] >= SIEVE * COORDINATES)
        j = best[i]
        ends = np.stack([np.minimum(doc[i], pivot[i, j]), np.maximum(doc[i], pivot[i, j])], axis=1)
        yield _node_rows(list(ends), list(np.ones((len(i), 1), np.int64)), np.ones(len(i)))


def _join_groups(percent: int):
    """Links (a, b, ca, cb: their components) between the two sides of a group of sets (left, doc_id, component_id, shingles): as few as join their components."""

    def run(group: pa.Table) -> pa.Table:
        doc, component, left = (group.column(c).to_numpy() for c in ("doc_id", "component_id", "left"))
        values, offsets = tk.list_parts(group.column("shingles").combine_chunks())
        size = np.diff(offsets)
        of_left = np.repeat(left, size)
        at = np.repeat(np.where(left, np.cumsum(left), np.cumsum(~left)) - 1, size)
        known, code = np.unique(values, return_inverse=True)
        both = np.zeros((2, len(known)), bool)
        both[of_left.astype(np.int64), code] = True
        common = both.all(axis=0)
        code = np.where(common, np.cumsum(common) - 1, -1)[code]
        shared = np.zeros((int(left.sum()), int((~left).sum())), np.float32)
        for lo in range(0, int(common.sum()), WIDTH):
            here = (code >= lo) & (code < lo + WIDTH)
            x, y = np.zeros((shared.shape[0], WIDTH), np.float32), np.zeros((shared.shape[1], WIDTH), np.float32)
            x[at[here & of_left], code[here & of_left] - lo] = 1
            y[at[here & ~of_left], code[here & ~of_left] - lo] = 1
            shared += x @ y.T
        total = size[left][:, None] + size[~left][None, :]
        i, j = np.nonzero((100 * shared.astype(np.int64) >= percent * (total - shared.astype(np.int64))) & (component[left][:, None] != component[~left][None, :]))
        ends, first = np.unique(np.stack([component[left][i], component[~left][j]]), axis=1, return_index=True)
        use = np.flatnonzero(_forest(*ends))
        first, (c, d) = first[use], ends[:, use]
        return pa.table({"a": pa.array(doc[left][i[first]]), "b": pa.array(doc[~left][j[first]]), "ca": pa.array(c), "cb": pa.array(d)}, pa.schema([(x, pa.int64()) for x in ("a", "b", "ca", "cb")]))

    return run


def _facing(members: DataFrame, mates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (doc_id, component_id) of pairs of components mates (key, mate) that may have a link to the pair's other component.

    Sets that are similar enough share one of the rarest shingles of each, and neither is smaller than percent of the other:
    a member that finds no such shingle of the other component, among sets of a fitting size, has no link there.
    """
    sides = mates.select("key", "mate", F.col("key").alias("component_id"), F.col("mate").alias("facing")).unionByName(mates.select("key", "mate", F.col("mate").alias("component_id"), F.col("key").alias("facing")))
    own = written(members.join(sides.select("component_id").distinct(), "component_id", "left_semi").join(sets, "doc_id").select("doc_id", "component_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles-of-many")
    ranked = own.join(own.groupBy("shingle").count(), "shingle").groupBy("doc_id", "component_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("order"))
    # n - ceil(n * percent / 100) + 1 of them, in whole numbers.
    prefix = F.expr(f"slice(order, 1, cast(n - (n * {percent} + 99) div 100 + 1 as int))")
    prefixes = written(ranked.select("doc_id", "component_id", "n", F.explode(prefix).alias("s")).select("doc_id", "component_id", "n", "s.shingle"), "prefixes")
    there = prefixes.groupBy(F.col("component_id").alias("facing"), "shingle").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # Few components have a shingle among their members' rarest: they meet by shingle before their pairs are looked up.
    met = prefixes.join(there, "shingle").filter(f"component_id != facing and 100 * n >= {percent} * least and 100 * most >= {percent} * n")
    return met.select("doc_id", "component_id", "facing").distinct().join(sides, ["component_id", "facing"]).select("key", "mate", "doc_id", "component_id")


def stragglers(nodes: DataFrame, sets: DataFrame, component: DataFrame, leaf: int, percent: int) -> DataFrame:
    """Confirmed links (a, b, ca, cb: their components) between the components of nodes that stayed large.
    nodes: node, doc_id; sets: doc_id, shingles; component: doc_id, component_id of all sets.

    A set whose component has few members in a node is compared on full sets with all of each component that has many
    there, and with the node's other stragglers. Two components that both have many members in a node are compared with
    each other, as far as ``_facing`` does not rule a member out. A component, or a pair of them, is met once, however many
    trees and nodes it fills. Both sides are dealt to parts of some PART_SETS sets and PART_SHINGLES shingles; each two
    parts are a group of their own, so no group grows with the data.
    """
    placed = written(nodes.select("node", "doc_id").join(component, "doc_id"), "placed")
    counts = written(placed.groupBy("node", "component_id").count(), "counts")
    rest = placed.join(counts.filter(F.col("count") <= leaf), ["node", "component_id"]).select("node", "doc_id", "component_id")
    many = counts.filter(F.col("count") > leaf).select("node", F.col("component_id").alias("key"))
    # key and mate: a node twice, a component twice, or two components, the lesser one first.
    within = rest.select(F.lit(True).alias("within"), F.col("node").alias("key"), F.col("node").alias("mate"), "doc_id", "component_id")
    against = rest.join(many, "node").select(F.lit(False).alias("within"), "key", F.col("key").alias("mate"), "doc_id", "component_id").distinct()
    of_many = placed.select("doc_id", "component_id").distinct().join(many.select(F.col("key").alias("component_id")).distinct(), "component_id")
    members = of_many.select(F.lit(False).alias("within"), F.col("component_id").alias("key"), F.col("component_id").alias("mate"), "doc_id", "component_id")
    rows = [side.withColumn("left", F.lit(left)) for side, left in ((within, True), (against, True), (within, False), (members, False))]
    mates = written(many.join(many.withColumnRenamed("key", "mate"), "node").filter("key < mate").select("key", "mate").distinct(), "mates")
    if not mates.isEmpty():
        rows.append(_facing(of_many, mates, sets, percent).select(F.lit(False).alias("within"), "key", "mate", "doc_id", "component_id", (F.col("component_id") == F.col("key")).alias("left")))
    sized = sets.select("doc_id", F.size("shingles").alias("n"))
    dealt = written(reduce(DataFrame.unionByName, rows).join(sized, "doc_id"), "dealt")
    of_group = ["within", "key", "mate"]
    parts = F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    parts = written(dealt.groupBy(*of_group, "left").agg(parts.alias("parts")), "parts")
    parts = parts.groupBy(*of_group).agg(F.max(F.when(F.col("left"), F.col("parts"))).alias("lefts"), F.max(F.when(~F.col("left"), F.col("parts"))).alias("rights")).filter("lefts is not null and rights is not null")
    mine, others = F.when(F.col("left"), F.col("lefts")).otherwise(F.col("rights")), F.when(F.col("left"), F.col("rights")).otherwise(F.col("lefts"))
    numbered = dealt.join(parts, of_group).withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    grouped = numbered.withColumn("x", F.when(F.col("left"), F.col("own")).otherwise(F.col("other"))).withColumn("y", F.when(F.col("left"), F.col("other")).otherwise(F.col("own")))
    full = grouped.select(*of_group, "x", "y", "left", "doc_id", "component_id").join(sets, "doc_id")
    return full.groupBy(*of_group, "x", "y").applyInArrow(_join_groups(percent), LINK)


def candidates(signatures: DataFrame, trees: int, leaf: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct nodes with candidate pairs of sets (doc_id, signature), as NODE says, and the rows of nodes that are large at the last level, if any."""
    rows_schema = "node long, doc_id long, sketch binary"
    rows, found = signatures.select("doc_id", "signature").mapInArrow(_grow(trees), rows_schema), None
    # Each level's nodes are written by themselves: one plan of all levels is more than a driver should hold.
    for level in range(1, depth + 1):
        sizes = rows.groupBy("node").count().filter("count > 1")
        large = written(sizes.filter(F.col("count") > leaf), "large")
        more = not large.isEmpty()
        # One plan at every size: the sizes of nodes grow with the data, and are never broadcast.
        known = rows.join(sizes.filter(F.col("count") <= leaf).hint("merge"), "node")
        pairs = [_compare(known, "node")]
        if more:
            big = written(rows.join(large.select("node"), "node"), "nodes")
            if level % 2 == depth % 2:
                pairs.append(_with_pivots(big))
            if level == depth:
                blocks = F.ceil(F.col("count") / leaf).cast("long")
                pairs.append(_compare(big.join(large, "node").withColumn("block", F.pmod(F.xxhash64("doc_id", "node"), blocks)), "node", "block"))
        met = written(reduce(DataFrame.unionByName, pairs), "met")
        found = met if found is None else found.unionByName(met)
        if not more:
            break
        if level < depth:
            # A set meets its signature once, with all its nodes: a number of them that trees and levels bound.
            of_set = big.groupBy("doc_id").agg(F.collect_list("node").alias("nodes"))
            rows = written(of_set.join(signatures.select("doc_id", "signature"), "doc_id").mapInArrow(_grow(0), rows_schema), "children")
    # Few sets meet in many trees: such nodes are one.
    return found.distinct(), big if more else None


#: A set with its component, and the sets (with theirs) that it is to be compared with.
PARTNERS = "a long, ca long, partners array<struct<b: long, cb: long>>"


def _open(percent: int):
    def run(batches):
        for batch in batches:
            rows, pairs_of = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
            sizes = [np.zeros(0, np.int64)]
            parts = [tk.list_parts(batch.column(c)) for c in ("docs", "c", "n", "pairs")]
            sketches = batch.column("fine").to_pylist()
            for k, skip in enumerate(batch.column("forest").to_pylist()):
                docs, c, n, pairs = (values[at[k] : at[k + 1]] for values, at in parts)
                i, j = np.divmod(pairs[skip:], PLACES)
                may = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[may], j[may]
                if len(i):
                    fine = np.frombuffer(b"".join(sketches[k]), np.uint8).reshape(-1, FINE)
                    near = np.flatnonzero((fine[i] == fine[j]).sum(axis=1) >= FINE_SIEVE * FINE)
                    i, j = i[near], j[near]
                order = np.lexsort((j, i))
                own, size = np.unique(i, return_counts=True)
                rows.append(np.stack([docs[own], c[own]]))
                sizes.append(size)
                pairs_of.append(np.stack([docs[j[order]], c[j[order]]]))
            (a, ca), (b, cb) = np.concatenate(rows, axis=1), np.concatenate(pairs_of, axis=1)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            partners = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(b), pa.array(cb)], ["b", "cb"]))
            yield pa.record_batch([pa.array(a), pa.array(ca), partners], ["a", "ca", "partners"])

    return run


def open_pairs(nodes: DataFrame, known: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that lie in different components and have sizes and coordinates that allow a link, but for those of tried and of the nodes' forests; as PARTNERS says.

    nodes: node and what NODE says; known: doc_id, c (component), n (size), fine (coordinates).
    One row for each set of a node meets its component, and one for each set its partners of all nodes, not one for each pair.
    """
    members = nodes.filter(F.size("pairs") > F.col("forest")).select("node", "forest", "pairs", F.posexplode("docs").alias("place", "doc_id"))
    members = members.withColumn("pairs", F.when(F.col("place") == 0, F.col("pairs"))).join(known, "doc_id")
    again = members.groupBy("node").agg(F.max("forest").alias("forest"), F.max("pairs").alias("pairs"), F.sort_array(F.collect_list(F.struct("place", "doc_id", "c", "n", "fine"))).alias("m"))
    found = again.select("forest", "pairs", F.col("m.doc_id").alias("docs"), "m.c", "m.n", "m.fine").mapInArrow(_open(percent), PARTNERS)
    found = found.groupBy("a", "ca").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    found = found.join(tried.select("a", F.col("partners.b").alias("tried")), "a", "left")
    found = found.withColumn("partners", F.expr("filter(partners, p -> not coalesce(array_contains(tried, p.b), false))"))
    return found.filter(F.size("partners") > 0).select("a", "ca", "partners")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb) of the pairs (as PARTNERS says) whose full sets (doc_id, shingles) have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = pairs.join(left, "a").select("a", "ca", "a_set", F.explode("partners").alias("p")).select("a", "ca", "a_set", "p.b", "p.cb").join(right, "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.select("a", "b", "ca", "cb", shared.alias("i"), (F.size("a_set") + F.size("b_set")).alias("n")).filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b", "ca", "cb")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(doc_id, component_id) of all ends of links (a, b), by alternating large-star and small-star rounds."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "doc_id")


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (doc_id, component_id) after links (ca, cb) between components."""
    new = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("new"))
    return written(component.join(new, "component_id", "left").select("doc_id", F.coalesce("new", "component_id").alias("component_id")), "component")


def _classes(linkable: DataFrame) -> tuple[DataFrame, bool]:
    """A row for each different set: set_id, rep (its least doc_id), key, signature; and whether rep is the key, as no doc_id has two sets."""
    classes = linkable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature"))
    n, ids = linkable.agg(F.count("*"), F.count_distinct("doc_id")).first()
    own = n == ids
    return written(classes.withColumn("key", F.col("rep") if own else F.monotonically_increasing_id()), "classes"), own


def _full_sets(texts: DataFrame, wanted: DataFrame, width: int, own: bool, broadcast_ids: int) -> DataFrame:
    """doc_id (the key), n, shingles and fine (coordinates) of each of wanted (key, rep, set_id)."""
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    # Few enough ids go to the texts; more of them meet the texts in a shuffle.
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width, False), "doc_id long, set_id binary, shingles array<long>, fine binary")
    if not own:
        sets = sets.join(wanted.select("set_id", "key"), "set_id").groupBy(F.col("key").alias("doc_id")).agg(F.min("shingles").alias("shingles"), F.min("fine").alias("fine"))
    return written(sets.select("doc_id", F.size("shingles").alias("n"), "shingles", "fine"), "sets")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, recall: float = 0.995, leaf: int = 24, depth: int = 5, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(_sets(width, True), "doc_id long, n_shingles long, set_id binary, signature binary"), "signed")
    linkable = signed.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_id", "signature")
    classes, own = _classes(linkable)
    met, large = candidates(classes.select(F.col("key").alias("doc_id"), "signature"), trees_for(recall, percent / 100, depth), leaf, depth)
    met = written(met.withColumn("node", F.monotonically_increasing_id()), "nodes")
    wanted = met.select(F.explode("docs").alias("key"))
    wanted = (wanted.unionByName(large.select(F.col("doc_id").alias("key"))) if large is not None else wanted).distinct()
    wanted = wanted.withColumn("rep", F.col("key")) if own else wanted.join(classes.select("key", "rep", "set_id"), "key")
    sets = _full_sets(texts, written(wanted, "wanted"), width, own, broadcast_ids)
    sizes, sets = sets.select("doc_id", "n", "fine"), sets.select("doc_id", "shingles")
    # First the closest pairs of each node.
    pairs = met.select(F.explode(F.slice("pairs", 1, F.col("forest"))).alias("p"), "docs").select(F.expr(f"docs[p div {PLACES}]").alias("a"), F.expr(f"docs[p % {PLACES}]").alias("b"))
    forest = written(pairs.groupBy("a").agg(F.collect_set(F.struct("b", F.col("b").alias("cb"))).alias("partners")).select("a", F.col("a").alias("ca"), "partners"), "forest")
    so_far = _merged(sizes.select("doc_id", F.col("doc_id").alias("component_id")), written(confirmed(forest, sets, percent), "links"))
    # Of the others only those that would still join two components.
    others = written(open_pairs(met, sizes.join(so_far.withColumnRenamed("component_id", "c"), "doc_id"), forest, percent), "others")
    links = written(confirmed(others, sets, percent), "links")
    if not links.isEmpty():
        so_far = _merged(so_far, links)
    if large is not None:
        late = written(stragglers(large, sets, so_far, leaf, percent), "late")
        if not late.isEmpty():
            so_far = _merged(so_far, late)
    of_class = classes.select("set_id", "rep", "key").join(so_far.withColumnRenamed("doc_id", "key"), "key", "left").select("set_id", "rep", F.coalesce("component_id", "key").alias("c"))
    if not own:
        # All texts of a doc_id are one document's: their components are one.
        of_row = linkable.join(of_class, "set_id")
        joins = of_row.groupBy("doc_id").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most")
        joins = of_row.join(joins.select("doc_id", "least"), "doc_id").select("least", "c").distinct()
        joined = components(joins.select(F.col("least").alias("a"), F.col("c").alias("b"))).select(F.col("doc_id").alias("c"), F.col("component_id").alias("new"))
        of_class = of_class.join(joined, "c", "left").select("set_id", "rep", F.coalesce("new", "c").alias("c"))
        of_class = of_class.join(of_class.groupBy("c").agg(F.min("rep").alias("least")), "c").select("set_id", F.col("least").alias("component_id"))
    else:
        of_class = of_class.select("set_id", F.col("c").alias("component_id"))
    # An empty set has no class: a key of its own keeps such rows from meeting in one task.
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))
    keyed = signed.select("doc_id", "n_shingles", F.coalesce(linked, F.concat(F.lit("no set, row "), F.monotonically_increasing_id()).cast("binary")).alias("set_id"))
    out = keyed.join(of_class, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
