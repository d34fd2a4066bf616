"""Column functions over names, texts and paths of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at the ends, in the sense of Unicode."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def embedding_text(kind: Column, name: Column, owner: Column, bases: Column, doc: Column) -> Column:
    doc = strip(F.coalesce(doc, F.lit("")))
    return F.concat_ws(
        "\n", F.concat(F.lit("Type: "), kind), F.concat(F.lit("Name: "), name), F.concat(F.lit("Class: "), blank_to_null(owner)),
        F.when((kind == "CLASS") & (F.size(bases) > 0), F.concat(F.lit("Inherits: "), F.array_join(bases, ", "))), F.when(doc != "", F.concat(F.lit("Doc: "), F.substring(doc, 1, 600))),
    )


def text_to_embed(text: Column, chunk: Column) -> Column:
    """What a node's vector stands for: its text, or its source where it has none; null where it has neither."""
    return blank_to_null(strip(F.coalesce(blank_to_null(text), chunk)))


def line_count(source: Column) -> Column:
    """Lines of a source as an editor counts them: an empty one has none, and what follows the last line end is one more."""
    return F.when(F.coalesce(source, F.lit("")) != "", F.size(F.split(source, "\n"))).otherwise(0)


def grep_text(name: Column, signature: Column, path: Column, text: Column) -> Column:
    return strip(F.concat_ws("\n", *map(blank_to_null, (name, signature, path, text))))


def keyword_score(keywords: list[str], name: Column, signature: Column, doc: Column, chunk: Column) -> Column:
    """Mean weight of the keywords over 3: 3 in name or signature, else 2 in the docstring, else 1 in the source."""
    if not keywords:
        return F.lit(0.0)
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, signature, doc, chunk)]
    each = [F.when(low[0].contains(k) | low[1].contains(k), 3).when(low[2].contains(k), 2).when(low[3].contains(k), 1).otherwise(0) for k in keywords]
    return sum(each[1:], each[0]) / F.lit(3.0 * len(keywords))


def folded(c: Column, cased: bool = False) -> Column:
    """As it is compared: empty for null, in lower case unless case counts."""
    c = F.coalesce(c, F.lit(""))
    return c if cased else F.lower(c)


def literal_rank(term: Column, node_id: Column, name: Column, signature: Column, centrality: Column, near: Column, cased: bool = False) -> Column:
    """Rank of a literal hit; near: the node's file is among the files of semantic hits."""
    name, signature = folded(name, cased), folded(signature, cased)
    member = F.concat(F.lit("."), term)
    score = F.when(name == term, F.lit(100.0)).when(name.endswith(member) | node_id.contains(member), 90.0).when(name.contains(term), 70 + centrality).when(signature.contains(term), 35 + centrality).otherwise(50 + centrality)
    short = (F.length(term) <= 4) & (name != term) & signature.contains(term)
    return score - F.when(short, 25.0).otherwise(0.0) + F.when(near, 15.0).otherwise(0.0)


def fuzzy_rank(term: Column, name: Column, signature: Column, centrality: Column, cased: bool = False) -> Column:
    text = folded(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(signature, F.lit(""))), cased)
    tokens = F.filter(F.regexp_extract_all(term, F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    hits = F.size(F.filter(tokens, lambda t: text.contains(t)))
    return F.when(text.contains(term), 80 + centrality).when(F.size(tokens) == 0, F.lit(0.0)).otherwise(hits / F.size(tokens) * 50 + centrality)


def expansions(term: Column) -> Column:
    """Array of (text, weight): a dotted name also stands for its member, its class with the member, and its class."""
    parts = F.filter(F.split(F.regexp_replace(term, "::", "."), "[.]"), lambda p: p != "")
    member, owner = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    pair = lambda t, w: F.struct(t.alias("text"), F.lit(w).alias("weight"))
    alone = F.array(pair(term, 1.0))
    return F.when(F.size(parts) > 1, F.array(pair(term, 1.0), pair(member, 0.85), pair(F.concat_ws(" ", owner, member), 0.8), pair(owner, 0.35))).otherwise(alone)


def one_sentence(c: Column) -> Column:
    """The first sentence of a reply, without code fences, back-ticks and line breaks."""
    lines = F.filter(F.split(strip(F.coalesce(c, F.lit(""))), "\n"), lambda x: ~F.ltrim(x).startswith("```"))
    flat = strip(F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), "`", ""), r"(?U)\s+", " "))
    first = F.regexp_extract(flat, r"^(.+?[.!?])(\s|$)", 1)
    return F.when(first != "", first).otherwise(flat)


def first_lines(c: Column, n: int) -> Column:
    """The first n lines that are neither blank nor comments, without white space at their ends."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.array_join(F.slice(F.filter(lines, lambda x: (F.ltrim(x) != "") & ~F.ltrim(x).startswith("#")), 1, n), "\n")


def cite(start: Column, end: Column, path: Column) -> Column:
    whole = start.isNotNull() & end.isNotNull() & (F.coalesce(path, F.lit("")) != "")
    return F.when(whole, F.concat_ws(":", start.cast("string"), end.cast("string"), path)).otherwise("")


def short_name(node_id: Column) -> Column:
    return F.when(node_id.contains("::"), F.element_at(F.split(F.element_at(F.split(node_id, "::"), -1), "[.]"), -1)).otherwise(node_id)


def module_name(path: Column) -> Column:
    """The dotted name under which a file is imported."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)__init__$", ""), "/", ".")
