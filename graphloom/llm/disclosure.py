"""Personal data and the terms that give it away, in DataFrame functions alone.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers that patterns and checks find. Each
distinct value is a protected entity. A term of a text that mentions an entity discloses it by the information it
carries about it,

    disclosure(t, e) = PMI(t; e) / IC(e),  PMI = log(N n(t, e) / (n(t) n(e))),  IC = log(N / n(e)),

with document counts over the whole corpus. Terms seen with the entity in at least ``SUPPORT`` different texts are
generalised from ``GENERALISE`` on and removed from ``REMOVE`` on, all their occurrences, in texts that hold the entity.

Counts are combined before every shuffle, corpus words as 64-bit hashes, and of all texts only those with entities go
through one in the query. Texts with the same content share their method spans by digest, so hot groups of copies are one row there.

Defined results. Null text: the empty text. Repeated rows, and rows that share a doc_id or have none, are each
returned and judged by their own text. An empty table gives an empty result. Offsets are code points, ends
exclusive. Extra columns are not read by ``find``; ``sanitise`` keeps the columns it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

SUPPORT = 2
GENERALISE = 0.6
REMOVE = 0.85
KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, anchored to where a match can begin (the end of the last one, or the start of a run of
# its first characters) and possessive where giving back can't help, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for its kind's pattern to be tried.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}{3,}"
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(text: str, pattern: str, kind: str, rank: int, offset: str = "0") -> str:
    """SQL for all matches in text as spans. Pieces between the matches, and the matches, give the offsets."""
    return f"""aggregate(
        zip_with(split({text}, {_quoted(pattern)}, -1), regexp_extract_all({text}, {_quoted(pattern)}, 0), (g, m) -> named_struct('g', g, 'm', m)),
        named_struct('at', cast({offset} as int), 'found', cast(array() as array<{_SPAN}>)),
        (a, x) -> named_struct('at', a.at + length(x.g) + coalesce(length(x.m), 0), 'found', if(x.m is null, a.found, concat(a.found, array(
            named_struct('start', a.at + length(x.g), 'rank', {rank}, 'kind', '{kind}', 'end', a.at + length(x.g) + length(x.m), 'value', x.m))))),
        a -> a.found)"""


def _valid(kind: str) -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    luhn = f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a + int(ascii(substring(reverse({digits}), i, 1)) - 48) * if(i % 2 = 0, 2, 1)
        - if(i % 2 = 0 and ascii(substring(reverse({digits}), i, 1)) >= 53, 9, 0)) % 10 = 0"""
    return {
        "email": "true",
        "ip": f"s.value rlike {_quoted(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
        "card": f"if(length({digits}) between 12 and 19, {luhn}, false)",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def base_spans(text: str = "text") -> str:
    """SQL for the sorted array of valid base spans of a text column."""
    none = f"cast(array() as array<{_SPAN}>)"
    parts = [f"if({text} rlike {_quoted(HINTS[k])}, filter({_spans(text, PATTERNS[k], k, r)}, s -> {_valid(k)}), {none})" for r, k in enumerate(KINDS)]
    return f"array_sort(concat({', '.join(parts)}))"


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, string(s.start), string(s.end))), ',')"


def entity(s: str) -> str:
    """What the mentions of one entity have in common."""
    return f"concat({s}.kind, ':', if({s}.kind = 'email', lower({s}.value), regexp_replace({s}.value, '[^0-9.]', '')))"


def with_base(docs: DataFrame) -> DataFrame:
    """Adds base (spans) and key (a digest of texts that have spans; otherwise something of the row's own)."""
    own = docs.withColumn("base", F.expr(base_spans("text")))
    return own.withColumn("key", F.when(F.size("base") > 0, F.sha2("text", 256)).otherwise(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))


#: The text with its base spans blanked: offsets stay, and what is left is outside of all of them.
MASKED = """aggregate(base, named_struct('at', 0, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end,
    'out', concat(a.out, substring(text, a.at + 1, greatest(s.start - a.at, 0)), repeat(' ', s.end - greatest(s.start, a.at))))), a -> concat(a.out, substring(text, a.at + 1)))"""


def entity_texts(found: DataFrame) -> DataFrame:
    """(key, copies, masked, entities): each text with entities once; copies: documents with that text."""
    texts = found.filter(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("copies"), F.min("masked").alias("masked"), F.min("base").alias("base"))
    return texts.select("key", "copies", "masked", F.expr(f"array_distinct(transform(base, b -> {entity('b')}))").alias("entities"))


#: Different words of a text that meet its classes in one task.
WORDS_AT_ONCE = 4096


def text_words(texts: DataFrame) -> DataFrame:
    """texts with values (the distinct words of the masked text), terms (these in lower case) and more (tasks that share them, less one)."""
    values = F.array_distinct(F.expr(f"regexp_extract_all(masked, {_quoted(TERM)}, 0)"))
    own = texts.withColumn("values", values).withColumn("terms", F.array_distinct(F.transform("values", F.lower)))
    return own.withColumn("more", F.expr(f"size(terms) div {WORDS_AT_ONCE}"))


def classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, n_entity) and (key, class)): entities that the same texts hold, SUPPORT of them or more, are one class, by a digest of the texts' keys.

    The entities of a class have the same counts with every term, so a list of addresses that occurs as a whole costs one row a text.
    """
    held = texts.select("key", "copies", F.explode("entities").alias("entity"))
    digest = F.sha2(F.concat_ws(" ", F.count("*"), F.sum(F.xxhash64("key").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("key", F.lit(1)))), 256)
    of_entity = held.groupBy("entity").agg(digest.alias("class"), F.count("*").alias("n"), F.sum("copies").alias("n_entity")).filter(F.col("n") >= SUPPORT)
    of_text = held.select("key", "entity").join(of_entity.select("entity", "class"), "entity").select("key", "class").distinct()
    return of_entity.groupBy("class").agg(F.first("n_entity").alias("n_entity")), of_text


def disclosing(docs: DataFrame, texts: DataFrame, of_class: DataFrame, of_text: DataFrame) -> DataFrame:
    """(class, term, disclosure) of at least GENERALISE; docs: doc_id, text; texts: from text_words; the others: from classes."""
    # A text's copies count as documents, and the text once as support. Words of fewer texts support nothing.
    terms = texts.select("key", "more", F.explode("terms").alias("term"))
    common = terms.groupBy("term").count().filter(F.col("count") >= SUPPORT).select("term")
    dealt = terms.join(common, "term").select("key", "term", F.pmod(F.xxhash64("term"), F.col("more") + 1).alias("part"))
    sides = of_text.join(texts.select("key", "copies", "more"), "key").select("key", "copies", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more").cast("long"))).alias("part"))
    each = sides.join(dealt, ["key", "part"])
    together = each.groupBy("class", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("support")).filter(F.col("support") >= SUPPORT)
    words = docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(F.expr(f"regexp_extract_all(text, {_quoted(TERM)}, 0)")), F.lower))).alias("term"))
    of_term = words.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n_term"))
    total = docs.count()
    counted = together.join(of_class, "class").withColumn("h", F.xxhash64("term")).join(of_term, "h")
    pmi = F.ln(F.lit(float(max(total, 1))) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    content = F.ln(F.lit(float(max(total, 1))) / F.col("n_entity"))
    return counted.select("class", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """key, extra: the method's spans of each text that has any, sorted; rank 4 is generalised, 5 removed."""
    texts = written(text_words(entity_texts(found)), "entity-texts")
    of_class, of_text = (written(df, "classes") for df in classes(texts))
    pairs = written(disclosing(docs, texts, of_class, of_text), "disclosing")
    told = of_text.join(pairs, "class").groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    values = texts.select("key", F.explode("values").alias("value")).withColumn("term", F.lower("value"))
    hit = written(told.join(values, ["key", "term"]).select("key", "value", "disclosure"), "hits")
    # Only the words that a text loses are looked for in it: whole runs of letters, which need no quoting.
    wanted = hit.groupBy("key").agg(F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.sort_array(F.collect_list("value")), "|"), F.lit(r")(?!\p{L})")).alias("pattern")).join(texts.select("key", "masked"), "key")
    parts = F.expr("zip_with(split(masked, pattern, -1), regexp_extract_all(masked, pattern, 0), (g, m) -> named_struct('g', length(g), 'value', m))")
    placed = wanted.select("key", F.posexplode(parts).alias("pos", "x")).select("key", "pos", "x.g", "x.value")
    ends = F.sum(F.col("g") + F.coalesce(F.length("value"), F.lit(0))).over(Window.partitionBy("key").orderBy("pos")).cast("int")
    hit = placed.withColumn("end", ends).filter("value is not null").withColumn("start", F.col("end") - F.length("value")).join(hit, ["key", "value"])
    span = F.struct("start", F.when(F.col("disclosure") >= REMOVE, 5).otherwise(4).alias("rank"), F.lit("term").alias("kind"), "end", "value")
    return hit.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("extra"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def find(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, base and spans, arrays of (start, rank, kind, end, value)."""
    own = _texts(docs)
    found = written(with_base(own).withColumn("masked", F.when(F.size("base") > 0, F.expr(MASKED))).drop("text"), "found")
    extra = term_spans(own, found)
    both = found.select("doc_id", "key", "base").join(extra, "key", "left")
    return both.select("doc_id", "base", F.expr("array_sort(if(extra is null, base, concat(base, extra)))").alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's digests of ``find``."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(F.encode(F.expr(joined("base")), "UTF-8"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))


#: Columns of sanitise's own, beside those of any table.
_BASE, _KEY, _EXTRA = "__disclosure_base", "__disclosure_key", "__disclosure_extra"
_TEXT = "coalesce(cast(text as string), '')"

#: Base spans become their kind; generalised terms become what they look like; removed ones go.
_STANDS_FOR = """case when s.kind != 'term' then concat('[', upper(s.kind), ']') when s.rank = 5 then ''
    when s.value rlike '^\\\\p{Lu}' then '[NAME]' else '[TERM]' end"""
_CLEANED = f"""aggregate({{spans}}, named_struct('at', 0, 'out', ''), (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out),
    named_struct('at', s.end, 'out', concat(a.out, substring({{text}}, a.at + 1, s.start - a.at), {_STANDS_FOR}))), a -> concat(a.out, substring({{text}}, a.at + 1)))"""


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced and disclosing terms generalised or removed in text; n_chars, if there, follows."""
    columns = docs.columns
    # The patterns run over every text once: what is found is written beside the rows.
    own = written(docs.withColumn(_BASE, F.expr(base_spans(_TEXT))).withColumn(_KEY, F.when(F.size(_BASE) > 0, F.sha2(F.expr(_TEXT), 256))), "marked")
    found = own.filter(F.size(_BASE) > 0).select(F.expr(_TEXT).alias("text"), F.col(_BASE).alias("base"), F.col(_KEY).alias("key"))
    extra = term_spans(_texts(docs), found.select("key", "base", F.expr(MASKED).alias("masked")))
    # Rows without spans stay where they are.
    dirty = own.filter(F.size(_BASE) > 0).join(extra.select(F.col("key").alias(_KEY), F.col("extra").alias(_EXTRA)), _KEY, "left")
    cleaned = F.expr(_CLEANED.replace("{text}", _TEXT).replace("{spans}", f"array_sort(if(`{_EXTRA}` is null, `{_BASE}`, concat(`{_BASE}`, `{_EXTRA}`)))"))
    dirty = dirty.withColumn("text", cleaned)
    if "n_chars" in columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return own.filter(F.size(_BASE) == 0).select(*columns).unionByName(dirty.select(*columns))
