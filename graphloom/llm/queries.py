"""The registered queries of these operators: the contract's columns from what the operators return."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import archive, chain_field, chosen_path, disclosure, fill_middle, grid_codes, line_blocks, merge_dropout, nb_svm, source_schedule, token_orc, weighted_sampling, wu_manber
from graphloom.llm.common import new_path, table


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers, or of the folder that GRAPHLOOM_TOKENIZERS names."""
    if folder := os.environ.get("GRAPHLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.encode_and_index(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_field.learn_and_identify(table(spark, sf_dir, "documents"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op8_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    archive.write(table(spark, sf_dir, "pages"), path)
    return archive.index(spark, path)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents"))


def op11_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_schedule.report(table(spark, sf_dir, "documents"))


def op12_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_disclosure, op2_quality, op3_token_orc, op4_language, op5_merge_dropout, op6_near_duplicates, op7_contamination, op8_archive, op9_main_text, op10_fingerprints, op11_source_schedule, op12_grid_codes, op13_fill_middle)}


def _codes_sql() -> str:
    """Every part against every entry, in each of the rounds."""
    steps = ["""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, k AS part, x[k * len(x) // 4 + 1:(k + 1) * len(x) // 4] AS x FROM v, unnest(range(4)) AS r(k)),
c0 AS (SELECT part, e, x AS y FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS e FROM p) WHERE e < 256)"""]
    for k in range(5):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT vec_id, label, p.part, p.x, c.e, list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c ON c.part = p.part),
a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM d{k} GROUP BY ALL)""")
        if k < 4:
            steps.append(f"""s{k} AS (SELECT part, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) AS r(i) GROUP BY ALL),
m{k} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS y FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.e = c.e)""")
    return (
        ", ".join(steps)
        + """, h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS books FROM c4),
o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM o, h"""
    )


ORACLES = {
    "op11_source_schedule": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS w, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, (150 * total - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size * 10 // w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
  > 200 * source_size * sum(w) OVER (ORDER BY source_size * 10 // w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM w),
o AS (SELECT coalesce(sum(source_size) FILTER (is_full), 0) AS full_size, coalesce(sum(w) FILTER (NOT is_full), 0) AS open_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(150 * total - 200 * full_size AS DOUBLE) / CAST(greatest(100 * open_weight, 1) AS DOUBLE) END AS target FROM f, o),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, words - pos)) + greatest(0, least(size, words - pos - source_size)) AS BIGINT) AS taken FROM p""",
    "op12_grid_codes": _codes_sql(),
    "op13_fill_middle": """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS us, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
h AS (SELECT *, CAST(len(us) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(us) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(us) + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM u),
c AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(us[1:least(c1, c2)], '') AS p, array_to_string(us[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(us[greatest(c1, c2) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op7_contamination": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k:k + least(len(ws), 13) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS r(k) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM p),
occ AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM w, lens, unnest(range(1, len(ws) - n + 2)) AS r(k)),
m AS (SELECT occ.doc_id, occ.k, occ.n, p.item_id FROM occ JOIN p ON occ.n = p.n AND occ.win = p.win),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM m), unnest(range(k, k + n)) AS r(j) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""",
    "op6_near_duplicates": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[k] || ' ' || ws[k + 1] END AS s FROM w, unnest(range(1, greatest(len(ws), 2))) AS r(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
