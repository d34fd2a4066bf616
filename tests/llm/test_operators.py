"""Edge cases (nulls, empty and long texts, ties, repeated rows, empty tables, extra columns) and brute force on small fixtures."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import archive, chain_field, chosen_path, disclosure, line_blocks, merge_dropout, nb_svm, token_orc, weighted_sampling, wu_manber
from graphloom.llm import textkit as tk
from graphloom.llm.common import new_path
from graphloom.llm.queries import tokenizer_file

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [(1, "Mail ab.c@mail.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111."), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one"), (6, "one"), (7, LONG), (8, "😀 é 10.0.0.256 10.0.0.255"), (None, "no id")]
EXTRA = "doc_id long, text string, lang string, kept boolean, score double, base string, key string, node long, ids string"


def table(spark, rows, schema=EXTRA):
    return spark.createDataFrame([(i, t, "en", True, 0.5, "b", "k", 1, "i") for i, t in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, TEXTS).cache()


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def near_copies(seed, groups=6, size=60):
    r, docs, k = random.Random(seed), [], 0
    for _ in range(groups):
        base = words(80, r.random())
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.randint(0, 9)):
                own[r.randrange(80)] = "zz" + str(r.randrange(9999))
            docs.append((k, " ".join(own)))
            k += 1
    return docs


def least_reachable(docs, width=2):
    """doc_id: (size of the set, least doc_id reachable) by comparing all pairs that share a shingle; the sets of a doc_id's texts are one document's."""
    sets, parent, holders = [], {i: i for i, _ in docs}, {}
    for i, t in docs:
        w = t.split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
        for g in sets[-1][1]:
            holders.setdefault(g, []).append(len(sets) - 1)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("seed, broadcast_ids", [(1, 1000), (2, 0)])
def test_near_duplicates_equal_brute_force(spark, seed, broadcast_ids):
    docs = near_copies(seed)
    found = {r.doc_id: r for r in chosen_path.near_duplicates(table(spark, docs), width=2, leaf=8, depth=3, broadcast_ids=broadcast_ids).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == least_reachable(docs)
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_dense_groups_near_the_threshold_lose_no_link(spark):
    # Groups larger than a node, with most pairs just around the similarity of a link.
    r, docs = random.Random(17), []
    for _ in range(150):
        base = words(120, r.random())
        for _ in range(30):
            own = list(base)
            for k in r.sample(range(120), r.randint(3, 5)):
                own[k] = f"zz{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in chosen_path.near_duplicates(table(spark, docs), width=2).collect()}
    assert found == least_reachable(docs)


def test_texts_that_share_a_doc_id_are_one_document(spark):
    one, two, three = (" ".join(words(60, k)) for k in (1, 2, 3))
    docs = [(5, one), (5, two), (7, one), (9, two + " x"), (3, two), (11, three), (11, three), (8, three)]
    rows = chosen_path.near_duplicates(table(spark, docs), width=2).collect()
    assert len(rows) == len(docs)
    assert {(x.doc_id, x.component_id) for x in rows} == {(5, 3), (7, 3), (9, 3), (3, 3), (11, 8), (8, 8)} == {(i, c) for i, (_, c) in least_reachable(docs).items()}


def test_trees_reach_the_stated_recall():
    # Pairs by simulation: coordinates that agree at 0.8, nodes that pick one or two of the 64 at random, in each tree.
    rng, depth = np.random.default_rng(5), 5
    trees, met, n = chosen_path.trees_for(0.995), 0, 20_000
    same = rng.random((n, chosen_path.COORDINATES)) < 0.8
    for agreed in same[same.mean(axis=1) >= chosen_path.SIEVE]:
        alive = np.ones(trees, int)
        for _ in range(depth):
            tried = alive + rng.binomial(alive, chosen_path.SECOND)
            alive = rng.binomial(tried, agreed.mean())
        met += alive.any()
    assert met / n > 0.9935
    assert chosen_path.trees_for(0.995, depth=3) < trees


def test_all_candidates_of_a_small_node_are_kept():
    # 12 sketches that agree on more than the sieve asks; the last two of them least of all.
    sketches = np.zeros((12, chosen_path.COORDINATES), np.uint8)
    sketches[10, :12], sketches[11, 12:24] = 1, 2
    node = pa.record_batch([pa.array([list(range(12))]), pa.array([[x.tobytes() for x in sketches]], pa.list_(pa.binary()))], ["docs", "sketches"])
    (out,) = chosen_path._similar([node])
    (docs,), (pairs,), (forest,) = (c.to_pylist() for c in out.columns)
    pairs = [divmod(p, chosen_path.PLACES) for p in pairs]
    assert docs == list(range(12)) and set(pairs) == {(a, b) for b in range(12) for a in range(b)}
    assert len(pairs) == 66 and forest == 11 and pairs[-1] == (10, 11)


def test_large_components_of_a_large_node_meet(spark):
    # Two families of 40 sets, each a component above leaf; sets 7 and 107 alone are at 0.8 across the families.
    r, families = random.Random(4), {}
    for first in (0, 100):
        base = list(range(first * 1000, first * 1000 + 60))
        for k in range(40):
            families[first + k] = set(base) | {10**9 + r.randrange(10**8) for _ in range(5)}
    families[7] = set(range(500, 560)) | set(range(40))
    families[107] = set(range(500, 560)) | set(range(29)) | set(range(900, 911))
    rows = [(i, sorted(s)) for i, s in families.items()]
    near = [(i, j) for i in families for j in families if i < 100 <= j and 100 * len(families[i] & families[j]) >= 80 * len(families[i] | families[j])]
    assert near == [(7, 107)]
    sets = spark.createDataFrame(rows, "doc_id long, shingles array<long>")
    component = spark.createDataFrame([(i, i // 100 * 100) for i in families], "doc_id long, component_id long")
    nodes = spark.createDataFrame([(n, i) for i in families for n in (1, 2)], "node long, doc_id long")
    assert [tuple(x) for x in chosen_path.stragglers(nodes, sets, component, 24, 80).collect()] == [(7, 107, 0, 100)]


def test_near_duplicates_edge_cases(spark, odd):
    rows = chosen_path.near_duplicates(odd, width=2).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert (by[5].component_id, by[6].component_id, by[6].kept) == (5, 5, False)
    assert [by[i].n_shingles for i in (2, 3, 4, 5)] == [0, 0, 0, 1]
    assert by[2].kept and by[3].kept and by[None].component_id is None and by[None].kept
    assert chosen_path.near_duplicates(odd.limit(0)).collect() == []


def test_contamination_in_blocks(spark):
    w = words(60, 5)
    items = [(1, " ".join(w[:20])), (2, " ".join(w[5:25])), (3, "Short item"), (4, None), (5, "..."), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [(1, " ".join(w).upper()), (2, " ".join(w[:12])), (3, "a SHORT, item!"), (4, None), (5, ""), (6, LONG)])
    one = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in wu_manber.contamination(docs, bench).collect()}
    assert one == {1: (60, 25, [1, 2], True), 2: (12, 0, [], False), 3: (3, 2, [3], True), 4: (0, 0, [], False), 5: (0, 0, [], False), 6: (60_000, 0, [], False)}
    many = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in wu_manber.contamination(docs, bench, block_chars=60).collect()}
    assert many == one
    assert wu_manber.contamination(docs.limit(0), bench).collect() == []
    assert not any(r.n_hit for r in wu_manber.contamination(docs, bench.limit(0)).collect())


def test_personal_data(spark, odd):
    rows = disclosure.report(odd).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_email, by[1].n_phone, by[1].n_card, by[8].n_ip) == (1, 1, 1, 1)
    assert by[1].spans == "email:5:26,phone:30:47,card:54:73"
    assert by[8].spans == "ip:15:25" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in disclosure.sanitise(odd).collect()}
    assert clean[1] == "Mail [EMAIL] or [PHONE], card [CARD]." and clean[2] is None and clean[7] == LONG
    assert disclosure.report(odd.limit(0)).collect() == []


def test_terms_that_disclose(spark):
    rows = [(k, f"common words here {k} zorblax ann@mail.example.com quibble end of it") for k in range(4)] + [(100 + k, "common words here end of it and more words") for k in range(200)]
    spans = {r.doc_id: r.spans for r in disclosure.report(table(spark, rows)).collect()}
    assert spans[0].count("term:") == 2 and "term:20:27" in spans[0]
    assert all(spans[100 + k] == "" for k in range(200))
    text = disclosure.sanitise(table(spark, rows)).filter("doc_id = 0").first().text
    assert "zorblax" not in text and "common words" in text


def test_terms_that_disclose_far_from_the_mention(spark):
    far = "common words here and more of them " * 10
    rows = [(k, f"Zorblax {far} {k} ann@mail.example.com {far} zorblax zorblaxes") for k in range(4)] + [(100 + k, far + "zorblaxian") for k in range(200)]
    spans = {r.doc_id: r.spans.split(",") for r in disclosure.report(table(spark, rows)).collect()}
    at = [m.span() for m in re.finditer(r"\b[Zz]orblax(?:es)?\b", rows[0][1])]
    assert [x for x in spans[0] if x.startswith("term:")] == [f"term:{a}:{b}" for a, b in at] and len(at) == 3
    assert all(spans[100 + k] == [""] for k in range(200))
    assert "orblax" not in disclosure.sanitise(table(spark, rows)).filter("doc_id = 0").first().text


def test_long_lists_of_addresses_in_long_texts(spark):
    """Two texts of 400 addresses and 3,000 words each: the addresses are one class, which meets the words once."""
    names = [f"user{k}@mail.example.com" for k in range(400)]
    shared = ["w" + "".join(chr(97 + int(c)) for c in f"{k:05d}") for k in range(3000)]
    rows = [(k, " ".join([*shared, f"only{'ab'[k]}", *names])) for k in range(2)] + [(10 + k, "other text of no interest at all") for k in range(30)]
    began = time.time()
    found = {r.doc_id: (len(r.base), len(r.spans)) for r in disclosure.find(table(spark, rows)).select("doc_id", "base", "spans").collect()}
    assert found == {0: (400, 3400), 1: (400, 3400)} | {10 + k: (0, 0) for k in range(30)} and time.time() - began < 120


def test_classes_of_entities_equal_counts_in_memory(spark, monkeypatch):
    monkeypatch.setattr(disclosure, "WORDS_AT_ONCE", 3)
    r, pool = random.Random(12), words(25, 4)
    docs = []
    for k in range(60):
        group = k % 5
        own = r.sample(pool, 9) + [f"Tell{'abcde'[group]}İx"] * (k % 2)
        own += [f"g{group}n{j}@mail.example.com" for j in range(3)] + [f"one{k}@mail.example.com"]
        docs.append((k, " ".join(own)))
    docs += [(100 + k, " ".join(r.sample(pool, 12))) for k in range(60)]
    got = {x.doc_id: x.text for x in disclosure.sanitise(table(spark, docs)).collect()}
    assert got == sanitised_by_definition(docs)


def test_token_files(spark, odd):
    path = tokenizer_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(path), 0
    rows = sorted(token_orc.encode_and_index(odd, path).collect(), key=lambda r: r.start)
    ordered = sorted(((i, x or "") for i, x in TEXTS), key=lambda r: (r[0] is not None, r))
    for row, (doc_id, text) in zip(rows, ordered, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder = new_path(spark, "orc")
    token_orc.write(odd, folder, path)
    assert [r.doc_id for r in token_orc.read(spark, folder, [5]).collect()] == [5]
    assert token_orc.encode_and_index(odd.limit(0), path).collect() == []


def test_merge_dropout(spark, odd):
    path = tokenizer_file("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {r.doc_id: r for r in merge_dropout.encode(odd, path, dropout=0.0).collect()}
    assert all(plain[i].ids == model.encode(t or "") for i, t in TEXTS)
    a, b = (merge_dropout.encode(odd, path, seed=s).collect() for s in (1, 2))
    assert all(r.lossless for r in [*a, *b]) and any(x.ids != y.ids for x, y in zip(a, b, strict=True))
    assert merge_dropout.encode(odd, path, seed=1).collect() == a
    assert [r.text for r in merge_dropout.decode(merge_dropout.encode(odd, path), path).collect()] == [t or "" for _, t in TEXTS]
    # Bytes that are no UTF-8 come back as they were.
    raw = [b"ab \xff\xfe c\xed\xa0\x80", b"\x80", b"ok \xe2\x82"]
    broken = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    coded = merge_dropout.encode(broken, path)
    assert [bytes(r.b) for r in merge_dropout.decode(coded, path).select(F.col("text").cast("binary").alias("b")).collect()] == raw
    assert all(r.lossless for r in coded.collect())


def agenda_by_definition(model, text, dropout, seed):
    """One agenda a unit, each candidate looked for anew at every step; the pieces' names and scores come from the model alone."""
    scores = {model.id_to_piece(i): (model.get_score(i), -i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    key, m64, out = tk.mix_int(seed), (1 << 64) - 1, []
    name = tk.mix_int(zlib.crc32(text.encode()) ^ key)
    for place, unit in enumerate(re.findall(r" *[^ ]+| +", " " + text) if text else []):
        own = [(k, c.replace(" ", "▁") if c != "▁" else "\U000f0000") for k, c in enumerate(unit)]
        occurrence = tk.mix_int(name + place & m64)
        while True:
            best = None
            for (b, x), (m, y) in zip(own, own[1:]):
                skipped = tk.mix_int(occurrence ^ tk.mix_int(b << 42 ^ m << 21 ^ m + len(y))) >> 32 < int(dropout * 2**32)
                if x in scores and y in scores and x + y in scores and not skipped and (best is None or scores[x + y] > scores[best[1]]):
                    best = b, x + y
            if best is None:
                break
            own = [(b, best[1] if b == best[0] else x) for b, x in own if not best[0] < b < best[0] + len(best[1])]
        out += [i for _, x in own for i in ([model.piece_to_id(x)] if x in scores else [model.piece_to_id(f"<0x{v:02X}>") for v in ("▁" if x == "\U000f0000" else x).encode()])]
    return out


def test_merge_dropout_equals_the_agenda_by_definition():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model, mine, r = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.pieces(path), random.Random(6)
    texts = ["▁ a ▁", "  x  ", "\x00\ud7ff", "日本 😀", "<s>", "", " ", "banana " * 8, "the international organisation of nations", "x" * 30]
    texts += [" ".join("".join(r.choice("aeinrstlo") for _ in range(r.randint(1, 30))) for _ in range(12)) for _ in range(30)]
    for dropout, seed in ((0.0, 1), (0.1, 1), (0.5, 2)):
        ids, n = mine.encode(texts, merge_dropout.text_names([t.encode() for t in texts], seed), dropout)
        stops = np.cumsum(n)
        got = [ids[b - k : b].tolist() for b, k in zip(stops, n, strict=True)]
        assert got == [agenda_by_definition(model, t, dropout, seed) for t in texts]
        assert mine.decode(ids, n) == [t.encode() for t in texts]
    # Long units: the heap gives what arrays give.
    for unit in ("x" * 150, "".join(r.choice("aeinrstlo日") for _ in range(190))):
        a = mine.of_char[np.array([ord(c) for c in unit])]
        b = a.copy()
        mine.segment(a[None, :], np.array([len(a)]), np.array([77], np.uint64), 1 << 29)
        mine.segment_long(b, 77, 1 << 29)
        assert a.tolist() == b.tolist()


def test_occurrences_of_a_word_vary():
    path = tokenizer_file("piece_bpe_32k.model")
    mine, text = merge_dropout.pieces(path), "nationalisation " * 3000
    ids, n = mine.encode([text], merge_dropout.text_names([text.encode()], 1), 0.1)
    starts = np.flatnonzero(mine.blob[mine.places[ids]] == 32)
    assert len({tuple(x) for x in np.split(ids, starts)}) > 30


def test_archive(spark):
    body = "<p>" + "x" * 100
    rows = [(3, "http://a/", body), (1, "http://b/\r\nEvil: 1", body), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (6, "é", "é" * 60 + "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = new_path(spark, "warc")
    archive.write(pages, path)
    by = {r.page_id: r for r in archive.index(spark, path).collect()}
    assert len(by) == len(rows)
    assert {i: (r.record_type, r.refers_to) for i, r in by.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert by[6].payload_bytes == len(rows[-1][2].encode()) and by[6].payload_digest == hashlib.sha256(rows[-1][2].encode()).hexdigest()
    whole = {r.page_id: r for r in archive.records(spark, path).collect()}
    assert all(whole[i].html == (h or "") for i, _, h in rows) and whole[2].url is None
    assert bytes(whole[6].record).endswith(rows[-1][2].encode() + b"\r\n\r\n") and b"\r\nEvil" not in bytes(whole[1].record)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    empty = new_path(spark, "warc")
    archive.write(pages.limit(0), empty)
    assert archive.index(spark, empty).collect() == []


def test_main_text(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=1>Home</a></nav><div class='cookie-notice'>We use cookies on this site for many purposes of ours.</div><article><h1>A &amp; B</h1><p>First   para\n of <b>text</b> that is long enough to be a surge of text in this page.<div class=ad>Buy now and save much money on things that nobody needs</div><p>Short.<aside>Side</aside></article><div id='comments'><p>Reader comment that is quite long, and it goes on and on for a while.</p></div><footer>F</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, "<p>only"), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "u", "<!-- open <p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    by = {r.page_id: r for r in line_blocks.extract(pages).collect()}
    assert by[1].text == "A & B\n\nFirst para of text that is long enough to be a surge of text in this page.\n\nShort."
    assert (by[2].text, by[2].n_chars, by[3].text, by[4].text, by[5].text) == ("", 0, "only", "deep", "")
    plain = "<body><div><a href=1>Menu one</a> <a href=2>Menu two</a></div><div><p>" + "Long sentence of the story. " * 5 + "</p><p>Tiny.</p><p>" + "More of the story again. " * 5 + "</p></div><div class=footer>Imprint</div>"
    assert line_blocks.main_text(plain).count("\n\n") == 2 and "Menu" not in line_blocks.main_text(plain)
    assert line_blocks.extract(pages.limit(0)).collect() == []


STORY = ["Long sentence of the story. " * 5, "More of the story again. " * 5, "And the end of it, at last, for all of us. " * 3]


@pytest.mark.parametrize(
    "start, end",
    [
        ('<body class="single no-sidebar"><div>', "</div>"),
        ('<body class="nav"><div>', "</div>"),
        ('<body><div class="content right-sidebar">', "</div>"),
        ('<body><div class="content sidebar">', "</div>"),
        ('<body><article class="post comment-open">', "</article>"),
        ('<body><article class="related">', "</article>"),
        ('<body><div id="page" class="has-nav">', "</div>"),
        ('<body><div class="overlay"><main>', "</main></div>"),
    ],
)
def test_names_on_wrappers_do_not_empty_the_page(start, end):
    page = f"<html>{start}" + "".join(f"<p>{p}</p>" for p in STORY) + f"{end}<div class=site-footer>Imprint</div></body></html>"
    assert line_blocks.main_text(page) == "\n\n".join(p.strip() for p in STORY)


@pytest.mark.parametrize("name", ["legal", "alert", "notice", "social"])
def test_named_paragraphs_of_the_article_stay(name):
    page = f"<article><p>{STORY[0]}</p><p class={name}>{STORY[1]}</p><div class={name}><a href=1>Share this</a></div><div class=ad-slot>Buy now</div><p>{STORY[2]}</p></article><div id=comments><article class=comment-body><p>{STORY[0]}</p></article></div>"
    assert line_blocks.main_text(page) == "\n\n".join(p.strip() for p in STORY)


def test_long_advert_beside_a_short_article():
    assert line_blocks.main_text(f"<body><div class=ad>{STORY[0]}</div><article><h1>Short</h1><p>Tiny.</article>") == "Short\n\nTiny."


def test_articles_stay_whole():
    story = "".join(f"<p>{p}</p>" for p in STORY)
    whole = [p.strip() for p in STORY]
    text = lambda page: line_blocks.main_text(page).split("\n\n")
    # Short lines at the ends, a list at the end, references that are links.
    ends = ["Fr", "En", "Title"]
    assert text(f"<nav><a>M</a></nav><article><p>Fr</p><p>En</p><h1>Title</h1>{story}<ul>{''.join(f'<li>{x}' for x in ('Tea', 'Egg', 'Ham', 'Jam', 'Fig'))}</ul></article><footer>F</footer>") == [*ends, *whole, "Tea", "Egg", "Ham", "Jam", "Fig"]
    links = [f"Reference {k}" for k in range(6)]
    assert text(f"<article>{story}{''.join(f'<p><a href={k}>{x}</a></p>' for k, x in enumerate(links))}</article>") == [*whole, *links]
    # Several articles, a short one with a sentence among them; one of links only is no text.
    second = "A second article that is far shorter than the first one on this page."
    assert text(f"<article>{story}</article><div><a href=1>More</a></div><article><h2>Next</h2><p>{second}</p></article><article><a href=2>{STORY[0]}</a></article>") == [*whole, "Next", second]
    # A paragraph about what is related stays, links to it go; outside of the article both go.
    assert text(f"<article>{story}<div class=related><p>{second}</p></div><div class=related><a href=1>See also this</a></div></article><div class=related><p>{second}</p></div>") == [*whole, second]


def test_surge_and_dive_choose_where_no_article_is():
    story = "".join(f"<p>{p}</p>" for p in STORY)
    page = f"<div><a href=1>Home</a></div><div><p>Log in</p></div><div><a href=2>News</a></div><div><a href=3>Shop</a></div><h1>Title</h1>{story}<p>Fin.</p><div><a href=4>Next</a></div><div><a href=5>Last</a></div><div><p>Imprint</p></div>"
    assert line_blocks.main_text(page) == "\n\n".join(["Title", *(p.strip() for p in STORY), "Fin."])
    # With a window that spans the page, the rest of the page is text as well.
    assert "Log in" in line_blocks.main_text(page, window=50)


def test_given_pages_without_article_tags():
    """The distribution alone finds most of what the articles hold, and hardly anything else; without it, all lines would be text."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    found = kept = wanted = everything = 0
    for page in pages:
        want = Counter(line_blocks.main_text(page).split("\n\n"))
        bare = re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")
        got = Counter(line_blocks.main_text(bare).split("\n\n"))
        size = lambda lines: sum(len(x) * n for x, n in lines.items())
        found, kept, wanted = found + size(got & want), kept + size(got), wanted + size(want)
        everything += sum(len(x.text) for x in line_blocks.lines_of(bare) if not x.furniture)
    assert found > 0.95 * wanted and found > 0.95 * kept and kept < everything


def test_windows_equal_sums_by_definition():
    r = random.Random(8)
    for _ in range(300):
        weights, window, level = [r.choice([0, 0, 3, 10, 80]) for _ in range(r.randint(0, 30))], r.randint(1, 5), r.choice([1, 16, 60])
        n = len(weights)
        sums = [(sum(weights[i : i + window]), sum(weights[max(0, i - window + 1) : i + 1])) for i in range(n)]
        low = max(1, min(level, max((a for a, _ in sums), default=0) / 2))
        inside = {i for i in range(n) if max(sums[i]) >= low}
        assert {i for a, b in line_blocks.stretches(weights, window, level) for i in range(a, b)} == inside
        assert all(b not in inside and a - 1 not in inside for a, b in line_blocks.stretches(weights, window, level))


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a ='", "<!", "<script ", "<div>x", "<div class=ad>x", '<a "> ', '<a href=">"', "</b><i>"])
def test_extraction_is_linear_in_the_page(piece):
    began = time.process_time()
    line_blocks.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 15


def plain_main_text(page):
    """Pages with neither names nor inline furniture: the article's blocks by the parser of the standard library."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        out, own, depth, skipped = [], [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.end() if tag not in ("a", "b", "i", "em") else None
            self.depth += tag == "article"
            self.skipped += tag == "aside" or dict(attrs).get("class") == "ad"
            self.names = [*getattr(self, "names", []), (tag, tag == "aside" or dict(attrs).get("class") == "ad")] if tag not in ("br", "meta", "p") else getattr(self, "names", [])

        def handle_endtag(self, tag):
            self.end() if tag not in ("a", "b", "i", "em") else None
            if tag in ("article", "aside", "div"):
                while self.names:
                    name, skips = self.names.pop()
                    self.skipped -= skips
                    if name == tag:
                        break
                self.depth -= tag == "article"

        def handle_data(self, data):
            self.own.append(data if self.depth and not self.skipped else "")

        def end(self):
            text = re.sub(r"\s+", " ", "".join(self.own)).strip()
            self.out = [*self.out, text] if text else self.out
            self.own = []

    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.end()
    return "\n\n".join(parser.out)


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    found = {r.page_id: r.text for r in line_blocks.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    assert len(found) == len(pages) and all(found[p.page_id] == plain_main_text(p.html) for p in pages)


def bag(t):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w) or Counter([""])


def test_fingerprints(spark, odd):
    same = [(502, "same"), (502, "same"), (502, "other words"), (None, "null id"), (None, "null id too")]
    docs = [(i * 3, " ".join(words(120, i % 7))) for i in range(40)] + [(500, None), (501, "")] + same
    rows = weighted_sampling.fingerprints(table(spark, docs)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    edited = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in rows}
    off, left = [], Counter({k: 1 for k in edited})
    # The order among the texts of one doc_id is the operator's own: any one of the neighbouring doc_id's texts may follow.
    ids = sorted({i for i, _ in docs if i is not None}, reverse=True) + [None]
    texts = {i: [t or "" for j, t in docs if j == i] for i in ids}
    for k, i in enumerate(ids):
        for t in texts[i]:
            may = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for x in texts[ids[(k + 1) % len(ids)]] + [x for x in texts[i] if x != t]]
            (row, e), *_ = [(edited[key], e) for e in may if (key := (i, len(t), hashlib.sha256(e.encode()).hexdigest())) in edited]
            a, b = bag(t), bag(e)
            off.append(row.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.05 and np.std(off) < 0.1
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[21].fingerprint and by[501].near_next == 1.0
    assert weighted_sampling.fingerprints(odd.limit(0)).collect() == []


def test_followers_in_a_wide_range_of_ids(spark):
    r = random.Random(2)
    ids = sorted({r.randrange(1000) for _ in range(300)} | {-(2**62) - 5, 2**62, 2**63 - 1, -(2**63)})
    docs = [(i, f"{i} " * r.randint(0, 9)) for i in ids]
    got = {x.doc_id: x for x in weighted_sampling.fingerprints(table(spark, docs)).collect()}
    for k, (i, t) in enumerate(docs):
        following = docs[k - 1][1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + following[: len(t) // 3]).encode()).hexdigest()


def test_samples_equal_the_definition(spark):
    # The least ln a by plain loops over Spark's own hashes of the terms.
    texts, n = ["a b b c c c", "a b b b x", "", "c c c c c c c c c c"], 8
    names = sorted({w for t in texts for w in bag(t)})
    hashes = spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("h"))
    both = {r.w: [(r[f"x{j}"], r[f"y{j}"]) for j in range(n)] for r in hashes.select("w", *[F.xxhash64("h", F.lit(2 * j)).alias(f"x{j}") for j in range(n)], *[F.xxhash64("h", F.lit(2 * j + 1)).alias(f"y{j}") for j in range(n)]).collect()}
    uniform = lambda h, part: ((((h & (2**64 - 1)) >> 21 * part) & (2**21 - 1)) + 0.5) / 2**21

    def least(t, j):
        out = []
        for w, s in bag(t).items():
            x, y = both[w][j]
            r, c, b = -math.log(uniform(x, 0) * uniform(x, 1)), -math.log(uniform(y, 0) * uniform(y, 1)), uniform(x, 2)
            out.append((math.log(c) - r * (math.floor(math.log(s) / r + b) - b + 1), w))
        return min(out)

    counted = spark.createDataFrame([(k, w, s) for k, t in enumerate(texts) for w, s in bag(t).items()], "key long, w string, s long").select("key", F.xxhash64("w").alias("term"), "s")
    found = {r.key: r.fp for r in weighted_sampling.signatures(counted, ["key"], {"fp": "s"}, n).collect()}
    for j in range(n):
        for a in range(len(texts)):
            for b in range(a):
                assert (found[a][j] == found[b][j]) == (abs(least(texts[a], j)[0] - least(texts[b], j)[0]) < 1e-12)


def test_quality_and_language_on_held_out_rows(spark):
    r, docs, labels = random.Random(3), [], []
    for i in range(600):
        lang = "en" if i % 2 else "xx"
        base = ["the", "and", "of", "thing", "with"] if lang == "en" else ["der", "und", "von", "ding", "mit"]
        own = [r.choice(base) + r.choice(["", "s", "er"]) for _ in range(40)]
        good = i % 3 > 0
        docs.append((i, " ".join(own if good else [w.upper() + "!!" for w in own]), lang))
        labels.append((i, int(good)))
    docs += [(9000, None, "en"), (9001, "", None), (9002, "123 ...", "en"), (9003, LONG, None), (None, "the thing", "en")]
    table_ = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("label", F.lit(7))
    marks = spark.createDataFrame([*labels, (9000, None), (77777, 1)], "doc_id long, quality int")
    scored = {x.doc_id: x for x in nb_svm.classify(table_, marks).collect()}
    assert len(scored) == len(docs)
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert all(scored[i].predicted == y for i, y in labels if scored[i].held_out)
    found = {x.doc_id: x for x in chain_field.learn_and_identify(table_).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in docs[:600] if found[i].held_out)
    assert [found[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert nb_svm.classify(table_.limit(0), marks).collect() == [] and chain_field.learn_and_identify(table_.limit(0)).collect() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    psi, move = rng.random((1, 4, 3)), rng.random((3, 3))
    total = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.prod([psi[0, t, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
        for t, y in enumerate(path):
            total[t, y] += p
    assert np.allclose(chain_field.marginals(psi, move)[0][0], total / total.sum(axis=1, keepdims=True))


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_by_definition(t):
    """The contract's spans with the standard library's regular expressions."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end(), m[0]) for k, (kind, pattern, good) in enumerate(rules) for m in re.finditer(pattern, t) if good(m[0])]
    return sorted(found)


def test_base_spans_equal_the_definition_on_random_texts(spark):
    r = random.Random(12)
    bits = ["a.b@c.de", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+49.30.1234567", "+", "-", " ", "0", "12", "x", "é", "😀", "a%b@d-e.f.g", "1.2.3.4.5", "5500005555555559"]
    docs = [(k, "".join(r.choice(bits) + r.choice(["", "", " ", "."]) for _ in range(r.randint(0, 25)))) for k in range(400)]
    got = {x.doc_id: x for x in disclosure.report(table(spark, docs)).collect()}
    for k, t in docs:
        want = base_by_definition(t)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b, _ in want)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(x[2] == kind for x in want) for kind in ("email", "ip", "card", "phone"))


def sanitised_by_definition(docs):
    """Counts of documents in dictionaries, all texts in memory."""
    texts = {i: t or "" for i, t in docs}
    base = {i: base_by_definition(t) for i, t in texts.items()}
    entity = lambda s: (s[2], s[4].lower() if s[2] == "email" else re.sub("[^0-9.]", "", s[4]))
    blank = {}
    for i, t in texts.items():
        for a, _, _, b, _ in base[i]:
            t = t[:a] + " " * (b - a) + t[b:]
        blank[i] = t
    letters = r"[^\W\d_]+"
    terms = {i: {w.lower() for w in re.findall(letters, blank[i]) if len(w) >= 3} for i in texts}
    n_term = Counter(w for t in texts.values() for w in {x.lower() for x in re.findall(letters, t) if len(x) >= 3})
    held = {i: {entity(s) for s in base[i]} for i in texts}
    n_entity = Counter(e for es in held.values() for e in es)
    both = Counter((e, w) for i in texts for e in held[i] for w in terms[i])
    distinct = Counter((e, w) for t in {t: i for i, t in texts.items()}.values() for e in held[t] for w in terms[t])
    n, score = len(texts), {}
    for (e, w), k in both.items():
        if distinct[e, w] >= disclosure.SUPPORT and n_entity[e] < n:
            d = math.log(n * k / (n_term[w] * n_entity[e])) / math.log(n / n_entity[e])
            if d >= disclosure.GENERALISE:
                score[e, w] = d
    out = {}
    for i, t in texts.items():
        spans = [(a, b, f"[{kind.upper()}]") for a, _, kind, b, _ in base[i]]
        for m in re.finditer(letters, blank[i]):
            d = max((score.get((e, m[0].lower()), 0) for e in held[i]), default=0)
            if d:
                spans.append((m.start(), m.end(), "" if d >= disclosure.REMOVE else "[NAME]" if m[0][0].isupper() else "[TERM]"))
        new, at = "", 0
        for a, b, what in sorted(spans):
            if a >= at:
                new += t[at:a] + what
            at = max(at, b)
        out[i] = new + t[at:]
    return out


def personal_docs():
    r, docs = random.Random(21), []
    common = words(30, 9)
    for k in range(160):
        own = r.sample(common, 8)
        if k % 4 == 0:
            e = r.randrange(6)
            own += [f"user{e}@mail.example.com", f"Zork{'abcdef'[e]}", "quibbling" if r.random() < 0.7 else "thing"]
        if k % 10 == 0:
            own.append("+1 (988) 555-2485")
        r.shuffle(own)
        docs.append((k, " ".join(own)))
    return [*docs, (900, None), (901, "")]


def test_disclosing_terms_equal_counts_in_memory(spark):
    docs = personal_docs()
    want = sanitised_by_definition(docs)
    got = {x.doc_id: x.text for x in disclosure.sanitise(table(spark, docs)).collect()}
    assert {i: t or "" for i, t in got.items()} == want and sum("[TERM]" in t or "[NAME]" in t for t in want.values()) > 0
    assert any(len(t.split()) < len(dict(docs)[i].split()) for i, t in want.items() if i < 900)


def test_dual_coordinate_descent_equals_dense_steps():
    rng, dim = np.random.default_rng(4), 40
    rows = [np.unique(rng.integers(0, dim, rng.integers(1, 9))) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    values = np.zeros(nb_svm.DIM)
    values[:dim] = rng.normal(size=dim)
    product, bias = nb_svm.dual_coordinate_descent(rows, y, values, epochs=400)
    x = np.zeros((60, dim + 1))
    for k, r in enumerate(rows):
        x[k, r] = values[r] / np.sqrt((values[r] ** 2).sum())
        x[k, dim] = 1
    share = (y > 0).mean(), (y < 0).mean()
    most = np.where(y > 0, min(1.0, share[1] / share[0]) ** 0.5, min(1.0, share[0] / share[1]) ** 0.5)
    objective = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w))).sum()
    w = np.zeros(dim + 1)
    np.divide(product[:dim], values[:dim], out=w[:dim], where=values[:dim] != 0)
    w[dim] = bias
    # No point nearby is better than the solution found by more than its tolerance.
    best = objective(w)
    for _ in range(300):
        assert objective(w + rng.normal(size=dim + 1) * 10 ** rng.uniform(-4, 0)) > best * (1 - 1e-3)


def test_long_rows_are_packed_and_teach_the_same():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, nb_svm.DIM, n)).astype(np.int32) for n in (0, 1, 30, 8192, 9000, 60_000)]
    raw = [nb_svm.packed(x) for x in rows]
    assert all((nb_svm.unpacked(x) == y).all() and len(x) <= nb_svm.DIM // 8 + 1 for x, y in zip(raw, rows, strict=True))
    positive = np.array([True, False, True, False, True, False])
    one, two = nb_svm.learn(rows, positive), nb_svm.learn(nb_svm.Rows(raw), positive)
    assert (one.values == two.values).all() and one.bias == two.bias and (one.scale == two.scale).all()


def test_ratios_equal_counts():
    rows, positive = [np.array([1, 2]), np.array([2, 3]), np.array([3])], np.array([True, False, False])
    p, q = np.ones(nb_svm.DIM), np.ones(nb_svm.DIM)
    p[[1, 2]] += 1
    q[[2, 3]] += 1
    q[3] += 1
    assert np.allclose(nb_svm.log_count_ratios(rows, positive), np.log(p / p.sum()) - np.log(q / q.sum()))


def test_words_of_code_switched_text_have_their_own_labels(spark):
    r, docs = random.Random(5), []
    kinds = {"en": ["the", "and", "of", "thing", "with", "this"], "de": ["der", "und", "von", "ding", "mit", "dies"]}
    for i in range(400):
        lang = "en" if i % 2 else "de"
        docs.append((i, " ".join(r.choice(kinds[lang]) + r.choice(["", "s", "er"]) for _ in range(30)), lang))
    field = chain_field.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    mixed = "The thing with this and of\n\n the things 12 der Ding und von mit dies dinger"
    rows = chain_field.label_words(table(spark, [(1, mixed), (2, None), (3, "")]), field).orderBy("place").collect()
    assert [(x.word, x.start) for x in rows] == [(m[0], m.start()) for m in re.finditer(r"\S+", mixed)]
    assert [x.lang for x in rows] == ["en"] * 8 + ["und"] + ["de"] * 7 and all(x.doc_id == 1 and 0 <= x.probability <= 1 for x in rows)
    assert {x.lang for x in chain_field.label_words(table(spark, [(1, mixed)]), None).collect()} == {"und"}


def test_token_files_prune_and_keep_their_order(spark):
    path, folder = tokenizer_file("word_bpe_49k.json"), new_path(spark, "orc")
    docs = table(spark, [(i, f"text number {i}") for i in range(4000)])
    token_orc.write(docs, folder, path, row_index=1000)
    numbers = spark.createDataFrame([(f"x/part-{n}-abc.c000.orc",) for n in ("00002", "100000", "99999")], "f string")
    assert [x[0] for x in numbers.orderBy(token_orc.file_number(F.col("f"))).collect()] == [f"x/part-{n}-abc.c000.orc" for n in ("00002", "99999", "100000")]
    import pyarrow.orc as orc

    files = [f.removeprefix("file://").removeprefix("file:") for f in token_orc.read(spark, folder).select("file").distinct().toPandas()["file"]]
    # The files hold Bloom filters, and ranges of doc_id that do not overlap.
    spans = sorted((min(ids), max(ids)) for f in files if len(ids := orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist()))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and spans[-1][1] == 3999
    assert "PushedFilters: [In(doc_id" in token_orc.read(spark, folder, [77, 3000])._jdf.queryExecution().toString().replace("IsNotNull(doc_id), ", "")
    assert sorted(r.doc_id for r in token_orc.read(spark, folder, [77, 3000]).collect()) == [77, 3000]


def encoded(texts, path):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [ids for out in token_orc._encode(path, 2)(iter([batch])) for ids in out.column("ids").to_pylist()]


def test_token_files_encode_the_pieces_of_words_once(monkeypatch):
    path, asked = tokenizer_file("word_bpe_49k.json"), []

    class Encoder(token_orc.WordEncoder):
        def __call__(self, words):
            asked.extend(words)
            return super().__call__(words)

    memory = token_orc.WordMemory(Encoder(token_orc._tokenizer(path)))
    monkeypatch.setattr(token_orc, "_memory", lambda _: memory)
    encoded(["The cat, the CAT. (Cat!)", "don't cat@the.cat"], path)
    encoded(["the, cat.the"], path)
    assert sorted(asked) == sorted(["the", "cat", ",", ".", "(", "!)", "don", "'t", "@"])


def test_token_files_read_the_ids_once(spark):
    folder = new_path(spark, "orc")
    token_orc.write(table(spark, [(i, f"text number {i}") for i in range(100)]), folder, tokenizer_file("word_bpe_49k.json"))
    plan = token_orc.index(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Format: ORC" not in plan and "Format: Parquet" in plan


def test_token_files_of_odd_texts_equal_the_tokenizer(tmp_path, monkeypatch):
    from tokenizers import Tokenizer, pre_tokenizers

    r = random.Random(8)
    parts = [*"aBsSJHIKt'.=@_1", "re", "ING", "''", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "</w>", "\u030c", "\u0301", "\u0307", "\u0331", "\u0338", "İ", "ß", "Σ", "é", " ", "  "]
    parts += ["\n", "\t", "\r", "\0", "\x1c", "\x85", "\xa0", "\u2009", "\u200d", "½", "٣", "中文", "😀", "ﬁ", "’s", "ǅ", "\U0001d400"]
    texts = [None, "", " ", "\n\n", *("".join(r.choices(parts, k=r.randrange(14))) for _ in range(4000))]
    texts += [x.replace("<|endoftext|>", "e") for x in texts[4:]]
    public = tokenizer_file("word_bpe_49k.json")
    other = Tokenizer.from_file(public)
    other.normalizer = None
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    for path in (public, str(tmp_path / "other.json")):
        tokenizer = Tokenizer.from_file(path)
        for some in (texts, texts[4004:], texts[4004:4010]):  # a text with the name of an added token keeps all that come with it whole
            assert encoded(some, path) == [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for x in some]
        small = token_orc.WordMemory(token_orc.WordEncoder(tokenizer), limit=40)
        with monkeypatch.context() as m:
            m.setattr(token_orc, "_memory", lambda _, small=small: small)
            assert [encoded([x], path)[0] for x in texts[:500]] == [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for x in texts[:500]] and len(small.index) <= 40


@pytest.mark.parametrize("name", ["op6_near_duplicates", "op7_contamination", "op8_archive"])
def test_query_equals_its_sql(spark, name):
    from oracle import actual, expected

    from graphloom.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    assert actual(QUERIES[name](spark, folder)) == expected(ORACLES[name], folder)


CLASH = "score double, hit string, items string, spans string, extra string, base string, key string, n_words long, contaminated boolean, kept boolean, component_id long, ids string, n_chars long"


def test_pipeline_stages_equal_brute_force_and_keep_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    docs = personal_docs() + [(2000 + i, t) for i, t in near_copies(3, groups=2, size=12)] + [(None, "no id"), (None, "no id"), (5, "five again"), (5, "five again")]
    items = [(1, " ".join(words(20, 77)))]
    docs += [(3000, items[0][1]), (3001, items[0][1] + " and " + " ".join(words(800, 5)))]
    rows = [(i, t, *[None] * 12, 7) for i, t in docs]
    own = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").select("doc_id", "text", *[c.split()[0] for c in CLASH.split(", ")])
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(160)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    # Quality: what the same model scores by itself.
    out = stages["quality"](spark, own, str(tmp_path))
    model = nb_svm.fit(own, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [(i, t) for i, t in docs if model.scores(nb_svm.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))[0] >= 0.5]
    assert out.columns == own.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(good, key=key)
    # Near duplicates: each row is a document, whatever its doc_id; of those that reach each other the first stays.
    ordered = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    least = least_reachable([(k, t or "") for k, (_, t) in enumerate(ordered)], width=5)
    groups = {}
    for k, (_, c) in least.items():
        groups.setdefault(c, []).append(ordered[k])
    out = stages["near duplicates"](spark, own, str(tmp_path))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == own.columns and len(got) == len(groups)
    for rows_of in groups.values():
        assert sum(got.count(r) for r in set(rows_of)) == 1 and any(r in got and r[0] == rows_of[0][0] for r in rows_of)
    # Different texts under one id stay, near copies go whatever their ids are.
    apart, copy = " ".join(words(60, 901)), " ".join(words(60, 902))
    few = [(1, copy), (5, copy + " end"), (5, apart), (7, apart), (7, "quite another text under the same id"), (None, copy), (None, "no id"), (None, "no id")]
    out = stages["near duplicates"](spark, spark.createDataFrame(few, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, copy), (5, apart), (7, "quite another text under the same id"), (None, "no id")], key=repr)
    plain = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(few)], "doc_id long, text string")
    assert sorted(r.doc_id for r in stages["near duplicates"](spark, plain, str(tmp_path)).collect()) == [0, 2, 4, 6]
    # Contamination: the one document of which a twentieth or more is the item.
    out = stages["decontamination"](spark, own, str(tmp_path))
    assert out.columns == own.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(((i, t) for i, t in docs if i != 3000), key=key)
    # Personal data: counts in memory. Rows without a doc_id get one for that.
    named = [(9000 + k, t) for k, (_, t) in enumerate(docs)]
    want = sanitised_by_definition(named)
    out = stages["personal data"](spark, own, str(tmp_path))
    assert out.columns == own.columns and sorted((r.text or "") for r in out.collect()) == sorted(want.values())
    assert all(r.n_chars == 7 or r.n_chars == len(r.text) for r in out.collect())
    # Encoding: the ids stand for the texts.
    path = tokenizer_file("piece_bpe_32k.model")
    out = stages["encoding"](spark, own, str(tmp_path))
    back = merge_dropout.decode(out, path).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t in docs), key=key)
    # And nothing out of nothing.
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.limit(0), str(tmp_path)).collect() == [], name


def test_pipeline_on_the_smallest_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert out and all(r.lossless for r in out) and {r.doc_id for r in out} <= docs and len({r.doc_id for r in out}) == len(out)
