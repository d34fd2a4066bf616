"""Source schedules, vector codes and fill-in-middle texts against plain loops, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle, grid_codes, source_schedule
from graphloom.llm.common import sums_before, written

DOCS = "doc_id long, text string, source string, size long, row long, slot string, place string, `n` string, __range int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "s", "p", "n", 3) for i, t, s in rows], DOCS)


def sized_text(n):
    return " \n".join(f"w{k}" for k in range(n))


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    """Shares handed out, and what is over handed on, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, rest = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    while rest > 1e-9:
        open_ones = [s for s in names if target[s] < 2 * sizes[s]]
        given = {s: rest * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        rest = 0.0
        for s in open_ones:
            rest += max(0.0, target[s] + given[s] - 2 * sizes[s])
            target[s] = min(2.0 * sizes[s], target[s] + given[s])
    return target


def mixed_by_loops(rows):
    """doc: (size, source size, target, taken) with sources as streams of documents in order of their keys."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    target, out = targets_by_rounds(sizes), {}
    for s in sizes:
        own = sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.sha256(f"7:{i}".encode()).hexdigest()[:16], i))
        left, taken = math.floor(target[s] + 0.5), dict.fromkeys(own, 0)
        for _ in range(2):
            for i in own:
                taken[i] += min(size[i], left)
                left -= min(size[i], left)
        out |= {i: (size[i], sizes[s], target[s], taken[i]) for i in own}
    return out


@pytest.fixture(scope="module")
def sources(spark):
    r = random.Random(1)
    rows = [(k, sized_text(r.randint(0, 60)), r.choice(["a", "b", "b", "ä", "z", None, "Z"])) for k in range(300)]
    rows += [(300, sized_text(5000), "long"), (301, None, "a"), (302, "", None), (303, " \t\n", "b"), (304, "one", "single"), (305, None, "void"), (306, sized_text(700), "a")]
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_equals_streams_by_loops(spark, sources, block):
    got = source_schedule.report(docs(spark, sources), block=block).collect()
    want = mixed_by_loops(sources)
    assert len(got) == len(sources)
    for x in got:
        size, source_size, target, taken = want[x.doc_id]
        assert (x["size"], x.source_size, x.taken) == (size, source_size, taken) and abs(x.target - target) < 1e-6


def test_slots_hold_their_blocks_and_keep_shares_all_along(spark, sources):
    made = source_schedule.mix(docs(spark, sources), block=16)
    aims = {x.place: x for x in made.sources.collect()}
    assert sum(x.words for x in aims.values()) == pytest.approx(1.5 * sum(x.source_size for x in aims.values()), abs=len(aims))
    place = {x.row: x.place for x in made.documents.join(made.sources.select("source", "place"), made.documents.source.eqNullSafe(made.sources.source)).collect()}
    words, source_of = {}, {}
    for x in made.pieces.collect():
        words[x.slot] = words.get(x.slot, 0) + x["last"] - x["first"]
        assert source_of.setdefault(x.slot, place[x.row]) == place[x.row] and x["last"] > x["first"] >= 0
    for p, x in aims.items():
        own = [words[k] for k, q in source_of.items() if q == p]
        # As many slots as said, alike to a word, and together just the words to take.
        assert len(own) == x.slots and sum(own) == x.words and (not own or max(own) - min(own) <= 1)
    total = sum(x.words for x in aims.values())
    last = math.ceil(total / 16)
    for p, x in aims.items():
        so_far = 0
        for k in range(last):
            so_far += source_of.get(k) == p
            assert abs(so_far - (k + 1) * x.words / total) < 2 + math.log2(last)


def test_texts_of_the_mix(spark, sources):
    own = docs(spark, sources)
    made = source_schedule.mix(own, block=16)
    pieces = source_schedule.texts(own, made.pieces).collect()
    of = {i: re.findall(r"\S+", t or "") for i, t, _ in sources}
    assert len(pieces) == made.pieces.count()
    for x in pieces:
        n = len(x.text.split(" "))
        assert x.text.split(" ") == of[x.doc_id][x["first"] : x["first"] + n]


def test_mix_edge_cases(spark):
    assert source_schedule.report(docs(spark, [])).collect() == []
    assert source_schedule.report(docs(spark, [])).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert [tuple(x) for x in source_schedule.report(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    # A third of all rows repeat one row, some have no id: each is a document.
    rows = [(1, "a b c", "x")] * 30 + [(None, "d e", "x")] * 5 + [(None, None, "y")] + [(k, sized_text(4), "y") for k in range(50)]
    got = source_schedule.report(docs(spark, rows), block=4).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x["size"] for x in got)
    aim = {x.source_size: x.target for x in got}
    assert {n: sum(x.taken for x in got if x.source_size == n) for n in aim} == {n: math.floor(t + 0.5) for n, t in aim.items()}
    again = source_schedule.report(docs(spark, rows[::-1]).repartition(3), block=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_sums_before_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.common.RANGE_ROWS", (40, 1000))
    rows = [(k, k % 5) for k in range(300)]
    df = written(spark.createDataFrame(rows, "k long, v long").repartition(7), "rows")
    got = {x.k: x.b for x in sums_before(df, [F.desc("k")], {"b": "v"}).collect()}
    assert got == {k: sum(v for j, v in rows if j > k) for k, _ in rows}


VECTORS = "vec_id long, embedding array<float>, label int, scaled string, code string, error double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, "s", "c", 0.5) for i, v, c in rows], VECTORS).repartition(3)


def codes_by_loops(rows, entries, rounds=4, parts=4):
    """Every part against every entry, in whole numbers of any size."""
    kept = [(i, [math.floor(1024 * x) for x in np.array(v, np.float32).astype(float).tolist()], c) for i, v, c in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    kept = [x for x in kept if len(x[1]) == len(kept[0][1])]
    d = len(kept[0][1]) // parts
    books = [[x[1][p * d : p * d + d] for x in kept[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), k) for k, y in enumerate(books[p]))
    for _ in range(rounds):
        members = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                own = v[p * d : p * d + d]
                members[p].setdefault(near(p, own)[1], []).append(own)
        for p in range(parts):
            for k, own in members[p].items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, v, c in kept:
        found = [near(p, v[p * d : p * d + d]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), c))
        by_label[c] = by_label.get(c, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, code, e, by_label[c], digest) for i, code, e, c in out), key=repr)


def random_vectors(n, dims, seed):
    r = random.Random(seed)
    return [(k, [r.gauss(0, 0.15) for _ in range(dims)], r.choice([1, 2, 3, None])) for k in range(n)]


@pytest.mark.parametrize("entries", [16, 256])
def test_codes_equal_loops(spark, entries):
    rows = random_vectors(120, 16, entries)
    rows += [(200, None, 1), (201, [0.1] * 15 + [None], 1), (202, [float("nan")] + [0.0] * 15, 2), (203, [float("inf")] * 16, 2), (-4, [float("-inf")] * 16, 2)]
    # Ties, a third of all rows equal, ids that occur again, no id, negative components that floor down.
    rows += [(300 + k, [0.0625] * 16, 3) for k in range(50)] + [(7, [-0.0001] * 16, None), (None, [0.0] * 16, 1), (None, [0.001] * 16, None), (5, [0.3] * 12, 1)]
    coded, books = grid_codes.compressed(vectors(spark, rows), entries=entries)
    errors = {}
    got = coded.collect()
    for x in got:
        errors[x.label] = errors.get(x.label, 0) + x.error
    assert sorted(((x.vec_id, x.code, x.error, errors[x.label], books.digest()) for x in got), key=repr) == codes_by_loops(rows, entries)
    if entries == 256:
        names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        report = grid_codes.codes(vectors(spark, rows))
        assert report.columns == names
        assert sorted(map(tuple, report.collect()), key=repr) == codes_by_loops(rows, 256)


def test_codes_edge_cases(spark):
    assert grid_codes.codes(vectors(spark, [])).collect() == [] == grid_codes.codes(vectors(spark, [(1, None, 1), (2, [], 1)])).collect()
    # Fewer components than parts.
    got = grid_codes.codes(vectors(spark, [(1, [0.5, -0.5], 1), (2, [0.25, 0.0], 1)])).collect()
    assert {x.vec_id: (x.code, x.error) for x in got} == {1: ("00000000", 0), 2: ("00010001", 0)}
    with pytest.raises(Exception, match="131072"):
        grid_codes.codes(vectors(spark, [(1, [2.0e5] * 4, 1)])).collect()


@pytest.mark.parametrize("cell", [1, 8, 32, 300, 5000])
def test_cells_lose_no_nearest_entry(cell):
    r = np.random.default_rng(cell)
    book, points = r.integers(-400, 400, (60, 5)), r.integers(-500, 500, (700, 5))
    book[30:40], points[:60], points[600:] = book[:10], book, points[:100]
    find = grid_codes.Finder(book, cell, limit=50)
    want = ((points[:, None] - book[None]) ** 2).sum(2)
    for lo in range(0, 700, 70):
        index, best = find(points[lo : lo + 70])
        assert (index == want[lo : lo + 70].argmin(1)).all() and (best == want[lo : lo + 70].min(1)).all()
    assert len(find.kept) <= 50


def test_cells_are_remembered_and_spare_comparisons():
    r = np.random.default_rng(2)
    book = r.integers(-400, 400, (256, 8))
    points = book[r.integers(0, 20, 5000)] + r.integers(0, 3, (5000, 8))
    find = grid_codes.Finder(book)
    for lo in range(0, 5000, 500):
        find(points[lo : lo + 500])
    assert find.made < find.met / 4 and find.compared < 20 * find.met


MARKED = "a <P> mark\nb"
TEXTS = [(1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n"), (5, "\n\n\n"), (6, "no line end"), (6, "no line end"), (6, "other\n"), (7, "é 😀\n" * 50), (8, MARKED), (9, "<S"), (10, "<P\n>x\n"), (None, "no id\nhere\n"), (11, "lorem ipsum\r\n\tdolor \n" * 30_000), (12, "x" * 200_000), (13, "a\x0bb\x0cc d\x85e\n")]


def middle_by_definition(doc_id, text, rate=100, suffix_first=50):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < suffix_first else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_equals_the_definition(spark):
    rows = spark.createDataFrame([(i, t, "x", 1, "f", "o") for i, t in TEXTS], "doc_id long, text string, lang string, n long, form string, output string").repartition(3)
    made = fill_middle.transform(rows)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((i, *middle_by_definition(i, t), t or "")) for i, t in TEXTS))
    assert sorted(repr(tuple(x)) for x in got) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(repr(tuple(x)) for x in fill_middle.digests(rows).collect()) == sorted(repr((i, *(w := middle_by_definition(i, t))[:4], sha(w[4]), sha(t or ""))) for i, t in TEXTS)
    assert fill_middle.digests(rows.limit(0)).collect() == []


def test_rates_and_orders(spark):
    rows = spark.createDataFrame([(k, f"a{k}\nb\nc\n") for k in range(300)], "doc_id long, text string")
    got = {x.doc_id: (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in fill_middle.transform(rows, rate=40, suffix_first=20).collect()}
    assert got == {k: middle_by_definition(k, f"a{k}\nb\nc\n", 40, 20) for k in range(300)}
    assert {x[1] for x in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("bits", "longest"), [(3, 1 << 16), (6, 40), (11, 1 << 16), (11, 5)])
def test_chunks_are_defined_by_content(bits, longest):
    r = random.Random(bits)
    passage = "".join(r.choice("abcdé \n") for _ in range(3000)).encode()
    for text in (b"", b"a", passage, b"z" * 500, passage[:700] + b"some other words\n" + passage[700:]):
        ends = fill_middle.chunk_ends(np.frombuffer(text, np.uint8), bits, longest)
        assert (np.diff(ends, prepend=0) > 0).all() and (np.diff(ends, prepend=0) <= longest).all() and (not len(text) or ends[-1] == len(text))
    if longest == 1 << 16:
        def pieces(t):
            ends = fill_middle.chunk_ends(np.frombuffer(t, np.uint8), bits, longest).tolist()
            return [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

        shared = set(pieces(passage)) & set(pieces(b"quite another beginning\n" + passage))
        assert sum(map(len, shared)) > 0.3 * len(passage) or bits == 11


def test_sums_over_chunks_equal_the_text(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(fill_middle, "CHUNK_BITS", 4)
    chunks = fill_middle.Chunks(limit=4000)  # let go again and again
    for _ in range(40):
        text = "".join(r.choice(["a", "b", "\n", "é", "😀", "ab cd\n"]) for _ in range(r.randint(0, 400)))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        layout = fill_middle.Layout(text.encode(), chunks)
        assert len(layout) == len(lines)
        for k in range(len(lines) + 1):
            before = "".join(lines[:k])
            assert layout.behind(k) == (len(before.encode()), len(before))
        assert chunks.used <= 4000 + 3000
    shared = fill_middle.Chunks()
    first = shared.summary(b"same\nbytes")
    assert shared.summary(bytes(bytearray(b"same\nbytes"))) is first and len(shared.kept) == 1
