"""Models are loaded once a worker, let go when unused, and the default one is what it says."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import models as M


def noted(path):
    """A function that loads a model of a class that travels with it."""

    class Noted:
        """Notes when it is loaded and closed, and by which process."""

        def __init__(self, path):
            self.path = path
            self.note("load")

        def note(self, what):
            with open(self.path, "a") as f:
                f.write(f"{what} {os.getpid()}\n")

        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

        def predict(self, pairs):
            assert len(pairs) <= 16
            return [len(q) - len(p) for q, p in pairs]

        def close(self):
            self.note("close")

    return lambda: Noted(path)


def notes(path):
    with open(path) as f:
        return [tuple(x.split()) for x in f.read().splitlines()]


@pytest.mark.parametrize("keep", [True, False])
def test_a_worker_loads_a_model_once(spark, tmp_path, keep):
    path = str(tmp_path / "notes")
    embed = M.embedder(noted(path), f"noted {path}", keep)
    for _ in range(2):
        rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("t"), "id").select("id", embed(F.col("t")).alias("v")).collect()
        assert all(r.v == (None if r.id % 10 == 0 else [r.id % 7, 1.0]) for r in rows) and len(rows) == 4000
    found = notes(path)
    loads = Counter(pid for what, pid in found if what == "load")
    if keep:
        assert set(loads.values()) == {1} and len(found) == len(loads)
    else:
        # Sixteen tasks loaded it, and each let it go.
        assert sum(loads.values()) == 16 and Counter(pid for what, pid in found if what == "close") == loads


def test_users_are_counted():
    models, made = M.Models(), []

    class Model:
        def __init__(self):
            made.append(self)
            self.closed = False

        def close(self):
            self.closed = True

    with models.held("a", Model, keep=False) as one:
        with models.held("a", Model, keep=False) as two:
            assert one is two
        assert not one.closed and models.loaded["a"][1] == 1
        with pytest.raises(KeyError), models.held("b", Model, keep=False):
            raise KeyError
        assert "b" not in models.loaded and made[1].closed
    assert one.closed and not models.loaded
    with models.held("a", Model) as kept:
        pass
    with models.held("a", Model) as again:
        assert again is kept is not one and len(made) == 3


def test_scorer_batches_pairs(spark, tmp_path):
    path = str(tmp_path / "notes")
    score = M.scorer(noted(path), f"scores {path}")
    rows = spark.range(50).select("id", score(F.repeat(F.lit("q"), F.col("id").cast("int")), F.when(F.col("id") > 3, "ppp")).alias("s")).collect()
    assert all(r.s == r.id - (3 if r.id > 3 else 0) for r in rows)


def test_hashing_model_by_definition():
    def by_definition(text, dims):
        v = [0.0] * dims
        for t in M.tokens(text):
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:8], 16) % dims] += 1 if h[8] in "01234567" else -1
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm if norm else 0.0 for x in v]

    texts = ["Load the load_graph file", "", "é !", "a b a b a"]
    assert M.tokens(texts[0]) == ["load", "the", "load_graph", "file", "load", "graph"]
    assert np.allclose(M.HashingModel(16).encode(texts), [by_definition(t, 16) for t in texts])
