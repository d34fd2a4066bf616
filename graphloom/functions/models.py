"""Models in pandas UDFs: loaded when a task first needs one, counted, and let go when nobody uses them.

An embedder is a column function text -> vector, a scorer (query, passage) -> number. Both are made from a function that
loads a model, which is called in Python workers, once for each as long as the model is kept; with keep = False it is
closed with the last task that uses it. Null texts have null vectors, and are not shown to the model.

``HashingModel`` is the default: the words of a text, and their parts between underscores, are counted in places that
their digest names, with a sign. It needs no files, and gives the same vectors everywhere.
"""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 256


class Models:
    """Loaded models of a process by key, with the number of their users."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.loaded: dict[str, list] = {}

    @contextmanager
    def held(self, key: str, load: Callable[[], Any], keep: bool = True) -> Iterator[Any]:
        with self.lock:
            if key not in self.loaded:
                self.loaded[key] = [load(), 0]
            entry = self.loaded[key]
            entry[1] += 1
        try:
            yield entry[0]
        finally:
            with self.lock:
                entry[1] -= 1
                if not entry[1] and not keep:
                    self.release(key)

    def release(self, key: str) -> None:
        """Forgets a model, and closes it if it can be closed."""
        model = self.loaded.pop(key)[0]
        getattr(model, "close", lambda: None)()


#: Of this process: a Python worker serves task after task.
MODELS = Models()


def _models() -> Models:
    """Those of the worker: functions travel without them."""
    return MODELS


class HashingModel:
    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            for token in tokens(text):
                digest = hashlib.md5(token.encode()).hexdigest()
                out[row, int(digest[:8], 16) % self.dims] += 1 if int(digest[8], 16) < 8 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def tokens(text: str) -> list[str]:
    """Words of ASCII letters, digits and underscores in lower case, and the parts of those with underscores."""
    words = re.findall("[a-z0-9_]+", text.lower())
    return words + [p for w in words if "_" in w for p in w.split("_") if p]


def embedder(load: Callable[[], Any] = HashingModel, key: str = "hashing", keep: bool = True) -> Callable[[Column], Column]:
    """A column function of texts; the model's encode(list of texts) gives a row of numbers for each."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with _models().held(key, load, keep) as model:
            for texts in batches:
                given = texts.notna().to_numpy()
                out = np.full(len(texts), None, object)
                own = texts[given].tolist()
                made = [v for k in range(0, len(own), BATCH) for v in np.asarray(model.encode(own[k : k + BATCH]), np.float32)]
                for k, v in zip(np.flatnonzero(given), made, strict=True):
                    out[k] = v
                yield pd.Series(out)

    return vectors


def scorer(load: Callable[[], Any], key: str, keep: bool = True, batch: int = 16) -> Callable[[Column, Column], Column]:
    """A column function of queries and passages; the model's predict(list of pairs) gives a number for each."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with _models().held(key, load, keep) as model:
            for queries, passages in batches:
                pairs = list(zip(queries.fillna("").tolist(), passages.fillna("").tolist(), strict=True))
                yield pd.Series([float(x) for k in range(0, len(pairs), batch) for x in model.predict(pairs[k : k + batch])], dtype="float64")

    return scores
