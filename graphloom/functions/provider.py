"""Sentences about functions from a text-generation service, a request for each body.

The service takes {"model", "prompt", "stream": false, "options"} by POST and answers {"response": text}. A task has a few
requests under way at a time; one that fails, stalls beyond its time or answers no JSON is tried again after a pause, and
is given up as null, which leaves the function without a docstring until the next sync. ``sync.with_generated_docs`` asks
for each body once, whatever the number of its copies, and stores what was said before anything else reads it.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TIMEOUT_S, TRIES, UNDER_WAY, PAUSE_S = 20.0, 3, 4, 0.5


def prompt(name: str, code: str) -> str:
    return f"Say in one sentence of 12 to 25 words what the Python function {name} is for. Answer with that sentence alone, in plain words.\n\n{code}\n"


def asked(url: str, body: dict, timeout_s: float = TIMEOUT_S, tries: int = TRIES, pause_s: float = PAUSE_S) -> str | None:
    """What the service says, or None."""
    data = json.dumps(body).encode()
    for k in range(tries):
        if k:
            time.sleep(pause_s * 2 ** (k - 1))
        try:
            request = urllib.request.Request(url, data, {"Content-Type": "application/json"}, method="POST")
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                said = json.loads(answer.read().decode("utf-8", errors="replace")).get("response")
            return str(said) if said else None
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code != 429:  # asking again will not help
                return None
        except (OSError, ValueError, AttributeError):
            pass
    return None


def http_provider(url: str, model: str, timeout_s: float = TIMEOUT_S, tries: int = TRIES, under_way: int = UNDER_WAY, pause_s: float = PAUSE_S) -> Callable[[Column, Column], Column]:
    """A column function (name, source) -> what the service at url says of the function."""

    @F.pandas_udf("string")
    def said(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(under_way) as pool:
            for names, codes in batches:
                ask = lambda pair: asked(url, {"model": model, "prompt": prompt(*pair), "stream": False, "options": {"temperature": 0.1}}, timeout_s, tries, pause_s) if all(x and x.strip() for x in pair) else None
                yield pd.Series(list(pool.map(ask, zip(names, codes, strict=True))), dtype="object")

    return said
