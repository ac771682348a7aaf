"""Model functions with pluggable backends; without one, small deterministic local ones.

Distinct inputs are inferred once and joined back, so repeated texts cost one call.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyflow.errors import ConfigError

GOOD = frozenset("good great excellent love happy best nice wonderful amazing fast".split())
BAD = frozenset("bad awful terrible hate sad worst poor horrible broken slow".split())


def sentiment(text: str, **_) -> float:
    """In [-1, 1]: balance of words of either lexicon."""
    words = re.findall(r"\w+", text.lower())
    good, bad = sum(w in GOOD for w in words), sum(w in BAD for w in words)
    return (good - bad) / (good + bad) if good + bad else 0.0


def embed(text: str, dim: int = 16, **_) -> list[float]:
    """Hashed words, normalised."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def classify(text: str, labels: list[str], **_) -> str:
    """The label whose hashed words are nearest; the first of equals."""
    v = embed(text)
    return max(labels, key=lambda x: sum(a * b for a, b in zip(v, embed(x), strict=True)))


BACKENDS: dict[str, tuple[Callable, str]] = {"classify": (classify, "string"), "sentiment": (sentiment, "double"), "embed": (embed, "array<float>")}
REMOTE = ("extract", "complete", "summarize", "translate", "gen")


def register(task: str, f: Callable, returns: str) -> None:
    """Set the backend of a task: a function of a text and options."""
    if task not in (*BACKENDS, *REMOTE):
        raise ConfigError(f"no model task: {task!r}")
    BACKENDS[task] = (f, returns)


def infer(df: DataFrame, task: str, column: str, name: str, **options) -> DataFrame:
    """``df`` with the task's result for a text column; null for null."""
    if task not in BACKENDS:
        raise ConfigError(f"the model task {task!r} needs a backend")
    f, returns = BACKENDS[task]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"_in": x["_in"], name: [f(t, **options) for t in x["_in"]]})

    known = df.select(F.col(column).alias("_in")).filter("_in IS NOT NULL").distinct().mapInPandas(run, f"_in string, {name} {returns}")
    return df.join(known, df[column] == known["_in"], "left").drop("_in")
