"""Models behind plain functions: each factory is called once in a task, so weights load once, not once a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Converters, chunk strategies, rankers and metrics by name; callers add their own.
REGISTRY: dict[str, dict[str, Callable]] = {"converter": {}, "strategy": {}, "ranker": {}, "metric": {}, "embedder": {}}


def register(kind: str, name: str, function: Callable) -> Callable:
    if name in REGISTRY[kind]:
        raise ValueError(f"{kind} {name} is registered")
    REGISTRY[kind][name] = function
    return function


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16):
    """A Column function text -> vector; ``make()`` gives a function of a list of texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])], index=part.index, dtype=object)

    return run


def pair_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16):
    """A Column function (query, passage) -> score."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for q, p in parts:
            pairs = list(zip(q.tolist(), p.tolist(), strict=True))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in score(pairs[i : i + batch])], index=q.index)

    return run


def generator(make: Callable[[], Callable[[str], str]]):
    """A Column function messages (JSON) -> the provider's JSON; null stays null, a call that fails gives null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()

        def one(m):
            if m is None:
                return None
            try:
                return call(m)
            except Exception:  # noqa: BLE001  a failed call is a failed generation
                return None

        for part in parts:
            yield part.map(one)

    return run
