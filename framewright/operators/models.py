"""The seam to models: recorded replies first, then batches through a function that is loaded once per worker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a model in Arrow batches; one row may give any number of rows. ``load`` runs once per Python worker and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def with_retries(call: Callable[[str], str], tries: int = 20, first_wait: float = 1.0, longest_wait: float = 60.0, sleep=time.sleep) -> Callable[[str], str | None]:
    """A call that is tried again after busy errors, waiting twice as long each time; None when all tries fail."""

    def run(prompt: str) -> str | None:
        wait = first_wait
        for n in range(tries):
            try:
                return call(prompt)
            except Exception as e:  # noqa: BLE001 - only busy errors are tried again
                if getattr(e, "status", 429) not in (429, 500, 502, 503, 504) or n == tries - 1:
                    return None
                sleep(min(longest_wait, getattr(e, "retry_after", None) or wait))
                wait *= 2
        return None

    return run


def memoised(requests: DataFrame, recorded: DataFrame, key: str, prompt: str, response: str, load: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """(key, response): recorded replies by key; only the missing keys, each once, go to the model."""
    known = recorded.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(response).alias(response))
    kind = requests.schema[key].dataType.simpleString()
    todo = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(prompt).alias(prompt)).join(known, key, "left_anti")

    def start():
        call = load()
        return lambda b: pd.DataFrame({key: b[key], response: [call(p) for p in b[prompt]]})

    fresh = apply_model(todo, start, f"`{key}` {kind}, `{response}` string")
    wanted = requests.select(key).where(F.col(key).isNotNull()).distinct()
    return known.join(wanted, key, "left_semi").unionByName(fresh)
