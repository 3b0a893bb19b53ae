"""Decayed counts over a stream of changes: an extension, as the analyses themselves are batch.

0.5 ^ (age / half-life) can be carried forward: a weight and its time are enough, so the state of a key
is two numbers, however many changes it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodework.operators.churn import HALF_LIFE_DAYS


def decayed_stream(changes: DataFrame, key: str, seconds: str, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(key, weight, at): the weight of each key that a batch touches, as of its latest change. Changes that come late count with their true age."""
    kind = dict(changes.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, at = state.get if state.exists else (0.0, None)
        for f in frames:
            last = int(f[seconds].max())
            now = last if at is None else max(at, last)
            if at is not None:
                weight *= 0.5 ** ((now - at) / 86400 / half_life_days)
            weight += float((0.5 ** ((now - f[seconds]) / 86400 / half_life_days)).sum())
            at = now
        state.update((weight, at))
        yield pd.DataFrame({key: [k[0]], "weight": [weight], "at": [at]})

    return changes.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, weight double, at long", "weight double, at long", "update", GroupStateTimeout.NoTimeout)
