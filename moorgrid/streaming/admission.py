"""Streaming admission by time to live: state per url is the time of the last admitted attempt."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moorgrid.operators.crawl import TTL


def admit_stream(attempts: DataFrame, ttl: float = TTL) -> DataFrame:
    """(url, ts) of admitted attempts of a stream (url, ts), in order of arrival batches."""
    ttl = max(1.0, float(ttl))

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        times = sorted({t for f in frames for t in f["ts"].dropna()})
        taken = []
        for t in times:
            if last is None or t - last >= ttl:
                taken.append(t)
                last = t
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame({"url": [key[0]] * len(taken), "ts": taken})

    return attempts.where("url IS NOT NULL").groupBy("url").applyInPandasWithState(step, "url STRING, ts DOUBLE", "last DOUBLE", "append", GroupStateTimeout.NoTimeout)
