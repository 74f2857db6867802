"""Sustained pressure on a stream: state is the time since when a run has been above the limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "run string, at double, value double, fired boolean"


def sustained_stream(samples: DataFrame, limit: float, seconds: float) -> DataFrame:
    """samples (run string, at double, value double) -> with ``fired``, as ``operators.monitors.sustained`` for samples in order.

    A micro-batch's samples of a run are taken by time; samples earlier than those of batches before are taken as they come."""

    def update(key, frames, state: GroupState):
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        fired = []
        for at, value in zip(rows["at"], rows["value"], strict=True):
            if value is not None and value > limit:
                fired.append(since is not None and at - since >= seconds)
                since = at if since is None else since
            else:
                fired.append(False)
                since = None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
        yield pd.DataFrame({"run": key[0], "at": rows["at"], "value": rows["value"], "fired": fired})

    return samples.groupBy("run").applyInPandasWithState(update, OUTPUT, "since double", "append", GroupStateTimeout.NoTimeout)
