"""Early stopping as a stateful stream operator: one state for each group, losses in the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUTPUT = "key string, best double, counter int, stopped boolean"
STATE = "best double, counter int, stopped boolean"


def early_stopping_stream(losses: DataFrame, group: str, order: str, loss: str, patience: int = 7, delta: float = 0.0) -> DataFrame:
    """key, best, counter, stopped after each micro-batch, for the groups that it touched; within a batch rows go by ``order``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, counter, stopped = state.get if state.exists else (None, 0, False)
        for score in (-pd.concat(list(frames)).sort_values("ord")["loss"]).tolist():
            if best is not None and score < best + delta:
                counter += 1
                stopped = stopped or counter >= patience
            else:
                best, counter = score, 0
        state.update((best, counter, stopped))
        yield pd.DataFrame({"key": [str(key[0])], "best": [best], "counter": [counter], "stopped": [stopped]})

    rows = losses.selectExpr(f"`{group}` AS grp", f"`{order}` AS ord", f"CAST(`{loss}` AS DOUBLE) AS loss")
    return rows.groupBy("grp").applyInPandasWithState(step, OUTPUT, STATE, "update", "NoTimeout")
