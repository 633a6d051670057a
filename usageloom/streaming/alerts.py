"""Threshold alerts on a stream of samples, with the state that exact toggling needs; and each key's bounded history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from usageloom.operators.series import HISTORY, USED_UP

ALERTS = "window_id string, seq long, alert string"
STATE = "previous double, fired array<int>, depleted boolean, history array<double>"


def alerts(samples: DataFrame, thresholds: list[int], enabled: str = "enabled") -> DataFrame:
    """Rows (window_id, seq, alert) of a stream (window_id, seq, utilization, enabled): threshold numbers, `depleted`, `restored`.

    A sample while alerts are off changes no alert state. Each window's last HISTORY utilizations are kept along. Of a
    micro-batch a window's samples are held as numbers, 17 bytes each, as they must be put in order; how many there are is
    bounded at the source (maxBytesPerTrigger).
    """
    marks = sorted(t for t in set(thresholds) if 1 <= t <= 100)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, fired, depleted, history = state.get if state.exists else (None, [], False, [])
        fired, history, out = set(fired), list(history), []
        kinds = {"seq": np.int64, "utilization": float, enabled: bool}
        parts = [[b[c].to_numpy(kind) for c, kind in kinds.items()] for b in batches]
        seqs, uses, ons = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(seqs, kind="stable")
        for seq, used, on in ((int(seqs[i]), float(uses[i]), bool(ons[i])) for i in order):
            history = [*history, used][-HISTORY:]
            if not on:
                continue
            left = 100 - used
            due = [t for t in marks if left <= t and t not in fired and (previous is None or previous > t)]
            if due:
                out.append((key[0], seq, str(due[0])))
                fired |= {t for t in marks if t >= due[0]}
            fired = {t for t in fired if left <= t}
            if (left <= USED_UP) != depleted:
                depleted = not depleted
                out.append((key[0], seq, "depleted" if depleted else "restored"))
            previous = left
        state.update((previous, sorted(fired), depleted, history))
        yield pd.DataFrame(out, columns=["window_id", "seq", "alert"])

    return samples.groupBy("window_id").applyInPandasWithState(step, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)
