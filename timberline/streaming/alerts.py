"""Alert rules on a stream, with the second from which each rule may fire again as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.functions import timing as M
from timberline.operators.alerts import AlertRule, alert_matches, fired_from
from timberline.streaming.partial import per_second

_OUT = "rule string, second timestamp, matches bigint"
_EARLIEST = -(2 ** 62)


def stream_alerts(reports: DataFrame, rules: list[AlertRule] | None = None) -> DataFrame:
    """(rule, second, matches): alerts that fire, with the number of matches in that second.

    Matches are added up per rule and second where they are read, so the state of a rule meets one row per task and second,
    however many matches there are; the seconds that fire are found by jumps, not one by one. Seconds that come in a later
    micro-batch than the alert they precede count from the rule's state on.
    """
    hits = per_second(alert_matches(reports, rules), ["rule", "cooldown_seconds"])
    seconds = hits.select("rule", F.col("cooldown_seconds").cast("bigint").alias("wait"),
                          F.floor(M.epoch_micros("first") / 1_000_000).cast("bigint").alias("at"), "n")

    def fire(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait, parts = 0, []
        for pdf in batches:
            wait = int(pdf["wait"].iloc[0])
            parts.append(pdf.groupby("at")["n"].sum())
        seen = pd.concat(parts).groupby(level=0).sum()  # by second, in order
        at = seen.index.to_numpy(np.int64)
        fired = fired_from(at, wait, state.get[0] if state.exists else _EARLIEST)
        if fired.any():
            state.update((int(at[fired][-1]) + max(wait, 1),))
        yield pd.DataFrame({"rule": key[0], "second": pd.to_datetime(at[fired], unit="s"), "matches": seen.to_numpy()[fired]})

    return seconds.groupBy("rule").applyInPandasWithState(
        fire, _OUT, "next_second long", "append", GroupStateTimeout.NoTimeout)
