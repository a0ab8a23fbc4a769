"""Per-user limits in fixed windows that start at a user's first request."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Limiter:
    """Windows of a minute and of a day; a request that the minute admits counts there even if the day refuses it."""

    def __init__(self, per_minute: int, per_day: int, state: tuple | None = None):
        self.rules = [(60.0, per_minute), (86400.0, per_day)]
        self.state = [list(s) for s in state] if state else [[None, 0], [None, 0]]

    def admit(self, now: float) -> bool:
        for (width, most), s in zip(self.rules, self.state):
            if s[0] is None or now - s[0] >= width:
                s[:] = [now, 1]
            elif s[1] >= most:
                return False
            else:
                s[1] += 1
        return True


def decisions(events: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """(user_id, event_id, admitted). Rows are sorted by user and time within tasks and run through as a stream, so no user's rows are held together."""
    own = events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("user_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    def run(parts: Iterable[pd.DataFrame]):
        user, limiter = None, None
        for p in parts:
            out = []
            for u, us in zip(p.user_id, p.us):
                if u != user:
                    user, limiter = u, Limiter(per_minute, per_day)
                out.append(limiter.admit(us / 1e6))
            yield p[["user_id", "event_id"]].assign(admitted=out)

    return own.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, "user_id string, event_id long, admitted boolean")
