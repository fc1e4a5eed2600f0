"""The sliding-window rate limiter, over a table and over a stream.

Accepted requests count; refused ones leave no mark. An entry exactly ``window`` seconds
old is out. The total of all keys is checked first, then the key's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PER_KEY, TOTAL, WINDOW = 30, 90, 60.0


def accepted(times: Column, most: int, window: float = WINDOW) -> Column:
    """For ordered ``times`` (seconds) of one key: struct(t, retry) each; retry is null where
    the request is accepted. The fold keeps only the last ``most`` accepted times."""

    def step(state: Column, t: Column) -> Column:
        live = F.filter(state["live"], lambda x: x > t - window)
        full = F.size(live) >= most
        retry = F.when(full, F.lit(window) - (t - F.get(live, 0)))
        return F.struct(F.when(full, live).otherwise(F.concat(live, F.array(t))).alias("live"), F.concat(state["out"], F.array(F.struct(t.alias("t"), retry.alias("retry")))).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("live"), F.array().cast("array<struct<t:double,retry:double>>").alias("out"))
    return F.aggregate(times, start, step, lambda s: s["out"])


def limit_by_key(requests: DataFrame, key: str, time: Column, order: str, *, most: int = PER_KEY, window: float = WINDOW) -> DataFrame:
    """``key``, ``order`` and ``retry_after`` (null: accepted) by each key's own limit."""
    grouped = requests.select(key, order, time.cast("double").alias("t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", order))).alias("r"))
    out = accepted(F.transform("r", lambda x: x["t"]), most, window)
    both = grouped.select(key, F.explode(F.zip_with("r", out, lambda a, b: F.struct(a[order].alias(order), b["retry"].alias("retry_after")))).alias("x"))
    return both.select(key, f"x.{order}", "x.retry_after")


def limit_all(requests: DataFrame, key: str, time: Column, order: str, *, per_key: int = PER_KEY, total: int = TOTAL, window: float = WINDOW) -> DataFrame:
    """Both limits in the order of time. The total ties all keys together, so this is one
    sequence: it streams through one task, which holds the last ``total`` times and no more."""
    rows = requests.select(F.col(key).alias("k"), F.col(order).alias("o"), time.cast("double").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        marks: deque[tuple[float, object]] = deque()
        for b in batches:
            out = []
            for k, o, t in b.itertuples(index=False, name=None):
                while marks and marks[0][0] <= t - window:
                    marks.popleft()
                own = [m for m, who in marks if who == k]
                if len(marks) >= total:
                    out.append((k, o, window - (t - marks[0][0])))
                elif len(own) >= per_key:
                    out.append((k, o, window - (t - own[0])))
                else:
                    marks.append((t, k))
                    out.append((k, o, None))
            yield pd.DataFrame(out, columns=[key, order, "retry_after"])

    types = dict(requests.dtypes)
    return rows.repartition(1).sortWithinPartitions("t", "o").mapInPandas(run, f"{key} {types[key]}, {order} {types[order]}, retry_after double")


class Limiter(StatefulProcessor):
    """One key's limit in a stream: its accepted times are list state."""

    def __init__(self, key: str, most: int, window: float) -> None:
        self.key, self.most, self.window = key, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getListState("marks", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = [float(m[0]) for m in self.marks.get()] if self.marks.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["t", "o"])
        out = []
        for o, t in zip(pdf["o"], pdf["t"], strict=True):
            live = [m for m in live if m > t - self.window]
            if len(live) >= self.most:
                out.append((key[0], o, self.window - (t - live[0])))
            else:
                live.append(float(t))
                out.append((key[0], o, None))
        if live:
            self.marks.put([(m,) for m in live])
        else:
            self.marks.clear()
        yield pd.DataFrame(out, columns=[self.key, "o", "retry_after"])

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, key: str, time: Column, order: str, *, most: int = PER_KEY, window: float = WINDOW) -> DataFrame:
    """``limit_by_key`` over a stream (needs the RocksDB state store)."""
    rows = requests.select(F.col(key), F.col(order).alias("o"), time.cast("double").alias("t"))
    types = dict(requests.dtypes)
    out = rows.groupBy(key).transformWithStateInPandas(Limiter(key, most, window), f"{key} {types[key]}, o {types[order]}, retry_after double", "Append", "None")
    return out.withColumnRenamed("o", order)
