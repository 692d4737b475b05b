"""Structured Streaming forms of the event windows and of the stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """events with ts as a time stamp, and a watermark on it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value): late rows beyond the watermark don't count."""
    by = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    by = events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    by = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_sink(path: str, *, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is one folder named by its id, so that a batch run again replaces itself.

    Read the folders with read_upserted().
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter(F.col(key).isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def repetition_guard(units: DataFrame, *, key: str, unit: str, order: str, repeats: int = 4, least_chars: int = 20) -> DataFrame:
    """(key, unit, at): once a key, when the same unit of 20 characters or more has come `repeats` times in a row.

    State of a key: its last unit, how often it came, and whether it was told of.
    Rows of one batch are taken by their order column.
    """
    kinds = units.schema
    key_type, order_type = kinds[key].dataType.simpleString(), kinds[order].dataType.simpleString()

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, told = state.get if state.exists else ("", 0, False)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for value, at in zip(rows[unit], rows[order], strict=True):
            value = " ".join((value or "").lower().split())
            times = times + 1 if value == last else 1
            last = value
            if times >= repeats and len(value) >= least_chars and not told:
                told = True
                out.append((name[0], value, at))
        state.update((last, times, told))
        yield pd.DataFrame(out, columns=[key, unit, order])

    return units.groupBy(key).applyInPandasWithState(
        run, f"{key} {key_type}, {unit} string, {order} {order_type}", "last string, times long, told boolean", "append", GroupStateTimeout.NoTimeout
    )


def read_upserted(spark, path: str, *, key: str, at: str) -> DataFrame:
    """What an upsert_sink() holds: one row a key, newest values, first time."""
    from glossmill.operators.logs import upsert_first_seen

    return upsert_first_seen(spark.read.parquet(path).drop("batch"), key=key, at=at)
