"""Event-time windows over a stream, with a watermark.

In append mode a window comes out once, when the watermark passes its end. The
watermark is the latest event time seen less ``delay``; rows of windows already
out are late and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quernwork.functions.measures import Measure, columns, partials
from quernwork.functions.times import micros


def with_event_time(stream: DataFrame, time: str, delay: timedelta) -> DataFrame:
    """The stream with a watermark on ``time``.

    A watermark needs a timestamp with a zone; one without is read in the zone of
    the session, which ``event_session`` sets to UTC.
    """
    zoned = stream.withColumn(time, F.col(time).cast("timestamp"))
    return zoned.withWatermark(time, micros(delay))


def tumbling(
    stream: DataFrame,
    by: Sequence[str],
    time: str,
    width: timedelta,
    measures: Sequence[Measure],
) -> DataFrame:
    return _grouped(stream, by, F.window(time, micros(width)), "window", measures)


def sliding(
    stream: DataFrame,
    by: Sequence[str],
    time: str,
    width: timedelta,
    slide: timedelta,
    measures: Sequence[Measure],
) -> DataFrame:
    return _grouped(stream, by, F.window(time, micros(width), micros(slide)), "window", measures)


def sessions(
    stream: DataFrame,
    by: Sequence[str],
    time: str,
    gap: timedelta,
    measures: Sequence[Measure],
) -> DataFrame:
    """Measures per session of a key.

    ``event_session`` has each task join up its own sessions before the shuffle,
    so a busy key shuffles sessions and not events.
    """
    return _grouped(stream, by, F.session_window(time, micros(gap)), "session", measures)


def _grouped(
    stream: DataFrame,
    by: Sequence[str],
    window: Column,
    name: str,
    measures: Sequence[Measure],
) -> DataFrame:
    return (
        stream.groupBy(*by, window.alias(name))
        .agg(*partials(measures))
        .select(
            *by,
            F.col(f"{name}.start").cast("timestamp_ntz").alias(f"{name}_start"),
            F.col(f"{name}.end").cast("timestamp_ntz").alias(f"{name}_end"),
            *columns(measures),
        )
    )


def still_open(
    spark: SparkSession, checkpoint: str, by: Sequence[str], name: str, measures: Sequence[Measure]
) -> DataFrame:
    """The windows that a stream holds in its state, as far as they have come.

    For a finite input whose stream has ended: with the windows that came out they are
    all there are. ``name`` is ``window`` or ``session``. Spark keeps the key and the
    sums of a window in its state, in the order in which they were asked for.
    """
    state = spark.read.format("statestore").load(checkpoint)
    # The sums have no names of their own, so fields are taken by their places.
    key, value = (_by_place(state, c) for c in ("key", "value"))
    fields = value if name == "session" else [*key, *value]
    *keys, window = fields[: len(by) + 1]
    return state.select(
        *[k.alias(b) for k, b in zip(keys, by)],
        window["start"].cast("timestamp_ntz").alias(f"{name}_start"),
        window["end"].cast("timestamp_ntz").alias(f"{name}_end"),
        *[f.alias(c) for f, c in zip(fields[len(by) + 1 :], columns(measures), strict=True)],
    )


def _by_place(df: DataFrame, struct: str) -> list[Column]:
    kinds = [f.dataType for f in df.schema[struct].dataType]
    named = StructType([StructField(f"f{i}", kind) for i, kind in enumerate(kinds)])
    return [F.col(struct).cast(named)[f"f{i}"] for i in range(len(kinds))]
