"""Small made-up event tables, one key and one time of which hold much of the rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

START = datetime(2024, 1, 1)
EVENT_SCHEMA = "id bigint, user bigint, ts timestamp_ntz, value double"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def events(seed: int, rows: int, span: int = 3600, null_share: float = 0.03) -> list[tuple]:
    """Rows of (id, user, ts, value). Of each three rows, one is user 0's."""
    rng = random.Random(seed)
    made = []
    for i in range(rows):
        user = 0 if rng.random() < 1 / 3 else rng.randrange(1, 8)
        ts = at(span // 2) if rng.random() < 1 / 3 else at(rng.randrange(span))
        value = round(rng.uniform(-50, 50), 2)
        user = None if rng.random() < null_share else user
        ts = None if rng.random() < null_share else ts
        made.append((i, user, ts, value))
    return made


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def sorted_rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))
