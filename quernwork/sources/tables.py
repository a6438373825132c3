"""The parquet tables of one data folder, as batches or as streams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quernwork.sources.schemas import SCHEMAS


@dataclass(frozen=True)
class Tables:
    """Tables kept as ``<root>/<name>.parquet``, each a file or a folder of files."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.parquet"

    def read(self, name: str, *columns: str) -> DataFrame:
        """The whole table, or only ``columns`` of it; the scan reads no others."""
        reader = self.spark.read
        if name in SCHEMAS:
            _require_columns(self.spark, self.path(name), SCHEMAS[name])
            reader = reader.schema(SCHEMAS[name])
        df = reader.parquet(self.path(name))
        return df.select(*columns) if columns else df

    def stream(self, name: str, max_files: int | None = None) -> DataFrame:
        """The table as a stream of its files.

        Without ``max_files`` one trigger takes every file there is. File order
        is not event order, so splitting a backlog over several triggers can
        make old rows late; set it only for files that arrive in event order.
        """
        reader = self.spark.readStream.schema(SCHEMAS[name])
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        _require_columns(self.spark, self.path(name), SCHEMAS[name])
        # A file stream takes a single file only as a glob, and a folder so as well.
        return reader.parquet(f"{self.root.rstrip('/')}/{{{name}.parquet}}")


@cache
def _require_columns(spark: SparkSession, path: str, schema: str) -> None:
    """Fail if files lack a column that is named; a reader would make it all nulls."""
    missing = set(StructType.fromDDL(schema).names) - set(spark.read.parquet(path).columns)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
