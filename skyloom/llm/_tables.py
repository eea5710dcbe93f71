"""Intermediate tables in the folder that all machines share, with few rows at a time for Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyloom.sources import shared
from skyloom.sources.shared import shared_folder

__all__ = ["save", "shared_folder"]

#: Rows of megabytes are tested for the size of a row group one by one, and packed tighter.
_LARGE_ROWS = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "zstd"}


def save(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it.

    Python takes a thousand rows at a time, as rows hold packed arrays; ``rows`` is for large ones: so many at a time.
    """
    return shared.save(df, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows or 1000)}, **_LARGE_ROWS if rows else {})
