"""Sinks: Parquet, tables, Arrow, grids for a sheet, and batches for a caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def to_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def to_table(df: DataFrame, name: str, mode: str = "overwrite", buckets: int | None = None, by: list[str] | None = None) -> None:
    """Save as a table; with buckets, later joins on the bucket columns need no shuffle."""
    writer = df.write.mode(mode)
    (writer.bucketBy(buckets, *by).sortBy(*by) if buckets else writer).saveAsTable(name)


def to_arrow_bytes(df: DataFrame) -> bytes:
    """The Arrow stream of a table that fits the driver."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    table = df.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def to_cells(df: DataFrame, anchor: tuple[int, int] = (0, 0), most_rows: int = 1_048_575) -> dict[tuple[int, int], object]:
    """Header and rows as cells from an anchor (row, column); refuses what does not fit a sheet."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("the table has more rows than a sheet")
    top, left = anchor
    cells = {(top, left + k): n for k, n in enumerate(df.columns)}
    return cells | {(top + 1 + r, left + k): v for r, row in enumerate(rows) for k, v in enumerate(row)}


def in_batches(df: DataFrame, on_batch: Callable[[list[list]], None], batch_size: int = 1024, header: bool = True) -> int:
    """Hand rows to a caller in batches, one partition at a time at the driver; returns the number of rows."""
    batch: list[list] = [list(df.columns)] if header else []
    total = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(list(row))
        total += 1
        if len(batch) >= batch_size:
            on_batch(batch)
            batch = []
    if batch:
        on_batch(batch)
    return total
