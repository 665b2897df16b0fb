"""Rows of Parquet files found by key without a scan: an index of row groups, and reads of those alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.growing import _file_system

INDEX = "file string, row_group int, first_row bigint, n_rows bigint, low string, high string"


def row_group_index(files: DataFrame, key: str) -> DataFrame:
    """(file, row_group, first_row, n_rows, low, high) of files (file), from their footers: tasks read no data.

    low and high are the bounds of a text or whole-number key as text; null where the footer has none. Keep it as a table beside the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file in b["file"]:
                system, inner = _file_system(file)
                with system.open_input_file(inner) as f:
                    meta = pq.ParquetFile(f).metadata
                at = meta.schema.names.index(key)
                first = 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    s = group.column(at).statistics
                    known = s is not None and s.has_min_max
                    rows.append((file, g, first, group.num_rows, str(s.min) if known else None, str(s.max) if known else None))
                    first += group.num_rows
            yield pd.DataFrame(rows, columns=["file", "row_group", "first_row", "n_rows", "low", "high"]).astype({"row_group": "int32"})

    return files.select("file").mapInPandas(run, INDEX)


def rows_of_keys(index: DataFrame, keys: DataFrame, key: str, schema: str, whole: bool = False) -> DataFrame:
    """Rows of the wanted keys (key), with their file and place: only row groups whose bounds may hold one are
    opened, and of those only the columns of `schema`. whole: the key is a whole number, not text. A
    row group without bounds is read; keys that are nowhere give no rows; a key wanted twice counts once."""
    kind = "bigint" if whole else "string"
    names = [f.strip().split()[0] for f in schema.split(",")]
    wanted = keys.select(F.col(key).cast(kind).alias("k")).where("k IS NOT NULL").distinct()
    bound = lambda c: F.col(c).cast(kind)
    hits = index.join(wanted, (bound("low").isNull() | (bound("low") <= F.col("k"))) & (bound("high").isNull() | (bound("high") >= F.col("k"))))
    parts = hits.groupBy("file", "row_group", "first_row").agg(F.collect_set("k").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.to_pylist():
                system, inner = _file_system(part["file"])
                with system.open_input_file(inner) as f:
                    got = pq.ParquetFile(f).read_row_group(part["row_group"], columns=names)
                column = got.column(key)
                fits = pa.compute.is_in(column, value_set=pa.array(part["keys"], column.type))
                place = pa.compute.indices_nonzero(fits)
                rows = got.take(place)
                rows = rows.append_column("file", pa.array([part["file"]] * rows.num_rows, pa.string()))
                rows = rows.append_column("row", pa.compute.add(place.cast(pa.int64()), part["first_row"]))
                yield from rows.combine_chunks().to_batches()

    return parts.mapInArrow(run, f"{schema}, file string, row bigint")


def row_at(spark: SparkSession, index: DataFrame, file: str, row: int, schema: str) -> pd.DataFrame:
    """One row of a file by its place, from the one row group that holds it. A place below 0 or behind the end is an error."""
    part = index.where((F.col("file") == file) & (F.col("first_row") <= row) & (F.col("first_row") + F.col("n_rows") > row)).first()
    if row < 0 or part is None:
        raise IndexError(f"{file} has no row {row}")
    names = [f.strip().split()[0] for f in schema.split(",")]
    system, inner = _file_system(file)
    with system.open_input_file(inner) as f:
        return pq.ParquetFile(f).read_row_group(part.row_group, columns=names).slice(row - part.first_row, 1).to_pandas()
