"""A sorted URL index of many files: which files hold a range of keys, without opening the others.

A manifest next to the index has one row per file: size and time of change, rows, row groups, least and
greatest key. Tasks read it from the Parquet footers, once per file: a refresh opens the footers of new
and changed files only. A range scan takes the files whose interval overlaps the range and gives Spark
that list, so neither listing nor planning touches the rest; inside the files row groups are skipped by
the pushed filter. A row group without statistics gives a file no bounds, and such a file is always read.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators.policy import index_range
from postlake.rules.sites import INDEX_KEY_END, INDEX_KEY_START
from postlake.sources.files import listed, open_file, spread
from postlake.sources.versions import VersionedTables

KEY = "url_surtkey"
MANIFEST = "_files"
FILES = (
    "path string, size bigint, modified timestamp, rows bigint, row_groups bigint, least_key string, greatest_key string, key_column string"
)
_NAMES = [field.split()[0] for field in FILES.split(", ")]


def _bounds(metadata: pq.FileMetaData, key: str) -> tuple[str | None, str | None]:
    """Least and greatest key of a file by its row groups' statistics; none if one row group has no statistics."""
    low, high = [], []
    for g in range(metadata.num_row_groups):
        group = metadata.row_group(g)
        column = next((c for k in range(group.num_columns) if (c := group.column(k)).path_in_schema == key), None)
        if column is None or column.statistics is None:
            return None, None
        if column.statistics.has_min_max:
            low.append(column.statistics.min)
            high.append(column.statistics.max)
        elif column.statistics.null_count != group.num_rows:
            return None, None
    # A file with no key at all has an interval that no range overlaps.
    return (min(low), max(high)) if low else ("\U0010ffff", "")


def footers(files: DataFrame, key: str = KEY) -> DataFrame:
    """The manifest rows of listed files, read from their footers in tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                with open_file(r.path) as file:
                    metadata = pq.ParquetFile(file).metadata
                    rows.append((r.path, r.size, r.modified, metadata.num_rows, metadata.num_row_groups, *_bounds(metadata, key), key))
            yield pd.DataFrame(rows, columns=_NAMES)

    return spread(files).mapInPandas(read, FILES)


def manifest(spark: SparkSession, index: str) -> VersionedTables:
    """The manifest's versions, in a folder of the index that Spark's readers pass over."""
    return VersionedTables(spark, f"{index.rstrip('/')}/{MANIFEST}")


def refresh_manifest(spark: SparkSession, index: str, key: str = KEY) -> dict[str, int]:
    """Bring the manifest up to the files that are there; says how many files it has, and of how many footers were read."""
    store = manifest(spark, index)
    base, started = store.current(), datetime.now(timezone.utc)
    here = listed(spark, index, "*.parquet")
    if base.number:
        same = ["path", "size", "modified"]
        known = store.read("files", base).filter(F.col("key_column") == key)
        kept, fresh = known.join(here, same, "left_semi"), here.join(known, same, "left_anti")
        rows = kept.unionByName(footers(fresh, key))
    else:
        kept, rows = None, footers(here, key)
    folder = store.new_folder()
    parts = store.write("files", rows, "key_column", folder)
    written = spark.read.schema(FILES).parquet(*[f"{store.root}/{f}" for f in parts.values()]) if parts else spark.createDataFrame([], FILES)
    count, old = written.count(), 0 if kept is None else kept.count()
    run = {"status": "SUCCEEDED", "mode": "manifest", "started_at": started.isoformat(), "records_seen": count, "records_created": count - old, "records_unchanged": old}
    store.commit(base, {"files": {**dict.fromkeys(base.parts.get("files", {})), **parts}}, {"files": rows.schema.jsonValue()}, run)
    return {"files": count, "footers_read": count - old}


def overlaps(start: str, end: str) -> Column:
    """Whether a manifest row's file may hold keys from start up to, not including, end."""
    unknown = F.col("least_key").isNull() | F.col("greatest_key").isNull()
    return unknown | ((F.col("greatest_key") >= start) & (F.col("least_key") < end))


def files_covering(spark: SparkSession, index: str, start: str = INDEX_KEY_START, end: str = INDEX_KEY_END, key: str = KEY) -> DataFrame:
    """The manifest rows of the files that a range scan reads."""
    return manifest(spark, index).read("files").filter((F.col("key_column") == key) & overlaps(start, end))


def read_index_range(
    spark: SparkSession, index: str, start: str = INDEX_KEY_START, end: str = INDEX_KEY_END, key: str = KEY, schema: str | None = None,
) -> DataFrame:
    """The index rows with keys from start up to, not including, end. No covering file is an error: the layout has changed."""
    paths = [r["path"] for r in files_covering(spark, index, start, end, key).select("path").collect()]  # what the scan would list itself
    if not paths:
        raise LookupError(f"no file of {index} covers keys from {start!r} to {end!r}")
    reader = spark.read.schema(schema) if schema else spark.read
    return index_range(reader.parquet(*paths), key, start, end)
