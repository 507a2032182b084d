"""A table read by a cursor, as a stream: the offset is the cursor (time, id), and the checkpoint keeps it.

Every poll takes the rows after the cursor up to an end that is fixed before they
are read, so a batch that is tried again reads the same rows and the next one starts
where it stopped. The end comes from the statistics of the table's Parquet files
alone; files that cannot hold a row of the range are not opened.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "millrace_polled"
# Tasks get these classes with the job, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class RowGroups(InputPartition):
    """Row groups of one file that may hold rows of a poll."""

    file: str
    groups: tuple[int, ...]
    start: tuple[int, int]
    end: tuple[int, int]


def _micros(value) -> int:
    return value if isinstance(value, int) else round((value.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


class PolledReader(DataSourceStreamReader):
    """``at`` follows the polls; after a restart Spark commits the last planned end, which sets it again."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.ts, self.tie = options["ts"], options["tie"]
        self.limit = int(options.get("limit", "0"))
        self.first = json.loads(options.get("start", "[]")) or [-(1 << 62), 0]
        self.at: dict | None = None

    # -- on the driver ------------------------------------------------------

    def initialOffset(self) -> dict:
        return {"ts": self.first[0], "id": self.first[1]}

    def _groups(self) -> list[tuple]:
        """(file, group, rows, least time, greatest time, greatest id) from file footers; no row is read."""
        files, base = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = []
        for info in files.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.type != pafs.FileType.File or not name.endswith(".parquet") or name.startswith(("_", ".")):
                continue
            meta = pq.ParquetFile(files.open_input_file(info.path)).metadata
            place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                ts, tie = (group.column(place[c]).statistics for c in (self.ts, self.tie))
                if ts is not None and ts.has_min_max and tie is not None and tie.has_min_max:
                    found.append((info.path, g, group.num_rows, _micros(ts.min), _micros(ts.max), tie.max))
        return found

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        start = (at["ts"], at["id"])
        after = sorted((g for g in self._groups() if (g[4], g[5]) > start), key=lambda g: (g[4], g[5]))
        if self.limit:
            rows = 0
            for n, group in enumerate(after):
                rows += group[2]
                if rows >= self.limit:
                    after = after[: n + 1]
                    break
        if after:
            newest = max(g[4] for g in after)
            end = max(start, (newest, max(g[5] for g in after if g[4] == newest)))
            self.at = {"ts": end[0], "id": end[1]}
        else:
            self.at = at
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["ts"], start["id"]), (end["ts"], end["id"])
        files: dict[str, list[int]] = {}
        for file, group, _, least, greatest, _ in self._groups():
            if greatest >= low[0] and least <= high[0]:
                files.setdefault(file, []).append(group)
        return [RowGroups(file, tuple(groups), low, high) for file, groups in sorted(files.items())]

    def commit(self, end: dict) -> None:
        if self.at is None:
            self.at = end

    # -- in the tasks -------------------------------------------------------

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        files = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        file = pq.ParquetFile(files.open_input_file(partition.file))
        for batch in file.iter_batches(10_000, row_groups=list(partition.groups), columns=self.schema.names):
            ts = batch.column(batch.schema.get_field_index(self.ts)).cast(pa.timestamp("us")).cast(pa.int64())
            tie = batch.column(batch.schema.get_field_index(self.tie)).cast(pa.int64())
            after = lambda c: pc.or_kleene(pc.greater(ts, c[0]), pc.and_kleene(pc.equal(ts, c[0]), pc.greater(tie, c[1])))
            inside = pc.and_kleene(after(partition.start), pc.invert(after(partition.end)))
            rows = batch.filter(pc.fill_null(inside, False))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) for f in target], schema=target)


class PolledSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["row_schema"]))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PolledReader(schema, self.options)


def polled_stream(
    spark: SparkSession, path: str, schema: T.StructType, ts_col: str, tie_col: str, limit: int | None = None,
    start: tuple[datetime, int] | None = None,
) -> DataFrame:
    """The rows of a growing Parquet table after ``start`` (default: all), ordered by polls.

    With ``availableNow`` a run is one poll, or the repetition of one that failed. A poll ends at the first file part that brings it to ``limit`` rows; rows of one time and
    id are never split. Rows that are added later at or before the cursor are not read, as with any
    cursor; rows without a time or id never are.
    """
    spark.dataSource.register(PolledSource)
    options = {"path": path, "ts": ts_col, "tie": tie_col, "row_schema": schema.json(), "limit": str(limit or 0)}
    if start:
        options["start"] = json.dumps([_micros(start[0]), start[1]])
    return spark.readStream.format(FORMAT).options(**options).load()
