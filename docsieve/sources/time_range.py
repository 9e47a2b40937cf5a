"""A data source that reads a folder of parquet files by slices of time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "docsieve_time_range"
_TICK = timedelta(microseconds=1)


@dataclass
class Slice(InputPartition):
    """Rows with ``start <= time < end``."""

    start: datetime
    end: datetime


def slices(start: datetime, end: datetime, step: timedelta) -> list[Slice]:
    """Cuts at whole steps since 1970, so that runs over other ranges cut at the same times."""
    zero, out = datetime(1970, 1, 1), []
    at = start
    while at < end:
        upto = min(end, zero + ((at - zero) // step + 1) * step)
        out.append(Slice(at, upto))
        at = upto
    return out


def _moment(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


class _Folder:
    """The files below a path of any file system that Arrow knows, with the given columns."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.column = options["path"], options["timecolumn"]
        self.step = timedelta(seconds=float(options.get("sliceseconds", "86400")))
        self.start = _moment(options["start"]) if "start" in options else None
        self.end = _moment(options["end"]) if "end" in options else None
        self.names = schema.fieldNames()

    def dataset(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        plain = self.path.removeprefix("file:") if not self.path.startswith("file://") else self.path
        system, path = fs.FileSystem.from_uri(plain if "://" in plain else f"file://{plain}")
        return ds.dataset(path, filesystem=system, format="parquet")

    def bounds(self) -> tuple[datetime, datetime] | None:
        """The first time and the one after the last, from the files' statistics where they have them, within the asked range."""
        import pyarrow.compute as pc

        low = high = None
        data = self.dataset()
        for piece in data.get_fragments():
            at = piece.metadata.schema.names.index(self.column)
            for group in range(piece.metadata.num_row_groups):
                stats = piece.metadata.row_group(group).column(at).statistics
                if stats is not None and stats.has_min_max:
                    pair = stats.min, stats.max
                else:
                    got = pc.min_max(piece.subset(row_group_ids=[group]).to_table(columns=[self.column]).column(0)).as_py()
                    pair = got["min"], got["max"]
                if pair[0] is None:
                    continue
                pair = tuple(x.astimezone(UTC).replace(tzinfo=None) if x.tzinfo else x for x in pair)
                low = pair[0] if low is None else min(low, pair[0])
                high = pair[1] if high is None else max(high, pair[1])
        if low is None:
            return None
        start, end = low if self.start is None else max(low, self.start), high + _TICK if self.end is None else min(high + _TICK, self.end)
        return (start, end) if start < end else None

    def rows(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """Row groups outside the slice are not read; rows without a time belong to none."""
        import pyarrow.dataset as ds

        data = self.dataset()
        kind = data.schema.field(self.column).type
        zone = UTC if getattr(kind, "tz", None) else None
        low, high = (pa.scalar(x.replace(tzinfo=zone), kind) for x in (part.start, part.end))
        yield from data.to_batches(columns=self.names, filter=(ds.field(self.column) >= low) & (ds.field(self.column) < high))


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Slice]:
        found = self.folder.bounds()
        return slices(*found, self.folder.step) if found else [Slice(datetime(1970, 1, 1), datetime(1970, 1, 1))]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a micro-batch holds what lies between two of them. Rows that come late, before the last offset, are not read."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": (self.folder.start or datetime(1970, 1, 1)).isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.folder.bounds()
        return {"at": found[1].isoformat()} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high = _moment(start["at"]), _moment(end["at"])
        found = self.folder.bounds()
        # Nothing lies before the first row: an early start makes no empty slices.
        low = max(low, found[0]) if found else low
        return slices(low, high, self.folder.step) or [Slice(high, high)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TimeRangeSource(DataSource):
    """Options: ``path``, ``timeColumn``, ``start`` and ``end`` (ISO times, optional), ``sliceSeconds``; the schema is the caller's."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Folder({k.lower(): v for k, v in self.options.items()}, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Folder({k.lower(): v for k, v in self.options.items()}, schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TimeRangeSource)
