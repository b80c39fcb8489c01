"""Archive files listed and read by byte ranges: a ZIP's tail and central directory, a RAR's headers, the one entry wanted."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from ..operators.payload import ENTRY, Extractor, first_srt, listed, taken
from ..profile import DEFAULT, SiteProfile
from ..session import materialize

#: What is known of an archive and of each entry. ``lower_name`` is there for filters, which reach the reader as they are.
LISTING = f"archive_id string, length long, n_entries int, bytes_read long, {ENTRY}, header_offset long, lower_name string, problem string"
_COLUMNS = [c.split()[0] for c in LISTING.split(", ")]
_TAKEN = pa.schema([("archive_id", pa.string()), ("name", pa.string()), ("data", pa.binary()), ("problem", pa.string()), ("bytes_read", pa.int64())])
#: Bytes that a read takes at least, from where it was asked on: headers and names come in one.
AHEAD = 1024


class Ranged:
    """A file that is sliced like bytes and read only where it is sliced."""

    def __init__(self, file, size: int, ahead: int = AHEAD) -> None:
        self.file, self.size, self.ahead, self.read_bytes = file, size, ahead, 0
        self.start, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice | int) -> bytes | int:
        if not isinstance(at, slice):
            return self[at : at + 1][0] if 0 <= at < self.size else b""[0]
        first, last, _ = at.indices(self.size)
        if first >= last:
            return b""
        if not self.start <= first or last > self.start + len(self.held):
            self.file.seek(first)
            self.start, self.held = first, self.file.read(min(max(last - first, self.ahead), self.size - first))
            self.read_bytes += len(self.held)
        return self.held[first - self.start : last - self.start]

    def __bytes__(self) -> bytes:
        return self[:]


class _Tested(NamedTuple):
    """A filter in terms that a reader can test by itself; a value that is null fails each, as in SQL."""

    column: str
    kind: str
    value: object

    def holds(self, row: dict) -> bool:
        x, v = row[self.column], self.value
        if self.kind == "null" or x is None:
            return self.kind == "null" and x is None
        match self.kind:
            case "not null":
                return True
            case "eq":
                return x == v
            case "in":
                return x in v
            case "starts":
                return x.startswith(v)
            case "ends":
                return x.endswith(v)
            case "lt":
                return x < v
            case "le":
                return x <= v
            case "gt":
                return x > v
        return x >= v


_KINDS = {IsNull: "null", IsNotNull: "not null", EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}
#: Filters on these keep a file shut; the others are tested on its rows.
_OF_FILES = ("archive_id", "length")


@dataclass
class Files(InputPartition):
    """Some files of about equal number: uri, size."""

    files: list[tuple[str, int]]


class ArchiveSource(DataSource):
    """``spark.read.format("archives").load(folder)``: a row for each entry of each archive below the folder.

    Options: ``pattern`` of file names (``*``), ``max_bytes`` and ``max_entries`` as a SiteProfile has them,
    ``files_per_partition``. Larger files aren't opened and give no rows. A file that is no archive, is broken or has too
    many entries gives one row with a ``problem`` and no entry. Nothing but headers is read: ``bytes_read`` says how much.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.pattern = o["path"], o.get("pattern", "*")
        self.max_bytes = int(o.get("max_bytes", DEFAULT.max_archive_bytes))
        self.max_entries = int(o.get("max_entries", DEFAULT.max_entries))
        self.per_partition = int(o.get("files_per_partition", 256))
        self.of_files: list[_Tested] = []
        self.of_rows: list[_Tested] = []

    def pushFilters(self, filters: list[Filter]):
        """Take the filters that the reader can test, on files before they are opened; give back the others."""
        for f in filters:
            kind = _KINDS.get(type(f))
            column = f.attribute[0] if kind and len(f.attribute) == 1 else None
            if column in _OF_FILES:
                self.of_files.append(_Tested(column, kind, getattr(f, "value", None)))
            elif column in _COLUMNS:
                self.of_rows.append(_Tested(column, kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files of the folder, found once on the driver as Spark's own file sources do; the largest are dealt out first."""
        fs, path = pafs.FileSystem.from_uri(self.path)
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else self.path.split("://")[0] + "://"
        found = [
            (scheme + f.path, f.size)
            for f in fs.get_file_info(pafs.FileSelector(path, recursive=True))
            if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", "."))
        ]
        kept = [f for f in found if f[1] <= self.max_bytes and all(t.holds({"archive_id": f[0], "length": f[1]}) for t in self.of_files)]
        kept.sort(key=lambda f: (-f[1], f[0]))
        n = -(-len(kept) // self.per_partition)
        return [Files(kept[i::n]) for i in range(n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri, size in partition.files:
            with _open(uri) as file:
                data = Ranged(file, size)
                entries, problem = listed(data, self.max_entries + 1, ranged=True)
            none = dict.fromkeys(_COLUMNS) | {"archive_id": uri, "length": size, "bytes_read": data.read_bytes}
            if entries is None and problem is None:
                problem = "Unsupported archive format"
            if entries is not None and len(entries) > self.max_entries:
                problem = "Archive contains too many entries"
            rows = [none | {"problem": problem}] if problem else [none | e | {"n_entries": len(entries), "lower_name": e["name"].lower()} for e in entries]
            for row in rows:
                if all(t.holds(row) for t in self.of_rows):
                    yield tuple(row[c] for c in _COLUMNS)


def list_archives(spark: SparkSession, path: str, profile: SiteProfile = DEFAULT, **options: object) -> DataFrame:
    """The entries of all archives below ``path``, see ``ArchiveSource``; filters on the result reach the reader."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("archives").option("max_bytes", profile.max_archive_bytes).option("max_entries", profile.max_entries)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def read_entries(picks: DataFrame, profile: SiteProfile = DEFAULT, rar_extractor: Extractor | None = None) -> DataFrame:
    """Rows of ``list_archives`` -> ``archive_id, name, data, problem, bytes_read``: of each archive only the entry's bytes are read."""
    fields = [c.split()[0] for c in ENTRY.split(", ") if c.split()[0] != "ord"]
    most = profile.max_srt_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one entry in memory at a time
                with _open(row["archive_id"]) as file:
                    data = Ranged(file, row["length"], 64)
                    got, problem = taken(data, row, most, rar_extractor)
                cells = {"archive_id": row["archive_id"], "name": row["name"], "data": got, "problem": problem, "bytes_read": data.read_bytes}
                yield pa.RecordBatch.from_pylist([cells], _TAKEN)

    return picks.select("archive_id", "length", *fields, "header_offset").mapInArrow(run, "archive_id string, name string, data binary, problem string, bytes_read long")


def first_subtitles(spark: SparkSession, path: str, profile: SiteProfile = DEFAULT, rar_extractor: Extractor | None = None, **options: object) -> DataFrame:
    """Archives below ``path`` -> ``archive_id, name, data, problem, length, bytes_read``: the first subtitle of each.

    As ``extract_first_srt``, without reading whole archives: they are listed, subtitles picked by name from slim rows,
    and the picked entries read. A row each; an archive without a subtitle has a problem.
    """
    # Listed once: the reader's rows are slim, and a second scan would open each file again.
    rows = materialize(list_archives(spark, path, profile, **options))
    picked = first_srt(rows.where("problem is null"))
    data = read_entries(picked, profile, rar_extractor).select("archive_id", "name", "data", F.col("problem").alias("__why"), F.col("bytes_read").alias("__more"))
    each = rows.groupBy("archive_id").agg(F.first("length").alias("length"), F.first("bytes_read").alias("bytes_read"), F.first("problem", True).alias("problem"))
    met = each.join(data, "archive_id", "left")
    why = F.coalesce("problem", "__why", F.when(F.col("name").isNull(), "Archive does not contain an SRT file"))
    return met.select("archive_id", "name", "data", why.alias("problem"), "length", (F.col("bytes_read") + F.coalesce("__more", F.lit(0))).alias("bytes_read"))
