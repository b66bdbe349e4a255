"""Landed feeds: tables in zip files, as a data source, and the pages of map layers, kept as Parquet.

Zip files are read through pyarrow's file systems, so any store that those know will do (file, hdfs, s3 and the like). Register
the source with `spark.dataSource.register(ZipTable)`."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rostrum.sources.parse import paged_features

#: Rows of a batch, which bound a task's memory whatever a file's size.
BATCH = 10_000


def listed(path: str, ending: str) -> list[str]:
    """The files under a folder, or the file itself, in order."""
    fs, root = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(ending))


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of text as batches of the schema's types; empty text is null, except in strings where it stays."""

    def made(part: list[tuple]) -> pa.RecordBatch:
        columns = []
        for f, values in zip(schema, zip(*part, strict=True), strict=True):
            text = pa.array(values, pa.string())
            columns.append(text if pa.types.is_string(f.type) else pa.array([v or None for v in values], pa.string()).cast(f.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == BATCH:
            yield made(part)
            part = []
    if part:
        yield made(part)


@dataclass
class Member(InputPartition):
    feed: str
    name: str


class ZipTable(DataSource):
    """A table of zip feeds: option `path`, a zip file or a folder of them, and `member`, the file inside, a CSV with a header. The
    schema is given; its column `feed`, if it has one, is the name of the zip. Columns that a feed lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "zip_table"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(self.options, schema)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.member, self.schema = options["path"], options["member"], to_arrow_schema(schema)

    def opened(self, feed: str) -> zipfile.ZipFile:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        return zipfile.ZipFile(fs.open_input_file(feed))

    def partitions(self) -> list[Member]:
        """One for each feed's member, so feeds are read side by side."""
        out = []
        for feed in listed(self.path, ".zip"):
            with self.opened(feed) as z:
                out += [Member(feed, n) for n in z.namelist() if n.rsplit("/", 1)[-1] == self.member]
        return out or [Member("", "")]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        if not part.feed:
            return
        feed = part.feed.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        with self.opened(part.feed) as z, z.open(part.name) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
            at = {name.strip(): i for i, name in enumerate(next(lines, []))}
            places = [at.get(f.name, -1) for f in self.schema]
            names = self.schema.names
            rows = (tuple(feed if n == "feed" else r[i] if 0 <= i < len(r) else None for n, i in zip(names, places, strict=True)) for r in lines if r)
            yield from batches(rows, self.schema)


def land_layers(pages: DataFrame, attributes: str, path: str, by: str, page_size: int) -> None:
    """Write the features of landed layer pages (layer, offset, json) as Parquet, a folder for each layer, in the order of the attribute
    `by`. A filter on the layer then leaves the other folders unread, one on an attribute reaches the scan, where row groups
    that can't hold it are passed over, and only the columns asked for are read. The layers given replace those of their name."""
    rows = paged_features(pages, attributes, page_size).drop("offset", "n")
    rows = rows.repartitionByRange("layer", by).sortWithinPartitions("layer", by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def layers(spark: SparkSession, path: str) -> DataFrame:
    """What land_layers wrote."""
    return spark.read.parquet(path)
