"""Folders of pages that are written only where they changed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rostrum.operators.graph import cut_lineage
from rostrum.operators.relational import duplicated_keys


def present(pages: DataFrame, folder: str) -> DataFrame:
    """(path, hash) of the files in the folder, none where it isn't there; paths are relative to it."""
    spark = pages.sparkSession
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return spark.createDataFrame([], "path string, hash string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    return files.select(inside.alias("path"), F.sha2("content", 256).alias("hash"))


def write_changed(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (path, body) to the folder where their content differs from the file that is there, and return those (path).

    Files that are equal keep their times; files that pages doesn't name stay. All that changed is first written beside, in a
    folder of its own that listings pass over, and moved once all of it is there: a run that fails before that changes nothing,
    and each file is replaced as a whole. The folder is a URI of a store that driver and executors share."""
    if duplicated_keys(pages, ["path"]).limit(1).count():
        raise ValueError("a page is given twice")
    body = F.when(F.col("body").isNull(), F.raise_error(F.concat(F.lit("page without body (no body): "), F.col("path")))).otherwise(F.col("body"))
    own = pages.select("path", body.alias("body")).withColumn("hash", F.sha2(F.col("body").cast("binary"), 256))

    @F.udf("boolean")
    def empty_there(path: str) -> bool:
        fs, root = pafs.FileSystem.from_uri(folder)
        found = fs.get_file_info(f"{root.rstrip('/')}/{path}")
        return found.type == pafs.FileType.File and found.size == 0

    changed = own.join(present(pages, folder), ["path", "hash"], "left_anti").select("path", "body")
    changed = cut_lineage(changed.where((F.col("body") != "") | ~empty_there("path")))  # Spark's reader passes empty files over
    staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def place(uri: str, path: str) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(uri)
        target = f"{root}/{path}"
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        return fs, target

    def stage(rows: Iterator[Row]) -> None:
        for r in rows:
            fs, target = place(staging, r.path)
            with fs.open_output_stream(target) as out:
                out.write(r.body.encode())

    def move(rows: Iterator[Row]) -> None:
        for r in rows:
            fs, target = place(folder.rstrip("/"), r.path)
            _, source = pafs.FileSystem.from_uri(f"{staging}/{r.path}")
            if fs.get_file_info(source).type == pafs.FileType.File:  # a task that is run again finds it moved already
                fs.move(source, target)

    try:
        changed.foreachPartition(stage)
        changed.select("path").foreachPartition(move)
    finally:
        fs, root = pafs.FileSystem.from_uri(staging)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)
    return changed.select("path")
