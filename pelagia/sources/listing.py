"""Folders listed by tasks: their own times, the files in them, and subfolders that nobody knew yet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import vocab
from pelagia.operators import store
from pelagia.sources.walk import BIN

ENTRIES = "kind string, folder string, path string, filename string, ext string, mtime double, size long"
MEDIA = frozenset(vocab.IMAGE_EXTENSIONS + vocab.VIDEO_EXTENSIONS + vocab.AUDIO_EXTENSIONS)
FOLDERS_A_TASK = 64


@dataclass
class Walk:
    """files (path, folder, filename, ext, mtime, size), folders (folder, mtime) that were listed, unreadable (folder)."""

    files: DataFrame
    folders: DataFrame
    unreadable: DataFrame


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def seconds(info: fs.FileInfo) -> float | None:
    return info.mtime_ns / 1e9 if info.mtime_ns is not None else None


def time_of(folder: str) -> tuple[float | None, bool]:
    """A folder's time, null if it can't be read, and whether it is known not to be there."""
    try:
        place, top = opened(folder)
        info = place.get_file_info(top)
    except OSError:
        return None, False
    return seconds(info), info.type == fs.FileType.NotFound


def entries_of(folder: str) -> list[tuple]:
    """The folder itself, its media files and its subfolders; or that it can't be read."""
    try:
        place, top = opened(folder)
        own = place.get_file_info(top)
        if own.type != fs.FileType.Directory:
            raise FileNotFoundError(folder)
        found = place.get_file_info(fs.FileSelector(top))
    except OSError:
        return [("unreadable", folder, None, None, None, None, None)]
    out = [("folder", folder, None, None, None, seconds(own), None)]
    for info in found:
        path, ext = f"{folder.rstrip('/')}/{info.base_name}", f".{info.extension.lower()}" if info.extension else ""
        if info.type == fs.FileType.Directory and info.base_name != BIN:
            out.append(("below", folder, path, info.base_name, None, None, None))
        elif info.type == fs.FileType.File and ext in MEDIA:
            out.append(("file", folder, path, info.base_name, ext, seconds(info), info.size))
    return out


def folder_times(folders: DataFrame) -> DataFrame:
    """(folder, mtime, missing) of folders (folder), mtime null where one can't be looked up: nothing in them is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, missing = zip(*map(time_of, batch.column(0).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(times, pa.float64()), pa.array(missing, pa.bool_())], ["folder", "mtime", "missing"])

    return folders.select("folder").mapInArrow(run, "folder string, mtime double, missing boolean")


def listed(folders: DataFrame) -> DataFrame:
    """Entries of folders (folder): each task lists about FOLDERS_A_TASK of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                columns = list(zip(*entries_of(folder), strict=True))
                types = [pa.string()] * 5 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "folder", "path", "filename", "ext", "mtime", "size"])

    return folders.repartition(max(1, -(-folders.count() // FOLDERS_A_TASK)), "folder").mapInArrow(run, ENTRIES)


def walk_folders(folders: DataFrame, known: DataFrame) -> Walk:
    """These folders (folder) and, at any depth, the subfolders found in them that aren't known (folder).

    One round of tasks for each level of new folders. Links between folders are followed once, as a folder that was listed
    isn't listed again.
    """
    spark, rounds = folders.sparkSession, []
    todo = store.written(folders.select("folder").distinct(), "folders-to-list")
    seen = known.select("folder").union(todo)
    while not todo.isEmpty():
        rounds.append(store.written(listed(todo), "folder-entries"))
        below = rounds[-1].where("kind = 'below'").select(F.col("path").alias("folder")).distinct()
        todo = store.written(below.join(seen, "folder", "left_anti"), "folders-to-list")
        seen = seen.union(todo)
    found = reduce(DataFrame.union, rounds, spark.createDataFrame([], ENTRIES))
    files = found.where("kind = 'file'").select("path", "folder", "filename", "ext", "mtime", "size")
    return Walk(files, found.where("kind = 'folder'").select("folder", "mtime"), found.where("kind = 'unreadable'").select("folder"))


def walk_tree(spark: SparkSession, root: str) -> Walk:
    """Everything below a root, with the true times of all folders, empty ones too."""
    start = spark.createDataFrame([(root.rstrip("/"),)], "folder string")
    return walk_folders(start, start.where("false"))
