"""Incremental ingest: what a walk finds against what the catalog holds, and the new version of the catalog.

Only new and changed files are read. Rows vanish only where the walk is known to be complete, so an unreachable
share never empties a catalog. Curation lives in tables of its own and is not touched by reading a file again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.functions import generation, vocab
from pelagia.operators import curate, store, workflow
from pelagia.sources import containers, listing

SAME_TIME = 1e-6
LEAST_RATED = 200


@dataclass
class Scan:
    """files: the new catalog; states (path, state): new, changed, unchanged or gone; read: the rows that were read."""

    files: DataFrame
    states: DataFrame
    read: DataFrame

    def counters(self) -> DataFrame:
        """(state, n), with failed for files that could not be read: their old row, if any, stays."""
        failed = self.read.where("error is not null").select(F.lit("failed").alias("state"))
        return self.states.select("state").union(failed).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def file_facts(files: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Catalog columns of walked files (path, filename, ext, ...): what is written inside them, read by tasks."""
    found = containers.extract(files).withColumnRenamed("width", "file_width").withColumnRenamed("height", "file_height")
    rows = files.drop("content").join(found, "path")
    rows = rows.join(sidecars.select("path", "sidecar"), "path", "left") if sidecars is not None else rows.withColumn("sidecar", F.lit(None).cast("string"))
    text = lambda *names: F.coalesce(*(F.try_element_at("texts", F.lit(n)) for n in names))
    rows = store.written(rows, "files-found")
    asked = rows.select("path", text("prompt").alias("graph"), text("parameters", "comment", "©cmt").alias("block"), "sidecar", "filename", text("vv_set_stage").alias("stage"))
    rows = rows.join(workflow.file_facts(asked, "path"), "path").withColumn("song", F.when(C.is_kind(F.col("ext"), "audio"), generation.song_facts(F.col("facts.positive"))))
    has_meta = F.coalesce(F.col("facts.positive"), F.col("facts.model"), F.col("facts.model_name")).isNotNull()
    return rows.select(*(c for c in files.columns if c != "content"), F.col("file_width").alias("width"), F.col("file_height").alias("height"), "animated", "duration", "peaks", F.coalesce(text("vv_set_id"), F.lit("")).alias("set_id"), F.coalesce(text("vv_set_stage"), F.lit("")).alias("set_stage"), "facts.*", *(F.col(f"song.{c}").alias(f"song_{c}") for c in ("bpm", "key", "genre", "vocal")), C.name_from_filename(F.col("filename")).alias("song_name"), has_meta.cast("int").alias("has_meta"), "error")


def states(stored: DataFrame, walked: DataFrame, force: bool = False) -> DataFrame:
    """(path, state) by time and size; videos whose size or duration is unknown are read once more."""
    old = stored.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), (F.col("ext").isin(".mp4", ".mov") & (F.col("width").isNull() | F.col("duration").isNull())).alias("blank"))
    both = old.join(walked.select("path", "mtime", "size"), "path", "full_outer")
    same = (F.abs(F.col("mtime") - F.col("old_mtime")) < SAME_TIME) & (F.col("size") == F.col("old_size")) & ~F.col("blank") & F.lit(not force)
    return both.select("path", F.when(F.col("old_size").isNull(), "new").when(F.col("size").isNull(), "gone").when(same, "unchanged").otherwise("changed").alias("state"))


def may_prune(stored: DataFrame, walked: DataFrame, complete: bool) -> bool:
    """Whether files that the walk hasn't seen are gone: not after a stopped walk, nor one that saw nothing at all."""
    return complete and (not walked.isEmpty() or stored.isEmpty())


def scan(stored: DataFrame, walked: DataFrame, read: Callable[[DataFrame], DataFrame] = file_facts, force: bool = False, complete: bool = True, folders: Sequence[str] | DataFrame | None = None, version: int | None = None) -> Scan:
    """The catalog after a walk of all, or of these folders: only rows in walked folders can vanish.

    A file that is read again keeps its row: its id, and every column that reading doesn't give. New files get the ids
    that follow. What was read is stamped with the reader's version; what could not be read stays as it was.
    """
    found = store.written(states(stored, walked, force), "scan-states")
    fresh = store.written(read(walked.join(found.where("state in ('new', 'changed')").select("path"), "path", "left_semi")), "scan-read")
    good = fresh.where("error is null").drop("error")
    if version is not None:
        good = good.withColumn("reader_ver", F.lit(version))
    gone = found.where("state = 'gone'").select("path")
    if folders is not None:
        inside = folders if isinstance(folders, DataFrame) else stored.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
        gone = gone.join(stored.join(inside.select("folder"), "folder", "left_semi").select("path"), "path", "left_semi")
    if not may_prune(stored, walked, complete):
        gone = gone.where("false")
    kept = stored.join(gone, "path", "left_anti")
    new = good.join(stored.select("path"), "path", "left_anti")
    new = numbered(new, stored.agg(F.max("id")).first()[0] or 0) if "id" in stored.columns else new
    files = reread(kept, good).unionByName(new.select(*(F.col(c).cast(kept.schema[c].dataType) if c in new.columns else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns)))
    seen = found.where("state <> 'gone'").union(gone.withColumn("state", F.lit("gone")))
    return Scan(files, seen, fresh)


def reread(stored: DataFrame, good: DataFrame) -> DataFrame:
    """stored with what good gives of each of its files (path); other columns, and the id, stay."""
    given = [c for c in stored.columns if c in good.columns and c not in ("id", "path")]
    both = stored.alias("old").join(good.select("path", F.lit(True).alias("was_read"), *given).alias("now"), "path", "left")
    return both.select(*(F.when(F.col("now.was_read"), F.col(f"now.{c}").cast(stored.schema[c].dataType)).otherwise(F.col(f"old.{c}")).alias(c) if c in given else F.col("path" if c == "path" else f"old.{c}") for c in stored.columns))


def numbered(rows: DataFrame, last: int) -> DataFrame:
    """rows with ids from last + 1 on without gaps: each partition, once written, has a range of its own."""
    placed = store.written(rows.drop("id").withColumn("place", F.monotonically_increasing_id()), "new-rows")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    starts, start = [], last + 1
    for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one for each partition
        starts.append((row["part"], start))
        start += row["n"]
    ranges = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, start long"))
    return placed.withColumn("part", part).join(ranges, "part").withColumn("id", F.col("start") + within).drop("part", "start", "place")


def scan_kind(last_full: float | None, now: float, signature: DataFrame | None, force: bool = False) -> tuple[bool, str | None]:
    """Whether all folders must be walked, and why: folder times can be wrong, so they are trusted for a while only."""
    if force:
        return True, "forced"
    if last_full is None:
        return True, "never walked in full"
    if full_scan_due(last_full, now):
        return True, f"last full walk {(now - last_full) / 3600:.1f}h ago"
    return (True, "no folder times") if signature is None or signature.isEmpty() else (False, None)


@dataclass
class Run:
    """A scan, the folder times to keep for the next one, when all was last walked, and why all was walked if it was."""

    scan: Scan
    signature: DataFrame
    last_full: float | None
    why_full: str | None


def run_scan(stored: DataFrame, root: str, signature: DataFrame | None, last_full: float | None, now: float, read: Callable[[DataFrame], DataFrame] = file_facts, force: bool = False, version: int | None = None) -> Run:
    """Walks all of root, or only the folders whose times moved and new ones below them; signature is (folder, mtime) of the last run.

    Every known folder's time is looked up, which lists no files of folders that stayed as they were. Rows vanish with their
    folder if it is missing while the root is there, and not where half of all folders, and two at least, can't be read.
    """
    spark = stored.sparkSession
    full, why = scan_kind(last_full, now, signature, force)
    top = spark.createDataFrame([(root.rstrip("/"),)], "folder string")
    if full:
        walk = listing.walk_tree(spark, root)
        complete = walk.unreadable.isEmpty()
        done = scan(stored, walk.files, read, force, complete, version=version)
        return Run(done, walk.folders, now if complete else last_full, why)
    times = store.written(listing.folder_times(signature.select("folder").union(top).distinct()), "folder-times")
    both = times.join(signature.withColumnRenamed("mtime", "before"), "folder", "left")
    moved = both.where("mtime is not null").where(F.col("before").isNull() | (F.abs(F.col("mtime") - F.col("before")) > vocab.MTIME_TOLERANCE) | (F.col("folder") == root.rstrip("/"))).select("folder")
    walk = listing.walk_folders(moved, signature.select("folder"))
    failing = times.where("mtime is null").count() + walk.unreadable.count()
    gone = times.where("missing").select("folder")
    if failing >= max(2, signature.count() / 2) or not gone.where(F.col("folder") == root.rstrip("/")).isEmpty():
        gone = gone.where("false")
    done = scan(stored, walk.files, read, False, True, walk.folders.select("folder").union(gone), version)
    kept = signature.join(walk.folders.select("folder").union(gone), "folder", "left_anti").select("folder", "mtime")
    return Run(done, kept.union(walk.folders), last_full, None)


def without_folders(files: DataFrame, gone: Sequence[str], unreadable: int, known: int) -> DataFrame:
    """files outside of the folders that are gone, and of those below them; nothing vanishes if half of all can't be read."""
    if not gone or unreadable >= max(2, known / 2):
        return files
    inside = F.lit(False)
    for folder in gone:
        inside = inside | (F.col("folder") == folder) | F.col("folder").startswith(folder + "/")
    return files.where(~inside)


def sweep_orphans(children: dict[str, DataFrame], files: DataFrame, key: str = "image_id") -> dict[str, DataFrame]:
    """Child tables without rows whose file is gone."""
    ids = files.select(F.col("id").alias(key))
    return {name: t.join(ids, key, "left_semi") for name, t in children.items()}


def latest_folder_grew(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(folder, before, now) if the newest stored folder holds another number of files than it did; both are (folder, mtime, n)."""
    newest = stored.agg(F.max_by(F.struct("folder", "n"), F.struct("mtime", "folder")).alias("x")).select("x.folder", F.col("x.n").alias("before"))
    return newest.join(current.select("folder", F.col("n").alias("now")), "folder").where("before <> now")


def refreshed_signature(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Folder times after files were moved by the catalog itself, so that the next quick scan doesn't take them for changes."""
    return curate.upsert(stored, current.select(*stored.columns), ["folder"])


def full_scan_due(last_full: float | None, now: float, most_seconds: float = 6 * 3600) -> bool:
    return last_full is None or now - last_full >= most_seconds


def read_rate(files: int, seconds: float, forced: bool) -> float | None:
    """Files a second of a run that read them all, if it was long enough to tell."""
    return files / seconds if forced and files >= LEAST_RATED and seconds > 0 else None


def catch_up(files: DataFrame, roots: DataFrame, version: int) -> DataFrame:
    """(root_id, behind, seconds, all_seconds): rows that an older reader wrote, and how long reading them again takes.

    roots are (root_id, rate: null where unknown); all_seconds is null unless every root with rows behind has a rate.
    """
    behind = files.where(F.col("reader_ver") < version).groupBy("root_id").agg(F.count(F.lit(1)).alias("behind"))
    rows = roots.join(behind, "root_id", "left").select("root_id", F.coalesce("behind", F.lit(0)).alias("behind"), "rate")
    rows = rows.withColumn("seconds", F.when(F.col("behind") == 0, F.lit(0.0)).otherwise(F.col("behind") / F.col("rate")))
    total = rows.agg(F.when(F.bool_and(F.col("seconds").isNotNull()), F.sum("seconds")).alias("all_seconds"))
    return rows.select("root_id", "behind", "seconds").join(F.broadcast(total))  # one row: the total


def stale(files: DataFrame, version: int) -> DataFrame:
    return files.where(F.coalesce("reader_ver", F.lit(0)) < version)


def add_columns(table: DataFrame, wanted: Sequence[tuple[str, str, Column | None]]) -> DataFrame:
    """table with columns (name, type, default) that an older version lacks; none is ever taken away."""
    for name, kind, default in wanted:
        if name not in table.columns:
            table = table.withColumn(name, (F.lit(None) if default is None else default).cast(kind))
    return table


def merge_catalogs(files: DataFrame, others: dict[str, DataFrame], children: dict[str, tuple[DataFrame, dict[str, DataFrame]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One catalog of several: others are files by root, children the (main, by root) tables that refer to them.

    A path that is known keeps its id; a new one's id is a hash of its path, so that numbering needs no single task and
    is the same in every run; references follow by path. Doing it again
    changes nothing.
    """
    arriving = None
    for root_id, table in others.items():
        rows = table.withColumn("root_id", F.lit(root_id)).withColumnRenamed("id", "old_id")
        arriving = rows if arriving is None else arriving.unionByName(rows, allowMissingColumns=True)
    first = arriving.groupBy("path").agg(F.min_by(F.struct(*arriving.columns), F.struct("root_id", "old_id")).alias("row")).select("row.*")
    new = first.join(files.select("path"), "path", "left_anti")
    numbered = new.withColumn("id", F.xxhash64("path"))
    merged = files.unionByName(numbered.drop("old_id"), allowMissingColumns=True)
    ids = arriving.select("root_id", "old_id", "path").join(merged.select("path", "id"), "path").select("root_id", "old_id", "id")
    out = {}
    for name, (main, by_root) in children.items():
        for root_id, rows in by_root.items():
            moved = rows.withColumnRenamed("image_id", "old_id").join(ids.where(F.col("root_id") == root_id).select("old_id", F.col("id").alias("image_id")), "old_id").select(*main.columns)
            main = curate.insert_ignore(main, moved, [c for c in main.columns if c in ("image_id", "tag", "source", "collection_id")])
        out[name] = main
    return merged, out


def root_changes(roots: DataFrame, stored: DataFrame) -> DataFrame:
    """(root_id, changed, gone) numbers of folders beyond the tolerance; roots and stored are (root_id, folder, mtime)."""
    both = stored.withColumnRenamed("mtime", "old").join(roots.withColumnRenamed("mtime", "now"), ["root_id", "folder"], "full_outer")
    moved = F.col("old").isNull() | (F.abs(F.col("now") - F.col("old")) > vocab.MTIME_TOLERANCE)
    return both.groupBy("root_id").agg(F.count_if(F.col("now").isNotNull() & moved).alias("changed"), F.count_if(F.col("now").isNull()).alias("gone"))
