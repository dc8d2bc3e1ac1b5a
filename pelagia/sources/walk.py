"""Folder walks by Spark's binary file source; contents are read only by scans that ask for them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.functions import vocab

#: a folder of files that wait to be deleted
BIN = "_ToRecycle"
SIDECAR_BYTES = 64 * 1024
MEDIA_GLOB = "*.{" + ",".join(e[1:] for e in vocab.IMAGE_EXTENSIONS + vocab.VIDEO_EXTENSIONS + vocab.AUDIO_EXTENSIONS) + "}"


def _load(spark: SparkSession, folders: str | Sequence[str], glob: str, deep: bool) -> DataFrame:
    paths = [folders] if isinstance(folders, str) else list(folders)
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", glob).load(paths)


def walk_media(spark: SparkSession, root: str, glob: str = MEDIA_GLOB) -> DataFrame:
    """(path, folder, filename, ext, mtime, size) of every media file below root."""
    return _described(_load(spark, root, glob, True)).where(~F.col("path").contains("/" + BIN + "/"))


def walk_folders(spark: SparkSession, folders: Sequence[str], glob: str = MEDIA_GLOB) -> DataFrame:
    """The same for the files directly in these folders."""
    return _described(_load(spark, folders, glob, False))


def walk_some(spark: SparkSession, folders: Sequence[str], glob: str = MEDIA_GLOB) -> tuple[DataFrame | None, list[str]]:
    """The same, and the folders that can't be listed: what lies in those is not known to be gone."""
    good, bad = [], []
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        try:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
            good.append(folder)
        except Py4JJavaError:
            bad.append(folder)
    return (walk_folders(spark, good, glob) if good else None), bad


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, set_id, set_stage) of the side files below root that are not too large; lines of ours are lifted out."""
    files = _load(spark, root, "*.txt", True).where(F.col("length") <= SIDECAR_BYTES)
    return lifted(files.select("path", F.decode("content", "UTF-8").alias("text")))


def lifted(texts: DataFrame) -> DataFrame:
    line = lambda name: rf"(?im)^[ \t]*vv[ _]*set[ _]*{name}[ \t]*:[ \t]*(.+?)[ \t]*$"
    value = lambda name: F.nullif(F.regexp_extract("text", line(name), 1), F.lit(""))
    return texts.select("path", F.regexp_replace(F.regexp_replace("text", line("id"), ""), line("stage"), "").alias("text"), value("id").alias("set_id"), value("stage").alias("set_stage"))


def _described(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"), F.col("length").alias("size"))


def folder_signature(files: DataFrame) -> DataFrame:
    """(folder, mtime, n) of every folder that holds files."""
    return files.groupBy("folder").agg(F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("n"))


def contents(spark: SparkSession, root: str, glob: str = MEDIA_GLOB) -> DataFrame:
    return _load(spark, root, glob, True).select("path", "content")


def sidecar_keys(path: Column) -> list[Column]:
    """Candidate text files of a media file, the most specific first."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return [F.concat(path, F.lit(".txt")), F.concat(stem, F.lit(".txt")), F.concat(F.regexp_replace(stem, r"(?i)_[0-9]{5,}_?(-audio)?$", ""), F.lit(".txt")), F.concat(F.regexp_extract(stem, r"(?i)^(.*?~vv[0-9a-z]{4,10}(?![0-9a-z]))[^/]*$", 1), F.lit(".txt"))]


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files with sidecar: the text of the first candidate that exists in sidecars (path, text)."""
    keyed = files.select("path", F.posexplode(F.array(*sidecar_keys(F.col("path")))).alias("priority", "candidate"))
    found = keyed.join(sidecars.select(F.col("path").alias("candidate"), "text"), "candidate")
    best = found.groupBy("path").agg(F.min_by("text", "priority").alias("sidecar"))
    return files.join(best, "path", "left")


def resolve(wanted: DataFrame, models: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """wanted (raw) with path: the file at that relative path, else one of that name, else of that stem if raw has no model's extension.

    Paths are relative to the folder of all models; of equal matches one in an earlier category comes first, and
    one outside of them last.
    """
    category = F.coalesce(*(F.when(F.col("path").startswith(c + "/"), F.lit(i)) for i, c in enumerate(categories)), F.lit(len(categories)))
    shelf = models.select("path", category.alias("category"))
    inside = F.coalesce(*(F.when(F.col("category") == i, F.substring("path", len(c) + 2, 1 << 20)) for i, c in enumerate(categories)), F.col("path"))
    key = lambda p, k: F.struct(F.lit(p).alias("p"), k.alias("k"))
    is_model = lambda name: F.lower(name).rlike(r"\.(safetensors|ckpt|sft|gguf|pt|pth|bin)$")
    plain = F.regexp_replace(F.regexp_replace("raw", r"\\", "/"), "^/+", "")
    name, base = (F.lower(F.element_at(F.split(x, "/"), -1)) for x in (plain, F.col("path")))
    keyed = wanted.select("raw", F.explode(F.array(key(0, plain), key(1, name), F.when(~is_model(name), key(2, name)))).alias("c")).select("raw", "c.p", "c.k")
    shelf = shelf.select("path", "category", F.explode(F.array(key(0, inside), key(0, F.col("path")), key(1, base), F.when(is_model(base), key(2, F.regexp_replace(base, r"\.[^.]*$", ""))))).alias("c")).select("path", "category", "c.p", "c.k")
    best = keyed.join(shelf, ["p", "k"]).groupBy("raw").agg(F.min_by("path", F.struct("p", "category", "path")).alias("path"))
    return wanted.join(best, "raw", "left")


def reachable(spark: SparkSession, folder: str, seconds: float = 6.0) -> bool:
    """Whether a folder can be listed in time: a guard on the driver before anything is taken for gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    look = lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    pool = ThreadPoolExecutor(1)
    try:
        return bool(pool.submit(look).result(seconds))
    except (Py4JJavaError, TimeoutError):
        return False
    finally:
        pool.shutdown(wait=False)


def short_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 10)
