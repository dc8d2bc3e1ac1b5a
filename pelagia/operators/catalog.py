"""The catalog table, and a catalog-shaped view of the documents and labels tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, shaped as a media file: kinds, groups, stages and sizes follow from the id."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    d = F.col("doc_id")
    scores = labels.groupBy("doc_id").agg(F.max("quality").alias("reward"), F.max("toxic").alias("toxic"))
    ext = F.when(d % 23 == 0, ".mp4").when(d % 31 == 0, ".mp3").otherwise(".png")
    return docs.join(scores, "doc_id", "left").select(
        d.alias("id"),
        F.concat(F.lit("r"), (d % 3).cast("string")).alias("root_id"),
        F.concat(F.lit("gen/"), F.col("source")).alias("folder"),
        F.when(d % 10 != 0, F.col("lang")).alias("model_name"),
        F.when(d % 10 != 0, F.concat(F.col("lang"), F.lit("_v"), (d % 4).cast("string"))).alias("model_type"),
        F.when(d % 10 != 0, F.concat(F.get(F.array(*map(F.lit, ("SDXL v1.5\\", "Pony/", "krea 2/", "Krea/", "krea2/", ""))), (d % 6).cast("int")), F.get(F.array(*map(F.lit, ("base", "ultraPonyReal_7", "influx", "my-flux_1Dev"))), (d % 4).cast("int")), F.lit(".safetensors"))).alias("model"),
        F.concat(F.lit("shot_"), (d % 97).cast("string"), F.when(d % 6 == 1, "_Refine").when(d % 6 == 2, "-audio").when(d % 6 == 3, "_det").otherwise(""), ext).alias("filename"),
        ext.alias("ext"),
        F.when(d % 4 != 0, F.concat(F.lit("g"), F.floor(d / 3).cast("string"))).alias("group_id"),
        F.when(d % 5 == 0, "Final").when(d % 5 == 1, "raw").when(d % 5 == 2, "First").otherwise("").alias("set_stage"),
        (F.lit(1700000000) + d * 60).alias("mtime"),
        F.col("n_chars").alias("size"),
        (F.lit(1024) + d % 60).alias("width"),
        (F.lit(1024) + d % 47).alias("height"),
        F.col("text").alias("positive"),
        F.col("reward").cast("int").alias("reward"),
        F.coalesce(F.col("toxic"), F.lit(0)).cast("int").alias("toxic"),
        F.when(d % 31 == 0, F.concat(F.lit("Chanson d'été "), F.col("lang"))).alias("lyrics"),
        (d * 7919 % 1000000007).alias("shuffle_key"),
        F.when(d % 9 == 0, 0).otherwise(1).alias("has_meta"),
        F.when(d % 17 == 0, F.concat(F.lit("Note on "), F.col("source"))).when(d % 17 == 1, " ").alias("note"),
    )
