"""Lines that stand in several documents are kept in one of them only; DataFrame functions alone.

Lines are exploded with 128 bits of hash of their normalised form and written without their text: document id, hash
of the text, position, hash. Distinct documents a hash are counted in two aggregations (first by hash and document, so
a line of a third of all rows is spread over its documents, then by hash, with partial sums). Hashes that hold at least
1 / HOT_SHARE of all lines are HOT_SHARE at most and are broadcast; the others meet their lines in an
equi-join. Positions to drop are gathered by document, and each text moves once, to meet its own.

Defined results: null and empty texts are one empty line. Documents without an id keep all lines and aren't counted.
Rows that share an id are one document: a line repeated in them, or within one text, isn't shared. Of texts that
differ under one id each keeps its own order. Columns of the input stay, whatever their names, but for
text and those named as results. An empty table gives an empty one. Texts of any length are split whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import ascii_lower, table, written

MIN_CHARS = 10
MIN_DOCUMENTS = 2
HOT_SHARE = 1024
BLANKS = " \t\n\x0b\x0c\r"
RESULTS = ("n_lines", "n_dropped")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keyed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, body, pos, h1, h2) of all lines; body is the hash of the whole text, h1 and h2 of the normalised line."""
    rows = documents.select(F.col("doc_id"), F.xxhash64("text").alias("body"), lines_of(ascii_lower(F.col("text").cast("string"))).alias("lines"))
    lines = rows.select("doc_id", "body", F.posexplode("lines").alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    return lines.select("doc_id", "body", "pos", F.length("line").alias("chars"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, first_id, n) of lines in at least so many documents: the smallest id and how many lines there are."""
    by_document = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_line = by_document.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_id"), F.sum("n").alias("n"))
    return by_line.where(F.col("documents") >= min_documents).select("h1", "h2", "first_id", "n")


def dedup(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """documents with their text reassembled from the lines that stay, n_lines and n_dropped."""
    lines = written(keyed_lines(documents).where((F.col("chars") >= min_chars) & F.col("doc_id").isNotNull()).drop("chars"), "lines")
    shared = written(shared_lines(lines, min_documents), "shared-lines")
    least_hot = lines.count() // HOT_SHARE + 1
    hot = F.broadcast(shared.where(F.col("n") >= least_hot).select("h1", "h2", F.col("first_id").alias("hot_id")))
    rest = shared.where(F.col("n") < least_hot).select("h1", "h2", "first_id")
    marked = lines.join(hot, ["h1", "h2"], "left")
    dropped = marked.where(F.col("doc_id") > F.col("hot_id")).select("doc_id", "body", "pos")
    dropped = dropped.union(marked.where(F.col("hot_id").isNull()).join(rest, ["h1", "h2"]).where(F.col("doc_id") > F.col("first_id")).select("doc_id", "body", "pos"))
    dropped = dropped.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("dropped"))

    others = [F.col(c) for c in documents.columns if c not in ("text", *RESULTS)]
    whole = documents.select(F.struct(*others).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), lines_of(F.col("text")).alias("lines"))
    found = whole.join(dropped, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("body")), "left")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.col("dropped").isNull(), places).otherwise(F.array_except(places, "dropped"))
    text = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return found.select("row.*", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
