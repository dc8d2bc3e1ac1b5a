"""Cards: groups claimed from names, groups collapsed to a face, counts without windows, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions import columns as C


def group_kinds(files: DataFrame) -> DataFrame:
    """(group_id, has_video, has_audio, n) of every group."""
    video, audio = C.is_kind(F.col("ext"), "video"), C.is_kind(F.col("ext"), "audio")
    return files.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.max(video).alias("has_video"), F.max(audio).alias("has_audio"), F.count(F.lit(1)).alias("n"))


def collapses(pairs: bool, sets: bool) -> Column:
    """Whether a group (has_video, has_audio) is one card; with one of the switches off, only sets of the other kind are."""
    songs = pairs and sets
    kinds = [F.lit(False)]
    if songs:
        kinds.append(F.col("has_audio"))
    if pairs:
        kinds.append(F.col("has_video"))
    if sets:
        kinds.append(~F.col("has_video") & ~F.col("has_audio"))
    out = kinds[0]
    for kind in kinds[1:]:
        out = out | kind
    return out


def with_cards(files: DataFrame, pairs: bool = True, sets: bool = True) -> DataFrame:
    """files with card, the key that they collapse by; kinds of groups are those of the given files."""
    own = F.concat(F.lit("i"), F.col("id").cast("string"))
    if pairs and sets:
        return files.withColumn("card", F.coalesce("group_id", own))
    kinds = group_kinds(files).where(collapses(pairs, sets)).select("group_id", F.col("group_id").alias("card_group"))
    return files.join(kinds, "group_id", "left").withColumn("card", F.coalesce("card_group", own)).drop("card_group").select(*files.columns, "card")


def collapse(members: DataFrame, sets_only: bool = False, favourites: DataFrame | None = None) -> DataFrame:
    """One row for each card of members (with card): its face, the number of its members and the video it plays.

    The face is the song where there is one, else a still before a video; then the best stage, the last name,
    favourites, the highest score (none last), the newest. Lean columns only; pages join display columns back.
    """
    video, audio = C.is_kind(F.col("ext"), "video"), C.is_kind(F.col("ext"), "audio")
    lean = members.select("card", "id", "filename", "mtime", "size", "reward", video.alias("is_video"), audio.alias("is_audio"), C.face_rank(F.col("set_stage"), F.col("filename")).alias("rank"), *(["shuffle_key"] if "shuffle_key" in members.columns else []))
    if favourites is not None:
        marks = favourites.select(F.col("image_id").alias("id")).distinct().withColumn("fav", F.lit(1))
        lean = lean.join(marks, "id", "left")
    fav = F.coalesce(F.col("fav"), F.lit(0)) if favourites is not None else F.lit(0)
    face = F.struct(F.col("is_audio"), ~F.col("is_video"), -F.col("rank"), F.col("filename"), fav, F.col("reward").alias("reward"), F.col("mtime"), F.col("id"))
    play = F.struct(F.lower("filename").contains("-audio."), F.col("id"))
    shown = F.struct("id", "mtime", "size", "reward", *(["shuffle_key"] if "shuffle_key" in lean.columns else []))
    out = lean.groupBy("card").agg(
        F.max_by(shown, face).alias("face"),
        F.count(F.lit(1)).alias("group_count"),
        F.max_by(F.when(F.col("is_video"), F.col("id")), F.when(F.col("is_video"), play)).alias("video_id"),
        F.max("is_video").alias("has_video"),
        F.max("is_audio").alias("has_audio"),
        F.max("mtime").alias("newest"),
    )
    out = out.where("group_count > 1") if sets_only else out
    return out.select("card", "face.*", "group_count", "video_id", "has_video", "has_audio", "newest")


ORDERS = ("date", "date-asc", "reward-asc", "reward-desc", "size-desc", "random")


def order_of(sort: str, seed: int = 1) -> list[Column]:
    """The order of a sort's name, ended by the id; an unknown name is by date."""
    by = {
        "date-asc": [F.asc("mtime")],
        "reward-asc": [F.asc_nulls_last("reward")],
        "reward-desc": [F.desc_nulls_last("reward")],
        "size-desc": [F.desc("size")],
    }
    if sort == "random":
        return [C.shuffle_order(F.col("shuffle_key"), seed).asc(), F.asc("id")]
    return [*by.get(sort, [F.desc("mtime")]), F.asc("id")]


def page(cards: DataFrame, files: DataFrame, order: list[Column], limit: int = 120, offset: int = 0) -> DataFrame:
    """A page of cards in a total order, with display columns fetched for its rows only."""
    rows = cards.orderBy(*order, F.asc("id")).offset(max(0, offset)).limit(max(1, min(limit, 500)))
    return rows.join(files.select("id", "folder", "filename", "model_name", "width", "height"), "id")


def members_of(page_rows: DataFrame, files: DataFrame) -> DataFrame:
    """(card, id) of all members of the cards of a page, one row for each: a card may have any number."""
    return files.select("card", "id").join(page_rows.select("card"), "card", "left_semi")


def display(page_rows: DataFrame, files: DataFrame) -> DataFrame:
    """A page with what only shown rows need: whether the whole group holds a video, what the video shows, the set badge.

    Width, height and size are the video's where a card plays one; a duration only fills a blank.
    """
    kinds = group_kinds(files).select(F.col("group_id").alias("card"), F.col("has_video").alias("whole_group_has_video"))
    video = files.select(F.col("id").alias("video_id"), *(F.col(c).alias(f"video_{c}") for c in ("width", "height", "size")))
    out = page_rows.join(kinds, "card", "left").join(video, "video_id", "left")
    whole = F.coalesce("whole_group_has_video", F.lit(False))
    is_set = (F.col("group_count") > 1) & ~whole & ~F.col("has_audio")
    return out.select("card", "id", "group_count", "video_id", whole.alias("group_has_video"), is_set.alias("is_set"), *(F.coalesce(f"video_{c}", c).alias(c) for c in ("width", "height", "size")))


def counts(files: DataFrame, pairs: bool = True, sets: bool = True) -> DataFrame:
    """Cards and files under the switches, in two aggregations and no window.

    Cards are files without a group, groups that collapse, and files of groups that don't. With one switch
    off only cards of two files or more count, as only those are shown.
    """
    video, audio = C.is_kind(F.col("ext"), "video"), C.is_kind(F.col("ext"), "audio")
    by_group = files.groupBy("group_id").agg(F.max(video).alias("has_video"), F.max(audio).alias("has_audio"), F.count(F.lit(1)).alias("n"))
    alone, one_card = F.col("group_id").isNull(), collapses(pairs, sets)
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")
    if pairs != sets:
        shown = ~alone & one_card & (F.col("n") > 1)
        return by_group.agg(total(shown, F.lit(1)).alias("cards"), total(shown, F.col("n")).alias("files"))
    cards = F.when(~alone & one_card, F.lit(1)).otherwise(F.col("n"))
    return by_group.agg(total(F.lit(True), cards).alias("cards"), total(F.lit(True), F.col("n")).alias("files"))


def claim_groups(files: DataFrame, passes: list[tuple[Column, Column]]) -> DataFrame:
    """Group ids by priority: each pass is (key, condition over its group) and sees rows no earlier pass claimed."""
    out = files.withColumn("claimed", F.lit(None).cast("string"))
    for i, (key, holds) in enumerate(passes):
        free = F.when(F.col("claimed").isNull(), key)
        out = out.withColumn("claim_key", free)
        wins = out.where(F.col("claim_key").isNotNull()).groupBy("claim_key").agg(holds.alias("wins")).where("wins").select("claim_key", F.lit(True).alias("wins"))
        own = F.concat(F.lit(f"{i}:"), F.col("claim_key"))
        out = out.join(wins, "claim_key", "left").withColumn("claimed", F.coalesce("claimed", F.when(F.col("wins"), own))).drop("wins", "claim_key")
    return out


def expand(selection: DataFrame, files: DataFrame) -> DataFrame:
    """The selected ids and those of all other members of their groups, each once, in order."""
    groups = files.join(selection.select("id"), "id", "left_semi").select("group_id").distinct()
    pulled = files.join(groups, "group_id", "left_semi").select("id")
    return selection.select("id").union(pulled).distinct().orderBy("id")


def expand_ordered(selection: DataFrame, files: DataFrame) -> DataFrame:
    """Selected ids in their order, each followed by the other members of its group that it pulls in first."""
    chosen = selection.join(files.select("id", "group_id"), "id")
    pulled = chosen.where(F.col("group_id").isNotNull()).select("pos", "group_id").join(files.select("id", "group_id"), "group_id").join(selection.select("id"), "id", "left_anti")
    extra = pulled.groupBy("id").agg(F.min("pos").alias("pos")).withColumn("came_with", F.lit(True))
    return chosen.select("id", "pos", F.lit(False).alias("came_with")).union(extra.select("id", "pos", "came_with")).orderBy("pos", "came_with", "id")


def ranked_in(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
