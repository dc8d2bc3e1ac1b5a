"""Filters of the catalog: one specification gives conditions, flags for facets and semi-joins."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import columns as C

NONE = "(none)"


@dataclass(frozen=True)
class FilterSpec:
    """What a search asks for; empty fields ask for nothing."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    roots: tuple[str, ...] = ()
    model: str = ""
    mtype: str = ""
    folder: str = ""
    kind: str = ""
    pairs: bool = True
    aspect: str = ""
    after: float | None = None
    before: float | None = None
    least_score: float | None = None
    most_score: float | None = None
    tags: tuple[str, ...] = ()
    pending: tuple[int, ...] = ()
    meta: str = ""
    fav: bool = False
    note: bool = False
    labels: tuple[str, ...] = ()
    collection: int | None = None

    def without(self, *names: str) -> FilterSpec:
        """The same search blind to some of its fields."""
        blank = FilterSpec()
        return replace(self, **{n: getattr(blank, n) for n in names})


def dimension(spec: FilterSpec, name: str) -> Column:
    """The condition of one faceted dimension, true where the search doesn't use it."""
    if name == "root":
        return F.col("root_id").isin(*spec.roots) if spec.roots else F.lit(True)
    if name == "model":
        wanted = None if spec.model == NONE else spec.model
        return F.col("model_name").eqNullSafe(F.lit(wanted)) if spec.model else F.lit(True)
    if name == "mtype":
        if not spec.mtype:
            return F.lit(True)
        if spec.mtype == NONE:
            return F.col("model_name").isNotNull() & (F.coalesce("model_type", F.lit("")) == "")
        return F.coalesce(F.lower("model_type") == spec.mtype.lower(), F.lit(False))
    if not spec.folder:
        return F.lit(True)
    return (F.col("folder") == spec.folder) | F.col("folder").startswith(spec.folder + "/")


SEARCHED = ("positive", "model_name", "filename", "folder", "lyrics")


def with_search_text(files: DataFrame) -> DataFrame:
    """files with search_text, the folded words of the searched columns: store it, and searches don't fold again."""
    return files.withColumn("search_text", C.search_text(*(F.col(c) for c in SEARCHED if c in files.columns)))


def search_index(files: DataFrame) -> DataFrame:
    """(token, id): an inverted index, to be written sorted by token so that a prefix reads few row groups."""
    words = F.split(F.trim(F.translate("search_text", "\n", " ")), " +")
    return with_search_text(files).select("id", F.explode(F.array_distinct(words)).alias("token")).where("token <> ''").select("token", "id")


def search_by_index(index: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Ids of files in which each of the terms (single words) starts a token; the prefixes are pushed to the scan."""
    out = None
    for term in terms:
        for word in C.term_words(term):
            ids = index.where(F.col("token").startswith(word)).select("id").distinct()
            out = ids if out is None else out.join(ids, "id", "left_semi")
    return out if out is not None else index.select("id").distinct()


def number(text: str | None) -> float | None:
    """A bound as it is typed; what is no finite number asks for nothing."""
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


#: runs of letters, digits and underscores, all of which must be found; an underscore makes a phrase of what it joins
SEARCH_TERM = re.compile(r"\w+")


def from_params(params: dict[str, str]) -> FilterSpec:
    """The search that typed parameters ask for; unknown ones are dropped, lists are split at commas."""
    listed = lambda name: tuple(x.strip() for x in params.get(name, "").split(",") if x.strip())
    collection = number(params.get("coll"))
    return FilterSpec(
        include=tuple(SEARCH_TERM.findall(params.get("q", ""))),
        exclude=tuple(SEARCH_TERM.findall(params.get("x", ""))),
        roots=listed("roots"),
        model=params.get("model", ""),
        mtype=params.get("mfolder", ""),
        folder=params.get("folder", ""),
        kind=params.get("type", ""),
        pairs=params.get("group", "1") == "1",
        aspect=params.get("aspect", ""),
        after=number(params.get("after")),
        before=number(params.get("before")),
        least_score=number(params.get("rmin")),
        most_score=number(params.get("rmax")),
        tags=listed("tags"),
        labels=listed("label"),
        meta=params.get("meta", ""),
        fav=params.get("fav") == "1",
        note=params.get("note") == "1",
        collection=None if collection is None else int(collection),
    )


SAVED_KEYS = ("q", "x", "roots", "model", "mfolder", "folder", "type", "group", "sets", "aspect", "after", "before", "rmin", "rmax", "tags", "label", "meta", "fav", "note", "coll", "sort")
MOST_SAVED, NAME_CHARS, LIST_ITEMS = 50, 60, 100


def saved(searches: list[dict]) -> list[dict]:
    """Searches as they are stored: known keys only, bounded names and lists, pairs and sets on unless they are off."""
    out = []
    for search in searches[:MOST_SAVED]:
        name = " ".join(str(search.get("name") or "").split())[:NAME_CHARS]
        params = search.get("params")
        if not name or not isinstance(params, dict):
            continue
        kept = {"group": "1", "sets": "1"}
        for key in SAVED_KEYS:
            value = params.get(key)
            if isinstance(value, list):
                kept[key] = ",".join(str(v) for v in value[:LIST_ITEMS])
            elif isinstance(value, bool):
                kept[key] = "1" if value else "0"
            elif isinstance(value, str | int | float):
                kept[key] = str(value)
        out.append({"name": name, "params": kept})
    return out


def is_tag() -> Column:
    return (F.col("source") == "user") | F.col("source").startswith("ext:")


def apply(files: DataFrame, spec: FilterSpec, tags: DataFrame | None = None, skip: tuple[str, ...] = (), members: DataFrame | None = None) -> DataFrame:
    """The files that match; skip names faceted dimensions to leave out. members are (collection_id, image_id)."""
    out = files
    for name in ("root", "model", "mtype", "folder"):
        if name not in skip:
            out = out.where(dimension(spec, name))
    if spec.after is not None:
        out = out.where(F.col("mtime") >= spec.after)
    if spec.before is not None:
        out = out.where(F.col("mtime") <= spec.before)
    if spec.least_score is not None:
        out = out.where(F.col("reward") >= spec.least_score)
    if spec.most_score is not None:
        out = out.where(F.col("reward") <= spec.most_score)
    if spec.aspect:
        out = out.where(C.aspect(F.col("width"), F.col("height")) == spec.aspect)
    if spec.meta in ("ok", "missing"):
        out = out.where(F.coalesce(F.col("has_meta"), F.lit(0)).cast("int") == (1 if spec.meta == "ok" else 0))
    if spec.note:
        out = out.where(F.trim("note") != "")
    if spec.pending:
        out = out.where(~F.col("id").isin(*spec.pending))
    if spec.include or spec.exclude:
        stored = "search_text" in out.columns
        out = out if stored else with_search_text(out)
        for term in spec.include:
            out = out.where(C.has_term(F.col("search_text"), term))
        for term in spec.exclude:
            if C.term_words(term):
                out = out.where(~C.has_term(F.col("search_text"), term))
        out = out if stored else out.drop("search_text")
    if spec.kind:
        out = of_kind(out, files, spec.kind, spec.pairs)
    wanted = sorted({t.lower() for t in spec.tags})
    if wanted:
        out = out.join(having_all(tags.where(is_tag()), wanted), "id", "left_semi")
    if spec.labels:
        marked = sorted({"label:" + x.lower() for x in spec.labels})
        out = out.join(tags.where((F.col("source") == "user") & F.col("tag").isin(*marked)).select(F.col("image_id").alias("id")), "id", "left_semi")
    if spec.fav:
        out = out.join(tags.where("source = 'fav'").select(F.col("image_id").alias("id")), "id", "left_semi")
    if spec.collection is not None:
        out = out.join(members.where(F.col("collection_id") == spec.collection).select(F.col("image_id").alias("id")), "id", "left_semi")
    return out


def visible(files: DataFrame, spec: FilterSpec) -> DataFrame:
    """Without the files that no search shows: those of other roots, and those that wait to be deleted."""
    shown = files.where(dimension(spec, "root"))
    return shown.where(~F.col("id").isin(*spec.pending)) if spec.pending else shown


def having_all(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids that have every wanted tag: one aggregation for any number of tags."""
    rows = tags.select("image_id", F.lower("tag").alias("tag")).where(F.col("tag").isin(*wanted))
    if len(wanted) == 1:
        return rows.select(F.col("image_id").alias("id"))
    return rows.groupBy(F.col("image_id").alias("id")).agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted)).select("id")


def of_kind(matched: DataFrame, files: DataFrame, kind: str, pairs: bool) -> DataFrame:
    """Files of a kind; with pairs, what their whole group is decides."""
    own = C.is_kind(F.col("ext"), kind)
    if not pairs or kind == "audio":
        return matched.where(own)
    if kind == "video":
        groups = files.where(C.is_kind(F.col("ext"), "video") & F.col("group_id").isNotNull()).select("group_id").distinct().withColumn("group_hit", F.lit(True))
        return matched.join(groups, "group_id", "left").where(own | F.col("group_hit").isNotNull()).drop("group_hit").select(*matched.columns)
    moving = files.where((C.is_kind(F.col("ext"), "video") | C.is_kind(F.col("ext"), "audio")) & F.col("group_id").isNotNull())
    return matched.where(own).join(moving.select("group_id").distinct(), "group_id", "left_anti").select(*matched.columns)


def cards_matching(files: DataFrame, matched: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """All files of every card that has a matching member, but for those that the search's roots or pending deletions rule out.

    A matching sibling brings a whole card into view, never a file that is hidden everywhere.
    """
    shown = visible(files, spec) if spec is not None else files
    keys = matched.select(C.card_key(F.col("group_id"), F.col("id")).alias("card")).distinct()
    return shown.withColumn("card", C.card_key(F.col("group_id"), F.col("id"))).join(keys, "card", "left_semi").select("card", *files.columns)
