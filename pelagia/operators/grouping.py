"""Groups of files that belong to one generation, and the family of each file's model, both from names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.functions import vocab
from pelagia.operators import cards


def group_passes() -> list[tuple[str, Column, Column]]:
    """(kind, key, condition over the group): run codes, stills with their videos, set ids, roles in names."""
    root = F.coalesce("root_id", F.lit(""))
    image, video = C.is_kind(F.col("ext"), "image"), C.is_kind(F.col("ext"), "video")
    name, several = F.col("filename"), F.count(F.lit(1)) >= 2
    in_folder = lambda key: F.concat_ws("|", root, F.coalesce("folder", F.lit("")), key)
    return [
        ("vvrun", F.concat_ws("|", root, C.run_code_key(name)), several),
        ("", in_folder(C.pair_key(name)), F.bool_or(image) & F.bool_or(video)),
        ("vvset", F.when(F.col("set_id") != "", F.concat_ws("|", root, F.col("set_id"))), several),
        ("set", F.when(image & C.set_role(name).isNotNull(), in_folder(C.set_key(name))), several & (F.min(C.set_role(name)) != F.max(C.set_role(name)))),
    ]


def regroup(files: DataFrame) -> DataFrame:
    """(id, group_id) of files (id, root_id, folder, filename, ext, set_id): the first pass that claims a file decides.

    Each pass is an aggregation with partial results and a join back on its key, so a key with a large share
    of all files is no hot task; group ids depend on the key only and are the same in every run.
    """
    passes = [(F.when(C.run_code_key(F.col("filename")).isNotNull(), key) if kind == "vvrun" else key, holds) for kind, key, holds in group_passes()]
    claimed = cards.claim_groups(files.select("id", "root_id", "folder", "filename", "ext", "set_id"), passes)
    number, key = F.substring("claimed", 1, 1).cast("int"), F.substring("claimed", 3, 1 << 20)
    kinds = F.array(*(F.lit(kind) for kind, _, _ in group_passes()))
    text = F.concat(F.when(F.get(kinds, number) != "", F.concat(F.get(kinds, number), F.lit("|"))).otherwise(""), key)
    return claimed.select("id", F.when(F.col("claimed").isNotNull(), F.substring(F.sha1(text), 1, 12)).alias("group_id"))


def vocabulary(models: DataFrame) -> dict[str, str]:
    """Family keys and the spelling to show: folders of models by most files, ties by alphabet, and the known hints.

    Its size is the number of model folders that users made, so it is collected. A key that is another's with
    digits or "xl" at its end takes that one's spelling.
    """
    family = C.family_name(C.top_folder(F.col("model")))
    votes = models.where("model <> ''").select(family.alias("spelling")).where("spelling <> ''").groupBy(F.lower("spelling").alias("key"), "spelling").agg(F.count(F.lit(1)).alias("n"))
    shown = {r["key"]: r["spelling"] for r in votes.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling"))).alias("spelling")).collect()}
    by_user = set(shown)
    for hint in vocab.FAMILY_HINTS:
        shown.setdefault(hint, hint)
    short = lambda x: re.sub(r"(?i)(?:[ _-]|[0-9]+|xl)+$", "", x)
    out = dict(shown)
    for key in sorted(shown):
        stem = short(key)
        if stem and stem != key and stem in shown and stem not in vocab.NEVER_FOLDED_INTO:
            if stem not in by_user:
                shown[stem] = out[stem] = short(shown[key])
            out[key] = stem
    return {key: shown.get(x.lower(), x) if key != x.lower() else x for key, x in out.items()}


def family_in(name: str, keys: list[str]) -> str:
    """The longest key that begins, at its first place in the name, at a boundary: no letter before, or a hump."""
    stem = re.sub(r"(?<=[^.])\.[^.]*$", "", re.split(r"[/\\]", name)[-1])
    lower = stem.lower()
    for key in keys:
        at = lower.find(key)
        if at >= 0 and (at == 0 or not stem[at - 1].isalpha() or (stem[at - 1].islower() and stem[at].isupper())):
            return key
    return ""


def model_types(files: DataFrame) -> DataFrame:
    """(id, model_type) of files (id, model, model_name) with a model: its folder's family, else one named in it."""
    models = files.where("model <> ''")
    shown = vocabulary(models)
    keys = sorted(shown, key=lambda k: (-len(k), k))

    @F.pandas_udf("string")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(lambda n: shown.get(family_in(n, keys), ""))

    folder = C.family_name(C.top_folder(F.col("model")))
    families = files.sparkSession.createDataFrame(list(shown.items()), "family string, spelling string")
    # few models have many files: names are looked up once for each
    by_model = models.select("model").distinct().select("model", F.coalesce(folder, F.lit("")).alias("folder"))
    named_in = F.when(F.col("folder") == "", named("model"))
    found = by_model.withColumn("by_name", named_in).join(families, F.lower("folder") == F.col("family"), "left")
    found = found.select("model", F.when(F.col("folder") != "", F.coalesce("spelling", "folder")).otherwise(F.coalesce("by_name", F.lit(""))).alias("model_type"))
    return models.select("id", "model").join(found, "model").select("id", "model_type")
