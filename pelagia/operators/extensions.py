"""Extensions: user functions over files that produce scores, tags or texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.operators import curate

PRODUCES = {"score": "double", "tags": "array<struct<tag:string,score:double>>", "text": "string"}


@dataclass(frozen=True)
class Extension:
    """A name, what it produces, the input column, and a function from a value to a result."""

    name: str
    produces: str
    column: str
    function: Callable

    def __post_init__(self):
        if self.produces not in PRODUCES:
            raise ValueError(f"an extension produces one of {', '.join(PRODUCES)}")


def run(files: DataFrame, extension: Extension, done: DataFrame | None = None) -> DataFrame:
    """(image_id, result, error) of files not done yet; a failing file has its error and stops nothing."""
    todo = files if done is None else files.join(done.select(F.col("image_id").alias("id")), "id", "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, value in zip(batch["id"], batch["value"], strict=True):
                try:
                    rows.append((file_id, extension.function(value), None))
                except Exception as problem:  # noqa: BLE001  reported with the file
                    rows.append((file_id, None, str(problem)[:200]))
            yield pd.DataFrame(rows, columns=["image_id", "result", "error"])

    return todo.select("id", F.col(extension.column).alias("value")).mapInPandas(work, f"image_id long, result {PRODUCES[extension.produces]}, error string")


def store_scores(quality: DataFrame, results: DataFrame) -> DataFrame:
    return curate.upsert(quality, results.where("error is null and result is not null").select("image_id", F.col("result").alias("reward")), ["image_id"])


def store_tags(tags: DataFrame, results: DataFrame, extension: Extension) -> DataFrame:
    """The answers in place of the extension's older tags; a file whose answer is an empty list loses them."""
    answered = results.where("error is null and result is not null")
    rows = answered.select("image_id", F.explode("result").alias("r")).select("image_id", "r.tag", "r.score")
    return curate.replace_tags(tags, rows, f"ext:{extension.name}", answered)


def post(selection: DataFrame, function: Callable[[list[dict]], str], most: int = 20) -> DataFrame:
    """(receipt, n, error): one call for a whole selection (with pos) in its order; more than `most` rows are refused."""
    n = selection.limit(most + 1).count()
    if n > most:
        raise ValueError(f"at most {most} files can be posted at once")
    schema = "receipt string, n long, error string"

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        items = batch.drop(columns="whole").sort_values("pos").to_dict("records")
        try:
            return pd.DataFrame([(function(items), len(items), None)], columns=["receipt", "n", "error"])
        except Exception as problem:  # noqa: BLE001  reported with the selection
            return pd.DataFrame([(None, len(items), str(problem)[:200])], columns=["receipt", "n", "error"])

    return selection.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(call, schema)


def post_log(receipts: DataFrame, failures: DataFrame, limit: int = 100) -> DataFrame:
    """Posts and failed ones, the newest first; both are (post_id, posted, ids, text)."""
    rows = receipts.withColumn("ok", F.lit(True)).unionByName(failures.withColumn("ok", F.lit(False)))
    return rows.orderBy(F.desc("posted"), "post_id").limit(max(1, min(limit, 500)))


def newest_receipts(receipts: DataFrame) -> DataFrame:
    """(image_id, post_id, posted): for each file the newest post that it was part of; receipts are (post_id, posted, ids)."""
    rows = receipts.select("post_id", "posted", F.explode("ids").alias("image_id"))
    return rows.groupBy("image_id").agg(F.max_by(F.struct("post_id", "posted"), F.struct("posted", "post_id")).alias("x")).select("image_id", "x.*")


def results_of_lines(lines: DataFrame, result_type: str) -> DataFrame:
    """(image_id, result, error) of a worker's JSON lines (value); lines of another kind are its control messages."""
    parsed = F.from_json("value", f"id long, result {result_type}, error string")
    return lines.select(parsed.alias("x")).where("x.id is not null").select(F.col("x.id").alias("image_id"), "x.result", "x.error")


@dataclass(frozen=True)
class Setting:
    """A setting that an extension declares: its kind, its default and, for a choice, its values."""

    name: str
    kind: str
    default: object = None
    choices: tuple = ()

    def __post_init__(self):
        if self.kind not in ("text", "number", "flag", "choice"):
            raise ValueError(f"unknown kind of setting: {self.kind}")
        if "password" in self.name.lower():
            raise ValueError("settings are stored in the open: no passwords")
        if self.kind == "choice" and self.default not in self.choices:
            raise ValueError("the default of a choice is one of its values")


def settings_from(declared: list[Setting], given: dict) -> dict:
    """Values of the declared settings in their types; what is undeclared or doesn't fit gives way to the default."""
    out = {}
    for s in declared:
        value = given.get(s.name, s.default)
        if s.kind == "number":
            try:
                value = float(value)
            except (TypeError, ValueError):
                value = s.default
        elif s.kind == "flag":
            value = value in (True, 1, "1", "true", "on")
        elif s.kind == "choice":
            value = value if value in s.choices else s.default
        else:
            value = s.default if value is None else str(value)
        out[s.name] = value
    return out


def from_manifest(manifest: dict, function: Callable) -> tuple[Extension, list[Setting]]:
    """An extension and its settings as a manifest declares them; raises with what is wrong in it."""
    name = str(manifest.get("name") or "").strip()
    if not name or not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError("an extension needs a name of letters, digits, dashes and underscores")
    declared = [Setting(str(x.get("name") or ""), str(x.get("type") or ""), x.get("default"), tuple(x.get("choices") or ())) for x in manifest.get("settings") or []]
    names = [s.name for s in declared]
    if "" in names or len(set(names)) < len(names):
        raise ValueError("settings need names of their own")
    return Extension(name, str(manifest.get("produces") or ""), str(manifest.get("column") or "positive"), function), declared


def self_test(extension: Extension, value) -> str | None:
    """What is wrong with an extension's answer to a value, or null."""
    try:
        answer = extension.function(value)
    except Exception as problem:  # noqa: BLE001  that is what the test is for
        return str(problem)[:200]
    fits = {"score": isinstance(answer, int | float), "text": isinstance(answer, str), "tags": isinstance(answer, list)}[extension.produces]
    return None if fits else f"the answer is no {extension.produces}"
