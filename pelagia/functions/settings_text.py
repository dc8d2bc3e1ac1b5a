"""The settings text that generators write into files: read in a pandas UDF, written by built-in functions."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SETTING_KEYS = ("steps", "sampler", "cfg scale", "seed", "size", "model", "model hash", "lora hashes", "denoising strength", "clip skip")
SCHEDULERS = ("karras", "exponential", "normal", "simple", "ddim_uniform", "beta", "sgm_uniform", "linear_quadratic")
PLACEHOLDERS = ("unknown", "none", "n/a", "na", "null", "undefined", "nil", "-")
SAMPLER_NAMES = {
    "euler": "Euler", "euler_cfg_pp": "Euler", "euler_ancestral": "Euler a", "euler_ancestral_cfg_pp": "Euler a",
    "heun": "Heun", "heunpp2": "Heun", "dpm_2": "DPM2", "dpm_2_ancestral": "DPM2 a", "lms": "LMS", "dpm_fast": "DPM fast",
    "dpm_adaptive": "DPM adaptive", "dpmpp_2s_ancestral": "DPM++ 2S a", "dpmpp_sde": "DPM++ SDE",
    "dpmpp_sde_gpu": "DPM++ SDE", "dpmpp_2m": "DPM++ 2M", "dpmpp_2m_sde": "DPM++ 2M SDE",
    "dpmpp_2m_sde_gpu": "DPM++ 2M SDE", "dpmpp_3m_sde": "DPM++ 3M SDE", "dpmpp_3m_sde_gpu": "DPM++ 3M SDE",
    "ddim": "DDIM", "uni_pc": "UniPC", "uni_pc_bh2": "UniPC", "lcm": "LCM",
}
RESOURCES = "civitai resources:"

LORAS = "array<struct<name:string,strength:double>>"
FACTS = ("positive", "negative", "model_name", "vae_name", "loras", "steps", "cfg", "sampler_name", "scheduler", "seed")
SCHEMA = f"positive string, negative string, model_name string, vae_name string, loras {LORAS}, steps int, cfg double, sampler_name string, scheduler string, seed decimal(20,0)"
LORA_TAG = re.compile(r"<lora:([^:>]+)(?::([^>]*))?>", re.IGNORECASE)
PAIR = re.compile(r'([^,:"]*):((?:"[^"]*"?|[^",])*)')


def to_float(text) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def to_int(text) -> int | None:
    """Whole numbers of any size, and others without their fraction."""
    try:
        return int(str(text).strip())
    except ValueError:
        pass
    value = to_float(text)
    return int(value) if value is not None and abs(value) < 1e300 else None


def bare_name(path: str) -> str:
    """A model's name without folders and extension."""
    return re.sub(r"(?<=[^.])\.[^.]*$", "", re.split(r"[\\/]", path)[-1])


def take_resources(line: str) -> tuple[str, list]:
    """The settings row without its list of resources, and the list; a damaged list leaves the row whole."""
    at = line.lower().find(RESOURCES)
    start = line.find("[", at) if at >= 0 else -1
    if start < 0:
        return line, []
    try:
        items, end = json.JSONDecoder().raw_decode(line, start)
    except ValueError:
        return line, []
    rest = re.sub(r",\s*,", ",", line[:at] + line[end:])
    return rest.strip(" ,"), items if isinstance(items, list) else []


def resources(items: list) -> dict:
    out: dict = {}
    for item in items:
        if not isinstance(item, dict) or not (name := str(item.get("modelName") or "").strip()):
            continue
        kind = str(item.get("type") or "").strip().lower()
        if kind == "checkpoint":
            out.setdefault("model_name", name)
        elif kind == "vae":
            out.setdefault("vae_name", name)
        elif kind == "lora":
            out.setdefault("loras", []).append((name, to_float(item.get("weight"))))
    return out


def parse(text: str | None) -> dict:
    """The facts of a block: a prompt, a negative prompt and, if its last line has a known key, a row of settings."""
    lines = (text or "").strip().split("\n")
    row, items = take_resources(lines[-1])
    settings = {k.strip().lower(): v.strip().strip('"') for k, v in PAIR.findall(row)}
    if not set(settings) & set(SETTING_KEYS):
        settings = {}
    lines = lines[:-1] if settings or (items and not row.strip()) else [*lines[:-1], row]
    positive, mark, negative = ("\n" + "\n".join(lines)).partition("\nNegative prompt:")
    named = resources(items)
    out = {
        "positive": LORA_TAG.sub("", positive).strip(),
        "negative": negative.strip() if mark else "",
        "model_name": settings.get("model") or named.get("model_name"),
        "vae_name": bare_name(settings["vae"]) if settings.get("vae") else named.get("vae_name"),
        "loras": [(name.strip(), to_float(weight)) for name, weight in LORA_TAG.findall(positive)] or named.get("loras"),
        "steps": to_int(settings.get("steps")),
        "cfg": to_float(settings.get("cfg scale")),
        "seed": to_int(settings.get("seed")),
    }
    name, _, last = settings.get("sampler", "").rpartition(" ")
    if name and last.lower() in SCHEDULERS:
        out["sampler_name"], out["scheduler"] = name.strip(), last.lower()
    else:
        out["sampler_name"] = settings.get("sampler")
    return {k: v for k, v in out.items() if v not in (None, "", [])}


def filled(found: dict, more: dict) -> dict:
    """found with what more has for its blanks; words that stand for nothing don't count."""
    nothing = lambda v: isinstance(v, str) and v.strip().lower() in PLACEHOLDERS
    return {**{k: v for k, v in more.items() if not nothing(v)}, **{k: v for k, v in found.items() if v not in (None, "", [])}}


def as_row(found: dict) -> dict:
    """The facts in the types of SCHEMA."""
    out = {k: found.get(k) for k in FACTS}
    out["loras"] = [{"name": name, "strength": to_float(strength)} for name, strength in out["loras"] or []]
    out["steps"] = to_int(out["steps"])
    out["cfg"] = to_float(out["cfg"])
    seed = to_int(out["seed"])
    out["seed"] = Decimal(seed) if seed is not None and abs(seed) < 10**20 else None
    return out


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(FACTS)).astype({"steps": "Int32", "cfg": "Float64"})


def _parsed(texts: pd.Series) -> pd.DataFrame:
    return frame([as_row(parse(t)) for t in texts])


def settings_of(text: Column | str) -> Column:
    """The facts of a settings text."""
    return F.pandas_udf(_parsed, SCHEMA)(text)


def number_text(value: Column) -> Column:
    """A number without a fraction of zero."""
    whole = value.cast("long")
    return F.when(whole == value, whole.cast("string")).otherwise(value.cast("string"))


def format_block(facts: Column, width: Column, height: Column, model_hash: Column | None = None, lora_hashes: Column | None = None) -> Column:
    """The settings text of facts (as SCHEMA): prompt and LoRA tags, the negative prompt if any, a row of settings.

    model_hash is a string, lora_hashes a map from names; both are left out where they are unknown.
    """
    known = F.create_map(*(F.lit(x) for pair in SAMPLER_NAMES.items() for x in pair))
    suffix = F.when(facts["scheduler"].isin("karras", "exponential"), F.concat(F.lit(" "), F.initcap(facts["scheduler"]))).otherwise("")
    named = lambda label, value: F.concat(F.lit(f"{label}: "), value)  # noqa: E731  null where the value is
    tag = lambda x: F.concat(F.lit("<lora:"), x["name"], F.lit(":"), number_text(F.coalesce(x["strength"], F.lit(1.0))), F.lit(">"))
    row = [
        named("Steps", facts["steps"].cast("string")),
        named("Sampler", F.concat(F.coalesce(F.try_element_at(known, facts["sampler_name"]), facts["sampler_name"]), suffix)),
        named("CFG scale", number_text(facts["cfg"])),
        named("Seed", facts["seed"].cast("string")),
        F.when((width > 0) & (height > 0), named("Size", F.concat_ws("x", width.cast("string"), height.cast("string")))),
        named("Model hash", model_hash if model_hash is not None else F.lit(None).cast("string")),
        named("Model", facts["model_name"]),
    ]
    if lora_hashes is not None:
        pairs = F.filter(F.transform(facts["loras"], lambda x: F.concat(x["name"], F.lit(": "), F.try_element_at(lora_hashes, x["name"]))), lambda x: x.isNotNull())
        row.append(F.when(F.size(pairs) > 0, F.concat(F.lit('Lora hashes: "'), F.array_join(pairs, ", "), F.lit('"'))))
    prompt = F.trim(F.concat_ws(" ", F.nullif(F.trim(facts["positive"]), F.lit("")), F.nullif(F.array_join(F.transform(facts["loras"], tag), " "), F.lit(""))))
    negative = F.when(F.trim(facts["negative"]) != "", named("Negative prompt", F.trim(facts["negative"])))
    return F.concat_ws("\n", prompt, negative, F.nullif(F.concat_ws(", ", *row), F.lit("")))


def readable_block(facts: Column) -> Column:
    """The same facts as labelled lines for people; unknown ones are left out."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.nullif(value, F.lit("")))
    loras = F.array_join(F.transform(facts["loras"], lambda x: F.concat_ws(" ", x["name"], F.concat(F.lit("("), number_text(x["strength"]), F.lit(")")))), ", ")
    parts = [("Prompt", facts["positive"]), ("Negative", facts["negative"]), ("Model", facts["model_name"]), ("VAE", facts["vae_name"]), ("LoRAs", loras), ("Steps", facts["steps"].cast("string")), ("CFG", number_text(facts["cfg"])), ("Sampler", facts["sampler_name"]), ("Scheduler", facts["scheduler"]), ("Seed", facts["seed"].cast("string"))]
    return F.concat_ws("\n", *(line(label, value) for label, value in parts))
