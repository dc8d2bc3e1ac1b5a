"""What a workflow graph says about the file that it made: nodes and links are rows, walks are rounds of joins.

A graph is JSON: nodes by id, each with a class and inputs; an input that is a list of two is a link [node, output].
All walks of all graphs (to the sampler, the model, the prompt, a number behind a link) are advanced together: a round
joins the nodes that were reached with the links that leave them and keeps the least way to each. Way lengths
are costs first, then the ranks of the links in their order, so the nearest or the first in depth is the least.
Rounds end when no way gets shorter; a cycle never shortens one. Damaged or cyclic graphs give less, never an error.

Graphs are dealt over buckets once, and everything that is written between steps stays in its graph's bucket: a round
reads and writes buckets, and moves nothing. Walks carry names of nodes; texts are read only where one is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import settings_text, vocab
from pelagia.operators import store

# fixed values
SAMPLERS = ("KSampler", "KSamplerAdvanced", "SamplerCustom", "SamplerCustomAdvanced", "KSampler (Efficient)", "KSampler //Inspire", "ClownsharKSampler_Beta", "ClownsharKSampler", "SharkSampler", "ClownSampler")
LOADERS = {"CheckpointLoaderSimple": "ckpt_name", "CheckpointLoader": "ckpt_name", "ImageOnlyCheckpointLoader": "ckpt_name", "UNETLoader": "unet_name", "UnetLoaderGGUF": "unet_name", "UnetLoaderGGUFAdvanced": "unet_name"}
MODEL_EXTENSIONS = (".safetensors", ".ckpt", ".sft", ".gguf", ".pt", ".pth", ".bin")
MODEL_KEYS = ("ckpt_name", "unet_name", "model_name", "model_path", "diffusion_model", "base_ckpt_name", "checkpoint_name")
OTHER_LOADERS = ("upscale", "vae", "clip", "controlnet", "control_net", "lora", "ipadapter", "style", "embedding", "preview", "save")
STRING_KEYS = ("value", "text", "string", "str", "wildcard_text", "populated_text")
SELECTOR_KEYS = ("Input", "input", "select", "select_input", "index", "switch")
REPLACED_KEYS = ("text", "string", "value", "text_a", "string_a")
PROMPT_KEYS = ("conditioning", "positive", "cond", "input", "a", "b")
NO_PROMPT_KEYS = ("clip", "clip_vision", "model", "vae", "latent", "samples", "image", "images", "mask", "pixels")
GUIDER_KEYS = ("guider", "conditioning_source", "cfg_guider")
MODEL_CHAIN = ("model", "guider", "base_ctx", "ctx", "context", "model_opt")
VAE_CHAIN = ("vae", "base_ctx", "ctx", "context")
LORA_PATH_KEYS, LORA_STRENGTH_KEYS, LORA_SWITCHES = ("lora", "name", "lora_name"), ("str", "strength", "strength_model"), ("on", "active", "enabled")
NUMBER_KEYS = ("value", "seed", "noise_seed", "int", "float", "number", "Number", "Value", "X", "a")
NAME_KEYS = ("sampler_name", "scheduler", "combo", "value", "string", "text", "name")
PAYLOAD_KEYS = ("samples", "latent", "latent_image", "images", "image", "img", "audio", "audio_in", "video", "pixels", "frames", "video_frames")
RELAY_KEYS = ("on_true", "on_false", "input", "value", "source", "default", "any", "base_ctx", "ctx", "context", "a", "b")
OFF_BRANCH_KEYS = ("model", "clip", "vae", "audio_vae", "clip_vision", "style_model", "positive", "negative", "conditioning", "guider", "sampler", "sigmas", "noise", "control_net", "mask", "first_frame", "start_image", "end_image")
FILE_KEYS = ("filename_prefix", "filename", "file", "path", "output_path", "base_name", "basename", "name", "prefix")
NUMBERS, NAMES = ("steps", "cfg", "seed", "noise_seed"), ("sampler_name", "scheduler")
AUDIO_FILES, VIDEO_FILES = (".mp3", ".flac", ".wav", ".opus", ".m4a", ".ogg", ".aac"), (".mp4", ".mov", ".m4v", ".webm", ".mkv", ".avi", ".gif")
PAYLOAD, RELAY, OTHER, OFF_BRANCH = 0, 2, 8, 40
ROUNDS, COST, GUIDER_HOPS = 64, 400, 3
BUCKET_CHARS = 32 << 20

WAY = "array<struct<rank:int,key:string,node:string>>"
STATE = ["g", "walk", "start", "key", "node", "value"]
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def kept(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    return store.bucketed(rows, name, "g", buckets)


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "g")


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value stands once in the plan however often body reads it: else plans grow by powers."""
    return first(F.transform(F.array(value), body))


def val(vals: Column, key: str) -> Column:
    return first(F.filter(vals, lambda x: x["key"] == key))


def has(vals: Column, *keys: str) -> Column:
    return F.exists(vals, lambda x: x["key"].isin(*keys))


def text(vals: Column, *keys: str) -> Column:
    """The first of these inputs that is a text and not blank."""
    return F.coalesce(*(F.when(F.trim(val(vals, k)["str"]) != "", val(vals, k)["str"]) for k in keys))


def as_number(x: Column) -> Column:
    return F.coalesce(x["num"], F.when(x["str"].rlike(NUMERIC), F.trim(x["str"])))


def bare(path: Column) -> Column:
    """A model's name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, r"[\\/]"), -1), r"(?<=[^.])\.[^.]*$", "")


def any_of(low: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def place(key: Column, keys: tuple[str, ...]) -> Column:
    return reduce(lambda c, ik: c.when(key == ik[1], ik[0]), enumerate(keys[1:], 1), F.when(key == keys[0], 0))


def rank(low: Column) -> Column:
    """How far an input leads away from the picture."""
    return F.when(low.isin(*PAYLOAD_KEYS), PAYLOAD).when(low.isin(*OFF_BRANCH_KEYS), OFF_BRANCH).when(low.isin(*RELAY_KEYS) | low.rlike(r"^(any_?|input_?)\d+$"), RELAY).otherwise(OTHER)


def number_at(vals: Column, slot: Column) -> Column:
    """The number that output slot of a node gives: its input of that place, a slider's, or one of a known key."""
    slider = F.when(has(vals, "isfloatX"), F.when(F.coalesce(val(vals, "isfloatX")["flag"], as_number(val(vals, "isfloatX")) == "1", F.lit(False)), val(vals, "Xf")["num"]).otherwise(val(vals, "Xi")["num"]))
    return F.coalesce(F.when(slot >= 0, F.try_element_at(vals, F.greatest(slot, F.lit(0)) + 1)["num"]), slider, *(as_number(val(vals, k)) for k in NUMBER_KEYS))


def name_at(vals: Column, slot: Column) -> Column:
    return F.coalesce(F.when(slot >= 0, F.try_element_at(vals, F.greatest(slot, F.lit(0)) + 1)["str"]), *(val(vals, k)["str"] for k in NAME_KEYS))


def nodes_of(graphs: DataFrame) -> DataFrame:
    """graphs (g, graph): a row for each node, its inputs in their order as vals, and what its class and inputs make of it."""

    def value(e: Column) -> Column:
        kind, whole = F.schema_of_variant(e["value"]), F.try_variant_get(e["value"], "$", "string")
        head = F.schema_of_variant(F.try_variant_get(e["value"], "$[0]", "variant"))
        link = F.coalesce(kind.startswith("ARRAY") & (F.size(F.try_variant_get(e["value"], "$", "array<variant>")) == 2) & head.isin("STRING", "BIGINT"), F.lit(False))
        to = F.try_variant_get(e["value"], "$[0]", "string")
        return F.struct(
            e["key"].alias("key"), F.lower(e["key"]).alias("low"), F.when(kind == "STRING", whole).alias("str"), F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), whole).alias("num"), F.when(kind == "BOOLEAN", whole == "true").alias("flag"),
            F.when(link & F.array_contains("names", to), to).alias("to"), F.when(link, F.coalesce(F.try_variant_get(e["value"], "$[1]", "int"), F.lit(-1))).alias("slot"), F.when(kind.rlike("^(ARRAY|OBJECT)") & ~link, whole).alias("js"),
        )

    top = graphs.select("g", F.map_filter(F.from_json("graph", "map<string,string>"), lambda _, v: F.coalesce(v.startswith("{"), F.lit(False))).alias("top"))
    flat = top.select("g", F.map_keys("top").alias("names"), F.posexplode("top").alias("at", "node", "raw")).withColumn("raw", F.from_json("raw", "class_type string, inputs string"))
    flat = flat.withColumn("inputs", F.coalesce(F.map_entries(F.from_json("raw.inputs", "map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)")))
    n = flat.select("g", "at", "node", F.coalesce("raw.class_type", F.lit("")).alias("kind"), F.transform("inputs", value).alias("vals")).withColumn("low", F.lower("kind"))
    vals, kind, low = F.col("vals"), F.col("kind"), F.col("low")
    shape = low.contains("sampler") & has(vals, "latent_image", "latent") & has(vals, "steps", "seed", "noise_seed", "cfg")
    listed = F.coalesce(*(F.when(kind == k, text(vals, key)) for k, key in LOADERS.items()))
    ends = lambda c: reduce(lambda a, b: a | b, (F.lower(c).endswith(x) for x in MODEL_EXTENSIONS))
    by_name = F.coalesce(*(F.when(ends(text(vals, k)), text(vals, k)) for k in MODEL_KEYS))
    decodes = F.regexp_replace(low, "[ _]", "").contains("vaedecode")
    return n.select(
        "*", (kind.isin(*SAMPLERS) | shape).alias("samples"), F.when(kind.isin(*LOADERS), listed).when(low.contains("load") & ~any_of(low, *OTHER_LOADERS), by_name).alias("model_file"),
        F.coalesce(text(vals, "vae_name"), F.when(low.contains("vae") & low.contains("loader"), text(vals, "model_name", "ckpt_name", "vae"))).alias("vae_file"),
        decodes.alias("decodes"), has(vals, "positive", "negative", "conditioning").alias("guides"),
    )


def links_of(nodes: DataFrame) -> DataFrame:
    """A row for each link: where it leaves (node, i, key), where it leads (to), and what can be read there."""
    out = nodes.select("g", "node", F.posexplode("vals").alias("i", "v")).where("v.to is not null").select("g", "node", "i", "v.key", "v.low", "v.to", "v.slot")
    there = nodes.select("g", F.col("node").alias("to"), F.col("vals").alias("theirs"), F.col("samples").alias("to_sampler"), F.col("model_file").alias("to_model"), F.col("vae_file").alias("to_vae"), F.col("guides").alias("to_guide"))
    return out.join(there, ["g", "to"]).select("*", number_at(F.col("theirs"), F.col("slot")).alias("number"), name_at(F.col("theirs"), F.col("slot")).alias("name")).drop("theirs")


def start(walk: str, origin: Column, node: Column, value: Column, key: Column | None = None) -> list[Column]:
    way = F.struct(F.lit(0).alias("cost"), F.expr(f"cast(array() as {WAY})").alias("way"))
    return [F.col("g"), F.lit(walk).alias("walk"), origin.alias("start"), (F.lit("") if key is None else key).alias("key"), node.alias("node"), value.cast("string").alias("value"), way.alias("order")]


def edge(walk: str, rank: Column, value: Column, cost: Column | None = None) -> Column:
    return F.struct(F.lit(walk).alias("walk"), rank.cast("int").alias("rank"), (F.lit(0) if cost is None else cost).cast("int").alias("cost"), value.cast("string").alias("found"))


def reach(starts: DataFrame, edges: DataFrame, buckets: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(g, walk, start, key, node, value, order): the first value that each start comes to, by least cost and way.

    edges (g, walk, node, to, key, rank, cost, found): a link with a found value ends the way. A round's rows are all that
    was reached; each new one gives itself and what its links lead to, so old and new ways meet in one aggregation.
    """
    link = F.struct("to", F.col("key").alias("by"), F.col("rank").cast("int").alias("rank"), F.col("cost").cast("int").alias("more"), "found")
    moves = kept(edges.groupBy("g", "walk", "node").agg(F.collect_list(link).alias("links")), "graph-moves", buckets)
    state = kept(dealt(starts, buckets).groupBy(*STATE).agg(F.min("order").alias("order")).withColumn("fresh", F.lit(True)), "graph-starts", buckets)
    going = F.col("fresh") & F.col("value").isNull()
    for _ in range(rounds):
        if state.where(going).isEmpty():
            break
        own = F.struct("node", "value", "order", F.lit(False).alias("is_new"))

        def step(x: Column) -> Column:
            way = F.concat("order.way", F.array(F.struct(x["rank"].alias("rank"), x["by"].alias("key"), x["to"].alias("node"))))
            order = F.struct((F.col("order.cost") + x["more"]).cast("int").alias("cost"), way.alias("way"))
            return F.struct(x["to"].alias("node"), x["found"].alias("value"), order.alias("order"), F.lit(True).alias("is_new"))

        steps = F.filter(F.transform("links", step), lambda x: (x["order"]["cost"] <= COST) & ((F.col("walk") != "guider") | (F.size(x["order"]["way"]) <= GUIDER_HOPS)))
        led = F.when(going & F.col("links").isNotNull(), F.concat(F.array(own), steps)).otherwise(F.array(own))
        rows = state.join(moves, ["g", "walk", "node"], "left").select("g", "walk", "start", "key", F.explode(led).alias("s")).select("g", "walk", "start", "key", "s.*")
        old, new = (F.min(F.when(F.col("is_new") == is_new, F.col("order"))) for is_new in (False, True))
        least = rows.groupBy(*STATE).agg(old.alias("old"), new.alias("new")).withColumn("fresh", F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old"))))
        state = kept(least.select(*STATE, F.when(F.col("fresh"), F.col("new")).otherwise(F.col("old")).alias("order"), "fresh"), "graph-round", buckets)
    ends = state.where("value is not null").groupBy("g", "walk", "start", "key").agg(F.min_by(F.struct("node", "value", "order"), "order").alias("end"))
    return kept(ends.select("g", "walk", "start", "key", "end.*"), "graph-ends", buckets)


def structure(nodes: DataFrame, links: DataFrame, savers: DataFrame, buckets: int = 1) -> DataFrame:
    """All walks that need no text: sampler, feeding sampler, guider, model, decoder's model, numbers and names."""
    node, no = F.col("node"), F.lit(None).cast("string")
    samplers = nodes.where("samples")
    asked = links.where(F.col("key").isin(*NUMBERS, *NAMES, *SELECTOR_KEYS))
    origin = F.col("node")
    starts = [
        savers.select(*start("source", node, node, no)), samplers.select(*start("fed", node, node, no)), samplers.select(*start("model", node, node, F.col("model_file"))),
        samplers.select(*start("guider", node, node, F.when(F.col("guides"), node))), links.join(nodes.where("decodes").select("g", "node"), ["g", "node"]).where("key = 'vae'").select(*start("vae", origin, F.col("to"), F.col("to_vae"))),
        asked.select(*start("number", origin, F.col("to"), F.col("number"), F.col("key"))), asked.select(*start("name", origin, F.col("to"), F.col("name"), F.col("key"))),
    ]
    key, sampler = F.col("key"), F.when(F.col("to_sampler"), F.col("to"))
    moves = F.array(
        edge("source", rank(F.col("low")), sampler, rank(F.col("low")) + 1), edge("fed", F.lit(0), sampler), edge("model", place(key, MODEL_CHAIN), F.col("to_model")), edge("vae", place(key, VAE_CHAIN), F.col("to_vae")),
        edge("guider", place(key, GUIDER_KEYS), F.when(F.col("to_guide"), F.col("to"))), edge("number", F.col("i"), F.col("number")), edge("name", F.col("i"), F.col("name")),
    )
    edges = links.select("g", "node", "to", "key", F.explode(F.filter(moves, lambda m: m["rank"].isNotNull())).alias("m")).select("g", "node", "to", "key", "m.*")
    return reach(reduce(DataFrame.unionByName, starts), edges, buckets)


def led_to(asked: DataFrame, refs: DataFrame, buckets: int, rounds: int = ROUNDS) -> DataFrame:
    """(g, node, asked): the asked nodes (g, node) and all that they refer to by refs (g, node, refs array)."""
    node, asks = F.col("node"), F.col("asked")
    state = kept(dealt(asked, buckets).select("g", "node").distinct().withColumn("asked", F.lit(True)).withColumn("fresh", F.lit(True)), "texts-asked", buckets)
    for _ in range(rounds):
        if state.where("fresh").isEmpty():
            break
        own = F.array(F.struct(node.alias("node"), asks.alias("asked"), F.lit(False).alias("is_new")))
        theirs = F.transform("refs", lambda r: F.struct(r.alias("node"), F.lit(False).alias("asked"), F.lit(True).alias("is_new")))
        led = F.when(F.col("fresh") & F.col("refs").isNotNull(), F.concat(own, theirs)).otherwise(own)
        rows = state.join(refs, ["g", "node"], "left").select("g", F.explode(led).alias("s")).select("g", "s.*")
        state = kept(rows.groupBy("g", "node").agg(F.max("asked").alias("asked"), F.min("is_new").alias("fresh")), "texts-asked", buckets)
    return state.select("g", "node", "asked")


def texts_of(nodes: DataFrame, walks: DataFrame, buckets: int = 1, asked: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(g, node, text): the text that a link to a node gives; of asked nodes (g, node), if these are given, else of all.
    Switches, joins and replacements are carried out.

    From the leaves up: each round settles the nodes whose sources are settled. What hangs on a cycle reads it as blank.
    """
    vals, kind = F.col("vals"), F.col("kind")
    selected = walks.where("walk = 'number'").groupBy("g", F.col("start").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("behind"))
    n = nodes.join(selected, ["g", "node"], "left")
    chooser = F.coalesce(*(F.when(has(vals, k), F.coalesce(as_number(val(vals, k)), F.try_element_at("behind", F.lit(k)), F.lit("-1"))) for k in SELECTOR_KEYS))
    truth = F.coalesce(val(vals, "boolean")["flag"], val(vals, "boolean")["str"] == "true", val(vals, "boolean")["num"] == "1", F.lit(False))
    choice = F.coalesce(chooser.try_cast("double").try_cast("int"), F.when(has(vals, "boolean"), F.when(truth, 1).otherwise(2)))
    n = n.withColumn("choice", F.when(kind.contains("Switch") & F.exists(vals, lambda x: x["low"].startswith("text")), choice)).withColumn("choice", F.when(F.col("choice").between(1, 26), F.col("choice")))
    named = lambda name: first(F.filter(vals, lambda x: x["key"] == name))
    chosen = F.coalesce(named(F.concat(F.lit("text"), F.col("choice").cast("string"))), named(F.concat(F.lit("text_"), F.char(F.col("choice") + 96))))
    n = n.withColumn("chosen", F.when(F.col("choice").isNotNull(), chosen))
    joined = F.filter(F.array_sort(vals), lambda x: ~x["key"].isin("delimiter", "separator", "clean_whitespace"))
    replaced = F.coalesce(*(val(vals, k) for k in REPLACED_KEYS))
    literal = F.coalesce(*(F.when(val(vals, k)["str"].isNotNull(), val(vals, k)) for k in STRING_KEYS))
    how = F.when(F.col("chosen").isNotNull(), "first").when(kind.contains("Concat"), "join").when(kind.contains("Replace"), "replace").otherwise("first")
    alone = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    parts = F.when(F.col("chosen").isNotNull(), alone(F.col("chosen"))).when(kind.contains("Concat"), joined).when(kind.contains("Replace"), alone(replaced)).when(literal.isNotNull(), alone(literal)).otherwise(F.filter(vals, lambda x: x["to"].isNotNull()))
    between = F.coalesce(F.when(has(vals, "delimiter"), val(vals, "delimiter")["str"]).otherwise(val(vals, "separator")["str"]), F.lit(""))
    find = F.coalesce(*(F.when(has(vals, k), F.coalesce(val(vals, k)["str"], F.lit(""))) for k in ("find", "find1")), F.lit(""))
    put = F.coalesce(*(F.when(has(vals, k), F.coalesce(val(vals, k)["str"], F.lit(""))) for k in ("replace", "replace1")), F.lit(""))
    rule = F.struct(how.alias("how"), between.alias("between"), (F.coalesce(val(vals, "clean_whitespace")["str"], F.lit("")) == "true").alias("clean"), find.alias("find"), put.alias("put"))
    item = lambda p, j: F.struct(j.alias("j"), p["to"].alias("ref"), F.when(p["to"].isNull(), F.coalesce(p["str"], F.lit(""))).alias("text"))
    none = F.struct(F.lit(0).alias("j"), F.lit(None).cast("string").alias("ref"), F.lit("").alias("text"))
    rows = n.select("g", "node", rule.alias("rule"), F.when(F.size(parts) > 0, F.transform(parts, item)).otherwise(F.array(none)).alias("items"))
    if asked is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        refs = kept(rows.select("g", "node", F.filter(F.transform("items", lambda x: x["ref"]), lambda r: r.isNotNull()).alias("refs")).where(F.size("refs") > 0), "text-refs", buckets)
        rows = rows.join(led_to(asked, refs, buckets, rounds), ["g", "node"])

    def settled(rows: DataFrame) -> DataFrame:
        """rows (g, node, asked, rule, items) with the text of those whose items tell it."""
        rule_, texts = F.col("rule"), F.transform("items", lambda x: x["text"])
        telling = F.try_element_at(F.filter(texts, lambda t: t.isNull() | (t != "")), F.lit(1))
        all_known = ~F.exists(texts, lambda t: t.isNull())
        told = F.transform(F.filter(texts, lambda t: F.trim(t) != ""), lambda t: F.when(rule_["clean"], F.trim(t)).otherwise(t))
        source = first(texts)
        value = F.when(rule_["how"] == "join", F.when(all_known, F.call_function("array_join", told, rule_["between"]))).when(rule_["how"] == "replace", F.when(rule_["find"] == "", source).otherwise(F.replace(source, rule_["find"], rule_["put"])))
        blank = F.when(F.size(F.filter(texts, lambda t: t.isNull() | (t != ""))) == 0, "")
        out = rows.withColumn("text", F.coalesce("text", value.when(rule_["how"] == "first", F.coalesce(telling, blank))))
        return out.withColumn("items", F.when(F.col("text").isNull(), F.col("items")))

    state = kept(settled(rows.withColumn("text", F.lit(None).cast("string"))).withColumn("fresh", F.col("text").isNotNull()), "text-round", buckets)
    for _ in range(rounds):
        if state.where("fresh").isEmpty() or state.where("text is null").isEmpty():
            break
        theirs = state.where("fresh").select("g", F.col("node").alias("ref"), F.col("text").alias("read"))
        left = state.where("asked or text is null").select("g", "node", "asked", "rule", F.col("text").alias("own"), F.explode_outer("items").alias("p")).select("g", "node", "asked", "rule", "own", "p.*")
        read = left.join(theirs, ["g", "ref"], "left").groupBy("g", "node").agg(
            F.max("asked").alias("asked"), F.first("rule").alias("rule"), F.first("own").alias("text"), F.array_sort(F.collect_list(F.struct("j", "ref", F.coalesce("text", "read").alias("text")))).alias("items")
        )
        before = F.col("text").isNotNull()
        state = kept(settled(read.withColumn("before", before)).withColumn("fresh", ~F.col("before") & F.col("text").isNotNull()).drop("before"), "text-round", buckets)
    rest = state.where("asked").withColumn("items", F.transform("items", lambda x: F.struct(x["j"].alias("j"), x["ref"].alias("ref"), F.coalesce(x["text"], F.lit("")).alias("text"))))
    return settled(rest).select("g", "node", "text")


def savers_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that take a picture or sound and hand nothing on, or say that they save."""
    read = links.select("g", F.col("to").alias("node"), F.lit(True).alias("read")).distinct()
    takes = F.exists("vals", lambda x: x["to"].isNotNull() & (rank(x["low"]) <= RELAY))
    return nodes.where(~F.col("samples") & takes).join(read, ["g", "node"], "left").where(F.col("read").isNull() | any_of(F.col("low"), "save", "write", "export"))


def loras_of(nodes: DataFrame) -> DataFrame:
    """(g, loras): the adapters that a graph applies, in order, each name once; those switched off are left out."""
    fields = ", ".join(f"{k} string" for k in dict.fromkeys((*LORA_PATH_KEYS, *LORA_STRENGTH_KEYS, *LORA_SWITCHES)))
    inner = lambda c: F.when(c.startswith("{"), F.coalesce(*(F.from_json(c, "__value__ string, value string, loras string")[k] for k in ("__value__", "value", "loras")))).otherwise(c)
    n = nodes.where(F.col("low").contains("lora")).select("g", "at", "low", "vals")
    own = n.where(val(F.col("vals"), "lora_name")["str"].isNotNull())
    strength = F.coalesce(*(F.coalesce(val(F.col("vals"), k)["num"], val(F.col("vals"), k)["str"]) for k in ("strength_model", "strength")))
    plain = own.select("g", "at", F.lit(0).alias("i"), F.lit(0).alias("j"), val(F.col("vals"), "lora_name")["str"].alias("path"), strength.alias("strength"))
    held = n.where(val(F.col("vals"), "lora_name")["str"].isNull()).select("g", "at", F.col("low").contains("power lora loader").alias("numbered"), F.posexplode("vals").alias("i", "v"))
    listed = F.coalesce(F.col("v.js"), F.when(F.col("v.str").rlike(r'^\s*[\[{]'), F.trim("v.str")))
    entries = F.when(F.col("numbered"), F.when(F.col("v.key").startswith("lora_"), F.array("v.js"))).otherwise(F.from_json(inner(inner(listed)), "array<string>"))
    each = held.select("g", "at", "i", "numbered", F.posexplode(entries).alias("j", "entry")).withColumn("e", F.from_json("entry", fields))
    off = lambda c: F.lower(c).isin("false", "0", "")
    on = reduce(lambda a, b: a & b, (F.coalesce(~off(F.col(f"e.{k}")), F.lit(True)) for k in LORA_SWITCHES)) & (~F.col("numbered") | F.col("e.on").isNotNull())
    stacked = each.where(on).select("g", "at", "i", "j", F.coalesce(*(F.when(F.col(f"e.{k}") != "", F.col(f"e.{k}")) for k in LORA_PATH_KEYS)).alias("path"), F.coalesce(*(F.col(f"e.{k}") for k in LORA_STRENGTH_KEYS)).alias("strength"))
    every = plain.union(stacked).where("path is not null").select("g", F.struct("at", "i", "j").alias("place"), bare(F.col("path")).alias("name"), F.col("strength").try_cast("double").alias("strength"))
    once = every.groupBy("g", "name").agg(F.min_by(F.struct("place", "strength"), "place").alias("x"))
    return once.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.place", "name", "x.strength"))), lambda x: F.struct(x["name"].alias("name"), x["strength"].alias("strength"))).alias("loras"))


def knobs_of(nodes: DataFrame, links: DataFrame, walks: DataFrame, prompts: DataFrame) -> DataFrame:
    """(g, steps, cfg, sampler_name, scheduler, seed) of the sampler that no other feeds, or of the nodes right before it."""
    fed = walks.where("walk = 'fed'").select("g", F.col("start").alias("node"), F.lit(True).alias("fed"))
    said = prompts.where("key = 'positive'").select("g", F.col("start").alias("node"), F.length("value").alias("chars"))
    samplers = nodes.where("samples").join(fed, ["g", "node"], "left").join(said, ["g", "node"], "left")
    order = F.when(F.col("fed").isNull(), F.struct(F.lit(0).alias("a"), F.length("node").alias("b"), F.col("node").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), (-F.coalesce("chars", F.lit(0))).alias("b"), F.lpad(F.col("at").cast("string"), 9, "0").alias("c")))
    base = samplers.groupBy("g").agg(F.min_by("node", order).alias("base"))
    near = base.join(links, (links["g"] == base["g"]) & (links["node"] == base["base"])).select(base["g"], F.col("to").alias("node"), (F.col("i") + 1).alias("far"))
    asked = base.select("g", F.col("base").alias("node"), F.lit(0).alias("far")).union(near)
    literal = nodes.select("g", "node", F.explode("vals").alias("v")).where(F.col("v.key").isin(*NUMBERS, *NAMES)).select("g", "node", "v.key", F.when(F.col("v.key").isin(*NUMBERS), as_number(F.col("v"))).otherwise(F.col("v.str")).alias("value"))
    behind = walks.where((F.col("walk") == "number") & F.col("key").isin(*NUMBERS) | (F.col("walk") == "name") & F.col("key").isin(*NAMES)).select("g", F.col("start").alias("node"), "key", "value")
    every = asked.join(literal.where("value is not null").union(behind), ["g", "node"]).where("far = 0 or key <> 'seed'").withColumn("name", F.when(F.col("key") == "noise_seed", "seed").otherwise(F.col("key"))).withColumn("place", F.struct("far", (F.col("key") == "noise_seed").alias("second")))
    least = lambda name, most: F.min_by(F.when((F.col("name") == name) & (F.col("far") <= most), F.col("value")), F.when((F.col("name") == name) & (F.col("far") <= most), F.col("place")))
    wide, own = ({k: least(k, most) for k in ("steps", "cfg", "sampler_name", "scheduler", "seed")} for most in (1 << 30, 0))
    both = every.groupBy("g").agg(F.struct(*(c.alias(k) for k, c in wide.items())).alias("wide"), F.struct(*(c.alias(k) for k, c in own.items())).alias("own"))
    out = both.select("g", F.when(F.col("own.steps").isNotNull() & F.col("own.sampler_name").isNotNull() & F.col("own.seed").isNotNull(), F.col("own")).otherwise(F.col("wide")).alias("k")).select("g", "k.*")
    whole = lambda c: F.coalesce(F.col(c).try_cast("decimal(20,0)"), F.col(c).try_cast("double").try_cast("decimal(20,0)"))
    return out.select("g", whole("steps").try_cast("int").alias("steps"), F.col("cfg").try_cast("double").alias("cfg"), "sampler_name", "scheduler", whole("seed").alias("seed"))


def prompts_of(nodes: DataFrame, links: DataFrame, walks: DataFrame, said: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Where the conditioning of each sampler leads, key positive or negative; and (g, node, encoded) of encoders."""
    t = lambda k: F.try_element_at("said", F.lit(k))
    pair = F.when(F.coalesce(t("text_l"), F.lit("")).isin("") | (t("text_l") == t("text_g")), t("text_g")).otherwise(F.concat_ws("\n", t("text_g"), t("text_l")))
    encoded = F.when(t("text").isNotNull(), t("text")).when(t("text_g").isNotNull(), pair).otherwise(t("wildcard_text"))
    encodes = any_of(F.col("low"), "textencode", "cliptext") | has(F.col("vals"), "text_g", "wildcard_text")
    shown = F.when(F.col("kind") == "ConditioningZeroOut", "").when(encodes & (encoded != ""), encoded)
    encoders = nodes.join(said, ["g", "node"], "left").select("g", "node", "at", "kind", encoded.alias("encoded"), shown.alias("shown"))
    there = encoders.select("g", F.col("node").alias("to"), F.when(F.col("shown").isNotNull(), "@").alias("shown"))  # the walk carries no texts
    turn = F.coalesce(place(F.col("key"), PROMPT_KEYS), F.lit(99))
    edges = links.where(~F.col("key").isin(*NO_PROMPT_KEYS)).join(there, ["g", "to"]).select("g", F.lit("prompt").alias("walk"), "node", "to", "key", turn.alias("rank"), F.lit(0).alias("cost"), F.col("shown").alias("found"))
    asked = walks.where("walk = 'guider'").select("g", F.col("start").alias("sampler"), F.col("value").alias("node")).join(nodes.select("g", "node", "vals"), ["g", "node"])
    vals = F.col("vals")
    two = has(vals, "positive", "negative")
    sides = F.array(F.struct(F.lit("positive").alias("side"), F.when(two, val(vals, "positive")).otherwise(val(vals, "conditioning")).alias("v")), F.struct(F.lit("negative").alias("side"), F.when(two, val(vals, "negative")).alias("v")))
    ask = asked.select("g", "sampler", F.explode(sides).alias("s")).select("g", "sampler", "s.side", F.col("s.v.str").alias("str"), F.col("s.v.to").alias("to")).where("str is not null or to is not null").join(there, ["g", "to"], "left")
    ends = reach(ask.select(*start("prompt", F.col("sampler"), F.coalesce("to", F.lit("")), F.coalesce(F.concat(F.lit("="), "str"), "shown"), F.col("side"))), edges, buckets)
    read = ends.join(encoders.select("g", "node", "shown"), ["g", "node"], "left").withColumn("value", F.when(F.col("value") == "@", F.col("shown")).otherwise(F.substring("value", 2, 1 << 30)))
    return read.drop("shown"), encoders


def graph_facts(graphs: DataFrame, buckets: int) -> DataFrame:
    """graphs (g, graph; dealt over the buckets): a row for each graph with nodes, with what holds for all of its files and what its savers and samplers have."""
    with store.local_joins(graphs.sparkSession):
        return _graph_facts(graphs, buckets)


def _graph_facts(graphs: DataFrame, buckets: int) -> DataFrame:
    nodes = kept(nodes_of(graphs), "graph-nodes", buckets)
    links = kept(links_of(nodes), "graph-links", buckets)
    savers = kept(savers_of(nodes, links), "graph-savers", buckets)
    walks = structure(nodes, links, savers, buckets)
    wanted = ("text", "text_g", "text_l", "wildcard_text", "caption", "style", "lyrics")
    named = nodes.select("g", "node", F.explode("vals").alias("v")).where(F.col("v.key").isin(*wanted) | F.col("v.low").isin(*FILE_KEYS)).select("g", "node", "v.key", "v.low", "v.str", F.col("v.to").alias("to"))
    texts = texts_of(nodes, walks, buckets, named.where("to is not null").select("g", F.col("to").alias("node")))
    named = named.join(texts.withColumnRenamed("node", "to"), ["g", "to"], "left").select("g", "node", "key", "low", F.coalesce("str", "text", F.lit("")).alias("text"))
    said = kept(named.groupBy("g", "node").agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isin(*wanted), F.struct("key", "text")))).alias("said"), F.collect_list(F.when(F.col("low").isin(*FILE_KEYS) & (F.trim("text") != ""), F.col("text"))).alias("names")), "graph-said", buckets)
    prompts, encoders = prompts_of(nodes, links, walks, said, buckets)

    marked = nodes.where(F.col("low").contains("lora") & (F.trim(val(F.col("vals"), "text")["str"]) != "")).groupBy("g").agg(F.collect_set(F.trim(val(F.col("vals"), "text")["str"])).alias("kept"))
    own = prompts.join(marked, "g", "left").withColumn("value", F.when(F.col("value").contains("127.0.0.1:8188/loras") | F.coalesce(F.exists("kept", lambda t: F.contains(F.trim("value"), t)), F.lit(False)), "").otherwise(F.col("value")))
    sides = own.groupBy("g", F.col("start").alias("node")).agg(F.max(F.when(F.col("key") == "positive", F.col("value"))).alias("positive"), F.max(F.when(F.col("key") == "negative", F.col("value"))).alias("negative"))
    model = walks.where("walk = 'model'").select("g", F.col("start").alias("node"), F.col("value").alias("model"))
    samplers = nodes.where("samples").select("g", "at", "node").join(sides, ["g", "node"], "left").join(model, ["g", "node"], "left")
    samplers = samplers.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "node", F.coalesce("positive", F.lit("")).alias("positive"), F.coalesce("negative", F.lit("")).alias("negative"), "model"))).alias("samplers"))

    source = walks.where("walk = 'source'").select("g", F.col("start").alias("node"), F.col("value").alias("sampler"), F.transform("order.way", lambda w: w["node"]).alias("way"))
    lows = F.transform(F.filter("vals", lambda x: x["to"].isNotNull()), lambda x: x["low"])
    takes = lambda *keys: F.arrays_overlap(lows, F.array(*map(F.lit, keys)))
    sound, picture = takes("audio", "audio_in"), takes("images", "image", "img", "frames", "video_frames")
    payload = F.when(takes("video", "frames") | (sound & picture), "video").when(sound, "audio").when(picture, "image")
    literals = F.transform(F.filter("vals", lambda x: F.trim(x["str"]) != ""), lambda x: F.lower(F.trim(x["str"])))
    ends = savers.select("g", "node", F.length("node").alias("chars"), payload.alias("payload"), literals.alias("literals")).join(said.select("g", "node", "names"), ["g", "node"], "left").join(source, ["g", "node"], "left")
    ends = ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("chars", "node", "payload", "literals", F.coalesce("names", F.expr("cast(array() as array<string>)")).alias("names"), "sampler", "way"))).alias("savers"))

    vae = walks.where("walk = 'vae'").select("g", F.col("start").alias("node"), F.col("value").alias("vae"))
    quiet = ~F.col("low").contains("audio")
    decoders = nodes.where("decodes").join(vae, ["g", "node"], "left").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "node", quiet.alias("quiet"), "vae"))).alias("decoders"))
    loaders = nodes.groupBy("g").agg(F.min_by("model_file", F.when(F.col("model_file").isNotNull(), F.col("at"))).alias("any_model"), F.min_by("vae_file", F.when(quiet & F.col("vae_file").isNotNull(), F.col("at"))).alias("any_vae"))
    longest = lambda c, at: F.max_by(c, F.when(F.length(c) > 0, F.struct(F.length(c).alias("n"), (-at).alias("at"))))
    clips = encoders.where(F.col("kind").contains("CLIPTextEncode")).groupBy("g").agg(longest(F.col("encoded"), F.col("at")).alias("clip"))
    t = lambda k: F.trim(F.try_element_at("said", F.lit(k)))
    songs = said.join(nodes.select("g", "node", "at"), ["g", "node"]).groupBy("g").agg(F.coalesce(longest(t("caption"), F.col("at")), longest(t("style"), F.col("at"))).alias("caption"), longest(t("lyrics"), F.col("at")).alias("lyrics"))
    # steps of their own, without the long texts: one plan of all of them takes much of the driver's memory
    small = [kept(dealt(part, buckets), name, buckets) for name, part in (("graph-loras", loras_of(nodes)), ("graph-knobs", knobs_of(nodes, links, walks, prompts)))]
    ways = kept(loaders.join(ends, "g", "left").join(decoders, "g", "left"), "graph-ways", buckets)
    return kept(reduce(lambda a, b: a.join(b, "g", "left"), [samplers, clips, songs, *small], ways), "graph-facts", buckets)


def saver_of(savers: Column, filename: Column, stage: Column) -> Column:
    """Which node wrote the file. Each kind of evidence only narrows: the name's start, the stage, what it takes, that it names files."""
    stem, ext = F.lower(bare(filename)), F.regexp_extract(F.lower(filename), r"\.[^.]*$", 0)
    tails = lambda s: F.transform(s["names"], lambda n: F.element_at(F.split(n, r"[\\/]"), -1))
    start_of = lambda s: F.array_max(F.concat(F.array(F.lit(0)), F.transform(tails(s), lambda t: F.when((F.length(t) >= 3) & stem.startswith(F.lower(t)), F.length(t)).otherwise(0))))
    kind = F.when(ext == "", None).when(ext.isin(*AUDIO_FILES), "audio").when(ext.isin(*VIDEO_FILES), "video").otherwise("image")
    tests = (lambda s: (F.trim(stage) != "") & F.array_contains(s["literals"], F.lower(F.trim(stage))), lambda s: s["payload"] == kind, lambda s: (F.size(s["names"]) > 0) | (F.size(s["literals"]) > 0))
    narrow = lambda left, holds: let(left, lambda x: let(F.filter(x, holds), lambda some: F.when(F.size(some) > 0, some).otherwise(x)))
    alone = lambda x: F.when(F.size(x) == 1, first(x))
    named = let(F.array_max(F.transform(savers, start_of)), lambda best: F.when(best > 0, first(F.filter(savers, lambda s: start_of(s) == best))))
    return F.coalesce(alone(savers), named, let(reduce(narrow, tests, savers), alone))


TYPES = dict(column.split(" ") for column in f"{settings_text.SCHEMA}, model string, lyrics string, method string".split(", "))
FACTS = tuple(TYPES)


def facts(files: DataFrame, key: str) -> DataFrame:
    """files (key, graph, filename, stage; all but the key may be null): what the graph says of each file that has one.

    Equal graphs are walked once. Columns: those of settings texts, with model, lyrics and method.
    """
    asked = files.where("graph is not null").select(F.col(key), F.unhex(F.sha2("graph", 256)).alias("g"), "graph", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("stage", F.lit("")).alias("stage"))
    asked = store.written(asked, "graph-files")
    if asked.isEmpty():
        return asked.select(key, *(F.lit(None).cast(t).alias(n) for n, t in TYPES.items()))
    chars = asked.agg(F.sum(F.length("graph"))).first()[0]
    buckets = max(asked.sparkSession.sparkContext.defaultParallelism, -(-chars // BUCKET_CHARS))
    known = graph_facts(dealt(asked.select("g", "graph"), buckets).groupBy("g").agg(F.first("graph").alias("graph")), buckets)
    rows = asked.drop("graph").join(known.hint("merge"), "g")  # facts hold texts: no broadcast
    sound = reduce(lambda a, b: a | b, (F.lower("filename").endswith(x) for x in AUDIO_FILES))
    rows = rows.withColumn("savers", F.coalesce("savers", F.expr("filter(savers, x -> false)"))).withColumn("saver", saver_of(F.col("savers"), F.col("filename"), F.col("stage")))
    able = F.filter("savers", lambda s: s["sampler"].isNotNull())
    agreed = F.when(F.size(F.array_distinct(F.transform(able, lambda s: s["sampler"]))) == 1, F.element_at(able, -1))
    rows = rows.withColumn("told", F.when(F.col("saver.sampler").isNotNull(), F.col("saver")).otherwise(agreed)).withColumn("how", F.when(F.col("saver.sampler").isNotNull(), "saver-walk").when(F.col("told").isNotNull(), "saver-walk-agreed"))
    mine = first(F.filter("samplers", lambda s: s["node"] == F.col("told.sampler")))
    most = F.array_max(F.transform("samplers", lambda s: F.length(s["positive"])))
    rows = rows.withColumn("mine", mine).withColumn("mine", F.when((F.col("mine.positive") != "") | F.col("mine.model").isNotNull(), F.col("mine")))
    rows = rows.withColumn("best", F.coalesce("mine", first(F.filter("samplers", lambda s: F.length(s["positive"]) == most))))
    how = F.when(F.col("mine").isNotNull(), F.col("how")).when(F.col("best").isNotNull(), "sampler-trace")
    filled = F.coalesce("best.positive", F.lit("")) != ""
    positive, method = F.when(filled, F.col("best.positive")).otherwise(F.col("clip")), F.when(filled, how).when(F.col("clip").isNotNull(), "longest-clip-fallback").otherwise(how)
    song = sound & F.col("caption").isNotNull()
    decoder = first(F.filter(F.col("told.way"), lambda n: F.exists("decoders", lambda d: (d["node"] == n) & (d["quiet"] | sound))))
    vae = F.coalesce(first(F.filter("decoders", lambda d: (d["node"] == decoder) & d["vae"].isNotNull()))["vae"], first(F.filter("decoders", lambda d: d["quiet"] & d["vae"].isNotNull()))["vae"], F.col("any_vae"))
    model, blank = F.coalesce("best.model", "any_model"), lambda c: F.when(c != "", c)
    rows = rows.withColumn("positive", F.when(song, F.col("caption")).otherwise(positive))
    negative = F.when(~F.col("best.negative").eqNullSafe(F.col("positive")), F.col("best.negative"))
    return rows.select(
        key, blank(F.col("positive")).alias("positive"), blank(negative).alias("negative"), bare(model).alias("model_name"), bare(vae).alias("vae_name"), F.coalesce("loras", F.expr(f"cast(array() as {settings_text.LORAS})")).alias("loras"), "steps", "cfg", "sampler_name", "scheduler", "seed",
        model.alias("model"), F.when(sound, F.col("lyrics")).alias("lyrics"), F.when(song, "audio-caption").otherwise(method).alias("method"),
    )


def file_facts(files: DataFrame, key: str) -> DataFrame:
    """files (key, graph, block, sidecar, filename, stage): (key, facts), blanks of the first source filled by the next.

    An image's graph comes before its settings text, a video's side text before its graph. Words that stand for
    nothing fill no blank.
    """
    rows = files.join(facts(files, key).select(key, F.struct(*FACTS).alias("by_graph")), key, "left")
    read = lambda c: settings_text.settings_of(F.coalesce(F.col(c), F.lit("")))
    rows = rows.withColumn("by_block", read("block")).withColumn("by_side", read("sidecar"))
    video = reduce(lambda a, b: a | b, (F.coalesce(F.lower("filename").endswith(x), F.lit(False)) for x in vocab.VIDEO_EXTENSIONS)) & (F.coalesce("sidecar", F.lit("")) != "")

    def some(source: str, name: str) -> Column:
        c = F.col(f"{source}.{name}")
        return F.when(F.size(c) > 0, c) if name == "loras" else F.when(c != "", c) if name in ("positive", "negative", "model_name", "vae_name", "sampler_name", "scheduler") else c

    def more(source: str, name: str) -> Column:
        c = some(source, name)
        return F.when(~F.lower(F.trim(c)).isin(*settings_text.PLACEHOLDERS), c) if name in ("positive", "negative", "model_name", "vae_name", "sampler_name", "scheduler") else c

    def pick(name: str) -> Column:
        if name in ("model", "lyrics", "method"):
            return F.col(f"by_graph.{name}")
        found = F.when(video, F.coalesce(some("by_side", name), more("by_graph", name))).otherwise(F.coalesce(some("by_graph", name), more("by_block", name), more("by_side", name)))
        return F.coalesce(found, F.expr(f"cast(array() as {settings_text.LORAS})")) if name == "loras" else found

    told = F.struct(*(pick(name).alias(name) for name in FACTS))
    any_text = reduce(lambda a, b: a | b, (F.col(f"told.{n}").isNotNull() for n in FACTS if n != "loras")) | (F.size("told.loras") > 0)
    rows = rows.withColumn("told", told).withColumn("method", F.when(any_text, F.coalesce("told.method", F.lit("settings-text"))))
    return rows.select(key, F.struct(*(F.col(f"told.{n}") for n in FACTS[:-1]), "method").alias("facts"))
