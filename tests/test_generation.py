"""Settings texts and workflow graphs, one rule at a time."""

import json

import pytest
from pyspark.sql import functions as F

from pelagia.functions import settings_text
from pelagia.operators import workflow


def test_settings_text():
    found = settings_text.parse('a cat, (dog:1.2) <lora:fur:0.7>\nsecond <LORA:eyes>\nNegative prompt: bad\nhands\nSteps: 20.0, Sampler: DPM++ 2M Karras, CFG scale: 7.5, Seed: 18446744073709551615, VAE: v/fine.pt, Lora hashes: "a: 1, b: 2", Model: m')
    assert found["positive"] == "a cat, (dog:1.2) \nsecond" and found["negative"] == "bad\nhands"
    assert found["loras"] == [("fur", 0.7), ("eyes", None)] and found["seed"] == 18446744073709551615
    assert (found["steps"], found["cfg"], found["sampler_name"], found["scheduler"]) == (20, 7.5, "DPM++ 2M", "karras")
    assert (found["vae_name"], found["model_name"]) == ("fine", "m")


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_blank_settings(text):
    assert settings_text.parse(text) == {}


def test_last_lines_that_are_no_settings_stay_in_the_prompt():
    assert settings_text.parse("one\nlighting: dramatic, mood: calm") == {"positive": "one\nlighting: dramatic, mood: calm"}
    assert settings_text.parse("Negative prompt: only this") == {"negative": "only this"}
    assert settings_text.parse("x\nSampler: Euler a") == {"positive": "x", "sampler_name": "Euler a"}


def test_resource_lists():
    items = [{"type": "checkpoint", "modelName": "Big [one], v2"}, {"type": "lora", "modelName": "fur", "weight": 0.4}, {"type": "vae", "modelName": "fine"}, {"type": "embed", "modelName": "e"}, 5]
    found = settings_text.parse(f"p\nSteps: 5, Civitai resources: {json.dumps(items)}, Size: 1x1")
    assert (found["model_name"], found["vae_name"], found["loras"], found["steps"]) == ("Big [one], v2", "fine", [("fur", 0.4)], 5)
    assert settings_text.parse(f"p\nModel: m, Civitai resources: {json.dumps(items)}")["model_name"] == "m"
    assert settings_text.parse(f"p\nCivitai resources: {json.dumps(items)}")["positive"] == "p"
    assert settings_text.parse("p\nSteps: 5, Civitai resources: [{broken")["steps"] == 5


def test_blanks_are_filled_and_placeholders_are_not():
    assert settings_text.filled({"positive": "a", "model_name": None}, {"positive": "b", "model_name": "Unknown", "seed": 0}) == {"positive": "a", "seed": 0}


def node(kind, **inputs):
    return {"class_type": kind, "inputs": inputs}


def simple(**more):
    return {
        "1": node("CheckpointLoaderSimple", ckpt_name="m/base.safetensors"), "2": node("CLIPTextEncode", text="a cat", clip=["1", 1]), "3": node("CLIPTextEncode", text="bad", clip=["1", 1]),
        "4": node("KSampler", model=["1", 0], positive=["2", 0], negative=["3", 0], latent_image=["5", 0], steps=20, cfg=7.5, seed=2**64 - 1, sampler_name="euler", scheduler="karras"),
        "5": node("EmptyLatentImage", width=8), "6": node("VAEDecode", samples=["4", 0], vae=["1", 2]), "7": node("SaveImage", images=["6", 0], filename_prefix="out"),
    } | more


def two_savers(**more):
    """A first picture and one that a second stage makes of it."""
    return simple(**{
        "8": node("CLIPTextEncode", text="closer, much longer prompt"), "9": node("KSampler", model=["12", 0], positive=["8", 0], negative=["3", 0], latent_image=["4", 0], steps=4, seed=1), "10": node("VAEDecode", samples=["9", 0], vae=["13", 0]), "11": node("SaveImage", images=["10", 0], filename_prefix="sub/late", stage="Final"),
        "12": node("UNETLoader", unet_name="second.gguf"), "13": node("VAELoader", vae_name="fine.pt"),
    }) | more


def sampler(**changed):
    return node("KSampler", **(simple()["4"]["inputs"] | changed))


CHAIN = {"20": node("FluxGuidance", conditioning=["21", 0], guidance=3), "21": node("ConditioningCombine", b=["22", 0], clip=["23", 0]), "22": node("CLIPTextEncodeSDXL", text_g="big", text_l="small"), "23": node("Lora Loader (LoraManager)", text="Go to http://127.0.0.1:8188/loras"), "30": node("ConditioningZeroOut", conditioning=["22", 0]), "4": sampler(positive=["20", 0], negative=["30", 0])}
GUIDED = {"4": node("SamplerCustomAdvanced", guider=["10", 0], latent_image=["5", 0], noise=["11", 0], sampler=["12", 0], sigmas=["13", 0]), "10": node("CFGGuider", model=["1", 0], positive=["2", 0], negative=["3", 0], cfg=3), "11": node("RandomNoise", noise_seed=7), "12": node("KSamplerSelect", sampler_name="heun"), "13": node("BasicScheduler", steps=9, scheduler="simple", model=["1", 0])}
CONFIG = {"10": node("KSampler Config", steps_total=30, refiner=24, cfg=4.5, sampler_name="dpmpp_2m", scheduler="beta"), "11": node("mxSlider", Xi=3, Xf=3.5, isfloatX=1), "4": sampler(steps=["10", 0], cfg=["10", 2], sampler_name=["10", 3], scheduler=["10", 4])}
ADAPTERS = dict(
    a=node("LoraLoader", lora_name="x\\one.safetensors", strength_model=0.5), b=node("Power Lora Loader (rgthree)", lora_1={"on": True, "lora": "two.safetensors", "strength": 1}, lora_2={"on": False, "lora": "off.safetensors"}),
    c=node("LTX_lora_loader", stack_data=json.dumps([{"lora": "three.safetensors", "str": 0.2}, {"lora": "gone", "on": False}])), d=node("Lora Manager", loras={"__value__": [{"name": "four", "strength": "0.9", "active": True}, {"name": "five", "active": False}]}), e=node("LoraLoader", lora_name="one.ckpt", strength_model=9),
)
MOVIE = {"11": node("VHS_VideoCombine", images=["10", 0], audio=["14", 0], prefix="renamed"), "14": node("LoadAudio", x=1)}
SONG = {"20": node("MusicEncode", caption=["21", 0], lyrics="la la", style="a longer style than the caption is"), "21": node("String", value="calm piano")}
LONG = {str(100 + i): node("Reroute", any=[str(101 + i), 0]) for i in range(9)} | {"109": node("CLIPTextEncode", text="far away"), "4": sampler(positive=["100", 0])}

CASES = {
    "simple": (simple(),), "chain": (simple(**CHAIN),), "note": (simple(**CHAIN, **{"24": node("Note", text="not a prompt", other=["22", 0])}) | {"20": node("FluxGuidance", conditioning=["24", 0])},), "guided": (simple(**GUIDED),), "config": (simple(**CONFIG),), "slider": (simple(**CONFIG | {"4": sampler(cfg=["11", 9])}),), "adapters": (simple(**ADAPTERS),),
    "early": (two_savers(), "out_0001.png"), "late": (two_savers(), "late_0001.png"), "stage": (two_savers(), "renamed.png", "final"), "unknown": (two_savers(), "renamed.png"), "movie": (two_savers(**MOVIE), "other.mp4"), "picture": (two_savers(**MOVIE), "other.png"),
    "relays": (simple(**{"20": node("Context (rgthree)", model=["21", 0], images=["6", 0]), "21": node("Weird", latent=["22", 0]), "22": node("KSampler", positive="wrong", latent_image=["5", 0], steps=1), "7": node("SaveImage", any_01=["20", 0])}),),
    "odd_loader": (simple(**{"1": node("NF4 Model Loader", model_name="odd.sft"), "30": node("UpscaleModelLoader", model_name="4x.pth")}),), "no_loader": (simple(**{"1": node("Nothing"), "30": node("UpscaleModelLoader", model_name="4x.pth")}),),
    "vae": (simple(**{"14": node("WanVideoVAELoader", model_name="w/wan_vae.safetensors"), "15": node("LTXVAudioVAELoader", ckpt_name="sound.safetensors")}),), "song": (two_savers(**SONG), "song_1.flac"), "no_song": (two_savers(**SONG), "out_1.png"),
    "agreed": (simple(**{"20": node("SaveImage", images=["6", 0], filename_prefix="twin")}), "renamed.png"), "shared": (simple(), "x.png"), "twice": (simple(), "x.png"), "long": (simple(**LONG),),
    "fed_by_each_other": (simple(**{"4": sampler(latent_image=["9", 0]), "9": sampler(latent_image=["4", 0], positive=["3", 0], steps=5)}),),
}
DAMAGED = {"null": None, "empty": "", "cut": "{", "list": "[]", "number": "5", "no_node": '{"a": 1}', "odd_node": '{"1": {"class_type": null, "inputs": [1]}}', "cycle": '{"1": {"class_type": "KSampler", "inputs": {"positive": ["1", 0], "model": ["1", 0], "latent_image": ["1", 0]}}}', "repeated_key": '{"1": {"class_type": "A", "class_type": "B", "inputs": {"x": 1, "x": 2}}}'}


@pytest.fixture(scope="module")
def told(spark):
    """What each case's graph says, all of them walked together."""
    rows = [(name, json.dumps(c[0]), *(list(c[1:]) + [None, None])[:2]) for name, c in CASES.items()] + [(name, text, None, None) for name, text in DAMAGED.items()]
    files = spark.createDataFrame(rows, "name string, graph string, filename string, stage string")
    found = [r.asDict(recursive=True) for r in workflow.facts(files, "name").collect()]
    assert len(found) == len({r["name"] for r in found})
    return {r["name"]: {k: v for k, v in r.items() if v is not None and v != []} for r in found}


def test_simple_graph(told):
    found = told["simple"]
    assert (found["positive"], found["negative"], found["model"], found["model_name"], found["method"]) == ("a cat", "bad", "m/base.safetensors", "base", "saver-walk")
    assert (found["steps"], found["cfg"], found["seed"], found["sampler_name"], found["scheduler"]) == (20, 7.5, 2**64 - 1, "euler", "karras")
    assert "vae_name" not in found and "loras" not in found
    assert {k: v for k, v in told["shared"].items() if k != "name"} == {k: v for k, v in told["twice"].items() if k != "name"} == {k: v for k, v in found.items() if k != "name"}


@pytest.mark.parametrize("name", DAMAGED)
def test_damaged_and_cyclic_graphs(told, name):
    assert not set(told.get(name, {})) - {"method", "name"}


def test_strings(spark):
    nodes = {
        "1": node("CR Text Input Switch", Input=["8", 0], text1="one", text2=["2", 0]), "2": node("StringConcatenate", string_b="b ", string_a=["3", 0], delimiter="-", clean_whitespace="true"),
        "3": node("StringReplace", string=["4", 0], find="x", replace="y"), "4": node("Reroute", anything=["5", 0]), "5": node("String", value="x x"), "8": node("Int", value=2),
        "9": node("Text Switch", boolean="false", text_a="no", text_b="yes"), "10": node("Reroute", v=["10", 0]), "11": node("Reroute", v=["none", 0]), "12": node("Join Concat", a=["10", 0], b="kept"),
    }
    graphs = spark.createDataFrame([("g", json.dumps(nodes))], "g string, graph string")
    rows = workflow.nodes_of(graphs).cache()
    links = workflow.links_of(rows)
    texts = {r["node"]: r["text"] for r in workflow.texts_of(rows, workflow.structure(rows, links, workflow.savers_of(rows, links))).collect()}
    rows.unpersist()
    assert {k: texts[k] for k in ("1", "9", "10", "11", "12")} == {"1": "y y-b", "9": "yes", "10": "", "11": "", "12": "kept"}


def test_prompts_are_taken_from_encoders_only(told):
    assert told["chain"]["positive"] == "big\nsmall" and "negative" not in told["chain"]
    assert told["note"]["positive"] == "big\nsmall"  # a text beside the way is no prompt
    assert told["long"]["positive"] == "far away"


def test_guiders_and_split_samplers(told):
    found = told["guided"]
    assert (found["positive"], found["negative"], found["model_name"]) == ("a cat", "bad", "base")
    assert (found["steps"], found["seed"], found["sampler_name"], found["scheduler"], found["cfg"]) == (9, 7, "heun", "simple", 3)


def test_outputs_of_settings_nodes_count_in_the_order_of_their_inputs(told):
    found = told["config"]
    assert (found["steps"], found["cfg"], found["sampler_name"], found["scheduler"]) == (30, 4.5, "dpmpp_2m", "beta")
    assert told["slider"]["cfg"] == 3.5


def test_adapters(told):
    assert [(x["name"], x["strength"]) for x in told["adapters"]["loras"]] == [("one", 0.5), ("two", 1), ("three", 0.2), ("four", 0.9)]


def test_each_file_is_told_by_its_own_saver(told):
    assert told["early"]["positive"] == "a cat"
    late = told["late"]
    assert (late["positive"], late["model_name"], late["vae_name"], late["steps"]) == ("closer, much longer prompt", "second", "fine", 20)  # settings are the first stage's
    assert told["stage"]["model_name"] == "second"
    assert told["unknown"]["method"] == "sampler-trace" and told["unknown"]["positive"] == "closer, much longer prompt"
    assert told["agreed"]["method"] == "saver-walk-agreed" and told["agreed"]["positive"] == "a cat"


def test_samplers_that_feed_each_other(told):
    assert told["fed_by_each_other"]["steps"] == 20  # the one with the longer prompt


def test_kinds_of_files_choose_among_savers(told):
    assert told["movie"]["model_name"] == "second" and told["picture"]["model_name"] == "base"


def test_relays_lead_to_the_picture_before_the_model(told):
    assert told["relays"]["positive"] == "a cat"


def test_models_of_unknown_loaders_and_of_none(told):
    assert told["odd_loader"]["model_name"] == "odd" and "model" not in told["no_loader"]


def test_vae_of_a_loader_by_its_class(told):
    assert told["vae"]["vae_name"] == "wan_vae"


def test_songs_take_their_caption_and_words(told):
    found = told["song"]
    assert (found["positive"], found["lyrics"], found["method"]) == ("calm piano", "la la", "audio-caption")
    assert "lyrics" not in told["no_song"]


def test_facts_of_files(spark):
    block = "from text\nSteps: 3, Model: other"
    rows = [(1, json.dumps(simple()), block, None, "out_1.png"), (2, None, block, None, "a.png"), (3, json.dumps(simple()), None, "side\nSteps: 9", "out.mp4"), (4, "{", None, None, None), (5, json.dumps({"1": node("X")}), block, None, "x.png"), (6, None, "p\nSteps: 2, Model: None", None, "b.png")]
    files = spark.createDataFrame(rows, "id int, graph string, block string, sidecar string, filename string").withColumn("stage", F.lit(None).cast("string"))
    got = [r["facts"] for r in workflow.file_facts(files, "id").orderBy("id").collect()]
    assert [(x["positive"], x["steps"], x["model_name"], x["method"]) for x in got] == [("a cat", 20, "base", "saver-walk"), ("from text", 3, "other", "settings-text"), ("side", 9, "base", "saver-walk"), (None, None, None, None), ("from text", 3, "other", "settings-text"), ("p", 2, None, "settings-text")]
    assert str(got[0]["seed"]) == "18446744073709551615" and got[3]["loras"] == []
    assert workflow.facts(files.where("graph is null"), "id").count() == 0
