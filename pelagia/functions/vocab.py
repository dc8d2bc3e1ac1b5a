"""Fixed values of the catalog: extensions, stages, labels, words that are no tags."""

from __future__ import annotations

# fixed values
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif")
VIDEO_EXTENSIONS = (".mp4", ".webm", ".mov")
AUDIO_EXTENSIONS = (".mp3", ".flac", ".wav", ".opus", ".m4a")
STATUS_LABELS = ("publish", "refine", "explore")
FLAG_LABELS = ("video", "published")
FACET_DIMENSIONS = ("model", "mtype", "folder", "root")
SHUFFLE_MODULUS = 2147483647
SHUFFLE_SEEDS = 1_000_000
MTIME_TOLERANCE = 2.0
COLLECTION_NAME_CHARS = 40
MAX_COLLECTIONS = 200
#: the blanks of Unicode (category Zs), which end a line's text at both sides; tabs and line ends are none
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
NOTE_SEPARATOR = "\n\n— merged from a deleted copy —\n"
#: stages of a pipeline in their order, older names of two of them, and role words in names
STAGES = ("raw", "detail", "refine", "upscale", "final")
STAGE_ALIASES = {"main": "raw", "det": "detail"}
SET_ROLES = ("main", "det", "refine")
PAIR_ROLES = ("base", "interp", "audio")
FAMILY_HINTS = ("pony", "illustrious", "flux", "sdxl", "krea", "wan", "ltx", "minimax", "noobai", "animagine", "qwen", "hunyuan")
NEVER_FOLDED_INTO = ("sd",)
STOP_WORDS = tuple(
    """
    a an the and or but of to in on at by for with from as is are was were be been being it its this that these those
    then than so into over under out up down off about very more most some any all no not you your my his her their our
    they them he she we i me him who which what has have had image photo picture style quality detailed detail best
    wearing looking standing sitting shot view scene ultra highly realistic comfyui img output render final copy edit
    upscale upscaled tmp temp png jpg jpeg webp
    """.split()
)
STOP_PHRASES = (
    "masterpiece", "best quality", "high quality", "highest quality", "ultra detailed", "ultra-detailed",
    "extremely detailed", "highly detailed", "high resolution", "hires", "8k", "4k", "uhd", "hdr", "sharp focus",
    "professional", "award winning", "award-winning", "trending on artstation", "artstation", "raw photo", "score_9",
    "score_9_up", "score_8", "score_8_up", "score_7_up", "score_6_up", "worst quality", "low quality",
    "normal quality", "lowres", "bad quality",
)
