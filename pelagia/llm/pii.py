"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from regular expressions: exact ones (the base spans, which always stay) and loose ones
(spelled-out addresses, split or undotted numbers). Six labelers vote +1, 0 or -1 on each candidate: two
check its form, two look parts of it up in gazetteers, two read the words and marks around it. Expectation
maximisation over the counts of vote patterns estimates, for each kind, the labelers' hit and false-alarm
rates and so the probability of each pattern; a logistic regression on votes and size, trained on these
soft labels, is the span classifier that decides which loose candidates are added.

Scale: passes over the text are narrow projections. What is aggregated is one row for each kind, vote
pattern and size class, at most 4 * 3^6 * 4 rows for any corpus. Patterns are written so that a scan is
linear in the text: possessive repeats, and a start only at the edge of a run.

A loose candidate counts only if it has its kind's form, or a cue before it where the form is open (cards that
fail Luhn, bare phone numbers); what the classifier then accepts is added.

Defined results: a null or empty text has no spans. With no candidates at all the classifier adds nothing.
Spans are in code points, end exclusive. Repeated rows each get their own result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
SIZES = 4
EM_ROUNDS = 8
DESCENT_ROUNDS = 8
THRESHOLD = 0.9
CONTEXT_LEFT, CONTEXT_RIGHT = 32, 12
BLOCK = 256

LOCAL = "[A-Za-z0-9._%+-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BRACKET_AT, WORD_DOT = r"\x20?[\[(][aA][tT][\])]\x20?", r"(?:\x20?[\[(][dD][oO][tT][\])]\x20?|\x20dot\x20)"
LABEL = "[A-Za-z0-9-]{1,63}+"
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+(?:{BRACKET_AT}{LABEL}(?:\.|{WORD_DOT})|\x20at\x20{LABEL}{WORD_DOT}){LABEL}(?:(?:\.|{WORD_DOT}){LABEL}){{0,3}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\x20\.\x20?|\.\x20)[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{1,7}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[0-9]{9,13}|\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4})(?![0-9.-])",
}

#: fixed gazetteers
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|pl|us|ca|br|mx|jp|cn|in|au"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35"
CALLING_CODES = "1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|7|81|82|84|86|90|91|92|98"
CUES = {
    "email": "mail|contact|correo|courriel|kontakt|write to|reach",
    "ip": r"\bip\b|server|host|address|addr|adresse|login|client",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|anruf|appel|llam",
}
AGAINST = {
    "email": r"look|arrive|meet|stay",
    "ip": r"version|release|\bv\.?\s*$|section|chapter",
    "card": r"order|invoice|serial|isbn|tracking|\bid\b|token|hash",
    "phone": r"version|page|isbn|order|invoice|\bid\b|serial|\byear",
}


@dataclass
class Model:
    """Weights of the span classifier by kind: bias, votes for, votes against, size classes."""

    weights: dict[str, list[float]] = field(default_factory=lambda: {k: [0.0] * (1 + 2 * LABELERS + SIZES) for k in KINDS})


def running_sums(steps: Column) -> Column:
    """Inclusive running sums of an array, in blocks so that long arrays don't cost their square."""

    def sums(items: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<bigint>)").alias("all"))
        return F.aggregate(items, start, lambda acc, x: F.struct((acc.total + x).alias("total"), F.concat(acc["all"], F.array(acc.total + x)).alias("all")), lambda acc: acc["all"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda i: sums(F.slice(steps, i * BLOCK + 1, F.lit(BLOCK))))
    totals = F.transform(blocks, lambda b: F.element_at(b, -1))
    before = F.concat(F.expr("array(0L)"), sums(totals))
    whole = F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(F.coalesce(b, F.expr("cast(array() as array<bigint>)")), lambda x: x + o)))
    return F.when(F.size(steps) <= BLOCK, sums(steps)).otherwise(whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a base match holds what its kind asks for."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checks(kind: str):
    return lambda x: _valid(kind, x["value"])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, value: Column, left: Column, right: Column) -> Column:
    """The labelers' votes on one candidate."""
    digits, left, right = _digits(value), F.lower(left), F.lower(right)
    n = F.length(digits)
    touching = left.rlike("[a-z0-9@/=-]$") | right.rlike("^[a-z0-9@/=-]")
    if kind == "email":
        form = _vote(value.rlike(r"(?i)(?:[\[(]at[\])]|\x20at\x20.*\x20dot\x20|@)"), value.rlike(r"^[._%+-]|\.\."))
        shape = _vote(value.rlike(r"[._0-9]") & F.length(value).between(6, 80), F.length(value) < 6)
        known = _vote(value.rlike(rf"(?i)[.\x20\])](?:{TLDS})$"), value.rlike(r"[0-9]$"))
        owner = _vote(value.rlike(r"(?i)(?:mail|example|test|corp|inc|univ|hotmail|gmail|yahoo)"), value.rlike(r"(?i)^(?:the|is|was|are|look|be)\b"))
    elif kind == "ip":
        parts = F.regexp_replace(value, r"[^0-9.]", "")
        form = _vote(parts.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), ~parts.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        shape = _vote(n >= 8, parts.rlike(r"^[0-9](?:\.[0-9]){3}$"))
        known = _vote(parts.rlike(r"^(?:10|172|192|8|1)\."), parts.rlike(r"^(?:0|255)\."))
        owner = _vote(value.contains("[.]"), value.rlike(r"\s"))
    elif kind == "card":
        good = n.between(13, 19) & F.call_function("luhn_check", digits)
        form = _vote(good, ~good)
        shape = _vote(n.isin(15, 16), ~n.isin(13, 14, 15, 16, 19))
        known = _vote(digits.rlike(rf"^(?:{ISSUERS})"), digits.rlike(r"^[0189]"))
        owner = _vote(value.rlike(r"^[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1"), digits.rlike(r"^([0-9])\1*$"))
    else:
        form = _vote(n.between(9, 15) & value.rlike(r"^(?:\+|00|\()"), ~n.between(9, 15) | value.rlike("^[1-9]"))
        shape = _vote(value.rlike(r"[ ().-]"), n > 13)
        known = _vote(value.rlike(rf"^(?:\+|00)(?:{CALLING_CODES})"), value.rlike(r"^(?:\+|00)0"))
        owner = _vote(value.contains("(") & value.contains(")"), value.rlike(r"^[0-9]{4}[./-][0-9]{4}[./-][0-9]{4}$"))
    cue = _vote(left.rlike(CUES[kind]), left.rlike(AGAINST[kind]))
    edge = _vote(~touching, touching)
    return F.array(*(v.cast("int") for v in (form, shape, known, owner, cue, edge)))


def _found(text: Column, matches: Column, rest: Column) -> Column:
    """Structs of start, end, value, left and right for the matches; rest holds what lies between them."""
    steps = F.transform(matches, lambda m, i: (F.char_length(F.get(rest, i)) + F.when(i > 0, F.char_length(F.get(matches, i - 1))).otherwise(0)).cast("long"))
    starts = running_sums(steps)
    spans = F.transform(
        F.arrays_zip(matches.alias("value"), starts.alias("start")),
        lambda x, i: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.char_length(x["value"])).alias("end"),
            x["value"].alias("value"),
            F.right(F.get(rest, i), F.lit(CONTEXT_LEFT)).alias("left"),
            F.left(F.get(rest, i + 1), F.lit(CONTEXT_RIGHT)).alias("right"),
        ),
    )
    return F.when(F.size(matches) > 0, spans)


#: places of two labelers among the votes
FORM, CUE = 0, 4


def _plausible(kind: str):
    """Loose candidates must have the form of their kind (digits that pass Luhn, octets, a country code); a card or phone
    number without it needs a cue before it, and a number that the words before it explain is out."""

    def plausible(x: Column) -> Column:
        formed, cue = x["votes"][FORM] == 1, x["votes"][CUE]
        return formed if kind == "email" else formed & (cue >= 0) if kind == "ip" else (formed & (cue >= 0)) | (cue == 1)

    return plausible


def _judged(kind: str, base: bool):
    def judge(x: Column) -> Column:
        size = F.least(F.lit(SIZES - 1), F.floor(F.char_length(x["value"]) / 10).cast("int"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), _votes(kind, x["value"], x["left"], x["right"]).alias("votes"), size.alias("size"))

    return judge


def _packed(documents: DataFrame, text_column: str) -> DataFrame:
    """(pii_text, row): columns of the documents are out of the way of those that are worked with."""
    return documents.select(F.col(f"`{text_column}`").cast("string").alias("pii_text"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))


def candidates(documents: DataFrame) -> DataFrame:
    """documents (with pii_text) with an array column pii_<kind> for each kind: start, end, base, votes, size of each candidate."""
    text = F.coalesce(F.col("pii_text"), F.lit(""))
    out = documents.withColumn("pii_digit", text.rlike("[0-9]"))
    gates = {
        ("email", 0): F.contains(text, F.lit("@")),
        ("email", 1): F.contains(text, F.lit(" at ")) | text.rlike(r"[\[(][aA][tT][\])]"),
        ("phone", 0): F.contains(text, F.lit("+")),
    }
    keys = [(kind, i) for kind in KINDS for i in (0, 1)]
    for kind, i in keys:
        pattern = (BASE, LOOSE)[i][kind]
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        out = out.withColumn(f"pii_m_{kind}_{i}", F.when(gates.get((kind, i), F.col("pii_digit")), found))
    for kind, i in keys:
        m = F.col(f"pii_m_{kind}_{i}")
        out = out.withColumn(f"pii_s_{kind}_{i}", F.when(F.size(m) > 0, F.split(text, (BASE, LOOSE)[i][kind], -1)))
    for kind, i in keys:
        out = out.withColumn(f"pii_f_{kind}_{i}", _found(text, F.col(f"pii_m_{kind}_{i}"), F.col(f"pii_s_{kind}_{i}")))
    empty = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"
    for kind in KINDS:
        exact = F.filter(F.coalesce(F.col(f"pii_f_{kind}_0"), F.expr(f"cast(array() as {empty})")), _checks(kind))
        out = out.withColumn(f"pii_e_{kind}", exact)
    spans = "array<struct<start:bigint,end:bigint>>"
    bare = [F.transform(F.col(f"pii_e_{k}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS]
    out = out.withColumn("pii_taken", F.concat(*bare).cast(spans))
    for kind in KINDS:
        free = F.filter(F.col(f"pii_f_{kind}_1"), lambda x: ~F.exists(F.col("pii_taken"), lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"])))
        exact = F.transform(F.col(f"pii_e_{kind}"), _judged(kind, True))
        more = F.when(F.size(F.col(f"pii_f_{kind}_1")) > 0, F.filter(F.transform(free, _judged(kind, False)), _plausible(kind)))
        out = out.withColumn(f"pii_{kind}", F.concat(exact, F.coalesce(more, F.slice(exact, 1, 0))))
    helpers = ["pii_digit", "pii_taken", *(f"pii_{x}_{k}_{i}" for x in "msf" for k, i in keys), *(f"pii_e_{k}" for k in KINDS)]
    return out.drop(*helpers)


def _by_kind(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, F.lit(float(value))).otherwise(out)
    return out


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _signed(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["votes"].alias("votes"), c["size"].alias("size"))


def _named(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))


def _score(weights: list[float]):
    def score(c: Column) -> Column:
        total = F.lit(weights[0])
        for j in range(LABELERS):
            v = c["votes"][j]
            total = total + F.when(v == 1, weights[1 + j]).when(v == -1, weights[1 + LABELERS + j]).otherwise(0.0)
        for s in range(SIZES):
            total = total + F.when(c["size"] == s, weights[1 + 2 * LABELERS + s]).otherwise(0.0)
        return total

    return score


def _accepted(score, cut: float):
    return lambda c: c["base"] | (score(c) >= cut)


def fit(documents: DataFrame, text_column: str = "text") -> Model:
    """Learns labeler reliabilities and the classifier from all documents' candidates."""
    return learn(candidates(documents.select(F.col(f"`{text_column}`").cast("string").alias("pii_text"))))


def learn(found: DataFrame) -> Model:
    """The same from candidates that are there already."""
    tagged = F.concat(*(F.transform(F.col(f"pii_{k}"), _signed(k)) for k in KINDS))
    patterns = written(found.select(F.explode(tagged).alias("c")).groupBy("c.kind", "c.votes", "c.size").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "pii-patterns")
    votes = [F.col("votes")[j] for j in range(LABELERS)]
    prior = dict.fromkeys(KINDS, 0.5)
    hit = [dict.fromkeys(KINDS, 0.85) for _ in votes]
    alarm = [dict.fromkeys(KINDS, 0.25) for _ in votes]
    log_odds = lambda p: math.log(p / (1 - p))

    def posterior() -> Column:
        score = _by_kind({k: log_odds(v) for k, v in prior.items()})
        for j, v in enumerate(votes):
            up = _by_kind({k: math.log(hit[j][k] / alarm[j][k]) for k in KINDS})
            down = _by_kind({k: math.log((1 - hit[j][k]) / (1 - alarm[j][k])) for k in KINDS})
            score = score + F.when(v == 1, up).when(v == -1, down).otherwise(0.0)
        return _sigmoid(score)

    for _ in range(EM_ROUNDS):
        q, n = F.col("q"), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * q).alias("pos")]
        for j, v in enumerate(votes):
            sums += [F.sum(F.when(c, n * w).otherwise(0.0)).alias(f"{name}{j}") for name, c, w in (("hit", v == 1, q), ("alarm", v == 1, 1 - q), ("seen", v != 0, q), ("against", v != 0, 1 - q))]
        for r in patterns.withColumn("q", posterior()).groupBy("kind").agg(*sums).collect():  # one row for each kind
            k = r["kind"]
            prior[k] = (r["pos"] + 1) / (r["n"] + 2)
            for j in range(LABELERS):  # priors keep a labeler better than chance until votes say otherwise
                hit[j][k] = (r[f"hit{j}"] + 8) / (r[f"seen{j}"] + 10)
                alarm[j][k] = (r[f"alarm{j}"] + 2) / (r[f"against{j}"] + 10)

    model = Model()
    for k in KINDS:  # the labelers' own log odds are where descent starts
        up = [math.log(hit[j][k] / alarm[j][k]) for j in range(LABELERS)]
        down = [math.log((1 - hit[j][k]) / (1 - alarm[j][k])) for j in range(LABELERS)]
        model.weights[k] = [log_odds(prior[k]), *up, *down, *[0.0] * SIZES]
    inputs = [F.lit(1.0), *((v == 1).cast("double") for v in votes), *((v == -1).cast("double") for v in votes), *((F.col("size") == s).cast("double") for s in range(SIZES))]
    soft = posterior()
    for _ in range(DESCENT_ROUNDS):
        score = sum((_by_kind({k: model.weights[k][i] for k in KINDS}) * x for i, x in enumerate(inputs)), F.lit(0.0))
        error = (F.col("p") - F.col("q")) * F.col("n")
        steps = [F.sum(F.col("n")).alias("n"), *(F.sum(error * x).alias(f"g{i}") for i, x in enumerate(inputs))]
        for r in patterns.withColumn("q", soft).withColumn("p", _sigmoid(score)).groupBy("kind").agg(*steps).collect():
            model.weights[r["kind"]] = [w - 2.0 * r[f"g{i}"] / r["n"] for i, w in enumerate(model.weights[r["kind"]])]
    return model


def accepted(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> Column:
    """The spans of candidates (pii_<kind>) that the base has or the classifier accepts, by kind and then start."""
    cut = math.log(threshold / (1 - threshold))
    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    parts = []
    for kind in KINDS:
        taken = F.transform(F.filter(F.col(f"pii_{kind}"), _accepted(_score(model.weights[kind]), cut)), _named(kind))
        parts.append(F.array_sort(taken, by_start))
    return F.concat(*parts)


def _detected(documents: DataFrame, model: Model, text_column: str, threshold: float) -> DataFrame:
    """(pii_text, row, pii_spans) of every document."""
    found = candidates(_packed(documents, text_column))
    return found.select("pii_text", "row", accepted(found, model, threshold).alias("pii_spans"))


def detect(documents: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents with pii_spans: array of (kind, start, end, base), by kind and then start.

    A column of that name gives way to it; all others stay as they are, whatever their names.
    """
    found = _detected(documents, model, text_column, threshold)
    return found.select(*(F.col("row")[c].alias(c) for c in documents.columns if c.lower() != "pii_spans"), "pii_spans")


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """documents with every span of text replaced by its kind in brackets; n_chars, if there, follows."""
    columns = documents.columns
    found = _detected(documents, model, "text", THRESHOLD)
    ordered = F.array_sort("pii_spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"].cast("int") - a["end"].cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(F.substring("pii_text", acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    cleaned = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("pii_text", acc["at"].cast("int") + 1, F.length("pii_text"))))
    hit = F.size("pii_spans") > 0
    out = found.withColumn("cleaned", F.when(hit, cleaned).otherwise(F.col("pii_text")))
    changed = {"text": F.col("cleaned"), "n_chars": F.when(hit, F.char_length("cleaned").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in columns else None}
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in columns))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("pii_text"))
    found = written(candidates(documents).drop("pii_text"), "pii-candidates")  # texts are searched once, for learning and for the result
    spans = found.select("doc_id", accepted(found, learn(found)).alias("pii_spans"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(F.filter("pii_spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("pii_spans")).alias("spans"),
    )
