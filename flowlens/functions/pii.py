"""Personal data in text: patterns, exact spans, redaction, merging. All of it stays in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Category and pattern, in the order in which findings are reported.
PATTERNS: dict[str, str] = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PHONE_US": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "PHONE_INTL": r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "IP_V4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "JWT": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "API_KEY": r"""(?i)(?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token)[\s:="']+[A-Za-z0-9_\-]{20,}""",
    "AWS_KEY": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "AADHAAR": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
}
#: Categories that only a model or a service reports, names that a service may give a category, model labels.
MODEL_CATEGORIES = ("PERSON_NAME", "LOCATION", "ORGANIZATION", "DATE_OF_BIRTH")
ALIASES = {"PHONEUS": "PHONE_US", "PHONEINTL": "PHONE_INTL", "CREDITCARD": "CREDIT_CARD", "IPV4": "IP_V4", "APIKEY": "API_KEY", "AWSKEY": "AWS_KEY", "PERSONNAME": "PERSON_NAME", "DATEOFBIRTH": "DATE_OF_BIRTH", "DOB": "DATE_OF_BIRTH"}
MODEL_LABELS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")
LABELS = {"PER": "PERSON_NAME", "LOC": "LOCATION", "ORG": "ORGANIZATION"}

ENTITY = "struct<category: string, source: string, start: int, end: int, byte_start: int, byte_end: int, confidence: float, text: string>"
_OPEN, _CLOSE, _OTHER = "", "", "￼"


def luhn_valid(digits: Column) -> Column:
    """Whether at least 13 digits satisfy the Luhn check."""
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def _may_have(text: Column, category: str) -> Column:
    """What a text must hold for a pattern to occur at all; a search for bytes, where the pattern is a search at every place."""
    if category == "EMAIL":
        return text.contains("@")
    if category == "PHONE_INTL":
        return text.contains("+")
    if category == "JWT":
        return text.contains("eyJ")
    if category == "AWS_KEY":
        return text.contains("AKIA") | text.contains("ASIA")
    if category == "API_KEY":
        return F.lower(text).contains("key") | F.lower(text).contains("token")
    return text.rlike("[0-9]")


def has(text: Column, category: str) -> Column:
    """Whether the category's pattern occurs."""
    return _may_have(text, category) & text.rlike(PATTERNS[category])


def has_pii(text: Column, categories: list[str] | None = None) -> Column:
    """Whether any pattern occurs; the cheap test before extraction."""
    out = F.lit(False)
    for name in categories or PATTERNS:
        out = out | has(text, name)
    return F.coalesce(out, F.lit(False))


def occurrences(text: Column, category: str) -> Column:
    """How often a category is found, without its places: one pass over the text."""
    if category == "CREDIT_CARD":
        n = F.size(F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[category]), F.lit(0)), lambda s: luhn_valid(F.regexp_replace(s, "[^0-9]", ""))))
    else:
        n = F.regexp_count(text, F.lit(PATTERNS[category]))
    return F.coalesce(F.when(_may_have(text, category), n), F.lit(0)).cast("long")


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern, none overlapping: array of (start, end, text) in code points. Every match is wrapped in two
    marks, the text cut at the marks, and the lengths of the parts give exact places."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER), pattern, f"{_OPEN}$0{_CLOSE}")
    parts = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start: int, end: int>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = (acc["at"] + F.length(part)).cast("int")
        found = F.when(acc["hit"], F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), found.alias("found"))

    places = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("text")))


def _entity(text: Column, category: str):
    """A span of text as a finding of this category."""

    def make(s: Column) -> Column:
        before = F.octet_length(F.substring(text, F.lit(1), s["start"]))
        return F.struct(F.lit(category).alias("category"), F.lit("Regex").alias("source"), s["start"].alias("start"), s["end"].alias("end"), before.alias("byte_start"), (before + F.octet_length(s["text"])).alias("byte_end"), F.lit(1.0).cast("float").alias("confidence"), s["text"].alias("text"))

    return make


def entities(text: Column, categories: list[str] | None = None) -> Column:
    """All findings, in the order of the patterns, then of the text; byte places as well as code points. An empty array for none or null."""
    none = F.array().cast(f"array<{ENTITY}>")
    groups = []
    for name in categories or PATTERNS:
        found = spans(text, PATTERNS[name])
        if name == "CREDIT_CARD":
            found = F.filter(found, lambda s: luhn_valid(F.regexp_replace(s["text"], "[^0-9]", "")))

        groups.append(F.when(has(text, name), F.transform(found, _entity(text, name))).otherwise(none))
    return F.coalesce(F.concat(*groups), none)


def redact(text: Column, found: Column) -> Column:
    """The text with <CATEGORY> in the place of each finding. Of findings that overlap the one that starts first counts, then
    the longest, then the first reported."""
    keyed = F.transform(found, lambda e, i: F.struct(e["start"].alias("start"), (-e["end"]).alias("longest"), i.alias("i"), e["end"].alias("end"), e["category"].alias("category")))
    piece = "struct<after: int, start: int, category: string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{piece}>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        free = e["start"] >= acc["at"]
        more = F.array(F.struct(acc["at"].alias("after"), e["start"].alias("start"), e["category"].alias("category")).cast(piece))
        return F.struct(F.when(free, e["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["kept"], more)).otherwise(acc["kept"]).alias("kept"))

    def joined(acc: Column) -> Column:
        parts = F.transform(acc["kept"], lambda k: F.concat(F.substring(text, k["after"] + 1, k["start"] - k["after"]), F.lit("<"), k["category"], F.lit(">")))
        return F.concat(F.array_join(parts, ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(F.array_sort(keyed), start, step, joined))


def report(text: Column, found: Column, redacted: bool = True) -> Column:
    """struct(entities, redacted_text, scanned_bytes); null where the text is empty or has no finding."""
    shown = redact(text, found) if redacted else F.lit(None).cast("string")
    return F.when((F.length(text) > 0) & (F.size(found) > 0), F.struct(found.alias("entities"), shown.alias("redacted_text"), F.octet_length(text).alias("scanned_bytes")))


def merge(first: Column, more: Column) -> Column:
    """first, and of `more` what overlaps none of those already in, one after the other."""

    def step(acc: Column, e: Column) -> Column:
        clash = F.exists(acc, lambda k: (e["start"] < k["end"]) & (e["end"] > k["start"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(more, first, step)


def category_of(name: Column) -> Column:
    """A category from how a service spells it, in any case; null if unknown."""
    upper = F.upper(name)
    for alias, category in ALIASES.items():
        upper = F.when(F.upper(name) == alias, F.lit(category)).otherwise(upper)
    return F.when(upper.isin(*PATTERNS, *MODEL_CATEGORIES), upper)


def decode_bio(tokens: Column) -> Column:
    """Spans of labelled tokens, array of (label, confidence): a run of one type, begun by B- or by an I- that continues
    nothing; its confidence is the least. Returns (type, token_start, token_end, confidence)."""
    span = "struct<type: string, token_start: int, token_end: int, confidence: float>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("open"), F.lit(0).alias("i"))

    def step(acc: Column, token: Column) -> Column:
        known = token["label"].rlike("^[BI]-(PER|LOC|ORG|MISC)\\z")
        kind, opened, i = F.substring(token["label"], 3, 4), acc["open"], acc["i"]
        continues = known & token["label"].startswith("I-") & opened.isNotNull() & (opened["type"] == kind)
        fresh = F.struct(kind.alias("type"), i.alias("token_start"), (i + 1).alias("token_end"), token["confidence"].cast("float").alias("confidence")).cast(span)
        longer = F.struct(opened["type"].alias("type"), opened["token_start"].alias("token_start"), (i + 1).alias("token_end"), F.least(opened["confidence"], token["confidence"].cast("float")).alias("confidence")).cast(span)
        now = F.when(F.coalesce(continues, F.lit(False)), longer).when(known, fresh)
        done = F.when(opened.isNull() | F.coalesce(continues, F.lit(False)), acc["done"]).otherwise(F.concat(acc["done"], F.array(opened)))
        return F.struct(done.alias("done"), now.cast(span).alias("open"), (i + 1).alias("i"))

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def token_labels(logits: Column, labels: tuple[str, ...]) -> Column:
    """A model's scores, an array of an array for each token, as (label, confidence): the first greatest score, and its share
    of the exponentials (softmax, from the greatest down, so that none overflows)."""
    names = F.array(*[F.lit(x) for x in labels])

    def label(scores: Column) -> Column:
        own = F.slice(scores, 1, len(labels)).cast("array<double>")
        top = F.array_max(own)
        share = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.struct(F.coalesce(F.get(names, (F.array_position(own, top) - 1).cast("int")), F.lit("O")).alias("label"), (F.lit(1.0) / share).cast("float").alias("confidence"))

    return F.transform(logits, label)


def token_offsets(offsets: Column, token_start: Column, token_end: Column) -> Column:
    """Start and end in the text of a run of tokens (offsets: array of (start, end)); null if the run is none or beyond them."""
    good = (token_start >= 0) & (token_start < token_end) & (token_end <= F.size(offsets))
    return F.when(good, F.struct(F.get(offsets, token_start)["start"].alias("start"), F.get(offsets, token_end - 1)["end"].alias("end")))


def model_findings(text: Column, logits: Column, offsets: Column, labels: tuple[str, ...], least: float) -> Column:
    """Findings (ENTITY) of a token model's scores: labels, spans, at least `least` sure, of a category that is reported."""
    category = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])

    def entity(s: Column) -> Column:
        at = token_offsets(offsets, s["token_start"], s["token_end"])
        part = F.substring(text, at["start"] + 1, at["end"] - at["start"])
        before = F.octet_length(F.substring(text, F.lit(1), at["start"]))
        return F.struct(F.try_element_at(category, s["type"]).alias("category"), F.lit("Ml").alias("source"), at["start"].alias("start"), at["end"].alias("end"), before.alias("byte_start"), (before + F.octet_length(part)).alias("byte_end"), s["confidence"].alias("confidence"), part.alias("text"))

    spans_ = F.filter(decode_bio(token_labels(logits, labels)), lambda s: s["confidence"] >= F.lit(least).cast("float"))
    found = F.filter(F.transform(spans_, entity), lambda e: e["category"].isNotNull() & e["start"].isNotNull())
    return F.coalesce(found, F.array().cast(f"array<{ENTITY}>"))


def hash_sampled(text: Column, rate: float) -> Column:
    """Whether a text is in a sample of this rate; decided by its digest, so alike on every engine and run."""
    if rate >= 1:
        return F.lit(True)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < F.lit(int(max(rate, 0) * (1 << 32)))
