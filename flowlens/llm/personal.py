"""Personal data in texts, in Column expressions only: patterns propose spans, validators confirm them, words nearby move the score.

The base kinds (email, ip, card, phone) are what their pattern and validator say, whatever the score. The added kinds (iban,
ssn, tel) are proposed by patterns that are not sure enough alone: an IBAN must have its country's length and leave 1 modulo
97, the other two need a word nearby that speaks of them. Each kind is searched for by itself, leftmost and not overlapping;
spans of different kinds may overlap. Nothing is shuffled, and work is linear in the text: patterns begin where a run of their
characters begins and never give a run back, and what is around a match is read from the stretch between two matches.

A null text is an empty one and has no spans. Rows are taken one by one: equal rows and equal ids stay apart, an id may be null,
and of the table only the two named columns are read, so no other column can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Code points before and after a match that may hold words which speak of it; only what lies between it and the next match of its kind.
BEFORE, AFTER = 40, 20
#: A word nearby that speaks for the kind, one that speaks against it, and the score an added span needs (of 100).
SPEAKS_FOR, SPEAKS_AGAINST, NEEDED = 30, 30, 50
#: Words that speak against any kind.
AGAINST = "example|sample|dummy|fake|placeholder"
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "VA": 22,
}
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """pattern: for Java, never backtracking over a run. needs: what a text must hold for a match at all. behind, ahead: what may
    not end right before a match (of the six code points there) or begin right after it ("" for none)."""

    name: str
    pattern: str
    needs: str
    score: int
    words: str
    behind: str = ""
    ahead: str = ""
    base: bool = True


#: In the order in which spans that start together are listed. A run that was cut by the match before goes on at \G.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 70, "mail|contact|write to|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 60, "address|host|server|client|login|logged|from"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 60, "card|visa|master|amex|credit|debit|payment|paid"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 60, "phone|tel|call|fax|mobile|cell|ring"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", "", 60, "iban|account|bank|transfer", "[A-Za-z0-9]$", "^[A-Za-z0-9]", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 30, "ssn|social security|tax id|taxpayer", "[A-Za-z0-9-]$", "^[A-Za-z0-9-]", False),
    Kind("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "", 30, "phone|tel|call|fax|mobile|cell|ring", r"(?:[A-Za-z0-9+.-]|\+[0-9]{1,3}[\x20.(]{1,2})$", "^[0-9-]", False),
)
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(letters: Column) -> Column:
    """The remainder of an IBAN (no blanks) by 97: its first four characters go last, a letter counts as two digits."""
    turned = F.split(F.concat(F.substring(letters, 5, 40), F.substring(letters, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        return F.regexp_replace(match, r"(?<![0-9])0++(?=[0-9])", "").rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", F.substring(_digits(match), 1, 19))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        return (F.length(bare) == F.coalesce(F.try_element_at(lengths, F.substring(bare, 1, 2)), F.lit(0))) & (mod97(bare) == 1)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def _lowered(text: Column) -> Column:
    return F.translate(text, _A_TO_Z, _A_TO_Z.lower())


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.concat(_lowered(F.right(before, F.lit(BEFORE))), F.lit(" | "), _lowered(F.left(after, F.lit(AFTER))))
    moved = F.lit(kind.score) + F.when(near.rlike(kind.words), SPEAKS_FOR).otherwise(0) - F.when(near.rlike(AGAINST), SPEAKS_AGAINST).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), moved)).cast("int")


def _stands_alone(kind: Kind, before: Column, after: Column) -> Column:
    if not kind.behind:
        return F.lit(True)
    return ~F.right(before, F.lit(6)).rlike(kind.behind) & ~F.left(after, F.lit(1)).rlike(kind.ahead)


def _let(value: Column, body) -> Column:
    """body(value), with the value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(matches: Column, gaps: Column, kind: Kind, number: int) -> Column:
    """Spans of the matches that hold: array of (start, number, end, score). Places are running sums of lengths, taken in blocks
    and then over the blocks, as an array that grows by one copies all it has."""
    n = F.size(matches)
    before = F.zip_with(matches, F.slice(gaps, F.lit(1), n), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    span = "struct<start: int, kind: int, end: int, score: int>"

    def judged(x: Column, after: Column) -> Column:
        sure = valid(kind.name, x["m"]) & _stands_alone(kind, x["b"], after)
        score = _score(kind, x["b"], after)
        keep = sure if kind.base else sure & (score >= NEEDED)
        return F.struct(F.length(x["b"]).alias("skip"), F.length(x["m"]).alias("size"), F.coalesce(keep, F.lit(False)).alias("keep"), score.alias("score"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["skip"]).cast("int")
        end = (start + x["size"]).cast("int")
        new = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["score"].alias("score")).cast(span))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    def block(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(f"array<{span}>").alias("found")), step, lambda acc: acc["found"])

    def cut(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / _BLOCK).cast("int")), lambda i: F.slice(each, i * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(blocks: Column) -> Column:
        length = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["skip"] + x["size"]))
        starts = F.aggregate(length, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), block))

    return _let(_let(F.zip_with(before, F.slice(gaps, F.lit(2), n), judged), cut), joined)


def with_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "spans") -> DataFrame:
    """A row for each row of docs: key, and its spans of all kinds in order of start, kind and end: array of (start, kind, end,
    score), where kind is the place in KINDS, places are code points, and the end is exclusive."""
    kept, none = [], F.array().cast("array<struct<start: int, kind: int, end: int, score: int>>")
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    source = F.col("__text")
    for i, kind in enumerate(KINDS):
        may = source.contains(kind.needs) if kind.needs else source.rlike("[0-9]")
        rows = rows.withColumn(f"__m{i}", F.when(may, F.regexp_extract_all(source, F.lit(kind.pattern), F.lit(0))))
    for i, kind in enumerate(KINDS):
        some = F.size(F.col(f"__m{i}")) > 0
        rows = rows.withColumn(f"__g{i}", F.when(some, F.split(source, kind.pattern, -1)))
        kept.append(F.when(some, _placed(F.col(f"__m{i}"), F.col(f"__g{i}"), kind, i)).otherwise(none))
    return rows.select(F.col("__key").alias(key), F.array_sort(F.concat(*[F.coalesce(k, none) for k in kept])).alias(out))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def of_base(spans: Column) -> Column:
    """The spans of the base kinds."""
    return F.filter(spans, lambda s: s["kind"] < sum(k.base for k in KINDS))


def counted(spans: Column, kind: str) -> Column:
    number = [k.name for k in KINDS].index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def document_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: key, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as shown), spans (all,
    as shown), scores (theirs, comma-joined)."""
    found = with_spans(docs, text, key, "__spans").withColumn("__base", of_base(F.col("__spans")))
    return found.select(
        key, *[counted(F.col("__base"), k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(shown(F.col("__base")), 256).alias("base_sha256"), shown(F.col("__spans")).alias("spans"),
        F.array_join(F.transform("__spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
