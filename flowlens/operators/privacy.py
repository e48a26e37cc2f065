"""Personal data in tables of text: scans, counts, the audit rows, and the paths to a model or a service."""

from __future__ import annotations

import itertools
import json
import threading
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions import pii, templates
from flowlens.schema import MIN_CONFIDENCE


def with_entities(rows: DataFrame, text: str = "text", out: str = "entities", categories: list[str] | None = None) -> DataFrame:
    return rows.withColumn(out, pii.entities(F.col(text), categories))


def findings(rows: DataFrame, keep: list[str], text: str = "text", categories: list[str] | None = None) -> DataFrame:
    """A row for each finding: the columns of keep, its number in the text, and the finding."""
    return rows.select(*keep, F.posexplode(pii.entities(F.col(text), categories)).alias("entity_no", "e")).select(*keep, "entity_no", "e.*")


def counts(rows: DataFrame, by: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts and findings of each category. Rows are counted on; places are not looked for, and one key's rows are one text."""
    per_text = rows.select(*[F.col(c).alias(f"by_{c}") for c in by], F.col(key).alias("__key"), *[pii.occurrences(F.col(text), c).alias(f"n_{c}") for c in pii.PATTERNS])
    each = per_text.select(*[f"by_{c}" for c in by], "__key", F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"n_{c}").alias("n")) for c in pii.PATTERNS]))).filter("n > 0")
    return each.groupBy(*[F.col(f"by_{c}").alias(c) for c in by], "category").agg(F.countDistinct("__key").alias("n_texts"), F.sum("n").alias("n_entities"))


def redacted(rows: DataFrame, text: str = "text", out: str = "redacted_text") -> DataFrame:
    """rows with the redacted text; where nothing is found, the text itself."""
    return rows.withColumn("__found", pii.entities(F.col(text))).withColumn(out, pii.redact(F.col(text), F.col("__found"))).drop("__found")


def audit_rows(rows: DataFrame, report: str = "pii", ts: str = "timestamp_ns", service: Column | None = None) -> DataFrame:
    """A row for each finding of a report: when, what, how sure, and what was done. The text found is never among them."""
    action = F.when(F.col(f"{report}.redacted_text").isNotNull(), "Redacted").otherwise("Detected")
    return rows.select(F.col(ts).alias("timestamp_ns"), F.explode(f"{report}.entities").alias("e"), action.alias("action"), (F.lit("unknown") if service is None else service).alias("service_identity")).select(
        "timestamp_ns", "e.category", "e.source", "e.confidence", "action", "service_identity")


def template_hashes(rows: DataFrame, text: str = "text", out: str = "template_hash") -> DataFrame:
    """rows with a 64-bit hash of the text's template; only equality and spread matter, so it is Spark's own."""
    return rows.withColumn(out, F.xxhash64(templates.text_template(F.col(text))))


def inference_budget(rows: DataFrame, text: str, ts: str, budget: int, order: list[str], period: int = 1_000_000_000) -> DataFrame:
    """Rows that a model sees: in each period the first of each template, as many as the budget allows."""
    keyed = rows.withColumns({"__period": F.floor(F.col(ts) / period), "__template": templates.text_template(F.col(text))})
    first = F.row_number().over(Window.partitionBy("__period", "__template").orderBy(ts, *order))
    place = F.row_number().over(Window.partitionBy("__period").orderBy(ts, *order))
    return keyed.withColumn("__first", first).filter("__first = 1").withColumn("__place", place).filter(F.col("__place") <= budget).drop("__period", "__template", "__first", "__place")


def model_entities(rows: DataFrame, text: str, tagger: Callable[[], Callable[[list[str]], list[list[tuple[str, float, int, int]]]]], least: float = MIN_CONFIDENCE, out: str = "model_entities") -> DataFrame:
    """rows with the findings of a token tagger. `tagger` makes, once in each worker, what maps texts to their tokens' label,
    confidence, start and end; spans below `least` and those of no category are left out."""
    kind = "array<struct<label: string, confidence: float, start: int, end: int>>"

    @F.pandas_udf(kind)
    def tagged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = tagger()
        for part in parts:
            yield pd.Series([[{"label": a, "confidence": b, "start": c, "end": d} for a, b, c, d in tokens] for tokens in run(part.fillna("").tolist())])

    tokens = rows.withColumn("__tokens", tagged(F.col(text)))
    category = F.create_map(*[F.lit(x) for pair in pii.LABELS.items() for x in pair])

    def entity(s: Column) -> Column:
        start, end = F.get(F.col("__tokens"), s["token_start"])["start"], F.get(F.col("__tokens"), s["token_end"] - 1)["end"]
        found = F.substring(F.col(text), start + 1, end - start)
        before = F.octet_length(F.substring(F.col(text), F.lit(1), start))
        return F.struct(F.try_element_at(category, s["type"]).alias("category"), F.lit("Ml").alias("source"), start.alias("start"), end.alias("end"), before.alias("byte_start"), (before + F.octet_length(found)).alias("byte_end"), s["confidence"].alias("confidence"), found.alias("text"))

    spans = F.filter(pii.decode_bio(F.col("__tokens")), lambda s: s["confidence"] >= F.lit(least).cast("float"))
    return tokens.withColumn(out, F.filter(F.transform(spans, entity), lambda e: e["category"].isNotNull())).drop("__tokens")


class _Wave:
    """Items that so many threads take one after the other. A call that takes too long is given up: its thread is left alone, its
    answer comes too late, and another thread goes on."""

    def __init__(self, call: Callable, items: list, places: list[int], width: int, timeout_s: float):
        self.call, self.items, self.timeout_s = call, items, timeout_s
        self.answers: dict[int, object] = {}
        self.lock, self.over = threading.Lock(), threading.Event()
        self.todo = deque(places)
        self.begun: dict[int, tuple[int, float]] = {}  # by thread: its item and since when
        self.threads = itertools.count()
        for _ in range(min(width, len(places))):
            self._start()

    def _start(self) -> None:
        number = next(self.threads)
        with self.lock:
            if not self._next(number):
                return
        threading.Thread(target=self._work, args=(number,), daemon=True).start()

    def _next(self, number: int) -> bool:
        """Under the lock: gives a thread its next item, or lets it go."""
        if self.todo:
            self.begun[number] = self.todo.popleft(), time.monotonic()
            return True
        self.begun.pop(number, None)
        if not self.begun:
            self.over.set()
        return False

    def _work(self, number: int) -> None:
        going = True
        while going:
            at = self.begun[number][0]
            try:
                answer = self.call(self.items[at])
            except Exception:
                answer = None
            with self.lock:
                if number not in self.begun:
                    return  # given up
                self.answers[at] = answer
                going = self._next(number)

    def run(self) -> dict[int, object]:
        """The answers by place, None or nothing where there is none."""
        left = self.timeout_s
        while not self.over.wait(left):
            with self.lock:
                now = time.monotonic()
                hanging = [n for n, (_, since) in self.begun.items() if now - since >= self.timeout_s]
                for n in hanging:
                    del self.begun[n]
                if not self.begun and not self.todo:
                    break
                left = max(0.001, min((since + self.timeout_s - now for _, since in self.begun.values()), default=0.001))
            for _ in hanging:
                self._start()
        return self.answers


def calls_in_flight(call: Callable, items: list, width: int, timeout_s: float, retries: int) -> list:
    """call(item) for each item, `width` at once at most; None where it failed or took over timeout_s, after so many retries.

    Threads take items one after the other, so a call costs little beside itself, and one that hangs holds up only its own
    place, for timeout_s: all takes ceil(items / width) times timeout_s at most, times the retries.
    """
    out, todo = [None] * len(items), list(range(len(items)))
    for _ in range(retries + 1):
        if not todo:
            break
        answers = _Wave(call, items, todo, width, timeout_s).run()
        for at in todo:
            out[at] = answers.get(at)
        todo = [at for at in todo if out[at] is None]
    return out


def _sound(found: list[dict], raw: bytes) -> list[tuple]:
    """Findings that lie in the text and do not cut a character: name, start, end, byte_start, byte_end, confidence, text."""
    out = []
    for e in found:
        a, b = int(e["start"]), int(e["end"])
        if 0 <= a < b <= len(raw) and not any(i < len(raw) and raw[i] & 0xC0 == 0x80 for i in (a, b)):
            before, inner = len(raw[:a].decode()), raw[a:b].decode()
            out.append((e["category"], before, before + len(inner), a, b, float(e.get("confidence", 1.0)), inner))
    return out


def external_entities(rows: DataFrame, key: str, text: str, client: Callable[[], Callable], width: int = 8, batch: int = 1, timeout_s: float = 0.1, retries: int = 1, out: str = "external_entities") -> DataFrame:
    """key and the findings of a service (array of pii.ENTITY, in order; null where it gave none in time) for every row.

    `client` makes, once in each task, what maps a text (batch > 1: a list of texts) to findings (category, start, end in bytes,
    confidence), one list of them for each text, or to None where the call failed. A task has `width` calls in flight at most.
    Findings of unknown category, out of the text, empty, or inside a character are left out. Nothing is shuffled, so rows of few
    partitions are better dealt out before (session.spread).
    """
    kind, base = dict(rows.dtypes)[key], rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found_kind = "array<struct<name: string, start: int, end: int, byte_start: int, byte_end: int, confidence: float, text: string>>"
    names = ("name", "start", "end", "byte_start", "byte_end", "confidence", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for part in parts:
            texts = part["text"].tolist()
            if batch == 1:
                answers = calls_in_flight(call, texts, width, timeout_s, retries)
            else:
                groups = [texts[i:i + batch] for i in range(0, len(texts), batch)]
                answers = [a for group, found in zip(groups, calls_in_flight(call, groups, width, timeout_s, retries), strict=True) for a in (found or [None] * len(group))]
            cells = [None if a is None else [dict(zip(names, x, strict=True)) for x in _sound(a, t.encode())] for a, t in zip(answers, texts, strict=True)]
            yield pd.DataFrame({"key": part["key"], "found": pd.Series(cells, dtype=object, index=part.index)})

    def entity(e: Column) -> Column:
        return F.struct(pii.category_of(e["name"]).alias("category"), F.lit("External").alias("source"), *[e[c].alias(c) for c in ("start", "end", "byte_start", "byte_end", "confidence", "text")])

    found = base.mapInPandas(run, f"key {kind}, found {found_kind}")
    known = F.filter(F.transform("found", entity), lambda e: e["category"].isNotNull())
    place = F.transform(known, lambda e: F.struct(e["byte_start"].alias("at"), e.alias("e")))
    return found.select(F.col("key").alias(key), F.transform(F.array_sort(place), lambda x: x["e"]).alias(out))


def http_client(url: str, timeout_s: float) -> Callable[[], Callable[[str], list[dict]]]:
    """A client for external_entities: posts {"text": ...} as JSON and takes the answer's `entities`; what is not an answer raises."""

    def client() -> Callable[[str], list[dict]]:
        def call(text: str) -> list[dict]:
            request = urllib.request.Request(url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                return json.load(answer)["entities"]

        return call

    return client


def with_service(rows: DataFrame, text: str, found: str, client: Callable[[], Callable], rate: float = 1.0, **calls) -> DataFrame:
    """rows with the findings of a service merged into those of the column `found`. A share `rate` of the texts is sent, by their
    digest, each text once however many rows have it. Where the service fails, the row keeps what it has."""
    digest = F.sha2(F.col(text), 256)
    texts = rows.filter((F.length(text) > 0) & pii.hash_sampled(F.col(text), rate)).select(digest.alias("__digest"), F.col(text).alias("__text")).dropDuplicates(["__digest"])
    answers = external_entities(texts, "__digest", "__text", client, out="__more", **calls)
    joined = rows.withColumn("__of", digest).join(answers.filter(F.size("__more") > 0), F.col("__of") == F.col("__digest"), "left")
    return joined.withColumn(found, F.when(F.col("__more").isNull(), F.col(found)).otherwise(pii.merge(F.col(found), F.col("__more")))).drop("__of", "__digest", "__more")
