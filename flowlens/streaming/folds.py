"""Operators that depend on the order of events, over streams: each gives what its batch form gives for the same rows."""

from __future__ import annotations

import functools
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlens import schema
from flowlens.functions import procfs, templates
from flowlens.operators.sessions import INPUT
from flowlens.streaming.held import Fold, held_fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- sessions -----------------------------------------------------------------------------------------------------

class SessionFold(Fold):
    """The messages of a connection. Where sessions are bounded, the one silent for the longest gives way (a row with the error
    `evicted`), and a row with the error `capacity` tells when the table is 80 % or 95 % full."""

    def __init__(self, idle_ns: int):
        self.idle_ns = idle_ns

    def begin(self, key: str):
        from flowlens.operators.sessions import SessionRunner

        return SessionRunner(self.idle_ns)

    def feed(self, state, event: dict) -> list[dict]:
        return state.feed(event)

    def until(self, state, at: int) -> int:
        return at + 2 * self.idle_ns

    def gone(self, key: str, state, last: int, evicted: bool) -> list[dict]:
        return [{"session_key": int(key), "msg_no": state.made, "timestamp_ns": last, "state": "evicted", "error": "evicted"}] if evicted else []

    def grown(self, live: int, capacity: int, event: dict) -> list[dict]:
        marks = {max(1, capacity * 80 // 100): "warning"} | {max(1, capacity * 95 // 100): "critical"}
        return [{"session_key": event["session_key"], "msg_no": live, "timestamp_ns": event["timestamp_ns"], "state": marks[live], "error": "capacity"}] if live in marks else []


def parse_session_stream(events: DataFrame, idle_ns: int = schema.IDLE_SECONDS * 1_000_000_000, late: str | None = None, capacity: int | None = None, buckets: int = 64) -> DataFrame:
    """parse_sessions over a stream. Needs the RocksDB state store provider (`held.use_keyed_state`).

    late: how late an event may come ("10 seconds"). Events then wait for the watermark and are parsed in order of time over
    all batches and files; what comes later than that is dropped, and what the watermark never passes waits on. Without it,
    events are put in order inside a batch only, for sources that give them in order. Sessions silent for twice idle_ns are
    dropped, by event time. capacity: as many sessions are kept at most, each bucket its share.
    """
    return held_fold(events.select(*INPUT), F.col("session_key"), functools.partial(SessionFold, idle_ns), schema.SESSION_ROW, late, order=["seq"], capacity=capacity, buckets=buckets)


# ---- correlation --------------------------------------------------------------------------------------------------

class CorrelationFold(Fold):
    """The last request of a key, until its time is up; responses with the request that they answer."""

    def __init__(self, within: int, asked: list[str], answers: list[str]):
        self.within, self.asked, self.answers = within, asked, answers

    def begin(self, key: str) -> dict:
        return {"at": None, "row": None, "answered": True}

    def _unanswered(self, state: dict) -> list[dict]:
        return [] if state["answered"] else [state["row"] | {"outcome": "no response"}]

    def feed(self, state: dict, event: dict) -> list[dict]:
        if event["__kind"] == 0:
            out = self._unanswered(state)
            state.update(at=event["__at"], row={c: event[c] for c in self.asked}, answered=False)
            return out
        own = {c: event[c] for c in self.answers}
        if state["at"] is None or event["__at"] - state["at"] > self.within:
            return [own | {"outcome": "no request"}]
        state["answered"] = True
        return [own | state["row"] | {"outcome": "answered"}]

    def until(self, state: dict, at: int) -> int:
        return (at if state["at"] is None else state["at"]) + self.within

    def gone(self, key: str, state: dict, last: int, evicted: bool) -> list[dict]:
        return self._unanswered(state)


def pair_correlated_stream(requests: DataFrame, responses: DataFrame, key: list[str], within: int, late: str, ts: str = "timestamp_ns", buckets: int = 64) -> DataFrame:
    """pair_correlated over two streams: responses with `request`, and requests that none answered. outcome: `answered`, `no
    request` (the response alone), or `no response` (the request alone). A request waits for `within` and no longer."""
    own = [c for c in requests.columns if c not in key]
    asked, answers = [f"q_{c}" for c in own], [f"r_{c}" for c in responses.columns]
    none = lambda frame, names, prefix: [F.lit(None).cast(frame.schema[c].dataType).alias(f"{prefix}{c}") for c in names]
    left = requests.select(*key, F.col(ts).alias("__ts"), F.lit(0).alias("__kind"), *[F.col(c).alias(f"q_{c}") for c in own], *none(responses, responses.columns, "r_"))
    right = responses.select(*key, F.col(ts).alias("__ts"), F.lit(1).alias("__kind"), *none(requests, own, "q_"), *[F.col(c).alias(f"r_{c}") for c in responses.columns])
    shape = StructType([*[StructField(f"r_{f.name}", f.dataType) for f in responses.schema], *[StructField(f"q_{c}", requests.schema[c].dataType) for c in own], StructField("outcome", StringType())])
    rows = held_fold(left.unionByName(right), F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), functools.partial(CorrelationFold, within, asked, answers), shape, late, ts="__ts", order=["__kind", *asked], buckets=buckets)
    request = F.when(F.col("outcome") != "no request", F.struct(*[F.col(f"q_{c}").alias(c) for c in own]))
    return rows.select(*[F.col(f"r_{c}").alias(c) for c in responses.columns], request.alias("request"), "outcome")


# ---- names of addresses -------------------------------------------------------------------------------------------

class NameFold(Fold):
    """The name that an address has, until its time is up."""

    def __init__(self, scale: int, given: list[str]):
        self.scale, self.given = scale, given

    def begin(self, key: str) -> dict:
        return {"domain": None, "until": None}

    def feed(self, state: dict, event: dict) -> list[dict]:
        if event["__kind"] == 0:
            state.update(domain=event["__domain"], until=event["__at"] + event["__ttl"] * self.scale)
            return []
        known = state["until"] is not None and event["__at"] < state["until"]
        return [{c: event[c] for c in self.given} | {"domain": state["domain"] if known else None}]

    def until(self, state: dict, at: int) -> int:
        return at if state["until"] is None else state["until"]


class AddressFold(Fold):
    """The latest address of a name: a row when it changes, and one without address when no answer counts any more."""

    def __init__(self, scale: int):
        self.scale = scale

    def begin(self, key: str) -> dict:
        return {"address": None, "until": None}

    def feed(self, state: dict, event: dict) -> list[dict]:
        # a name that comes back had no address before, though no timer has come by yet
        out = self.gone(event["__domain"], state, state["until"], False) if state["until"] is not None and state["until"] < event["__at"] else []
        if out:
            state.update(self.begin(event["__domain"]))
        changed, until = state["address"] != event["__address"], event["__at"] + event["__ttl"] * self.scale
        state.update(address=event["__address"], until=until if state["until"] is None else max(state["until"], until))
        return [*out, {"domain": event["__domain"], "address": event["__address"], "since": event["__at"]}] if changed else out

    def until(self, state: dict, at: int) -> int:
        return state["until"]

    def gone(self, key: str, state: dict, last: int, evicted: bool) -> list[dict]:
        return [{"domain": key, "address": None, "since": state["until"]}]


def asof_domain_stream(rows: DataFrame, dns: DataFrame, address: str, ts: str, late: str, ip: str = "ip", since: str = "inserted_at", ttl: str = "ttl", unit_ns: int = 1, buckets: int = 64) -> DataFrame:
    """asof_domain over a stream of rows and one of answers; times are in whole units of unit_ns nanoseconds (see held_fold). A name is
    forgotten when its time is up, so the state holds what counts just now. A row without an address has no name."""
    none = lambda kind: F.lit(None).cast(kind)
    given = [f"c_{c}" for c in rows.columns]
    left = dns.select(F.col(ip).alias("__address"), F.col(since).cast("long").alias("__ts"), F.lit(0).alias("__kind"), F.col("domain").alias("__domain"), F.col(ttl).cast("long").alias("__ttl"), *[none(rows.schema[c].dataType).alias(f"c_{c}") for c in rows.columns])
    right = rows.select(F.coalesce(F.col(address), none(dns.schema[ip].dataType)).alias("__address"), F.col(ts).cast("long").alias("__ts"), F.lit(1).alias("__kind"), none("string").alias("__domain"), none("long").alias("__ttl"), *[F.col(c).alias(f"c_{c}") for c in rows.columns])
    shape = StructType([*[StructField(f"c_{f.name}", f.dataType) for f in rows.schema], StructField("domain", StringType())])
    key = F.coalesce(F.col("__address").cast("string"), F.lit(""))
    out = held_fold(left.unionByName(right), key, functools.partial(NameFold, 1, given), shape, late, ts="__ts", order=["__kind", "__domain"], buckets=buckets, unit_ns=unit_ns)
    return out.select(*[F.col(f"c_{c}").alias(c) for c in rows.columns], "domain")


def address_stream(dns: DataFrame, late: str, ip: str = "ip", since: str = "inserted_at", ttl: str = "ttl", unit_ns: int = 1, buckets: int = 16) -> DataFrame:
    """The latest address of each domain as a stream of changes: domain, address (null once all answers have run out), since. Times are
    in whole units of unit_ns nanoseconds (see held_fold)."""
    rows = dns.select(F.col("domain").alias("__domain"), F.col(ip).alias("__address"), F.col(since).cast("long").alias("__ts"), F.col(ttl).cast("long").alias("__ttl"))
    shape = StructType([StructField("domain", StringType()), StructField("address", dns.schema[ip].dataType), *StructType.fromDDL("since long").fields])
    return held_fold(rows, F.col("__domain"), functools.partial(AddressFold, 1), shape, late, ts="__ts", order=["__address"], buckets=buckets, unit_ns=unit_ns)


# ---- libraries ----------------------------------------------------------------------------------------------------

class TargetFold(Fold):
    """A library, as long as scans find it: a row when it is found first, or again, and one when scans have missed it for so long."""

    def __init__(self, keep_ns: int):
        self.keep_ns = keep_ns

    def begin(self, key: str) -> dict:
        return {"last": None, "pid": None, "base": None}

    def feed(self, state: dict, event: dict) -> list[dict]:
        new = state["last"] is None or event["__at"] - state["last"] > self.keep_ns
        # one that comes back was missed before, though no timer has come by yet
        out = self.gone(event["path"], state, state["last"], False) if new and state["last"] is not None else []
        if state["last"] != event["__at"]:  # the first of a scan has the least pid
            state.update(last=event["__at"], pid=event["pid"], base=event["base"])
        return [*out, {"path": event["path"], "base": event["base"], "pid": event["pid"], "at": event["__at"], "change": "attach"}] if new else out

    def until(self, state: dict, at: int) -> int:
        return state["last"] + self.keep_ns

    def gone(self, key: str, state: dict, last: int, evicted: bool) -> list[dict]:
        return [{"path": key, "base": state["base"], "pid": state["pid"], "at": state["last"] + self.keep_ns, "change": "detach"}]


def target_stream(maps: DataFrame, every_ns: int, late: str, pattern: str = procfs.TLS_LIBRARY, buckets: int = 64) -> DataFrame:
    """What to attach to and to detach from as scans come in: path, base, pid (the least of the scan that has it), at, change. maps:
    scanned_ns, pid and content (the text of its maps). A library is gone when no scan has found it for one and a half times
    every_ns."""
    each = maps.select("scanned_ns", "pid", F.inline(procfs.mapped_files(F.col("content")))).filter(F.col("path").rlike(pattern)).select("scanned_ns", "path", "pid", "base")
    shape = StructType.fromDDL("path string, base long, pid long, at long, change string")
    return held_fold(each, F.col("path"), functools.partial(TargetFold, every_ns * 3 // 2), shape, late, ts="scanned_ns", order=["pid", "base"], buckets=buckets)


# ---- budgets ------------------------------------------------------------------------------------------------------

class TokenFold(Fold):
    """A token bucket of event time: `most` tokens, of which a tenth comes back each tick."""

    def __init__(self, most: int, tick_ns: int):
        self.most, self.tick_ns = most, tick_ns

    def begin(self, key: str) -> dict:
        return {"tokens": self.most, "tick": None}

    def feed(self, state: dict, event: dict) -> list[dict]:
        tick = event["__at"] // self.tick_ns
        if state["tick"] is not None:
            state["tokens"] = min(self.most, state["tokens"] + (tick - state["tick"]) * (self.most // 10))
        state["tick"] = tick
        if state["tokens"] == 0:
            return []
        state["tokens"] -= 1
        return [event]

    def until(self, state: dict, at: int) -> int | None:
        """A full bucket need not be kept."""
        return at + (-(-self.most // (self.most // 10)) + 1) * self.tick_ns if self.most >= 10 else None


class BudgetFold(Fold):
    """In each period the first row of each template, as many as the budget allows; no more templates are remembered than that."""

    def __init__(self, budget: int, period: int):
        self.budget, self.period = budget, period

    def begin(self, key: str) -> dict:
        return {"period": None, "seen": set()}

    def feed(self, state: dict, event: dict) -> list[dict]:
        now = event["__at"] // self.period
        if now != state["period"]:
            state.update(period=now, seen=set())
        if len(state["seen"]) >= self.budget or event["__template"] in state["seen"]:
            return []
        state["seen"].add(event["__template"])
        return [event]

    def until(self, state: dict, at: int) -> int:
        return (state["period"] + 1) * self.period


class HeadFold(Fold):
    """The first events of a key, as long as their sizes come to `most` at most."""

    def __init__(self, size: str, most: int, keep_ns: int):
        self.size, self.most, self.keep_ns = size, most, keep_ns

    def begin(self, key: str) -> dict:
        return {"so_far": 0}

    def feed(self, state: dict, event: dict) -> list[dict]:
        state["so_far"] += event[self.size] or 0
        return [event] if state["so_far"] <= self.most else []

    def until(self, state: dict, at: int) -> int:
        return at + self.keep_ns


def rate_limited_stream(events: DataFrame, most: int, late: str, host: str | None = None, ts: str = "timestamp_ns", order: list[str] | None = None, tick_ns: int = 100_000_000, buckets: int = 64) -> DataFrame:
    """rate_limited over a stream. 0 is no limit. Without a host there is one bucket of tokens, so one task counts for all."""
    if most == 0:
        return events
    key = F.col(host).cast("string") if host else F.lit("")
    return held_fold(events, F.coalesce(key, F.lit("")), functools.partial(TokenFold, most, tick_ns), events.schema, late, ts=ts, order=order, buckets=buckets)


def inference_budget_stream(rows: DataFrame, text: str, ts: str, budget: int, late: str, order: list[str], host: str | None = None, period: int = 1_000_000_000, buckets: int = 64) -> DataFrame:
    """inference_budget over a stream, with a budget for each host (one in all if None)."""
    keyed = rows.withColumn("__template", F.coalesce(templates.text_template(F.col(text)), F.lit("")))
    key = F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")
    return held_fold(keyed, key, functools.partial(BudgetFold, budget, period), rows.schema, late, ts=ts, order=order, buckets=buckets)


def head_only_stream(events: DataFrame, key: Column, size: str, most: int, late: str, keep_ns: int, order: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """head_only over a stream; a key silent for keep_ns begins anew."""
    return held_fold(events, key, functools.partial(HeadFold, size, most, keep_ns), events.schema, late, order=order, buckets=buckets)
