"""Folds over streams in the order of event time: what a batch operator does after a sort, done as events come.

Keys are dealt to buckets, and a bucket is what Spark groups by, so that a batch costs calls by bucket, not by key. Events
wait in their bucket until the watermark has passed them, in a map by slot of time: each batch adds its own entries, and
none is read or written again before its slot's turn; only slots of very few events share an entry. One timer a bucket stands at the next slot. A slot's events are then
put in order and folded, each into the state of its key. States lie apart in another map, in pages of many keys, as every
call to a store has its price; a slot is folded page by page, so a page is read and written once and one is held at a time.
Where nothing waits, a batch is laid by page too if it is long, so memory doesn't grow with it. When a key was seen last is
kept for the whole bucket: by that, silent keys are dropped, and the longest silent first where only so many are kept.
"""

from __future__ import annotations

import heapq
import pickle
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from flowlens.session import ship

# Spark also unpickles a processor in a driver-side worker, which has no shipped packages: the class goes by value, and
# what it needs is imported where its rows are handled
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_MS = 1_000_000
#: Pages of a bucket's states, and rows of an output frame or of what is laid by at once.
_PAGES, _FRAME = 32, 10_000
#: So many slots that follow one another share a part where they hold fewer events each than this.
_RUN, _FEW = 256, 4


class Fold:
    """What is done with the events of a key, in order. States are plain objects that pickle can store."""

    def begin(self, key: str):
        """The state of a key that was not known."""
        raise NotImplementedError

    def feed(self, state, event: dict) -> list[dict]:
        """The rows that an event completes; the state is changed in place."""
        raise NotImplementedError

    def until(self, state, at: int) -> int | None:
        """How long the key stays after an event at this time if no other comes; None: for ever."""
        return None

    def gone(self, key: str, state, last: int, evicted: bool) -> list[dict]:
        """The rows of a key that is dropped: silent for long, or (evicted) the longest silent of too many."""
        return []

    def grown(self, live: int, capacity: int, event: dict) -> list[dict]:
        """The rows for an event whose key is the `live`-th that is kept, of `capacity` at most."""
        return []


class HeldProcessor(StatefulProcessor):
    """Runs a fold for a bucket of keys. held: events wait for the watermark; else those of a batch are put in order and folded
    at once. capacity: how many keys of the bucket are kept at most. whole: columns of whole numbers, of which the bits of
    `nulls` say which are null. Columns come numbered, as Spark hands rows on as named tuples, which don't take every name.
    Times and slots are in units, of which per_ms make a millisecond of the watermark."""

    def __init__(self, make: Callable[[], Fold], columns: list[str], whole: list[str], out: list[str], order: list[str], slot: int, capacity: int | None, held: bool, per_ms: int = _MS):
        self.make, self.columns, self.whole, self.out, self.order = make, columns, whole, out, order
        self.slot, self.capacity, self.held, self.per_ms = slot, capacity, held, per_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "due long, parts long, known binary")
        self.waiting = handle.getMapState("waiting", "slot long, part long", "events binary")
        self.states = handle.getMapState("states", "page long", "states binary")
        self.fold = self.make()

    def close(self) -> None:
        pass

    # ---- what a bucket knows ----

    def _load(self) -> None:
        kept = self.meta.get()
        self.due, self.parts = (kept[0], kept[1]) if kept else (0, 0)
        # when each key was seen last and until when it stays; the parts of each slot that waits
        self.seen: dict[str, tuple[int, int | None]]
        self.slots: dict[int, list[int]]
        self.wide: set[tuple[int, int]]  # parts that hold more slots than the one they begin with
        self.seen, self.slots, *more = pickle.loads(kept[2]) if kept else ({}, {})
        self.wide = more[0] if more else set()
        self.pages: dict[int, dict[str, object]] = {}
        self.stored: set[int] = set()  # pages at hand that the store has too
        self.heap: list[tuple[int, str]] | None = None

    def _store(self) -> None:
        self._flush()
        self.meta.update((self.due, self.parts, pickle.dumps((self.seen, self.slots, self.wide))))

    def _flush(self) -> None:
        for page, states in self.pages.items():
            if states:
                self.states.updateValue((page,), (pickle.dumps(states),))
            elif page in self.stored:
                self.states.removeKey((page,))
        self.pages.clear()
        self.stored.clear()

    def _page(self, key: str) -> int:
        return zlib.crc32(key.encode("utf-8", "surrogatepass")) % _PAGES

    def _states(self, key: str) -> dict[str, object]:
        """The states of the key's page. Without a capacity, keys come page by page, so only one is held; with one, few are kept."""
        page = self._page(key)
        if page not in self.pages:
            if self.capacity is None:
                self._flush()
            kept = self.states.getValue((page,))
            self.pages[page] = pickle.loads(kept[0]) if kept else {}
            if kept:
                self.stored.add(page)
        return self.pages[page]

    def _drop(self, key: str, evicted: bool) -> list[dict]:
        return self.fold.gone(key, self._states(key).pop(key), self.seen.pop(key)[0], evicted)

    # ---- folding ----

    def _oldest(self) -> str:
        """The key seen last the longest ago, of equal ones the least. The heap also holds old times, which are passed over."""
        if self.heap is None or len(self.heap) > 4 * len(self.seen) + 64:
            self.heap = [(last, key) for key, (last, _) in self.seen.items()]
            heapq.heapify(self.heap)
        while self.heap[0][0] != self.seen.get(self.heap[0][1], (None,))[0]:
            heapq.heappop(self.heap)
        return self.heap[0][1]

    def _ordered(self, parts: Iterable[list[tuple]]) -> list[tuple]:
        """The rows of parts in order: of time, and without a capacity of pages before that."""
        rows = [row for part in parts for row in part]
        order = [self.columns.index(c) for c in self.order]
        rank = lambda x: (True, 0) if x is None or x != x else (False, x)
        if self.capacity is None:
            rows.sort(key=lambda r: (self._page(r[-3]), r[-2], *[rank(r[i]) for i in order]))
        else:
            rows.sort(key=lambda r: (r[-2], *[rank(r[i]) for i in order]))
        return rows

    def _events(self, parts: Iterable[list[tuple]]) -> Iterator[dict]:
        """The rows in order, as plain values."""
        for *values, key, at, nulls in self._ordered(parts):
            event = dict(zip(self.columns, values, strict=True))
            if nulls:
                event |= {c: None for i, c in enumerate(self.whole) if nulls >> i & 1}
            yield event | {"__key": key, "__at": at}

    def _folded(self, parts: Iterable[list[tuple]]) -> Iterator[pd.DataFrame]:
        """Frames of what the fold gives; the rows of a frame are in order of time, whatever page they come from."""
        out: list[tuple[int, dict]] = []
        for event in self._events(parts):
            key, at = event["__key"], event["__at"]
            new, rows = key not in self.seen, []
            if new:
                full = self.capacity is not None and len(self.seen) >= self.capacity
                if full:
                    rows += self._drop(self._oldest(), True)
                self._states(key)[key] = self.fold.begin(key)
            state = self._states(key)[key]
            rows += self.fold.feed(state, event)
            self.seen[key] = (at, self.fold.until(state, at))
            if self.heap is not None:
                heapq.heappush(self.heap, (at, key))
            if new and self.capacity is not None and not full:
                rows += self.fold.grown(len(self.seen), self.capacity, event)
            out += [(at, row) for row in rows]
            if len(out) >= _FRAME:
                yield self._frame([row for _, row in sorted(out, key=lambda x: x[0])])
                out = []
        if out:
            yield self._frame([row for _, row in sorted(out, key=lambda x: x[0])])

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in self.out})

    def _expired(self, now: int) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for key in sorted((k for k, (_, until) in self.seen.items() if until is not None and until < now), key=self._page):
            rows += self._drop(key, False)
            if len(rows) >= _FRAME:
                yield self._frame(rows)
                rows = []
        if rows:
            yield self._frame(rows)

    # ---- what Spark calls ----

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        held, waiting, latest = 0, [], None
        for part in rows:
            waiting.append(part)
            held += len(part)
            if not self.held:
                now = int(part["at"].max())
                latest = now if latest is None else max(latest, now)
            # with a capacity, events of all keys go in one order, so a batch can't be taken apart by key
            if held >= _FRAME and (self.held or self.capacity is None):
                self._lay_by(waiting)
                held, waiting = 0, []
        if self.held:
            if waiting:
                self._lay_by(waiting)
            self._next()
        else:
            if self.slots and waiting:
                self._lay_by(waiting)
            if self.slots:
                yield from self._due()
            elif waiting:
                yield from self._folded([self._rows(part) for part in waiting])
            yield from self._expired(latest)
        self._store()

    def _rows(self, frame: pd.DataFrame) -> list[tuple]:
        """Plain values: the columns, then key, at and nulls."""
        return list(zip(*[frame[c].tolist() for c in (*[f"c{i}" for i in range(len(self.columns))], "key", "at", "nulls")], strict=True))

    def _lay_by(self, parts: list[pd.DataFrame]) -> None:
        """By slot of time, or by page where events don't wait."""
        frame = pd.concat(parts, ignore_index=True)
        slots = frame["slot"].to_numpy() if self.held else np.array([self._page(key) for key in frame["key"]])
        order = np.argsort(slots, kind="stable")
        events = self._rows(frame.take(order))
        values, firsts = np.unique(slots[order], return_index=True)
        found = [(slot, events[a:b]) for slot, a, b in zip(values.tolist(), firsts.tolist(), [*firsts.tolist()[1:], len(frame)], strict=True)]
        self._keep(found)

    def _keep(self, found: list[tuple[int, list[tuple]]]) -> None:
        """Stores the events of slots as a part each; where there are few to a slot, many slots share one, as a call costs more than
        they do."""
        for i in range(0, len(found), _RUN):
            run = found[i:i + _RUN]
            wide = self.held and len(run) > 1 and sum(len(events) for _, events in run) < _FEW * len(run)
            for first, value in [(run[0][0], run)] if wide else run:
                self.waiting.updateValue((first, self.parts), (pickle.dumps(value),))
                self.slots.setdefault(first, []).append(self.parts)
            if wide:
                self.wide.add((run[0][0], self.parts))
        self.parts += 1

    def _due(self, last: int | None = None) -> Iterator[pd.DataFrame]:
        """Folds what waits in the slots up to the last one that is due (None: in all), in their order; slots of few events go
        together, so that a page serves them all."""
        firsts = sorted(slot for slot in self.slots if last is None or slot <= last)
        at_hand: dict[int, list[list[tuple]]] = {}
        ready: list[list[tuple]] = []
        for i, first in enumerate(firsts):
            for p in self.slots.pop(first):
                value = pickle.loads(self.waiting.getValue((first, p))[0])
                self.waiting.removeKey((first, p))
                for slot, events in value if (first, p) in self.wide else [(first, value)]:
                    at_hand.setdefault(slot, []).append(events)
                self.wide.discard((first, p))
            # a slot is whole when no other part can hold events of it
            whole = firsts[i + 1] - 1 if i + 1 < len(firsts) else last
            for slot in sorted(slot for slot in at_hand if whole is None or slot <= whole):
                ready += at_hand.pop(slot)
            if i + 1 == len(firsts) or sum(map(len, ready)) >= _FRAME:
                yield from self._folded(ready)
                ready = []
        if at_hand:  # not due yet
            self._keep([(slot, [row for part in parts for row in part]) for slot, parts in sorted(at_hand.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self.due = 0  # it has fired
        # the end of the last slot that the watermark has passed: what lies between the two still waits, and its keys with it
        now = timerValues.getCurrentWatermarkInMs() * self.per_ms // self.slot * self.slot
        yield from self._due(now // self.slot - 1)
        yield from self._expired(now)
        self._next()
        self._store()

    def _next(self) -> None:
        """One timer: at the end of the next slot that holds events; without any, of the one where the longest silent key is to go."""
        due = self.due
        if self.slots:
            due = (min(self.slots) + 1) * self.slot // self.per_ms
            due = min(due, self.due) if self.due else due
        elif not self.due and (ends := [until for _, until in self.seen.values() if until is not None]):
            due = (min(ends) // self.slot + 1) * self.slot // self.per_ms
        if due != self.due:
            if self.due:
                self.handle.deleteTimer(self.due)
            self.handle.registerTimer(due)
            self.due = due


def _milliseconds(interval: str) -> int:
    """"10 seconds" and the like."""
    number, unit = interval.split()
    return int(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def held_fold(rows: DataFrame, key: Column, make: Callable[[], Fold], shape: StructType, late: str | None, ts: str = "timestamp_ns", order: list[str] | None = None,
              capacity: int | None = None, buckets: int = 64, slots: int = 16, unit_ns: int = 1) -> DataFrame:
    """The rows (as shape) that a fold gives for a stream of rows, taken in the order of `ts` (units of unit_ns) and `order` in each key.

    late: how late an event may come ("10 seconds"); what comes later is dropped, and what the watermark never passes waits on.
    None: nothing waits, and order is restored inside a batch only. buckets: how many groups Spark sees; a few for each core.
    slots: into how many slots of time `late` is cut. A key is never split: its events must be folded one after the other.
    capacity is the table's, so each bucket keeps its share of it. Rows without a key or a time are left out.
    unit_ns: 1 for nanoseconds, which end in 2262, or whole milliseconds. Of those a unit is a millisecond of the watermark, a clock
    of its own that does not go with other watermarks in the query: event time reaches Python as nanoseconds whatever its unit.
    """
    spark = rows.sparkSession
    if spark.conf.get(_PROVIDER, None) != ROCKSDB:
        raise ValueError(f"keyed state needs {_PROVIDER} to be {ROCKSDB}")
    ship(spark)
    columns, whole = list(rows.columns), [f.name for f in rows.schema if isinstance(f.dataType, IntegralType)]
    if unit_ns != 1 and unit_ns % _MS:
        raise ValueError("a unit is a nanosecond or whole milliseconds")
    per_ms, clock_ms = (_MS, 1) if unit_ns == 1 else (1, unit_ns // _MS)
    late_ms = -(-_milliseconds(late) // clock_ms) if late else 0
    slot = max(1, late_ms // slots) * per_ms
    share = None if capacity is None else max(1, -(-capacity // buckets))
    nulls = [F.when(F.col(c).isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(whole)]
    given = [(F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) if c in whole else F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    keyed = rows.select(*given, key.cast("string").alias("key"), F.col(ts).cast("long").alias("at"), sum(nulls, F.lit(0).cast("long")).alias("nulls")).filter("key is not null and at is not null")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    processor = HeldProcessor(make, columns, whole, shape.names, order or [], slot, share, late is not None, per_ms)
    if late is None:
        return keyed.groupBy("bucket").transformWithStateInPandas(processor, shape, "append", "none")
    event_time = F.timestamp_micros(F.floor(F.col("at") / 1000)) if unit_ns == 1 else F.timestamp_millis("at")
    timed = keyed.withColumns({"slot": F.floor(F.col("at") / slot), "event_time": event_time}).withWatermark("event_time", f"{late_ms} milliseconds")
    return timed.groupBy("bucket").transformWithStateInPandas(processor, shape, "append", "eventTime")


def use_keyed_state(spark) -> None:
    """Sets the state store that keyed state needs, for queries of this session that start from now on."""
    spark.conf.set(_PROVIDER, ROCKSDB)
