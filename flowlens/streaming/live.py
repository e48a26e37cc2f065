"""Counters of a running job: they are observed in passing, by the pass that does the work, and reported now and then."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowlens.operators.metrics import COUNTERS
from flowlens.schema import BACKPRESSURE_SHARE

#: What each place of the job counts: as DataFrame.observe takes it, by the name of the place.
PLACES = {
    "received": lambda: [F.count(F.lit(1)).alias("events_received")],
    "admitted": lambda: [F.count(F.lit(1)).alias("events_admitted")],
    "messages": lambda: [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull() & ~F.col("error").isin("evicted", "capacity")).alias("drops_parser_error")],
    "scanned": lambda: [F.coalesce(F.sum(F.coalesce(F.size("pii.entities"), F.lit(0))), F.lit(0)).alias("pii_detections")],
}


def counted(rows: DataFrame, place: str, observation: Observation | None = None) -> DataFrame:
    """rows, counted as they go by. With an observation (a batch) that gets the numbers; without one (a stream) the query's progress
    has them under the place's name."""
    return rows.observe(observation or place, *PLACES[place]())


class Counters:
    """Numbers of all places, added up."""

    def __init__(self) -> None:
        self.found = dict.fromkeys((*COUNTERS, "events_admitted", "rows"), 0)

    def add(self, numbers: dict[str, int]) -> None:
        for name, n in numbers.items():
            self.found[name] = self.found.get(name, 0) + (n or 0)

    def totals(self) -> dict[str, int]:
        """The counters by name: what was received and not admitted was over the limit."""
        f = self.found
        limited = max(0, f["events_received"] - f["events_admitted"]) if f["events_admitted"] else 0
        dropped = limited + f["drops_parser_error"]
        return {c: f[c] for c in COUNTERS} | {"drops_rate_limit": limited, "events_dropped": dropped, "events_processed": f["events_received"] - dropped}

    def line(self, before: dict[str, int] | None = None) -> str:
        """What happened since `before`, on one line; with a warning where over 5 % of it was dropped."""
        now = self.totals()
        since = {c: now[c] - (before or {}).get(c, 0) for c in now}
        shown = " ".join(f"{c}={n}" for c, n in since.items() if n)
        warned = since["events_received"] > 0 and since["events_dropped"] > BACKPRESSURE_SHARE * since["events_received"]
        return ("WARNING: over 5 % dropped: " if warned else "") + (shown or "nothing new")


class Report(StreamingQueryListener):
    """Adds up what the queries of a session observe, and says so every `period` seconds. Runs on the driver, on numbers only."""

    def __init__(self, period: float = 10.0, say: Callable[[str], None] = print, clock: Callable[[], float] = time.monotonic):
        self.counters, self.period, self.say, self.clock = Counters(), period, say, clock
        self.last, self.before = clock(), None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for place, row in (event.progress.observedMetrics or {}).items():
            if place in PLACES:
                self.counters.add(row.asDict())
        if self.clock() - self.last >= self.period:
            self.say(self.counters.line(self.before))
            self.last, self.before = self.clock(), self.counters.totals()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say(self.counters.line(self.before))
        self.before = self.counters.totals()
