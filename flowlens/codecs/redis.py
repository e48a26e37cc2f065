"""Redis (RESP2): commands are queued, and each reply answers the oldest."""

from __future__ import annotations

from collections import deque

from flowlens.codecs.base import Codec, CodecError, elapsed, lossy, message

MOST_DEPTH = 64
KINDS = b"+-:$*"
SHOWN = {":": "(integer) ", "-": "(error) "}


class Reply:
    """A value: kind is one of + - : $ *, value None for the null ones."""

    __slots__ = ("kind", "value")

    def __init__(self, kind: str, value):
        self.kind, self.value = kind, value

    def plain(self) -> str | None:
        """As an argument of a command; None for what can't be one."""
        if self.kind in "-*" or self.value is None:
            return None
        return str(self.value)

    def text(self) -> str:
        if self.value is None:
            return "(nil)"
        if self.kind == "*":
            return ", ".join(x.text() for x in self.value)
        return SHOWN.get(self.kind, "") + str(self.value)


def _count(raw: bytes) -> int:
    try:
        return int(raw) if raw.isdigit() else int(raw.decode("ascii")) if raw.lstrip(b"+-").isdigit() else int("x")
    except ValueError:
        raise CodecError("malformed number") from None


def read_value(data: bytearray, at: int = 0, depth: int = 0) -> tuple[Reply, int] | None:
    """The value that begins at `at` and where it ends; None if bytes are missing."""
    line = data.find(b"\r\n", at)
    if at < len(data) and data[at] not in KINDS or depth > MOST_DEPTH:
        raise CodecError("no RESP value")
    if line < 0:
        return None
    kind, body, at = chr(data[at]), bytes(data[at + 1:line]), line + 2
    if kind in "+-":
        return Reply(kind, lossy(body)), at
    n = _count(body)
    if kind == ":":
        return Reply(kind, n), at
    if n < 0:
        return Reply(kind, None), at
    if kind == "$":
        return (Reply(kind, lossy(data[at:at + n])), at + n + 2) if len(data) >= at + n + 2 else None
    items = []
    for _ in range(n):
        found = read_value(data, at, depth + 1) if at < len(data) else None
        if found is None:
            return None
        items.append(found[0])
        at = found[1]
    return Reply(kind, items), at


class RedisCodec(Codec):
    protocol = "redis"

    def __init__(self):
        super().__init__()
        self.pending: deque[tuple[list[str], int]] = deque()

    def _values(self, stream):
        while stream.data:
            found = read_value(stream.data)
            if found is None:
                self.state = "parsing"
                return
            stream.take(found[1])
            self.state = "idle"
            yield found[0]

    def advance(self, ts: int):
        for value in self._values(self.client) if self.client.data else ():
            parts = [p for x in (value.value or [] if value.kind == "*" else [value]) if (p := x.plain()) is not None]
            if parts:
                self.pending.append((parts, ts))
        for value in self._values(self.server) if self.server.data else ():
            failed = value.kind == "-"
            out = message("redis", ts, status=int(failed), payload_text=value.value if failed else value.text())
            if self.pending:
                parts, since = self.pending.popleft()
                out |= {"method": parts[0].upper(), "path": parts[1] if len(parts) > 1 else None, "latency_ns": elapsed(ts, since)}
            yield out
