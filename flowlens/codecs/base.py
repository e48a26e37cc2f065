"""What every codec shares: a bounded byte stream for each direction, and the message row."""

from __future__ import annotations

STREAM_LIMIT = 256 * 1024
TEXT_LIMIT = 65536
SQL_TEXT_LIMIT = 4096


class CodecError(Exception):
    """The bytes can't be what the codec expects; the session begins anew."""


class Stream:
    """Bytes received in one direction and not yet used."""

    def __init__(self, limit: int = STREAM_LIMIT):
        self.data = bytearray()
        self.limit = limit

    def push(self, more: bytes) -> None:
        if len(self.data) + len(more) > self.limit:
            raise CodecError("stream overflow")
        self.data += more

    def take(self, n: int) -> bytes:
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def __len__(self) -> int:
        return len(self.data)


def number(data: bytes | bytearray, at: int, size: int, signed: bool = False, little: bool = False) -> int:
    return int.from_bytes(data[at:at + size], "little" if little else "big", signed=signed)


def lossy(data: bytes | bytearray) -> str:
    return data.decode("utf-8", "replace")


def capped(text: str, limit: int) -> str:
    """At most `limit` bytes of UTF-8, cut before a character rather than inside it."""
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")


def strict_text(data: bytes | bytearray, limit: int = TEXT_LIMIT) -> str | None:
    """data as text; None if it is empty or not UTF-8."""
    if not data:
        return None
    try:
        return capped(bytes(data).decode(), limit)
    except UnicodeDecodeError:
        return None


def elapsed(now: int, since: int | None) -> int | None:
    return None if since is None else max(0, now - since)


def message(protocol: str, ts: int, direction: str = "ingress", **fields) -> dict:
    row = {
        "protocol": protocol, "direction": direction, "timestamp_ns": ts, "latency_ns": None, "method": None, "path": None, "status": None,
        "content_type": None, "payload_text": None, "headers": [], "request_size_bytes": 0, "response_size_bytes": 0,
    }
    row.update(fields)
    return row


class Codec:
    """One connection's parser. feed() takes the next bytes of one direction and returns the messages that they complete."""

    protocol = "unknown"

    def __init__(self):
        self.client, self.server = Stream(), Stream()
        self.version: str | None = None
        self.state = "idle"

    def feed(self, data: bytes, egress: bool, ts: int) -> list[dict]:
        (self.client if egress else self.server).push(data)
        return list(self.advance(ts))

    def advance(self, ts: int):
        raise NotImplementedError
