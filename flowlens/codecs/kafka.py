"""Kafka: requests and responses are rows of their own, joined on the correlation id."""

from __future__ import annotations

import struct

from flowlens.codecs.base import Codec, CodecError, Stream, elapsed, lossy, message, number

MOST_PENDING, MOST_BYTES = 256, 16 * 1024 * 1024
#: Names of the API keys, from 0.
API_NAMES = (
    "Produce", "Fetch", "ListOffsets", "Metadata", "LeaderAndIsr", "StopReplica", "UpdateMetadata", "ControlledShutdown", "OffsetCommit", "OffsetFetch",
    "FindCoordinator", "JoinGroup", "Heartbeat", "LeaveGroup", "SyncGroup", "DescribeGroups", "ListGroups", "SaslHandshake", "ApiVersions", "CreateTopics",
    "DeleteTopics",
)
#: Bytes of a Produce (0) and a Fetch (1) request before its topics, and the fewest it can have.
TOPIC_AT = {0: (6, 12), 1: (12, 16)}


def api_name(key: int) -> str:
    return API_NAMES[key] if 0 <= key < len(API_NAMES) else f"Unknown({key})"


def _string(body: bytes, at: int) -> str | None:
    size = number(body, at, 2, signed=True)
    return lossy(body[at + 2:at + 2 + size]) if len(body) >= at + 2 and size > 0 and len(body) >= at + 2 + size else None


def topic_of(key: int, body: bytes) -> str | None:
    """The first topic, if the request has one where its simplest form has it: after a count of topics, or at once."""
    at, least = TOPIC_AT.get(key, (0, 0))
    if not least or len(body) < least:
        return None
    if len(body) >= at + 6 and 0 < number(body, at, 4, signed=True) < 1000 and (name := _string(body, at + 4)):
        return name
    return _string(body, at)


class KafkaCodec(Codec):
    protocol = "kafka"

    def __init__(self):
        super().__init__()
        self.client, self.server = Stream(MOST_BYTES + 4), Stream(MOST_BYTES + 4)
        self.pending: dict[int, list[tuple[str, str | None, int]]] = {}
        self.held = 0

    def _frames(self, stream):
        held = stream.data
        while len(held) >= 4:
            size = int.from_bytes(held[:4], "big", signed=True)
            if not 0 < size <= MOST_BYTES:
                raise CodecError(f"message size {size}")
            if len(held) < 4 + size:
                break
            yield stream.take(4 + size)[4:]
        self.state = "buffering" if held else "idle"

    def advance(self, ts: int):
        for body in self._frames(self.client):
            if len(body) < 8:
                continue
            key, version, correlation = struct.unpack_from(">hhi", body)
            client = _string(body, 8)
            at = min(len(body), 10 + (len(client.encode()) if client else 0))
            name, topic = api_name(key), topic_of(key, body[at:])
            if self.held >= MOST_PENDING:
                oldest = next(iter(self.pending))
                self._drop(oldest)
            self.pending.setdefault(correlation, []).append((name, topic, ts))
            self.held += 1
            yield message("kafka", ts, "egress", method=name, path=topic, payload_text=client, request_size_bytes=len(body) + 4, headers=[("api_version", str(version))])
        for body in self._frames(self.server):
            if len(body) < 4:
                continue
            code = number(body, 8, 2, signed=True) if len(body) >= 10 else 0
            out = message("kafka", ts, status=code % (1 << 32), response_size_bytes=len(body) + 4)
            found = self._drop(number(body, 0, 4, signed=True))
            if found:
                out |= {"method": found[0], "path": found[1], "latency_ns": elapsed(ts, found[2])}
            yield out

    def _drop(self, correlation: int):
        """Takes out the oldest request of a correlation id."""
        waiting = self.pending.get(correlation)
        if not waiting:
            return None
        found = waiting.pop(0)
        self.held -= 1
        if not waiting:
            del self.pending[correlation]
        return found
