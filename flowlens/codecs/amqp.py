"""AMQP 0-9-1: a row for each method frame; content frames and heartbeats are passed over."""

from __future__ import annotations

from flowlens.codecs.base import Codec, CodecError, lossy, message, number

HEADER = b"AMQP\x00\x00\x09\x01"
FRAME_END, MOST_BYTES, METHOD = 0xCE, 256 * 1024, 1
#: Names of the methods by class and method id.
METHODS = {
    (10, 10): "Connection.Start", (10, 11): "Connection.StartOk", (10, 30): "Connection.Tune", (10, 31): "Connection.TuneOk", (10, 40): "Connection.Open",
    (10, 41): "Connection.OpenOk", (10, 50): "Connection.Close", (10, 51): "Connection.CloseOk", (20, 10): "Channel.Open", (20, 11): "Channel.OpenOk",
    (20, 40): "Channel.Close", (20, 41): "Channel.CloseOk", (40, 10): "Exchange.Declare", (40, 11): "Exchange.DeclareOk", (50, 10): "Queue.Declare",
    (50, 11): "Queue.DeclareOk", (50, 20): "Queue.Bind", (50, 21): "Queue.BindOk", (60, 20): "Basic.Qos", (60, 21): "Basic.QosOk", (60, 40): "Basic.Publish",
    (60, 50): "Basic.Return", (60, 60): "Basic.Deliver", (60, 70): "Basic.Get", (60, 71): "Basic.GetOk", (60, 80): "Basic.Ack", (60, 90): "Basic.Reject",
    (60, 120): "Basic.Nack",
}


def _strings(args: bytes, at: int, n: int) -> tuple[list[str], int]:
    """Up to n short strings from `at` on, as many as are whole, and where they end."""
    out = []
    while len(out) < n and at < len(args) and at + 1 + args[at] <= len(args):
        out.append(lossy(args[at + 1:at + 1 + args[at]]))
        at += 1 + args[at]
    return out, at


def _route(exchange: str, key: str) -> str:
    return f"{exchange}/{key}" if exchange else key


class AmqpCodec(Codec):
    protocol = "amqp"

    def __init__(self):
        super().__init__()
        self.state = "awaiting_header"

    def feed(self, data: bytes, egress: bool, ts: int) -> list[dict]:
        stream = self.client if egress else self.server
        stream.push(data)
        return list(self._frames(stream, "egress" if egress else "ingress", ts))

    def _frames(self, stream, direction: str, ts: int):
        if self.state == "awaiting_header":
            if len(stream) < 8:
                return
            self.state = "connected"
            if stream.data.startswith(b"AMQP") and stream.take(8) == HEADER:  # another version's header is passed over
                yield message("amqp", ts, direction, method="ProtocolHeader", status=0)
        held = stream.data
        while len(held) >= 7:
            size = int.from_bytes(held[3:7], "big")
            if size > MOST_BYTES:
                raise CodecError(f"frame size {size}")
            if len(held) < size + 8:
                return
            frame = stream.take(size + 8)
            if frame[-1] != FRAME_END:
                raise CodecError("bad end of frame")
            if frame[0] == METHOD and size >= 4:
                yield self._method(number(frame, 7, 2), number(frame, 9, 2), frame[11:-1], direction, ts)

    @staticmethod
    def _method(kind: int, method: int, args: bytes, direction: str, ts: int) -> dict:
        out = message("amqp", ts, direction, method=METHODS.get((kind, method), "Unknown"), status=0)
        if (kind, method) == (50, 10):
            out["path"] = next(iter(_strings(args, 2, 1)[0]), None)
        elif (kind, method) == (60, 40):
            found = _strings(args, 2, 2)[0]
            out["path"] = _route(*found) if len(found) == 2 else next((x for x in found if x), None)
        elif (kind, method) == (60, 60):
            tag, at = _strings(args, 0, 1)
            found = _strings(args, at + 9, 2)[0] if tag else []
            out["path"] = _route(*found) if len(found) == 2 else None
        elif (kind, method) in ((10, 50), (20, 40)) and len(args) >= 2:
            out["status"] = number(args, 0, 2)
            out["payload_text"] = next(iter(_strings(args, 2, 1)[0]), None)
        return out
