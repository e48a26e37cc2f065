"""HTTP/2 and gRPC: frames of many streams, a request and its response as one message.

A message is complete when its response ends, on whatever frame carries the end. Each direction has its own header table.
"""

from __future__ import annotations

from flowlens.codecs.base import TEXT_LIMIT, Codec, elapsed, message, number, strict_text
from flowlens.codecs.hpack import Decoder

PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
#: Frame kinds and flags.
DATA, HEADERS, CONTINUATION = 0, 1, 9
END_STREAM, END_HEADERS, PADDED, PRIORITY = 1, 4, 8, 32


class Exchange:
    """What is known of one stream."""

    def __init__(self, ts: int):
        self.begun = ts
        self.fields: dict = {"method": None, "path": None, "status": None, "content_type": None}
        self.headers: list[tuple[str, str]] = []
        self.block = bytearray()
        self.ends = False  # the header block under way ends its side of the stream
        self.asked: bool | None = None  # the direction of the request, True for egress
        self.answering = False
        self.sizes = [0, 0]
        self.body = bytearray()
        self.asking = bytearray()  # the request's body, once it is complete


class Http2Codec(Codec):
    protocol = "http2"

    def __init__(self, grpc: bool = False):
        super().__init__()
        self.version = "2"
        self.state = "preface"
        self.grpc = grpc
        self.decoders = {True: Decoder(), False: Decoder()}
        self.exchanges: dict[int, Exchange] = {}

    def feed(self, data: bytes, egress: bool, ts: int) -> list[dict]:
        stream = self.client if egress else self.server
        stream.push(data)
        held = stream.data
        if held.startswith(PREFACE):
            stream.take(len(PREFACE))
            self.state = "streaming"
        elif 3 <= len(held) < len(PREFACE) and PREFACE.startswith(held):
            return []
        out = []
        while len(held) >= 9:
            size = held[0] << 16 | held[1] << 8 | held[2]
            if len(held) < 9 + size:
                break
            self.state = "streaming"
            frame = stream.take(9 + size)
            done = self._frame(frame[3], frame[4], number(frame, 5, 4) & 0x7FFFFFFF, frame[9:], egress, ts)
            if done:
                out.append(done)
        return out

    def _frame(self, kind: int, flags: int, number_: int, payload: bytes, egress: bool, ts: int) -> dict | None:
        if kind not in (DATA, HEADERS, CONTINUATION):
            return None
        if kind != CONTINUATION and flags & PADDED and payload:
            payload = payload[1:max(1, len(payload) - payload[0])]
        if kind == HEADERS and flags & PRIORITY:
            payload = payload[5:]
        exchange = self.exchanges.get(number_)
        if exchange is None:
            exchange = self.exchanges[number_] = Exchange(ts)
        if kind == DATA:
            side = int(exchange.answering if exchange.asked is None else egress != exchange.asked or exchange.answering)
            exchange.sizes[side] += len(payload)
            exchange.body += payload[:max(0, TEXT_LIMIT - len(exchange.body))]
            return self._ended(number_, ts) if flags & END_STREAM else None
        exchange.block += payload
        exchange.ends = exchange.ends or bool(flags & END_STREAM and kind == HEADERS)
        if not flags & END_HEADERS:
            return None
        block, exchange.block = bytes(exchange.block), bytearray()
        self._headers(exchange, self.decoders[egress].decode(block), egress)
        ends, exchange.ends = exchange.ends, False
        return self._ended(number_, ts) if ends else None

    def _headers(self, exchange: Exchange, headers: list[tuple[str, str]], egress: bool) -> None:
        for name, value in headers:
            name = name.lower()
            if name in (":method", ":path"):
                exchange.fields[name[1:]] = value
                exchange.asked = egress
            elif name == ":status":
                exchange.answering = True
                exchange.fields["status"] = int(value) if value.isdigit() else None
            elif name == "content-type":
                exchange.fields["content_type"] = value
                self.grpc = self.grpc or value.startswith("application/grpc")
            elif name == "grpc-status" and value.isdigit():
                exchange.fields["status"] = int(value)
            exchange.headers.append((name, value))

    def _ended(self, number_: int, ts: int) -> dict | None:
        exchange = self.exchanges[number_]
        if not exchange.answering:
            exchange.asking, exchange.body = exchange.body, bytearray()
            return None  # the request's side; the response is still to come
        del self.exchanges[number_]
        out = message("grpc" if self.grpc else "http2", ts, headers=exchange.headers, request_size_bytes=exchange.sizes[0], response_size_bytes=exchange.sizes[1], payload_text=strict_text(exchange.body or exchange.asking), latency_ns=elapsed(ts, exchange.begun), **exchange.fields)
        if self.grpc and out["path"] and out["path"].startswith("/") and "/" in out["path"][1:]:
            out["method"] = out["path"][1:]  # package.Service/Method
        return out
