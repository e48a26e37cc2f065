"""Exchanges as bytes: what a client and a server would send, for fixtures and round trips."""

from __future__ import annotations

import struct
from collections.abc import Callable

from flowlens.codecs.amqp import HEADER as AMQP_HEADER
from flowlens.codecs.http1 import RESPONSE
from flowlens.codecs.http2 import PREFACE

Step = tuple[bool, bytes]  # from the client, and the bytes


def http1(n: int, k: int) -> list[Step]:
    body = b'{"item": %d}' % k
    return [(True, b"GET /users/%d/items/%d HTTP/1.1\r\nHost: shop\r\n\r\n" % (n, k)), (False, b"HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body))]


def _frame(kind: int, flags: int, stream: int, payload: bytes) -> bytes:
    return len(payload).to_bytes(3, "big") + bytes([kind, flags]) + stream.to_bytes(4, "big") + payload


def _literal(name: bytes, value: bytes) -> bytes:
    return bytes([0, len(name)]) + name + bytes([len(value)]) + value


def http2(n: int, k: int) -> list[Step]:
    ask = b"\x82" + _literal(b":path", b"/users/%d/items/%d" % (n, k))
    body = b"item %d" % k
    return [(True, PREFACE + _frame(4, 0, 0, b"") + _frame(1, 5, 1, ask)), (False, _frame(1, 4, 1, b"\x88" + _literal(b"content-type", b"text/plain")) + _frame(0, 1, 1, body))]


def grpc(n: int, k: int) -> list[Step]:
    ask = b"\x83" + _literal(b":path", b"/shop.Items/Get%d" % (k % 3)) + _literal(b"content-type", b"application/grpc")
    data = b"\0" + struct.pack(">I", 2) + bytes([8, k])
    answer = _frame(1, 4, 1, b"\x88") + _frame(0, 0, 1, data) + _frame(1, 5, 1, _literal(b"grpc-status", b"%d" % (k % 2)))
    return [(True, PREFACE + _frame(1, 4, 1, ask) + _frame(0, 1, 1, data)), (False, answer)]


def _mysql(seq: int, payload: bytes) -> bytes:
    return len(payload).to_bytes(3, "little") + bytes([seq]) + payload


def mysql(n: int, k: int) -> list[Step]:
    greeting = _mysql(0, b"\x0a8.0.32\0" + bytes(8) + b"\0caching_sha2_password\0")
    query = _mysql(0, b"\x03SELECT * FROM items WHERE id = %d AND owner = 'u%d'" % (k, n))
    eof = b"\xfe\0\0\x02\0"
    rows = _mysql(1, b"\x01") + _mysql(2, b"\x03def") + _mysql(3, eof) + _mysql(4, b"\x01a") + _mysql(5, eof)
    failed = _mysql(1, b"\xff" + struct.pack("<H", 1146) + b"#42S02no table %d" % k)
    return [(False, greeting), (True, _mysql(1, bytes(32))), (False, _mysql(2, b"\0\0\0\x02\0\0\0")), (True, query), (False, failed if k % 5 == 0 else rows)]


def _pg(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack(">I", len(body) + 4) + body


def postgres(n: int, k: int) -> list[Step]:
    startup = struct.pack(">II", 8 + 10, 196608) + b"user\0app\0\0"
    ready = _pg(b"Z", b"I")
    hello = _pg(b"R", struct.pack(">I", 0)) + _pg(b"S", b"server_version\x0015.2\0") + ready
    query = _pg(b"Q", b"SELECT * FROM items WHERE id = %d\0" % k)
    rows = _pg(b"T", b"\0\0") + _pg(b"D", b"\0\0") + _pg(b"C", b"SELECT 1\0") + ready
    failed = _pg(b"E", b"SERROR\0C42P01\0Mno table %d\0\0" % k) + ready
    return [(True, startup), (False, hello), (True, query), (False, failed if k % 5 == 0 else rows)]


def redis(n: int, k: int) -> list[Step]:
    key = b"user:%d" % n
    ask = b"*2\r\n$3\r\nGET\r\n$%d\r\n%s\r\n" % (len(key), key)
    value = b"v%d" % k
    return [(True, ask), (False, b"-ERR no %d\r\n" % k if k % 7 == 0 else b"$%d\r\n%s\r\n" % (len(value), value))]


def kafka(n: int, k: int) -> list[Step]:
    topic = b"orders-%d" % (k % 4)
    body = struct.pack(">hhi", 0, 2, n) + struct.pack(">h", 3) + b"cli" + struct.pack(">hii", 1, 1000, 1) + struct.pack(">h", len(topic)) + topic
    reply = struct.pack(">iih", n, 0, 3 if k % 6 == 0 else 0)
    return [(True, struct.pack(">i", len(body)) + body), (False, struct.pack(">i", len(reply)) + reply)]


def dns(n: int, k: int) -> list[Step]:
    name = b"".join(bytes([len(x)]) + x for x in (b"svc-%d" % (n % 10), b"local")) + b"\0"
    question = name + struct.pack(">HH", 1, 1)
    ask = struct.pack(">HHHHHH", n % 65536, 0x0100, 1, 0, 0, 0) + question
    answer = struct.pack(">HHHHHH", n % 65536, 0x8180, 1, 1, 0, 0) + question + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60 + k, 4) + bytes([10, 0, n % 256, k])
    return [(True, ask), (False, answer)]


def _short(text: bytes) -> bytes:
    return bytes([len(text)]) + text


def _method(kind: int, method: int, args: bytes) -> bytes:
    payload = struct.pack(">HH", kind, method) + args
    return b"\x01\0\x01" + struct.pack(">I", len(payload)) + payload + b"\xce"


def amqp(n: int, k: int) -> list[Step]:
    publish = _method(60, 40, b"\0\0" + _short(b"ex" if k % 2 else b"") + _short(b"key-%d" % k) + b"\0")
    beat = b"\x08\0\0" + bytes(4) + b"\xce"
    close = _method(10, 50, struct.pack(">H", 320) + _short(b"bye") + bytes(4))
    return [(True, AMQP_HEADER), (True, publish + beat), (False, close)]


EXCHANGES: dict[str, tuple[Callable[[int, int], list[Step]], int]] = {
    "http1": (http1, 80), "http2": (http2, 8443), "grpc": (grpc, 50051), "mysql": (mysql, 3306), "postgres": (postgres, 5432), "redis": (redis, 6379), "kafka": (kafka, 9092),
    "dns": (dns, 53), "amqp": (amqp, 5672),
}


def packets(protocol: str, n: int, k: int, ts: int) -> list[tuple[int, bool, bytes]]:
    """An exchange as packets, 1 ms apart, each step but a datagram cut in two where k says: time, from the client, bytes."""
    out = []
    for client, data in EXCHANGES[protocol][0](n, k):
        cut = len(data) if protocol == "dns" else max(1, k % len(data)) if len(data) > 1 else 1
        # the first packet of a connection must show the protocol, so it is never cut too short for that
        cut = max(cut, min(len(data), 24)) if not out else cut
        if data[cut:].startswith(RESPONSE):
            cut += 3  # by its looks, the rest of this request would pass for a response
        for part in (data[:cut], data[cut:]):
            if part:
                out.append((ts + 1_000_000 * len(out), client, part))
    return out
