"""Which protocol a payload speaks: by its first bytes, else by the ports. As a Column, and in Python for session parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.codecs.http1 import RESPONSE, VERBS
from flowlens.codecs.http2 import PREFACE

#: Ports that stand for a protocol, and the codes of a PostgreSQL start-up and of its backend messages.
PORTS = {3306: "mysql", 5432: "postgres", 6379: "redis", 50051: "grpc", 80: "http1", 8080: "http1", 8000: "http1", 443: "http1", 8443: "http1", 53: "dns", 9092: "kafka", 5672: "amqp"}
SSL_REQUEST, STARTUP_V3 = 80877103, 196608
HTTP1_STARTS = (RESPONSE, *VERBS)
BACKEND_TAGS, RESP_TAGS = b"RKZTDCENS", b"+-:$*"
#: A DNS datagram begins with a number that may be anything, so on its port the rest of the header is looked at first: no reserved bit, one question.
DNS_PORT, DNS_HEADER, DNS_OPCODES = 53, 12, (0, 1, 2, 4, 5)


def detect(payload: Column, src_port: Column, dst_port: Column) -> Column:
    """The protocol's name, or null. Tests in order: HTTP/2 preface, HTTP/1, a DNS header on its port, MySQL greeting, PostgreSQL, RESP, AMQP; then the ports, the destination's first."""
    head = F.hex(F.substring(payload, F.lit(1), F.lit(128)))

    def starts(*prefixes: bytes) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | head.startswith(p.hex().upper())
        return out

    def word(at: int) -> Column:
        """The unsigned number in four bytes, null if they are not there."""
        digits = F.substring(head, 2 * at + 1, 8)
        return F.when(F.length(digits) == 8, F.conv(digits, 16, 10).cast("long"))

    startup = ((word(0) == 8) & (word(4) == SSL_REQUEST)) | ((word(4) == STARTUP_V3) & word(0).between(8, 10000))
    backend = starts(*[bytes([t]) for t in BACKEND_TAGS]) & word(1).between(4, 1_000_000)
    resp = starts(*[bytes([t]) for t in RESP_TAGS]) & head.rlike("^(?:..)*0D0A")
    octet = lambda at: F.conv(F.substring(head, 2 * at + 1, 2), 16, 10).cast("int")
    opcode = F.shiftright(octet(2), 3).bitwiseAND(F.lit(15))
    dns = ((src_port == DNS_PORT) | (dst_port == DNS_PORT)) & (F.octet_length(payload) >= DNS_HEADER) & opcode.isin(*DNS_OPCODES) & (octet(3).bitwiseAND(F.lit(0x40)) == 0) & (octet(4) == 0) & (octet(5) == 1)
    by_port = F.lit(None).cast("string")
    for port_column in (src_port, dst_port):
        for port, name in PORTS.items():
            by_port = F.when(port_column == port, F.lit(name)).otherwise(by_port)
    return (
        F.when(payload.isNull() | (F.octet_length(payload) == 0), F.lit(None).cast("string"))
        .when(starts(PREFACE), "http2").when(starts(*HTTP1_STARTS), "http1")
        .when(F.coalesce(dns, F.lit(False)), "dns")
        .when(F.substring(head, 7, 4) == "000A", "mysql")
        .when(F.coalesce(startup, F.lit(False)) | F.coalesce(backend, F.lit(False)), "postgres")
        .when(resp, "redis").when(starts(b"AMQP") & (F.octet_length(payload) >= 8), "amqp").otherwise(by_port)
    )


def detect_bytes(payload: bytes, src_port: int | None, dst_port: int | None) -> str | None:
    """The same for one payload."""
    if not payload:
        return None
    if payload.startswith(PREFACE):
        return "http2"
    if payload.startswith(HTTP1_STARTS):
        return "http1"
    if DNS_PORT in (src_port, dst_port) and len(payload) >= DNS_HEADER and payload[2] >> 3 & 15 in DNS_OPCODES and not payload[3] & 0x40 and payload[4:6] == b"\0\1":
        return "dns"
    if payload[3:5] == b"\x00\x0a":
        return "mysql"
    size, code = int.from_bytes(payload[:4], "big"), int.from_bytes(payload[4:8], "big")
    if len(payload) >= 8 and (size == 8 and code == SSL_REQUEST or code == STARTUP_V3 and 8 <= size <= 10000):
        return "postgres"
    if len(payload) >= 5 and payload[0] in BACKEND_TAGS and 4 <= int.from_bytes(payload[1:5], "big") <= 1_000_000:
        return "postgres"
    if payload[0] in RESP_TAGS and b"\r\n" in payload[:128]:
        return "redis"
    if payload.startswith(b"AMQP") and len(payload) >= 8:
        return "amqp"
    return PORTS.get(dst_port) or PORTS.get(src_port)
