"""DNS over datagrams: queries and responses are rows of their own, joined on the transaction id."""

from __future__ import annotations

from flowlens.codecs.base import Codec, CodecError, elapsed, lossy, message, number

MOST_PENDING, MOST_JUMPS = 1024, 10
#: Names of the record types.
TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}


def type_name(code: int) -> str:
    return TYPES.get(code, "OTHER")


def read_name(packet: bytes, at: int) -> tuple[str, int]:
    """A name, which may point elsewhere in the packet, and where the record goes on."""
    labels, after, jumps = [], None, 0
    while True:
        if at >= len(packet):
            raise CodecError("truncated name")
        size = packet[at]
        if size & 0xC0 == 0xC0:
            jumps += 1
            target = number(packet, at, 2) & 0x3FFF
            if at + 1 >= len(packet) or jumps > MOST_JUMPS or target >= len(packet):
                raise CodecError("bad name pointer")
            after = at + 2 if after is None else after
            at = target
        elif size == 0:
            return ".".join(labels) or ".", at + 1 if after is None else after
        else:
            if at + 1 + size > len(packet):
                raise CodecError("truncated label")
            labels.append(lossy(packet[at + 1:at + 1 + size]))
            at += 1 + size


class DnsCodec(Codec):
    protocol = "dns"

    def __init__(self):
        super().__init__()
        self.pending: dict[int, tuple[str, int]] = {}

    def feed(self, data: bytes, egress: bool, ts: int) -> list[dict]:
        if len(data) < 12:
            raise CodecError("datagram too short")
        answers = not egress and data[2] & 0x80
        return [self._response(data, ts)] if answers else self._query(data, ts)

    def _query(self, data: bytes, ts: int) -> list[dict]:
        if not number(data, 4, 2):
            return []
        name, at = read_name(data, 12)
        if at + 4 > len(data):
            raise CodecError("truncated question")
        if len(self.pending) >= MOST_PENDING:
            del self.pending[min(self.pending, key=lambda k: self.pending[k][1])]
        self.pending[number(data, 0, 2)] = name, ts
        return [message("dns", ts, "egress", method="QUERY", path=name, headers=[("qtype", type_name(number(data, at, 2)))], request_size_bytes=len(data))]

    def _response(self, data: bytes, ts: int) -> dict:
        at = 12
        for _ in range(number(data, 4, 2)):
            at = read_name(data, at)[1] + 4
            if at > len(data):
                raise CodecError("truncated question")
        name, since = self.pending.pop(number(data, 0, 2), (None, None))
        addresses, aliases, services, headers = [], [], [], []
        for _ in range(number(data, 6, 2)):
            try:
                at = read_name(data, at)[1]
            except CodecError:
                break
            kind, ttl, size = number(data, at, 2), number(data, at + 4, 4), number(data, at + 8, 2)
            at += 10
            if at + size > len(data):
                break
            body = data[at:at + size]
            try:
                if kind == 1 and size == 4:
                    addresses.append(".".join(map(str, body)))
                    if name:
                        headers.append(("dns_a_record", f"{name}|{number(body, 0, 4)}|{ttl}"))
                elif kind == 28 and size == 16:
                    addresses.append(":".join(f"{number(body, i, 2):x}" for i in range(0, 16, 2)))
                elif kind == 5:
                    aliases.append(read_name(data, at)[0])
                elif kind == 33 and size >= 6:
                    services.append(f"{read_name(data, at + 6)[0]}:{number(body, 4, 2)} (pri={number(body, 0, 2)}, w={number(body, 2, 2)})")
            except CodecError:
                pass  # one bad record; the others stand
            at += size
        return message("dns", ts, method="RESPONSE", path=name, status=data[3] & 15, latency_ns=elapsed(ts, since), headers=headers, response_size_bytes=len(data), payload_text=", ".join(addresses + aliases + services) or None)
