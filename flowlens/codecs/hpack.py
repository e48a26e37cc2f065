"""Header decompression for HTTP/2 (RFC 7541)."""

from __future__ import annotations

from flowlens.codecs.base import CodecError

#: The static table of RFC 7541, appendix A.
STATIC = [
    (":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https"),
    (":status", "200"), (":status", "204"), (":status", "206"), (":status", "304"), (":status", "400"), (":status", "404"), (":status", "500"),
    ("accept-charset", ""), ("accept-encoding", "gzip, deflate"), ("accept-language", ""), ("accept-ranges", ""), ("accept", ""),
    ("access-control-allow-origin", ""), ("age", ""), ("allow", ""), ("authorization", ""), ("cache-control", ""), ("content-disposition", ""),
    ("content-encoding", ""), ("content-language", ""), ("content-length", ""), ("content-location", ""), ("content-range", ""), ("content-type", ""),
    ("cookie", ""), ("date", ""), ("etag", ""), ("expect", ""), ("expires", ""), ("from", ""), ("host", ""), ("if-match", ""), ("if-modified-since", ""),
    ("if-none-match", ""), ("if-range", ""), ("if-unmodified-since", ""), ("last-modified", ""), ("link", ""), ("location", ""), ("max-forwards", ""),
    ("proxy-authenticate", ""), ("proxy-authorization", ""), ("range", ""), ("referer", ""), ("refresh", ""), ("retry-after", ""), ("server", ""),
    ("set-cookie", ""), ("strict-transport-security", ""), ("transfer-encoding", ""), ("user-agent", ""), ("vary", ""), ("via", ""), ("www-authenticate", ""),
]

#: The bytes that have a Huffman code of each length, appendix B; every byte not named has 28 bits. The code
#: is canonical: codes count up by length, then by byte.
SYMBOLS = {
    5: b"012aceiost",
    6: b" %-./3456789=A_bdfghlmnpru",
    7: b":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz",
    8: b"&*,;XZ",
    10: b'!"()?',
    11: b"'+|",
    12: b"#>",
    13: b"\x00$@[]~",
    14: b"^}",
    15: b"<`{",
    19: b"\\\xc3\xd0",
    20: b"\x80\x82\x83\xa2\xb8\xc2\xe0\xe2",
    21: b"\x99\xa1\xa7\xac\xb0\xb1\xb3\xd1\xd8\xd9\xe3\xe5\xe6",
    22: b"\x81\x84\x85\x86\x88\x92\x9a\x9c\xa0\xa3\xa4\xa9\xaa\xad\xb2\xb5\xb9\xba\xbb\xbd\xbe\xc4\xc6\xe4\xe8\xe9",
    23: b"\x01\x87\x89\x8a\x8b\x8c\x8d\x8f\x93\x95\x96\x97\x98\x9b\x9d\x9e\xa5\xa6\xa8\xae\xaf\xb4\xb6\xb7\xbc\xbf\xc5\xe7\xef",
    24: b"\t\x8e\x90\x91\x94\x9f\xab\xce\xd7\xe1\xec\xed",
    25: b"\xc7\xcf\xea\xeb",
    26: b"\xc0\xc1\xc8\xc9\xca\xcd\xd2\xd5\xda\xdb\xee\xf0\xf2\xf3\xff",
    27: b"\xcb\xcc\xd3\xd4\xd6\xdd\xde\xdf\xf1\xf4\xf5\xf6\xf7\xf8\xfa\xfb\xfc\xfd\xfe",
    30: b"\n\r\x16",
}


def _codes() -> dict[tuple[int, int], int]:
    """(length, code) to byte."""
    length = dict.fromkeys(range(256), 28) | {b: n for n, group in SYMBOLS.items() for b in group}
    out, code, last = {}, 0, 0
    for symbol in sorted(length, key=lambda b: (length[b], b)):
        code <<= length[symbol] - last
        last = length[symbol]
        out[last, code] = symbol
        code += 1
    return out


_DECODE = _codes()
_ENCODE = {symbol: key for key, symbol in _DECODE.items()}


def huffman_decode(data: bytes) -> bytes:
    out, code, size = bytearray(), 0, 0
    for byte in data:
        for bit in range(7, -1, -1):
            code, size = code << 1 | byte >> bit & 1, size + 1
            symbol = _DECODE.get((size, code))
            if symbol is not None:
                out.append(symbol)
                code = size = 0
            elif size > 30:
                raise CodecError("bad Huffman code")
    if size > 7 or code != (1 << size) - 1:
        raise CodecError("bad Huffman padding")
    return bytes(out)


def huffman_encode(data: bytes) -> bytes:
    bits, size = 0, 0
    for byte in data:
        n, code = _ENCODE[byte]
        bits, size = bits << n | code, size + n
    pad = -size % 8
    return ((bits << pad) | ((1 << pad) - 1)).to_bytes((size + pad) // 8, "big")


class Decoder:
    """One direction's table and its headers."""

    def __init__(self, size: int = 4096):
        self.limit = self.size = size
        self.table: list[tuple[str, str]] = []
        self.used = 0

    def decode(self, block: bytes) -> list[tuple[str, str]]:
        headers, at = [], 0
        while at < len(block):
            first = block[at]
            if first & 0x80:  # an entry of the tables
                index, at = self._integer(block, at, 7)
                headers.append(self._entry(index))
            elif first & 0xE0 == 0x20:  # the table's new size
                self.size, at = self._integer(block, at, 5)
                if self.size > self.limit:
                    raise CodecError("table size over the limit")
                self._evict()
            else:
                keep = first & 0xC0 == 0x40
                index, at = self._integer(block, at, 6 if keep else 4)
                if index:
                    name = self._entry(index)[0]
                else:
                    name, at = self._string(block, at)
                value, at = self._string(block, at)
                headers.append((name, value))
                if keep:
                    self.table.insert(0, (name, value))
                    self.used += len(name.encode()) + len(value.encode()) + 32
                    self._evict()
        return headers

    def _evict(self) -> None:
        while self.used > self.size and self.table:
            name, value = self.table.pop()
            self.used -= len(name.encode()) + len(value.encode()) + 32

    def _entry(self, index: int) -> tuple[str, str]:
        if 0 < index <= len(STATIC):
            return STATIC[index - 1]
        if 0 < index - len(STATIC) <= len(self.table):
            return self.table[index - len(STATIC) - 1]
        raise CodecError("no such header entry")

    @staticmethod
    def _integer(block: bytes, at: int, bits: int) -> tuple[int, int]:
        value = block[at] & (1 << bits) - 1
        at += 1
        if value < (1 << bits) - 1:
            return value, at
        shift = 0
        while True:
            if at >= len(block) or shift > 28:
                raise CodecError("bad integer")
            value += (block[at] & 0x7F) << shift
            shift += 7
            at += 1
            if not block[at - 1] & 0x80:
                return value, at

    def _string(self, block: bytes, at: int) -> tuple[str, int]:
        if at >= len(block):
            raise CodecError("truncated header")
        packed = block[at] & 0x80
        size, at = self._integer(block, at, 7)
        if at + size > len(block):
            raise CodecError("truncated header")
        raw = block[at:at + size]
        return (huffman_decode(raw) if packed else raw).decode("utf-8", "replace"), at + size
