"""Decompression of payloads, with a limit on what comes out. Every outcome is a status, never an exception."""

from __future__ import annotations

import zlib

import pyarrow as pa

LIMIT = 10 * 1024 * 1024
#: What a content encoding is called; deflate is treated as gzip.
NAMES = {"gzip": "gzip", "x-gzip": "gzip", "deflate": "gzip", "snappy": "snappy", "zstd": "zstd", "identity": "identity", "": "identity", "none": "identity"}


def kind_of(name: str | None) -> str | None:
    """The kind of a content encoding's name, in any case; None if unknown."""
    return NAMES.get((name or "").strip().lower())


class _TooLarge(Exception):
    pass


def _gunzip(data: bytes, limit: int) -> bytes:
    out = b""
    while data:  # members one after the other
        engine = zlib.decompressobj(47)
        out += engine.decompress(data, limit + 1 - len(out))
        if len(out) > limit:
            raise _TooLarge
        if not engine.eof:
            raise ValueError("truncated")
        data = engine.unused_data
    return out


def _stream(data: bytes, codec: str, limit: int) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(data), codec) as stream:
        out = stream.read(limit + 1)
    if len(out) > limit:
        raise _TooLarge
    return out


def _snappy(data: bytes, limit: int) -> bytes:
    if data[:10] == b"\xff\x06\x00\x00sNaPpY":  # framed: chunks of a kind, 3 bytes of length, 4 of checksum
        out, at = b"", 10
        while at + 4 <= len(data):
            kind, size = data[at], int.from_bytes(data[at + 1:at + 4], "little")
            body = data[at + 8:at + 4 + size]
            out += _snappy(body, limit) if kind == 0 else body if kind == 1 else b""
            if len(out) > limit:
                raise _TooLarge
            at += 4 + size
        return out
    size = shift = 0
    for at in range(min(5, len(data))):  # a raw block begins with its length
        size |= (data[at] & 0x7F) << shift
        shift += 7
        if not data[at] & 0x80:
            break
    if size > limit:
        raise _TooLarge
    return pa.Codec("snappy").decompress(data, size).to_pybytes()


def decompress(data: bytes | None, encoding: str | None, limit: int = LIMIT, enabled: tuple[str, ...] = ("gzip", "snappy", "zstd")) -> tuple[str, bytes | None, str | None]:
    """Status (success, not_compressed, unsupported, size_limit, failed), the bytes and a detail."""
    kind = kind_of(encoding)
    if kind == "identity":
        return "not_compressed", data, None
    if kind is None or kind not in enabled:
        return "unsupported", None, encoding
    try:
        raw = bytes(data or b"")
        return "success", _gunzip(raw, limit) if kind == "gzip" else _snappy(raw, limit) if kind == "snappy" else _stream(raw, "zstd", limit), None
    except _TooLarge:
        return "size_limit", None, str(limit)
    except Exception as error:  # whatever the bytes made the codec do
        return "failed", None, type(error).__name__
