"""Addresses, ports, connection keys and codes, as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from flowlens import schema

#: Ports a protocol's servers listen on.
SERVER_PORTS = {
    "http1": (80, 443, 8080, 8443), "http2": (80, 443, 8080, 8443), "grpc": (80, 443, 8080, 8443), "mysql": (3306,), "postgres": (5432,), "redis": (6379,),
    "dns": (53,), "kafka": (9092,), "amqp": (5672,),
}
#: The parameters of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def format_ipv4(address: Column) -> Column:
    """A 32-bit address in host order as a dotted quad."""
    a = address.cast("long")
    return F.concat_ws(".", *[F.shiftright(a, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def named(code: Column, names: tuple[str, ...]) -> Column:
    """The name of a code; null for one that has none."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.when(code >= 0, code).cast("int"))


def coded(name: Column, names: tuple[str, ...]) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0).cast("long")) - 1


def null_if_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("long"))


def tls_cookie(pid: Column, tgid: Column) -> Column:
    """The key of a TLS session that has no socket: the top bit, the pid, the tgid."""
    return F.lit(-(1 << 63)).cast("long").bitwiseOR(F.shiftleft(pid.cast("long"), 32)).bitwiseOR(tgid.cast("long"))


def session_key(cookie: Column, event_type: Column, pid: Column, tgid: Column) -> Column:
    return F.when((cookie == 0) & (event_type == "TlsData"), tls_cookie(pid, tgid)).otherwise(cookie)


def worker_of(cookie: Column, workers: int) -> Column:
    """cookie modulo workers, the cookie being read as unsigned."""
    wrap = (1 << 64) % workers
    return F.pmod(F.pmod(cookie, F.lit(workers).cast("long")) + F.when(cookie < 0, F.lit(wrap)).otherwise(F.lit(0)), F.lit(workers).cast("long"))


def flow_key(src_addr: Column, src_port: Column, dst_addr: Column, dst_port: Column, ip_proto: Column) -> Column:
    """One key for both directions of a connection: its ends in order, and the protocol."""
    first = (src_addr < dst_addr) | ((src_addr == dst_addr) & (src_port <= dst_port))
    here, there = F.concat_ws(":", src_addr, src_port), F.concat_ws(":", dst_addr, dst_port)
    return F.concat_ws("/", F.when(first, F.concat_ws("-", here, there)).otherwise(F.concat_ws("-", there, here)), ip_proto)


@F.pandas_udf(T.LongType())
def fnv_flow_cookie(src_addr: pd.Series, src_port: pd.Series, dst_addr: pd.Series, dst_port: pd.Series, ip_proto: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a hash of the ordered five-tuple, big-endian, as the capture computes it."""
    sa, sp, da, dp = (x.to_numpy(np.uint64) for x in (src_addr, src_port, dst_addr, dst_port))
    first = (sa < da) | ((sa == da) & (sp <= dp))
    ends = [np.where(first, x, y) for x, y in ((sa, da), (sp, dp), (da, sa), (dp, sp))]
    out = np.full(len(sa), FNV_OFFSET, np.uint64)
    for value, size in zip([*ends, ip_proto.to_numpy(np.uint64)], (4, 2, 4, 2, 1), strict=True):
        for shift in range(8 * (size - 1), -1, -8):
            out = (out ^ (value >> np.uint64(shift) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return pd.Series(out.view(np.int64))


@F.pandas_udf(T.LongType())
def socket_key(pid_tgid: pd.Series, src_addr: pd.Series, dst_addr: pd.Series, src_port: pd.Series, dst_port: pd.Series) -> pd.Series:
    """The key that socket events carry; it differs from the packet's key."""
    out = pid_tgid.to_numpy(np.int64).view(np.uint64)
    for address in (src_addr, dst_addr):
        out = (out ^ address.to_numpy(np.uint64)) * np.uint64(FNV_PRIME)
    return pd.Series((out ^ (src_port.to_numpy(np.uint64) << np.uint64(16) | dst_port.to_numpy(np.uint64))).view(np.int64))


def _listens(protocol: Column, port: Column) -> Column:
    out = F.lit(False)
    for name, ports in SERVER_PORTS.items():
        out = F.when(protocol == name, port.isin(*ports)).otherwise(out)
    return out


def swapped(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """Whether the source is the server: it has the protocol's port and the destination has not, or, if neither has, the lower one."""
    return F.when(_listens(protocol, dst_port), F.lit(False)).when(_listens(protocol, src_port), F.lit(True)).otherwise(src_port < dst_port)


def server_ports(protocol: Column, src_port: Column, dst_port: Column) -> tuple[Column, Column]:
    """The client's and the server's port."""
    swap = swapped(protocol, src_port, dst_port)
    return F.when(swap, dst_port).otherwise(src_port), F.when(swap, src_port).otherwise(dst_port)


def identity_name(domain: Column, address: Column, port: Column) -> Column:
    """What a service is called: its domain, else address:port."""
    return F.coalesce(domain, F.concat(format_ipv4(address), F.lit(":"), port.cast("string")))


def wall_clock(timestamp_ns: Column, boot_offset_ns: Column | int) -> Column:
    """The time of day of a monotonic clock's reading."""
    offset = boot_offset_ns if isinstance(boot_offset_ns, Column) else F.lit(boot_offset_ns)
    return F.timestamp_micros(F.floor((timestamp_ns + offset) / 1000).cast("long"))


def c_string(raw: Column) -> Column:
    """Bytes up to the first NUL as text; `<invalid>` if they are not UTF-8."""
    head = F.substring_index(raw.cast("string"), "\0", 1)
    return F.when(F.is_valid_utf8(raw.cast("string")), head).otherwise(F.lit("<invalid>"))


def length_encoded(raw: Column) -> Column:
    """A length-encoded integer of the MySQL protocol at the start of raw: a first byte up to 0xFB stands for itself, above it
    tells how many bytes follow, the least first. Null if bytes are missing or the first is no length."""
    digits = F.hex(raw)
    first = F.conv(F.substring(digits, 1, 2), 16, 10).cast("long")

    def little(size: int) -> Column:
        turned = F.concat(*[F.substring(digits, 3 + 2 * i, 2) for i in range(size - 1, -1, -1)])
        return F.when(F.octet_length(raw) > size, F.conv(turned, 16, -10).cast("long"))

    return F.when(first <= 0xFB, first).when(first == 0xFC, little(2)).when(first == 0xFD, little(3)).when(first == 0xFE, little(8))


def capped_text(raw: Column, most: int) -> Column:
    """The first `most` bytes as text, what is no UTF-8 shown by a mark; a character that the cut parts is left out."""
    text = F.make_valid_utf8(F.substring(raw, F.lit(1), F.lit(most)).cast("string"))
    whole = F.make_valid_utf8(raw.cast("string"))
    # a cut inside a character leaves one mark at the end that the whole text has not at that place
    cut = (F.octet_length(raw) > most) & text.endswith("\ufffd") & ~F.substring(whole, 1, F.length(text)).endswith("\ufffd")
    return F.when(cut, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def payload_slice(payload: Column, length: Column) -> Column:
    """The payload's bytes that count: its stated length, at most the record's."""
    return F.substring(payload, F.lit(1), F.least(length, F.lit(schema.MAX_PAYLOAD)).cast("int"))


def tls_name(library: Column) -> Column:
    """The exported name of a TLS library; null for none."""
    out = F.lit(None).cast("string")
    for name, shown in schema.TLS_NAMES.items():
        out = F.when(library == name, F.lit(shown)).otherwise(out)
    return out
